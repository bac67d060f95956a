"""Embedding job and filtered exact nearest neighbours.

Retrieval is restricted to an explicit candidate-id list per query (the
portfolio's 2n products), so the work is an equi-join on the id followed by a
top-k over at most len(candidates) rows per query: no all-pairs product.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestegg.session import bounded_broadcast, cut_lineage

#: Dimensions of the default embedder's term space; vectors are sparse, so it costs only the IDF weights.
DIM = 1 << 20
#: Rows of a piece (:func:`pieces_searched`), queries that meet them at once, and candidates whose distance is taken at once.
PIECE_ROWS, PIECE_QUERIES, PIECE_PAIRS = 16384, 128, 1 << 17
#: Components above are left to plain expressions, as are non-finite ones: their squares may overflow.
LARGEST = 1e100


def fit_embedder(docs: DataFrame, text_col: str = "page_content", dim: int = DIM) -> PipelineModel:
    """Default embedder: tokens -> hashed term counts -> IDF (fitted on ``docs``) -> L2 normalise."""
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"(?U)\W+", minTokenLength=1),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_vec", p=2.0),
    ])
    return pipe.fit(docs)


def embed(df: DataFrame, model: PipelineModel, text_col: str = "page_content",
          out: str = "embedding") -> DataFrame:
    """Apply a fitted embedder; the sparse vector becomes map<int, double>, dimension to weight."""
    renamed = df if text_col == "page_content" else df.withColumnRenamed(text_col, "page_content")
    vec = F.unwrap_udt("_vec")
    res = model.transform(renamed).withColumn(out, F.map_from_arrays(vec["indices"], vec["values"]))
    res = res.drop("_tok", "_tf", "_tfidf", "_vec")
    return res if text_col == "page_content" else res.withColumnRenamed("page_content", text_col)


def build_vector_table(docs: DataFrame, text_col: str = "page_content", dim: int = DIM,
                       path: str | None = None, fit_on: DataFrame | None = None) -> tuple[DataFrame, PipelineModel]:
    """Fit the default embedder, embed ``docs`` and store the vectors as a Parquet table.

    The embedder (its IDF weights) is fitted on ``fit_on`` when given (e.g. the whole
    catalog while only the retrievable documents are embedded), else on ``docs``.
    ``path`` defaults to a fresh folder under the session's checkpoint folder. Returns
    the re-read table and the fitted model (needed to embed queries the same way).
    """
    model = fit_embedder(fit_on if fit_on is not None else docs, text_col, dim)
    vecs = embed(docs, model, text_col)
    if path is None:
        return cut_lineage(vecs, "document_vectors"), model
    vecs.write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path), model


def update_vector_table(docs: DataFrame, path: str, embed_docs, id_col: str = "product_id", text_col: str = "page_content",
                        buckets: int = 64) -> dict[str, int]:
    """A7 kept up to date: only texts that are new or changed are embedded, and only their buckets are written.

    The table at ``path`` holds the columns of ``docs``, ``content_hash`` and what ``embed_docs`` (DataFrame ->
    DataFrame with ``embedding``) adds, in folders by a hash of the id. Rows that are in it with the same hash are
    kept as they are; rows that ``docs`` has no more go. The embedder must be the same at every call (a refitted
    one needs a new path). The change set is written first, so a failure leaves the table as it was or each bucket
    whole; running it again finishes the work. Returns the rows embedded, kept and removed. Ids must be unique.
    """
    spark = docs.sparkSession
    bucket = F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int")
    now = docs.withColumns({"content_hash": F.sha2(F.coalesce(F.to_json(F.struct(*docs.columns)), F.lit("")), 256), "bucket": bucket})
    try:
        old = spark.read.parquet(path).where(F.col(id_col).isNotNull())
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        old = None
    keys = [id_col, "content_hash"]
    if old is None:
        changed, gone = now, now.limit(0).select(id_col, "bucket")
    else:
        changed = now.join(old.select(*keys), keys, "left_anti")
        gone = cut_lineage(old.select(id_col, "bucket").join(now.select(id_col), id_col, "left_anti"), "vectors_gone")
    fresh = cut_lineage(embed_docs(changed), "vectors_fresh")
    counts = {"embedded": fresh.count(), "removed": gone.count()}
    if old is None:
        fresh.write.partitionBy("bucket").parquet(path)
        return counts | {"kept": 0}
    touched = fresh.select("bucket").unionByName(gone.select("bucket")).distinct()
    kept = old.join(F.broadcast(touched), "bucket", "left_semi").join(now.select(*keys), keys, "left_semi")
    # A bucket whose rows are all gone gets no file by a dynamic overwrite, therefore it keeps a row without id.
    blank = touched.select("bucket", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fresh.schema.fields if f.name != "bucket"])
    rows = cut_lineage(kept.unionByName(fresh).unionByName(blank), "vectors_next")
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return counts | {"kept": now.count() - counts["embedded"]}


def read_vector_table(spark, path: str, id_col: str = "product_id") -> DataFrame:
    """The rows of a table that :func:`update_vector_table` keeps."""
    return spark.read.parquet(path).where(F.col(id_col).isNotNull()).drop("bucket")


def embed_with(df: DataFrame, text_col: str, model_fn, out: str = "embedding",
               return_type: str = "array<float>") -> DataFrame:
    """User-supplied embedding model applied per Arrow batch (``model_fn(pd.Series) -> pd.Series``)."""
    from pyspark.sql.functions import pandas_udf
    udf = pandas_udf(model_fn, return_type)
    return df.withColumn(out, udf(F.col(text_col)))


def squared_l2(a: Column, b: Column) -> Column:
    """Sum of squared differences, in double, element order."""
    diffs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, d: acc + d)


def sparse_squared_l2(a: Column, b: Column) -> Column:
    """The same of two sparse vectors, by their norms and product; rounded, so that what is equal ties."""
    add = lambda acc, x: acc + x
    norm = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda acc, x: acc + x * x)
    products = F.transform(F.map_entries(a), lambda e: e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))
    return F.round(norm(a) + norm(b) - 2 * F.aggregate(products, F.lit(0.0), add), 12)


def _l2(kind: T.DataType):
    return sparse_squared_l2 if isinstance(kind, T.MapType) else squared_l2


def vector_blocks(corpus: DataFrame, id_col: str = "doc_id", n_blocks: int = 64) -> tuple[DataFrame, list]:
    """The corpus with its ``block`` (the nearest of ``n_blocks`` pivots) and a number of the row (``place``), written,
    and (pivot, radius, rows) of each block.

    Pivots are the first rows by a hash of the id; their number bounds what is collected.
    """
    l2 = _l2(corpus.schema["embedding"].dataType)
    rows = corpus.where(F.col("embedding").isNotNull())
    pivots = [r.embedding for r in rows.orderBy(F.xxhash64(id_col), id_col).select("embedding").limit(n_blocks).collect()]
    if not pivots:
        return rows.withColumns({"block": F.lit(0), "place": F.lit(0).cast("long")}), []
    nearest = F.array_min(F.transform(F.array(*map(_literal, pivots)), lambda p, i: F.struct(l2(F.col("embedding"), p).alias("d"), i.alias("i"))))
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    placed = cut_lineage(rows.withColumn("_near", nearest).withColumns(
        {"block": F.col("_near.i"), "to_pivot": F.sqrt(F.greatest(F.col("_near.d"), F.lit(0.0)))}).drop("_near"), "vector_blocks")
    sizes = {r.block: (r.radius, r.n) for r in placed.groupBy("block").agg(F.max("to_pivot").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    return placed.drop("to_pivot"), [(p, *sizes.get(i, (0.0, 0))) for i, p in enumerate(pivots)]


def blocks_to_read(queries: DataFrame, blocks: list, fetch_k: int) -> DataFrame:
    """``queries`` with ``block``: the blocks that can hold one of its ``fetch_k`` nearest rows.

    The distance to a block's rows lies between (to the pivot - radius) and (to the pivot + radius). The
    ``fetch_k`` nearest are no farther than the least upper bound under which that many rows lie for sure; a
    block whose lower bound is above isn't read. A margin covers rounding.
    """
    l2 = _l2(queries.schema["qvec"].dataType)
    pivots = F.array(*[_literal(p) for p, _, _ in blocks])
    sizes = F.array(*[F.struct(F.lit(float(r)).alias("r"), F.lit(int(n)).alias("n")) for _, r, n in blocks])
    bounds = F.transform(pivots, lambda p, i: F.struct(
        F.sqrt(F.greatest(l2(F.col("qvec"), p), F.lit(0.0))).alias("d"), F.get(sizes, i)["r"].alias("r"), F.get(sizes, i)["n"].alias("n"), i.alias("block")))
    queries = queries.withColumn("_bounds", bounds)
    rows = lambda limit: F.aggregate("_bounds", F.lit(0), lambda n, b: n + F.when(b["d"] + b["r"] <= limit, b["n"]).otherwise(0))
    enough = F.filter(F.transform("_bounds", lambda b: b["d"] + b["r"]), lambda u: rows(u) >= fetch_k)
    reach = F.coalesce(F.array_min(enough), F.lit(float("inf"))) * (1 + 1e-9) + 1e-9
    return (queries.withColumn("_reach", reach)
            .withColumn("block", F.explode(F.transform(F.filter("_bounds", lambda b: (b["n"] > 0) & (b["d"] - b["r"] <= F.col("_reach"))), lambda b: b["block"])))
            .drop("_bounds", "_reach"))


def _literal(vector) -> Column:
    if isinstance(vector, dict):
        return F.create_map(*[F.lit(x) for kv in vector.items() for x in kv]) if vector else F.create_map().cast("map<int,double>")
    return F.array(*[F.lit(float(x)) for x in vector])


class Piece:
    """Some rows of the corpus, as arrays: their numbers, ids and vectors, and the order of the ids (NULL first)."""

    def __init__(self, places: np.ndarray, ids: pa.Array, x: np.ndarray, k: int):
        order = pc.sort_indices(pa.table({"id": ids}), sort_keys=[("id", "ascending")], null_placement="at_start").to_numpy()
        self.places, self.ids, self.x, self.k = places[order], ids.take(pa.array(order)), x[order], k
        self.thin()
        self.norms = (self.x * self.x).sum(axis=1)

    def thin(self) -> None:
        """Of equal vectors only the first ``k`` by id can be among the nearest ``k``."""
        same = np.unique(np.ascontiguousarray(self.x).view(np.dtype((np.void, self.x.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()
        by = np.argsort(same, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(same[by]) != 0])
        nth = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
        if nth.max() >= self.k:
            kept = np.sort(by[nth < self.k])
            self.places, self.ids, self.x = self.places[kept], self.ids.take(pa.array(kept)), self.x[kept]

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, number of the row, distance) of the ``k`` nearest rows of each query, ties by id.

        A matrix product leaves the rows that can be among them, up to its rounding; their distances are then
        summed in element order, as :func:`squared_l2` does.
        """
        own = (queries * queries).sum(axis=1)
        rough = self.norms[None, :] - 2 * (queries @ self.x.T)
        if len(self.norms) > self.k:
            least = np.partition(rough, self.k - 1, axis=1)[:, self.k - 1]
            asked, rows = np.nonzero(rough <= (least + 1e-9 * (1 + own + self.norms.max()))[:, None])
        else:
            asked, rows = np.nonzero(np.ones(rough.shape, bool))
        distance = np.empty(len(rows))
        for a in range(0, len(rows), PIECE_PAIRS):
            part = slice(a, a + PIECE_PAIRS)
            diff = queries[asked[part]] - self.x[rows[part]]
            distance[part] = np.add.accumulate(diff * diff, axis=1)[:, -1]
        by = np.lexsort((rows, distance, asked))
        starts = np.searchsorted(asked[by], np.arange(len(queries)))
        kept = by[np.arange(len(by)) - starts[asked[by]] < self.k]
        return asked[kept], rows[kept], distance[kept]


def _vectors(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dimensions)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """piece, asks and rows of each run of equal piece and asks."""
    piece, asks = batch.column("piece").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
    cuts = (np.flatnonzero((np.diff(piece) != 0) | (asks[1:] != asks[:-1])) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield int(piece[a]), bool(asks[a]), batch.slice(a, b - a)


def pieces_searched(pairs: DataFrame, placed: DataFrame, blocks: list, k: int, id_col: str, dimensions: int) -> DataFrame:
    """(_q, place, id, distance): of each query's blocks (``pairs``), the ``k`` nearest rows of each piece, ties by id.

    Blocks are dealt to pieces of about ``PIECE_ROWS`` rows. A task holds one piece at a time; the queries that
    read it come behind it by the shuffle and stream through, so that neither a task nor the driver holds them all.
    """
    counts = [-(-n // PIECE_ROWS) for _, _, n in blocks]
    total = sum(counts)
    tasks = max(1, min(total, max(placed.sparkSession.sparkContext.defaultParallelism, -(-sum(n for _, _, n in blocks) // PIECE_ROWS))))
    first = F.get(F.array(*[F.lit(sum(counts[:i])) for i in range(len(counts))]), F.col("block"))
    count = F.get(F.array(*map(F.lit, counts)), F.col("block"))
    id_type = placed.schema[id_col].dataType
    rows = placed.select((first + F.pmod(F.xxhash64("place"), count)).cast("int").alias("piece"), F.lit(False).alias("asks"), F.col("place").alias("number"),
                         F.col(id_col).alias("id"), F.col("embedding").alias("vector"))
    asked = pairs.select(F.explode(F.sequence(first, first + count - 1)).alias("piece"), F.lit(True).alias("asks"), F.col("_q").alias("number"),
                         F.lit(None).cast(id_type).alias("id"), F.col("qvec").alias("vector"))
    if rows.schema["vector"].dataType != asked.schema["vector"].dataType:
        rows, asked = (d.withColumn("vector", F.col("vector").cast("array<double>")) for d in (rows, asked))
    out = T.StructType([T.StructField("_q", T.LongType()), T.StructField("place", T.LongType()), T.StructField("id", id_type), T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, piece = None, [], None
        for batch in batches:
            for at, asks, part in _runs(batch) if batch.num_rows else ():
                if at != now:
                    now, held, piece = at, [], None
                if not asks:
                    held.append(part)
                    continue
                if held:
                    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    piece, held = Piece(whole.column("number").to_numpy(), whole.column("id"), _vectors(whole.column("vector"), dimensions), k), []
                if piece:
                    numbers, x = part.column("number").to_numpy(), _vectors(part.column("vector"), dimensions)
                    for a in range(0, len(x), PIECE_QUERIES):
                        q, r, distance = piece.nearest(x[a : a + PIECE_QUERIES])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(numbers[a + q]), pa.array(piece.places[r]), piece.ids.take(pa.array(r)), pa.array(distance)], names=out.names)

    dealt = rows.unionByName(asked).repartitionById(tasks, F.pmod("piece", F.lit(tasks)).cast("int")).sortWithinPartitions("piece", "asks")
    return dealt.mapInArrow(run, out)


def _plain(vector: Column, dimensions: int) -> Column:
    """Vectors that arrays can hold: of the usual length, without a null, non-finite or very large component."""
    fits = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < LARGEST))
    return F.coalesce((F.size(vector) == dimensions) & fits, F.lit(False))


def global_nearest(queries: DataFrame, corpus: DataFrame, fetch_k: int, query_key: list[str] | None = None, id_col: str = "doc_id",
                   n_blocks: int = 64) -> DataFrame:
    """The ``fetch_k`` nearest rows of the whole corpus for each query, exactly: query columns, id, distance, rank.

    Queries meet the pieces of the blocks to read (:func:`pieces_searched`), and the nearest of each piece are
    ranked; ties go by id. Vectors that arrays don't hold (sparse ones, odd components or lengths) are met by an
    equi-join of the blocks. Rows without a vector take no part.
    """
    qk = query_key or ["query_id"]
    placed, blocks = vector_blocks(corpus, id_col, n_blocks)
    l2 = _l2(corpus.schema["embedding"].dataType)
    ranked = lambda df, by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("distance", id_col))).where(F.col("rank") <= fetch_k)
    joined = lambda asked, rows: asked.join(rows, "block").withColumn("distance", l2(F.col("qvec"), F.col("embedding"))).drop("qvec", "embedding", "block", "place")
    dimensions = Counter(len(p) for p, _, _ in blocks).most_common(1)[0][0] if blocks else 0
    if not dimensions or isinstance(corpus.schema["embedding"].dataType, T.MapType):
        pairs = blocks_to_read(queries, blocks, fetch_k) if blocks else queries.withColumn("block", F.lit(0)).limit(0)
        return ranked(joined(pairs, placed), qk)
    queries = cut_lineage(queries.withColumns({"_q": F.monotonically_increasing_id(), "_plain": _plain(F.col("qvec"), dimensions)}), "vector_queries")
    rest = [c for c in queries.columns if c not in ("qvec", "_q", "_plain")]
    pairs = cut_lineage(blocks_to_read(queries.select("_q", "qvec", "_plain"), blocks, fetch_k).drop("qvec"), "vector_reads")
    pairs = pairs.join(queries.select("_q", "qvec"), "_q")
    usual = _plain(F.col("embedding"), dimensions)
    near = pieces_searched(pairs.where("_plain"), placed.where(usual), blocks, fetch_k, id_col, dimensions).withColumnRenamed("id", id_col)
    near = ranked(near, ["_q"]).drop("rank").join(queries.select("_q", *rest), "_q")
    payload = [c for c in placed.columns if c not in (id_col, "embedding", "block", "place")]
    if payload:
        near = near.join(placed.select("place", *payload), "place")
    known = queries.select("_q", *rest)
    odd = joined(pairs.where("_plain"), placed.where(~usual)).unionByName(joined(pairs.where("not _plain"), placed))
    odd = odd.drop("_plain").join(known, "_q")
    return ranked(near.drop("place", "_q").unionByName(odd.drop("_q")), qk)


def filtered_knn(queries: DataFrame, corpus: DataFrame, k: int = 3, query_key: list[str] | None = None,
                 id_col: str = "doc_id", fetch_k: int | None = None, corpus_rows: int | None = None) -> DataFrame:
    """k nearest corpus rows per query, among the query's candidate ids only.

    ``queries``: ``query_key`` columns, ``qvec`` array<float> or sparse (``embed``), ``cand_ids`` array.
    ``corpus``: ``id_col``, ``embedding`` of the same form (plus any payload columns).
    The answer is exact: candidates are filtered first, then ranked (an index that
    fetches a fixed number of global neighbours and filters afterwards may return
    fewer than k; this never does). Ties are broken by id.
    Returns query_key + id_col + distance + rank (1-based) + payload. Pairs are ranked without the payload,
    which joins the k rows left; ``corpus_rows`` (counted by the caller) tells if the corpus can be broadcast.

    With ``fetch_k`` it does as such an index: the ``fetch_k`` nearest rows of the whole corpus are searched
    (:func:`global_nearest`) and filtered by the candidate ids afterwards, so that there may be fewer than ``k``.
    """
    qk = query_key or ["query_id"]
    if fetch_k is not None:
        hits = global_nearest(queries.select(*qk, "qvec", "cand_ids"), corpus, fetch_k, qk, id_col)
        w = Window.partitionBy(*qk).orderBy("distance", id_col)
        return (hits.where(F.array_contains("cand_ids", F.col(id_col))).drop("cand_ids")
                .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
    payload = [c for c in corpus.columns if c not in (id_col, "embedding")]
    found = [id_col]
    if payload:  # rows of one id are told apart by their number
        found.append("_copy")
        copies = Window.partitionBy(id_col).orderBy(F.to_json(F.struct(*payload)))
        corpus = corpus.withColumn("_copy", F.row_number().over(copies))
    pairs = (queries.select(*qk, "qvec", F.explode(F.array_distinct("cand_ids")).alias(id_col))
             .join(bounded_broadcast(corpus.select(*found, "embedding"), known_rows=corpus_rows, row_bytes=2048), id_col))
    l2 = _l2(queries.schema["qvec"].dataType)
    scored = pairs.withColumn("distance", l2(F.col("qvec"), F.col("embedding"))).drop("qvec", "embedding")
    w = Window.partitionBy(*qk).orderBy("distance", id_col)
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if payload:
        best = best.join(bounded_broadcast(corpus.select(*found, *payload), known_rows=corpus_rows, row_bytes=4096), found).drop("_copy")
    return best


def joined_texts(hits: DataFrame, query_key: list[str], text_col: str, sep: str, out: str) -> DataFrame:
    """Retrieved texts in distance order joined by ``sep`` (k rows per query at most)."""
    return (hits.groupBy(*query_key)
            .agg(F.array_sort(F.collect_list(F.struct("rank", text_col))).alias("_h"))
            .select(*query_key, F.array_join(F.transform("_h", lambda x: x[text_col]), sep).alias(out)))
