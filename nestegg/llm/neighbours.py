"""Approximate nearest neighbours by inner product: a hash-prefix forest.

The vectors are dealt to shards of about ``SHARD_ROWS`` rows, at least one a core. A task builds a forest
over its shard: ``TREES`` sorted arrays of ``HASH_BITS``-bit hash strings (signs of random projections).
A query descends in every tree to its longest prefix match; then all trees ascend together, one bit a
step, until the prefixes that match hold enough candidates. These are ranked exactly, in double
precision, and the best of each shard meet in a top-k per query. Inner products of vectors of unequal
length are turned into angles by one further coordinate, sqrt(longest^2 - length^2).

Queries come to the shards by the shuffle, behind the shard's rows, and stream through its forest batch
by batch: neither the driver nor a task holds the query set, and nothing is broadcast. Each query is
copied to each shard; no pair of vectors outside a query's candidates is formed.

How many candidates are enough is fitted in a task: on at most ``FIT_ROWS`` vectors (in the order of a
hash of the id) and ``FIT_QUERIES`` queries, the smallest share of a shard in ``SHARES`` that reaches
``FIT_RECALL`` against brute force. Its last value is 1, all rows, for vectors that the hash strings
don't separate at all. Every row is indexed.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component take no
part, neither do rows without an id, or of another dimension than most; equal scores go by the id;
repeated rows of an id are candidates each, and one query (the least of its vectors).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nestegg.llm.common import stage

TREES, HASH_BITS, SHARD_ROWS = 96, 24, 16384
FIT_ROWS, FIT_QUERIES, FIT_RECALL = 4096, 160, 0.965
SHARES = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.7, 1.0)


class Plan(NamedTuple):
    projections: np.ndarray  # (dimensions + 1, TREES * HASH_BITS)
    share: float


def hash_strings(x: np.ndarray, projections: np.ndarray) -> np.ndarray:
    """One hash string for each vector (row) and tree (column), as an integer."""
    bits = (x @ projections > 0).reshape(len(x), TREES, HASH_BITS)
    return bits @ (1 << np.arange(HASH_BITS - 1, -1, -1, dtype=np.int64))


class Forest:
    """Sorted arrays of hash strings over one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, plan: Plan):
        self.ids, self.vectors, self.plan = ids, vectors, plan
        norm = np.linalg.norm(vectors, axis=1)
        self.longest = norm.max()
        lifted = np.hstack([vectors / self.longest, np.sqrt(np.maximum(0, 1 - (norm / self.longest) ** 2))[:, None]])
        strings = hash_strings(lifted, plan.projections)
        self.order = np.argsort(strings, axis=0, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=0)

    def matches(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query, tree and prefix length, the range of the sorted array with that prefix."""
        flat = np.hstack([queries / np.linalg.norm(queries, axis=1, keepdims=True), np.zeros((len(queries), 1))])
        strings = hash_strings(flat, self.plan.projections)
        lo = np.empty((len(queries), TREES, HASH_BITS + 1), np.int32)
        hi = np.empty_like(lo)
        drop = HASH_BITS - np.arange(HASH_BITS + 1)
        first = strings[:, :, None] >> drop << drop
        last = first + (np.int64(1) << drop)
        for t in range(TREES):
            lo[:, t] = np.searchsorted(self.sorted[:, t], first[:, t])
            hi[:, t] = np.searchsorted(self.sorted[:, t], last[:, t])
        return lo, hi

    def candidates(self, lo: np.ndarray, hi: np.ndarray, enough: int) -> np.ndarray:
        """Ascend all trees together until the matching prefixes hold ``enough`` rows."""
        found = np.zeros(len(self.ids), bool)
        total = (hi - lo).sum(axis=0)
        length = int(np.flatnonzero(total >= min(enough, total[0]))[-1])
        while True:
            for t in range(TREES):
                found[self.order[lo[t, length] : hi[t, length], t]] = True
            if length == 0 or found.sum() >= enough:
                return np.flatnonzero(found)
            length -= 1

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """Yields (query row, row numbers, scores) of the best ``k`` candidates of each query."""
        enough = max(k + 1, int(np.ceil(self.plan.share * len(self.ids))))
        for a in range(0, len(queries), 256):
            part = queries[a : a + 256]
            for i, (lo, hi) in enumerate(zip(*self.matches(part))):
                rows = self.candidates(lo, hi, enough)
                rows = rows[self.ids[rows] != query_ids[a + i]]
                rough = self.vectors[rows] @ part[i]
                if len(rows) > k:
                    keep = rough >= np.partition(rough, len(rows) - k)[len(rows) - k] - 1e-9 * (1 + np.abs(rough).max())
                    rows = rows[keep]
                # The same sum for the same vector, wherever it stands, so that ties are ties.
                score = (self.vectors[rows] * part[i]).sum(axis=1)
                best = np.lexsort((self.ids[rows], -score))[:k]
                yield a + i, rows[best], score[best]


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.ascontiguousarray(np.asarray(column.flatten(), np.float64).reshape(-1, dimensions))


def projections_of(dimensions: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dimensions + 1, TREES * HASH_BITS))


def smallest_share(ids: np.ndarray, x: np.ndarray, plan: Plan, k: int) -> float:
    """The least of ``SHARES`` that finds ``FIT_RECALL`` of the nearest of some queries among all rows."""
    forest, picked = Forest(ids, x, plan), slice(None, None, max(1, len(ids) // FIT_QUERIES))
    best = {q: set(r.tolist()) for q, r, _ in forest.nearest(ids[picked], x[picked], k)}
    for share in SHARES:
        forest.plan = plan._replace(share=share)
        found = sum(len(best[q] & set(r.tolist())) for q, r, _ in forest.nearest(ids[picked], x[picked], k))
        if found >= FIT_RECALL * sum(map(len, best.values())):
            return share
    return 1.0


def fitted_share(rows: DataFrame, dimensions: int, k: int, seed: int) -> float:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [b for b in batches if b.num_rows]
        if sample:
            ids = np.concatenate([b.column("id").to_numpy() for b in sample])
            x = np.concatenate([matrix(b.column("vector"), dimensions) for b in sample])
            share = smallest_share(ids, x, Plan(projections_of(dimensions, seed), 1.0), k)
            yield pa.RecordBatch.from_arrays([pa.array([share])], names=["share"])

    sample = rows.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).coalesce(1)
    return sample.mapInArrow(run, "share double").first()[0]


def runs_of(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """shard, is_query and rows of each run of equal shard and is_query."""
    if batch.num_rows:
        shard, asks = batch.column("shard").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero((np.diff(shard) != 0) | (asks[1:] != asks[:-1])) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield int(shard[a]), bool(asks[a]), batch.slice(a, b - a)


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42) -> DataFrame:
    """query_id, rank, id, score: the ``k`` nearest found of every query among all other rows."""
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    # The place of a row is fixed by being written; rows of one id or one vector have different places.
    rows = stage(rows.withColumn("place", F.xxhash64(F.monotonically_increasing_id())), "vectors")
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    dimensions, n = common
    rows = rows.filter(F.size("vector") == dimensions)
    share = fitted_share(rows, dimensions, k, seed)
    shards = max(spark.sparkContext.defaultParallelism, -(-n // SHARD_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, now, held, forest = Plan(projections_of(dimensions, seed), share), None, [], None
        for batch in batches:
            for shard, asks, part in runs_of(batch):
                if shard != now:
                    now, held, forest = shard, [], None
                ids, x = part.column("id").to_numpy(), matrix(part.column("vector"), dimensions)
                if not asks:
                    held.append((ids, x))
                    continue
                if held:
                    forest, held = Forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), plan), []
                if forest:
                    out = list(forest.nearest(ids, x, k))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids[[q for q, _, _ in out]], [len(r) for _, r, _ in out])),
                         pa.array(forest.ids[np.concatenate([r for _, r, _ in out])]),
                         pa.array(np.concatenate([s for _, _, s in out]))], names=["query_id", "id", "score"])

    indexed = rows.select(F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("is_query"), "id", "vector")
    queries = rows.filter("is_query").groupBy("id").agg(F.min("vector").alias("vector"))
    copies = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("is_query"), "id", "vector")
    dealt = indexed.unionByName(copies).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "is_query")
    found = dealt.mapInArrow(run, "query_id long, id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
