"""Ranked lexical search: all items at once, over partial document accumulators that they share.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased.
A document's score for an item is the sum, over the item's distinct terms, of
w * ((10^9 tf) div (1000 tf + 8 m)), see :class:`Corpus` and :func:`impacts`.

The items are mined for term sets that several of them hold: each item is the sequence of its
terms, most shared first, and neighbours that two or more items have in common become one symbol,
again and again (:func:`shared_sets`). The symbols form a DAG. For each block of documents the
accumulator of a symbol (the partial score of every document of the block) is made once from the
accumulators of its two halves, and each item adds up the few symbols that are left of it.

Spark's part: one pass over the texts leaves each document's postings of item terms (staged);
document frequencies are a partial aggregation over them; a map-only pass scores blocks of
documents and keeps, in each task, an item's ``k`` best; a window ranks what the tasks kept. Items
are taken in blocks of about ``block_terms`` terms, one after the other, so what is broadcast is
bounded (an item with more terms is a block of its own size); each block is a further pass.

Defined cases: a null or empty text has no terms and isn't counted among the documents; an item
without terms has no result; rows that repeat an id are documents or items of their own; equal
scores go by ascending id, null ids last; empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestegg.llm.common import as_bytes, ship, stage, text_pieces

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes outside of terms become spaces; A-Z become a-z; bytes of characters beyond ASCII stay.
FOLD = bytes(b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_TERMS = 200_000
#: Numbers that the accumulators of one block of documents may hold.
BLOCK_CELLS = 4 << 20


class Plan(NamedTuple):
    """The query-sharing DAG: symbols below ``n_terms`` are terms, the others are ``rules`` in order."""

    n_terms: int
    rules: list[tuple[int, int]]
    items: list[list[int]]

    def additions(self) -> int:
        return len(self.rules) + sum(map(len, self.items))


class Corpus(NamedTuple):
    """N documents with terms, L terms in all, w: floor(1000 ln((2N + 2) / (2 df + 1))) of each term."""

    n_docs: int
    n_words: int
    weights: np.ndarray


def shared_sets(items: list[list[int]], n_terms: int) -> Plan:
    """Mine term sets that two or more items share, as a DAG of pairs."""
    often = Counter(t for item in items for t in item)
    rows = [sorted(item, key=lambda t: (-often[t], t)) for item in items]
    rules: list[tuple[int, int]] = []
    while True:
        pairs = Counter(p for row in rows for p in zip(row, row[1:]))
        if not pairs or pairs.most_common(1)[0][1] < 2:
            return Plan(n_terms, rules, rows)
        symbol: dict[tuple[int, int], int] = {}
        shorter = []
        for row in rows:
            out, i = [], 0
            while i < len(row):
                pair, after = tuple(row[i : i + 2]), tuple(row[i + 1 : i + 3])
                if len(pair) == 2 and pairs[pair] >= 2 and pairs[pair] >= pairs.get(after, 0):
                    if pair not in symbol:
                        symbol[pair] = n_terms + len(rules)
                        rules.append(pair)
                    out.append(symbol[pair])
                    i += 2
                else:
                    out.append(row[i])
                    i += 1
            shorter.append(out)
        rows = shorter


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, corpus: Corpus) -> np.ndarray:
    m = 10 + (90 * n * corpus.n_docs) // corpus.n_words
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def accumulate(plan: Plan, n_docs: int, docs: np.ndarray, terms: np.ndarray, scores: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(item, scores of the block's documents), from the block's (document, term, score) postings."""
    order = np.argsort(terms, kind="stable")
    docs, scores = docs[order], scores[order]
    starts = np.searchsorted(terms[order], np.arange(plan.n_terms + 1)).tolist()
    made: list[np.ndarray | None] = []

    def total(symbols) -> np.ndarray | None:
        out = None
        for s in symbols:
            part = made[s - plan.n_terms] if s >= plan.n_terms else None
            a, b = (0, 0) if s >= plan.n_terms else (starts[s], starts[s + 1])
            if part is None and a == b:
                continue
            if out is None:
                out = np.zeros(n_docs, np.int64)
            if part is not None:
                out += part
            else:
                out[docs[a:b]] += scores[a:b]  # a term has one posting for each document
        return out

    for pair in plan.rules:
        made.append(total(pair))
    for i, symbols in enumerate(plan.items):
        if (out := total(symbols)) is not None:
            yield i, out


def postings(docs: DataFrame, words: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms with repeats), terms, tfs: each document's numbers of ``words`` and how often it has them."""
    shipped = ship(docs.sparkSession, words)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, other = shipped(), len(shipped())
        get, rest = numbers.get, iter(lambda: other, None)
        for piece in text_pieces(batches, text_col):
            found = [t.translate(FOLD).split() if t else [] for t in as_bytes(piece.column(text_col))]
            n = np.array([len(w) for w in found], np.int64)
            ids = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(get, w, rest), np.int64, len(w)) for w in found)])
            key = np.repeat(np.arange(len(found)), n) * (other + 1) + ids
            key, tf = np.unique(key[ids != other], return_counts=True)
            cuts = pa.array(np.searchsorted(key, np.arange(len(found) + 1) * (other + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (key % (other + 1), tf)]
            yield pa.RecordBatch.from_arrays([piece.column(id_col), pa.array(n), *lists], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


class Best:
    """An item's ``k`` best (score, id) so far; ids are places in ``ids``, None last."""

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, [], 1

    def offer(self, scores: np.ndarray, ids: list) -> None:
        self.rows += [(-s, ids[i] is None, ids[i] if ids[i] is not None else 0, ids[i]) for i, s in
                      ((i, int(scores[i])) for i in self.candidates(scores))]
        if len(self.rows) > self.k:
            self.rows.sort(key=lambda r: r[:3])
            del self.rows[self.k :]
            self.least = -self.rows[-1][0]

    def candidates(self, scores: np.ndarray) -> list[int]:
        """Places that may be among the best: of many, those that reach the block's k-th score."""
        at = np.flatnonzero(scores >= self.least)
        if len(at) > 4 * self.k:
            kth = np.partition(scores[at], len(at) - self.k)[len(at) - self.k]
            at, ties = at[scores[at] > kth], at[scores[at] == kth]
            at = np.concatenate([at, ties[: self.k]])  # the block is in the order of the ids
        return at.tolist()


def best_of_tasks(found: DataFrame, plan: Plan, corpus: Corpus, item_rows: list, k: int) -> DataFrame:
    """item_row, doc_id, score: of each task's documents, the ``k`` best of each item."""
    shipped = ship(found.sparkSession, (plan, corpus))
    schema = T.StructType([T.StructField("item_row", T.LongType()), found.schema["doc_id"], T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, corpus = shipped()
        best = [Best(k) for _ in plan.items]
        rows = max(64, BLOCK_CELLS // (len(plan.rules) + 1))
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("terms")), 0))
            for a in range(0, batch.num_rows, rows):
                block = batch.slice(a, rows)
                block = block.take(pc.sort_indices(block, sort_keys=[("doc_id", "ascending")], null_placement="at_end"))
                sizes = pc.list_value_length(block.column("terms")).to_numpy(zero_copy_only=False)
                at = np.repeat(np.arange(block.num_rows), sizes)
                terms, tf = (np.asarray(block.column(c).flatten()).astype(np.int64) for c in ("terms", "tfs"))
                n = np.asarray(block.column("n"))[at]
                ids = block.column("doc_id").to_pylist()
                for i, scores in accumulate(plan, block.num_rows, at, terms, impacts(tf, n, corpus.weights[terms], corpus)):
                    best[i].offer(scores, ids)
        out = [(item_rows[i], r[3], -r[0]) for i, b in enumerate(best) for r in sorted(b.rows, key=lambda r: r[:3])[:k]]
        for a in range(0, len(out), 50_000):
            row, ids, score = zip(*out[a : a + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(ids, batch.schema.field("doc_id").type), pa.array(score, pa.int64())], names=schema.names)

    return found.mapInArrow(run, schema)


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_terms: int) -> tuple[DataFrame, int]:
    """Staged item_row, item_id, terms, block of the items with terms, and the number of blocks."""
    terms = F.array_distinct(F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit(TERM), F.lit(0)))
    rows = stage(items.select(F.monotonically_increasing_id().alias("item_row"), F.col(id_col).alias("item_id"), terms.alias("terms")).filter(F.size("terms") > 0), "search-items")
    n = max(1, -(-(rows.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms))
    return rows.withColumn("block", F.pmod(F.xxhash64("item_row"), F.lit(n))), n


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
           item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_row, item_id, rank, doc_id, score: each item's ``k`` highest-scoring documents with a score above 0."""
    spark = docs.sparkSession
    rows, n_blocks = item_blocks(items, item_id_col, item_text_col, block_terms)
    ranked = None
    for block in range(n_blocks):
        found = rows.filter(F.col("block") == block).select("item_row", "terms").orderBy("item_row").collect()
        words = {t: i for i, t in enumerate(sorted({t.encode() for r in found for t in r.terms}))}
        plan = shared_sets([[words[t.encode()] for t in r.terms] for r in found], len(words))
        listed = stage(postings(docs, words, id_col, text_col), "search-postings")
        n_docs, n_words = listed.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        df = np.zeros(len(words), np.int64)
        for r in listed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
            df[r.term] = r.df
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        corpus = Corpus(n_docs, n_words or 1, weights)
        kept = stage(best_of_tasks(listed, plan, corpus, [r.item_row for r in found], k), "search-best")
        ranked = kept if ranked is None else ranked.unionByName(kept)
    rank = F.row_number().over(W.partitionBy("item_row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    top = ranked.withColumn("rank", rank).filter(F.col("rank") <= k)
    return top.join(rows.select("item_row", "item_id"), "item_row").select("item_row", "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
