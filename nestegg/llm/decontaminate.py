"""Benchmark decontamination: an FM-index over each training shard, searched for all test phrases.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased.
A phrase is a window of ``window`` consecutive words of a benchmark item (a shorter item is one
phrase). The pass over the documents has no shuffle: each piece of an Arrow batch is a training
shard. A word that no item holds ends every match, so the shard's index covers the runs of item
words that are long enough for the shortest phrase, which loses no occurrence. Backward search
finds all phrases at once; occurrences are located through sampled suffixes, and overlapping ones
merge into removal spans (code points, end exclusive).

The benchmark is shipped to the tasks in blocks of about ``block_bytes`` of text, dealt by a hash; each
further block is one more pass that adds to the spans of the one before, which is staged. The driver
holds the items of one block at a time, and a block's broadcast can be dropped when its pass is over.

Defined cases: a null or empty text has no words; a null or empty item has no phrases; items with
null ids mark words but are not named; items that repeat an id count once; an empty benchmark
leaves every document clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestegg.llm.common import as_bytes, fresh, ship, stage, text_pieces
from nestegg.llm.fm_index import FMIndex

WINDOW = 10
BLOCK_BYTES = 32 << 20
SHARD_BYTES = 3 << 20
#: Bytes that aren't part of a word become spaces; A-Z become a-z; bytes of other characters stay.
FOLD = bytes(b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Phrases:
    """The distinct phrases of a block of items, as rows of word numbers (from 2; 1 separates)."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.words: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 2) for w in words_of(text and text.encode())]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + window]), set()).update([item_id] if item_id is not None else [])
        self.owners = [sorted(x) for x in owners.values()]
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.rows = np.zeros((len(owners), window), np.int64)
        for row, p in zip(self.rows, owners):
            row[window - len(p) :] = p

    def occurrences(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position among all words of ``docs``) of every occurrence within a document."""
        none = np.zeros(0, np.int64)
        if not len(self.lengths):
            return none, none
        get, zero = self.words.get, iter(int, 1)
        ids = [np.fromiter(map(get, w, zero), np.int32, len(w)) for w in docs]
        ends = np.cumsum([len(w) for w in docs])
        flat = np.concatenate([*ids, [0]])
        # Runs of item words: they end at other words and at the end of a document.
        edge = np.zeros(len(flat) + 1, bool)
        known = flat > 0
        edge[1:-1] = known[1:] != known[:-1]
        edge[ends] = True
        edge[0] = True
        starts = np.flatnonzero(edge[:-1])
        sizes = np.diff(np.append(starts, len(flat)))
        keep = known[starts] & (sizes >= self.lengths.min())
        starts, sizes = starts[keep], sizes[keep]
        if not len(starts):
            return none, none
        # Each run with one separator behind it.
        at = np.repeat(starts - np.cumsum(sizes + 1) + sizes + 1, sizes + 1) + np.arange((sizes + 1).sum())
        last = np.cumsum(sizes + 1) - 1
        text = flat[at].astype(np.int64)
        text[last] = 1
        index = FMIndex(text, len(self.words) + 2)
        lo, hi = index.search(self.rows, self.lengths)
        n = hi - lo
        phrase = np.repeat(np.arange(len(n)), n)
        rows = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return phrase, at[index.locate(rows)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shard_hits(texts: list[bytes | None], phrases: Phrases) -> tuple[list[int], dict[int, tuple[np.ndarray, set[str]]]]:
    """Word counts; for each document with occurrences its hit words' numbers and the items."""
    docs = [words_of(t) for t in texts]
    counts = [len(w) for w in docs]
    ends = np.cumsum(counts) if counts else np.zeros(0, np.int64)
    phrase, at = phrases.occurrences(docs)
    hits: dict[int, tuple[np.ndarray, set[str]]] = {}
    if len(at):
        doc = np.searchsorted(ends, at, side="right")
        order = np.argsort(doc, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
            d = int(doc[part[0]])
            step = np.zeros(counts[d] + 1, np.int64)
            first = at[part] - (ends[d] - counts[d])
            np.add.at(step, first, 1)
            np.add.at(step, first + phrases.lengths[phrase[part]], -1)
            owners = set().union(*(phrases.owners[p] for p in np.unique(phrase[part])))
            hits[d] = (np.flatnonzero(np.cumsum(step[:-1])), owners)
    return counts, hits


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """The items with the number of their block, and how many blocks of about ``block_bytes`` of text there are."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    return items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), n


def block_of(items: DataFrame, block: int) -> list[tuple[str | None, str | None]]:
    """(item_id, text) of one block's items."""
    return [tuple(r) for r in items.filter(F.col("block") == block).select("item_id", "text").collect()]


def hit_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
              item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
              names: tuple[str, str, str, str] = ("n_words", "n_hit", "spans", "items"), cut: bool = False) -> DataFrame:
    """``docs`` with the number of words, of hit words, the merged spans, and the ids of the items found.

    ``cut``: ``docs`` with the spans removed from the texts instead.
    """
    n_words, n_hit, spans, items = names = tuple(fresh(docs, n) for n in names)
    schema = T.StructType([*docs.schema.fields, T.StructField(n_words, T.LongType()), T.StructField(n_hit, T.LongType()),
                           T.StructField(spans, SPANS), T.StructField(items, T.ArrayType(T.StringType()))])
    out, columns, plain = docs, docs.columns, docs.schema
    blocks, n_blocks = item_blocks(benchmark, item_id, item_text, block_bytes)
    for nth in range(n_blocks):
        cut_now = cut and nth == n_blocks - 1
        shipped = ship(docs.sparkSession, Phrases(block_of(blocks, nth), window))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, first=not nth, cut_now=cut_now) -> Iterator[pa.RecordBatch]:
            phrases = shipped()
            for piece in text_pieces(batches, text_col, SHARD_BYTES):
                raw = as_bytes(piece.column(text_col))
                counts, found = shard_hits(raw, phrases)
                old_spans = [[]] * len(raw) if first else piece.column(spans).to_pylist()
                old_items = [[]] * len(raw) if first else piece.column(items).to_pylist()
                hits, new_spans, new_items = [], [], []
                for d, text in enumerate(raw):
                    numbers, owners = found.get(d, (np.zeros(0, np.int64), set()))
                    was = [(s["start"], s["end"]) for s in old_spans[d]]
                    words = [m.span() for m in WORD.finditer(text.decode())] if len(numbers) or was else []
                    hit = {*numbers.tolist(), *(i for i, w in enumerate(words) for a, b in was if a <= w[0] < b)}
                    runs = [(words[i][0], words[i + 1][0] if i + 1 in hit else words[i][1]) for i in sorted(hit)]
                    hits.append(len(hit))
                    new_spans.append([{"start": a, "end": b} for a, b in merged(runs)])
                    new_items.append(sorted({*old_items[d], *owners}))
                if cut_now:
                    texts = piece.column(text_col)
                    if any(new_spans):
                        texts = pa.array([without_spans(t, c) for t, c in zip(texts.to_pylist(), new_spans)], texts.type)
                    yield pa.RecordBatch.from_arrays([texts if c == text_col else piece.column(c) for c in columns], names=columns)
                    continue
                kept = piece.columns if first else piece.columns[:-4]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(new_spans, ARROW_SPANS),
                     pa.array(new_items, pa.list_(pa.string()))], names=schema.names)

        out = out.mapInArrow(run, plain if cut_now else schema)
        if nth < n_blocks - 1:  # the block is done with before the next one is collected
            out = stage(out, "hit-spans")
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without its text, with n_words, n_hit, spans, items."""
    text_col = options.get("text_col", "text")
    return hit_spans(docs, benchmark, **options).drop(text_col)


def without_spans(text: str | None, spans: list[dict]) -> str | None:
    """The text outside the spans."""
    if not spans or text is None:
        return text
    cuts = [0, *(x for s in spans for x in (s["start"], s["end"])), len(text)]
    return "".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every occurrence of a phrase removed from the text; other texts stay as they are."""
    return hit_spans(docs, benchmark, text_col=text_col, cut=True, **options)
