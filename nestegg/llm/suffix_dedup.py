"""Suffix-array dedup: remove every byte that a repeated string of ``length`` bytes covers.

Sorting the suffix at every byte would move the corpus many times over, so each window (string of
``length`` bytes) is represented by one anchor inside it: of the first ``spread`` positions, the one
whose next 8 bytes hash lowest. The choice depends on the window's bytes alone, so equal windows
have their anchor at the same offset, and the windows of one anchor are neighbours. The suffixes
that start at anchors are sorted, about one in ``spread`` / 2 bytes:

1. Anchors whose first ``length - spread + 1`` bytes (which all their windows hold) occur nowhere
   else are dropped, after a shuffle by a hash of these bytes.
2. The others fetch their windows' bytes on the right and on the left from the text.
3. Spark range-partitions them, by splitters that it samples, by these leading bytes. Equal leading
   bytes never fall on both sides of a splitter, so matches needn't be looked for across boundaries.
4. Each bucket is sorted by multikey quicksort, 8 bytes at a time, all subfiles of a depth at once:
   the suffixes, and the bytes before them read backwards. Longest common prefixes of neighbours in
   both orders divide the anchors into classes for each offset; a window is repeated exactly if
   another anchor is in its two classes.
5. Runs of repeated windows go back to their texts.

Leading bytes that very many texts share would load one task of steps 1 and 3. Two exact ways serve
them, so that no task holds more than ``BUCKET_ROWS`` anchors of one string:

* Leading bytes held by at least ``HEAVY_TEXTS`` of about ``SAMPLE_TEXTS`` sampled texts are heavy
  (the sample decides the way only, never the result). Their anchors aren't shuffled: each task
  hashes the windows (128 bits) and counts equal ones before the shuffle; the windows that stay
  alone are taken from the anchors' ranges.
* A string of leading bytes that still overflows its bucket gives its windows to that same count, row
  by row.

Texts are known by a 128-bit hash; copies of a whole text are one text (all of it is repeated), so a
large group of copies is worked on once.

Defined cases: null is the empty text; texts shorter than ``length`` keep all bytes; matches never
cross documents, but may overlap within one; repeated rows are documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestegg.llm.common import as_bytes, fresh, ship, shuffle_partitions, stage, text_pieces

LENGTH, SPREAD = 200, 160
BUCKET_ROWS = 16384  # anchors that are sorted at once, unless one string of leading bytes has more
GRAM = 8
SAMPLE_TEXTS, HEAVY_TEXTS, HEAVY_KEYS = 16384, 16, 65536
#: Kinds of pieces: bytes that are repeated; starts of windows to be counted, as a range; one such window.
SPAN, RANGE, WINDOW = 0, 1, 2
PIECES = "kind long, w1 long, w2 long, low long, high long, d long, e long, start long, end long"


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("d"), F.xxhash64(F.lit(7), text, F.lit(11)).alias("e")]


def window_anchors(text: bytes, length: int, spread: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, least offset, largest offset) of the anchors: offsets are window start to anchor."""
    n = len(text) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    raw = np.frombuffer(text, np.uint8)
    gram = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, GRAM)[: n + spread - 1]).view("<u8")[:, 0]
    mixed = (gram ^ (gram >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    least = (mixed >> np.uint64(32) << np.uint64(32)) | np.arange(len(mixed), dtype=np.uint64)
    width = 1
    while width * 2 <= spread:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < spread:
        least = np.minimum(least[: -(spread - width)], least[spread - width :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    last = np.append(first[1:], n) - 1
    return at[first], at[first] - last, at[first] - first


def anchor_keys(text: bytes, at: np.ndarray, lead: int) -> np.ndarray:
    """The hash of the leading bytes of each anchor."""
    return np.fromiter((xxhash.xxh3_64_intdigest(text[a : a + lead]) for a in at.tolist()), np.uint64, len(at)).view(np.int64)


def among(keys: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Which of the keys are in the sorted array."""
    if not len(heavy):
        return np.zeros(len(keys), bool)
    return heavy[np.minimum(np.searchsorted(heavy, keys), len(heavy) - 1)] == keys


def anchor_rows(texts: DataFrame, length: int, spread: int, heavy: Callable[[], np.ndarray] | None = None) -> DataFrame:
    """key, d, e, anchor: the hash of the leading bytes, the text, position and offsets in one number.

    Anchors with a ``heavy`` key are left out.
    """
    lead = length - spread + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = heavy() if heavy else np.zeros(0, np.int64)
        for piece in text_pieces(batches, "text", 1 << 20):
            keys, packed, sizes = [], [], []
            for text in as_bytes(piece.column("text")):
                at, lo, hi = window_anchors(text, length, spread)
                key = anchor_keys(text, at, lead)
                mine = ~among(key, others)
                keys.append(key[mine])
                packed.append((at << 16 | lo << 8 | hi)[mine])
                sizes.append(int(mine.sum()))
            cols = [np.repeat(piece.column(c).to_numpy(), sizes) for c in ("d", "e")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *map(pa.array, cols), pa.array(np.concatenate(packed))],
                                             names=["key", "d", "e", "anchor"])

    return texts.select("d", "e", "text").mapInArrow(run, "key long, d long, e long, anchor long")


def heavy_keys(texts: DataFrame, length: int, spread: int) -> np.ndarray:
    """The keys that many of the sampled texts hold, sorted; at most ``HEAVY_KEYS``."""
    one_in = max(1, texts.count() // SAMPLE_TEXTS)
    held = anchor_rows(texts.filter(F.pmod("d", F.lit(one_in)) == 0), length, spread).select("key", "d", "e").distinct()
    found = held.groupBy("key").count().filter(F.col("count") >= HEAVY_TEXTS).orderBy(F.desc("count"), "key").limit(HEAVY_KEYS)
    return np.sort(np.array([r[0] for r in found.collect()], np.int64))


def mixed64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def window_hashes(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every window of ``length`` bytes, from the hashes of its halves."""
    raw = np.frombuffer(text, np.uint8)
    gram = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, GRAM)).view("<u8")[:, 0].astype(np.uint64)
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        h, width = mixed64(gram ^ np.uint64(seed)), GRAM
        while width < length:
            step = min(width, length - width)
            h = mixed64(h[:-step] * np.uint64(seed) + h[step:])
            width += step
        out.append(h.view(np.int64))
    return out[0], out[1]


def row_ids(d: np.ndarray, e: np.ndarray, start: np.ndarray) -> np.ndarray:
    unsigned = [np.ascontiguousarray(x, np.int64).view(np.uint64) for x in (d, e, start)]
    return mixed64(unsigned[0] ^ mixed64(unsigned[1] + mixed64(unsigned[2]))).view(np.int64)


def pieces(kind: int, d: np.ndarray, e: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Spans or ranges: each is a group of its own in :func:`settled`."""
    same = np.zeros(len(d), np.int64)
    cols = [same + kind, row_ids(d, e, start), end, same, same, d, e, start, end]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=PIECES.replace(" long", "").split(", "))


def counted_windows(w1: np.ndarray, w2: np.ndarray, d: np.ndarray, e: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """One row for each different window: two rows' ids that differ tell that it occurs twice."""
    ids, order = row_ids(d, e, start), np.lexsort((w2, w1))
    new = np.append(True, (np.diff(w1[order]) != 0) | (np.diff(w2[order]) != 0))[: len(order)]
    first = np.flatnonzero(new)
    row, ids = order[first], ids[order]
    low, high = ((f.reduceat(ids, first) if len(first) else ids) for f in (np.minimum, np.maximum))
    cols = [np.full(len(row), WINDOW), w1[row], w2[row], low, high, d[row], e[row], start[row], start[row] + 1]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=PIECES.replace(" long", "").split(", "))


def window_pieces(rows: list[tuple[int, int, bytes, int, np.ndarray, np.ndarray]], length: int) -> Iterator[pa.RecordBatch]:
    """The windows of (d, e, bytes, place of the bytes in the text, first and last starts) and their ranges."""
    found, ranges = [], []
    for d, e, text, place, first, last in rows:
        starts = np.repeat(first - np.cumsum(last - first + 1) + last - first + 1, last - first + 1) + np.arange((last - first + 1).sum())
        base = int(first.min())
        w1, w2 = window_hashes(text[base : int(last.max()) + length], length)
        n = len(starts)
        found.append((w1[starts - base], w2[starts - base], np.full(n, d), np.full(n, e), starts + place))
        ranges.append((np.full(len(first), d), np.full(len(first), e), first + place, last + place + 1))
    if found:
        yield counted_windows(*map(np.concatenate, zip(*found)))
        yield pieces(RANGE, *map(np.concatenate, zip(*ranges)))


def heavy_pieces(texts: DataFrame, heavy: Callable[[], np.ndarray], length: int, spread: int) -> DataFrame:
    """The windows of the heavy anchors, counted piece by piece before any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = heavy()
        for piece in text_pieces(batches, "text", 1 << 20):
            rows = []
            for d, e, text in zip(*(piece.column(c).to_pylist() for c in ("d", "e")), as_bytes(piece.column("text"))):
                at, lo, hi = window_anchors(text, length, spread)
                mine = among(anchor_keys(text, at, length - spread + 1), keys)
                if mine.any():
                    rows.append((d, e, text, 0, (at - hi)[mine], (at - lo)[mine]))
            yield from window_pieces(rows, length)

    return texts.select("d", "e", "text").mapInArrow(run, PIECES)


def repeated_anchors(anchors: DataFrame) -> DataFrame:
    """d, e, anchor of the anchors whose key another anchor has too, read as a stream in the order of the keys."""
    n = shuffle_partitions(anchors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last_key, twice = np.zeros((0, 4), np.int64), None, False
        for batch in batches:
            new = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            rows = np.concatenate([held, new])
            # The last row waits for its successor; of the key it belongs to, it is known whether two differ.
            fresh_row = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
            rows = rows[fresh_row]
            same = rows[1:, 0] == rows[:-1, 0]
            keep = np.append(same, False) | np.append(twice and len(rows) > 0 and last_key == rows[0, 0], same)
            if len(rows) > 1:
                out = rows[:-1][keep[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array(out[:, k]) for k in (1, 2, 3)], names=["d", "e", "anchor"])
                last_key, twice = rows[-1, 0], bool(same[-1])
            held = rows[-1:]
        if len(held) and twice:
            yield pa.RecordBatch.from_arrays([pa.array(held[:, k]) for k in (1, 2, 3)], names=["d", "e", "anchor"])

    ordered = anchors.repartition(n, "key").sortWithinPartitions("key", "d", "e", "anchor")
    return ordered.mapInArrow(run, "d long, e long, anchor long")


def anchor_contexts(texts: DataFrame, repeated: DataFrame, length: int) -> DataFrame:
    """d, e, anchor, right, left: the bytes of all the anchor's windows from it on, and before it."""
    per_text = repeated.groupBy(F.col("d").alias("rd"), F.col("e").alias("re")).agg(F.collect_list("anchor").alias("anchors"))
    joined = texts.join(per_text, (F.col("d") == F.col("rd")) & (F.col("e") == F.col("re"))).select("d", "e", "text", "anchors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for piece in text_pieces(batches, "text", 1 << 20):
            out: list[tuple[int, int, int, bytes, bytes]] = []
            for d, e, text, anchors in zip(*(piece.column(c).to_pylist() for c in ("d", "e")), as_bytes(piece.column("text")), piece.column("anchors").to_pylist()):
                if (d, e) != last:  # copies of a text follow one another
                    for x in anchors:
                        a, lo, hi = x >> 16, x >> 8 & 255, x & 255
                        out.append((d, e, x, text[a : a + length - lo], text[a - hi : a]))
                last = d, e
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.binary()) for c in cols[3:])],
                                             names=["d", "e", "anchor", "right", "left"])

    # Where copies reached several tasks, their rows are equal.
    return joined.mapInArrow(run, "d long, e long, anchor long, right binary, left binary")


def multikey_order(strings: np.ndarray) -> np.ndarray:
    """Order of the rows of a byte matrix (its width a multiple of 8): three-way by 8 bytes at each depth."""
    words = np.ascontiguousarray(strings).view(">u8").astype(np.uint64)
    order, tied, group = np.arange(len(words)), np.arange(len(words)), np.zeros(len(words), np.int64)
    for depth in range(words.shape[1]):
        # tied: places in the order that aren't settled; group: the subfile of each.
        rows = order[tied]
        word = words[rows, depth]
        by = np.lexsort((word, group))
        order[tied] = rows[by]
        word, group = word[by], group[by]
        equal = (word[1:] == word[:-1]) & (group[1:] == group[:-1])
        group = np.append(0, np.cumsum(~equal))
        keep = np.append(equal, False) | np.append(False, equal)
        tied, group = tied[keep], group[keep]
        if not len(tied):
            break
    return order


def byte_matrix(strings: list[bytes], width: int) -> np.ndarray:
    return np.array(strings, f"S{width}").view(np.uint8).reshape(len(strings), width)


def common_prefix(ordered: np.ndarray) -> np.ndarray:
    """Of each row with the one before it; 0 for the first."""
    differ = ordered[1:] != ordered[:-1]
    return np.append(0, np.where(differ.any(axis=1), differ.argmax(axis=1), ordered.shape[1]))


def repeated_windows(right: list[bytes], left: list[bytes], lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """(anchor, offset): does the window occur at another anchor too?"""
    n, width = len(right), int(hi.max()) + 1
    round8 = lambda x: -(-x // 8) * 8
    rights = byte_matrix(right, round8(length))
    lefts = byte_matrix([x[::-1] for x in left], round8(width))
    orders = [multikey_order(m) for m in (rights, lefts)]
    common = [common_prefix(m[o]) for m, o in zip((rights, lefts), orders)]
    flags = np.zeros((n, width), bool)
    classes = [np.empty(n, np.int64), np.empty(n, np.int64)]
    for offset in range(int(lo.min()), width):
        rows = np.flatnonzero((lo <= offset) & (offset <= hi))
        if len(rows) < 2:
            continue
        for cls, order, lcp, size in zip(classes, orders, common, (length - offset, offset)):
            cls[order] = np.cumsum(lcp < size)
        pair = classes[0][rows] * (n + 1) + classes[1][rows]
        _, back, count = np.unique(pair, return_inverse=True, return_counts=True)
        flags[rows, offset] = count[back] > 1
    return flags


def repeated_runs(contexts: DataFrame, length: int, spread: int) -> DataFrame:
    """Pieces: the bytes that runs of repeated windows cover; the windows of leading bytes that overflow."""
    lead = length - spread + 1
    n = shuffle_partitions(contexts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes, bytes]] = []
        overflowing = None  # leading bytes whose windows are counted elsewhere

        def settled(rows):
            rows = sorted(set(rows))
            d, e, x = (np.array([r[k] for r in rows], np.int64) for k in range(3))
            at, lo, hi = x >> 16, x >> 8 & 255, x & 255
            flags = repeated_windows([r[3] for r in rows], [r[4] for r in rows], lo, hi, length)
            step = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, first = np.nonzero(step == 1)
            last = np.nonzero(step == -1)[1] - 1  # offsets: the larger, the earlier the window
            return pieces(SPAN, d[row], e[row], at[row] - last, at[row] - first + length)

        def undecided(rows):
            for i in range(0, len(rows), 1024):
                some = []
                for d, e, x, right, left in rows[i : i + 1024]:
                    lo, hi = x >> 8 & 255, x & 255
                    some.append((d, e, left + right, (x >> 16) - hi, np.array([0]), np.array([hi - lo])))
                yield from window_pieces(some, length)

        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                held += zip(*(c.to_pylist() for c in batch.slice(i, 4096).columns[:5]))
                if overflowing is not None:
                    cut = next((k for k, r in enumerate(held) if r[3][:lead] != overflowing), len(held))
                    yield from undecided(held[:cut])
                    held, overflowing = held[cut:], overflowing if cut == len(held) else None
                if len(held) > BUCKET_ROWS:
                    cut = len(held) - 1
                    while cut and held[cut - 1][3][:lead] == held[-1][3][:lead]:
                        cut -= 1
                    if cut:
                        yield settled(held[:cut])
                        held = held[cut:]
                    else:
                        overflowing = held[0][3][:lead]
                        yield from undecided(held)
                        held = []
        if held:
            yield settled(held)

    leading = F.substring("right", 1, lead)
    return contexts.repartitionByRange(n, leading).sortWithinPartitions(leading).mapInArrow(run, PIECES)


def settled_pieces(found: DataFrame) -> DataFrame:
    """d, e, kind, start, end: spans, ranges, and the windows that occur once (low = high)."""
    first = [F.first(c).alias(c) for c in ("d", "e", "start", "end")]
    grouped = found.groupBy("kind", "w1", "w2").agg(F.min("low").alias("low"), F.max("high").alias("high"), *first)
    return grouped.filter("low = high").select("d", "e", "kind", "start", "end")


def covered(found: list[dict], length: int) -> list[tuple[int, int]]:
    """The spans of a text's pieces: its spans, and the windows of its ranges but for those that occur once."""
    alone = np.array(sorted(p["start"] for p in found if p["kind"] == WINDOW), np.int64)
    spans = [(p["start"], p["end"]) for p in found if p["kind"] == SPAN]
    for p in found:
        if p["kind"] == RANGE:
            edges = alone[np.searchsorted(alone, p["start"]) : np.searchsorted(alone, p["end"])]
            first, last = np.append(p["start"], edges + 1), np.append(edges, p["end"]) - 1
            spans += [(a, b + length) for a, b in zip(first.tolist(), last.tolist()) if a <= b]
    return sorted(spans)


def repeated_spans(docs: DataFrame, length: int = LENGTH, spread: int = SPREAD, text_col: str = "text") -> DataFrame:
    """d, e (the text's hash) and the pieces that tell its repeated bytes (:func:`covered`), for texts that have any."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(*text_key(text), text.alias("text"))
    long = texts.filter(F.octet_length("text") >= length)
    keys = heavy_keys(long, length, spread)
    heavy = ship(docs.sparkSession, keys)
    repeated = stage(repeated_anchors(anchor_rows(long, length, spread, heavy)), "anchors")
    runs = repeated_runs(anchor_contexts(long, repeated, length), length, spread)
    if len(keys):
        runs = runs.unionByName(heavy_pieces(long, heavy, length, spread))
    number = lambda n: F.lit(n).cast("long")
    copies = (
        texts.select("d", "e", F.octet_length("text").cast("long").alias("end")).filter(F.col("end") >= length)
        .groupBy("d", "e", "end").count().filter("count > 1").select("d", "e", number(SPAN).alias("kind"), number(0).alias("start"), "end")
    )
    # Pieces of a text: bounded by its length.
    found = settled_pieces(runs).unionByName(copies)
    return stage(found.groupBy("d", "e").agg(F.collect_set(F.struct("kind", "start", "end")).alias("spans")), "repeats")


def deduplicated(docs: DataFrame, length: int = LENGTH, spread: int = SPREAD, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256, and (``keep_text``) the bytes that stay, as ``kept``.

    ``kept`` is binary: a removed run may begin or end inside a character.
    """
    d, e, spans = (fresh(docs, n) for n in ("d", "e", "spans"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = repeated_spans(docs, length, spread, text_col).select(F.col("d").alias("rd"), F.col("e").alias("re"), F.col("spans").alias(spans))
    key = text_key(text)
    keyed = docs.withColumns({d: key[0], e: key[1]})
    joined = keyed.join(found, (F.col(d) == F.col("rd")) & (F.col(e) == F.col("re")), "left").select(*docs.columns, spans)
    fields = [T.StructField(fresh(docs, n), t) for n, t in (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()))]
    fields += [T.StructField(fresh(docs, "kept"), T.BinaryType())] if keep_text else []
    others = [f for f in docs.schema.fields if f.name != text_col]
    schema = T.StructType([*others, *fields])
    names, kept_names = schema.names, [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_pieces(batches, text_col):
            rows = []
            for raw, cuts in zip(as_bytes(piece.column(text_col)), piece.column(spans).to_pylist()):
                raw, at, removed, n, out = raw or b"", 0, 0, 0, []
                end = -1
                for first, last in covered(cuts or [], length):
                    if first > end:
                        out.append(raw[at:first])
                        n += 1
                        removed += last - first
                    elif last > end:
                        removed += last - end
                    end = at = max(end, last)
                kept = b"".join([*out, raw[at:]])
                rows.append((len(raw), removed, n, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows))
            new = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept_names), *new[: len(fields)]], names=names)

    return joined.mapInArrow(run, schema)
