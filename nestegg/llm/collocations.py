r"""Phrase collocations: exact n-gram counts in counting quotient filters, scored by their weakest cut.

Texts (A-Z lower-cased) are cut into pieces at ``[.,;:!?\x0A-\x0D]``, pieces into words
``[^\x20\x09]+``; everything is counted within a language (null: ``und``).

1. One pass over the texts counts words in each task, then over all tasks. Words that occur
   ``min_count`` times get dense numbers (no phrase of that many occurrences holds another word).
2. A second pass writes the texts as numbers (staged): the words of a piece are looked up by their
   128-bit hashes in the sorted hashes of the numbered words, which are broadcast (16 bytes each,
   at most ``MOST_WORDS``). 0 stands for the end of a piece and for any other word.
3. For each length from 2 on, a task packs the n-grams of its pieces, permutes them, and holds
   them in counting quotient filters (``quotient_filter.py``), one for each slice of the permuted
   keys. The filters of a slice, from all tasks, are merged in order; keys that occur ``min_count``
   times are read back through the inverse permutation. Slices are even, whatever the n-grams are,
   and their number grows with the words of the corpus.
   From length 3 on, only n-grams go in whose two shorter ones may be frequent: a bit table of
   fixed size (``2^TABLE_BITS`` bits), set by the frequent ones, tells. A false positive only costs
   a counter.
4. Candidates are cut at every place and joined with the counts of both parts; the score is exact
   (decimal) integer arithmetic. A candidate goes if a longer one that holds it is as frequent; a
   longest chain of equally frequent phrases has one more word at each step, so only candidates
   with one word more need to be looked at.

Defined cases: null and empty texts have no words; null languages count as ``und``; rows that repeat
count again; an empty table, or one without frequent words, gives an empty result; other columns
take no part. More than ``MOST_WORDS`` frequent words (of all languages) are an error, to be met with a
larger ``min_count``: the packed key of five words would not fit, and the hashes are broadcast.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestegg.llm.common import as_bytes, ship, stage, text_pieces
from nestegg.llm.quotient_filter import MOST_HALF, Packing, QuotientFilter, combined, merged, slices

#: A-Z become a-z, tabs become spaces, characters that end a piece become 0xFF (which UTF-8 doesn't use).
FOLD = bytes(0xFF if chr(b) in ".,;:!?\n\v\f\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
BREAK = b"\xff"
MOST_WORDS = (1 << 24) - 1
#: Distinct words that a task counts before it writes them out.
HELD_WORDS = 1 << 18
#: Distinct keys that a task holds before it writes its filters out (sorting them takes some five times their 24 bytes).
HELD_KEYS = 1 << 20
#: Words of the corpus for each slice.
SLICE_WORDS = 1 << 20
TABLE_BITS = 27
BUCKET_BITS = 15  # of one bitmap of Spark's


def cut(texts: list[bytes | None]) -> list[bytes]:
    """The words of the texts, with ``BREAK`` around each piece."""
    found = BREAK.join([b"", *(t or b"" for t in texts)]).translate(FOLD).replace(BREAK, b" \xff ").split(b" ")
    return [w for w in found if w]


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, words) of each piece of a batch."""
    for piece in text_pieces(batches, "text"):
        texts = defaultdict(list)
        for lang, text in zip(piece.column("lang").to_pylist(), as_bytes(piece.column("text"))):
            texts[lang].append(text)
        for lang, some in texts.items():
            yield lang, cut(some)


def texts_of(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f over all texts; the row without a word has the number of all."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("word", T.StringType()), T.StructField("f", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def written() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                found.pop(BREAK, None)
                rows = chain([(None, sum(found.values()))], found.items())
                while some := [*islice(rows, 50_000)]:
                    words, n = [w if w is None else w.decode() for w, _ in some], [n for _, n in some]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64())], names=schema.names)

        for lang, words in by_language(batches):
            counts[lang].update(words)
            if sum(map(len, counts.values())) > HELD_WORDS:
                yield from written()
                counts.clear()
        yield from written()

    return docs.mapInArrow(run, schema).groupBy("lang", "word").agg(F.sum("f").alias("f"))


def numbered(frequent: DataFrame) -> tuple[DataFrame, int]:
    """``frequent`` with a dense ``id`` from 1, and the number of rows. Only the rows of each part are collected."""
    rows = stage(frequent.withColumn("at", F.monotonically_increasing_id()), "phrase-words")
    part, offsets, total = F.shiftright("at", 33), [], 0
    for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        offsets.append((r.part, total))
        total += r.n
    starts = frequent.sparkSession.createDataFrame(offsets, "part long, start long")
    placed = rows.withColumn("part", part).join(F.broadcast(starts), "part")
    return placed.withColumn("id", (F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int")).drop("part", "start", "at"), total


def hashes(words: list[bytes], lang: str) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of words of a language, as :func:`hash_table` has them from Spark."""
    seeds = [xxhash.xxh64_intdigest(x, 42) for x in (lang.encode(), lang.encode() + b"\0")]
    return tuple(np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words)) for seed in seeds)


def hash_table(words: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first hash, second hash, number) of the numbered words, in order of the first."""
    table = words.select(F.xxhash64("lang", "word").alias("a"), F.xxhash64(F.concat("lang", F.lit("\0")), "word").alias("b"), "id").toArrow()
    a, b, number = (table.column(c).to_numpy() for c in ("a", "b", "id"))
    a = a.view(np.uint64)
    order = np.argsort(a)
    if len(a) != len(np.unique(a)):
        raise ValueError("two frequent words have one hash")
    return a[order], b.view(np.uint64)[order], number[order]


def renumbered(docs: DataFrame, words: DataFrame) -> DataFrame:
    """tokens (int32) of pieces of the texts; 0 for breaks and for words without a number."""
    shipped = ship(docs.sparkSession, hash_table(words))
    schema = T.StructType([T.StructField("tokens", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, number = shipped()
        for lang, found in by_language(batches):
            own: dict[bytes, int] = defaultdict()
            own.default_factory = own.__len__
            tokens = np.fromiter(map(own.__getitem__, found), np.int32, len(found))
            a, b = hashes([*own], lang)
            at = np.minimum(np.searchsorted(first, a), len(first) - 1)
            to = np.where((first[at] == a) & (second[at] == b), number[at], 0).astype(np.int32)
            tokens = to[tokens]
            kept = tokens[np.concatenate([[True], (tokens[1:] != 0) | (tokens[:-1] != 0)])] if len(tokens) else tokens
            yield pa.RecordBatch.from_arrays([pa.array([kept.tobytes()], pa.binary())], names=["tokens"])

    return docs.mapInArrow(run, schema)


def table_bit(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The bit of a permuted key in the table of frequent keys."""
    return ((left * np.uint64(0x9E3779B97F4A7C15) + right) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - TABLE_BITS)


def held_filters(packing: Packing, slice_bits: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[QuotientFilter]:
    """The filters of a task's permuted keys; about ``HELD_KEYS`` distinct ones are held, and freed before they are sorted together."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def together() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        columns = [*zip(*held)]
        held.clear()
        parts = []
        while columns:
            parts.append(np.concatenate(columns.pop(0)))
        return combined(packing.half, *parts)

    for left, right in found:
        for a in range(0, len(left), HELD_KEYS):
            some = left[a : a + HELD_KEYS]
            held.append(combined(packing.half, some, right[a : a + HELD_KEYS], np.ones(len(some), np.int64)))
            if sum(len(h[0]) for h in held) > HELD_KEYS:
                held.append(together())
                if len(held[0][0]) > HELD_KEYS // 2:
                    yield from slices(packing, slice_bits, *held.pop())
    if held:
        yield from slices(packing, slice_bits, *together())


def filters(tokens: DataFrame, packing: Packing, slice_bits: int, shorter: bytes | None) -> DataFrame:
    """slice, filter: the n-grams of each task's chunks. ``shorter``: the bit table of the length below."""
    shipped = ship(tokens.sparkSession, shorter)
    schema = T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("filter", T.BinaryType())])
    below = Packing(packing.length - 1, packing.bits)

    def keys(numbers: np.ndarray, table: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        size, n = packing.length, max(0, len(numbers) - packing.length + 1)
        if table is None:
            good = reduce(np.logical_and, (numbers[i : i + n] != 0 for i in range(size)))
        else:
            m = n + 1 if n else 0  # places of the n-grams that are one word shorter
            whole = reduce(np.logical_and, (numbers[i : i + m] != 0 for i in range(size - 1)))
            at = np.flatnonzero(whole)
            bit = table_bit(*below.permute(*below.pack([numbers[at + i] for i in range(size - 1)])))
            may = np.zeros(m, bool)
            may[at] = (table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
            good = may[:-1] & may[1:]
        at = np.flatnonzero(good)
        return packing.permute(*packing.pack([numbers[at + i] for i in range(size)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shipped(), np.uint8) if shorter_is_given else None
        raws = (raw for batch in batches for raw in batch.column("tokens"))
        found = held_filters(packing, slice_bits, (keys(np.frombuffer(raw.as_py(), np.int32), table) for raw in raws))
        while some := [*islice(found, 64)]:
            yield pa.RecordBatch.from_arrays([pa.array([f.slice_number for f in some], pa.int32()), pa.array([pickle.dumps(tuple(f)) for f in some], pa.binary())], names=schema.names)

    shorter_is_given = shorter is not None
    return tokens.mapInArrow(run, schema)


def frequent_keys(parts: DataFrame, packing: Packing, min_count: int) -> DataFrame:
    """words (numbers), f, bit: the keys that occur ``min_count`` times, after merging the filters of each slice."""
    schema = T.StructType([T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("f", T.LongType()), T.StructField("bit", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        left, right, counts = merged([QuotientFilter(*pickle.loads(x.as_py())) for x in table.column("filter")])
        keep = counts >= min_count
        left, right, counts = left[keep], right[keep], counts[keep]
        words = np.stack(packing.unpack(*packing.invert(left, right)), axis=1).astype(np.int32).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(words) + 1, packing.length), pa.int32()), pa.array(words))
        return pa.table([lists, pa.array(counts), pa.array(table_bit(left, right).astype(np.int64))], names=schema.names)

    return parts.groupBy("slice").applyInArrow(run, schema)


def bit_table(frequent: DataFrame) -> bytes:
    """The table of ``2^TABLE_BITS`` bits that the frequent keys set, put together from Spark's bitmaps."""
    table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    maps = frequent.groupBy(F.shiftright("bit", BUCKET_BITS).alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1))).alias("bits"))
    size = 1 << (BUCKET_BITS - 3)
    for r in maps.collect():
        table[r.bucket * size : (r.bucket + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return table.tobytes()


def phrase_counts(tokens: DataFrame, n_numbers: int, n_words: int, min_count: int, longest: int) -> DataFrame | None:
    """words, f of all phrases of 2 to ``longest`` words that occur ``min_count`` times; None if there are none."""
    slice_bits, table, out = max(1, (n_words // SLICE_WORDS).bit_length()), None, None
    if Packing(longest, n_numbers.bit_length()).half > MOST_HALF:
        raise ValueError(f"keys of {longest} of {n_numbers} words don't fit, take a larger min_count")
    for length in range(2, longest + 1):
        packing = Packing(length, n_numbers.bit_length())
        parts = filters(tokens, packing, min(slice_bits, packing.half), table)
        found = stage(frequent_keys(parts, packing, min_count), f"phrases-{length}")
        if found.isEmpty():
            break
        out = found if out is None else out.unionByName(found)
        table = bit_table(found)
    return None if out is None else out.select("words", "f")


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """phrase (numbers), lang, a, l, r, n, score of the candidates that no longer one replaces."""
    size = F.size("words")
    longer = phrases.filter(size > 2).select(
        F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("words"), F.col("f").alias("longer_f"))
    longer = longer.groupBy("words").agg(F.max("longer_f").alias("longer_f"))
    left = phrases.join(longer, "words", "left").filter(F.coalesce(100 * F.col("longer_f") < 100 * F.col("f"), F.lit(True)))
    counts = phrases.unionByName(words.select(F.array("id").alias("words"), F.col("f")))
    cuts = left.select("words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        F.col("words").alias("phrase"), "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("first"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("rest"))
    of = words.select(F.col("id").alias("of"), "lang").join(F.broadcast(totals), "lang")
    both = (
        cuts.join(counts.select(F.col("words").alias("first"), F.col("f").alias("l")), "first")
        .join(counts.select(F.col("words").alias("rest"), F.col("f").alias("r")), "rest")
        .join(of, F.col("phrase")[0] == F.col("of")))
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return both.groupBy("phrase", "lang", "a", "n").agg(weakest).select("phrase", "lang", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, min_count: int = 100, longest: int = 5, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` collocations."""
    spark: SparkSession = docs.sparkSession
    texts = texts_of(docs, text_col, lang_col)
    counts = stage(word_counts(texts).filter((F.col("f") >= min_count) | F.col("word").isNull()), "phrase-counts")
    totals = counts.filter(F.col("word").isNull()).select("lang", F.col("f").alias("n"))  # a row for each language
    words, n_numbers = numbered(counts.filter(F.col("word").isNotNull()))
    if n_numbers > MOST_WORDS:
        raise ValueError(f"{n_numbers} words occur {min_count} times, {MOST_WORDS} are possible; take a larger min_count")
    words = stage(words, "phrase-dictionary")
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    phrases = None
    if n_numbers:
        tokens = stage(renumbered(texts, words), "phrase-tokens")
        phrases = phrase_counts(tokens, n_numbers, n_words, min_count, longest)
    if phrases is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    found = scored(phrases, words, totals)
    # Those that may be among the first, with all ties; their words are needed to order the ties.
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = stage(found.withColumn("near", F.rank().over(best)).filter(F.col("near") <= top).drop("near"), "phrase-best")
    spelt = (
        near.select("phrase", F.posexplode("phrase").alias("place", "id")).join(words.select("id", "word"), "id")
        .groupBy("phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x.word), " ").alias("spelt")))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "spelt")
    return (
        near.join(spelt, "phrase").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
        .select("lang", "rank", F.col("spelt").alias("phrase"), "a", "l", "r", "n", "score"))
