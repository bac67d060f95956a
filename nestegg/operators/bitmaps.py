"""Candidate sets as unions of operator bitmaps (D11), and what is counted on them.

Every product gets a slot: products that F8 ranks come first, by their value, so that a product's
rank in a set is the number of set bits before it. A slot is a bucket of ``2^BUCKET_BITS`` places
and a place in it. Each operator's products are one bitmap a bucket; a candidate set is the OR of
its operators' bitmaps. What is written grows with operators x products; rows of (set, product)
are only expanded on the way to a query's result: the bitmaps are cut into words of 32 places, and
products meet the words of their place by an equi-join. When the catalog is too large to broadcast,
words and products are shuffled, never the rows they expand to; ranks are bits counted on the words.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestegg.session import bounded_broadcast, cut_lineage

BUCKET_BITS = 15  # places of one of Spark's bitmaps
WORD = 32  # places of a word
_PART_BITS = 33  # of monotonically_increasing_id

EXTREMES = {"max_rate": (F.max, "interest_rate"), "min_1y": (F.min, "return_1y"), "max_1y": (F.max, "return_1y"),
            "min_3y": (F.min, "return_3y"), "max_3y": (F.max, "return_3y"), "min_5y": (F.min, "return_5y"),
            "max_5y": (F.max, "return_5y"), "min_fee": (F.min, "total_expense_ratio"), "max_fee": (F.max, "total_expense_ratio")}


class Slots(NamedTuple):
    """``rows``: products with bucket, place, and the first and last slot of their value (``tie``, ``tie_last``)."""

    rows: DataFrame
    n_products: int
    ranked_buckets: int  # ranked products lie in the buckets below
    spans: bool  # some value's products lie in several buckets
    bucket_bits: int = BUCKET_BITS


def product_slots(products: DataFrame, value: str = "total_net_worth", bucket_bits: int = BUCKET_BITS) -> Slots:
    """Number the products: variable ones with a value by that value, the others from the next bucket on.

    One range-partitioned sort of the catalog; only the row counts of its parts are collected.
    """
    ranked = F.coalesce((F.col("category") == "NON_GUARANTEED") & F.col(value).isNotNull(), F.lit(False))
    ordered = cut_lineage(products.withColumn("_ranked", ranked).orderBy(F.desc("_ranked"), value, "product_id")
                          .withColumn("_at", F.monotonically_increasing_id()), "product_order")
    part, starts, total, n_ranked = F.shiftright("_at", _PART_BITS), [], 0, 0
    for r in ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if("_ranked").alias("n_ranked")).orderBy("part").collect():
        starts.append((r.part, total))
        total, n_ranked = total + r.n, n_ranked + r.n_ranked
    size = 1 << bucket_bits
    ranked_buckets = -(-n_ranked // size)
    starts = products.sparkSession.createDataFrame(starts, "part long, start long")
    number = F.col("start") + F.col("_at").bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    slot = F.when(F.col("_ranked"), number).otherwise(number - n_ranked + ranked_buckets * size)
    rows = ordered.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("slot", slot).drop("part", "start", "_at")
    ties = rows.where("_ranked").groupBy(F.col(value).alias("_value")).agg(F.min("slot").alias("tie"), F.max("slot").alias("tie_last"))
    rows = cut_lineage(
        rows.join(ties, F.col("_ranked") & (F.col(value) == F.col("_value")), "left").drop("_value", "_ranked")
        .withColumns({"bucket": F.shiftright("slot", bucket_bits).cast("int"), "place": F.col("slot").bitwiseAND(F.lit(size - 1)).cast("int"),
                      "spans": F.coalesce(F.shiftright("tie", bucket_bits) != F.shiftright("tie_last", bucket_bits), F.lit(False))})
        .drop("slot"), "product_slots")
    return Slots(rows, total, ranked_buckets, not rows.where("spans").isEmpty(), bucket_bits)


def operator_summaries(mapping: DataFrame, slots: DataFrame) -> DataFrame:
    """(operator_id, category, bucket, bits, extremes): the products each operator offers, in one pass over the mapping.

    Bits and extremes merge to a set's, as a product may count several times.
    """
    columns = sorted({c for _, c in EXTREMES.values()})
    return (mapping.select("product_id", "operator_id").join(slots.select("product_id", "category", "bucket", "place", *columns), "product_id")
            .groupBy("operator_id", "category", "bucket")
            .agg(F.bitmap_construct_agg(F.col("place")).alias("bits"), *[f(c).alias(name) for name, (f, c) in EXTREMES.items()]))


def set_bitmaps(set_operators: DataFrame, summaries: DataFrame, partitions: int) -> DataFrame:
    """(cand_key, bucket, bits): the union of each set's operators.

    Partitioned by a given number of tasks: the rows are few and small, but what they expand to isn't.
    """
    return (set_operators.join(summaries.select("operator_id", "bucket", "bits"), "operator_id")
            .select("cand_key", "bucket", "bits").repartition(partitions, "cand_key", "bucket")
            .groupBy("cand_key", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")))


def set_extremes(set_operators: DataFrame, summaries: DataFrame) -> DataFrame:
    """(cand_key, category, extremes) of the union of each set's operators."""
    return set_operators.join(summaries.drop("bits"), "operator_id").groupBy("cand_key", "category").agg(
        *[f(name).alias(name) for name, (f, _) in EXTREMES.items()])


def edges(slots: Slots, by: list[str], size: int) -> DataFrame:
    """(by, head_last, tail_tie): of runs of ``size`` slots, the end of the value that comes in from before and
    ends there, and the start of the value that starts there and goes on behind; NULL if there is none."""
    rows = slots.rows.where(F.col("tie").isNotNull()).withColumn("nth", _nth())
    start = _start(slots) if "nth" in by else F.shiftleft(F.col("bucket").cast("long"), slots.bucket_bits)
    first, last = F.col("tie") < start, F.col("tie_last") < start + min(size, 1 << slots.bucket_bits)
    return rows.groupBy(*by).agg(F.max(F.when(first & last, F.col("tie_last"))).alias("head_last"), F.max(F.when(~first & ~last, F.col("tie"))).alias("tail_tie"))


def word_edges(slots: Slots) -> DataFrame:
    return edges(slots, ["bucket", "nth"], WORD)


def _nth() -> Column:
    return F.shiftright("place", 5)


def _start(slots: Slots) -> Column:
    """The first slot of a word."""
    return F.shiftleft(F.col("bucket").cast("long"), slots.bucket_bits) + F.col("nth") * WORD


def _below(places: Column) -> Column:
    """How many of the first ``places`` bits of the word are set."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(F.greatest(places, F.lit(0)), F.lit(WORD)).cast("int")) - 1
    return F.bit_count(F.col("word").bitwiseAND(mask))


def ranked_counts(sets: DataFrame, slots: Slots) -> DataFrame:
    """(cand_key, bucket, before, n_worth, start, end): ranked products of the set in the buckets before, and in all.

    ``start`` counts those before the value that comes into the bucket from an earlier one, ``end`` those up to the
    end of the value that goes on behind the bucket; both are NULL without such a value.
    """
    ranked, own = sets.where(F.col("bucket") < slots.ranked_buckets), Window.partitionBy("cand_key")
    up, down = (own.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("bucket"), F.desc("bucket")))
    before = F.coalesce(F.sum("n").over(up), F.lit(0))
    if not slots.spans:
        none = F.lit(None).cast("long")
        return ranked.select("cand_key", "bucket", F.bitmap_count("bits").alias("n")).select(
            "cand_key", "bucket", before.alias("before"), F.sum("n").over(own).alias("n_worth"), none.alias("start"), none.alias("end"))
    crossing = edges(slots, ["bucket"], 1 << slots.bucket_bits)  # a row for each bucket
    counts = (words(ranked).where(F.col("word") != 0).join(F.broadcast(crossing), "bucket").groupBy("cand_key", "bucket").agg(
        F.sum(F.bit_count("word")).alias("n"), F.sum(_below(F.col("tail_tie") - _start(slots))).alias("n_tail"),
        F.sum(_below(F.col("head_last") - _start(slots) + 1)).alias("n_head")))
    # A value may start or end in a bucket of which the set has nothing.
    whole = counts.select("cand_key").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(slots.ranked_buckets - 1))))
    whole = whole.join(F.broadcast(crossing), "bucket").join(counts, ["cand_key", "bucket"], "left").fillna(0, ["n", "n_tail", "n_head"]).withColumn("before", before)
    return whole.select("cand_key", "bucket", "before", F.sum("n").over(own).alias("n_worth"),
                        F.last(F.when(F.col("tail_tie").isNotNull(), F.col("before") + F.col("n_tail")), True).over(up).alias("start"),
                        F.last(F.when(F.col("head_last").isNotNull(), F.col("before") + F.col("n_head")), True).over(down).alias("end"))


def words(sets: DataFrame) -> DataFrame:
    """The rows of ``sets`` with (nth, word) of every word of the bitmap instead of ``bits``; bit i of a word is its place i.

    No rows move, so they stay in the partitions of ``sets``.
    """
    def word(i: Column) -> Column:
        read = F.conv(F.hex(F.substr("bits", i * 4 + 1, F.lit(4))), 16, 10).cast("long")  # first byte highest
        byte = lambda k: F.shiftleft(F.shiftright(read, 24 - 8 * k).bitwiseAND(F.lit(255).cast("long")), 8 * k)
        return byte(0).bitwiseOR(byte(1)).bitwiseOR(byte(2)).bitwiseOR(byte(3))

    found = F.transform(F.sequence(F.lit(0), F.lit((1 << BUCKET_BITS) // WORD - 1)), lambda i: F.struct(i.alias("nth"), word(i).alias("word")))
    rest = [c for c in sets.columns if c != "bits"]
    return sets.select(*rest, F.explode(found).alias("_w")).select(*rest, "_w.nth", "_w.word")


def expanded(sets: DataFrame) -> DataFrame:
    """(cand_key, bucket, place) of every set bit."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(F.col("word"), i) == 1)
    return (words(sets).where(F.col("word") != 0).select("cand_key", "bucket", "nth", F.explode(bits).alias("bit"))
            .select("cand_key", "bucket", (F.col("nth") * WORD + F.col("bit")).cast("int").alias("place")))


def set_rows(found: DataFrame, slots: Slots, products: DataFrame | None = None) -> DataFrame:
    """Candidate rows: the set bits of the words ``found`` with the product columns of ``products`` (rows of ``slots``)."""
    side = (slots.rows if products is None else products).withColumn("nth", _nth())
    bit = F.getbit(F.col("word"), F.col("place").bitwiseAND(F.lit(WORD - 1))) == 1
    return found.where(F.col("word") != 0).join(bounded_broadcast(side, known_rows=slots.n_products), ["bucket", "nth"]).where(bit)


def ranked_words(sets: DataFrame, counts: DataFrame, slots: Slots, word_edges: DataFrame) -> DataFrame:
    """The words of ``sets`` with what a rank needs: the set's ranked products before the word (``before``), before the
    value that comes in (``start``), and up to the end of the value that goes on (``end``).

    Values that share a word only in part are counted where they start and end, and carried over the words between.
    """
    known = counts.select("cand_key", "bucket", "before", "start", "end")
    found = words(sets.join(known, ["cand_key", "bucket"], "left"))
    found = found.join(bounded_broadcast(word_edges, known_rows=slots.n_products // WORD + slots.ranked_buckets + 1), ["bucket", "nth"], "left")
    own = Window.partitionBy("cand_key", "bucket")
    up, down = (own.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("nth"), F.desc("nth")))
    found = found.withColumn("before", F.col("before") + F.coalesce(F.sum(F.bit_count("word")).over(up), F.lit(0)))
    opened = F.when(F.col("tail_tie").isNotNull(), F.col("before") + _below(F.col("tail_tie") - _start(slots)))
    closed = F.when(F.col("head_last").isNotNull(), F.col("before") + _below(F.col("head_last") - _start(slots) + 1))
    return found.withColumns({"_opened": opened, "_closed": closed}).withColumns({
        "start": F.coalesce(F.last("_opened", True).over(up), "start"), "end": F.coalesce(F.last("_closed", True).over(down), "end")}).drop(
        "_opened", "_closed", "tail_tie", "head_last")


def average_ranks(rows: DataFrame, slots: Slots, out: str) -> DataFrame:
    """``rows`` (of :func:`ranked_words`) with ``out``: the average rank (ties share it) of each ranked product in its set; else NULL.

    Ranked slots are in the order of the value: the rank is the set bits before the product's value
    plus half of (those that share it + 1).
    """
    start = _start(slots)
    first = F.when(F.col("tie") >= start, F.col("before") + _below(F.col("tie") - start)).otherwise(F.col("start"))
    upto = F.when(F.col("tie_last") < start + min(WORD, 1 << slots.bucket_bits), F.col("before") + _below(F.col("tie_last") - start + 1)).otherwise(F.col("end"))
    rank = first.cast("double") + (upto - first + 1) / 2.0
    return rows.withColumn(out, F.when(F.col("tie").isNotNull(), rank)).drop("before", "start", "end")
