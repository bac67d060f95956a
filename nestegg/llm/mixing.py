"""Mixing sources to target weights, with DataFrame functions only.

The words of a source form one stream (its documents in the order of a hash of their id), cut
into blocks of ``block_words``. The recipe gives each source a number of words to take; these
are slots of one block each. A pseudorandom permutation of all slots deals them to output
shards of ``shard_slots`` slots, so the counts of the sources in a shard follow the multinomial
law of the weights, given the totals: the targets are met to the word (less than one block is
lost where the short last block of a source is drawn). Slot ``j`` of a source maps through the
source's own index permutation (one for each epoch) to a block, and slots and blocks join by
that index.

Defined cases: a null text has no words; a source without words gets target 0; the null source
is a source of its own and comes last; rows that repeat a doc_id are documents of their own;
empty tables give empty results.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nestegg.llm.common import shuffle_partitions, stage

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 32
SHARD_SLOTS = 8192
BUCKET_DOCS = 1024  # documents of one source that one window task orders
SLOT_CHUNK = 16384  # slots that one row of the recipe is expanded to at a time
CHUNK_SPAN = 4096  # chunks that one array holds
ROUNDS = 20


class Mix(NamedTuple):
    sizes: DataFrame  # uid, doc_id, source, size, text_hash
    recipe: DataFrame  # one row for each source
    blocks: DataFrame  # src, block, uid, piece_start, piece_words, from_word
    slots: DataFrame  # shard, position, src, block, slot_words
    mixture: DataFrame  # shard, position, src, block, uid, from_word, words


def cyclic_weights(sources: DataFrame, weights: list[float]) -> DataFrame:
    """Weights that repeat over the sources by code point, null last (one row for each source)."""
    nth = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    values = F.array(*[F.lit(float(w)) for w in weights])
    return sources.withColumn("weight", F.element_at(values, (nth % len(weights) + 1).cast("int")))


def fill_targets(sources: DataFrame, share: float, max_repeat: int) -> DataFrame:
    """Targets proportional to the weights, at most ``max_repeat`` times the source's size.

    Sharing the excess again until no target is above its cap is filling to one level: with the
    sources ordered by cap / weight, the level is the largest of (total - caps before) / (weights
    from here on). The table has one row for each source.
    """
    cap = F.col("source_size") * max_repeat
    ordered = W.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum(cap).over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(ordered.rowsBetween(W.currentRow, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(share)
    return (
        sources.withColumn("level", (total - before) / rest)
        .withColumn("level", F.max("level").over(W.partitionBy()))
        .withColumn("target", F.least(cap.cast("double"), F.col("level") * F.col("weight")))
        .drop("level")
    )


def slot_recipe(targets: DataFrame, block_words: int) -> DataFrame:
    """Slots of each source: whole epochs over all blocks, then part of one more."""
    size, want = F.col("source_size"), F.floor("target")
    by_source = W.orderBy(F.col("source").isNull(), "source")
    return (
        targets.withColumn("n_blocks", F.ceil(size / block_words))
        .withColumn("epochs", F.when(size > 0, F.floor(want / size)).otherwise(0).cast("long"))
        .withColumn("rest", (want - F.col("epochs") * size).cast("long"))
        .withColumn("rest_slots", F.ceil(F.col("rest") / block_words))
        .withColumn("n_slots", F.col("epochs") * F.col("n_blocks") + F.col("rest_slots"))
        .withColumn("last_words", F.col("rest") - (F.col("rest_slots") - 1) * block_words)
        .withColumn("src", F.row_number().over(by_source).cast("long"))
        .withColumn("first_slot", F.sum("n_slots").over(by_source) - F.col("n_slots"))
        .withColumn("all_slots", F.sum("n_slots").over(W.partitionBy()))
    )


def permuted(df: DataFrame, out: str, index: Column, size: Column, salt: list[Column], rounds: int = ROUNDS) -> DataFrame:
    """``out``: a pseudorandom permutation of 0 .. size-1 at ``index`` (swap-or-not shuffle).

    Each round pairs x with (key - x) mod size and a hash of the larger of the two decides
    for both whether they swap, which is a bijection for any size. One projection a round.
    """
    df = df.withColumn(out, index)
    for r in range(rounds):
        x, partner = F.col(out), F.pmod(F.pmod(F.xxhash64(F.lit(2 * r), *salt), size) - F.col(out), size)
        swap = F.xxhash64(F.lit(2 * r + 1), F.greatest(x, partner), *salt).bitwiseAND(F.lit(1)) == 1
        df = df.withColumn(out, F.when(swap, partner).otherwise(x))
    return df


def packed_blocks(sizes: DataFrame, recipe: DataFrame, seed: int, block_words: int) -> DataFrame:
    """The pieces of documents in each block of their source's stream.

    The stream position of a document is a prefix sum over the source. A source is split by a
    hash of id, size and text into buckets of about ``BUCKET_DOCS`` documents, each ordered by a task
    of its own, so that neither a source nor an id with most of the rows lands in one task.
    """
    keys = recipe.select("source", "src", F.ceil(F.col("n_docs") / BUCKET_DOCS).alias("n_buckets"))
    docs = (
        sizes.alias("d")
        .join(keys.alias("k"), F.col("d.source").eqNullSafe(F.col("k.source")))
        .filter("size > 0")
        .select("uid", "doc_id", "size", "src", "text_hash", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"), F.col("text_hash")).alias("h"),
                "n_buckets")
        .withColumn("bucket", F.pmod(F.col("h"), F.col("n_buckets")))
    )
    before = lambda *order: W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    offsets = docs.groupBy("src", "bucket").agg(F.sum("size").alias("words")).select(
        "src", "bucket",
        F.coalesce(F.sum("words").over(before("bucket").partitionBy("src")), F.lit(0)).alias("offset"))
    in_bucket = before("h", "doc_id", "size", "text_hash", "uid").partitionBy("src", "bucket")
    at, block = F.col("at"), F.col("block")
    lo, hi = F.greatest(at, block * block_words), F.least(at + F.col("size"), (block + 1) * block_words)
    return (
        docs.withColumn("within", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
        .join(offsets, ["src", "bucket"])
        .select("src", "uid", "size", (F.col("offset") + F.col("within")).alias("at"))
        .withColumn("block", F.explode(F.sequence(F.floor(at / block_words), F.floor((at + F.col("size") - 1) / block_words))))
        .select("src", "block", "uid", (lo - block * block_words).alias("piece_start"), (hi - lo).alias("piece_words"),
                (lo - at).alias("from_word"))
    )


def dealt_slots(recipe: DataFrame, seed: int, block_words: int, shard_slots: int) -> DataFrame:
    """One row for each slot: its place in an output shard, and the block it takes.

    A source's slots are expanded in chunks that are dealt out first, so a source with most of
    the slots is expanded by many tasks.
    """
    n = shuffle_partitions(recipe.sparkSession)
    last_chunk = F.floor((F.col("n_slots") - 1) / SLOT_CHUNK)
    chunks = (
        recipe.filter("n_slots > 0")
        .select("src", "n_blocks", "n_slots", "epochs", "rest", "last_words", "first_slot", "all_slots",
                F.explode(F.sequence(F.lit(0), F.floor(last_chunk / CHUNK_SPAN))).alias("span"))
        .withColumn("chunk", F.explode(F.sequence(F.col("span") * CHUNK_SPAN, F.least(last_chunk, (F.col("span") + 1) * CHUNK_SPAN - 1))))
        .repartition(n, "src", "chunk")
    )
    first = F.col("chunk") * SLOT_CHUNK
    slots = chunks.withColumn("slot", F.explode(F.sequence(first, F.least(F.col("n_slots"), first + SLOT_CHUNK) - 1)))
    last = (F.col("slot") == F.col("n_slots") - 1) & (F.col("rest") > 0)
    slots = slots.select(
        "src", "n_blocks", "all_slots", (F.col("first_slot") + F.col("slot")).alias("global_slot"),
        F.floor(F.col("slot") / F.col("n_blocks")).alias("epoch"), (F.col("slot") % F.col("n_blocks")).alias("nth"),
        F.when(last, F.col("last_words")).otherwise(F.lit(block_words)).cast("long").alias("slot_words"))
    slots = permuted(slots, "block", F.col("nth"), F.col("n_blocks"), [F.lit(seed), F.col("src"), F.col("epoch")])
    slots = permuted(slots, "place", F.col("global_slot"), F.col("all_slots"), [F.lit(seed), F.lit(-1)])
    return slots.select("src", "block", "slot_words", F.floor(F.col("place") / shard_slots).alias("shard"),
                        (F.col("place") % shard_slots).alias("position"))


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, max_repeat: int = 2, seed: int = 42,
        block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", keep_text: bool = False) -> Mix:
    """The mixture of all ``docs``: which words of which document stand in which slot of which shard.

    Reruns over the same rows give the same mixture. ``keep_text`` stages the texts too, for
    :func:`block_texts`.
    """
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = stage(
        docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"),
                    F.col(source_col).alias("source"), words.alias("size"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                    *([F.col(text_col).alias("text")] if keep_text else [])), "mix-sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    recipe = stage(slot_recipe(fill_targets(cyclic_weights(sources, weights), share, max_repeat), block_words), "mix-recipe")
    blocks = packed_blocks(sizes, recipe, seed, block_words)
    # Staged: a predicate on a permuted index, pushed through all rounds, would double in each.
    slots = stage(dealt_slots(recipe, seed, block_words, shard_slots), "mix-slots")
    used = F.least(F.col("piece_words"), F.col("slot_words") - F.col("piece_start"))
    mixture = blocks.join(slots, ["src", "block"]).withColumn("words", used).filter("words > 0").select(
        "shard", "position", "src", "block", "uid", "piece_start", "from_word", "words")
    return Mix(sizes, recipe, blocks, slots, mixture)


def block_texts(mixed: Mix) -> DataFrame:
    """src, block, text: the words of each packed block, joined by spaces (needs ``keep_text``)."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    per_doc = mixed.blocks.groupBy("uid").agg(F.collect_list(F.struct("src", "block", "piece_start", "piece_words", "from_word")).alias("pieces"))
    piece = F.col("piece")
    return (
        mixed.sizes.select("uid", words.alias("words")).join(per_doc, "uid")
        .select("words", F.explode("pieces").alias("piece"))
        .select(piece.src.alias("src"), piece.block.alias("block"), piece.piece_start.alias("start"),
                F.array_join(F.slice("words", (piece.from_word + 1).cast("int"), piece.piece_words.cast("int")), " ").alias("text"))
        .groupBy("src", "block")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda p: p.text), " ").alias("text"))
    )


def taken_words(mixed: Mix) -> DataFrame:
    """One row for each document: its size, its source's size and target, the words the mixture takes of it."""
    taken = mixed.mixture.groupBy("uid").agg(F.sum("words").alias("taken"))
    recipe = mixed.recipe.select(F.col("source").alias("recipe_source"), "source_size", "target")
    return (
        mixed.sizes.join(taken, "uid", "left")
        .join(recipe, F.col("source").eqNullSafe(F.col("recipe_source")))
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")
    )
