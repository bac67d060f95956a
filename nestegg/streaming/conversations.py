"""Live conversations: state of the turns (H17) and rendered prompts (H14, H18) as streams.

Turns are (conv_id, turn, role, text, event_time). A turn that arrives twice counts once (within the
watermark); a turn that is later than the watermark is left out. State is kept per conversation and
``span`` of event time, and is dropped when the watermark has passed the span, so it stays bounded
however many conversations there have been. Each trigger writes the spans that changed into a folder
of its own, named by the batch id: a batch that is replayed after a failure replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from nestegg.operators.chat import chat_prompts
from nestegg.session import shared_path

STATES = ("conv_id long, span_start timestamp, n_turns long, n_user long, n_assistant long, last struct<turn: long, role: string>, "
          "last_user_turn long, last_assistant_turn long, history_chars long")


def span_states(turns: DataFrame, watermark: str = "1 hour", span: str = "1 day") -> DataFrame:
    """Per conversation and span of event time, aggregates that merge to the conversation's state.

    Works on a stream (deduplication and windowed aggregation with state) and on a table.
    """
    once = turns.withWatermark("event_time", watermark)
    once = once.dropDuplicatesWithinWatermark(["conv_id", "turn"]) if turns.isStreaming else once.dropDuplicates(["conv_id", "turn"])
    of = lambda role: F.col("role") == role
    return (
        once.groupBy("conv_id", F.window("event_time", span).alias("w")).agg(
            F.count(F.lit(1)).alias("n_turns"),
            F.sum(F.when(of("user"), 1).otherwise(0)).cast("long").alias("n_user"),
            F.sum(F.when(of("assistant"), 1).otherwise(0)).cast("long").alias("n_assistant"),
            F.max(F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"))).alias("last"),
            F.max(F.when(of("user"), F.col("turn"))).cast("long").alias("last_user_turn"),
            F.max(F.when(of("assistant"), F.col("turn"))).cast("long").alias("last_assistant_turn"),
            F.sum(F.length("text")).cast("long").alias("history_chars"))
        .select("conv_id", F.col("w.start").alias("span_start"), "n_turns", "n_user", "n_assistant", "last", "last_user_turn",
                "last_assistant_turn", "history_chars"))


def merged_states(states: DataFrame) -> DataFrame:
    """The state of each conversation from its spans, as ``text.conversation_state`` has it from the turns.

    Suggested questions follow an assistant turn, and the next user turn makes them invalid.
    """
    return (
        states.groupBy("conv_id").agg(
            F.sum("n_turns").alias("n_turns"), F.sum("n_user").alias("n_user"), F.sum("n_assistant").alias("n_assistant"),
            F.max("last").getField("role").alias("last_role"), F.max("last_user_turn").alias("last_user_turn"),
            F.max("last_assistant_turn").alias("last_assistant_turn"), F.sum("history_chars").alias("history_chars"))
        .withColumn("suggestions_valid", F.coalesce(
            F.col("last_assistant_turn") > F.coalesce(F.col("last_user_turn"), F.lit(-1)), F.lit(False))))


def replace_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the rows of a batch are the folder of its id, written anew when it is replayed."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def batches(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """All rows that :func:`replace_batch` wrote, with their ``batch_id``; empty before the first batch."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    whole = T.StructType([*fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(whole).parquet(path)


def current_states(spark: SparkSession, path: str) -> DataFrame:
    """The conversations' states now: of each span the row of the latest batch that changed it, merged."""
    rows = batches(spark, path, STATES)
    values = [c for c in rows.columns if c not in ("conv_id", "span_start", "batch_id")]
    latest = rows.groupBy("conv_id", "span_start").agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return merged_states(latest.select("conv_id", "span_start", "v.*"))


def run_states(turns: DataFrame, path: str, checkpoint: str, watermark: str = "1 hour", span: str = "1 day", **trigger) -> StreamingQuery:
    """Start the stream of conversation states; it goes on where ``checkpoint`` ends."""
    return (span_states(turns, watermark, span).writeStream.outputMode("update").foreachBatch(replace_batch(path))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def run_prompts(turns: DataFrame, portfolio: Callable[[SparkSession], DataFrame], docs: DataFrame, embedder, path: str, checkpoint: str,
                k: int = 3, **trigger) -> StreamingQuery:
    """Start the stream of prompts: every batch of (conv_id, turn, user_id, query, ...) meets the portfolio as it is then.

    ``portfolio`` is called for each batch, so that a rebuilt portfolio takes effect without a restart. Tables
    that a batch needs on the way replace those of the batch before.
    """
    write, folder = replace_batch(path), shared_path(turns.sparkSession, "prompt_tables")

    def prompts(batch: DataFrame, batch_id: int) -> None:
        batch = batch.dropDuplicates(["conv_id", "turn"])
        write(chat_prompts(batch, portfolio(batch.sparkSession), docs, embedder, k, folder), batch_id)

    return (turns.writeStream.foreachBatch(prompts).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
