"""Structured Streaming entry points for the stateless parts.

The reference has no streams. What is stateless per row runs unchanged on a
streaming DataFrame: survey rows -> investor profile (B4-B9) and chat turns ->
intent / recommendation-request flags (H6, H7) and parsed questions (H16).
Sinks write files with a checkpoint location under the session's
``spark.checkpoint.dir`` (set one only where it is unset, as in tests).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestegg import schemas
from nestegg.operators.survey import build_profiles
from nestegg.operators.text import intent, is_recommendation, parse_questions


def survey_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Streaming survey answers with the fixed schema (file source)."""
    reader = spark.readStream.schema(schemas.SURVEY_ANSWERS).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def profile_stream(answers: DataFrame) -> DataFrame:
    """B4-B9 on a stream: the same expressions as the batch profile."""
    return build_profiles(answers)


def turn_stream(turns: DataFrame) -> DataFrame:
    """H6/H7/H16 per chat turn (conv_id, turn, role, text)."""
    return turns.select(
        "conv_id", "turn", "role",
        F.when(F.col("role") == "user", intent(F.col("text"))).alias("intent"),
        F.when(F.col("role") == "user", is_recommendation(F.col("text"))).alias("is_recommendation"),
        F.when(F.col("role") == "assistant", parse_questions(F.col("text"))).alias("questions"),
    )


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True):
    """Append sink; ``checkpoint`` is a fixed shared folder, so that a restarted stream goes on where it was."""
    writer = (df.writeStream.format(fmt).outputMode("append")
              .option("checkpointLocation", checkpoint).option("path", path))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
