"""Helpers shared by the operators: staged tables, bounded Arrow passes, held-out splits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that one numpy pass works on at a time; longer single texts form a piece of their own.
CHUNK_BYTES = 2 << 20
#: Rows that Spark hands to a Python worker at a time (its default of 10,000 long texts is a lot of memory).
ARROW_ROWS = 1000
#: Rows of one labelled id that a sample takes.
ROWS_OF_ID = 4


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a scratch folder only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="nestegg-llm-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder in the shared folder, for one use."""
    return f"{shared_root(spark)}/nestegg-llm/{name}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``ARROW_ROWS`` rows, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors.

    The planner also gets the measured size of what was written, so that it broadcasts
    a staged table only when it is small.
    """
    bound_batches(df.sparkSession)
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``, equals ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids (label 0 or 1), taken in the order of a hash of the id.

    The sample is bounded by ``rows``, therefore it can be broadcast. An id with several
    labels counts with its largest.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    return (
        known.groupBy(F.col(id_col).alias("sample_id"))
        .agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("sample_id"), "sample_id")
        .limit(rows)
    )


def labelled_documents(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """text, label of the documents of a sample of at most ``rows`` labelled ids, staged.

    Rows that share an id count ``ROWS_OF_ID`` times at most, in the order of a hash of the text, so the
    sample has at most ``ROWS_OF_ID * rows`` rows whatever the ids are.
    """
    sample = labelled_sample(labels, id_col, label_col, rows)
    known = docs.join(F.broadcast(sample), F.col(id_col) == F.col("sample_id")).select("sample_id", F.col(text_col), "label")
    nth = F.row_number().over(W.partitionBy("sample_id").orderBy(F.xxhash64(text_col), text_col))
    return stage(known.withColumn("nth", nth).filter(F.col("nth") <= ROWS_OF_ID).select(text_col, "label"), "labelled")


def text_pieces(batches: Iterator[pa.RecordBatch], text_col: str, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of about ``max_bytes`` of text (never inside a row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(size, dtype=np.int64) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def as_bytes(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.binary()).to_pylist()


def with_text_columns(
    df: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    compute: Callable[[pa.Array], list[pa.Array]],
    max_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``df`` with further columns that ``compute`` derives from the text column, piece by piece.

    A map-only step: no shuffle, memory bounded by one piece, lost tasks are simply run again.
    """
    schema = T.StructType([*df.schema.fields, *fields])
    names = [f.name for f in schema.fields]
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_pieces(batches, text_col, max_bytes):
            yield pa.RecordBatch.from_arrays([*piece.columns, *compute(piece.column(text_col))], names=names)

    return df.mapInArrow(run, schema)


def sha256_joined(values: Column) -> Column:
    """Lowercase hex SHA-256 of an array of strings, comma-joined."""
    return F.sha2(F.concat_ws(",", values), 256)


def ship(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast a bounded object of any class; the result, called in a task, gives it back."""
    bound_batches(spark)
    shipped = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(shipped.value)
