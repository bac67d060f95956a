"""SparkSession construction and the few session-level helpers the jobs share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Broadcast budget per side. The row bound of a call is this budget divided by the caller's
# estimate of the row width (default 320 bytes, i.e. about 200k narrow rows).
BROADCAST_MAX_BYTES = 64 << 20
DEFAULT_ROW_BYTES = 320
BROADCAST_MAX_ROWS = BROADCAST_MAX_BYTES // DEFAULT_ROW_BYTES
# Work of one task: bytes of a file it reads, and rows of the largest table for each partition of a shuffle.
SPLIT_BYTES = 16 << 20
SHUFFLE_ROWS = 200_000


def get_spark(app: str = "nestegg", cpus: int | str = "*", shuffle_partitions: int = 8,
              driver_memory: str = "16g") -> SparkSession:
    """Local session for tests, tools and the bench; a cluster job brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", LOCAL_TUNING[
            "spark.sql.adaptive.coalescePartitions.minPartitionSize"])
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", LOCAL_TUNING[
            "spark.sql.adaptive.advisoryPartitionSizeInBytes"])
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


LOCAL_TUNING = {
    # Local runs move megabytes: keep AQE from collapsing every stage into one task.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; set a scratch one only when unset (tests)."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="nestegg-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def shared_path(spark: SparkSession, name: str) -> str:
    """The path of a table or stream folder under the shared checkpoint folder, for one use."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/nestegg-tables/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "table", folder: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint folder and read it back.

    With ``folder`` (a shared one) the table is ``name`` in it, and replaces that of an earlier call.

    The result survives executor loss (it is a file on the shared folder, not a
    cached block), cuts the lineage, and the re-read scan gets column pruning and
    filter pushdown. Writing columnar Parquet is cheaper than an RDD checkpoint,
    which also recomputes its input for the checkpoint job.
    """
    spark = df.sparkSession
    path = f"{folder}/{name}" if folder else shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def bound_tasks(spark: SparkSession, rows: int) -> None:
    """Settle the size of the session's tasks for a largest table of ``rows`` rows.

    Hash maps and sorts of a task grow with what it gets, so splits of files are small, and shuffles start with
    partitions in proportion to the rows (adaptive execution merges those that turn out small). A split size
    that differs from Spark's default, and a larger number of partitions, are kept.
    """
    split, initial = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if spark.conf.get(split) in ("134217728b", "134217728", "128MB"):
        spark.conf.set(split, str(SPLIT_BYTES))
    known = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(initial, None) or 0))
    if rows // SHUFFLE_ROWS > known:
        spark.conf.set(initial, str(rows // SHUFFLE_ROWS))


def bounded_broadcast(df: DataFrame, max_rows: int | None = None, known_rows: int | None = None,
                      row_bytes: int = DEFAULT_ROW_BYTES) -> DataFrame:
    """Broadcast ``df`` when the caller's proven bound on its rows is within the broadcast budget.

    ``known_rows`` is an upper bound proven by the caller (e.g. a table derived from an
    already counted one), ``row_bytes`` the caller's estimate of one row. Without a bound,
    or beyond the budget, the frame is returned untouched: the planner and AQE decide from
    measured sizes, and split skewed partitions of a shuffle join.
    """
    limit = max_rows if max_rows is not None else max(1, BROADCAST_MAX_BYTES // row_bytes)
    return F.broadcast(df) if known_rows is not None and known_rows <= limit else df
