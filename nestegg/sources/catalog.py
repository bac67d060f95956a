"""Catalog readers (parquet folder, JDBC query, seed CSV) and the operator-name scan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestegg import schemas


def load_catalog(spark: SparkSession, path: str, fmt: str = "parquet",
                 tables: list[str] | None = None) -> dict[str, DataFrame]:
    """Read ``<path>/<table>`` for each catalog table and coerce to the fixed schema.

    Missing optional columns are added as typed NULLs; unknown columns are dropped.
    """
    out = {}
    for name in tables or list(schemas.CATALOG):
        schema = schemas.CATALOG[name]
        df = spark.read.format(fmt).load(f"{path.rstrip('/')}/{name}")
        out[name] = conform(df, schema)
    return out


def conform(df: DataFrame, schema) -> DataFrame:
    """Project ``df`` onto ``schema``: typed casts (ANSI-safe), absent columns as NULL.

    ``integrity.write_checked`` tells which values were unreadable, and keeps their rows out of a table.
    """
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def run_query(spark: SparkSession, query: str, args: dict[str, object] | None = None,
              tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """A1, A2: run ``query`` with bound parameters (``:name``) over ``tables`` (written ``{name}``) or the catalog.

    Values never become part of the query's text. A list is bound item by item, so that ``x IN (:names)`` reaches
    the scan as a filter; an empty list finds nothing. A query that can't be run raises, at once or when its
    rows are read: there is no empty result instead.
    """
    bound: dict[str, object] = {}

    def marker(match: re.Match) -> str:
        name = match.group(2)
        value = (args or {}).get(name)
        if match.group(1) or not isinstance(value, (list, tuple, set)):  # quoted text, or a single value
            if not match.group(1) and name in (args or {}):
                bound[name] = value
            return match.group(0)
        items = {f"{name}_{i}": v for i, v in enumerate(dict.fromkeys(value))} or {f"{name}_0": None}
        bound.update(items)
        return ", ".join(f":{n}" for n in items)

    text = re.sub(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|::)|:([A-Za-z_]\w*)", marker, query)
    return spark.sql(text, args=bound, **(tables or {}))


def read_jdbc_query(spark: SparkSession, url: str, query: str, properties: dict | None = None,
                    partition_column: str | None = None, lower: int | None = None,
                    upper: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """Run ``query`` on a database through JDBC (deployment path of the catalog query).

    Unlike a swallow-and-return-empty reader, failures raise. For a large table pass a
    numeric ``partition_column`` with bounds so the read is split across tasks.
    """
    reader = spark.read.format("jdbc").option("url", url)
    if partition_column:
        reader = (reader.option("dbtable", f"({query}) q").option("partitionColumn", partition_column)
                  .option("lowerBound", lower).option("upperBound", upper)
                  .option("numPartitions", num_partitions or 8))
    else:
        reader = reader.option("query", query)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    return reader.load()


def read_seed(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Seed dimension CSV (header row) read with the table's fixed schema."""
    return (spark.read.option("header", "true").option("mode", "FAILFAST")
            .schema(schemas.CATALOG[table]).csv(path))


def operator_names(operator_info: DataFrame) -> DataFrame:
    """The operator-name list the survey matches against."""
    return operator_info.select("operator_name")
