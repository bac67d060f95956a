"""Catalog integrity report (A3): the DDL constraints checked as DataFrame plans.

``checked_rows`` and ``write_checked`` apply them to each row before a table is written, together with
the values that the fixed schema can't read. Primary keys by ``groupBy(pk).count > 1``, foreign keys by ``left_anti`` joins,
NOT NULL and ENUM domains by filters. Only tables present in the catalog are checked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from nestegg import schemas
from nestegg.session import cut_lineage

REJECTION = "array<struct<rule: string, column_name: string, value: string>>"


def _key(cols: list[str]):
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in cols])


def violations(catalog: dict[str, DataFrame]) -> DataFrame:
    """One row per violation: (table_name, rule, column_name, key)."""
    parts = []
    for table, df in catalog.items():
        pk = schemas.PRIMARY_KEYS.get(table)
        if pk:
            dup = df.groupBy(*pk).count().where(F.col("count") > 1)
            parts.append(dup.select(F.lit(table).alias("table_name"), F.lit("primary_key").alias("rule"),
                                    F.lit(",".join(pk)).alias("column_name"), _key(pk).alias("key")))
        for col in schemas.NOT_NULL.get(table, []):
            parts.append(df.where(F.col(col).isNull()).select(
                F.lit(table).alias("table_name"), F.lit("not_null").alias("rule"), F.lit(col).alias("column_name"),
                _key(pk or [col]).alias("key")))
        for col, allowed in schemas.DOMAINS.get(table, {}).items():
            parts.append(df.where(F.col(col).isNotNull() & ~F.col(col).isin(allowed)).select(
                F.lit(table).alias("table_name"), F.lit("domain").alias("rule"), F.lit(col).alias("column_name"),
                _key(pk or [col]).alias("key")))
        for col, parent, pcol in schemas.FOREIGN_KEYS.get(table, []):
            if parent not in catalog:
                continue
            keys = catalog[parent].select(F.col(pcol).alias("_pk")).distinct()
            orphan = (df.where(F.col(col).isNotNull())
                      .join(keys, F.col(col) == F.col("_pk"), "left_anti"))
            parts.append(orphan.select(
                F.lit(table).alias("table_name"), F.lit("foreign_key").alias("rule"),
                F.lit(f"{col}->{parent}.{pcol}").alias("column_name"), _key(pk or [col]).alias("key")))
    return reduce(DataFrame.unionByName, parts)


def _counted(table: str, df: DataFrame, catalog: dict[str, DataFrame]) -> DataFrame:
    """Violation counts of one table: all row rules and foreign keys in one pass, the primary key in another.

    A foreign key is a left join with the parent's distinct keys, which never multiplies rows.
    """
    rules = [("not_null", c, F.col(c).isNull()) for c in schemas.NOT_NULL.get(table, [])]
    rules += [("domain", c, F.col(c).isNotNull() & ~F.col(c).isin(allowed))
              for c, allowed in schemas.DOMAINS.get(table, {}).items()]
    joined = df
    for nth, (col, parent, pcol) in enumerate(schemas.FOREIGN_KEYS.get(table, [])):
        if parent in catalog:
            key = f"_parent{nth}"
            keys = catalog[parent].select(F.col(pcol).alias(key)).where(F.col(key).isNotNull()).distinct()
            joined = joined.join(keys, F.col(col) == F.col(key), "left")
            rules.append(("foreign_key", f"{col}->{parent}.{pcol}", F.col(col).isNotNull() & F.col(key).isNull()))
    row = lambda rule, column, count: F.struct(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.lit(column).alias("column_name"),
        F.coalesce(F.col(count), F.lit(0)).cast("long").alias("violations"))
    counts = joined.agg(*[F.count_if(cond).alias(f"_n{i}") for i, (_, _, cond) in enumerate(rules)])
    out = counts.select(F.inline(F.array(*[row(rule, c, f"_n{i}") for i, (rule, c, _) in enumerate(rules)])))
    pk = schemas.PRIMARY_KEYS.get(table)
    if not pk:
        return out
    repeated = df.groupBy(*pk).count().agg(F.count_if(F.col("count") > 1).alias("_n"))
    return out.unionByName(repeated.select(F.inline(F.array(row("primary_key", ",".join(pk), "_n")))))


def integrity_report(catalog: dict[str, DataFrame]) -> DataFrame:
    """Violation count per (table, rule, column), zero rows included for every check run."""
    return reduce(DataFrame.unionByName, [_counted(t, df, catalog) for t, df in catalog.items()])


def checked_rows(table: str, raw: DataFrame, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of ``raw`` under the table's fixed schema, with ``rejections`` (rule, column_name, raw value).

    Rules: ``unreadable`` (a value that its type can't hold), ``not_null``, ``domain``,
    ``foreign_key`` (against ``parents``) and ``primary_key`` (every row that repeats a key). Row rules and
    foreign keys need no shuffle but those of the left joins with the parents' distinct keys; repeated keys are
    a partial aggregation, joined back.
    """
    schema, pk = schemas.CATALOG[table], schemas.PRIMARY_KEYS.get(table)
    names = {f.name: f"_raw_{f.name}" for f in schema.fields}
    text = lambda c: F.col(names[c]).cast("string") if c in raw.columns else F.lit(None).cast("string")
    kept = raw.select(*[F.col(c).alias(names[c]) for c in names if c in raw.columns])
    typed = lambda f: F.col(names[f.name]).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)
    both = kept.select(*kept.columns, *[typed(f).alias(f.name) for f in schema.fields])
    entry = lambda rule, column, value, bad: F.when(bad, F.struct(
        F.lit(rule).alias("rule"), F.lit(column).alias("column_name"), value.alias("value")))
    rules = [entry("unreadable", f.name, text(f.name), F.col(names[f.name]).isNotNull() & F.col(f.name).isNull())
             for f in schema.fields if names[f.name] in kept.columns]
    rules += [entry("not_null", c, text(c), F.col(c).isNull()) for c in schemas.NOT_NULL.get(table, [])]
    rules += [entry("domain", c, text(c), F.col(c).isNotNull() & ~F.col(c).isin(allowed)) for c, allowed in schemas.DOMAINS.get(table, {}).items()]
    for nth, (col, parent, pcol) in enumerate(schemas.FOREIGN_KEYS.get(table, [])):
        if parent in (parents or {}):
            key = f"_parent{nth}"
            keys = parents[parent].select(F.col(pcol).alias(key)).where(F.col(key).isNotNull()).distinct()
            both = both.join(keys, F.col(col) == F.col(key), "left")
            rules.append(entry("foreign_key", f"{col}->{parent}.{pcol}", text(col), F.col(col).isNotNull() & F.col(key).isNull()))
    if pk:
        again = both.groupBy(*pk).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*[F.col(c).alias(f"_pk_{c}") for c in pk], F.lit(True).alias("_again"))
        both = both.join(again, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_pk_{c}")) for c in pk]), "left")
        rules.append(entry("primary_key", ",".join(pk), F.concat_ws("|", *map(text, pk)), F.coalesce("_again", F.lit(False))))
    return both.select(*[f.name for f in schema.fields], F.array_compact(F.array(*rules)).cast(REJECTION).alias("rejections"))


def write_checked(table: str, raw: DataFrame, path: str, parents: dict[str, DataFrame] | None = None) -> dict[str, int]:
    """Write the good rows of ``raw`` to ``path/table`` and the rejected ones, with their reasons, to ``path/table_rejected``.

    Rows are checked once; their numbers are observed while they are written. Rejected rows stand once for each
    reason: (table_name, key, rule, column_name, value). Returns the rows read, good and rejected.
    """
    seen = Observation(f"checked {table}")
    bad = F.size("rejections") > 0
    rows = checked_rows(table, raw, parents).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(~bad).alias("good"), F.count_if(bad).alias("rejected"))
    rows = cut_lineage(rows, f"checked_{table}")
    rows.where(~bad).drop("rejections").write.mode("overwrite").parquet(f"{path}/{table}")
    rejected_rows(table, rows).write.mode("overwrite").parquet(f"{path}/{table}_rejected")
    return seen.get


def rejected_rows(table: str, checked: DataFrame) -> DataFrame:
    """(table_name, key, rule, column_name, value): one row for each reason of each rejected row."""
    key = _key(schemas.PRIMARY_KEYS.get(table) or schemas.CATALOG[table].fieldNames()[:1])
    return checked.where(F.size("rejections") > 0).select(F.lit(table).alias("table_name"), key.alias("key"), F.inline("rejections"))
