"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is fully executed with the no-op sink (no collect to the driver).
Shared plans (profiles, the checkpointed candidate hub) are built by the first
query that needs them and reused, as in a batch run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "risk_profile",
    "candidates",
    "guaranteed_topn",
    "variable_total_topn",
    "portfolio_flat",
    "portfolio_context",
    "rag_documents",
    "filtered_knn",
    "operator_resolution",
    "chat_prompts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from nestegg.session import get_spark
    from nestegg.plans.queries import QUERIES, context

    spark = get_spark("nestegg-bench", cpus=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    # Session warm-up (JVM, parquet reader, codegen) is reported apart from the query times.
    t_w = time.time()
    spark.read.parquet(f"{sf_dir.rstrip('/')}/region.parquet").selectExpr("count(*)").collect()
    spark.range(100000).selectExpr("sum(id * 2) AS s").collect()
    warmup = round(time.time() - t_w, 3)
    times: dict[str, float] = {}
    t_all = time.time()
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(time.time() - t_all, 3)

    # Work actually scored vs the naive user x product plan.
    ctx = context(spark, sf_dir)
    sc = ctx.scored
    from pyspark.sql import functions as F
    per_set = sc.candidates.groupBy("cand_key").count()
    naive = (ctx.profiles.groupBy("cand_key").count().withColumnRenamed("count", "users")
             .join(per_set, "cand_key").select(F.sum(F.col("users") * F.col("count"))).first()[0])
    extra = {
        "candidate_rows": sc.candidates.count(),
        "naive_user_x_product_rows": int(naive or 0),
        "segments": sc.segments.count(),
    }
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times,
                      "sf": sf, "cpus": cpus, "warmup_sec": warmup, "work": extra}))


if __name__ == "__main__":
    main()
