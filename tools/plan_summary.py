"""Summarise the executed plan of every registered query (the final adaptive plan of a run whose rows are fetched).

usage: python tools/plan_summary.py [sf_dir] [out.md]
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from nestegg.plans.queries import QUERIES  # noqa: E402
from nestegg.session import get_spark  # noqa: E402

NODES = ["Exchange hashpartitioning", "Exchange RoundRobinPartitioning", "Exchange SinglePartition",
         "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
         "CartesianProduct", "WindowGroupLimit", "Window", "HashAggregate", "ObjectHashAggregate", "ArrowEvalPython",
         "BatchEvalPython", "Generate"]


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    if len(sys.argv) > 2:
        sys.stdout = open(sys.argv[2], "w", encoding="utf-8")
    spark = get_spark("nestegg-plans")
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `python tools/plan_summary.py {sf_dir}` (final adaptive plans, after execution).")
    print("Scans of `nestegg-tables/...` are the materialised Parquet tables under `spark.checkpoint.dir`.\n")
    print("| query | " + " | ".join(n.replace("Exchange ", "X ") for n in NODES) + " |")
    print("|" + " --- |" * (len(NODES) + 1))
    details = []
    for name, fn in QUERIES.items():
        df = fn(spark, sf_dir)
        df.collect()  # a write would run another query execution than the one read below
        plan = df._jdf.queryExecution().executedPlan().toString()
        # Of an adaptive plan, the part that ran.
        plan = plan.split("+- == Initial Plan ==")[0]
        counts = []
        for n in NODES:
            if n == "Window":
                c = len(re.findall(r"(?<![A-Za-z])Window \[", plan))
            else:
                c = plan.count(n)
            counts.append(str(c))
        print(f"| {name} | " + " | ".join(counts) + " |")
        scans = re.findall(r"FileScan parquet [^\n]*", plan)
        lines = []
        for s in scans:
            loc = re.search(r"Location: [^\[]*\[([^\],]*)", s)
            rs = re.search(r"ReadSchema: (struct<[^>]*>)", s)
            pf = re.search(r"PushedFilters: (\[[^\]]*\])", s)
            where = "/".join(loc.group(1).rstrip("/").split("/")[-2:]) if loc else "?"
            where = re.sub(r"-[0-9a-f]{32}", "", where)
            lines.append(f"  - `{where}` pushed={pf.group(1) if pf else '[]'} read={rs.group(1) if rs else "(truncated in the plan string)"}")
        details.append((name, sorted(set(lines))))
    print("\n## Scans (file, pushed filters, read schema)\n")
    for name, lines in details:
        print(f"- **{name}**")
        for ln in lines:
            print(ln)


if __name__ == "__main__":
    main()
