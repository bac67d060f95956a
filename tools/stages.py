"""Summarise a Spark event log (written to a scratch folder): jobs, stages, task time.

usage: python tools/stages.py <eventlog file or dir> [top]
"""

from __future__ import annotations

import glob
import json
import os
import sys


def main():
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    files = sorted(glob.glob(os.path.join(path, "**", "*"), recursive=True)) if os.path.isdir(path) else [path]
    stages, jobs = {}, {}
    for f in files:
        if os.path.isdir(f):
            continue
        if f.endswith(".zstd"):
            import io

            import zstandard
            raw = zstandard.ZstdDecompressor().stream_reader(open(f, "rb"))
            fh = io.TextIOWrapper(raw, encoding="utf-8")
        else:
            fh = open(f, encoding="utf-8")
        with fh:
            for line in fh:
                e = json.loads(line)
                ev = e.get("Event")
                if ev == "SparkListenerStageCompleted":
                    si = e["Stage Info"]
                    dur = (si.get("Completion Time", 0) - si.get("Submission Time", 0)) / 1000
                    scopes = []
                    for r in si.get("RDD Info", []):
                        sc = r.get("Scope")
                        if sc:
                            nm = json.loads(sc).get("name", "")
                            if nm and nm not in scopes:
                                scopes.append(nm)
                    stages[si["Stage ID"]] = (dur, si["Number of Tasks"], si["Stage Name"][:40], ",".join(scopes)[:150])
                elif ev == "SparkListenerJobStart":
                    jobs[e["Job ID"]] = [e["Submission Time"], None, len(e.get("Stage IDs", []))]
                elif ev == "SparkListenerJobEnd":
                    jobs[e["Job ID"]][1] = e["Completion Time"]
    total_stage = sum(s[0] for s in stages.values())
    print(f"jobs={len(jobs)} stages={len(stages)} stage_time_sum={total_stage:.1f}s")
    jd = sorted(((v[1] - v[0]) / 1000, k, v[2]) for k, v in jobs.items() if v[1])
    print("slowest jobs:", [(round(d, 2), k, n) for d, k, n in jd[-top:]])
    for sid, (d, n, name, scopes) in sorted(stages.items(), key=lambda kv: -kv[1][0])[:top]:
        print(f"  stage {sid:4d} {d:6.2f}s tasks={n:4d} {scopes or name}")


if __name__ == "__main__":
    main()
