"""Per-query physical-plan summary (shuffles, broadcasts, Python stages).

Usage: python tests/plan_report.py [sf_dir] > PLANS.md
Counts come from the executed plan after one run (AQE final plan).
"""
from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def summarize(plan: str) -> dict:
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning)", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "single": plan.count("Exchange SinglePartition"),
        "python": len(re.findall(r"ArrowEvalPython|BatchEvalPython|MapInPandas|PythonMapInArrow", plan)),
        "window_limit": plan.count("WindowGroupLimit"),
        "checkpoint_scans": plan.count("Scan ExistingRDD"),
        "pushed": "PushedFilters: [" in plan and not re.search(r"PushedFilters: \[\]", plan),
    }


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as E
    from petrel.session import get_session
    spark = get_session("local[8]", 8)
    print("| query | shuffles | broadcasts | single-partition exchanges | Python stages | partial top-k | checkpoint scans |")
    print("|---|---|---|---|---|---|---|")
    for name, fn in E.queries().items():
        df = fn(spark, sf)
        df.write.format("noop").mode("overwrite").save()
        p = df._jdf.queryExecution().executedPlan().toString()
        s = summarize(p)
        print(f"| {name} | {s['shuffles']} | {s['broadcasts']} | {s['single']} | {s['python']} | "
              f"{s['window_limit']} | {s['checkpoint_scans']} |", flush=True)


if __name__ == "__main__":
    main(sys.argv)
