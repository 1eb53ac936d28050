"""Summarise the physical plan of each registered query: scans, exchanges,
join strategies, and any sort-merge / nested-loop (cross) join.

usage: python tools/plan_audit.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tractscope.plans.registry import CATALOG  # noqa: E402
from tractscope.session import build_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(CATALOG)
    spark = build_session("local[8]", shuffle_partitions=16)
    jvm = spark.sparkContext._jvm
    for name in names:
        if CATALOG[name][1] is None:
            continue
        df = CATALOG[name][0](spark, sf)
        plan = jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
        count = lambda pat: len(re.findall(pat, plan))
        flags = []
        if "SortMergeJoin" in plan:
            flags.append("SMJ")
        if "BroadcastNestedLoopJoin" in plan or "CartesianProduct" in plan:
            flags.append("CROSS")
        print(f"{name:34s} scans={count('FileScan parquet'):2d} exch={count('Exchange '):2d} "
              f"bhj={count('BroadcastHashJoin'):d} sort_agg={count('SortAggregate'):d} {' '.join(flags)}")
    spark.stop()


if __name__ == "__main__":
    main()
