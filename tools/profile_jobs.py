"""Jobs, stages and tasks each registered query launches (status tracker).

usage: python tools/profile_jobs.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tractscope.plans.registry import CATALOG  # noqa: E402
from tractscope.session import build_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:] or list(CATALOG)
    spark = build_session("local[8]", shuffle_partitions=16)
    sc = spark.sparkContext
    tracker = sc.statusTracker()
    CATALOG["by_year"][0](spark, sf).write.format("noop").mode("overwrite").save()
    for name in names:
        sc.setJobGroup(name, name)
        t0 = time.perf_counter()
        CATALOG[name][0](spark, sf).write.format("noop").mode("overwrite").save()
        dt = time.perf_counter() - t0
        jobs = tracker.getJobIdsForGroup(name)
        stages = [s for j in jobs for s in (tracker.getJobInfo(j).stageIds if tracker.getJobInfo(j) else [])]
        infos = [tracker.getStageInfo(s) for s in stages]
        tasks = sum(i.numTasks for i in infos if i)
        print(f"{name:32s} {dt:6.2f}s jobs={len(jobs):2d} stages={len(stages):2d} tasks={tasks}")
    spark.stop()


if __name__ == "__main__":
    main()
