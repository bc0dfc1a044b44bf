"""Per-segment filter loop (the reference's shape) vs one GROUPING SETS pass.

Both compute n / mean / var_samp of every tested metric for every
(segment, cohort) on the same materialised user table; prints both wall times.
usage: python scripts/compare_segment_loop.py [sf_dir]
"""

from __future__ import annotations

import json
import sys
import time

sys.path.insert(0, ".")
from pyspark.sql import functions as F  # noqa: E402

from splitscope.operators import significance  # noqa: E402
from splitscope.plans import pipeline  # noqa: E402
from splitscope.session import local_session  # noqa: E402
from splitscope.spec import NOTEBOOK_SPEC as NB  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8, 16)
    users = pipeline.user_metrics_table(spark, sf, NB, materialized=True)
    metrics = [NB.primary_metric, NB.continuous_metric]
    significance.metric_suffstats(users, NB).collect()  # warm-up of both paths' code
    t0 = time.perf_counter()
    gs = significance.metric_suffstats(users, NB).collect()
    t_gs = time.perf_counter() - t0

    platforms = list(NB.platforms)
    regions = [r[0] for r in users.select("region").distinct().where("region IS NOT NULL").collect()]
    segments = [("global", None)] + [("platform", p) for p in platforms] + [("region", r) for r in regions]
    t0 = time.perf_counter()
    loop_rows = 0
    for kind, value in segments:
        seg = users if kind == "global" else users.where(F.col(kind) == value)
        for cohort in NB.all_cohorts:
            part = seg.where(F.col(NB.cohort_col) == cohort)
            aggs = []
            for m in metrics:
                aggs += [F.count(m), F.avg(m), F.var_samp(m)]
            part.agg(*aggs).collect()
            loop_rows += 1
    t_loop = time.perf_counter() - t0
    print(json.dumps({"grouping_sets_sec": round(t_gs, 3), "segment_loop_sec": round(t_loop, 3),
                      "cells": loop_rows, "grouping_sets_rows": len(gs)}))
    spark.stop()


if __name__ == "__main__":
    main()
