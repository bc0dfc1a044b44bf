"""Scale properties of the physical plans.

The plans do not depend on the data size, so the small fixture shows the shape
a cluster would run: no window without a partition key, no cartesian or
nested-loop join, no single-partition exchange on row-level data, and one
grouping-sets aggregate (Expand) for all segments.
"""

import re

from splitscope.operators import eda, quantiles, significance, user_metrics
from splitscope.plans import pipeline
from splitscope.session import materialize
from splitscope.spec import NOTEBOOK_SPEC as NB

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _assert_scalable(plan: str) -> None:
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    for first in re.findall(r"windowspecdefinition\(([^,)]*)", plan):
        assert "specifiedwindowframe" not in first and " ASC" not in first and " DESC" not in first, first


def test_user_metrics_plan(spark):
    clean = pipeline.clean_sessions(spark, SF, NB)
    plan = _plan(user_metrics.user_metrics_full(clean, NB))
    _assert_scalable(plan)
    assert "SinglePartition" not in plan
    # the user-level aggregates are partial before their shuffle
    assert "partial_sum" in plan and "partial_min" in plan


def test_tests_plan_uses_one_grouping_sets_pass(spark):
    users = pipeline.user_metrics_table(spark, SF, NB, materialized=True)
    stats_plan = _plan(significance.metric_suffstats(users, NB))
    assert stats_plan.count("Expand") == 1 and stats_plan.count("FileScan") == 1
    plan = _plan(significance.all_tests(users, NB))
    _assert_scalable(plan)
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan  # tails run in the JVM


def test_eda_plan(spark):
    clean = pipeline.clean_sessions(spark, SF, NB, materialized=True)
    _assert_scalable(_plan(eda.session_length_distribution(clean, NB)))
    _assert_scalable(_plan(eda.revenue_vs_control(clean, NB)))


def _raw_scans(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet")


def test_user_builds_read_the_raw_table_once(spark, monkeypatch):
    assert _raw_scans(pipeline.user_metrics_table(spark, SF)) == 1
    # the template's sessions are written once on the way: the scans of what is written count as well
    written = []

    def counted(df, name="table"):
        written.append(_raw_scans(df))
        return materialize(df, name)

    monkeypatch.setattr(user_metrics, "materialize", counted)
    monkeypatch.setattr(quantiles, "materialize", counted)
    assert _raw_scans(pipeline.template_users(spark, SF)) + sum(written) == 1 and len(written) == 2


def test_tests_keys_read_the_written_user_table_only(spark):
    assert _raw_scans(pipeline.notebook_tests(spark, SF)) == 0  # its one raw scan wrote the user table
    assert _raw_scans(pipeline.template_tests(spark, SF)) == 0
