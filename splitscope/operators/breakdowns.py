"""Per-cohort summaries of user metrics, globally or by one dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitscope.functions.columns import rounded_avg
from splitscope.functions.regions import OTHER_REGION
from splitscope.spec import ExperimentSpec, NOTEBOOK_SPEC, TEMPLATE_SPEC

# metric name -> (column averaged over users, scale factor, digits of the rounded SQL reports)
_METRICS = {
    "arpu": (lambda s: F.col("total_revenue"), 1, 6),
    "d1_retention_pct": (lambda s: F.col(s.binary_metric), 100, 2),
    "avg_sessions_per_user": (lambda s: F.col("total_sessions"), 1, 2),
    "avg_session_length_sec": (lambda s: F.col(s.continuous_metric), 1, 2),
    "avg_median_session_length_sec": (lambda s: F.col(s.median_metric), 1, 2),
}
# Means that may lie on a rounding midpoint (of counts, flags and two-decimal values).
_EXACT = {"d1_retention_pct", "avg_sessions_per_user", "avg_session_length_sec", "avg_median_session_length_sec"}

FULL = ("arpu", "d1_retention_pct", "avg_sessions_per_user", "avg_session_length_sec", "avg_median_session_length_sec")


def cohort_breakdown(
    users: DataFrame,
    keys: Sequence[str],
    spec: ExperimentSpec = NOTEBOOK_SPEC,
    metrics: Sequence[str] = FULL,
    rounded: bool = True,
    exclude_other: bool = False,
) -> DataFrame:
    """Users and mean metrics per (keys..., cohort). ARPU averages over users with revenue."""
    df = users
    if exclude_other and spec.region_col in keys:
        df = df.where(F.col(spec.region_col) != OTHER_REGION)  # also drops NULL regions
    aggs = [F.count(spec.user_col).alias("total_users")]  # `users` has a row for each user
    for m in metrics:
        expr, scale, digits = _METRICS[m]
        x = expr(spec)
        if rounded and m in _EXACT:
            e = rounded_avg(x * F.lit(scale), digits)
        elif rounded:
            e = F.round(F.avg(x) * scale, digits)
        else:
            e = F.avg(x) * scale
        aggs.append(e.alias(m))
    out = df.groupBy(*keys, spec.cohort_col).agg(*aggs)
    return out.orderBy(*keys, F.desc("arpu"))


def platform_breakdown(users: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    return cohort_breakdown(users, [spec.platform_col], spec)


def region_breakdown(users: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    return cohort_breakdown(users, [spec.region_col], spec, exclude_other=True)


def cohort_summary(users: DataFrame, spec: ExperimentSpec = TEMPLATE_SPEC) -> DataFrame:
    return cohort_breakdown(users, [], spec, FULL[:4], rounded=False)


def platform_summary(users: DataFrame, spec: ExperimentSpec = TEMPLATE_SPEC) -> DataFrame:
    return cohort_breakdown(users, [spec.platform_col], spec, ("arpu", "d1_retention_pct", "avg_session_length_sec"),
                            rounded=False)


def region_summary(users: DataFrame, spec: ExperimentSpec = TEMPLATE_SPEC) -> DataFrame:
    return cohort_breakdown(users, [spec.region_col], spec, ("arpu", "d1_retention_pct", "avg_session_length_sec"),
                            rounded=False, exclude_other=True)
