"""Exploratory per-cohort aggregates over cleaned sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitscope.functions.columns import round_half_up
from splitscope.operators.quantiles import disc_rank0, join_on, quantiles, rank_value, running_counts, value_ranks
from splitscope.session import materialize
from splitscope.spec import ExperimentSpec, NOTEBOOK_SPEC


def percentile_limits(sessions: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC, mode: str = "exact",
                      lower: float = 0.05, upper: float = 0.95) -> DataFrame:
    """Per-cohort lower/upper trimming limits of the session length."""
    return quantiles(sessions, [spec.cohort_col], spec.length_col, {"p05_limit": lower, "p95_limit": upper}, mode)


def _inside(lower: float, upper: float) -> Column:
    """Whether a histogram row's value lies between the two quantiles, both included."""
    before, f, n = F.col("before__f"), F.col("_f"), F.col("total__f")
    return (before + f > disc_rank0(lower, n)) & (before <= disc_rank0(upper, n))


def _mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight).cast("double"))


def session_length_distribution(sessions: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    """Count, mean, stddev, p10/p50/p90 and the 5 % trimmed mean (bounds inclusive) per cohort.

    All are weighted sums over the value histogram: sessions are read once and
    never joined or shuffled on the cohort.
    """
    v, f, before, n = F.col(spec.length_col), F.col("_f"), F.col("before__f"), F.col("total__f")
    total = F.sum(f).cast("double")
    spread = F.greatest(F.sum(v * v * f) - F.sum(v * f) * F.sum(v * f) / total, F.lit(0.0))
    at = {"median_session_length": 0.5, "p10_session_length": 0.10, "p90_session_length": 0.90}
    return value_ranks(sessions, [spec.cohort_col], spec.length_col).groupBy(spec.cohort_col).agg(
        F.sum(f).alias("total_sessions"),
        round_half_up(_mean(v, f), 2).alias("avg_session_length_sec"),
        round_half_up(F.when(F.sum(f) > 1, F.sqrt(spread / (total - 1))), 2).alias("stddev_session_length"),
        *[rank_value(before, f, v, disc_rank0(q, n)).alias(name) for name, q in at.items()],
        round_half_up(_mean(v, F.when(_inside(0.05, 0.95), f)), 2).alias("trimmed_mean_5pct"),
    ).orderBy(F.desc("avg_session_length_sec"))


def trimmed_mean(sessions: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC,
                 lower: float = 0.05, upper: float = 0.95) -> DataFrame:
    """The per-cohort limits and the mean of the values between them, both bounds included."""
    v, f, before, n = F.col(spec.length_col), F.col("_f"), F.col("before__f"), F.col("total__f")
    return value_ranks(sessions, [spec.cohort_col], spec.length_col).groupBy(spec.cohort_col).agg(
        rank_value(before, f, v, disc_rank0(lower, n)).alias("p05_limit"),
        rank_value(before, f, v, disc_rank0(upper, n)).alias("p95_limit"),
        _mean(v, F.when(_inside(lower, upper), f)).alias("trimmed_mean"),
    )


def _revenue(sessions: DataFrame, spec: ExperimentSpec, mode: str) -> DataFrame:
    """Users, total, mean, median and deviation of the revenue per cohort, from one pass over the sessions.

    Sessions are counted once by (cohort, user, revenue); that table is written, and gives both the
    distinct users (two plain aggregates) and the value histogram, whose weighted sums are the rest.
    A cohort with users but no revenue keeps its row, with NULL measures.
    """
    cohort, rev = spec.cohort_col, spec.revenue_col
    v, f, before, n = F.col(rev), F.col("_f"), F.col("before__f"), F.col("total__f")
    cells = materialize(sessions.groupBy(cohort, spec.user_col, rev).agg(F.count(F.lit(1)).alias("_f")), "revenue_cells")
    users = cells.select(cohort, spec.user_col).distinct().groupBy(cohort).agg(F.count(spec.user_col).alias("users"))
    hist = cells.where(v.isNotNull()).groupBy(cohort, rev).agg(F.sum("_f").alias("_f"))
    ranked = running_counts(hist, [cohort], rev, ["_f"])
    total = F.sum(f).cast("double")
    spread = F.greatest(F.sum(v * v * f) - F.sum(v * f) * F.sum(v * f) / total, F.lit(0.0))
    stats = ranked.groupBy(cohort).agg(
        F.sum(v * f).alias("_sum"), (F.sum(v * f) / total).alias("_mean"),
        F.when(F.sum(f) > 1, F.sqrt(spread / (total - 1))).alias("_dev"), rank_value(before, f, v, disc_rank0(0.5, n)).alias("_median"),
    )
    if mode == "approx":
        stats = join_on(stats.drop("_median"), quantiles(sessions, [cohort], rev, {"_median": 0.5}, mode), [cohort])
    return join_on(users, stats, [cohort], "left").select(
        cohort, "users", F.round("_sum", 4).alias("total_revenue"), F.round("_mean", 6).alias("avg_revenue_per_session"),
        F.round("_median", 6).alias("median_revenue_per_session"), F.round("_dev", 2).alias("stddev_revenue_per_session"),
        F.round(F.try_divide(F.col("_sum"), F.col("users").cast("double")), 6).alias("revenue_per_user"),
    )


def revenue_distribution(sessions: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC, mode: str = "exact") -> DataFrame:
    return _revenue(sessions, spec, mode)


def revenue_vs_control(sessions: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC, mode: str = "exact") -> DataFrame:
    """Revenue distribution plus each cohort's difference from control's rounded total.

    The distribution, a row for each cohort, is written once; the control total is a scalar
    subquery over it. No control row gives NULL.
    """
    dist = materialize(_revenue(sessions, spec, mode), "revenue_distribution")
    ctrl = dist.where(F.col(spec.cohort_col) == spec.control).select("total_revenue").scalar()
    return dist.withColumn("increase_in_total_revenue", F.round(F.col("total_revenue") - ctrl, 6)).orderBy(
        F.desc("total_revenue")
    )


def ads_by_cohort(sessions: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    fs, rv = F.col(spec.fs_col), F.col(spec.rv_col)
    return (
        sessions.groupBy(spec.cohort_col)
        .agg(
            F.sum(fs).alias("total_fs"),
            F.round(F.avg(fs), 2).alias("avg_fs_per_session"),
            F.sum(rv).alias("total_rv"),
            F.round(F.avg(rv), 4).alias("avg_rv_per_session"),
            (F.sum(rv) + F.sum(fs)).alias("total_ads"),
            F.round(F.avg(fs + rv), 2).alias("avg_total_ads_per_session"),
        )
        .orderBy(F.desc("avg_total_ads_per_session"))
    )
