"""Session -> user aggregation: revenue, sessions, lengths, ads, day-1 retention.

Every user-level step aggregates partially before its shuffle on the user key,
so a user holding a large share of all sessions is combined map-side. The D1
flag works on distinct (user, day) pairs, at most one per user and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitscope.functions.columns import rounded_avg
from splitscope.operators.quantiles import APPROX_ACCURACY, exact_quantiles
from splitscope.session import materialize
from splitscope.spec import ExperimentSpec, NOTEBOOK_SPEC, TEMPLATE_SPEC


def _days(spec: ExperimentSpec) -> Column:
    """Aggregate: a user's distinct calendar days (at most one for each day of the data)."""
    return F.collect_set(F.to_date(F.col(spec.time_col)))


def _returned(days: str) -> Column:
    """1 if the day after the first is among a user's days."""
    return F.array_contains(days, F.date_add(F.array_min(days), 1)).cast("int")


def user_base(sessions_clean: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC, *more: Column) -> DataFrame:
    """One row per user. ANY_VALUE dims are taken as MIN (deterministic). `more`: further aggregates.

    The per-user median is the sketch quantile (as the warehouse's approximate
    quantile): bounded memory per user however many sessions a user has.
    """
    length = F.col(spec.length_col)
    return sessions_clean.groupBy(spec.user_col).agg(
        F.min(spec.platform_col).alias("platform"),
        F.min(spec.region_col).alias("region"),
        F.min(spec.cohort_col).alias(spec.cohort_col),
        F.min(spec.segment_col).alias("segment_name"),
        F.min(spec.time_col).alias("first_session_at"),
        F.min(spec.acquired_col).alias("acquired_at"),
        F.sum(spec.revenue_col).alias("total_revenue"),
        F.count(F.lit(1)).alias("total_sessions"),
        rounded_avg(length, 2).alias("avg_session_length"),
        F.percentile_approx(length, 0.5, APPROX_ACCURACY).alias("median_session_length"),
        F.sum(spec.fs_col).alias("total_fs_shown"),
        F.sum(spec.rv_col).alias("total_rv_shown"),
        F.sum(spec.activity_col).alias("total_activity_count"),
        *more,
    )


def first_session_dates(sessions_clean: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    """Every session row with its date and the user's first session date.

    Written as aggregate + equi-join instead of MIN() OVER (PARTITION BY user):
    the aggregate is partial, and AQE can split a skewed user's join partition,
    which it cannot do for a window partition.
    """
    d = F.to_date(F.col(spec.time_col))
    sess = sessions_clean.select(F.col(spec.user_col), d.alias("session_date"))
    firsts = sess.groupBy(spec.user_col).agg(F.min("session_date").alias("first_session_date"))
    return sess.join(firsts, spec.user_col, "inner")


def user_days(sessions: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Distinct (user, calendar day) pairs."""
    return sessions.select(F.col(spec.user_col), F.to_date(F.col(spec.time_col)).alias("session_date")).distinct()


def d1_retention(sessions_clean: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC,
                 exclude_censored: bool = False) -> DataFrame:
    """returned_d1 = 1 if the user has a session exactly one calendar day after the first.

    As published, users first seen on the last day count as not returned
    (right-censored). With `exclude_censored=True` they get NULL instead, so
    they leave the D1 rate; the last day is an uncorrelated scalar subquery.
    """
    days = user_days(sessions_clean, spec)
    first = F.min("session_date").over(Window.partitionBy(spec.user_col))
    out = (
        days.withColumn("first_session_date", first)
        .groupBy(spec.user_col, "first_session_date")
        .agg(
            F.max(F.when(F.col("session_date") == F.date_add("first_session_date", 1), 1).otherwise(0)).alias(
                "returned_d1"
            )
        )
    )
    if exclude_censored:
        last_day = days.select(F.max("session_date")).scalar()
        out = out.withColumn(
            "returned_d1", F.when(F.col("first_session_date") < last_day, F.col("returned_d1"))
        )
    return out


def user_metrics_full(sessions_clean: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC,
                      exclude_censored: bool = False) -> DataFrame:
    """user_base with the day-1 flag, from the same aggregate: sessions are read and shuffled once."""
    out = user_base(sessions_clean, spec, _days(spec).alias("_days"))
    returned = _returned("_days")
    if exclude_censored:
        last_day = sessions_clean.select(F.max(F.to_date(F.col(spec.time_col)))).scalar()
        returned = F.when(F.array_min("_days") < last_day, returned)
    return out.withColumn("returned_d1", returned).drop("_days")


def d1_retention_join(sessions: DataFrame, spec: ExperimentSpec = TEMPLATE_SPEC) -> DataFrame:
    """Template D1: first-seen timestamp per user, joined back; DATE(t) = DATE(first) + 1.

    The join side is pre-reduced to distinct (user, day) pairs.
    """
    first = sessions.groupBy(spec.user_col).agg(F.min(spec.time_col).alias("first_seen_at"))
    days = user_days(sessions, spec)
    return (
        days.join(first, spec.user_col, "inner")
        .groupBy(spec.user_col, "first_seen_at")
        .agg(
            F.max(
                F.when(F.col("session_date") == F.date_add(F.to_date("first_seen_at"), 1), 1).otherwise(0)
            ).alias("returned_d1")
        )
    )


def user_activity(cleaned: DataFrame, spec: ExperimentSpec = TEMPLATE_SPEC) -> DataFrame:
    """Template user metrics: unrounded mean and interpolated (continuous) median per user.

    `cleaned` has one row per (user, session), so COUNT(session) equals
    COUNT(DISTINCT session) and needs no distinct-aggregate expansion. The day-1 flag comes
    from the same aggregate. Users without an id leave, as in a join on it.

    The exact median comes from the (user, length) histogram, range-partitioned with
    carried offsets: no task holds all lengths of a user, however many there are. The sessions
    feed two aggregates, so they are written once.
    """
    known = materialize(cleaned.where(F.col(spec.user_col).isNotNull()), "user_sessions")
    length = F.col(spec.length_col)
    agg = known.groupBy(spec.user_col).agg(
        F.min(spec.cohort_col).alias(spec.cohort_col),
        F.min(spec.platform_col).alias(spec.platform_col),
        F.min(spec.region_col).alias(spec.region_col),
        F.sum(spec.revenue_col).alias("total_revenue"),
        F.count(spec.session_col).alias("total_sessions"),
        F.avg(length).alias("avg_session_length"),
        _days(spec).alias("_days"),
    )
    medians = exact_quantiles(known, [spec.user_col], spec.length_col, {"median_session_length": 0.5}, "cont")
    # a user whose lengths are all NULL has no row in the histogram
    return agg.join(medians, spec.user_col, "left").withColumn("returned_d1", _returned("_days")).select(
        spec.user_col, spec.cohort_col, spec.platform_col, spec.region_col, "total_revenue", "returned_d1",
        "total_sessions", "avg_session_length", "median_session_length",
    )
