"""Profiling of the raw session table (row counts, date range, dimension sizes)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitscope.spec import ExperimentSpec, NOTEBOOK_SPEC


def total_rows(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count(F.lit(1)).alias("total_rows"))


def date_range(sessions: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    """Start, end and the day difference (the start day itself is not counted)."""
    d = F.to_date(F.col(spec.time_col))
    return sessions.agg(F.min(d).alias("experiment_start"), F.max(d).alias("experiment_end")).withColumn(
        "duration_days", F.datediff("experiment_end", "experiment_start")
    )


def sessions_and_users_by(sessions: DataFrame, key: str, spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    """Sessions and distinct users per value of one dimension, most sessions first."""
    return (
        sessions.groupBy(key)
        .agg(F.count(F.lit(1)).alias("sessions"), F.count_distinct(spec.user_col).alias("users"))
        .orderBy(F.desc("sessions"))
    )


def cohort_user_counts(sessions: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    return (
        sessions.groupBy(spec.cohort_col)
        .agg(F.count_distinct(spec.user_col).alias("user_count"))
        .orderBy(F.desc("user_count"))
    )


def users_by_platform_region_cohort(sessions: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    return sessions.groupBy(spec.platform_col, spec.region_col, spec.cohort_col).agg(
        F.count_distinct(spec.user_col).alias("users")
    )


def dimension_values(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Distinct values of several dimensions in one pass: (dimension, value)."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    )
    return df.select(pairs.alias("p")).select("p.dimension", "p.value").distinct()


def cohort_row_counts(df: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    """Rows per cohort of a user-level table (one row per user)."""
    return df.groupBy(spec.cohort_col).agg(F.count(F.lit(1)).alias("rows"))
