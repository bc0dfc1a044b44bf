"""Data-quality checks on the raw session table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitscope.functions.columns import pct_of
from splitscope.spec import ExperimentSpec, NOTEBOOK_SPEC


def missing_user(sessions: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    return sessions.agg(F.count_if(F.col(spec.user_col).isNull()).alias("missing_user_id"))


def _count_and_pct(sessions: DataFrame, cond, name: str) -> DataFrame:
    """Count of rows matching `cond` and its share of all rows, in one scan."""
    return sessions.agg(F.count_if(cond).alias(name), F.count(F.lit(1)).alias("_all")).select(
        name, pct_of(F.col(name), F.col("_all")).alias("pct")
    )


def invalid_session_length(sessions: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    length = F.col(spec.length_col)
    return _count_and_pct(sessions, length.isNull() | (length <= 0), "invalid_session_length")


def missing_cohort(sessions: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    """NULL cohorts only; the literal 'nan' is not counted here (cleaning drops it)."""
    return _count_and_pct(sessions, F.col(spec.cohort_col).isNull(), "missing_cohort")


def duplicate_sessions(sessions: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    """Session ids seen more than once among rows with a positive length."""
    length = F.col(spec.length_col)
    return (
        sessions.where(length.isNotNull() & (length > 0))
        .groupBy(spec.session_col)
        .agg(F.count(F.lit(1)).alias("dup_count"))
        .where(F.col("dup_count") > 1)
    )


def duplicate_user_sessions(sessions: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    return (
        sessions.groupBy(spec.user_col, spec.session_col)
        .agg(F.count(F.lit(1)).alias("dup_count"))
        .where(F.col("dup_count") > 1)
    )


def invalid_rows(sessions: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    """Rows with a non-positive length or negative revenue (NULL length is not listed)."""
    return sessions.where((F.col(spec.length_col) <= 0) | (F.col(spec.revenue_col) < 0))


def cohort_balance(sessions: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    """Users per cohort and their share of the sum over cohorts.

    The denominator is an uncorrelated scalar subquery over the aggregated
    result (one row per cohort value), never a window over session rows.
    """
    per = sessions.groupBy(spec.cohort_col).agg(F.count_distinct(spec.user_col).alias("users"))
    total = per.select(F.sum("users")).scalar()
    return per.withColumn("pct", F.round(pct_of(F.col("users"), total), 2))


def multi_cohort_users(sessions: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    """Users assigned to more than one cohort (the user-level views pick one silently)."""
    return (
        sessions.where(F.col(spec.user_col).isNotNull())
        .groupBy(spec.user_col)
        .agg(F.count_distinct(spec.cohort_col).alias("cohorts"))
        .where(F.col("cohorts") > 1)
    )
