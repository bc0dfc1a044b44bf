"""Dedupe, validity filter and region enrichment of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitscope.functions.regions import region_of
from splitscope.spec import ExperimentSpec, NOTEBOOK_SPEC, TEMPLATE_SPEC


def dedupe(raw: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    """One row per distinct combination of the session keys; each measure is its own maximum.

    The maxima may come from different duplicate rows, and rows that differ in
    any key survive as separate sessions. Partial (map-side) aggregation
    collapses duplicates before the shuffle on the keys.
    """
    return raw.groupBy(*spec.session_keys).agg(*[F.max(raw_name).alias(name) for name, raw_name in spec.session_measures])


def valid_sessions(deduped: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    """Keep sessions with ids, a positive (maximum) length and a real cohort of a kept segment."""
    cohort = F.col(spec.cohort_col)
    return deduped.where(
        F.col(spec.user_col).isNotNull()
        & F.col(spec.session_col).isNotNull()
        & (F.col(spec.length_col) > 0)
        & cohort.isNotNull()
        & (cohort != "nan")
        & F.col(spec.segment_col).isin(*spec.kept_segments)
    )


def with_region(df: DataFrame, country_col: str = "country", region_col: str = "region") -> DataFrame:
    return df.withColumn(region_col, region_of(country_col))


def sessions_clean(raw: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    """Dedupe -> filter -> region (the cleaned session view)."""
    return with_region(valid_sessions(dedupe(raw, spec), spec), spec.country_col, spec.region_col)


def clean_sessions_by_pair(sessions: DataFrame, spec: ExperimentSpec = TEMPLATE_SPEC) -> DataFrame:
    """Template cleaning: drop non-positive lengths first, then one row per (user, session).

    ANY_VALUE of the dimensions is taken as MIN, a deterministic choice that is
    equal to any value when the dimension is constant within the pair.
    """
    return (
        sessions.where(F.col(spec.length_col) > 0)
        .groupBy(spec.user_col, spec.session_col)
        .agg(
            F.min(spec.cohort_col).alias(spec.cohort_col),
            F.min(spec.platform_col).alias(spec.platform_col),
            F.min(spec.region_col).alias(spec.region_col),
            F.max(spec.length_col).alias(spec.length_col),
            F.max(spec.revenue_col).alias(spec.revenue_col),
            F.max("session_number").alias("session_number"),
            F.max(spec.time_col).alias(spec.time_col),
        )
    )
