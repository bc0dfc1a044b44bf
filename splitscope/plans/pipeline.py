"""The two reuse points of the workflow, built once per run.

raw sessions -> sessions_clean -> user_metrics; everything downstream reads
one of these. `materialized=True` writes the frame into the shared checkpoint
folder so later stages (and retried tasks) do not re-run the upstream plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splitscope.operators import cleaning, user_metrics
from splitscope.session import materialize
from splitscope.sources import files, testdata
from splitscope.spec import ExperimentSpec, NOTEBOOK_SPEC, TEMPLATE_SPEC


def raw_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.ingest(testdata.sessions_raw(spark, sf_dir))


def clean_sessions(spark: SparkSession, sf_dir: str, spec: ExperimentSpec = NOTEBOOK_SPEC,
                   materialized: bool = False) -> DataFrame:
    df = cleaning.sessions_clean(raw_sessions(spark, sf_dir), spec)
    return materialize(df) if materialized else df


def user_metrics_table(spark: SparkSession, sf_dir: str, spec: ExperimentSpec = NOTEBOOK_SPEC,
                       materialized: bool = False, sessions: DataFrame | None = None) -> DataFrame:
    s = sessions if sessions is not None else clean_sessions(spark, sf_dir, spec)
    df = user_metrics.user_metrics_full(s, spec)
    return materialize(df) if materialized else df


def template_clean(spark: SparkSession, sf_dir: str, spec: ExperimentSpec = TEMPLATE_SPEC) -> DataFrame:
    return cleaning.clean_sessions_by_pair(testdata.template_sessions(spark, sf_dir), spec)


def template_users(spark: SparkSession, sf_dir: str, spec: ExperimentSpec = TEMPLATE_SPEC,
                   materialized: bool = False) -> DataFrame:
    df = user_metrics.user_activity(template_clean(spark, sf_dir, spec), spec)
    return materialize(df) if materialized else df


def notebook_tests(spark: SparkSession, sf_dir: str, spec: ExperimentSpec = NOTEBOOK_SPEC,
                   levels=("global", "platform", "region"), users: DataFrame | None = None,
                   materialized: bool = False) -> DataFrame:
    """All four tests for every (segment, tested cohort): two aggregates over the user table, which is written once."""
    from splitscope.operators import significance

    u = users if users is not None else user_metrics_table(spark, sf_dir, spec, materialized=True)
    df = significance.all_tests(u, spec, levels)
    return materialize(df) if materialized else df


def template_tests(spark: SparkSession, sf_dir: str, spec: ExperimentSpec = TEMPLATE_SPEC,
                   users: DataFrame | None = None) -> DataFrame:
    """The template runner: candidates only, regions without 'Other', platforms from the data."""
    from pyspark.sql import functions as F

    from splitscope.operators import significance

    u = users if users is not None else template_users(spark, sf_dir, spec, materialized=True)
    df = significance.all_tests(u, spec, cohorts=spec.candidates)
    return df.where(~((F.col("segment_type") == "region") & (F.col("segment") == "Other")))


def run_concurrently(*actions, max_workers: int = 4) -> list:
    """Run independent actions (e.g. report collects) as concurrent Spark jobs.

    Small report jobs leave most cores idle; submitting them from threads lets
    the scheduler overlap them. Results come back in argument order.
    """
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=max(1, min(max_workers, len(actions)))) as pool:
        futures = [pool.submit(a) for a in actions]
        return [f.result() for f in futures]
