"""The published views for users who work in SQL, as temp views or as views of the catalog.

`register_views` names the library's DataFrames like the views of the SQL
pipeline (cleaned sessions, user base, D1, user metrics); `spark.sql` then
plans queries over them with the same Catalyst optimiser as the DataFrame API.
Pass materialised frames to share them across many SQL queries.

`create_views` writes the same chain into the catalog as SQL over a table of raw sessions: each view
selects from the one before, so any session that reaches the catalog resolves it, without this library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splitscope.functions.columns import NUDGE
from splitscope.functions.regions import region_case_sql
from splitscope.operators import cleaning, user_metrics
from splitscope.operators.quantiles import APPROX_ACCURACY
from splitscope.spec import ExperimentSpec, NOTEBOOK_SPEC


def register_views(spark: SparkSession, raw_sessions: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC,
                   sessions_clean: DataFrame | None = None, users: DataFrame | None = None) -> dict[str, DataFrame]:
    clean = sessions_clean if sessions_clean is not None else cleaning.sessions_clean(raw_sessions, spec)
    views = {
        "sessions_raw": raw_sessions,
        "sessions_clean": clean,
        "user_base": user_metrics.user_base(clean, spec),
        "d1_retention": user_metrics.d1_retention(clean, spec),
        "user_metrics": users if users is not None else user_metrics.user_metrics_full(clean, spec),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return views


def view_sql(raw_table: str, spec: ExperimentSpec = NOTEBOOK_SPEC, database: str = "") -> dict[str, str]:
    """SELECT of each published view by name, in the order in which they build on each other."""
    at = f"{database}." if database else ""
    keys, user, length, time = ", ".join(spec.session_keys), spec.user_col, spec.length_col, spec.time_col
    measures = ", ".join(f"max({raw}) AS {name}" for name, raw in spec.session_measures)
    kept = ", ".join(f"'{x}'" for x in spec.kept_segments)
    sessions = f"""
SELECT {keys}, {measures},
       {region_case_sql(spec.country_col)} AS {spec.region_col}
FROM {raw_table}
WHERE {user} IS NOT NULL AND {spec.session_col} IS NOT NULL AND {spec.cohort_col} IS NOT NULL AND {spec.cohort_col} != 'nan'
  AND {spec.segment_col} IN ({kept})
GROUP BY {keys} HAVING max({length}) > 0"""
    base = f"""
SELECT {user}, min({spec.platform_col}) AS platform, min({spec.region_col}) AS region, min({spec.cohort_col}) AS {spec.cohort_col},
       min({spec.segment_col}) AS segment_name, min({time}) AS first_session_at, min({spec.acquired_col}) AS acquired_at,
       sum({spec.revenue_col}) AS total_revenue, count(*) AS total_sessions, round(avg({length}) * {NUDGE!r}D, 2) AS avg_session_length,
       percentile_approx({length}, 0.5, {APPROX_ACCURACY}) AS median_session_length, sum({spec.fs_col}) AS total_fs_shown,
       sum({spec.rv_col}) AS total_rv_shown, sum({spec.activity_col}) AS total_activity_count
FROM {at}sessions_clean GROUP BY {user}"""
    d1 = f"""
SELECT {user}, array_min(days) AS first_session_date, CAST(array_contains(days, date_add(array_min(days), 1)) AS INT) AS returned_d1
FROM (SELECT {user}, collect_set(to_date({time})) AS days FROM {at}sessions_clean GROUP BY {user})"""
    users = f"SELECT b.*, d.returned_d1 FROM {at}user_base b JOIN {at}d1_retention d USING ({user})"
    return {"sessions_clean": sessions, "user_base": base, "d1_retention": d1, "user_metrics": users}


def create_views(spark: SparkSession, raw_table: str, spec: ExperimentSpec = NOTEBOOK_SPEC, database: str = "") -> list[str]:
    """Create or replace the published views in the catalog over the table `raw_table`; returns their names.

    The raw table holds the session columns with NaN as NULL (as `files.ingest` gives them). A name, once
    created, follows the table: rows that are added, or a table replaced under its name, show in every view.
    """
    names = []
    for name, select in view_sql(raw_table, spec, database).items():
        names.append(f"{database}.{name}" if database else name)
        spark.sql(f"CREATE OR REPLACE VIEW {names[-1]} AS {select}")
    return names
