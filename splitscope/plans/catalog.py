"""Query catalogue: key -> callable(spark, sf_dir) -> DataFrame.

Every entry reads the whole test tables and runs the library operators. The
float columns that the published SQL leaves unrounded are rounded here to a
fixed number of digits (`_r`) so that two engines that sum in a different
order still produce equal values; the library functions themselves return
full precision.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitscope.functions.columns import round_half_up
from splitscope.operators import (
    breakdowns, cleaning, decision, eda, profiling, quality, reports, significance, sketches, user_metrics,
)
from splitscope.plans import pipeline, views
from splitscope.session import materialize, shared_path
from splitscope.sources import files, tables, testdata
from splitscope.spec import NOTEBOOK_SPEC as NB, TEMPLATE_SPEC as TP
from splitscope.streaming import user_state

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def _r(df: DataFrame, digits: int = 6, only: tuple[str, ...] | None = None) -> DataFrame:
    """Round double columns (all, or `only`) for cross-engine comparison.

    Midpoints go away from zero in both engines, though sums in a different
    order land on either side of them.
    """
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType) and (only is None or f.name in only):
            cols.append(round_half_up(f.name, digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _raw(spark, sf):
    return pipeline.raw_sessions(spark, sf)


def _clean(spark, sf):
    return pipeline.clean_sessions(spark, sf)


def _users(spark, sf):
    return pipeline.user_metrics_table(spark, sf)


# ---- A: scans -------------------------------------------------------------
@register("scan_sessions")
def scan_sessions(spark, sf):
    return _raw(spark, sf)


@register("dimension_values")
def dimension_values(spark, sf):
    return profiling.dimension_values(_users(spark, sf), ("ab_cohort_name", "platform", "region"))


@register("cohort_row_counts")
def cohort_row_counts(spark, sf):
    return profiling.cohort_row_counts(_users(spark, sf), NB)


def _by_day(spark, sf):
    path = shared_path(spark, "sessions_by_day")
    files.write_sessions_by_day(_raw(spark, sf), path)
    return path


@register("sessions_between_days")
def sessions_between_days(spark, sf):
    """A1: the sessions of one week, read from a layout by day."""
    return files.read_sessions_by_day(spark, _by_day(spark, sf), "2020-02-05", "2020-02-11").drop(files.DAY)


@register("weekend_profile")
def weekend_profile(spark, sf):
    """A1: sessions and users of each weekend day; the days come from a calendar, whose filter prunes the scan."""
    by_day = files.read_sessions_by_day(spark, _by_day(spark, sf))
    bounds = by_day.agg(F.min(files.DAY).alias("a"), F.max(files.DAY).alias("b"))
    calendar = materialize(bounds.select(F.explode(F.sequence("a", "b")).alias("day")).withColumn("weekday", F.weekday("day")), "calendar")
    days = calendar.where("weekday >= 5").select("day")
    return profiling.sessions_and_users_by(files.sessions_on(by_day, days), files.DAY, NB)


@register("user_metrics_bucketed")
def user_metrics_bucketed(spark, sf):
    """A4: the cleaned sessions as a table replaced and bucketed by user; the user metrics need no shuffle from it."""
    name = f"sessions_clean_{uuid.uuid4().hex}"
    clean = tables.replace_table(_clean(spark, sf), name, bucket_by=(NB.user_col,))
    return _r(user_metrics.user_metrics_full(clean, NB), 4, ("total_revenue",))


@register("user_metrics_by_sql")
def user_metrics_by_sql(spark, sf):
    """A3: the chain of catalog views over a table of raw sessions, read by SQL alone."""
    database = f"experiment_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{shared_path(spark, database)}'")
    tables.replace_table(_raw(spark, sf), f"{database}.sessions_raw")
    views.create_views(spark, f"{database}.sessions_raw", NB, database)
    return _r(spark.sql(f"SELECT * FROM {database}.user_metrics"), 4, ("total_revenue",))


def _checked_csv(spark, sf):
    """A2: the user metrics as CSV lines; every tenth user once more with fields missing, every fifteenth with an id that is no number."""
    users = materialize(_users(spark, sf), "user_metrics")
    fields = [F.col(c) for c in users.columns]
    whole = users.select(F.to_csv(F.struct(*fields)).alias("line"))
    short = users.where("user_id % 10 = 0").select(F.to_csv(F.struct(*fields[:6])).alias("line"))
    wrong = users.where("user_id % 15 = 0").select(F.concat(F.lit("u"), F.to_csv(F.struct(*fields))).alias("line"))
    path = shared_path(spark, "users_csv")
    whole.unionByName(short).unionByName(wrong).write.text(path)
    return files.read_checked_csv(spark, path, header=False, rejects=shared_path(spark, "users_csv_rejects"))


@register("csv_user_metrics")
def csv_user_metrics(spark, sf):
    return _r(_checked_csv(spark, sf)[0], 4, ("total_revenue",))


@register("csv_rejects")
def csv_rejects(spark, sf):
    return _checked_csv(spark, sf)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


# ---- B: profiling ---------------------------------------------------------
@register("profile_total_rows")
def profile_total_rows(spark, sf):
    return profiling.total_rows(_raw(spark, sf))


@register("profile_date_range")
def profile_date_range(spark, sf):
    return profiling.date_range(_raw(spark, sf), NB)


@register("profile_platform")
def profile_platform(spark, sf):
    return profiling.sessions_and_users_by(_raw(spark, sf), "platform", NB)


@register("profile_cohort")
def profile_cohort(spark, sf):
    return profiling.sessions_and_users_by(_raw(spark, sf), "ab_cohort_name", NB)


@register("profile_segment")
def profile_segment(spark, sf):
    return profiling.sessions_and_users_by(_raw(spark, sf), "segment_name", NB)


@register("cohort_user_counts")
def cohort_user_counts(spark, sf):
    return profiling.cohort_user_counts(testdata.template_sessions(spark, sf), TP)


@register("profile_platform_region_cohort")
def profile_platform_region_cohort(spark, sf):
    return profiling.users_by_platform_region_cohort(testdata.template_sessions(spark, sf), TP)


#: The reports of B3 to B7 and C7 as lists of dimensions.
USER_REPORTS = ((), ("platform",), ("cohort_name",), ("region",), ("platform", "region", "cohort_name"))


@register("user_counts_sketched")
def user_counts_sketched(spark, sf):
    """B3-B7, C7: sessions and users of all reports from stored sketches, held against the exact counts."""
    sessions = testdata.template_sessions(spark, sf)
    cells = materialize(sketches.user_sketches(sessions, ("platform", "region", "cohort_name"), TP), "user_sketches")
    got = sketches.sketched_users(cells, USER_REPORTS)
    checked = sketches.users_check(got, sketches.exact_users(sessions, USER_REPORTS, TP), sketches.count_error())
    return checked.withColumn("values", F.array_join("values", "|", "-"))


# ---- C: quality -----------------------------------------------------------
@register("dq_missing_user")
def dq_missing_user(spark, sf):
    return quality.missing_user(_raw(spark, sf), NB)


@register("dq_invalid_session_length")
def dq_invalid_session_length(spark, sf):
    return _r(quality.invalid_session_length(_raw(spark, sf), NB))


@register("dq_missing_cohort")
def dq_missing_cohort(spark, sf):
    return _r(quality.missing_cohort(_raw(spark, sf), NB))


@register("dq_duplicate_sessions")
def dq_duplicate_sessions(spark, sf):
    return quality.duplicate_sessions(_raw(spark, sf), NB)


@register("dq_duplicate_user_sessions")
def dq_duplicate_user_sessions(spark, sf):
    return quality.duplicate_user_sessions(testdata.template_sessions(spark, sf), TP)


@register("dq_invalid_rows")
def dq_invalid_rows(spark, sf):
    return quality.invalid_rows(testdata.template_sessions(spark, sf), TP)


@register("cohort_balance")
def cohort_balance(spark, sf):
    return quality.cohort_balance(testdata.template_sessions(spark, sf), TP)


@register("dq_multi_cohort_users")
def dq_multi_cohort_users(spark, sf):
    return quality.multi_cohort_users(_raw(spark, sf), NB)


# ---- D: cleaning ----------------------------------------------------------
@register("dedupe_sessions")
def dedupe_sessions(spark, sf):
    return cleaning.dedupe(_raw(spark, sf))


@register("clean_sessions")
def clean_sessions(spark, sf):
    return cleaning.valid_sessions(cleaning.dedupe(_raw(spark, sf)), NB)


@register("region_enrich")
def region_enrich(spark, sf):
    return _clean(spark, sf)


@register("clean_sessions_by_pair")
def clean_sessions_by_pair(spark, sf):
    return pipeline.template_clean(spark, sf, TP)


# ---- E: exploratory aggregates -------------------------------------------
@register("cohort_percentile_limits")
def cohort_percentile_limits(spark, sf):
    return eda.percentile_limits(_clean(spark, sf), NB, "exact")


@register("percentile_limits_sketched")
def percentile_limits_sketched(spark, sf):
    """E1 from sketches stored by day and cohort: whether the ranks of both limits are within the stated error."""
    clean, limits = _clean(spark, sf), {"p05_limit": 0.05, "p95_limit": 0.95}
    cells = materialize(sketches.value_sketches(clean, NB), "length_sketches")
    got = materialize(sketches.sketched_quantiles(cells, [NB.cohort_col], limits), "sketched_limits")
    return sketches.rank_check(clean, got, [NB.cohort_col], NB.length_col, limits, sketches.rank_error())


@register("session_length_distribution")
def session_length_distribution(spark, sf):
    return eda.session_length_distribution(_clean(spark, sf), NB)


@register("trimmed_mean")
def trimmed_mean(spark, sf):
    return _r(eda.trimmed_mean(_clean(spark, sf), NB))


@register("revenue_distribution")
def revenue_distribution(spark, sf):
    return eda.revenue_distribution(_clean(spark, sf), NB, "exact")


@register("revenue_vs_control")
def revenue_vs_control(spark, sf):
    return eda.revenue_vs_control(_clean(spark, sf), NB, "exact")


@register("ads_by_cohort")
def ads_by_cohort(spark, sf):
    return eda.ads_by_cohort(_clean(spark, sf), NB)


# ---- F: user metrics ------------------------------------------------------
@register("user_base_metrics")
def user_base_metrics(spark, sf):
    return _r(user_metrics.user_base(_clean(spark, sf), NB), 4, ("total_revenue",))


@register("user_first_session")
def user_first_session(spark, sf):
    return user_metrics.first_session_dates(_clean(spark, sf), NB)


@register("d1_retention")
def d1_retention(spark, sf):
    return user_metrics.d1_retention(_clean(spark, sf), NB)


@register("user_metrics_full")
def user_metrics_full(spark, sf):
    return _r(_users(spark, sf), 4, ("total_revenue",))


@register("user_metrics_incremental")
def user_metrics_incremental(spark, sf):
    """F1-F4 from three deliveries: two spans of days, then sessions and repeated rows that come late."""
    raw = materialize(_raw(spark, sf), "sessions_raw")
    late = (F.col("session_number_") % 5 == 0) | (F.col("fs_shown") == 2)
    early = F.to_date("open_at") < F.lit("2020-02-12").cast("date")
    folder = shared_path(spark, "user_state")
    for number, rows in enumerate((raw.where(~late & early), raw.where(~late & ~early), raw.where(late))):
        user_state.apply_delivery(rows, number, folder, NB, buckets=8)
    return _r(user_state.read_user_metrics(spark, folder), 4, ("total_revenue",))


@register("d1_retention_join")
def d1_retention_join(spark, sf):
    return user_metrics.d1_retention_join(pipeline.template_clean(spark, sf, TP), TP)


@register("user_activity")
def user_activity(spark, sf):
    users = _r(pipeline.template_users(spark, sf, TP), 4, ("total_revenue",))
    return _r(users, 6, ("avg_session_length", "median_session_length"))


# ---- G: breakdowns ---------------------------------------------------------
@register("platform_breakdown")
def platform_breakdown(spark, sf):
    return breakdowns.platform_breakdown(_users(spark, sf), NB)


@register("region_breakdown")
def region_breakdown(spark, sf):
    return breakdowns.region_breakdown(_users(spark, sf), NB)


@register("cohort_summary")
def cohort_summary(spark, sf):
    return _r(breakdowns.cohort_summary(pipeline.template_users(spark, sf, TP), TP))


@register("platform_summary")
def platform_summary(spark, sf):
    return _r(breakdowns.platform_summary(pipeline.template_users(spark, sf, TP), TP))


@register("region_summary")
def region_summary(spark, sf):
    return _r(breakdowns.region_summary(pipeline.template_users(spark, sf, TP), TP))


# ---- H: significance tests -------------------------------------------------
def _tests(spark, sf):
    return pipeline.notebook_tests(spark, sf)


def _published_columns(df: DataFrame) -> DataFrame:
    """Drop the raw t/z/dof columns (kept by the library, not part of the published tables)."""
    return df.drop(*[c for c in df.columns if c.endswith(("t_stat", "z_stat", "dof"))])


@register("metric_suffstats")
def metric_suffstats(spark, sf):
    return _r(significance.metric_suffstats(_users(spark, sf), NB))


@register("sample_size_gate")
def sample_size_gate(spark, sf):
    return significance.sample_size_gate(_users(spark, sf), NB)


for _lvl in ("global", "platform", "region", "platform_region"):
    def _register_tests(lvl):
        def welch_q(spark, sf):
            return _r(_published_columns(significance.welch_ttest(_users(spark, sf), NB.primary_metric, NB, (lvl,))))

        def prop_q(spark, sf):
            return _r(_published_columns(significance.prop_ztest(_users(spark, sf), NB, (lvl,))))

        def session_q(spark, sf):
            return _r(_published_columns(
                significance.welch_ttest(_users(spark, sf), NB.continuous_metric, NB, (lvl,))))

        def mw_q(spark, sf):
            return _r(significance.mannwhitney(_users(spark, sf), NB.median_metric, NB, (lvl,)))

        REGISTRY[f"welch_ttest_{lvl}"] = welch_q
        REGISTRY[f"prop_ztest_{lvl}"] = prop_q
        REGISTRY[f"session_ttest_{lvl}"] = session_q
        REGISTRY[f"mannwhitney_{lvl}"] = mw_q
    _register_tests(_lvl)


@register("full_analysis")
def full_analysis(spark, sf):
    return _r(reports.template_analysis(pipeline.template_tests(spark, sf, TP)))


@register("format_results")
def format_results(spark, sf):
    return _r(reports.format_results(_tests(spark, sf)))


# ---- I: decisions ----------------------------------------------------------
def _verdicts(spark, sf, level):
    return decision.verdicts(_tests(spark, sf), level, NB)


@register("verdict_global")
def verdict_global(spark, sf):
    return _r(_verdicts(spark, sf, "global"))


@register("verdict_platform")
def verdict_platform(spark, sf):
    return _r(_verdicts(spark, sf, "platform"))


@register("verdict_region")
def verdict_region(spark, sf):
    return _r(_verdicts(spark, sf, "region"))


@register("verdict_reasons")
def verdict_reasons(spark, sf):
    t = _tests(spark, sf).where("segment_type = 'global'").where(F.col("cohort").isin(*NB.candidates))
    return decision.verdict_reasons(t)


@register("verdict_template")
def verdict_template(spark, sf):
    return _r(decision.template_verdict(reports.template_analysis(pipeline.template_tests(spark, sf, TP))))


@register("results_summary")
def results_summary(spark, sf):
    tv = decision.template_verdict(reports.template_analysis(pipeline.template_tests(spark, sf, TP)))
    return _r(reports.results_summary(tv))


ALL_LEVELS = ("global", "platform", "region")


def _winners(spark, sf):
    return decision.segment_winners(decision.verdicts(_tests(spark, sf), ALL_LEVELS, NB), NB)


@register("segment_winner")
def segment_winner(spark, sf):
    return _r(_winners(spark, sf))


@register("recommendations")
def recommendations(spark, sf):
    v = decision.verdicts(_tests(spark, sf), ALL_LEVELS, NB)
    recs = decision.recommendations(decision.segment_winners(v, NB))
    call = decision.variant_callout(v.where(F.col("segment_type") == "global"), NB)
    return recs.unionByName(call)


@register("variant_callout")
def variant_callout(spark, sf):
    return decision.variant_callout(_verdicts(spark, sf, "global"), NB)


# ---- J: exports --------------------------------------------------------------
@register("export_arpu_global")
def export_arpu_global(spark, sf):
    return _r(reports.arpu_global_detailed(_tests(spark, sf)))


@register("export_d1_global")
def export_d1_global(spark, sf):
    return _r(reports.d1_global_detailed(_tests(spark, sf)))


@register("export_session_global")
def export_session_global(spark, sf):
    return _r(reports.session_global_detailed(_tests(spark, sf)))


@register("export_platform_detailed")
def export_platform_detailed(spark, sf):
    return _r(reports.platform_detailed(_tests(spark, sf), NB))


@register("export_region_detailed")
def export_region_detailed(spark, sf):
    return _r(reports.region_detailed(_tests(spark, sf), NB))


@register("export_platform_csv")
def export_platform_csv(spark, sf):
    """A5: all nine exports are written as CSV; the platform table is read back from its file."""
    exports, out_dir = reports.export_tables(pipeline.notebook_tests(spark, sf, materialized=True), NB), shared_path(spark, "exports")
    reports.write_exports(exports, out_dir)
    return _r(reports.read_exports(exports, out_dir)["platform_detailed"])


# ---- a second session source: the events table ------------------------------
def _event_sessions(spark, sf):
    return files.ingest(testdata.sessions_from_events(spark, sf))


@register("events_profile_date_range")
def events_profile_date_range(spark, sf):
    return profiling.date_range(_event_sessions(spark, sf), NB)


@register("events_profile_cohort")
def events_profile_cohort(spark, sf):
    return profiling.sessions_and_users_by(_event_sessions(spark, sf), "ab_cohort_name", NB)


@register("events_d1_retention")
def events_d1_retention(spark, sf):
    return user_metrics.d1_retention(cleaning.sessions_clean(_event_sessions(spark, sf), NB), NB)


@register("events_platform_breakdown")
def events_platform_breakdown(spark, sf):
    users = user_metrics.user_metrics_full(cleaning.sessions_clean(_event_sessions(spark, sf), NB), NB)
    return breakdowns.platform_breakdown(users, NB)
