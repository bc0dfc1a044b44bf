"""Tiered guardrail verdicts, winners and recommendations as column expressions.

All rules run on the small per-(segment, cohort) test frame; nothing is
collected. A row whose tests did not pass the sample-size gate gets
status 'insufficient_data', false pass flags and can never win.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitscope.operators.significance import GLOBAL_SEGMENT, INSUFFICIENT, OK, SEG
from splitscope.spec import ExperimentSpec, NOTEBOOK_SPEC, Thresholds

# Labels of the failed criteria, in the published order.
CRITERIA_LABELS = ("ARPU", "D1", "Avg Session", "Median Session")

# Published recommendation texts.
RATIONALE_GLOBAL_WIN = "Passes all tiered criteria"
RATIONALE_GLOBAL_NONE = "No variant passes strict guardrails"
RATIONALE_PLATFORM_WIN = "Best on {platform} with acceptable guardrails"
RATIONALE_PLATFORM_NONE = "No variant passes tiered criteria"
RATIONALE_REGION_WIN = "Passes tiered criteria"
RATIONALE_REGION_NONE = "Engagement cost too high or no uplift"
CALLOUT_NOT_RECOMMENDED = "NOT RECOMMENDED"
CALLOUT_RATIONALE = "No monetization advantage over fixed rules, adds complexity"
NO_UPLIFT = "—"
BORDERLINE_NOTE = " (borderline sig)"


def _all_ok(prefixes: Sequence[str] = ("arpu", "d1", "avg_session", "med_session")) -> Column:
    cond = None
    for p in prefixes:
        c = F.coalesce(F.col(f"{p}_status") == OK, F.lit(False))
        cond = c if cond is None else cond & c
    return cond


def with_pass_flags(tests: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Notebook rules: primary needs p < 0.10 and uplift >= 3 %; a guardrail fails only
    when significant and beyond its limit (D1 two-sided: |delta| <= 1 pp)."""
    ok = _all_ok()

    def sig(p: str) -> Column:
        return F.coalesce(F.col(f"{p}_significant"), F.lit(False))

    arpu = F.coalesce(
        (F.col("arpu_p_value") < th.arpu_pvalue) & (F.col("arpu_delta_pct") >= th.arpu_min_uplift_pct), F.lit(False)
    )
    d1 = ~sig("d1") | (F.abs(F.col("d1_delta_pp")) <= th.d1_max_drop_pp)
    avg = ~sig("avg_session") | (F.col("avg_session_delta_pct") >= -th.avg_session_max_drop_pct)
    med = ~sig("med_session") | (F.col("med_session_delta_pct") >= -th.med_session_max_drop_pct)
    flags = {"arpu_pass": arpu, "d1_pass": d1, "avg_session_pass": avg, "median_session_pass": med}
    # a cell that did not pass the sample gate has status 'insufficient_data'
    # and false flags, so it can never win
    out = tests.select(*tests.columns, *[F.when(ok, c).otherwise(F.lit(False)).alias(k) for k, c in flags.items()])
    failed = F.array_compact(F.array(*[
        F.when(~F.col(k), F.lit(label)) for k, label in zip(flags, CRITERIA_LABELS)
    ]))
    return out.select(
        *out.columns,
        (F.col("arpu_pass") & F.col("d1_pass") & F.col("avg_session_pass") & F.col("median_session_pass"))
        .alias("overall_pass"),
        F.when(ok, F.concat_ws(", ", failed)).alias("failed_criteria"),
        F.when(ok, OK).otherwise(INSUFFICIENT).alias("status"),
    )


def verdicts(tests: DataFrame, segment_type: str | Sequence[str], spec: ExperimentSpec = NOTEBOOK_SPEC,
             th: Thresholds = Thresholds(), exclude_other: bool = True) -> DataFrame:
    """Verdict rows of one or more segment levels for the candidate cohorts."""
    types = [segment_type] if isinstance(segment_type, str) else list(segment_type)
    t = tests.where(F.col("segment_type").isin(*types) & F.col("cohort").isin(*spec.candidates))
    if exclude_other:
        t = t.where(~((F.col("segment_type") == "region") & (F.col("segment") == "Other")))
    v = with_pass_flags(t, th)
    return v.select(
        *SEG, "cohort", "arpu_pass", "d1_pass", "avg_session_pass", "median_session_pass", "overall_pass",
        "failed_criteria", "arpu_delta_pct", F.col("arpu_p_value").alias("arpu_pvalue"), "status",
    )


def _share(x: float) -> str:
    return f"{x:g}"


def _level(p: float) -> str:
    """A p-value with two decimals, or with as many as it has."""
    return max(f"{p:.2f}", f"{p:g}", key=len)


def verdict_reasons(tests: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Why each criterion passed or failed (the notebook's printed reasoning, as columns), with the thresholds of `th`."""
    v = with_pass_flags(tests, th)
    p = F.col("arpu_p_value")
    up, d1, avg, med = map(_share, (th.arpu_min_uplift_pct, th.d1_max_drop_pp, th.avg_session_max_drop_pct, th.med_session_max_drop_pct))
    # The published reason texts, with the thresholds put in.
    strong, weak = f"p<{_level(th.significance)}", f"{_level(th.significance)}≤p<{_level(th.arpu_pvalue)}"
    uplift, no_uplift = f"PASS: Uplift ≥ +{up}% and ", f"FAIL: Uplift < +{up}%"
    not_significant = f"FAIL: Not significant (p ≥ {_level(th.arpu_pvalue)})"
    no_impact = "PASS: Not significant → no proven {} impact"
    d1_within, d1_drop = f"PASS: Significant but within ±{d1} pp tolerance", f"FAIL: Significant drop > {d1} pp"
    drop_within, drop = "PASS: Significant but drop ≤ {}%", "FAIL: Significant drop > {}%% (%.2f%%)"

    arpu = (
        F.when(F.col("arpu_pass"), F.concat(F.lit(uplift), F.when(p < th.significance, F.lit(strong)).otherwise(F.lit(weak))))
        .when(p.isNull() | (p >= th.arpu_pvalue), F.lit(not_significant))
        .otherwise(F.lit(no_uplift))
    )

    def guard(prefix: str, passed: str, impact: str, within: str, fail: Column) -> Column:
        significant = F.coalesce(F.col(f"{prefix}_significant"), F.lit(False))
        return F.when(~significant, F.lit(no_impact.format(impact))).when(F.col(passed), F.lit(within)).otherwise(fail)

    def length(prefix: str, passed: str, limit: str) -> Column:
        return guard(prefix, passed, "engagement", drop_within.format(limit), F.format_string(drop.format(limit), F.col(f"{prefix}_delta_pct")))

    return v.where(F.col("status") == OK).select(
        *SEG, "cohort",
        arpu.alias("arpu_reason"),
        guard("d1", "d1_pass", "retention", d1_within, F.lit(d1_drop)).alias("d1_reason"),
        length("avg_session", "avg_session_pass", avg).alias("avg_session_reason"),
        length("med_session", "median_session_pass", med).alias("median_session_reason"),
    )


def template_verdict(tests: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """The template's sequential rule (one-sided D1: only a significant drop beyond 1 pp fails).

    An undefined primary p-value fails (it cannot show an uplift).
    """
    def sig_drop(p: str, d: str, limit: float) -> Column:
        return F.coalesce((F.col(p) < th.significance) & (F.col(d) < -limit), F.lit(False))

    ap = F.col("arpu_pvalue")
    verdict = (
        F.when(ap.isNull() | (ap >= th.arpu_pvalue), F.lit("FAIL"))
        .when(F.col("arpu_delta_pct") < th.arpu_min_uplift_pct, F.lit("FAIL"))
        .when(sig_drop("d1_pvalue", "d1_delta_pp", th.d1_max_drop_pp), F.lit("FAIL"))
        .when(sig_drop("avg_session_pvalue", "avg_session_delta_pct", th.avg_session_max_drop_pct), F.lit("FAIL"))
        .when(sig_drop("med_session_pvalue", "med_session_delta_pct", th.med_session_max_drop_pct), F.lit("FAIL"))
        .otherwise(F.lit("PASS"))
    )
    return tests.withColumn("verdict", verdict)


def segment_winners(verdict_rows: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    """Per segment: the passing candidate with the largest ARPU uplift (earlier candidate on ties),
    else control. The window runs over the verdict rows (segments x candidates)."""
    pos = F.array_position(F.array(*[F.lit(c) for c in spec.candidates]), F.col("cohort"))
    w = Window.partitionBy(*SEG).orderBy(F.desc("arpu_delta_pct"), pos)
    best = (
        verdict_rows.where(F.coalesce(F.col("overall_pass"), F.lit(False)))
        .withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") == 1)
        .select(*SEG, F.col("cohort").alias("winner"), "arpu_delta_pct", "arpu_pvalue")
    )
    spine = verdict_rows.select(*SEG).distinct()
    return spine.join(best, SEG, "left").select(
        *SEG, F.coalesce(F.col("winner"), F.lit(spec.control)).alias("winner"),
        (F.col("winner").isNotNull()).alias("has_winner"), "arpu_delta_pct", "arpu_pvalue",
    )


def recommendations(winners: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Segment, Recommendation, ARPU_Uplift, Rationale for every segment (winner or control)."""
    st, seg, win = F.col("segment_type"), F.col("segment"), F.col("has_winner")
    uplift = F.format_string("+%.2f%%", F.col("arpu_delta_pct"))
    borderline = F.when((st == "global") & (F.col("arpu_pvalue") >= th.borderline_pvalue), F.lit(BORDERLINE_NOTE))
    label = F.when(st == "global", F.lit(GLOBAL_SEGMENT)).when(st == "platform", F.initcap(seg)).otherwise(seg)
    rationale = (
        F.when(st == "global", F.when(win, F.lit(RATIONALE_GLOBAL_WIN)).otherwise(F.lit(RATIONALE_GLOBAL_NONE)))
        .when(st == "platform",
              F.when(win, F.format_string(RATIONALE_PLATFORM_WIN.replace("{platform}", "%s"), seg))
              .otherwise(F.lit(RATIONALE_PLATFORM_NONE)))
        .otherwise(F.when(win, F.lit(RATIONALE_REGION_WIN)).otherwise(F.lit(RATIONALE_REGION_NONE)))
    )
    return winners.select(
        label.alias("Segment"),
        F.col("winner").alias("Recommendation"),
        F.when(win, F.concat(uplift, F.coalesce(borderline, F.lit("")))).otherwise(F.lit(NO_UPLIFT))
        .alias("ARPU_Uplift"),
        rationale.alias("Rationale"),
    )


def variant_callout(global_verdicts: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    """Overall row for one named variant; the verdict is derived from its global overall_pass."""
    v = global_verdicts.where(F.col("cohort") == spec.call_out)
    passed = F.coalesce(F.col("overall_pass"), F.lit(False))
    return v.select(
        F.lit(f"{spec.call_out} (Overall)").alias("Segment"),
        F.when(passed, F.lit("RECOMMENDED")).otherwise(F.lit(CALLOUT_NOT_RECOMMENDED)).alias("Recommendation"),
        # NULL when the variant's ARPU test is gated (format_string would print "null")
        F.when(F.col("arpu_delta_pct").isNotNull(), F.format_string("%+.2f%%", F.col("arpu_delta_pct")))
        .alias("ARPU_Uplift"),
        F.when(passed, F.lit(RATIONALE_GLOBAL_WIN)).otherwise(F.lit(CALLOUT_RATIONALE)).alias("Rationale"),
    )
