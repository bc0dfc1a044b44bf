"""Projections of the test frame into the published result tables, and their sinks."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitscope.functions.columns import round_half_up
from splitscope.operators.significance import OK, SEG
from splitscope.sources.files import write_csv
from splitscope.spec import ExperimentSpec, NOTEBOOK_SPEC


def _ok(*prefixes: str):
    cond = None
    for p in prefixes:
        c = F.col(f"{p}_status") == OK
        cond = c if cond is None else cond & c
    return cond


def arpu_global_detailed(tests: DataFrame) -> DataFrame:
    return tests.where((F.col("segment_type") == "global") & _ok("arpu")).select(
        "cohort", F.col("arpu_control_mean").alias("control_arpu"), F.col("arpu_cohort_mean").alias("cohort_arpu"),
        F.col("arpu_delta").alias("delta"), F.col("arpu_delta_pct").alias("delta_pct"),
        F.col("arpu_p_value").alias("p_value"), F.col("arpu_significant").alias("significant"),
        F.col("arpu_ci_lower").alias("ci_lower"), F.col("arpu_ci_upper").alias("ci_upper"),
    )


def d1_global_detailed(tests: DataFrame) -> DataFrame:
    return tests.where((F.col("segment_type") == "global") & _ok("d1")).select(
        "cohort", F.col("d1_control_prop").alias("control_d1"), F.col("d1_cohort_prop").alias("cohort_d1"),
        F.col("d1_delta_pp").alias("delta_pp"), F.col("d1_p_value").alias("p_value"),
        F.col("d1_significant").alias("significant"),
    )


def session_global_detailed(tests: DataFrame) -> DataFrame:
    return tests.where((F.col("segment_type") == "global") & _ok("avg_session", "med_session")).select(
        "cohort",
        F.col("avg_session_control_mean").alias("avg_control"), F.col("avg_session_cohort_mean").alias("avg_cohort"),
        F.col("avg_session_delta_pct").alias("avg_delta_pct"), F.col("avg_session_p_value").alias("avg_pvalue"),
        F.col("avg_session_significant").alias("avg_significant"),
        F.col("med_session_control_median").alias("median_control"),
        F.col("med_session_cohort_median").alias("median_cohort"),
        F.col("med_session_delta_pct").alias("median_delta_pct"), F.col("med_session_p_value").alias("median_pvalue"),
        F.col("med_session_significant").alias("median_significant"),
    )


def platform_detailed(tests: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    t = tests.where((F.col("segment_type") == "platform") & F.col("cohort").isin(*spec.candidates)
                    & _ok("arpu", "d1", "avg_session"))
    return t.select(
        F.col("segment").alias("platform"), "cohort",
        "arpu_delta_pct", F.col("arpu_p_value").alias("arpu_pvalue"), "arpu_significant",
        "d1_delta_pp", F.col("d1_p_value").alias("d1_pvalue"), "d1_significant",
        "avg_session_delta_pct", F.col("avg_session_p_value").alias("avg_session_pvalue"), "avg_session_significant",
    )


def region_detailed(tests: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    t = tests.where((F.col("segment_type") == "region") & (F.col("segment") != "Other")
                    & F.col("cohort").isin(*spec.candidates) & _ok("arpu", "d1"))
    return t.select(
        F.col("segment").alias("region"), "cohort",
        "arpu_delta_pct", F.col("arpu_p_value").alias("arpu_pvalue"), "arpu_significant",
        "d1_delta_pp", F.col("d1_p_value").alias("d1_pvalue"), "d1_significant",
    )


def template_analysis(tests: DataFrame) -> DataFrame:
    """The template runner's columns; a row only where all four tests exist."""
    return tests.where(_ok("arpu", "d1", "avg_session", "med_session")).select(
        *SEG, "cohort",
        "arpu_delta_pct", F.col("arpu_p_value").alias("arpu_pvalue"),
        "d1_delta_pp", F.col("d1_p_value").alias("d1_pvalue"),
        "avg_session_delta_pct", F.col("avg_session_p_value").alias("avg_session_pvalue"),
        F.col("med_session_delta_pct").alias("med_session_delta_pct"),
        F.col("med_session_p_value").alias("med_session_pvalue"),
    )


def results_summary(template_verdicts: DataFrame) -> DataFrame:
    return template_verdicts.where(F.col("segment_type") == "global").select(
        "cohort", F.col("arpu_delta_pct").alias("arpu_uplift_pct"), F.col("arpu_pvalue").alias("p_value"),
        F.col("d1_delta_pp").alias("d1_change_pp"), F.col("avg_session_delta_pct").alias("avg_session_pct"),
        "verdict",
    )


def _num(column: str, digits: int, sign: bool = False) -> Column:
    """The number with its digits as text; NULL stays NULL, and no zero is negative."""
    x = round_half_up(column, digits) + F.lit(0.0)
    return F.when(x.isNotNull(), F.format_string(f"%{'+' if sign else ''}.{digits}f", x))


def _range(test: str, digits: int, unit: str = "") -> Column:
    return F.concat(F.lit("["), _num(f"{test}_ci_lower", digits), F.lit(", "), _num(f"{test}_ci_upper", digits), F.lit("]" + unit))


def _mark(test: str) -> Column:
    return F.when(F.col(f"{test}_significant"), F.lit("✓")).otherwise(F.lit("✗"))


def format_results(tests: DataFrame) -> DataFrame:
    """Display strings of the four tests next to the numeric columns (which are always kept), for every segment.

    Rows are those whose revenue and D1 tests exist; strings of a session test that doesn't are NULL.
    """
    session = []
    for test, value, name in (("avg_session", "mean", "avg"), ("med_session", "median", "median")):
        session += [
            F.concat(_num(f"{test}_control_{value}", 2), F.lit("s")).alias(f"control_{name}_fmt"),
            F.concat(_num(f"{test}_cohort_{value}", 2), F.lit("s")).alias(f"cohort_{name}_fmt"),
            F.concat(_num(f"{test}_delta", 2), F.lit("s")).alias(f"{name}_delta_fmt"),
            F.concat(_num(f"{test}_delta_pct", 2, True), F.lit("%")).alias(f"{name}_delta_pct_fmt"),
            _num(f"{test}_p_value", 4).alias(f"{name}_p_value_fmt"),
            _mark(test).alias(f"{name}_significant_fmt"),
        ]
    return tests.where(_ok("arpu", "d1")).select(
        *SEG, "cohort", "arpu_delta_pct", "arpu_p_value", "d1_delta_pp", "d1_p_value",
        F.concat(F.lit("$"), _num("arpu_control_mean", 6)).alias("control_arpu_fmt"),
        F.concat(F.lit("$"), _num("arpu_cohort_mean", 6)).alias("cohort_arpu_fmt"),
        F.concat(F.lit("$"), _num("arpu_delta", 6)).alias("delta_fmt"),
        F.concat(_num("arpu_delta_pct", 2, True), F.lit("%")).alias("delta_pct_fmt"),
        _num("arpu_p_value", 4).alias("p_value_fmt"),
        _mark("arpu").alias("significant_fmt"),
        _range("arpu", 6).alias("ci_95_fmt"),
        F.concat(_num("d1_control_prop", 2), F.lit("%")).alias("control_d1_fmt"),
        F.concat(_num("d1_cohort_prop", 2), F.lit("%")).alias("cohort_d1_fmt"),
        F.concat(_num("d1_delta_pp", 2, True), F.lit(" pp")).alias("delta_pp_fmt"),
        _num("d1_p_value", 4).alias("d1_p_value_fmt"),
        _mark("d1").alias("d1_significant_fmt"),
        _range("d1", 2, " pp").alias("d1_ci_95_fmt"),
        *session,
    )


def export_tables(tests: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC) -> dict[str, DataFrame]:
    """The nine published exports by name, from the test frame of all levels."""
    from splitscope.operators import decision

    verdict_rows = decision.verdicts(tests, ("global", "platform", "region"), spec)
    return {
        "global_results": decision.verdicts(tests, "global", spec),
        "platform_results": decision.verdicts(tests, "platform", spec),
        "region_results": decision.verdicts(tests, "region", spec),
        "final_recommendations": decision.recommendations(decision.segment_winners(verdict_rows, spec)),
        "arpu_global_detailed": arpu_global_detailed(tests),
        "d1_global_detailed": d1_global_detailed(tests),
        "session_global_detailed": session_global_detailed(tests),
        "platform_detailed": platform_detailed(tests, spec),
        "region_detailed": region_detailed(tests, spec),
    }


def read_exports(tables: dict[str, DataFrame], out_dir: str) -> dict[str, DataFrame]:
    """The exports as `write_exports` left them in `out_dir`, typed as the tables that were written."""
    return {
        name: df.sparkSession.read.schema(df.schema).option("header", True).csv(os.path.join(out_dir, name))
        for name, df in tables.items()
    }


def write_exports(tables: dict[str, DataFrame], out_dir: str, parallel: int = 4) -> list[str]:
    """One CSV directory (header, no index) per exported table.

    The tables are small projections of one materialised frame; their writes
    are independent Spark jobs, submitted concurrently.
    """
    from concurrent.futures import ThreadPoolExecutor

    def one(item):
        name, df = item
        path = os.path.join(out_dir, name)
        write_csv(df.repartition(1), path)  # each table has at most segments x cohorts rows
        return path

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        return list(pool.map(one, tables.items()))
