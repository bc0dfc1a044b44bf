from pyspark.sql import functions as F

from splitscope.operators import decision
from splitscope.spec import NOTEBOOK_SPEC

COLS = ("segment_type string, segment string, cohort string, "
        "arpu_delta_pct double, arpu_p_value double, arpu_significant boolean, arpu_status string, "
        "d1_delta_pp double, d1_p_value double, d1_significant boolean, d1_status string, "
        "avg_session_delta_pct double, avg_session_p_value double, avg_session_significant boolean, "
        "avg_session_status string, "
        "med_session_delta_pct double, med_session_p_value double, med_session_significant boolean, "
        "med_session_status string")


def row(cohort, arpu=(5.0, 0.01), d1=(0.0, 0.5), avg=(0.0, 0.5), med=(0.0, 0.5), seg=("global", "Global"),
        status="ok"):
    def t(pair):
        return (pair[0], pair[1], None if pair[1] is None else pair[1] < 0.05, status)
    return (*seg, cohort, *t(arpu), *t(d1), *t(avg), *t(med))


def flags(spark, rows):
    df = spark.createDataFrame(rows, COLS)
    return {r.cohort: r for r in decision.with_pass_flags(df).collect()}


def test_thresholds_at_the_boundaries(spark):
    got = flags(spark, [
        row("p010", arpu=(5.0, 0.10)),                 # p = 0.10 is not < 0.10
        row("p0099", arpu=(3.0, 0.0999)),              # uplift exactly 3 % passes
        row("up29", arpu=(2.9999, 0.01)),
        row("d1drop", d1=(-1.0, 0.01)),                # |delta| = 1 pp allowed
        row("d1drop2", d1=(-1.01, 0.01)),
        row("d1gain", d1=(1.5, 0.01)),                 # significant gain > 1 pp fails (two-sided rule)
        row("avg3", avg=(-3.0, 0.01)), row("avg31", avg=(-3.1, 0.01)),
        row("med4", med=(-4.0, 0.01)), row("med41", med=(-4.1, 0.01)),
        row("nsig", avg=(-50.0, 0.05)),                # p = 0.05 is not significant
        row("undefp", arpu=(5.0, None)),
    ])
    assert got["p010"].arpu_pass is False and got["p0099"].arpu_pass is True and got["up29"].arpu_pass is False
    assert got["d1drop"].d1_pass is True and got["d1drop2"].d1_pass is False and got["d1gain"].d1_pass is False
    assert got["avg3"].avg_session_pass is True and got["avg31"].avg_session_pass is False
    assert got["med4"].median_session_pass is True and got["med41"].median_session_pass is False
    assert got["nsig"].avg_session_pass is True and got["nsig"].overall_pass is True
    assert got["undefp"].arpu_pass is False
    assert got["d1gain"].failed_criteria == "D1"
    assert got["p010"].failed_criteria == "ARPU"


def test_template_rule_is_one_sided_on_d1(spark):
    df = spark.createDataFrame([
        ("global", "Global", "a", 5.0, 0.01, 1.5, 0.01, 0.0, 0.5, 0.0, 0.5),
        ("global", "Global", "b", 5.0, None, 0.0, 0.5, 0.0, 0.5, 0.0, 0.5),
        ("global", "Global", "c", 5.0, 0.01, -1.5, 0.01, 0.0, 0.5, 0.0, 0.5),
    ], "segment_type string, segment string, cohort string, arpu_delta_pct double, arpu_pvalue double, "
       "d1_delta_pp double, d1_pvalue double, avg_session_delta_pct double, avg_session_pvalue double, "
       "med_session_delta_pct double, med_session_pvalue double")
    got = {r.cohort: r.verdict for r in decision.template_verdict(df).collect()}
    assert got == {"a": "PASS", "b": "FAIL", "c": "FAIL"}


def test_winners_tie_none_and_insufficient(spark):
    rows = [
        row("xxHigh", arpu=(5.0, 0.01)), row("xHigh", arpu=(5.0, 0.01)), row("gameTune", arpu=(4.0, 0.01)),
        row("xxHigh", arpu=(1.0, 0.01), seg=("platform", "ios")),
        row("xHigh", arpu=(9.0, 0.01), seg=("region", "Europe"), status="insufficient_data"),
        row("gameTune", arpu=(4.0, 0.07), seg=("region", "Europe")),
    ]
    df = spark.createDataFrame(rows, COLS).withColumn("arpu_p_value", F.col("arpu_p_value"))
    v = decision.verdicts(df, ("global", "platform", "region"), NOTEBOOK_SPEC)
    w = {r.segment: r for r in decision.segment_winners(v, NOTEBOOK_SPEC).collect()}
    assert w["Global"].winner == "xxHigh"        # tie on uplift: earlier candidate wins
    assert w["ios"].winner == "control" and w["ios"].has_winner is False
    assert w["Europe"].winner == "gameTune"      # the insufficient cell never wins
    recs = {r.Segment: r for r in decision.recommendations(decision.segment_winners(v, NOTEBOOK_SPEC)).collect()}
    assert recs["Global"].ARPU_Uplift == "+5.00%"
    assert recs["Ios"].ARPU_Uplift == "—" and recs["Ios"].Rationale == "No variant passes tiered criteria"


def test_callout_of_a_gated_variant_has_no_uplift_text(spark):
    df = spark.createDataFrame([row("gameTune", arpu=(None, None), status="insufficient_data")], COLS)
    v = decision.verdicts(df, "global", NOTEBOOK_SPEC)
    r = decision.variant_callout(v, NOTEBOOK_SPEC).first()
    assert r.ARPU_Uplift is None and r.Recommendation == "NOT RECOMMENDED"


def test_reasons_name_the_thresholds_in_force(spark):
    from splitscope.spec import Thresholds

    rows = [row("up", arpu=(6.0, 0.01)), row("low", arpu=(1.0, 0.01)), row("none", arpu=(6.0, 0.2)), row("drops", arpu=(6.0, 0.06), d1=(-3.0, 0.01), avg=(-9.0, 0.01), med=(-1.0, 0.01))]
    df = spark.createDataFrame(rows, COLS)
    got = {r["cohort"]: r for r in decision.verdict_reasons(df).collect()}
    assert got["up"]["arpu_reason"] == "PASS: Uplift ≥ +3% and p<0.05" and got["drops"]["arpu_reason"] == "PASS: Uplift ≥ +3% and 0.05≤p<0.10"
    assert got["low"]["arpu_reason"] == "FAIL: Uplift < +3%" and got["none"]["arpu_reason"] == "FAIL: Not significant (p ≥ 0.10)"
    assert got["drops"]["d1_reason"] == "FAIL: Significant drop > 1 pp" and got["drops"]["avg_session_reason"] == "FAIL: Significant drop > 3% (-9.00%)"
    assert got["drops"]["median_session_reason"] == "PASS: Significant but drop ≤ 4%" and got["up"]["d1_reason"] == "PASS: Not significant → no proven retention impact"
    th = Thresholds(arpu_min_uplift_pct=2.5, arpu_pvalue=0.125, d1_max_drop_pp=2.0, avg_session_max_drop_pct=7.5, med_session_max_drop_pct=0.5)
    got = {r["cohort"]: r for r in decision.verdict_reasons(df, th).collect()}
    assert got["low"]["arpu_reason"] == "FAIL: Uplift < +2.5%" and got["none"]["arpu_reason"] == "FAIL: Not significant (p ≥ 0.125)"
    assert got["drops"]["d1_reason"] == "FAIL: Significant drop > 2 pp" and got["drops"]["avg_session_reason"] == "FAIL: Significant drop > 7.5% (-9.00%)"
    assert got["drops"]["median_session_reason"] == "FAIL: Significant drop > 0.5% (-1.00%)"
