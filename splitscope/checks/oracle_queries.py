"""Oracle SQL of the significance, decision and report keys."""

from __future__ import annotations

from splitscope.checks.oracle import ORACLE, R, TEMPLATE_CTES, USER_CTES, q
from splitscope.checks.oracle_stats import NB, TP, OSpec, all_tests

NB_CTES = USER_CTES + all_tests(NB)
TP_CTES = TEMPLATE_CTES + all_tests(TP)
PR_CTES = USER_CTES + all_tests(OSpec(levels=("platform_region",)))


def _sel(cols: str, doubles: tuple[str, ...]) -> str:
    """Select list with comparison rounding on the double columns."""
    out = []
    for c in [x.strip() for x in cols.split(",") if x.strip()]:
        name = c.split(" AS ")[-1].strip()
        expr = c.split(" AS ")[0].strip()
        out.append(f"{R(expr)} AS {name}" if name in doubles else (c if " AS " in c else expr))
    return ", ".join(out)


_SIG = "COALESCE(p_value < 0.05, FALSE) AS significant"

_WELCH_D = ("control_mean", "cohort_mean", "delta", "delta_pct", "p_value", "ci_lower", "ci_upper")
_PROP_D = ("control_prop", "cohort_prop", "delta_pp", "p_value", "ci_lower", "ci_upper")
_MW_D = ("control_median", "cohort_median", "delta", "delta_pct", "u_stat", "p_value")

ORACLE["metric_suffstats"] = q(USER_CTES + all_tests(NB)[:1], f"""
SELECT segment_type, segment, cohort,
  COUNT(total_revenue) AS n_total_revenue, {R('AVG(total_revenue)')} AS mean_total_revenue,
  {R('VAR_SAMP(total_revenue)')} AS var_total_revenue,
  COUNT(avg_session_length) AS n_avg_session_length, {R('AVG(avg_session_length)')} AS mean_avg_session_length,
  {R('VAR_SAMP(avg_session_length)')} AS var_avg_session_length,
  COUNT(returned_d1) AS n_returned_d1, {R('SUM(CAST(returned_d1 AS DOUBLE))')} AS sum_returned_d1
FROM su GROUP BY segment_type, segment, cohort""")

ORACLE["sample_size_gate"] = q(USER_CTES + all_tests(NB)[:1], """,
cnt AS (
  SELECT segment_type, segment, cohort,
         unnest(['total_revenue', 'avg_session_length', 'median_session_length', 'returned_d1']) AS metric,
         unnest([COUNT(total_revenue), COUNT(avg_session_length), COUNT(median_session_length), COUNT(returned_d1)]) AS cohort_n
  FROM su GROUP BY segment_type, segment, cohort
),
beside AS (
  SELECT *, COALESCE(MAX(CASE WHEN cohort = 'control' THEN cohort_n END) OVER (PARTITION BY segment_type, segment, metric), 0) AS control_n
  FROM cnt
)
SELECT segment_type, segment, cohort, metric, control_n, cohort_n,
       CASE WHEN cohort_n >= 30 AND control_n >= 30 THEN 'ok' ELSE 'insufficient_data' END AS status
FROM beside WHERE cohort IN ('xxHigh', 'xHigh', 'gameTune', 'xLow', 'xxLow')""")

for lvl, ctes in (("global", NB_CTES), ("platform", NB_CTES), ("region", NB_CTES), ("platform_region", PR_CTES)):
    ORACLE[f"welch_ttest_{lvl}"] = q(ctes, f"""
SELECT segment_type, segment, cohort, {_sel("control_mean, cohort_mean, delta, delta_pct, p_value", _WELCH_D)},
       {_SIG}, {_sel("ci_lower, ci_upper", _WELCH_D)}, control_n, cohort_n, status
FROM arpu WHERE segment_type = '{lvl}'""")
    ORACLE[f"session_ttest_{lvl}"] = q(ctes, f"""
SELECT segment_type, segment, cohort, {_sel("control_mean, cohort_mean, delta, delta_pct, p_value", _WELCH_D)},
       {_SIG}, {_sel("ci_lower, ci_upper", _WELCH_D)}, control_n, cohort_n, status
FROM avgs WHERE segment_type = '{lvl}'""")
    ORACLE[f"prop_ztest_{lvl}"] = q(ctes, f"""
SELECT segment_type, segment, cohort, {_sel("control_prop, cohort_prop, delta_pp, p_value", _PROP_D)},
       {_SIG}, {_sel("ci_lower, ci_upper", _PROP_D)}, control_n, cohort_n, status
FROM d1 WHERE segment_type = '{lvl}'""")
    ORACLE[f"mannwhitney_{lvl}"] = q(ctes, f"""
SELECT segment_type, segment, cohort,
       {_sel("control_median, cohort_median, delta, delta_pct, u_stat, p_value", _MW_D)},
       {_SIG}, control_n, cohort_n, status
FROM meds WHERE segment_type = '{lvl}'""")

_FULL = f"""SELECT segment_type, segment, cohort, {R('arpu_delta_pct')} AS arpu_delta_pct,
       {R('arpu_p_value')} AS arpu_pvalue, {R('d1_delta_pp')} AS d1_delta_pp, {R('d1_p_value')} AS d1_pvalue,
       {R('avg_delta_pct')} AS avg_session_delta_pct, {R('avg_p_value')} AS avg_session_pvalue,
       {R('med_delta_pct')} AS med_session_delta_pct, {R('med_p_value')} AS med_session_pvalue"""
_FULL_WHERE = "arpu_status = 'ok' AND d1_status = 'ok' AND avg_status = 'ok' AND med_status = 'ok'"
ORACLE["full_analysis"] = q(TP_CTES, f"{_FULL} FROM tests WHERE {_FULL_WHERE}")

_TV = """CASE WHEN arpu_p_value IS NULL OR arpu_p_value >= 0.10 THEN 'FAIL'
     WHEN arpu_delta_pct < 3.0 THEN 'FAIL'
     WHEN COALESCE(d1_p_value < 0.05 AND d1_delta_pp < -1.0, FALSE) THEN 'FAIL'
     WHEN COALESCE(avg_p_value < 0.05 AND avg_delta_pct < -3.0, FALSE) THEN 'FAIL'
     WHEN COALESCE(med_p_value < 0.05 AND med_delta_pct < -4.0, FALSE) THEN 'FAIL'
     ELSE 'PASS' END"""
ORACLE["verdict_template"] = q(TP_CTES, f"{_FULL}, {_TV} AS verdict FROM tests WHERE {_FULL_WHERE}")
ORACLE["results_summary"] = q(TP_CTES, f"""
SELECT cohort, {R('arpu_delta_pct')} AS arpu_uplift_pct, {R('arpu_p_value')} AS p_value,
       {R('d1_delta_pp')} AS d1_change_pp, {R('avg_delta_pct')} AS avg_session_pct, {_TV} AS verdict
FROM tests WHERE {_FULL_WHERE} AND segment_type = 'global'""")

_CAND = "cohort IN ('xxHigh', 'xHigh', 'gameTune')"
_NOT_OTHER = "NOT (segment_type = 'region' AND segment = 'Other')"
_VERDICT_COLS = f"""segment_type, segment, cohort, arpu_pass, d1_pass, avg_session_pass, median_session_pass,
       overall_pass, failed_criteria, {R('arpu_delta_pct')} AS arpu_delta_pct, {R('arpu_pvalue')} AS arpu_pvalue,
       status"""
for lvl in ("global", "platform", "region"):
    ORACLE[f"verdict_{lvl}"] = q(NB_CTES, f"""
SELECT {_VERDICT_COLS} FROM verdicts WHERE segment_type = '{lvl}' AND {_CAND} AND {_NOT_OTHER}""")

ORACLE["verdict_reasons"] = q(NB_CTES, """
SELECT t.segment_type, t.segment, t.cohort,
  CASE WHEN v.arpu_pass THEN 'PASS: Uplift ≥ +3% and ' || CASE WHEN t.arpu_p_value < 0.05 THEN 'p<0.05'
                                                            ELSE '0.05≤p<0.10' END
       WHEN t.arpu_p_value IS NULL OR t.arpu_p_value >= 0.10 THEN 'FAIL: Not significant (p ≥ 0.10)'
       ELSE 'FAIL: Uplift < +3%' END AS arpu_reason,
  CASE WHEN NOT COALESCE(t.d1_sig, FALSE) THEN 'PASS: Not significant → no proven retention impact'
       WHEN v.d1_pass THEN 'PASS: Significant but within ±1 pp tolerance'
       ELSE 'FAIL: Significant drop > 1 pp' END AS d1_reason,
  CASE WHEN NOT COALESCE(t.avg_sig, FALSE) THEN 'PASS: Not significant → no proven engagement impact'
       WHEN v.avg_session_pass THEN 'PASS: Significant but drop ≤ 3%'
       ELSE printf('FAIL: Significant drop > 3%% (%.2f%%)', t.avg_delta_pct) END AS avg_session_reason,
  CASE WHEN NOT COALESCE(t.med_sig, FALSE) THEN 'PASS: Not significant → no proven engagement impact'
       WHEN v.median_session_pass THEN 'PASS: Significant but drop ≤ 4%'
       ELSE printf('FAIL: Significant drop > 4%% (%.2f%%)', t.med_delta_pct) END AS median_session_reason
FROM tests t JOIN verdicts v ON v.segment_type = t.segment_type AND v.segment = t.segment AND v.cohort = t.cohort
WHERE t.segment_type = 'global' AND t.cohort IN ('xxHigh', 'xHigh', 'gameTune') AND v.status = 'ok'""")

_WINNERS = f""",
cand AS (SELECT * FROM verdicts WHERE {_CAND} AND {_NOT_OTHER}),
best AS (
  SELECT segment_type, segment, cohort, arpu_delta_pct, arpu_pvalue,
         ROW_NUMBER() OVER (PARTITION BY segment_type, segment ORDER BY arpu_delta_pct DESC,
           CASE cohort WHEN 'xxHigh' THEN 1 WHEN 'xHigh' THEN 2 ELSE 3 END) AS rn
  FROM cand WHERE overall_pass
),
winners AS (
  SELECT s.segment_type, s.segment, COALESCE(b.cohort, 'control') AS winner, b.cohort IS NOT NULL AS has_winner,
         b.arpu_delta_pct, b.arpu_pvalue
  FROM (SELECT DISTINCT segment_type, segment FROM cand) s
  LEFT JOIN best b ON b.segment_type = s.segment_type AND b.segment = s.segment AND b.rn = 1
)"""
ORACLE["segment_winner"] = q(NB_CTES + (_WINNERS.lstrip(",\n"),), f"""
SELECT segment_type, segment, winner, has_winner, {R('arpu_delta_pct')} AS arpu_delta_pct,
       {R('arpu_pvalue')} AS arpu_pvalue FROM winners""")
_CALLOUT = """
SELECT 'gameTune (Overall)' AS "Segment",
       CASE WHEN COALESCE(overall_pass, FALSE) THEN 'RECOMMENDED' ELSE 'NOT RECOMMENDED' END AS "Recommendation",
       printf('%+.2f%%', arpu_delta_pct) AS "ARPU_Uplift",
       CASE WHEN COALESCE(overall_pass, FALSE) THEN 'Passes all tiered criteria'
            ELSE 'No monetization advantage over fixed rules, adds complexity' END AS "Rationale"
FROM verdicts WHERE segment_type = 'global' AND cohort = 'gameTune'"""
ORACLE["variant_callout"] = q(NB_CTES, _CALLOUT)
ORACLE["recommendations"] = q(NB_CTES + (_WINNERS.lstrip(",\n"),), """
SELECT
  CASE segment_type WHEN 'global' THEN 'Global' WHEN 'platform' THEN UPPER(segment[1]) || LOWER(segment[2:])
       ELSE segment END AS "Segment",
  winner AS "Recommendation",
  CASE WHEN has_winner THEN printf('+%.2f%%', arpu_delta_pct)
         || CASE WHEN segment_type = 'global' AND arpu_pvalue >= 0.05 THEN ' (borderline sig)' ELSE '' END
       ELSE '—' END AS "ARPU_Uplift",
  CASE segment_type
    WHEN 'global' THEN CASE WHEN has_winner THEN 'Passes all tiered criteria' ELSE 'No variant passes strict guardrails' END
    WHEN 'platform' THEN CASE WHEN has_winner THEN 'Best on ' || segment || ' with acceptable guardrails'
                              ELSE 'No variant passes tiered criteria' END
    ELSE CASE WHEN has_winner THEN 'Passes tiered criteria' ELSE 'Engagement cost too high or no uplift' END
  END AS "Rationale"
FROM winners
UNION ALL""" + _CALLOUT)

ORACLE["export_arpu_global"] = q(NB_CTES, f"""
SELECT cohort, {R('control_mean')} AS control_arpu, {R('cohort_mean')} AS cohort_arpu, {R('delta')} AS delta,
       {R('delta_pct')} AS delta_pct, {R('p_value')} AS p_value, {_SIG},
       {R('ci_lower')} AS ci_lower, {R('ci_upper')} AS ci_upper
FROM arpu WHERE segment_type = 'global' AND status = 'ok'""")
ORACLE["export_d1_global"] = q(NB_CTES, f"""
SELECT cohort, {R('control_prop')} AS control_d1, {R('cohort_prop')} AS cohort_d1, {R('delta_pp')} AS delta_pp,
       {R('p_value')} AS p_value, {_SIG}
FROM d1 WHERE segment_type = 'global' AND status = 'ok'""")
ORACLE["export_session_global"] = q(NB_CTES, f"""
SELECT a.cohort, {R('a.control_mean')} AS avg_control, {R('a.cohort_mean')} AS avg_cohort,
       {R('a.delta_pct')} AS avg_delta_pct, {R('a.p_value')} AS avg_pvalue, COALESCE(a.p_value < 0.05, FALSE) AS avg_significant,
       {R('m.control_median')} AS median_control, {R('m.cohort_median')} AS median_cohort,
       {R('m.delta_pct')} AS median_delta_pct, {R('m.p_value')} AS median_pvalue,
       COALESCE(m.p_value < 0.05, FALSE) AS median_significant
FROM avgs a JOIN meds m ON m.segment_type = a.segment_type AND m.segment = a.segment AND m.cohort = a.cohort
WHERE a.segment_type = 'global' AND a.status = 'ok' AND m.status = 'ok'""")
ORACLE["export_platform_detailed"] = q(NB_CTES, f"""
SELECT segment AS platform, cohort, {R('arpu_delta_pct')} AS arpu_delta_pct, {R('arpu_p_value')} AS arpu_pvalue,
       COALESCE(arpu_sig, FALSE) AS arpu_significant, {R('d1_delta_pp')} AS d1_delta_pp, {R('d1_p_value')} AS d1_pvalue,
       COALESCE(d1_sig, FALSE) AS d1_significant, {R('avg_delta_pct')} AS avg_session_delta_pct,
       {R('avg_p_value')} AS avg_session_pvalue, COALESCE(avg_sig, FALSE) AS avg_session_significant
FROM tests WHERE segment_type = 'platform' AND {_CAND}
  AND arpu_status = 'ok' AND d1_status = 'ok' AND avg_status = 'ok'""")
ORACLE["export_region_detailed"] = q(NB_CTES, f"""
SELECT segment AS region, cohort, {R('arpu_delta_pct')} AS arpu_delta_pct, {R('arpu_p_value')} AS arpu_pvalue,
       COALESCE(arpu_sig, FALSE) AS arpu_significant, {R('d1_delta_pp')} AS d1_delta_pp, {R('d1_p_value')} AS d1_pvalue,
       COALESCE(d1_sig, FALSE) AS d1_significant
FROM tests WHERE segment_type = 'region' AND segment <> 'Other' AND {_CAND}
  AND arpu_status = 'ok' AND d1_status = 'ok'""")


def _text(expr: str, digits: int, sign: str = "") -> str:
    return f"printf('%{sign}.{digits}f', {R(expr, digits)})"


def _tick(expr: str) -> str:
    return f"CASE WHEN {expr} < 0.05 THEN '✓' ELSE '✗' END"


def _session_texts(t: str, value: str, name: str) -> str:
    return f"""{_text(f'{t}.control_{value}', 2)} || 's' AS control_{name}_fmt,
       {_text(f'{t}.cohort_{value}', 2)} || 's' AS cohort_{name}_fmt, {_text(f'{t}.delta', 2)} || 's' AS {name}_delta_fmt,
       {_text(f'{t}.delta_pct', 2, '+')} || '%' AS {name}_delta_pct_fmt, {_text(f'{t}.p_value', 4)} AS {name}_p_value_fmt,
       {_tick(f'{t}.p_value')} AS {name}_significant_fmt"""


ORACLE["format_results"] = q(NB_CTES, f"""
SELECT a.segment_type, a.segment, a.cohort, {R('a.delta_pct')} AS arpu_delta_pct, {R('a.p_value')} AS arpu_p_value,
       {R('d.delta_pp')} AS d1_delta_pp, {R('d.p_value')} AS d1_p_value,
       '$' || {_text('a.control_mean', 6)} AS control_arpu_fmt, '$' || {_text('a.cohort_mean', 6)} AS cohort_arpu_fmt,
       '$' || {_text('a.delta', 6)} AS delta_fmt, {_text('a.delta_pct', 2, '+')} || '%' AS delta_pct_fmt,
       {_text('a.p_value', 4)} AS p_value_fmt, {_tick('a.p_value')} AS significant_fmt,
       '[' || {_text('a.ci_lower', 6)} || ', ' || {_text('a.ci_upper', 6)} || ']' AS ci_95_fmt,
       {_text('d.control_prop', 2)} || '%' AS control_d1_fmt, {_text('d.cohort_prop', 2)} || '%' AS cohort_d1_fmt,
       {_text('d.delta_pp', 2, '+')} || ' pp' AS delta_pp_fmt, {_text('d.p_value', 4)} AS d1_p_value_fmt,
       {_tick('d.p_value')} AS d1_significant_fmt,
       '[' || {_text('d.ci_lower', 2)} || ', ' || {_text('d.ci_upper', 2)} || '] pp' AS d1_ci_95_fmt,
       {_session_texts('s', 'mean', 'avg')}, {_session_texts('m', 'median', 'median')}
FROM arpu a JOIN d1 d USING (segment_type, segment, cohort) LEFT JOIN avgs s USING (segment_type, segment, cohort)
LEFT JOIN meds m USING (segment_type, segment, cohort)
WHERE a.status = 'ok' AND d.status = 'ok'""")

# read back from the CSV file
ORACLE["export_platform_csv"] = ORACLE["export_platform_detailed"]
