"""DuckDB oracles of the significance tests, verdicts and reports.

Written from the textbook definitions, not from the Spark code:
segments as UNION ALL of plain GROUP BYs, Mann-Whitney from explicit average
ranks (RANK() plus half the tie width), and both tails by Simpson integration
with 2,000 intervals: the Student t tail through the substitution
x = sqrt(df) tan(theta), the normal tail over [|z|, |z| + 12].
"""

from __future__ import annotations

from dataclasses import dataclass

from splitscope.checks.oracle import R

SIMPSON_N = 2000


@dataclass(frozen=True)
class OSpec:
    users: str = "user_metrics"
    cohort: str = "ab_cohort_name"
    platforms: tuple[str, ...] | None = ("android", "ios")
    exclude_other: bool = False
    all_cohorts: tuple[str, ...] = ("control", "xxHigh", "xHigh", "gameTune", "xLow", "xxLow")
    tests: tuple[str, ...] = ("xxHigh", "xHigh", "gameTune", "xLow", "xxLow")
    candidates: tuple[str, ...] = ("xxHigh", "xHigh", "gameTune")
    primary: str = "total_revenue"
    binary: str = "returned_d1"
    continuous: str = "avg_session_length"
    median: str = "median_session_length"
    levels: tuple[str, ...] = ("global", "platform", "region")


NB = OSpec()
TP = OSpec(users="activity", cohort="cohort_name", platforms=None, exclude_other=True,
           tests=("xxHigh", "xHigh", "gameTune"))


def _lst(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


def _simpson_weight(k: str = "g.k") -> str:
    return f"(CASE WHEN {k} = 0 OR {k} = {SIMPSON_N} THEN 1 WHEN {k} % 2 = 1 THEN 4 ELSE 2 END)"


def seg_users(o: OSpec, name: str) -> str:
    plat = f"platform IN ({_lst(o.platforms)})" if o.platforms else "platform IS NOT NULL"
    reg = "region IS NOT NULL" + (" AND region <> 'Other'" if o.exclude_other else "")
    segments = {
        "global": ("'Global'", "TRUE"),
        "platform": ("platform", plat),
        "region": ("region", reg),
        "platform_region": ("platform || ' / ' || region", f"{plat} AND {reg}"),
    }
    parts = [
        f"""SELECT '{lvl}' AS segment_type, {segments[lvl][0]} AS segment, {o.cohort} AS cohort, u.* FROM {o.users} u
    WHERE {o.cohort} IN ({_lst(o.all_cohorts)}) AND {segments[lvl][1]}"""
        for lvl in o.levels
    ]
    return f"\n{name} AS (\n  " + "\n  UNION ALL\n  ".join(parts) + "\n)"


def grid() -> str:
    return f"\ngrid AS (SELECT range AS k FROM range(0, {SIMPSON_N + 1}))"


def welch(o: OSpec, su: str, metric: str, name: str) -> str:
    """CTE `name`: Welch test rows of `metric` for the test cohorts."""
    x = f"CASE WHEN isnan(CAST({metric} AS DOUBLE)) THEN NULL ELSE CAST({metric} AS DOUBLE) END"
    return f"""
{name}_s AS (
  SELECT segment_type, segment, cohort, COUNT({x}) AS n, AVG({x}) AS m, VAR_SAMP({x}) AS v
  FROM {su} GROUP BY segment_type, segment, cohort
),
{name}_p AS (
  SELECT t.segment_type, t.segment, t.cohort, t.n AS n1, t.m AS m1, t.v AS v1,
         COALESCE(c.n, 0) AS n0, c.m AS m0, c.v AS v0,
         t.n >= 30 AND COALESCE(c.n, 0) >= 30 AS ok
  FROM {name}_s t LEFT JOIN {name}_s c
    ON c.segment_type = t.segment_type AND c.segment = t.segment AND c.cohort = 'control'
  WHERE t.cohort IN ({_lst(o.tests)})
),
{name}_t AS (
  SELECT *, v1 / n1 + v0 / n0 AS se2,
         CASE WHEN v1 / n1 + v0 / n0 > 0 THEN (m1 - m0) / SQRT(v1 / n1 + v0 / n0) END AS t,
         CASE WHEN v1 / n1 + v0 / n0 > 0 THEN POW(v1 / n1 + v0 / n0, 2)
              / (POW(v1 / n1, 2) / (n1 - 1) + POW(v0 / n0, 2) / (n0 - 1)) END AS dof
  FROM {name}_p
),
{name}_tail AS (
  SELECT segment_type, segment, cohort,
         2 * SUM({_simpson_weight()} * POW(COS(a + g.k * h), dof - 1)) * h / 3
           / EXP(LGAMMA(dof / 2) + LGAMMA(0.5) - LGAMMA(dof / 2 + 0.5)) AS p
  FROM (SELECT *, ATAN(ABS(t) / SQRT(dof)) AS a, (PI() / 2 - ATAN(ABS(t) / SQRT(dof))) / {SIMPSON_N} AS h
        FROM {name}_t WHERE ok AND t IS NOT NULL) w
  CROSS JOIN grid g
  GROUP BY segment_type, segment, cohort, dof, h
),
{name} AS (
  SELECT w.segment_type, w.segment, w.cohort,
         CASE WHEN ok THEN m0 END AS control_mean, CASE WHEN ok THEN m1 END AS cohort_mean,
         CASE WHEN ok THEN m1 - m0 END AS delta,
         CASE WHEN ok THEN CASE WHEN m0 <> 0 THEN (m1 - m0) / m0 * 100 ELSE 0 END END AS delta_pct,
         CASE WHEN ok THEN CASE WHEN se2 > 0 THEN LEAST(1.0, GREATEST(0.0, tl.p))
                                WHEN m1 <> m0 THEN 0.0 END END AS p_value,
         CASE WHEN ok THEN (m1 - m0) - 1.96 * SQRT(se2) END AS ci_lower,
         CASE WHEN ok THEN (m1 - m0) + 1.96 * SQRT(se2) END AS ci_upper,
         n0 AS control_n, n1 AS cohort_n,
         CASE WHEN ok THEN 'ok' ELSE 'insufficient_data' END AS status
  FROM {name}_t w LEFT JOIN {name}_tail tl
    ON tl.segment_type = w.segment_type AND tl.segment = w.segment AND tl.cohort = w.cohort
)"""


def normal_tail(src: str, zcol: str, name: str) -> str:
    """CTE `name`(segment_type, segment, cohort, p) = 2 * P(Z > |z|) for rows of `src` with z."""
    return f"""
{name} AS (
  SELECT segment_type, segment, cohort,
         2 * SUM({_simpson_weight()} * EXP(-0.5 * POW(a + g.k * h, 2)) / SQRT(2 * PI())) * h / 3 AS p
  FROM (SELECT segment_type, segment, cohort, ABS({zcol}) AS a, 12.0 / {SIMPSON_N} AS h
        FROM {src} WHERE {zcol} IS NOT NULL) s
  CROSS JOIN grid g
  GROUP BY segment_type, segment, cohort, h
)"""


def prop(o: OSpec, su: str, name: str) -> str:
    x = f"CAST({o.binary} AS DOUBLE)"
    return f"""
{name}_s AS (
  SELECT segment_type, segment, cohort, COUNT({x}) AS n, SUM({x}) AS c
  FROM {su} GROUP BY segment_type, segment, cohort
),
{name}_p AS (
  SELECT t.segment_type, t.segment, t.cohort, t.n AS n1, t.c AS c1, COALESCE(c.n, 0) AS n0, c.c AS c0,
         t.n >= 30 AND COALESCE(c.n, 0) >= 30 AS ok
  FROM {name}_s t LEFT JOIN {name}_s c
    ON c.segment_type = t.segment_type AND c.segment = t.segment AND c.cohort = 'control'
  WHERE t.cohort IN ({_lst(o.tests)})
),
{name}_z AS (
  SELECT *, c1 / n1 AS p1, c0 / n0 AS p0,
         CASE WHEN (c1 + c0) / (n1 + n0) * (1 - (c1 + c0) / (n1 + n0)) > 0
              THEN (c1 / n1 - c0 / n0)
                   / SQRT((c1 + c0) / (n1 + n0) * (1 - (c1 + c0) / (n1 + n0)) * (1.0 / n1 + 1.0 / n0)) END AS z
  FROM {name}_p WHERE ok
),{normal_tail(f"{name}_z", "z", f"{name}_tail")},
{name} AS (
  SELECT w.segment_type, w.segment, w.cohort,
         CASE WHEN w.ok THEN z.p0 * 100 END AS control_prop, CASE WHEN w.ok THEN z.p1 * 100 END AS cohort_prop,
         CASE WHEN w.ok THEN (z.p1 - z.p0) * 100 END AS delta_pp,
         CASE WHEN w.ok THEN LEAST(1.0, tl.p) END AS p_value,
         CASE WHEN w.ok THEN (z.p1 - z.p0 - 1.96 * SQRT(z.p0 * (1 - z.p0) / w.n0 + z.p1 * (1 - z.p1) / w.n1)) * 100 END
           AS ci_lower,
         CASE WHEN w.ok THEN (z.p1 - z.p0 + 1.96 * SQRT(z.p0 * (1 - z.p0) / w.n0 + z.p1 * (1 - z.p1) / w.n1)) * 100 END
           AS ci_upper,
         w.n0 AS control_n, w.n1 AS cohort_n,
         CASE WHEN w.ok THEN 'ok' ELSE 'insufficient_data' END AS status
  FROM {name}_p w
  LEFT JOIN {name}_z z ON z.segment_type = w.segment_type AND z.segment = w.segment AND z.cohort = w.cohort
  LEFT JOIN {name}_tail tl ON tl.segment_type = w.segment_type AND tl.segment = w.segment AND tl.cohort = w.cohort
)"""


def mannwhitney(o: OSpec, su: str, name: str) -> str:
    x = f"CASE WHEN isnan(CAST({o.median} AS DOUBLE)) THEN NULL ELSE CAST({o.median} AS DOUBLE) END"
    return f"""
{name}_b AS (
  SELECT segment_type, segment, cohort, {x} AS v FROM {su} WHERE {x} IS NOT NULL
),
{name}_pairs AS (
  SELECT c.cohort AS test_cohort, b.segment_type, b.segment, b.cohort AS member, b.v
  FROM (SELECT DISTINCT segment_type, segment, cohort FROM {name}_b WHERE cohort IN ({_lst(o.tests)})) c
  JOIN {name}_b b ON b.segment_type = c.segment_type AND b.segment = c.segment
                 AND (b.cohort = c.cohort OR b.cohort = 'control')
),
{name}_ranked AS (
  SELECT *, RANK() OVER (PARTITION BY segment_type, segment, test_cohort ORDER BY v)
            + (COUNT(*) OVER (PARTITION BY segment_type, segment, test_cohort, v) - 1) / 2.0 AS r
  FROM {name}_pairs
),
{name}_ties AS (
  SELECT segment_type, segment, test_cohort, SUM(POW(CAST(cnt AS DOUBLE), 3) - cnt) AS tie
  FROM (SELECT segment_type, segment, test_cohort, v, COUNT(*) AS cnt FROM {name}_pairs
        GROUP BY segment_type, segment, test_cohort, v) t
  GROUP BY segment_type, segment, test_cohort
),
{name}_a AS (
  SELECT k.segment_type, k.segment, k.test_cohort AS cohort,
         SUM(CASE WHEN member = k.test_cohort THEN r END) AS r1,
         COUNT(CASE WHEN member = k.test_cohort THEN 1 END) AS n1,
         COUNT(CASE WHEN member = 'control' THEN 1 END) AS n0,
         QUANTILE_CONT(CASE WHEN member = k.test_cohort THEN v END, 0.5) AS med1,
         QUANTILE_CONT(CASE WHEN member = 'control' THEN v END, 0.5) AS med0,
         ANY_VALUE(t.tie) AS tie
  FROM {name}_ranked k JOIN {name}_ties t
    ON t.segment_type = k.segment_type AND t.segment = k.segment AND t.test_cohort = k.test_cohort
  GROUP BY k.segment_type, k.segment, k.test_cohort
),
{name}_z AS (
  SELECT *, n1 >= 30 AND n0 >= 30 AS ok, r1 - n1 * (n1 + 1) / 2.0 AS u1,
         SQRT(n1 * n0 / 12.0 * ((n1 + n0 + 1) - tie / ((n1 + n0) * (n1 + n0 - 1.0)))) AS sigma
  FROM {name}_a
),
{name}_zz AS (
  SELECT *, CASE WHEN sigma > 0 THEN (GREATEST(u1, n1 * n0 - u1) - n1 * n0 / 2.0 - 0.5) / sigma END AS z
  FROM {name}_z
),{normal_tail(f"(SELECT * FROM {name}_zz WHERE ok AND z >= 0)", "z", f"{name}_tail")},
{name} AS (
  SELECT w.segment_type, w.segment, w.cohort,
         CASE WHEN ok THEN med0 END AS control_median, CASE WHEN ok THEN med1 END AS cohort_median,
         CASE WHEN ok THEN med1 - med0 END AS delta,
         CASE WHEN ok THEN CASE WHEN med0 <> 0 THEN (med1 - med0) / med0 * 100 ELSE 0 END END AS delta_pct,
         CASE WHEN ok THEN u1 END AS u_stat,
         CASE WHEN ok THEN CASE WHEN z >= 0 THEN LEAST(1.0, tl.p) ELSE 1.0 END END AS p_value,
         n0 AS control_n, n1 AS cohort_n,
         CASE WHEN ok THEN 'ok' ELSE 'insufficient_data' END AS status
  FROM {name}_zz w
  LEFT JOIN {name}_tail tl ON tl.segment_type = w.segment_type AND tl.segment = w.segment AND tl.cohort = w.cohort
)"""


def all_tests(o: OSpec) -> tuple[str, ...]:
    """CTEs: su, grid, arpu, d1, avgs, meds and `tests` (the four side by side)."""
    return (
        seg_users(o, "su"), grid(), welch(o, "su", o.primary, "arpu"), prop(o, "su", "d1"),
        welch(o, "su", o.continuous, "avgs"), mannwhitney(o, "su", "meds"),
        """
tests AS (
  SELECT a.segment_type, a.segment, a.cohort,
         a.delta_pct AS arpu_delta_pct, a.p_value AS arpu_p_value, a.p_value < 0.05 AS arpu_sig, a.status AS arpu_status,
         d.delta_pp AS d1_delta_pp, d.p_value AS d1_p_value, d.p_value < 0.05 AS d1_sig, d.status AS d1_status,
         s.delta_pct AS avg_delta_pct, s.p_value AS avg_p_value, s.p_value < 0.05 AS avg_sig, s.status AS avg_status,
         m.delta_pct AS med_delta_pct, m.p_value AS med_p_value, m.p_value < 0.05 AS med_sig, m.status AS med_status
  FROM arpu a
  JOIN d1 d ON d.segment_type = a.segment_type AND d.segment = a.segment AND d.cohort = a.cohort
  JOIN avgs s ON s.segment_type = a.segment_type AND s.segment = a.segment AND s.cohort = a.cohort
  LEFT JOIN meds m ON m.segment_type = a.segment_type AND m.segment = a.segment AND m.cohort = a.cohort
),
verdict AS (
  SELECT *,
         arpu_status = 'ok' AND d1_status = 'ok' AND avg_status = 'ok' AND COALESCE(med_status = 'ok', FALSE) AS all_ok,
         COALESCE(arpu_p_value < 0.10 AND arpu_delta_pct >= 3.0, FALSE) AS ap,
         NOT COALESCE(d1_sig, FALSE) OR ABS(d1_delta_pp) <= 1.0 AS dp,
         NOT COALESCE(avg_sig, FALSE) OR avg_delta_pct >= -3.0 AS sp,
         NOT COALESCE(med_sig, FALSE) OR med_delta_pct >= -4.0 AS mp
  FROM tests
),
verdicts AS (
  SELECT segment_type, segment, cohort,
         all_ok AND ap AS arpu_pass, all_ok AND dp AS d1_pass,
         all_ok AND sp AS avg_session_pass, all_ok AND mp AS median_session_pass,
         all_ok AND ap AND dp AND sp AND mp AS overall_pass,
         CASE WHEN all_ok THEN CONCAT_WS(', ', CASE WHEN NOT ap THEN 'ARPU' END, CASE WHEN NOT dp THEN 'D1' END,
                                          CASE WHEN NOT sp THEN 'Avg Session' END,
                                          CASE WHEN NOT mp THEN 'Median Session' END) END AS failed_criteria,
         arpu_delta_pct, arpu_p_value AS arpu_pvalue,
         CASE WHEN all_ok THEN 'ok' ELSE 'insufficient_data' END AS status
  FROM verdict
)""",
    )
