"""Each cohort against control, per segment, from distributed aggregates.

One GROUPING SETS aggregate over the user table gives, for every (segment,
cohort), the sufficient statistics of the mean tests (n, mean, sample
variance) and of the proportion test (n, successes). The rank test uses a
value histogram (one grouping-sets aggregate with a count column per cohort)
and bucketed prefix sums, so no task ever sees all users of a segment:

  U(cohort)  = sum over values v of f_cohort(v) * (C(v) + f_ctl(v) / 2)
  ties       = sum over v of t^3 - t,  t = f_cohort(v) + f_ctl(v)
  median     = exact interpolated median read off the cumulative counts

where C(v) is the number of control users with a value below v.
Only the small result frame (segments x cohorts) is joined with its control
row and passed through the p-value UDFs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitscope.functions.columns import delta_pct, nan_to_null
from splitscope.functions.tails import t_pvalue, z_pvalue
from splitscope.operators.quantiles import join_on, running_counts
from splitscope.spec import ExperimentSpec, NOTEBOOK_SPEC, Thresholds

LEVELS = ("global", "platform", "region")  # and, asked for by name, "platform_region"
GLOBAL_SEGMENT = "Global"
SEG = ["segment_type", "segment"]
CI_Z = 1.96
OK, INSUFFICIENT = "ok", "insufficient_data"


# ---------------------------------------------------------------- segments
def segmented_agg(df: DataFrame, spec: ExperimentSpec, levels: Sequence[str], keys: Sequence[str],
                  aggs: Sequence[Column]) -> DataFrame:
    """Aggregate per (segment, keys...) for all segment levels in one pass (GROUPING SETS).

    Segment rows with a NULL dimension value are dropped; platform segments are
    limited to `spec.platforms` when it is given.
    """
    p, r = spec.platform_col, spec.region_col
    dims = {"global": [], "platform": [p], "region": [r], "platform_region": [p, r]}
    sets = [dims[lvl] + list(keys) for lvl in levels]
    out = df.groupingSets(sets, p, r, *keys).agg(*aggs, F.grouping_id().alias("_gid"))
    shift = len(keys)
    gid = F.col("_gid")
    seg_type = (
        F.when(gid == (3 << shift), F.lit("global"))
        .when(gid == (1 << shift), F.lit("platform"))
        .when(gid == (2 << shift), F.lit("region"))
        .otherwise(F.lit("platform_region"))
    )
    segment = (
        F.when(gid == (3 << shift), F.lit(GLOBAL_SEGMENT))
        .when(gid == (1 << shift), F.col(p))
        .when(gid == (2 << shift), F.col(r))
        .otherwise(F.concat(F.col(p), F.lit(" / "), F.col(r)))
    )
    if spec.platforms is not None:
        by_platform = (gid == (1 << shift)) | (gid == 0)
        out = out.where(~by_platform | F.col(p).isin(*spec.platforms))
    out = out.select(seg_type.alias("segment_type"), segment.alias("segment"), *keys,
                     *[c for c in out.columns if c not in (p, r, "_gid", *keys)])
    return out.where(F.col("segment").isNotNull())


def _x(name: str) -> Column:
    """Metric value with NULL and NaN both treated as missing (pandas dropna)."""
    return nan_to_null(F.col(name).cast("double"))


# ---------------------------------------------------------------- H1-H3
def metric_suffstats(users: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC, levels: Sequence[str] = LEVELS,
                     mean_metrics: Sequence[str] | None = None,
                     binary_metrics: Sequence[str] | None = None) -> DataFrame:
    """n / mean / var_samp per mean-tested metric and n / successes per binary metric."""
    mean_metrics = list(mean_metrics or (spec.primary_metric, spec.continuous_metric))
    binary_metrics = list(binary_metrics or (spec.binary_metric,))
    u = users.where(F.col(spec.cohort_col).isin(*spec.all_cohorts))
    aggs = []
    for m in mean_metrics:
        aggs += [F.count(_x(m)).alias(f"n_{m}"), F.avg(_x(m)).alias(f"mean_{m}"),
                 F.var_samp(_x(m)).alias(f"var_{m}")]
    for b in binary_metrics:
        aggs += [F.count(_x(b)).alias(f"n_{b}"), F.sum(_x(b)).alias(f"sum_{b}")]
    return segmented_agg(u, spec, levels, [spec.cohort_col], aggs).withColumnRenamed(spec.cohort_col, "cohort")


def pair_with_control(stats: DataFrame, spec: ExperimentSpec, cohorts: Sequence[str]) -> DataFrame:
    """Each tested cohort's row next to its segment's control row (`ctl_` columns).

    The control values are picked by a window over each segment's rows (one row
    per cohort, so a window partition holds at most len(cohorts) + 1 rows). The
    stats aggregate is computed once; a self-join would push a different cohort
    filter into each side and aggregate twice. A segment without control users
    keeps its cohort rows, with NULL control columns (gated).
    """
    value_cols = [c for c in stats.columns if c not in SEG + ["cohort"]]
    w = Window.partitionBy(*SEG)
    is_ctl = F.col("cohort") == spec.control
    paired = stats.select(
        *stats.columns, *[F.max(F.when(is_ctl, F.col(c))).over(w).alias(f"ctl_{c}") for c in value_cols]
    )
    return paired.where(F.col("cohort").isin(*cohorts))


def _gate(n1: Column, n0: Column, spec: ExperimentSpec) -> Column:
    return F.coalesce((n1 >= spec.min_sample) & (n0 >= spec.min_sample), F.lit(False))


def sample_size_gate(users: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC, levels: Sequence[str] = LEVELS,
                     cohorts: Sequence[str] | None = None) -> DataFrame:
    """Per test metric: both sample sizes and whether the n >= min_sample gate passes."""
    cohorts = list(cohorts or spec.test_cohorts)
    metrics = [spec.primary_metric, spec.continuous_metric, spec.median_metric, spec.binary_metric]
    stats = metric_suffstats(users, spec, levels, metrics[:3], metrics[3:])
    pairs = pair_with_control(stats, spec, cohorts)
    rows = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(f"ctl_n_{m}"), F.lit(0)).alias("control_n"),
                 F.col(f"n_{m}").alias("cohort_n"))
        for m in metrics
    ]))
    out = pairs.select(*SEG, "cohort", rows.alias("r")).select(*SEG, "cohort", "r.*")
    return out.withColumn(
        "status", F.when(_gate(F.col("cohort_n"), F.col("control_n"), spec), OK).otherwise(INSUFFICIENT)
    )


# ---------------------------------------------------------------- H4-H6 Welch
def named(cols: dict[str, Column], prefix: str = "") -> list[Column]:
    return [c.alias(f"{prefix}{k}") for k, c in cols.items()]


def welch_columns(m: str, spec: ExperimentSpec, th: Thresholds = Thresholds()) -> dict[str, Column]:
    n1, m1, v1 = F.col(f"n_{m}"), F.col(f"mean_{m}"), F.col(f"var_{m}")
    n0, m0, v0 = F.col(f"ctl_n_{m}"), F.col(f"ctl_mean_{m}"), F.col(f"ctl_var_{m}")
    ok = _gate(n1, n0, spec)
    a, b = v1 / n1, v0 / n0
    se2 = a + b
    t = F.when(se2 > 0, (m1 - m0) / F.sqrt(se2))
    dof = F.when(se2 > 0, se2 * se2 / (a * a / (n1 - 1) + b * b / (n0 - 1)))
    # zero variance on both sides: a certain difference (p = 0) or an undefined test
    p = F.when(se2 > 0, t_pvalue(t, dof)).when(m1 != m0, F.lit(0.0))
    delta = m1 - m0
    se = F.sqrt(se2)

    def g(c: Column) -> Column:
        return F.when(ok, c)

    return {
        "control_mean": g(m0), "cohort_mean": g(m1), "delta": g(delta), "delta_pct": g(delta_pct(delta, m0)),
        "t_stat": g(t), "dof": g(dof), "p_value": g(p),
        "significant": F.coalesce(ok & (p < th.significance), F.lit(False)),  # untested -> false
        "ci_lower": g(delta - CI_Z * se), "ci_upper": g(delta + CI_Z * se),
        "control_n": F.coalesce(n0, F.lit(0)), "cohort_n": n1,
        "status": F.when(ok, OK).otherwise(INSUFFICIENT),
    }


def welch_ttest(users: DataFrame, metric: str, spec: ExperimentSpec = NOTEBOOK_SPEC, levels: Sequence[str] = LEVELS,
                cohorts: Sequence[str] | None = None, th: Thresholds = Thresholds()) -> DataFrame:
    """Welch two-sample t-test (two-sided, unequal variances) of `metric`, cohort vs control."""
    cohorts = list(cohorts or spec.test_cohorts)
    pairs = pair_with_control(metric_suffstats(users, spec, levels, [metric], []), spec, cohorts)
    return pairs.select(*SEG, "cohort", *named(welch_columns(metric, spec, th)))


# ---------------------------------------------------------------- H7-H8 proportions
def prop_columns(b: str, spec: ExperimentSpec, th: Thresholds = Thresholds()) -> dict[str, Column]:
    n1, c1 = F.col(f"n_{b}"), F.col(f"sum_{b}")
    n0, c0 = F.col(f"ctl_n_{b}"), F.col(f"ctl_sum_{b}")
    ok = _gate(n1, n0, spec)
    p1, p0 = c1 / n1, c0 / n0
    pooled = (c1 + c0) / (n1 + n0)
    sd = F.sqrt(pooled * (1 - pooled) * (F.lit(1.0) / n1 + F.lit(1.0) / n0))
    z = F.when(sd > 0, (p1 - p0) / sd)
    p = z_pvalue(z)
    se_u = F.sqrt(p0 * (1 - p0) / n0 + p1 * (1 - p1) / n1)

    def g(c: Column) -> Column:
        return F.when(ok, c)

    return {
        "control_prop": g(p0 * 100), "cohort_prop": g(p1 * 100), "delta_pp": g((p1 - p0) * 100),
        "z_stat": g(z), "p_value": g(p),
        "significant": F.coalesce(ok & (p < th.significance), F.lit(False)),  # untested -> false
        "ci_lower": g((p1 - p0 - CI_Z * se_u) * 100), "ci_upper": g((p1 - p0 + CI_Z * se_u) * 100),
        "control_n": F.coalesce(n0, F.lit(0)), "cohort_n": n1,
        "status": F.when(ok, OK).otherwise(INSUFFICIENT),
    }


def prop_ztest(users: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC, levels: Sequence[str] = LEVELS,
               cohorts: Sequence[str] | None = None, metric: str | None = None,
               th: Thresholds = Thresholds()) -> DataFrame:
    """Two-proportion z-test with pooled variance (two-sided) of a 0/1 metric."""
    cohorts = list(cohorts or spec.test_cohorts)
    b = metric or spec.binary_metric
    pairs = pair_with_control(metric_suffstats(users, spec, levels, [], [b]), spec, cohorts)
    return pairs.select(*SEG, "cohort", *named(prop_columns(b, spec, th)))


# ---------------------------------------------------------------- H9-H10 ranks
def rank_statistics(users: DataFrame, metric: str, spec: ExperimentSpec = NOTEBOOK_SPEC,
                    levels: Sequence[str] = LEVELS) -> DataFrame:
    """Per (segment, cohort): n, U against control, tie term and exact median; control columns alongside."""
    cohorts = list(spec.all_cohorts)  # index 0 is control
    u = users.where(F.col(spec.cohort_col).isin(*cohorts)).select(
        spec.platform_col, spec.region_col, spec.cohort_col, _x(metric).alias("_v")
    ).where(F.col("_v").isNotNull())
    fcols = [f"_f{i}" for i in range(len(cohorts))]
    hist = segmented_agg(
        u, spec, levels, ["_v"], [F.count_if(F.col(spec.cohort_col) == c).alias(f) for c, f in zip(cohorts, fcols)]
    )
    h = running_counts(hist, SEG, "_v", fcols)
    v = F.col("_v")
    f0, c0 = F.col("_f0").cast("double"), F.col("before__f0").cast("double")
    aggs = []
    for i, f in enumerate(fcols):
        n, fi, before = F.col(f"total_{f}"), F.col(f), F.col(f"before_{f}")
        pos = (n - 1).cast("double") * F.lit(0.5)
        aggs += [
            F.max(n).alias(f"n{i}"),
            F.min(F.when(before + fi > F.floor(pos), v)).alias(f"lo{i}"),
            F.min(F.when(before + fi > F.ceil(pos), v)).alias(f"hi{i}"),
        ]
        if i > 0:
            t = fi.cast("double") + f0
            aggs += [
                F.sum(fi.cast("double") * (c0 + f0 * 0.5)).alias(f"u{i}"),
                F.sum(t * t * t - t).alias(f"ties{i}"),
            ]
    per = h.groupBy(*SEG).agg(*aggs)

    def med(i: int) -> Column:
        return F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.lit(0.5)

    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("cohort"), F.col(f"n{i}").alias("n"), F.col(f"u{i}").alias("u"),
                 F.col(f"ties{i}").alias("ties"), med(i).alias("median"))
        for i, c in enumerate(cohorts) if i > 0
    ]))
    return per.select(*SEG, F.col("n0").alias("ctl_n"), med(0).alias("ctl_median"), rows.alias("r")).select(
        *SEG, "r.cohort", "r.n", "r.u", "r.ties", "r.median", "ctl_n", "ctl_median"
    ).where(F.col("n") > 0)


def mw_columns(spec: ExperimentSpec, th: Thresholds = Thresholds()) -> dict[str, Column]:
    n1, n0, u1 = F.col("n").cast("double"), F.col("ctl_n").cast("double"), F.col("u")
    ok = _gate(F.col("n"), F.col("ctl_n"), spec)
    nn = n1 + n0
    mu = n1 * n0 / 2
    sigma = F.sqrt(n1 * n0 / 12 * ((nn + 1) - F.col("ties") / (nn * (nn - 1))))
    u_max = F.greatest(u1, n1 * n0 - u1)
    z = F.when(sigma > 0, (u_max - mu - 0.5) / sigma)
    # 2 * P(Z > z) clipped to 1: z < 0 (U at its mean) or sigma = 0 (all tied) give 1
    p = F.when(z >= 0, z_pvalue(z)).otherwise(F.lit(1.0))
    m1, m0 = F.col("median"), F.col("ctl_median")
    delta = m1 - m0

    def g(c: Column) -> Column:
        return F.when(ok, c)

    return {
        "control_median": g(m0), "cohort_median": g(m1), "delta": g(delta), "delta_pct": g(delta_pct(delta, m0)),
        "u_stat": g(u1), "p_value": g(p),
        "significant": F.coalesce(ok & (p < th.significance), F.lit(False)),  # untested -> false
        "control_n": F.col("ctl_n"), "cohort_n": F.col("n"),
        "status": F.when(ok, OK).otherwise(INSUFFICIENT),
    }


def mannwhitney(users: DataFrame, metric: str, spec: ExperimentSpec = NOTEBOOK_SPEC, levels: Sequence[str] = LEVELS,
                cohorts: Sequence[str] | None = None, th: Thresholds = Thresholds()) -> DataFrame:
    """Mann-Whitney U (two-sided, tie-corrected normal approximation with continuity)."""
    cohorts = list(cohorts or spec.test_cohorts)
    rs = rank_statistics(users, metric, spec, levels).where(F.col("cohort").isin(*cohorts))
    return rs.select(*SEG, "cohort", *named(mw_columns(spec, th)))


# ---------------------------------------------------------------- all four tests
TEST_PREFIXES = ("arpu", "d1", "avg_session", "med_session")


def all_tests(users: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC, levels: Sequence[str] = LEVELS,
              cohorts: Sequence[str] | None = None, th: Thresholds = Thresholds()) -> DataFrame:
    """One row per (segment, cohort) with the four tests side by side (prefixed columns).

    Two distributed aggregates in total (sufficient statistics, value histogram);
    everything after them works on the small result.
    """
    cohorts = list(cohorts or spec.test_cohorts)
    stats = metric_suffstats(users, spec, levels)
    pairs = pair_with_control(stats, spec, cohorts)

    wide = pairs.select(
        *SEG, "cohort",
        *named(welch_columns(spec.primary_metric, spec, th), "arpu_"),
        *named(prop_columns(spec.binary_metric, spec, th), "d1_"),
        *named(welch_columns(spec.continuous_metric, spec, th), "avg_session_"),
    )
    mw = mannwhitney(users, spec.median_metric, spec, levels, cohorts, th)
    mw = mw.select(*SEG, "cohort", *[F.col(c).alias(f"med_session_{c}") for c in mw.columns if c not in SEG + ["cohort"]])
    return join_on(wide, mw, SEG + ["cohort"], "left")
