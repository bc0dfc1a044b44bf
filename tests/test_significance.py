import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitscope.functions.tails import normal_two_sided, student_t_two_sided
from splitscope.operators import significance as S
from splitscope.operators.quantiles import exact_quantiles
from tests.helpers import user_rows

LEVEL = ("global",)


def _users(spark, samples, metric="median_session_length", extra=None):
    rows = []
    for cohort, values in samples.items():
        for v in values:
            r = {"ab_cohort_name": cohort, metric: v}
            if extra:
                r.update(extra(cohort, v))
            rows.append(r)
    return user_rows(spark, rows)


def _brute_mw(x, y):
    """U of x against y by all pairs, tie term from the pooled sample, p by the normal approximation."""
    u = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in x for b in y)
    n1, n0 = len(x), len(y)
    n = n1 + n0
    pooled = {}
    for v in list(x) + list(y):
        pooled[v] = pooled.get(v, 0) + 1
    ties = sum(t ** 3 - t for t in pooled.values())
    sigma = math.sqrt(n1 * n0 / 12 * ((n + 1) - ties / (n * (n - 1))))
    z = (max(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / sigma if sigma > 0 else None
    p = 1.0 if z is None or z < 0 else min(1.0, normal_two_sided(z))
    return u, p


@pytest.mark.parametrize("seed,distinct", [(1, 5), (2, 40), (3, 10000)])
def test_mannwhitney_matches_brute_force(spark, seed, distinct):
    rnd = random.Random(seed)
    x = [float(rnd.randrange(distinct)) for _ in range(45)]
    y = [float(rnd.randrange(distinct)) + (1 if seed == 2 else 0) for _ in range(60)]
    users = _users(spark, {"control": y, "xHigh": x})
    for parts in (1, 3, 16):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        r = S.mannwhitney(users, "median_session_length", levels=LEVEL, cohorts=["xHigh"]).first()
        u, p = _brute_mw(x, y)
        assert r.u_stat == pytest.approx(u)
        assert r.p_value == pytest.approx(p, abs=1e-12)
        assert r.cohort_median == pytest.approx(float(np.median(x)))
        assert r.control_median == pytest.approx(float(np.median(y)))


def test_mannwhitney_all_tied_gives_p_one(spark):
    users = _users(spark, {"control": [3.0] * 30, "xHigh": [3.0] * 30})
    r = S.mannwhitney(users, "median_session_length", levels=LEVEL, cohorts=["xHigh"]).first()
    assert r.p_value == 1.0 and r.u_stat == 450.0 and r.delta_pct == 0.0


def test_welch_matches_numpy(spark):
    rnd = np.random.default_rng(7)
    x, y = rnd.normal(5, 2, 40), rnd.normal(4.2, 3, 55)
    users = _users(spark, {"xHigh": list(map(float, x)), "control": list(map(float, y))}, metric="total_revenue")
    r = S.welch_ttest(users, "total_revenue", levels=LEVEL, cohorts=["xHigh"]).first()
    a, b = x.var(ddof=1) / len(x), y.var(ddof=1) / len(y)
    t = (x.mean() - y.mean()) / math.sqrt(a + b)
    dof = (a + b) ** 2 / (a * a / (len(x) - 1) + b * b / (len(y) - 1))
    assert r.t_stat == pytest.approx(t, rel=1e-9)
    assert r.dof == pytest.approx(dof, rel=1e-9)
    assert r.p_value == pytest.approx(student_t_two_sided(t, dof), abs=1e-12)
    assert r.delta_pct == pytest.approx((x.mean() - y.mean()) / y.mean() * 100, rel=1e-9)
    assert r.ci_lower == pytest.approx(x.mean() - y.mean() - 1.96 * math.sqrt(a + b), rel=1e-9)


def test_sample_gate_29_vs_30(spark):
    users = _users(spark, {"control": [1.0] * 30 + [2.0] * 5, "xHigh": [1.0] * 29, "xxHigh": [1.0] * 15 + [2.0] * 15},
                   metric="total_revenue")
    rows = {r.cohort: r for r in S.welch_ttest(users, "total_revenue", levels=LEVEL,
                                               cohorts=["xHigh", "xxHigh"]).collect()}
    assert rows["xHigh"].status == "insufficient_data" and rows["xHigh"].p_value is None
    assert rows["xxHigh"].status == "ok" and rows["xxHigh"].cohort_n == 30


def test_null_and_nan_metrics_not_counted(spark):
    users = _users(spark, {"control": [1.0] * 30 + [None, float("nan")], "xHigh": [2.0] * 31},
                   metric="total_revenue")
    r = S.welch_ttest(users, "total_revenue", levels=LEVEL, cohorts=["xHigh"]).first()
    assert r.control_n == 30 and r.cohort_n == 31


def test_degenerate_zero_variance_and_zero_control(spark):
    users = _users(spark, {"control": [0.0] * 30, "xHigh": [0.0] * 30, "xxHigh": [1.0] * 30},
                   metric="total_revenue")
    rows = {r.cohort: r for r in S.welch_ttest(users, "total_revenue", levels=LEVEL,
                                               cohorts=["xHigh", "xxHigh"]).collect()}
    assert rows["xHigh"].p_value is None and rows["xHigh"].significant is False
    assert rows["xxHigh"].p_value == 0.0 and rows["xxHigh"].delta_pct == 0.0  # zero control mean -> 0 %


def test_prop_ztest(spark):
    ctl = [1] * 25 + [0] * 75
    trt = [1] * 40 + [0] * 60
    users = _users(spark, {"control": ctl, "xHigh": trt, "xxHigh": [0] * 50}, metric="returned_d1")
    users = users.withColumn("returned_d1", F.col("returned_d1").cast("int"))
    rows = {r.cohort: r for r in S.prop_ztest(users, levels=LEVEL, cohorts=["xHigh", "xxHigh"]).collect()}
    p1, p0 = 0.4, 0.25
    pooled = 65 / 200
    z = (p1 - p0) / math.sqrt(pooled * (1 - pooled) * (1 / 100 + 1 / 100))
    assert rows["xHigh"].p_value == pytest.approx(normal_two_sided(z), abs=1e-12)
    assert rows["xHigh"].delta_pp == pytest.approx(15.0)
    # control 25 %, cohort 0 %: pooled variance > 0, defined
    assert rows["xxHigh"].p_value is not None
    allzero = _users(spark, {"control": [0] * 30, "xHigh": [0] * 30}, metric="returned_d1")
    r = S.prop_ztest(allzero.withColumn("returned_d1", F.col("returned_d1").cast("int")), levels=LEVEL,
                     cohorts=["xHigh"]).first()
    assert r.p_value is None and r.significant is False


def test_segments_sum_to_global_and_partitioning_is_irrelevant(spark):
    rnd = random.Random(5)
    rows = [{"ab_cohort_name": rnd.choice(["control", "xHigh"]), "platform": rnd.choice(["android", "ios"]),
             "region": rnd.choice(["Europe", "LATAM", None]), "total_revenue": rnd.random()} for _ in range(400)]
    users = user_rows(spark, rows)
    st = S.metric_suffstats(users)
    by = {(r.segment_type, r.cohort): 0 for r in st.collect()}
    for r in st.collect():
        by[(r.segment_type, r.cohort)] += r.n_total_revenue
    for c in ("control", "xHigh"):
        assert by[("platform", c)] == by[("global", c)]
        assert by[("region", c)] <= by[("global", c)]  # NULL regions are not a segment
    key = ("segment_type", "segment", "cohort")
    a = sorted(S.all_tests(users).collect(), key=lambda r: tuple(r[k] for k in key))
    b = sorted(S.all_tests(users.repartition(7)).collect(), key=lambda r: tuple(r[k] for k in key))
    assert len(a) == len(b)
    for ra, rb in zip(a, b):
        for f in ra.__fields__:
            x, y = ra[f], rb[f]
            if isinstance(x, float) and y is not None:
                assert x == pytest.approx(y, rel=1e-9, abs=1e-12), f
            else:
                assert x == y, f


@pytest.mark.parametrize("kind", ["disc", "cont"])
def test_exact_quantiles_against_numpy(spark, kind):
    rnd = random.Random(11)
    data = [(g, float(rnd.randrange(30))) for g in ("a", "b") for _ in range(rnd.randrange(20, 90))]
    df = spark.createDataFrame(data, "g string, v double")
    qs = {"q05": 0.05, "q50": 0.5, "q95": 0.95, "q10": 0.1}
    for parts in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r.g: r for r in exact_quantiles(df, ["g"], "v", qs, kind).collect()}
        for g in ("a", "b"):
            vals = np.sort([v for gg, v in data if gg == g])
            for name, q in qs.items():
                if kind == "disc":
                    want = vals[max(1, math.ceil(q * len(vals))) - 1]
                else:
                    want = np.quantile(vals, q)
                assert getattr(got[g], name) == pytest.approx(float(want))
