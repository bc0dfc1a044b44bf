"""Property tests over random small samples (few examples: each runs Spark jobs)."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from splitscope.operators import significance as S
from splitscope.operators.quantiles import approx_quantiles
from tests.test_significance import _brute_mw, _users

values = st.lists(st.integers(min_value=0, max_value=12), min_size=30, max_size=45)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(x=values, y=values)
def test_mannwhitney_u_and_p_against_pairs(spark, x, y):
    xs, ys = [float(v) for v in x], [float(v) for v in y]
    users = _users(spark, {"xHigh": xs, "control": ys})
    r = S.mannwhitney(users, "median_session_length", levels=("global",), cohorts=["xHigh"]).first()
    u, p = _brute_mw(xs, ys)
    assert r.u_stat == pytest.approx(u)
    assert r.p_value == pytest.approx(p, abs=1e-12)
    # swapping the roles keeps p (two-sided) and U1 + U2 = n1 * n0
    swapped = _users(spark, {"xHigh": ys, "control": xs})
    r2 = S.mannwhitney(swapped, "median_session_length", levels=("global",), cohorts=["xHigh"]).first()
    assert r2.p_value == pytest.approx(r.p_value, abs=1e-12)
    assert r.u_stat + r2.u_stat == pytest.approx(len(xs) * len(ys))


def test_approx_quantiles_within_rank_error(spark):
    rng = np.random.default_rng(3)
    vals = rng.gamma(2.0, 10.0, 20000)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double").selectExpr("'g' AS g", "v")
    qs = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    got = approx_quantiles(df, ["g"], "v", qs).first()
    srt = np.sort(vals)
    for name, q in qs.items():
        rank = np.searchsorted(srt, getattr(got, name), side="right") / len(srt)
        assert abs(rank - q) <= 1.0 / 10000 + 1.0 / len(srt)
