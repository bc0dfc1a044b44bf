"""A key holding a third of all rows: results stay whole and exact."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitscope.operators import cleaning, significance, user_metrics
from splitscope.operators.quantiles import exact_quantiles
from tests.helpers import session_rows, ts


def test_hot_user_keeps_exact_user_metrics(spark):
    rows = []
    for i in range(300):  # user 1: a third of all sessions, on 5 days
        rows.append(dict(session_id=f"h{i}", user_id=1, open_at=ts(f"2020-02-0{1 + i % 5}", i % 20),
                         session_length=float(1 + i % 7), publisher_revenue=0.5))
    for u in range(2, 602):
        rows.append(dict(session_id=f"s{u}", user_id=u, open_at=ts("2020-02-10"), session_length=3.0,
                         publisher_revenue=1.0))
    clean = cleaning.sessions_clean(session_rows(spark, rows).repartition(8))
    users = {r.user_id: r for r in user_metrics.user_metrics_full(clean).collect()}
    hot = users[1]
    lengths = [float(1 + i % 7) for i in range(300)]
    assert hot.total_sessions == 300 and hot.total_revenue == pytest.approx(150.0)
    assert hot.avg_session_length == round(float(np.mean(lengths)) + 1e-12, 2)
    assert hot.median_session_length == float(np.sort(lengths)[149])
    assert hot.returned_d1 == 1
    assert len(users) == 601


def test_hot_value_in_exact_quantiles_and_ranks(spark):
    vals = [0.0] * 400 + [float(v) for v in range(1, 801)]  # one value holds a third of the rows
    df = spark.createDataFrame([("g", v) for v in vals], "g string, v double").repartition(8)
    got = exact_quantiles(df, ["g"], "v", {"p25": 0.25, "p50": 0.5, "p90": 0.9}, "cont").first()
    for name, q in (("p25", 0.25), ("p50", 0.5), ("p90", 0.9)):
        assert getattr(got, name) == pytest.approx(float(np.quantile(vals, q)))
    from tests.test_significance import _brute_mw, _users

    x = [0.0] * 40 + [float(v) for v in range(40)]
    y = [0.0] * 60 + [float(v) for v in range(0, 80, 2)]
    users = _users(spark, {"xHigh": x, "control": y})
    r = significance.mannwhitney(users, "median_session_length", levels=("global",), cohorts=["xHigh"]).first()
    u, p = _brute_mw(x, y)
    assert r.u_stat == pytest.approx(u) and r.p_value == pytest.approx(p, abs=1e-12)
