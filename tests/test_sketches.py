"""Sketches stored by day and dimension: errors, unions, NULLs."""

import pytest
from pyspark.sql import functions as F

from splitscope.operators import sketches
from splitscope.spec import NOTEBOOK_SPEC as NB
from tests.helpers import session_rows

QS = {"low": 0.05, "mid": 0.5, "high": 0.95}


@pytest.fixture
def skewed(spark):
    """300,000 lengths, a third of them equal, one cohort with most of the rows, over 5 days."""
    x = F.when(F.col("id") % 3 == 0, 10.0).otherwise(F.exp((F.xxhash64("id") % 1000) / 200.0))
    return spark.range(300_000, numPartitions=8).select(
        F.when(F.col("id") % 10 < 8, "control").otherwise("xLow").alias("ab_cohort_name"),
        F.expr("timestamp_ntz'2020-02-01' + make_dt_interval(cast(id % 5 as int))").alias("open_at"),
        F.when(F.col("id") % 101 != 0, x).alias("session_length"),
        (F.col("id") % 50_000).alias("user_id"),
    )


@pytest.mark.parametrize("k", [64, sketches.KLL_K])
def test_quantiles_within_the_stated_error(skewed, k):
    cells = sketches.value_sketches(skewed, NB, k=k)
    assert cells.count() == 7
    got = sketches.sketched_quantiles(cells, [NB.cohort_col], QS, k)
    assert {r["ab_cohort_name"]: r["n"] for r in got.collect()} == {
        r[0]: r[1] for r in skewed.groupBy("ab_cohort_name").agg(F.count("session_length")).collect()
    }
    # a sketch is drawn at random; what it returned once is what is checked
    fixed = skewed.sparkSession.createDataFrame(got.collect(), got.schema)
    checked = sketches.rank_check(skewed, fixed, [NB.cohort_col], NB.length_col, QS, sketches.rank_error(k)).collect()
    assert len(checked) == 2 and all(r[f"{q}_within"] for r in checked for q in QS)


def test_a_wrong_limit_is_outside(skewed, spark):
    off = spark.createDataFrame([("control", 0, 9.0, 100.0, 140.0)], "ab_cohort_name string, n long, low double, mid double, high double")
    r = sketches.rank_check(skewed, off, [NB.cohort_col], NB.length_col, QS, 0.01).collect()
    assert [(x["low_within"], x["mid_within"]) for x in r] == [(False, False)]


def test_cells_unite_over_any_days_and_all(skewed, spark):
    cells = sketches.value_sketches(skewed, NB)
    two = sketches.sketched_quantiles(cells.where("day <= '2020-02-02'"), [], QS).collect()
    part = skewed.where("open_at < '2020-02-03'")
    assert two[0]["n"] == part.where("session_length is not null").count()
    fixed = spark.createDataFrame([(1, *two[0])], "one int, n long, low double, mid double, high double")
    checked = sketches.rank_check(part.withColumn("one", F.lit(1)), fixed, ["one"], NB.length_col, QS, sketches.rank_error()).first()
    assert all(checked[f"{q}_within"] for q in QS)


def test_small_cells_are_exact(spark):
    rows = [dict(session_length=float(i)) for i in range(1, 101)] + [dict(session_length=None)]
    got = sketches.sketched_quantiles(sketches.value_sketches(session_rows(spark, rows), NB), [NB.cohort_col], QS).first()
    assert (got["n"], got["low"], got["mid"], got["high"]) == (100, 5.0, 50.0, 95.0)


REPORTS = ((), ("ab_cohort_name",), ("platform", "ab_cohort_name"))


def test_users_of_all_reports_from_one_set_of_cells(skewed):
    sessions = skewed.withColumn("platform", F.when(F.col("user_id") % 7 < 3, "ios").when(F.col("user_id") % 7 < 6, "android")).withColumn("user_id", F.when(F.col("user_id") % 11 != 0, F.col("user_id")))
    cells = sketches.user_sketches(sessions, ("platform", "ab_cohort_name"), NB)
    exact = sketches.exact_users(sessions, REPORTS, NB)
    checked = sketches.users_check(sketches.sketched_users(cells, REPORTS), exact, sketches.count_error()).collect()
    assert len(checked) == 1 + 2 + 6 and all(r["within"] for r in checked)
    want = sessions.groupBy("platform", "ab_cohort_name").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("u")).collect()
    found = {tuple(r["values"]): (r["sessions"], r["users"]) for r in checked if r["report"] == "platform,ab_cohort_name"}
    assert found == {(r[0], r[1]): (r["n"], r["u"]) for r in want}


def test_no_sessions(spark):
    none = session_rows(spark, []).drop("region")
    assert sketches.sketched_quantiles(sketches.value_sketches(none, NB), [NB.cohort_col], QS).collect() == []
    assert sketches.sketched_users(sketches.user_sketches(none, ("platform",), NB), (("platform",),)).collect() == []
