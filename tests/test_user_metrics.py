from pyspark.sql import functions as F

from splitscope.operators import breakdowns, user_metrics
from splitscope.operators.cleaning import with_region
from splitscope.spec import TEMPLATE_SPEC
from tests.helpers import session_rows, ts


def _d1(spark, days_by_user):
    rows = []
    for u, days in days_by_user.items():
        for i, d in enumerate(days):
            rows.append(dict(session_id=f"{u}-{i}", user_id=u, open_at=ts(d, 10 + i)))
    s = with_region(session_rows(spark, rows))
    return {r.user_id: r.returned_d1 for r in user_metrics.d1_retention(s).collect()}


def test_d1_calendar(spark):
    got = _d1(spark, {
        1: ["2020-02-28", "2020-02-29"],          # leap day counts as day 1
        2: ["2020-01-31", "2020-02-01"],          # month end
        3: ["2020-02-05", "2020-02-05"],          # same-day second session
        4: ["2020-02-05", "2020-02-07"],          # day 2 only
        5: ["2020-02-29"],                        # first seen on the last day (censored)
        6: ["2020-02-10", "2020-02-12", "2020-02-11"],  # out of order
    })
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 1}


def test_template_d1_matches(spark):
    from pyspark.sql import functions as F

    from splitscope.spec import TEMPLATE_SPEC

    rows = [dict(session_id="a", user_id=1, open_at=ts("2020-02-28", 23)),
            dict(session_id="b", user_id=1, open_at=ts("2020-02-29", 0)),
            dict(session_id="c", user_id=2, open_at=ts("2020-02-28", 1))]
    s = session_rows(spark, rows).select(
        "user_id", "session_id", F.col("open_at").alias("created_at"))
    got = {r.user_id: r.returned_d1 for r in user_metrics.d1_retention_join(s, TEMPLATE_SPEC).collect()}
    assert got == {1: 1, 2: 0}


def test_user_base_and_arpu_denominator(spark):
    from splitscope.operators.cleaning import sessions_clean

    s = sessions_clean(session_rows(spark, [
        dict(session_id="a", user_id=1, publisher_revenue=None, session_length=27.45),
        dict(session_id="b", user_id=1, publisher_revenue=None, session_length=27.46),
        dict(session_id="c", user_id=2, publisher_revenue=4.0, session_length=3.0),
    ]))
    users = user_metrics.user_metrics_full(s)
    by = {r.user_id: r for r in users.collect()}
    assert by[1].total_revenue is None and by[1].total_sessions == 2
    assert by[1].avg_session_length == 27.46  # exact mean 27.455 rounds half away from zero
    b = breakdowns.cohort_breakdown(users, ["platform"]).first()
    assert b.arpu == 4.0 and b.total_users == 2  # the all-NULL revenue user leaves the ARPU mean


def test_d1_censored_users_can_be_excluded(spark):
    rows = [dict(session_id="a", user_id=1, open_at=ts("2020-02-10")),
            dict(session_id="b", user_id=1, open_at=ts("2020-02-11")),
            dict(session_id="c", user_id=2, open_at=ts("2020-02-11"))]  # first seen on the last day
    s = with_region(session_rows(spark, rows))
    kept = {r.user_id: r.returned_d1 for r in user_metrics.d1_retention(s).collect()}
    excl = {r.user_id: r.returned_d1 for r in user_metrics.d1_retention(s, exclude_censored=True).collect()}
    assert kept == {1: 1, 2: 0} and excl == {1: 1, 2: None}


def test_user_metrics_can_exclude_censored_users(spark):
    from splitscope.operators.cleaning import sessions_clean

    rows = [dict(session_id="a", user_id=1, open_at=ts("2020-02-10")),
            dict(session_id="b", user_id=2, open_at=ts("2020-02-11"))]
    s = sessions_clean(session_rows(spark, rows))
    got = {r.user_id: r.returned_d1 for r in user_metrics.user_metrics_full(s, exclude_censored=True).collect()}
    assert got == {1: 0, 2: None}


def test_exact_median_of_a_user_with_millions_of_lengths(spark):
    """One user holds most sessions, each with a length of its own; the others have few, or no length."""
    big = spark.range(2_000_001, numPartitions=8).select(F.lit(1).cast("long").alias("user_id"), F.col("id").cast("string").alias("session_id"), (F.col("id") * 0.5).alias("session_length"))
    small = spark.createDataFrame([(2, "a", 1.0), (2, "b", 4.0), (3, "c", 7.0), (4, "d", None), (None, "e", 1.0)], "user_id long, session_id string, session_length double")
    pairs = big.unionByName(small).select(
        "*", F.lit("control").alias("cohort_name"), F.lit("ios").alias("platform"), F.lit("Europe").alias("region"), F.lit(1.0).alias("revenue"), F.expr("timestamp_ntz'2020-02-01'").alias("created_at"),
    )
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    got = {r["user_id"]: r for r in user_metrics.user_activity(pairs, TEMPLATE_SPEC).collect()}
    assert {u: r["median_session_length"] for u, r in got.items()} == {1: 500_000.0, 2: 2.5, 3: 7.0, 4: None}
    assert got[1]["total_sessions"] == 2_000_001 and got[1]["avg_session_length"] == 500_000.0
    plan = user_metrics.user_activity(pairs, TEMPLATE_SPEC)._jdf.queryExecution().executedPlan().toString()
    assert "median" not in plan.replace("median_session_length", "")
