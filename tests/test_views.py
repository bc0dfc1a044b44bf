from splitscope.operators import breakdowns
from splitscope.plans import pipeline
from splitscope.plans.views import register_views

SF = "/root/testdata/sf0.001"


def test_sql_over_registered_views_matches_operators(spark):
    views = register_views(spark, pipeline.raw_sessions(spark, SF))
    sql = spark.sql("""
        SELECT platform, ab_cohort_name, COUNT(DISTINCT user_id) AS total_users,
               ROUND(AVG(total_revenue), 6) AS arpu
        FROM user_metrics GROUP BY platform, ab_cohort_name""")
    df = breakdowns.platform_breakdown(views["user_metrics"]).select(
        "platform", "ab_cohort_name", "total_users", "arpu")
    assert sorted(sql.collect()) == sorted(df.collect())
    n_clean = spark.sql("SELECT COUNT(*) FROM sessions_clean").first()[0]
    assert n_clean == views["sessions_clean"].count() > 0
