from pyspark.sql import functions as F

from splitscope.functions.regions import REGION_COUNTRIES
from splitscope.operators import cleaning, quality
from splitscope.sources.testdata import ingest
from tests.helpers import session_rows


def test_dedupe_takes_each_maximum_independently(spark):
    raw = session_rows(spark, [
        dict(session_length=5.0, publisher_revenue=1.0),
        dict(session_length=-1.0, publisher_revenue=9.0),   # same 10 keys: maxima from different rows
        dict(session_number_=2, session_length=3.0),         # one key differs: stays separate
    ])
    out = cleaning.dedupe(raw).orderBy("session_number_").collect()
    assert len(out) == 2
    assert out[0].session_length == 5.0 and out[0].publisher_revenue == 9.0
    assert out[1].session_length == 3.0


def test_filter_drops_each_defect(spark):
    raw = ingest(session_rows(spark, [
        dict(session_id="ok"),
        dict(session_id="null_len", session_length=None),
        dict(session_id="zero_len", session_length=0.0),
        dict(session_id="neg_len", session_length=-2.0),
        dict(session_id="nan_len", session_length=float("nan")),
        dict(session_id="null_cohort", ab_cohort_name=None),
        dict(session_id="nan_cohort", ab_cohort_name="nan"),
        dict(session_id="other_segment", segment_name="existing_users"),
        dict(session_id="null_user", user_id=None),
    ]))
    kept = [r.session_id for r in cleaning.valid_sessions(cleaning.dedupe(raw)).collect()]
    assert kept == ["ok"]


def test_filter_uses_max_length_but_template_filters_first(spark):
    raw = session_rows(spark, [dict(session_length=5.0, publisher_revenue=1.0),
                               dict(session_length=-1.0, publisher_revenue=9.0)])
    clean = cleaning.valid_sessions(cleaning.dedupe(raw)).collect()
    assert clean[0].publisher_revenue == 9.0  # non-positive duplicate still contributes its revenue
    tmpl = raw.select(
        "user_id", "session_id", F.col("ab_cohort_name").alias("cohort_name"), "platform",
        F.lit("Europe").alias("region"), "session_length", F.col("publisher_revenue").alias("revenue"),
        F.col("session_number_").alias("session_number"), F.col("open_at").alias("created_at"),
    )
    t = cleaning.clean_sessions_by_pair(tmpl).collect()
    assert t[0].revenue == 1.0  # template drops the invalid row before grouping


def test_regions(spark):
    codes = [codes[0] for codes in REGION_COUNTRIES.values()] + ["LC", "ZZ", None]
    raw = session_rows(spark, [dict(session_id=str(i), country=c) for i, c in enumerate(codes)])
    got = {r.country: r.region for r in cleaning.with_region(raw).collect()}
    for region, cs in REGION_COUNTRIES.items():
        assert got[cs[0]] == region
    assert got["LC"] == "MEA (Middle East & Africa)"
    assert got["ZZ"] == "Other" and got[None] == "Other"
    assert sum(len(v) for v in REGION_COUNTRIES.values()) == 108


def test_quality_counts(spark):
    raw = session_rows(spark, [
        dict(session_id="a"), dict(session_id="a"), dict(session_id="b", session_length=None),
        dict(session_id="c", ab_cohort_name=None), dict(session_id="d", ab_cohort_name="nan", user_id=None),
    ])
    assert quality.missing_user(raw).first()[0] == 1
    inv = quality.invalid_session_length(raw).first()
    assert inv.invalid_session_length == 1 and abs(inv.pct - 20.0) < 1e-12
    assert quality.missing_cohort(raw).first().missing_cohort == 1  # 'nan' is not counted
    dups = quality.duplicate_sessions(raw).collect()
    assert [(r.session_id, r.dup_count) for r in dups] == [("a", 2)]
