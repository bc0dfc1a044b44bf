"""Replaced tables, the layout by day, catalog views and checked CSV input."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from splitscope.operators import cleaning, user_metrics
from splitscope.plans import views
from splitscope.session import shared_path
from splitscope.sources import files, tables
from splitscope.sources.schemas import USER_METRICS
from splitscope.spec import NOTEBOOK_SPEC as NB
from tests.helpers import session_rows, ts, user_rows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def name(spark):
    n = f"t_{uuid.uuid4().hex}"
    yield n
    tables.drop_table(spark, n)


def some_sessions(spark, users=60):
    rows = [
        dict(session_id=f"s{u}-{d}", user_id=u, open_at=ts(f"2020-02-{1 + d:02d}"), session_length=float(1 + u % 7 + d), publisher_revenue=u / 8, country="FR" if u % 2 else None)
        for u in range(users) for d in range(1 + u % 3)
    ]
    return session_rows(spark, rows)


def test_readers_see_the_old_rows_or_the_new(spark, name):
    tables.replace_table(spark.range(10), name)
    before = spark.table(name)
    before.schema  # planned on the first version
    after = tables.replace_table(spark.range(100, 105), name)
    assert sorted(r[0] for r in before.collect()) == list(range(10))
    assert sorted(r[0] for r in after.collect()) == sorted(r[0] for r in spark.sql(f"SELECT * FROM {name}").collect()) == list(range(100, 105))


def test_a_table_is_replaced_from_itself(spark, name):
    tables.replace_table(spark.range(5), name)
    for _ in range(3):
        now = spark.table(name)
        tables.replace_table(now.select((F.col("id") + 1).alias("id")), name)
    assert sorted(r[0] for r in spark.table(name).collect()) == [3, 4, 5, 6, 7]


def test_a_failed_write_leaves_the_old_version(spark, name):
    tables.replace_table(spark.range(3), name)
    broken = spark.range(1000).select(F.when(F.col("id") == 999, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        tables.replace_table(broken, name)
    assert spark.table(name).count() == 3
    tables.replace_table(spark.range(4), name)
    tables.replace_table(spark.range(5), name)
    assert spark.table(name).count() == 5 and len(tables.versions(spark, name)) == 2


def test_old_versions_and_their_files_go(spark, name):
    folder = shared_path(spark, "versions")
    for n in range(1, 6):
        tables.replace_table(spark.range(n), name, location=folder, keep=1)
    held = tables.versions(spark, name)
    assert len(held) == 2 and sorted(os.listdir(folder.removeprefix("file:"))) == [v.lower() for v in held]
    tables.drop_table(spark, name, location=folder)
    assert os.listdir(folder.removeprefix("file:")) == [] and not spark.catalog.tableExists(name)


def test_changed_columns_show_under_the_name(spark, name):
    tables.replace_table(spark.range(3), name)
    assert tables.replace_table(spark.range(3).select(F.lit("x").alias("a"), "id"), name).columns == ["a", "id"]


def test_no_shuffle_on_the_user_from_a_bucketed_table(spark, name):
    clean = cleaning.sessions_clean(some_sessions(spark), NB)
    want = sorted(map(tuple, user_metrics.user_metrics_full(clean, NB).collect()))
    stored = tables.replace_table(clean, name, bucket_by=("user_id",), buckets=4)
    for df in (user_metrics.user_metrics_full(stored, NB), user_metrics.d1_retention(stored, NB)):
        assert "hashpartitioning(user_id" not in plan_of(df)
    assert sorted(map(tuple, user_metrics.user_metrics_full(stored, NB).collect())) == want
    # a join of two bucketed tables on the user
    other = f"{name}_users"
    users = tables.replace_table(user_metrics.user_base(stored, NB), other, bucket_by=("user_id",), buckets=4)
    joined = users.hint("merge").join(stored.select("user_id", "session_id"), "user_id")
    assert "Exchange" not in plan_of(joined) and joined.count() == clean.count()
    tables.drop_table(spark, other)


def test_partitioned_tables_split_a_hot_folder(spark, name):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, 1).otherwise(F.col("id") % 3).alias("day"))
    stored = tables.replace_table(df, name, partition_by=("day",))
    part = stored.where("day = 2")
    assert "PartitionFilters: [isnotnull(day" in plan_of(part) and part.count() == df.where("day = 2").count()


# --- by day -------------------------------------------------------------------


@pytest.fixture
def by_day(spark):
    path = shared_path(spark, "by_day")
    rows = [dict(session_id=f"s{i}", user_id=i % 5, open_at=ts(f"2020-02-{1 + i % 20:02d}", i % 24)) for i in range(100)]
    files.write_sessions_by_day(session_rows(spark, [*rows, dict(session_id="none", open_at=None)]), path)
    return path


def test_a_range_of_days_reads_its_folders_alone(spark, by_day):
    some = files.read_sessions_by_day(spark, by_day, "2020-02-03", "2020-02-04")
    plan = plan_of(some)
    assert "PartitionFilters: [isnotnull(open_date" in plan and "open_date" not in plan.split("PushedFilters")[1].split("]")[0]
    assert sorted({str(r[0]) for r in some.select(F.to_date("open_at")).collect()}) == ["2020-02-03", "2020-02-04"] and some.count() == 10
    assert {f.rsplit("/", 2)[1] for r in some.select(F.input_file_name()).distinct().collect() for f in r} == {"open_date=2020-02-03", "open_date=2020-02-04"}
    assert files.read_sessions_by_day(spark, by_day).count() == 101
    assert files.read_sessions_by_day(spark, by_day, last="2020-02-01").count() == 5
    assert files.read_sessions_by_day(spark, by_day, "2021-01-01").count() == 0


def test_days_of_another_table_prune_the_scan(spark, by_day):
    path = shared_path(spark, "calendar")
    spark.sql("SELECT explode(sequence(DATE'2020-02-01', DATE'2020-02-20')) AS day").withColumn("weekday", F.weekday("day")).write.parquet(path)
    weekend = files.sessions_on(files.read_sessions_by_day(spark, by_day), spark.read.parquet(path).where("weekday >= 5").select("day"))
    assert "dynamicpruning" in plan_of(weekend)
    assert {r[0].weekday() for r in weekend.select("open_date").collect()} == {5, 6} and weekend.count() == 30


# --- views ----------------------------------------------------------------------


def test_catalog_views_in_a_fresh_session(spark):
    database = f"db_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{shared_path(spark, database)}'")
    raw = some_sessions(spark)
    tables.replace_table(raw, f"{database}.sessions_raw")
    assert views.create_views(spark, f"{database}.sessions_raw", NB, database) == [f"{database}.{v}" for v in ("sessions_clean", "user_base", "d1_retention", "user_metrics")]
    fresh = spark.newSession()
    clean = cleaning.sessions_clean(raw, NB)
    users = user_metrics.user_metrics_full(clean, NB)

    def rows(df, like):
        return sorted(map(repr, df.select(*like.columns).collect()))

    assert fresh.sql(f"SELECT * FROM {database}.sessions_clean").columns == clean.columns
    assert rows(fresh.sql(f"SELECT * FROM {database}.sessions_clean"), clean) == rows(clean, clean)
    assert rows(fresh.sql(f"SELECT * FROM {database}.user_metrics"), users) == rows(users, users)
    assert dict(fresh.table(f"{database}.user_metrics").dtypes) == dict(users.dtypes)
    # the chain follows the table under it
    tables.replace_table(raw.where("user_id < 5"), f"{database}.sessions_raw")
    fresh.sql(f"USE {database}")
    assert fresh.sql("SELECT count(*) FROM user_metrics").first()[0] == 5
    spark.sql(f"DROP DATABASE {database} CASCADE")


# --- CSV ------------------------------------------------------------------------


def test_lines_that_do_not_fit_are_rejected(spark):
    path, rejects = shared_path(spark, "csv"), shared_path(spark, "rejects")
    header = ",".join(USER_METRICS.names)
    good = '1,android,"Asia, ""far"" ",control,s,2020-02-01T10:00:00,2020-01-31T00:00:00,1.5,2,3.0,,1,0,4,1'
    empty = "2" + "," * 14
    bad = {
        "3,android": "fields",
        "4,android,x,control,s,2020-02-01T10:00:00,2020-01-31T00:00:00,1.5,2,3.0,3.0,1,0,4,1,extra": "fields",
        "five" + "," * 14: "value",
        '6,android,"Asia, far",control,s,2020-02-01T10:00:00,2020-01-31T00:00:00,much,2,3.0,3.0,1,0,4,1': "value",
        "7,a,b,c,d,yesterday,,,,,,,,,": "value",
    }
    for part, lines in enumerate(([good, *list(bad)[:3]], [empty, *list(bad)[3:]])):
        spark.createDataFrame([("\n".join([header, *lines]),)], "line string").coalesce(1).write.mode("append").text(path)
    rows, rejected = files.read_checked_csv(spark, path, rejects=rejects)
    got = {r["user_id"]: r for r in rows.collect()}
    assert set(got) == {1, 2} and rows.schema.names == USER_METRICS.names
    assert got[1]["region"] == 'Asia, "far" '
    assert got[1]["median_session_length"] is None and got[1]["returned_d1"] == 1
    assert [got[2][c] for c in USER_METRICS.names[1:]] == [None] * 14
    assert {r["line"]: r["reason"] for r in rejected.collect()} == bad
    sunk = spark.read.json(rejects)
    assert {r["line"]: r["reason"] for r in sunk.collect()} == bad and sunk.select("file").distinct().count() == 2


def test_csv_without_any_bad_line(spark):
    path = shared_path(spark, "csv")
    users = user_rows(spark, [{}, {"total_revenue": float("nan")}])
    files.write_csv(users, path)
    rows, rejected = files.read_checked_csv(spark, path)
    assert rows.count() == 2 and rejected.count() == 0
