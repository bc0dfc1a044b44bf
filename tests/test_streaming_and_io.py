import os
import tempfile

from pyspark.sql import functions as F

from splitscope.operators import reports
from splitscope.plans import pipeline
from splitscope.sources import files
from splitscope.sources.testdata import sessions_raw
from splitscope.streaming import land_sessions

SF = "/root/testdata/sf0.001"


def test_land_sessions_appends_each_file_once(spark):
    work = tempfile.mkdtemp(prefix="splitscope-stream-", dir="/tmp")
    src, table, ckpt = (os.path.join(work, d) for d in ("src", "table", "ckpt"))
    raw = sessions_raw(spark, SF)  # holds NaN, which landing turns into NULL
    raw.where(F.col("session_number_") <= 5).write.parquet(os.path.join(src, "batch1"))
    q = land_sessions(spark, src + "/*", table, ckpt)
    q.awaitTermination()
    raw.where(F.col("session_number_") > 5).write.parquet(os.path.join(src, "batch2"))
    q = land_sessions(spark, src + "/*", table, ckpt)  # restart: only the new files
    q.awaitTermination()
    landed = spark.read.parquet(table)
    assert landed.count() == raw.count()
    assert landed.exceptAll(files.ingest(raw)).count() == 0
    assert raw.where("isnan(session_length)").count() > 0 and landed.where("isnan(session_length) OR isnan(publisher_revenue)").count() == 0


def test_user_metrics_csv_and_table_round_trip(spark):
    work = tempfile.mkdtemp(prefix="splitscope-io-", dir="/tmp")
    users = pipeline.user_metrics_table(spark, SF)
    files.write_csv(users, os.path.join(work, "csv"))
    back = files.read_user_metrics_csv(spark, os.path.join(work, "csv"))
    assert back.count() == users.count()
    assert back.select("user_id", "returned_d1").exceptAll(users.select("user_id", "returned_d1")).count() == 0
    files.write_table(users, os.path.join(work, "table"), partition_by=("platform",))
    assert spark.read.parquet(os.path.join(work, "table")).count() == users.count()


def test_exports_write_one_directory_each(spark):
    work = tempfile.mkdtemp(prefix="splitscope-exp-", dir="/tmp")
    df = spark.range(3).withColumn("x", F.col("id") * 2)
    paths = reports.write_exports({"a": df, "b": df}, work)
    assert [os.path.basename(p) for p in paths] == ["a", "b"]
    assert spark.read.option("header", True).csv(paths[0]).count() == 3


def test_nine_exports_read_back_as_written(spark):
    from splitscope.plans import pipeline
    from splitscope.session import shared_path

    tests = pipeline.notebook_tests(spark, "/root/testdata/sf0.01", materialized=True)
    tables, out_dir = reports.export_tables(tests), shared_path(spark, "exports")
    reports.write_exports(tables, out_dir)
    back = reports.read_exports(tables, out_dir)
    assert len(back) == 9
    for name, df in tables.items():
        # CSV holds an empty text as it holds none
        want = sorted(repr(tuple(x or None if isinstance(x, str) else x for x in r)) for r in df.collect())
        assert sorted(repr(tuple(r)) for r in back[name].collect()) == want, name
        assert back[name].schema.simpleString() == df.schema.simpleString()


def test_entry_smoke(spark):
    import __spark_entry__ as E

    out = E.entry(spark)
    rows = out.collect()
    assert len(rows) > 0
    assert out.columns[:3] == ["platform", "ab_cohort_name", "total_users"]


def test_cluster_conf_sizes_partitions_to_the_input():
    from splitscope.session import cluster_conf

    conf = cluster_conf(100 * 2 ** 40, total_cores=8000)  # 100 TB on 1000 executors x 8 cores
    parts = int(conf["spark.sql.shuffle.partitions"])
    assert parts % 8000 == 0 and parts * (256 << 20) >= 100 * 2 ** 40
    assert conf["spark.sql.adaptive.enabled"] == "true"
    assert conf["spark.sql.files.maxPartitionBytes"] == str(256 << 20)


def test_no_task_holds_a_whole_group_of_distinct_values(spark):
    """One group of two million distinct values: its prefix sums come from even pieces."""
    from splitscope.operators.quantiles import value_ranks

    n = 2_000_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(n).select(F.lit("g").alias("g"), (F.col("id") * 7919 % n).cast("double").alias("v"))
        ranks = value_ranks(df, ["g"], "v")
        # within the group the running count of a value is the value itself
        assert ranks.where("before__f != v OR total__f != 2000000").count() == 0
        sizes = [r["count"] for r in ranks.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < n // 2


def test_rounded_means_keep_infinities_and_signs(spark):
    from splitscope.functions.columns import round_half_up, rounded_avg

    df = spark.createDataFrame([(1.0, 4e-7, -0.1234565), (float("inf"), 4e-7, -0.1234565)], "a double, b double, c double")
    r = df.agg(rounded_avg("a", 2).alias("a"), rounded_avg("b", 8).alias("b"), rounded_avg("c", 6).alias("c"), round_half_up(F.lit(27.455), 2).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (float("inf"), 4e-7, -0.123457, 27.46)


def test_run_concurrently_keeps_argument_order(spark):
    from splitscope.plans.pipeline import run_concurrently

    out = run_concurrently(*[(lambda k=k: spark.range(k + 1).count()) for k in range(5)], max_workers=3)
    assert out == [1, 2, 3, 4, 5]
