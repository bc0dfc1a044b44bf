"""Session-level experiment tables derived from the shared test tables.

An order is a session, its line items are natural duplicates of it (same 10
keys, different measures) and a customer is a user. The defects the quality
checks look for (NULL users, invalid and NaN lengths, negative and NaN revenue, NULL
and 'nan' cohorts, users in two cohorts, other segments, unmapped countries) are planted by integer rules, so Spark and the
SQL oracle derive identical rows. Every derivation reads the whole tables.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitscope.functions.regions import region_of
from splitscope.sources.files import ingest

DEFAULT_SF_DIR = "/root/testdata/sf0.01"

# Fixed values of the projection rules (FIXTURES.md section 3).
COUNTRY_BY_RESIDUE = ("US", "CA", "FR", "DE", "BR", "MX", "IN", "JP", "AE", "ZA", "GB", "ZZ", None)
COHORT_BY_RESIDUE = ("control", "xxHigh", "xHigh", "gameTune", "xLow", "xxLow")
EXPERIMENT_START = "2020-02-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _pick(index: Column, values) -> Column:
    """values[index] for a small integer residue: a lookup into a constant-folded array."""
    arr = F.array(*[F.lit(v) if v is not None else F.lit(None).cast("string") for v in values])
    return F.element_at(arr, (index + 1).cast("int"))


def sessions_raw(spark: SparkSession, sf_dir: str = DEFAULT_SF_DIR) -> DataFrame:
    """The raw session table (schema `SESSIONS_RAW`) over the whole test tables.

    Join order: orders (1/4 of lineitem) meets customer and nation first, so the
    only wide shuffle of lineitem is the one on the order key.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey")
    cust_nation = cust.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey, "inner")  # 25 rows
    ocn = orders.join(cust_nation, orders.o_custkey == cust_nation.c_custkey, "inner")
    # The order-key join is a shuffle (sort-merge) join at any scale where both
    # sides are large; the hint keeps that plan on small inputs too, so the
    # per-row projection and the partial dedupe aggregate run in parallel even
    # when lineitem arrives as a single row group.
    j = li.join(ocn.hint("merge"), li.l_orderkey == ocn.o_orderkey, "inner")

    ck = F.col("o_custkey")
    ok = F.col("l_orderkey")
    pk = F.col("l_partkey")
    # cohort by residue of the customer key; NULL and 'nan' planted first
    null_cohort = ck % 83 == 0
    nan_cohort = ~null_cohort & (ck % 89 == 0)
    real = ~null_cohort & ~nan_cohort
    # some users change to the next cohort in every other session
    residue = F.when((ck % 29 == 0) & (ok % 2 == 1), (ck + 1) % 6).otherwise(ck % 6)
    is_xx_high = real & (residue == 1)
    is_x_high = real & (residue == 2)
    cohort = (
        F.when(null_cohort, F.lit(None).cast("string"))
        .when(nan_cohort, F.lit("nan"))
        .otherwise(_pick(residue, COHORT_BY_RESIDUE))
    )
    platform = F.when(F.expr("(o_custkey div 6) % 2") == 0, F.lit("android")).otherwise(F.lit("ios"))
    start = F.lit(EXPERIMENT_START).cast("date")
    length = (
        F.when(pk % 53 == 0, F.lit(None).cast("double"))
        .when(pk % 41 == 0, F.lit(0.0))
        .when(pk % 67 == 0, F.lit(-1.0))
        .when(pk % 59 == 0, F.lit(float("nan")))
        .when(is_xx_high, F.col("l_quantity") * F.lit(0.85))
        .otherwise(F.col("l_quantity"))
    )
    base_rev = F.col("l_extendedprice") * F.col("l_discount") / F.lit(1000.0)
    revenue = (
        F.when(pk % 61 == 0, F.lit(float("nan")))
        .when(pk % 71 == 0, F.lit(0.0) - base_rev)
        .when(is_xx_high, base_rev * F.lit(1.30)).when(is_x_high, base_rev * F.lit(1.25)).otherwise(base_rev)
    )
    return (
        j.select(
            ok.cast("string").alias("session_id"),
            F.when(ok % 97 == 0, F.lit(None).cast("bigint")).otherwise(ck).cast("bigint").alias("user_id"),
            platform.alias("platform"),
            _pick(F.col("n_nationkey") % 13, COUNTRY_BY_RESIDUE).alias("country"),
            # a session opens at some second of its day
            F.timestamp_add(
                "SECOND", (ok * 37 + ck) % 86400, F.date_add(start, ((ok * 5 + ck) % 28).cast("int")).cast("timestamp_ntz")
            ).alias("open_at"),
            F.date_sub(start, (ck % 7).cast("int")).cast("timestamp_ntz").alias("acquired_at"),
            F.lit("ad_frequency").alias("ab_name"),
            cohort.alias("ab_cohort_name"),
            F.when(ck % 11 == 0, F.lit("existing_users"))
            .otherwise(F.concat(platform, F.lit("_new_users")))
            .alias("segment_name"),
            (ok % 10 + 1).cast("int").alias("session_number_"),
            length.alias("session_length"),
            revenue.alias("publisher_revenue"),
            F.col("l_linenumber").cast("bigint").alias("fs_shown"),
            (F.col("l_linenumber") % 3).cast("bigint").alias("rv_shown"),
            (F.col("l_suppkey") % 10).cast("bigint").alias("game_count"),
            (pk % 5).cast("bigint").alias("offline_game_count"),
        )
        .select(
            "session_id", "user_id", "platform", "country", "open_at", "acquired_at", "ab_name",
            "ab_cohort_name", "segment_name", "session_number_", "session_length", "publisher_revenue",
            "fs_shown", "rv_shown", "game_count", "offline_game_count",
        )
    )


def template_sessions(spark: SparkSession, sf_dir: str = DEFAULT_SF_DIR) -> DataFrame:
    """The template's input schema: region already present, other column names."""
    raw = ingest(sessions_raw(spark, sf_dir))
    return raw.select(
        "user_id",
        "session_id",
        F.col("ab_cohort_name").alias("cohort_name"),
        "platform",
        region_of("country").alias("region"),
        "session_length",
        F.col("publisher_revenue").alias("revenue"),
        F.col("session_number_").alias("session_number"),
        F.col("open_at").alias("created_at"),
    )


def sessions_from_events(spark: SparkSession, sf_dir: str = DEFAULT_SF_DIR) -> DataFrame:
    """A second, duplicate-free session source: one `events` row is one session.

    Cohort, platform and country are residues of the user id (as above), the
    length is the event value, revenue is the value of purchase events.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    uid = F.col("user_id")
    platform = F.when(F.expr("(user_id div 6) % 2") == 0, F.lit("android")).otherwise(F.lit("ios"))
    etype = F.col("event_type")
    return ev.select(
        F.col("event_id").cast("string").alias("session_id"),
        uid.cast("bigint").alias("user_id"),
        platform.alias("platform"),
        _pick(uid % 13, COUNTRY_BY_RESIDUE).alias("country"),
        F.col("ts").cast("timestamp_ntz").alias("open_at"),
        F.to_date("ts").cast("timestamp_ntz").alias("acquired_at"),
        F.lit("ad_frequency").alias("ab_name"),
        _pick(uid % 6, COHORT_BY_RESIDUE).alias("ab_cohort_name"),
        F.concat(platform, F.lit("_new_users")).alias("segment_name"),
        F.lit(1).cast("int").alias("session_number_"),
        F.col("value").cast("double").alias("session_length"),
        F.when(etype == "purchase", F.col("value")).otherwise(F.lit(0.0)).alias("publisher_revenue"),
        (etype == "view").cast("bigint").alias("fs_shown"),
        (etype == "click").cast("bigint").alias("rv_shown"),
        F.lit(1).cast("bigint").alias("game_count"),
        F.lit(0).cast("bigint").alias("offline_game_count"),
    )
