"""Catalog tables replaced as a whole (CREATE OR REPLACE TABLE), bucketed or partitioned.

A replacement is staged as a table of its own under a new folder and swapped in by one
change of the catalog: the name is a view of the version that counts. Until the swap readers
see the old rows, after it the new ones; a plan made before it still finds
its files, as the version before is kept. A failed or lost write leaves the old version in place.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitscope.session import delete_paths, ensure_checkpoint_dir

_MARK = "__v"


def _split(name: str) -> tuple[str, str]:
    """(prefix with its dot, table) of a name that may state its database."""
    database, dot, table = name.rpartition(".")
    return database + dot, table


def versions(spark: SparkSession, name: str) -> list[str]:
    """The staged tables of a name, oldest first; the one that counts is the newest that was swapped in."""
    prefix, table = _split(name)
    shown = spark.sql("SHOW TABLES" + (f" IN {prefix[:-1]}" if prefix else "") + f" LIKE '{table}{_MARK}*'")
    return sorted(prefix + r["tableName"] for r in shown.collect())


def replace_table(df: DataFrame, name: str, location: str | None = None, bucket_by: Sequence[str] = (),
                  buckets: int | None = None, partition_by: Sequence[str] = (), keep: int = 1) -> DataFrame:
    """Replace the catalog table `name` by the rows of df; returns it read through its name.

    `bucket_by` with `buckets` deals the rows by the keys once, here: later joins and
    aggregates on them need no shuffle. Meant for tables with many rows a key at most
    as large as a bucket may be (user tables; sessions where no user has a large share of them).
    `partition_by` makes folders that filters on these columns prune; tasks write only the folders of the
    rows they are dealt, and a folder with many rows is split over several.
    `location`: folder of the versions, by default in the shared checkpoint folder. `keep` older versions stay for readers that
    planned on them; earlier ones, and stages that were never swapped in, are dropped.
    """
    spark = df.sparkSession
    base = (location or f"{ensure_checkpoint_dir(spark).rstrip('/')}/splitscope-tables").rstrip("/")
    prefix, table = _split(name)
    # versions sort by time; the rest keeps two writers apart
    staged = f"{prefix}{table}{_MARK}{time.time_ns():020d}_{uuid.uuid4().hex[:8]}"
    if bucket_by:
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        # dealt as the buckets are, so each task writes one file
        writer = df.repartition(n, *bucket_by).write.bucketBy(n, *bucket_by).sortBy(*bucket_by)
    elif partition_by:
        writer = df.hint("rebalance", *[F.col(c) for c in partition_by]).write
    else:
        writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format("parquet").option("path", f"{base}/{staged}").saveAsTable(staged)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {staged}")
    drop_versions(spark, name, base, keep + 1)
    return spark.table(name)


def drop_versions(spark: SparkSession, name: str, location: str, keep: int) -> None:
    """Drop all but the `keep` newest versions, files included."""
    for old in versions(spark, name)[:-keep]:
        spark.sql(f"DROP TABLE IF EXISTS {old}")
        delete_paths(spark, f"{location.rstrip('/')}/{old}")


def drop_table(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Drop the name and all its versions."""
    base = (location or f"{ensure_checkpoint_dir(spark).rstrip('/')}/splitscope-tables").rstrip("/")
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    for old in versions(spark, name):
        spark.sql(f"DROP TABLE IF EXISTS {old}")
        delete_paths(spark, f"{base}/{old}")
