"""User metrics kept up to date by deliveries of sessions, without a rebuild from all raw rows.

The state has two layers, cut into buckets by user: de-duplicated sessions, whose
measures are maxima and so merge with any later delivery in any order, and the user metrics
made from them. A delivery changes the buckets of the users it names: their
sessions are merged with its own and their users' metrics are made anew from that; other buckets aren't read.
Raw rows are read once, on delivery. Late and repeated deliveries give what a full rebuild gives.

A delivery writes its buckets into folders of its own and then one commit, a list of the folder
that counts for each bucket. Readers follow the newest finished commit; a delivery that was lost midway left nothing
in it, and one that is delivered again under its number is skipped.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from splitscope.operators import cleaning, user_metrics
from splitscope.session import delete_paths
from splitscope.sources.files import ingest
from splitscope.sources.schemas import SESSIONS_RAW, USER_METRICS
from splitscope.spec import ExperimentSpec, NOTEBOOK_SPEC

BUCKET = "bucket"
BUCKETS = 64


def _commits(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished commits, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/commits")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at)]
    done = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()) for p in done)


def _commit(spark: SparkSession, folder: str, number: int | None) -> dict[int, int]:
    """Of each bucket, the delivery whose folder counts (at most as many entries as buckets)."""
    if number is None:
        return {}
    return {int(k): v for k, v in json.loads(spark.read.text(f"{folder}/commits/{number}").first()[0]).items()}


def _paths(folder: str, layer: str, commit: dict[int, int], buckets) -> list[str]:
    return [f"{folder}/{layer}/{commit[b]}/{BUCKET}={b}" for b in sorted(buckets) if b in commit]


def apply_delivery(delivered: DataFrame, number: int, folder: str, spec: ExperimentSpec = NOTEBOOK_SPEC, buckets: int = BUCKETS) -> None:
    """Merge a delivery of raw sessions into the state under `folder`. Numbers rise from one delivery to the next.

    A number that was committed before is skipped, so a delivery may be repeated. Sessions
    that no cleaning would keep whatever their measures (no ids, no cohort, another segment) don't enter the state.
    `buckets` is fixed when the state is begun; a bucket should fit a few tasks.
    """
    spark = delivered.sparkSession
    done = _commits(spark, folder)
    if done and number <= done[-1]:
        return
    commit = _commit(spark, folder, done[-1] if done else None)
    cohort = F.col(spec.cohort_col)
    kept = delivered.where(
        F.col(spec.user_col).isNotNull() & F.col(spec.session_col).isNotNull() & cohort.isNotNull() & (cohort != "nan") & F.col(spec.segment_col).isin(*spec.kept_segments)
    )
    bucket = F.pmod(F.hash(F.col(spec.user_col)), F.lit(buckets))
    # written first: the buckets it names, and what is merged, come from the same rows
    fresh_path = f"{folder}/delivered/{number}"
    first = _merged(kept, spec)
    schema = first.schema
    first.write.mode("overwrite").parquet(fresh_path)
    fresh = spark.read.schema(schema).parquet(fresh_path)
    touched = [r[0] for r in fresh.select(bucket).distinct().collect()]
    held = _paths(folder, "sessions", commit, touched)
    merged = _merged(fresh.unionByName(spark.read.schema(schema).parquet(*held)), spec) if held else fresh
    _write(merged.withColumn(BUCKET, bucket), f"{folder}/sessions/{number}")
    new = {**commit, **{b: number for b in touched}}
    if touched:
        sessions = spark.read.schema(schema).parquet(*_paths(folder, "sessions", new, touched))
        users = user_metrics.user_metrics_full(cleaning.sessions_clean(sessions, spec), spec)
        _write(users.withColumn(BUCKET, bucket), f"{folder}/users/{number}")
    line = spark.createDataFrame([(json.dumps({str(k): v for k, v in new.items()}),)], "commit string")
    line.coalesce(1).write.mode("overwrite").text(f"{folder}/commits/{number}")
    delete_paths(spark, fresh_path)


def _merged(sessions: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """One row for each combination of keys, each measure its maximum: the same whether merged at once or bit by bit."""
    return sessions.groupBy(*spec.session_keys).agg(*[F.max(raw).alias(raw) for _, raw in spec.session_measures])


def _write(df: DataFrame, path: str) -> None:
    """One folder a bucket; a bucket with many rows is split over tasks."""
    df.hint("rebalance", F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read_user_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The user metrics as of the newest finished delivery."""
    done = _commits(spark, folder)
    commit = _commit(spark, folder, done[-1] if done else None)
    # a bucket whose sessions are all invalid has no users, and no folder of them
    paths = _existing(spark, _paths(folder, "users", commit, commit))
    return spark.read.schema(USER_METRICS).parquet(*paths) if paths else spark.createDataFrame([], USER_METRICS)


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return [p for p, a in zip(paths, at, strict=True) if a.getFileSystem(conf).exists(a)]


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Delete commits but for the newest `keep`, and the buckets that none of these lists."""
    done = _commits(spark, folder)
    listed = {(b, n) for c in done[-keep:] for b, n in _commit(spark, folder, c).items()}
    known = {(b, n) for c in done[:-keep] for b, n in _commit(spark, folder, c).items()}
    delete_paths(spark, *[f"{folder}/{layer}/{n}/{BUCKET}={b}" for b, n in sorted(known - listed) for layer in ("sessions", "users")])
    delete_paths(spark, *[f"{folder}/commits/{c}" for c in done[:-keep]])


def follow_sessions(spark: SparkSession, source_dir: str, folder: str, checkpoint_location: str, spec: ExperimentSpec = NOTEBOOK_SPEC,
                    buckets: int = BUCKETS, fmt: str = "parquet", files_a_delivery: int | None = None, available_now: bool = True,
                    processing_time: str | None = None) -> StreamingQuery:
    """Start a stream that applies the session files of `source_dir` to the state under `folder`, each delivery once.

    A restart with the same `checkpoint_location` repeats at most the delivery that
    was under way, under its number. `available_now` takes what is there and stops.
    """
    reader = spark.readStream.schema(SESSIONS_RAW).format(fmt)
    if files_a_delivery:
        reader = reader.option("maxFilesPerTrigger", files_a_delivery)
    writer = ingest(reader.load(source_dir)).writeStream.option("checkpointLocation", checkpoint_location).foreachBatch(
        lambda delivered, number: apply_delivery(delivered, number, folder, spec, buckets)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
