"""Append new session files to the raw session table, exactly once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from splitscope.sources.schemas import SESSIONS_RAW
from splitscope.sources.files import ingest


def land_sessions(spark: SparkSession, source_dir: str, table_dir: str, checkpoint_location: str,
                  fmt: str = "parquet", available_now: bool = True,
                  processing_time: str | None = None) -> StreamingQuery:
    """Start a stream from `source_dir` (explicit schema, NaN -> NULL) into the parquet table `table_dir`.

    The file source and the file sink commit through the checkpoint, so a
    run restarted with the same `checkpoint_location` (one for each stream, on shared
    storage) appends each input file once. `available_now`
    processes what is there and stops; otherwise it runs on `processing_time`.
    """
    stream = ingest(spark.readStream.schema(SESSIONS_RAW).format(fmt).load(source_dir))
    writer = (
        stream.writeStream.format("parquet")
        .option("path", table_dir)
        .option("checkpointLocation", checkpoint_location)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
