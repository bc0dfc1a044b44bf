"""File readers and result sinks (CSV exports, parquet tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitscope.functions.columns import nan_to_null
from splitscope.session import materialize
from splitscope.sources.schemas import SESSIONS_RAW, USER_METRICS


def ingest(raw: DataFrame) -> DataFrame:
    """NaN -> NULL on the measures (ledger rule 1); every pipeline starts here."""
    return raw.withColumn("session_length", nan_to_null("session_length")).withColumn(
        "publisher_revenue", nan_to_null("publisher_revenue")
    )


def read_sessions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Session table with its explicit schema, NaN as NULL; filters and projections push into the scan."""
    return ingest(spark.read.schema(SESSIONS_RAW).format(fmt).load(path))


#: Folder column of the layout by day.
DAY = "open_date"


def write_sessions_by_day(raw: DataFrame, path: str) -> None:
    """Session table in one folder a calendar day (`open_date`), so that a range of days reads those folders alone.

    Rows are dealt by day and large days are split over tasks, so a day
    that holds a third of all sessions isn't written by one task. Sessions without a time stand in a folder of their own.
    """
    dated = raw.withColumn(DAY, F.to_date("open_at"))
    dated.hint("rebalance", F.col(DAY)).write.mode("overwrite").partitionBy(DAY).parquet(path)


def read_sessions_by_day(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Sessions of the days `first` to `last` (both included, each optional) with their `open_date`.

    The bounds are filters on the folder column: other days' folders aren't read.
    With a bound, sessions without a time leave.
    """
    out = ingest(spark.read.schema(T.StructType([*SESSIONS_RAW, T.StructField(DAY, T.DateType())])).parquet(path))
    if first is not None:
        out = out.where(F.col(DAY) >= F.lit(first).cast("date"))
    if last is not None:
        out = out.where(F.col(DAY) <= F.lit(last).cast("date"))
    return out


def sessions_on(by_day: DataFrame, days: DataFrame, day_col: str = "day") -> DataFrame:
    """Sessions of the days that another table names (a calendar, say), each day once.

    A join on the folder column: where `days` is the result of a filter that compares a column, Spark
    reads the days first and prunes the folders by them while it runs.
    """
    return by_day.join(days, by_day[DAY] == days[day_col], "left_semi")


def read_user_metrics_csv(spark: SparkSession, path: str, schema: T.StructType = USER_METRICS) -> DataFrame:
    """User-level CSV with a header; typed by an explicit schema instead of inference."""
    return spark.read.schema(schema).option("header", True).option("nanValue", "nan").csv(path)


#: Column with the text of a line that doesn't fit the schema.
BAD_LINE = "_corrupt_record"


def read_checked_csv(spark: SparkSession, path: str, schema: T.StructType = USER_METRICS, header: bool = True,
                     rejects: str | None = None) -> tuple[DataFrame, DataFrame]:
    """CSV rows that fit the schema, and the rejected lines: (line, reason, file).

    A line is rejected if it has another number of fields than the schema (reason `fields`), or a
    value that isn't of its column's type (`value`); none of its values reach the good rows.
    Empty fields are NULL; a quote within a quoted field is doubled. The files are parsed once into a table in the shared folder, which both
    results are read from. `rejects` names a folder that the rejected lines are written to as well, as JSON lines, for a later
    delivery; it is replaced.
    """
    checked = T.StructType([*schema, T.StructField(BAD_LINE, T.StringType())])
    read = spark.read.schema(checked).option("header", header).option("nanValue", "nan").option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_LINE)
    parsed = materialize(read.csv(path).withColumn("_file", F.input_file_name()), "csv")
    good = parsed.where(F.col(BAD_LINE).isNull()).select(*schema.names)
    # separators within quotes don't count; a doubled quote within a quoted field is passed over as well
    bare = F.regexp_replace(BAD_LINE, '"([^"]|"")*"', "")
    reason = F.when(F.size(F.split(bare, ",", -1)) == len(schema), "value").otherwise("fields")
    bad = parsed.where(F.col(BAD_LINE).isNotNull()).select(F.col(BAD_LINE).alias("line"), reason.alias("reason"), F.col("_file").alias("file"))
    if rejects:
        bad.write.mode("overwrite").json(rejects)
    return good, bad


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One export directory per table, header row, no index column."""
    df.write.mode(mode).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    """Materialised table (CREATE OR REPLACE TABLE) as parquet."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
