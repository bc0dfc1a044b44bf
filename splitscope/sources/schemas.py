"""Explicit schemas of the session and user-level tables (no inference at scale)."""

from pyspark.sql import types as T

SESSION_KEYS = (
    "session_id", "user_id", "platform", "country", "open_at", "acquired_at",
    "ab_name", "ab_cohort_name", "segment_name", "session_number_",
)

SESSIONS_RAW = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("platform", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("open_at", T.TimestampNTZType()),
    T.StructField("acquired_at", T.TimestampNTZType()),
    T.StructField("ab_name", T.StringType()),
    T.StructField("ab_cohort_name", T.StringType()),
    T.StructField("segment_name", T.StringType()),
    T.StructField("session_number_", T.IntegerType()),
    T.StructField("session_length", T.DoubleType()),
    T.StructField("publisher_revenue", T.DoubleType()),
    T.StructField("fs_shown", T.LongType()),
    T.StructField("rv_shown", T.LongType()),
    T.StructField("game_count", T.LongType()),
    T.StructField("offline_game_count", T.LongType()),
])

USER_METRICS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("platform", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("ab_cohort_name", T.StringType()),
    T.StructField("segment_name", T.StringType()),
    T.StructField("first_session_at", T.TimestampNTZType()),
    T.StructField("acquired_at", T.TimestampNTZType()),
    T.StructField("total_revenue", T.DoubleType()),
    T.StructField("total_sessions", T.LongType()),
    T.StructField("avg_session_length", T.DoubleType()),
    T.StructField("median_session_length", T.DoubleType()),
    T.StructField("total_fs_shown", T.LongType()),
    T.StructField("total_rv_shown", T.LongType()),
    T.StructField("total_activity_count", T.LongType()),
    T.StructField("returned_d1", T.IntegerType()),
])
