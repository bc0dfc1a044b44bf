"""Builders of small literal session/user tables for the edge-case tests."""

from __future__ import annotations

import datetime as dt

from splitscope.sources.schemas import SESSIONS_RAW, USER_METRICS


def ts(day: str, hour: int = 12) -> dt.datetime:
    d = dt.date.fromisoformat(day)
    return dt.datetime(d.year, d.month, d.day, hour)


def session_rows(spark, rows):
    """rows: dicts with any SESSIONS_RAW fields; the rest get valid defaults."""
    defaults = dict(
        session_id="s1", user_id=1, platform="android", country="US", open_at=ts("2020-02-01"),
        acquired_at=ts("2020-01-31"), ab_name="ad_frequency", ab_cohort_name="control",
        segment_name="android_new_users", session_number_=1, session_length=10.0, publisher_revenue=1.0,
        fs_shown=1, rv_shown=0, game_count=1, offline_game_count=0,
    )
    data = []
    for r in rows:
        d = dict(defaults)
        d.update(r)
        data.append(tuple(d[f.name] for f in SESSIONS_RAW.fields))
    return spark.createDataFrame(data, SESSIONS_RAW)


def user_rows(spark, rows):
    defaults = dict(
        user_id=1, platform="android", region="Europe", ab_cohort_name="control", segment_name="android_new_users",
        first_session_at=ts("2020-02-01"), acquired_at=ts("2020-01-31"), total_revenue=1.0, total_sessions=1,
        avg_session_length=10.0, median_session_length=10.0, total_fs_shown=1, total_rv_shown=0,
        total_activity_count=1, returned_d1=0,
    )
    data = []
    for i, r in enumerate(rows):
        d = dict(defaults)
        d["user_id"] = i + 1
        d.update(r)
        data.append(tuple(d[f.name] for f in USER_METRICS.fields))
    return spark.createDataFrame(data, USER_METRICS)
