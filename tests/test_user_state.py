"""User metrics from deliveries equal a rebuild from all rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from splitscope.operators import cleaning, user_metrics
from splitscope.session import shared_path
from splitscope.sources.schemas import SESSIONS_RAW
from splitscope.spec import NOTEBOOK_SPEC as NB
from splitscope.streaming import user_state
from tests.helpers import session_rows, ts


def rows_of(seed, n=120):
    r = random.Random(seed)
    return [
        dict(session_id=f"s{r.randrange(150)}", user_id=r.choice([None, *range(12)]), open_at=ts(f"2020-02-{r.randint(1, 12):02d}"), session_number_=r.randint(1, 2),
             session_length=r.choice([None, 0.0, -1.0, 4.0, 8.5, 21.25]), publisher_revenue=r.randint(0, 64) / 16, country=r.choice(["US", "FR", "ZZ", None]),
             ab_cohort_name=r.choice(["control", "xxHigh", "nan", None]), segment_name=r.choice(["android_new_users", "ios_new_users", "existing_users"]), fs_shown=r.choice([None, 1, 5]))
        for _ in range(n)
    ]


def rebuilt(spark, rows):
    return sorted(map(repr, user_metrics.user_metrics_full(cleaning.sessions_clean(session_rows(spark, rows), NB), NB).collect()))


def state(spark, folder):
    return sorted(map(repr, user_state.read_user_metrics(spark, folder).collect()))


def test_three_deliveries_one_late_equal_a_rebuild(spark):
    folder = shared_path(spark, "state")
    first, second = rows_of(1), rows_of(2)
    # late: an earlier day for users known by then, and a longer measure of a session that was delivered before
    late = [dict(r, open_at=ts("2020-01-30"), session_id="late" + r["session_id"]) for r in first[:30]] + [dict(r, session_length=99.0) for r in first[30:50]]
    seen = []
    for number, rows in enumerate((first, second, late)):
        user_state.apply_delivery(session_rows(spark, rows), number, folder, NB, buckets=4)
        seen += rows
        assert state(spark, folder) == rebuilt(spark, seen)
    # in another order, and with rows delivered twice
    again = shared_path(spark, "state")
    for number, rows in enumerate((late, second + first, first)):
        user_state.apply_delivery(session_rows(spark, rows), number, again, NB, buckets=4)
    assert state(spark, again) == rebuilt(spark, seen)


def test_a_delivery_is_applied_once(spark):
    folder = shared_path(spark, "state")
    user_state.apply_delivery(session_rows(spark, rows_of(1)), 0, folder, NB, buckets=4)
    user_state.apply_delivery(session_rows(spark, rows_of(2)), 0, folder, NB, buckets=4)
    assert state(spark, folder) == rebuilt(spark, rows_of(1))


def test_a_delivery_lost_midway_leaves_the_state(spark, monkeypatch):
    folder = shared_path(spark, "state")
    user_state.apply_delivery(session_rows(spark, rows_of(1)), 0, folder, NB, buckets=4)
    write = user_state._write
    monkeypatch.setattr(user_state, "_write", lambda df, path: write(df, path) if "/sessions/" in path else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        user_state.apply_delivery(session_rows(spark, rows_of(2)), 1, folder, NB, buckets=4)
    assert state(spark, folder) == rebuilt(spark, rows_of(1))
    monkeypatch.undo()
    user_state.apply_delivery(session_rows(spark, rows_of(2)), 1, folder, NB, buckets=4)
    assert state(spark, folder) == rebuilt(spark, rows_of(1) + rows_of(2))


def test_only_buckets_with_new_users_are_written(spark):
    folder = shared_path(spark, "state")
    many = [dict(session_id=f"s{i}", user_id=i) for i in range(100)]
    user_state.apply_delivery(session_rows(spark, many), 0, folder, NB, buckets=16)
    one = [dict(session_id="new", user_id=7, publisher_revenue=5.0)]
    user_state.apply_delivery(session_rows(spark, one), 1, folder, NB, buckets=16)
    local = folder.removeprefix("file:")
    for layer in ("sessions", "users"):
        assert len([d for d in os.listdir(f"{local}/{layer}/0") if d.startswith("bucket=")]) == 16
        assert len([d for d in os.listdir(f"{local}/{layer}/1") if d.startswith("bucket=")]) == 1
    assert state(spark, folder) == rebuilt(spark, many + one)
    user_state.vacuum(spark, folder, keep=1)
    assert state(spark, folder) == rebuilt(spark, many + one)
    assert len([d for d in os.listdir(f"{local}/users/0") if d.startswith("bucket=")]) == 15 and os.listdir(f"{local}/commits") == ["1"]


def test_deliveries_without_valid_sessions(spark):
    folder = shared_path(spark, "state")
    assert state(spark, folder) == []
    user_state.apply_delivery(session_rows(spark, []), 0, folder, NB)
    user_state.apply_delivery(session_rows(spark, [dict(user_id=None), dict(session_length=0.0)]), 1, folder, NB)
    assert state(spark, folder) == []
    user_state.apply_delivery(session_rows(spark, [dict(session_length=3.0)]), 2, folder, NB)
    assert state(spark, folder) == rebuilt(spark, [dict(session_length=3.0)])


def test_a_stream_of_files(spark):
    source, folder, checkpoint = (shared_path(spark, x) for x in ("files", "state", "stream"))
    seen = []
    for number in range(3):
        session_rows(spark, rows_of(number, 60)).coalesce(1).withColumn("publisher_revenue", F.nanvl("publisher_revenue", F.lit(0.0))).select(*SESSIONS_RAW.names).write.mode("append").parquet(source)
        seen += rows_of(number, 60)
        if number != 1:  # the second and third files come to one run, a delivery each
            user_state.follow_sessions(spark, source, folder, checkpoint, NB, buckets=4, files_a_delivery=1).awaitTermination()
            assert state(spark, folder) == rebuilt(spark, seen)
    assert user_state._commits(spark, folder) == [0, 1, 2]
    user_state.follow_sessions(spark, source, folder, checkpoint, NB, buckets=4, files_a_delivery=1).awaitTermination()
    assert user_state._commits(spark, folder) == [0, 1, 2] and state(spark, folder) == rebuilt(spark, seen)
