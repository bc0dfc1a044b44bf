"""Mergeable sketches, stored at the grain of a day and united on read.

Exact distinct users and exact quantiles need all sessions for every report. A
sketch of each (day, dimensions) cell is built once, from one scan; any report over any days is then
a union of cells. Sizes are fixed: a cell is some kB however many sessions it holds.
The errors are stated; the exact operators (`profiling`, `eda`) stay beside.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitscope.spec import ExperimentSpec, NOTEBOOK_SPEC

#: Size of a quantile sketch (KLL) and binary logarithm of the registers of a distinct-count sketch (HLL).
KLL_K, HLL_LG = 800, 14


def rank_error(k: int = KLL_K) -> float:
    """Largest difference, as a share of all values, between the rank asked for and that of the value returned (confidence 99 %)."""
    return 2.296 / k**0.9021


def count_error(lg: int = HLL_LG, deviations: float = 3.0) -> float:
    """Relative error of a distinct count: so many standard deviations of the sketch."""
    return deviations * 1.04 / 2 ** (lg / 2)


def _day(spec: ExperimentSpec) -> Column:
    return F.to_date(F.col(spec.time_col)).alias("day")


# --- quantiles ----------------------------------------------------------------


def value_sketches(sessions: DataFrame, spec: ExperimentSpec = NOTEBOOK_SPEC, value_col: str | None = None, k: int = KLL_K) -> DataFrame:
    """(day, cohort, n, sketch): a KLL sketch of a measure (by default the length) for each day and cohort. NULLs are ignored.

    The aggregate is partial: a hot cohort or day is sketched where its rows are, and sketches are merged.
    """
    value = F.col(value_col or spec.length_col)
    return sessions.where(value.isNotNull()).groupBy(_day(spec), F.col(spec.cohort_col)).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch")
    )


def sketched_quantiles(sketches: DataFrame, group_cols: Sequence[str], qs: Mapping[str, float], k: int = KLL_K) -> DataFrame:
    """Quantiles of any union of cells: group_cols, the exact `n`, and a column for each entry of `qs`, within `rank_error(k)`."""
    united = sketches.groupBy(*group_cols).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("_s"))
    return united.select(*group_cols, "n", *[F.kll_sketch_get_quantile_double("_s", F.lit(float(q))).alias(name) for name, q in qs.items()])


def rank_check(sessions: DataFrame, limits: DataFrame, group_cols: Sequence[str], value_col: str, qs: Mapping[str, float], error: float) -> DataFrame:
    """group_cols, n, and for each entry of `qs` whether the exact rank of its value is within `error` of the rank asked for.

    Values found more than once take a range of ranks; the nearest one counts.
    """
    v = F.col(value_col)
    joined = sessions.where(v.isNotNull()).select(*group_cols, v).join(limits.drop("n"), list(group_cols))
    sums = [F.count(F.lit(1)).alias("n")]
    for name in qs:
        sums += [F.count_if(v < F.col(name)).alias(f"_below_{name}"), F.count_if(v <= F.col(name)).alias(f"_upto_{name}")]
    out = joined.groupBy(*group_cols).agg(*sums)
    within = [
        ((F.col(f"_below_{name}") <= (q + error) * F.col("n")) & (F.col(f"_upto_{name}") >= (q - error) * F.col("n"))).alias(f"{name}_within")
        for name, q in qs.items()
    ]
    return out.select(*group_cols, "n", *within)


# --- distinct users -----------------------------------------------------------


def user_sketches(sessions: DataFrame, dims: Sequence[str], spec: ExperimentSpec = NOTEBOOK_SPEC, lg: int = HLL_LG) -> DataFrame:
    """(day, dims, sessions, sketch): sessions (exact) and an HLL sketch of the users of each cell. Users without an id aren't counted."""
    return sessions.groupBy(_day(spec), *dims).agg(
        F.count(F.lit(1)).alias("sessions"), F.hll_sketch_agg(F.col(spec.user_col), lg).alias("sketch")
    )


def sketched_users(sketches: DataFrame, reports: Sequence[Sequence[str]]) -> DataFrame:
    """Sessions and estimated users of several reports at once, from one read of the cells.

    A report is a list of the cells' dimensions (none: the total). Rows are (report, values, sessions, users):
    the dimensions' names joined by a comma, and their values in that order, NULL where a value is NULL.
    """
    rows = F.explode(F.array(*[
        F.struct(F.lit(",".join(r)).alias("report"), F.array(*[F.col(c).cast("string") for c in r]).cast("array<string>").alias("values")) for r in reports
    ]))
    return sketches.select(rows.alias("r"), "sessions", "sketch").groupBy("r.report", "r.values").agg(
        F.sum("sessions").alias("sessions"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("users")
    )


def exact_users(sessions: DataFrame, reports: Sequence[Sequence[str]], spec: ExperimentSpec = NOTEBOOK_SPEC) -> DataFrame:
    """The same reports with exact users: (report, values, sessions, users)."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(",".join(r)).alias("report"), F.array(*[F.col(c).cast("string") for c in r]).cast("array<string>").alias("values")) for r in reports
    ]))
    # distinct users by two plain aggregates, both combined before their shuffles
    each = sessions.select(rows.alias("r"), F.col(spec.user_col).alias("u")).groupBy("r.report", "r.values", "u").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("report", "values").agg(F.sum("n").alias("sessions"), F.count("u").alias("users"))


def users_check(sketched: DataFrame, exact: DataFrame, error: float) -> DataFrame:
    """(report, values, sessions, users, within): the exact counts and whether the sketch is within `error` of them."""
    s = sketched.select("report", "values", F.col("sessions").alias("_sessions"), F.col("users").alias("_users"))
    match = exact["report"].eqNullSafe(s["report"]) & exact["values"].eqNullSafe(s["values"])
    near = (F.col("_sessions") == F.col("sessions")) & (F.abs(F.col("_users") - F.col("users")) <= error * F.col("users"))
    return exact.join(s, match, "left").select(exact["report"], exact["values"], "sessions", "users", F.coalesce(near, F.lit(False)).alias("within"))
