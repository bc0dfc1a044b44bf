"""Exact quantiles and rank sums from value histograms, without one-task groups.

Exact quantiles of a large group need every distinct value in order. Instead of
a per-group value map (held by one task) or a window over the whole group, we

1. aggregate a histogram: one row per (group, value) with counts (partial
   aggregation, so a hot value or hot group is combined map-side);
2. range-partition it by (group, value) and write it with each row's piece: Spark
   samples the keys, so pieces are even however large one group is, and their
   number is that of the shuffle partitions, which is sized to the data;
3. prefix-sum the pieces' totals (a window over at most one row a piece);
4. run the prefix sum within each (group, piece) and add the piece's offset.

There is one path at all sizes; no window holds more than a piece.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitscope.session import materialize

APPROX_ACCURACY = 10000


def join_on(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on `cols`, NULL-safe, keeping one copy of the key columns."""
    if not cols:
        raise ValueError("join_on needs at least one key")
    r = right.select(*[F.col(c).alias(f"__r_{c}") for c in cols], *[c for c in right.columns if c not in cols])
    cond = None
    for c in cols:
        e = left[c].eqNullSafe(r[f"__r_{c}"])
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*[f"__r_{c}" for c in cols])


def running_counts(hist: DataFrame, group_cols: Sequence[str], value_col: str, count_cols: Sequence[str]) -> DataFrame:
    """Add `before_<c>` (sum of count column c over strictly smaller values of the group)
    and `total_<c>` (its sum over the whole group).

    `hist` must hold one row per (group, value).
    """
    group_cols = list(group_cols)
    # the pieces feed two branches: written once, they are the same in both
    h = materialize(
        hist.repartitionByRange(*group_cols, value_col).withColumn("_piece", F.spark_partition_id()), "value_histogram"
    )
    totals = h.groupBy(*group_cols, "_piece").agg(*[F.sum(c).alias(f"_t_{c}") for c in count_cols])
    w_group = Window.partitionBy(*group_cols)
    w_before = w_group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group_cols,
        "_piece",
        *[F.coalesce(F.sum(f"_t_{c}").over(w_before), F.lit(0)).cast("bigint").alias(f"_o_{c}") for c in count_cols],
        *[F.sum(f"_t_{c}").over(w_group).cast("bigint").alias(f"total_{c}") for c in count_cols],
    )
    h = join_on(h, offsets, group_cols + ["_piece"])
    w_in = Window.partitionBy(*group_cols, "_piece").orderBy(value_col).rowsBetween(Window.unboundedPreceding, -1)
    h = h.select(
        *h.columns,
        *[
            (F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(w_in), F.lit(0))).cast("bigint").alias(f"before_{c}")
            for c in count_cols
        ],
    )
    return h.drop("_piece", *[f"_o_{c}" for c in count_cols])


def rank_value(before: Column, f: Column, value: Column, rank0: Column) -> Column:
    """Aggregate: the value at 0-based rank `rank0` (rows sorted by value)."""
    return F.min(F.when(before + f > rank0, value))


def disc_rank0(q: float, n: Column) -> Column:
    """0-based rank of PERCENTILE_DISC(q): first value whose cumulative share reaches q."""
    k = n - F.floor(n.cast("double") - n.cast("double") * F.lit(float(q)))
    return F.greatest(k, F.lit(1)) - 1


def value_ranks(df: DataFrame, group_cols: Sequence[str], value_col: str) -> DataFrame:
    """One row per (group, value) with its count `_f`, `before__f` and `total__f`. NULL values are ignored."""
    hist = df.where(F.col(value_col).isNotNull()).groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_f"))
    return running_counts(hist, group_cols, value_col, ["_f"])


def exact_quantiles(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    qs: Mapping[str, float],
    kind: str = "disc",
) -> DataFrame:
    """Exact quantiles per group: `kind='disc'` (PERCENTILE_DISC) or 'cont' (interpolated).

    Returns group_cols + one column per entry of `qs`. NULL values are ignored.
    """
    group_cols = list(group_cols)
    v = F.col(value_col)
    h = value_ranks(df, group_cols, value_col)
    before, f, nn = F.col("before__f"), F.col("_f"), F.col("total__f")
    aggs = []
    for name, q in qs.items():
        if kind == "disc":
            aggs.append(rank_value(before, f, v, disc_rank0(q, nn)).alias(name))
        else:
            pos = (nn - 1).cast("double") * F.lit(float(q))
            aggs.append(rank_value(before, f, v, F.floor(pos)).alias(f"_lo_{name}"))
            aggs.append(rank_value(before, f, v, F.ceil(pos)).alias(f"_hi_{name}"))
            aggs.append(F.max(pos - F.floor(pos)).alias(f"_fr_{name}"))
    out = h.groupBy(*group_cols).agg(*aggs)
    if kind != "disc":
        out = out.select(
            *group_cols,
            *[
                (F.col(f"_lo_{k}") + F.col(f"_fr_{k}") * (F.col(f"_hi_{k}") - F.col(f"_lo_{k}"))).alias(k)
                for k in qs
            ],
        )
    return out


def approx_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str, qs: Mapping[str, float]) -> DataFrame:
    """Sketch-based quantiles (bounded memory per group, mergeable partial aggregates)."""
    names = list(qs)
    arr = F.percentile_approx(F.col(value_col), [qs[k] for k in names], APPROX_ACCURACY)
    return df.groupBy(*group_cols).agg(arr.alias("_q")).select(
        *group_cols, *[F.col("_q")[i].alias(k) for i, k in enumerate(names)]
    )


def quantiles(df: DataFrame, group_cols, value_col: str, qs: Mapping[str, float], mode: str = "exact") -> DataFrame:
    if mode == "exact":
        return exact_quantiles(df, group_cols, value_col, qs, "disc")
    if mode == "approx":
        return approx_quantiles(df, group_cols, value_col, qs)
    raise ValueError(f"unknown quantile mode {mode!r}")
