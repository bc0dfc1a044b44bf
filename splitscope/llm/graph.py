"""Distributed union-find: connected components of an edge table by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitscope.llm.common import drop, save


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction step over edges (a, b) with a > b.

    Large-star links each node's greater neighbours to its least neighbour (itself
    included); small-star links a node and its lesser neighbours to the least of them. The least neighbour is a partial aggregate
    and the join back can be split, so a hot node never meets in one task.
    """
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        linked = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        linked = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return linked.where("a > b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, str]:
    """(node, component) for each node of an edge: the least node it can reach. Also the table's path.

    Edges may be repeated, in either direction, or loops (a loop alone gives no row). Each step is
    written to the shared folder; the steps end when one changes nothing. A step's edges are never more than the first's.
    """
    spark = edges.sparkSession
    known = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    held, path = save(known, "edges")
    marks = F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")
    before = tuple(held.agg(*marks).first())
    while True:
        step, after = save(_star(_star(held, large=True), large=False), "edges")
        now = tuple(step.agg(*marks).first())
        drop(spark, path)
        held, path = step, after
        if now == before:
            break
        before = now
    # stars are left: each node is linked to its component's least
    nodes = held.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out, done = save(nodes.unionByName(held.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components")
    drop(spark, path)
    return out, done
