"""From banded signatures to components: candidates by common keys, links by an exact check, no pairs within a component.

A bucket (the rows of one band key) may hold a third of all rows, so its pairs are
never all made. Each row is first paired with two pivots of its bucket (its least id and its hub), and links that hold are united. What is left are
buckets with rows in different components, mostly rows that share a passage but are not alike. Small ones
give their pairs across components. For the rows of larger ones the pairs come from the sets themselves: two sets of similarity t or more share one of the rarest (1 - t) of
their elements (prefix filtering, exact), and rows that share only a passage have rarer elements than its own.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitscope.llm.common import drop, save
from splitscope.llm.dealt import WORDS
from splitscope.llm.graph import components


#: Rows of a bucket up to which its pairs across components are made: a row then has fewer than so many in each.
SMALL = 32
#: Of a set: how many of its elements may be in others, and 64 * WORDS bits, each the parity of those elements that fall on it.
OUTLINE = ("some", *(f"w{i}" for i in range(WORDS)))


def _across(rows: DataFrame, share: float, placed: bool) -> DataFrame:
    """Pairs (a > b) of rows (key, id, n, label, at) with one key, in different components, that may be alike.

    Rows outside a key's largest component meet all rows of other components, so
    rows of one component never meet each other. If the key is an element in its place `at`, sizes must fit, and
    what stands from there on in both orders must suffice for the similarity: the first
    element that two similar sets have in common does. And the bits in which their outlines differ stand
    for as many elements that one of them lacks: what is left must suffice as well.
    """
    sizes = rows.groupBy("key", "label").agg(F.count("*").alias("c"))
    main = sizes.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    known = rows.join(main.select("key", "main"), "key")
    some = known.where("label != main").select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), F.col("at").alias("ia"), *(F.col(c).alias(f"{c}a") for c in OUTLINE if placed))
    other = known.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"), F.col("at").alias("ib"), "main", *(F.col(c).alias(f"{c}b") for c in OUTLINE if placed))
    fits = (F.col("na") >= share * F.col("nb")) & (F.col("nb") >= share * F.col("na"))
    left = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) + 1
    least = F.lit(share / (1 + share)) * (F.col("na") + F.col("nb")) - 1e-6
    met = some.join(other, "key").where("la != lb AND (lb = main OR a > b)")
    if placed:
        met = met.where(fits & (left >= least) & (F.expr("somea + someb - " + " - ".join(f"bit_count(w{i}a ^ w{i}b)" for i in range(WORDS))) >= 2 * least))
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _counts(sets: DataFrame) -> DataFrame:
    """(key, df): the elements that sets of two components have, and how many sets have them."""
    counts = sets.groupBy("key").agg(F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return counts.where("lo < hi").select("key", "df")


def _prefixes(sets: DataFrame, share: float, counts: DataFrame | None = None) -> DataFrame:
    """(key, id, n, label, at, and OUTLINE): each set's rarest elements and their places in its order, as many as two sets of similarity `share` must share one of.

    sets: (id, label, n, key), a row for each element. Pairs are wanted across components alone, so elements of one
    component alone come first in the order, and lead to no pair: a large component of copies that meets another row by a passage gives the passage's elements.
    Outlines are of a set's elements that components share: others can't be in two sets of different components.
    """
    shared = sets.join((_counts(sets) if counts is None else counts).hint("shuffle_hash"), "key")
    own = Window.partitionBy("id")  # one set's elements
    placed = shared.select("key", "id", "n", "label", F.row_number().over(own.orderBy("df", "key")).alias("at"), F.count("*").over(own).alias("some"), *(F.bit_xor(F.expr(f"if(key & {64 * (WORDS - 1)} = {64 * i}, shiftleft(1L, cast(key & 63 as int)), 0L)")).over(own).alias(f"w{i}") for i in range(WORDS)))
    length = F.col("n") - F.ceil(F.lit(share) * F.col("n") - F.lit(1e-9)) + 1
    at = F.col("n") - F.col("some") + F.col("at")
    return placed.where(at <= length).select("key", "id", "n", "label", at.alias("at"), *OUTLINE)


def link_components(
    bands: DataFrame | list[DataFrame],
    fetch: Callable[[DataFrame], DataFrame],
    verify: Callable[[DataFrame, DataFrame], DataFrame],
    elements: Callable[[DataFrame], DataFrame] | None,
    share: float,
    read: tuple[str, ...] = (),
    shared: bool = False,
    pairs_of: Callable[[DataFrame], DataFrame] | None = None,
    small: int | None = None,
) -> tuple[DataFrame, list[str]]:
    """(node, component) of all nodes with a link, and the tables to drop in the end.

    bands: (id long, key long, n long): a row for each band key of a node, n the size of
    its set, or 1 for all if it isn't known yet; or several such tables without a key in common, dealt one after the other to need less room. fetch: ids -> their texts (a table with id). verify: pairs (a, b) and the
    texts -> those pairs that are linked. elements: texts with label -> (id, n, key, label) for each element of the sets (without
    label, it is joined). share: the least similarity. read: tables
    that only bands are read from, dropped once they are. shared: bands hold only keys that two nodes have, and n follows from id. pairs_of:
    texts with label -> the pairs that _across gives for the _prefixes of their sets, in place of elements. small: in place of SMALL.
    """
    tables = bands if isinstance(bands, list) else [bands]
    spark = tables[0].sparkSession
    small = SMALL if small is None else small
    row = F.struct("id", "n")
    # nearly all keys are one node's alone: the others are a table of their own, so that the shuffle files of all keys go before all rows are dealt
    found = []
    for some in tables:
        if shared:
            found.append(save(some, "shared-bands"))
            continue
        keys, p0 = save(some.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key"), "shared-keys")
        found.append(save(some.join(keys.hint("shuffle_hash"), "key"), "shared-bands"))
        drop(spark, p0)
    drop(spark, *read)
    met = functools.reduce(DataFrame.unionByName, [x for x, _ in found])
    # min_by needs no sort of the rows, but n must follow from the id
    least = F.struct(F.min("id").alias("id"), F.min_by("n", "id").alias("n")) if shared else F.min(row)
    ends = met.groupBy("key").agg(least.alias("lo"), F.count("*").alias("size"))
    members, p2 = save(met.join(ends, "key").select("id", "n", "key", "lo", "size").distinct(), "members")
    drop(spark, *(path for _, path in found))
    texts, p1 = save(fetch(members.select("id").distinct()), "member-texts")
    # the row that shares the most keys with others is nearest to the middle of its group: copies are
    # nearer to what they are copied from than to each other
    met = members.withColumn("met", F.sum("size").over(Window.partitionBy("id")))  # one node's keys
    hubs = met.groupBy("key").agg(F.max_by(row, F.struct("met", "id")).alias("hub"))
    star = members.join(hubs, "key").select("id", "n", F.explode(F.array("lo", "hub")).alias("p")).where("id != p.id")
    star = star.where((F.col("n") >= share * F.col("p.n")) & (F.col("p.n") >= share * F.col("n")))
    tested, p3 = save(star.select(F.greatest("id", "p.id").alias("a"), F.least("id", "p.id").alias("b")).distinct(), "pairs")
    links, p4 = save(verify(tested, texts), "links")
    found, p5 = components(links)
    paths = [p1, p2, p3, p4, p5]

    labels = found.withColumnRenamed("node", "id")
    labelled = members.select("id", "n", "key", "size").join(labels, "id", "left").select("id", "n", "key", "size", F.coalesce("component", "id").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    rows, p6 = save(labelled.join(mixed, "key"), "open")
    nodes = rows.where(F.col("size") > small).select("id", "label").distinct()
    if pairs_of:
        rare, p7 = save(pairs_of(texts.join(nodes, "id")), "prefix-pairs")
    else:
        sets = elements(texts.join(nodes, "id"))
        if "label" not in sets.columns:
            sets = sets.join(nodes, "id")
        # a table of their own, so that their shuffle files go before the sets are dealt
        counts, p11 = save(_counts(sets), "shared-elements")
        prefixes, p7 = save(_prefixes(sets, share, counts), "prefixes")
        drop(spark, p11)
        rare = _across(prefixes, share, True)
    few = _across(rows.where(F.col("size") <= small).withColumn("at", F.lit(1)), share, False)
    pairs = few.unionByName(rare).distinct()
    fresh, p8 = save(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    more, p9 = save(verify(fresh, texts), "links")
    paths += [p6, p7, p8, p9]
    if more.isEmpty():
        return found, paths
    # what is known as stars, which take fewer steps than the links
    out, p10 = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    drop(spark, p5)
    return out, [*(p for p in paths if p != p5), p10]
