"""Numbers dealt by key as arrays: a row for each bucket of keys and part of a task's rows, instead of one for each number.

Spark deals, sorts and spills these rows as any others; tasks work on a bucket's arrays with numpy. A bucket
has a bounded share of the keys, and a key's rows pass by in parts, so that a hot key is never held whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from splitscope.llm.common import as_long, map_arrow, mix

#: Numbers of a column that are dealt or worked on at once; buckets for a shuffle partition.
PART, EACH = 1 << 18, 2
_U = np.uint64


def n_buckets(spark: SparkSession) -> int:
    """EACH for a shuffle partition up to 4096, so that rows don't become short, but one at least; as many as 16 bits number."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(1 << 16, max(partitions, min(EACH * partitions, 1 << 12)))


def schema(columns: int) -> str:
    return ", ".join(["bucket int", "kind int", *(f"c{i} binary" for i in range(columns))])


def deal(by: np.ndarray, buckets: int, kind: int, columns: list[np.ndarray], width: int) -> pa.RecordBatch:
    """A row for each bucket that has numbers of `by`, with the columns' 64-bit numbers there; null columns up to `width`."""
    bucket = ((mix(by.view(_U)) >> _U(32)) * _U(buckets) >> _U(32)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    held = np.flatnonzero(sizes)
    ends = pa.py_buffer(np.r_[0, 8 * np.cumsum(sizes[held])].astype(np.int32))
    made = [pa.Array.from_buffers(pa.binary(), len(held), [None, ends, pa.py_buffer(np.ascontiguousarray(c[order]))]) for c in columns]
    made += [pa.nulls(len(held), pa.binary())] * (width - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(np.full(len(held), kind, np.int32)), *made], ["bucket", "kind", *(f"c{i}" for i in range(width))])


class Parts:
    """Arrays of one kind that a task gathers up to PART numbers before it deals them."""

    def __init__(self, buckets: int, kind: int, width: int):
        self.to, self.held, self.size = (buckets, kind, width), [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The first column is dealt by."""
        self.held.append(columns)
        self.size += len(columns[0])
        if self.size >= PART:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
            buckets, kind, width = self.to
            yield deal(columns[0], buckets, kind, columns, width)
        self.held, self.size = [], 0


def by_bucket(rows: DataFrame) -> DataFrame:
    """The dealt rows, a bucket's in one task one after the other, in the order of their kinds."""
    return rows.repartition("bucket").sortWithinPartitions("bucket", "kind")


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(bucket, kind, columns) of the rows of by_bucket; a bucket's numbers of one kind come in parts of about PART."""
    at, held, size = None, [], 0

    def joined() -> tuple[int, int, list[np.ndarray]]:
        return *at, [np.frombuffer(b"".join(c), np.int64) for c in zip(*held, strict=True) if c[0] is not None]

    for b in batches:
        for bucket, kind, *columns in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and ((bucket, kind) != at or size >= PART):
                yield joined()
                held, size = [], 0
            at = bucket, kind
            held.append(columns)
            size += len(columns[0]) // 8
    if held:
        yield joined()


def _first(x: np.ndarray) -> np.ndarray:
    """Where a sorted column's values begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)


def _sums(keys: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, with the sum of n, the least lo and the greatest hi of each."""
    order = np.argsort(keys)
    keys = keys[order]
    at = _first(keys)
    return (keys[at], np.add.reduceat(n[order], at), np.minimum.reduceat(lo[order], at), np.maximum.reduceat(hi[order], at)) if len(keys) else (keys, n, lo, hi)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, key) whose key has two ids, of the rows (key, id) of a task."""
    now, known = None, None
    for bucket, _, (key, id_) in parts(batches):
        if bucket != now:
            now, known = bucket, None
        order = np.argsort(key)
        key, id_ = key[order], id_[order]
        start = _first(key)
        sizes = np.diff(np.r_[start, len(key)])
        new = key[start], sizes, np.minimum.reduceat(id_, start), np.maximum.reduceat(id_, start)
        # the number, least and greatest id of each of the bucket's keys so far
        known, before = new if known is None else _sums(*map(np.concatenate, zip(known, new, strict=True))), known
        is_shared = known[2] < known[3]
        take = np.repeat(is_shared[np.searchsorted(known[0], new[0])], sizes)
        out = [(id_[take], key[take])]
        if before is not None:  # a key of one id alone until now
            at = np.searchsorted(known[0], before[0])
            late = (before[2] == before[3]) & is_shared[at]
            out.append((before[2][late], before[0][late]))
        ids, keys = map(np.concatenate, zip(*out, strict=True))
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys)], ["id", "key"])


def shared_rows(rows: DataFrame) -> DataFrame:
    """(id, key) of the rows (key, id) dealt by key whose key has two ids or more; rows may repeat."""
    return map_arrow(by_bucket(rows), _shared, "id long, key long")


#: Kinds of rows of sets: what a task has of each element, the elements of sets, and the sets.
COUNTS, ELEMENTS, SETS = range(3)


#: 64-bit words of a set's outline (linking's OUTLINE).
WORDS = 8
_PREFIX = ["key", "id", "n", "label", "at", "some", *(f"w{i}" for i in range(WORDS))]


def _placed(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Elements that two components share, with their counts, dealt by id."""
    out, sets = Parts(buckets, ELEMENTS, 3), Parts(buckets, SETS, 3)
    now, known, shared = None, None, None
    for bucket, kind, columns in parts(batches):
        if bucket != now:
            now, known, shared = bucket, None, None
        if kind == COUNTS:
            known = _sums(*(columns if known is None else map(np.concatenate, zip(known, columns, strict=True))))
        elif kind == ELEMENTS:
            if shared is None:
                two = known[2] < known[3]
                shared = known[0][two], known[1][two]
            if len(shared[0]):
                key, id_ = columns
                at = np.minimum(np.searchsorted(shared[0], key), len(shared[0]) - 1)
                take = shared[0][at] == key
                yield from out.add(id_[take], key[take], shared[1][at[take]])
        else:
            yield from sets.add(*columns)
    yield from out.rest()
    yield from sets.rest()


def _prefixes(elements: list[list[np.ndarray]], sets: list[list[np.ndarray]], share: float) -> Iterator[pa.RecordBatch]:
    """The prefix rows of a bucket's sets."""
    if not elements:
        return
    id_, key, df = map(np.concatenate, zip(*elements, strict=True))
    of, n, label = map(np.concatenate, zip(*sets, strict=True))
    order = np.argsort(of)
    of, n, label = of[order], n[order], label[order]
    order = np.lexsort((key, df, np.searchsorted(of, id_)))
    id_, key = id_[order], key[order]
    start = _first(id_)
    if not len(start):
        return
    some = np.diff(np.r_[start, len(id_)])
    bits = np.left_shift(_U(1), key.view(_U) & _U(63))
    outlines = [np.bitwise_xor.reduceat(np.where(key >> 6 & WORDS - 1 == i, bits, _U(0)), start) for i in range(WORDS)]
    at = np.searchsorted(of, id_[start])
    n, label = n[at], label[at]
    own = np.repeat(np.arange(len(start)), some)
    place = (n - some - start + 1)[own] + np.arange(len(id_))
    keep = place <= (n - np.ceil(share * n - 1e-9).astype(np.int64) + 1)[own]
    own = own[keep]
    columns = [key[keep], id_[keep], n[own], label[own], place[keep], some[own], *(as_long(w)[own] for w in outlines)]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _PREFIX)


def _ordered(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """The prefix rows of a task's sets."""
    now, elements, sets = None, [], []
    for bucket, kind, columns in parts(batches):
        if bucket != now:
            yield from _prefixes(elements, sets, share)
            now, elements, sets = bucket, [], []
        (elements if kind == ELEMENTS else sets).append(columns)
    yield from _prefixes(elements, sets, share)


def _shared_elements(rows: DataFrame) -> DataFrame:
    met = map_arrow(by_bucket(rows), functools.partial(_placed, buckets=n_buckets(rows.sparkSession)), schema(3))
    return by_bucket(met)


def prefix_rows(rows: DataFrame, share: float) -> DataFrame:
    """What linking's _prefixes gives, for sets dealt as arrays.

    rows: COUNTS (key, df, least label, greatest label), to be summed; ELEMENTS (key, id) of all sets;
    and SETS (id, n, label), dealt by id, which pass through.
    """
    return map_arrow(_shared_elements(rows), functools.partial(_ordered, share=share), ", ".join(f"{c} long" for c in _PREFIX))


def _dealt_prefixes(batches: Iterator[pa.RecordBatch], share: float, buckets: int) -> Iterator[pa.RecordBatch]:
    """The prefix rows of a task's sets, dealt by key."""
    out = Parts(buckets, 0, len(_PREFIX))
    for b in _ordered(batches, share):
        yield from out.add(*(c.to_numpy() for c in b.columns))
    yield from out.rest()


#: Pairs that are tested at once.
PAIRS = 1 << 15


def _across(columns: list[np.ndarray], share: float) -> Iterator[np.ndarray]:
    """The pairs (greater id, lesser id) that linking's _across gives for prefix rows: all rows of a bucket's keys; some come more than once.

    Rows of a key's largest component don't meet each other. And of two rows the smaller set's stands so early in its
    order that a set of its own size could be alike: two later rows don't meet either.
    """
    key, label = columns[0], columns[3]
    order = np.lexsort((label, key))
    key, label = key[order], label[order]
    run = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (label[1:] != label[:-1])])  # the rows of one key and label
    size = np.diff(np.r_[run, len(key)])
    by_size = np.lexsort((size, key[run]))
    last = np.r_[key[run][by_size][1:] != key[run][by_size][:-1], True]
    main = np.zeros(len(run), bool)
    main[by_size[last]] = True
    first = np.r_[True, key[run][1:] != key[run][:-1]]
    several = np.repeat(~(first & np.r_[first[1:], True]), size)  # rows whose key has more than one label
    main = np.repeat(main, size)[several]
    order, key = order[several], key[several]
    if not len(key):
        return
    early = columns[2][order] - columns[4][order] + 1 >= 2 * share / (1 + share) * columns[2][order] - 1e-6
    # of a key: early rows, late ones, the early and the late of the largest component
    again = np.lexsort((~early, main, key))
    order, key, main, early = order[again], key[again], main[again], early[again]
    start = _first(key)
    sizes = np.diff(np.r_[start, len(key)])
    others, met = (np.add.reduceat(x.astype(np.int64), start) for x in (~main, main & early))
    number = np.arange(len(key))
    from_ = np.where(early, number + 1, np.repeat(start + others, sizes))
    upto = np.where(early, np.repeat(start + sizes, sizes), np.repeat(start + others + met, sizes))
    meets = np.where(main, 0, upto - from_)
    upto = np.cumsum(meets)
    id_, n, label, at, some, *words = (c[order] for c in columns[1:])
    words = [w.view(_U) for w in words]
    for lo in range(0, int(upto[-1]), PAIRS):
        hi = min(lo + PAIRS, int(upto[-1]))
        rows = np.arange(np.searchsorted(upto, lo, "right"), np.searchsorted(upto, hi, "left") + 1)
        before = upto[rows] - meets[rows]
        skip = np.maximum(lo - before, 0)
        many = np.minimum(hi - before, meets[rows]) - skip
        x = np.repeat(rows, many)
        y = np.repeat(from_[rows] + skip - np.cumsum(many) + many, many) + np.arange(len(x))
        nx, ny = n[x], n[y]
        least = share / (1 + share) * (nx + ny) - 1e-6
        fits = np.flatnonzero((label[x] != label[y]) & (nx >= share * ny) & (ny >= share * nx) & (np.minimum(nx - at[x], ny - at[y]) + 1 >= least))
        x, y, least = x[fits], y[fits], least[fits]
        left = some[x] + some[y]
        for w in words:
            left = left - np.bitwise_count(w[x] ^ w[y])
        fits = np.flatnonzero(left >= 2 * least)
        if len(fits):
            x, y = id_[x[fits]], id_[y[fits]]
            yield np.unique(np.stack((np.maximum(x, y), np.minimum(x, y)), axis=1), axis=0)


def _paired(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of the prefix rows of a task's keys, once for each bucket."""

    def met(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        found = list(_across([np.concatenate(c) for c in zip(*held, strict=True)], share)) if held else []
        if found:
            a, b = np.unique(np.concatenate(found), axis=0).T
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], ["a", "b"])

    now, held = None, []
    for bucket, _, columns in parts(batches):
        if bucket != now:
            yield from met(held)
            now, held = bucket, []
        held.append(columns)
    yield from met(held)


def prefix_pairs(rows: DataFrame, share: float) -> DataFrame:
    """The pairs that linking's _across gives for the prefix_rows of `rows`; some come more than once.

    Prefix rows move as arrays and a bucket's pairs are tested in numpy, PAIRS at once: a large group of rows in
    different components that share rare elements makes as many pairs as before, but no rows of them.
    """
    moved = map_arrow(_shared_elements(rows), functools.partial(_dealt_prefixes, share=share, buckets=n_buckets(rows.sparkSession)), schema(len(_PREFIX)))
    return map_arrow(by_bucket(moved), functools.partial(_paired, share=share), "a long, b long")


def deal_sets(batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """The rows for prefix_rows of sets: from (ids, labels, keys, owner), keys distinct in a set, owner the number of a key's set."""
    counts, elements, sets = Parts(buckets, COUNTS, 4), Parts(buckets, ELEMENTS, 4), Parts(buckets, SETS, 4)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def summed() -> Iterator[pa.RecordBatch]:
        if held:
            key, label = map(np.concatenate, zip(*held, strict=True))
            yield from counts.add(*_sums(key, np.ones(len(key), np.int64), label, label))

    for ids, labels, keys, owner in batches:
        yield from elements.add(keys, ids[owner])
        yield from sets.add(ids, np.bincount(owner, minlength=len(ids)), labels)
        held.append((keys, labels[owner]))
        size += len(keys)
        if size >= 4 * PART:
            yield from summed()
            held.clear()
            size = 0
    yield from summed()
    for x in (counts, elements, sets):
        yield from x.rest()
