"""Op 8: removal of repeated 200-byte strings, by merging Burrows-Wheeler transforms of shards.

1. Windows of SPAN bytes are grouped by content: a window's anchor is the k-gram of least hash
   in it (the first of them), and a run is the windows in a row with one anchor. Equal windows have equal
   anchors at equal places, so repeats occur only between runs of one anchor hash, a class.
2. A class of equal runs is repeated in full. For a class with different runs, one text of
   each is fetched; classes are laid out in shards, each shard's suffixes are sorted and its transform taken.
3. Two shards' transforms are merged by refining their interleaving: at depth h, each row's block
   of equal h-prefixes is known; the blocks at depth 2h follow from the row's block and that of the row h symbols on,
   which the transform gives (stable counting order of its symbols, composed with itself). Each shard's keys are in order already, so
   a refinement merges two sorted runs and never sorts suffixes anew. Blocks at depth SPAN with two rows or more are the repeated intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitscope.llm.common import BESIDE, TEXT_KEY, as_long, drop, map_arrow, prefix_sums, raw_text, renewed, save, span_hashes, text_groups, text_key, with_text_key

SPAN, GRAM = 200, 64
#: Different runs of a class from which its windows are counted by their hashes instead, one by one over all tasks.
HOT = 20_000
#: Bytes of text that runs are taken from at once, bytes of a shard, and bytes of classes that are merged at once (a larger
#: class is merged alone): arrays of a few hundred kB stay in a core's cache, and their memory is used again.
SLICE, SHARD, TOGETHER = 1 << 16, 1 << 19, 1 << 17
_U = np.uint64


# --- runs --------------------------------------------------------------------


def slices(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined up to SLICE bytes; longer ones in slices that overlap by SPAN - 1 bytes.

    Yields the bytes and, for each part in it, the text's number, the part's start there and its start in the bytes.
    """
    held: list[bytes] = []
    rows: list[tuple[int, int, int]] = []
    size = 0
    for i, t in enumerate(texts):
        for start in range(0, max(1, len(t) - SPAN + 1), SLICE):
            part = t[start : start + SLICE + SPAN - 1]
            if len(part) < SPAN:
                continue
            rows.append((i, start, size))
            held.append(part)
            size += len(part)
            if size >= SLICE:
                yield np.frombuffer(b"".join(held), np.uint8), *np.array(rows, np.int64).T
                held, rows, size = [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), *np.array(rows, np.int64).T


def runs_of(data: np.ndarray, part_at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of a slice: class hash, hash of the run's bytes, start, number of windows, and its part.

    part_at: where each part starts; windows across parts are no windows.
    """
    sums = prefix_sums(data)
    n = len(data)
    grams = span_hashes(sums, np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
    bits = _U(max(1, int(n - 1).bit_length()))
    best = grams >> bits << bits | np.arange(len(grams), dtype=np.uint64)
    width, span = SPAN - GRAM + 1, 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if width > span:
        best = np.minimum(best[: span - width], best[width - span :])
    anchor = (best & ((_U(1) << bits) - _U(1))).astype(np.int64)
    part = np.repeat(np.arange(len(part_at)), np.diff(np.r_[part_at, n]))[: len(anchor)]
    stop = np.r_[part_at[1:], n][part]
    valid = np.arange(len(anchor)) + SPAN <= stop
    change = np.r_[True, (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])]
    start = np.flatnonzero(change)
    end = np.r_[start[1:], len(anchor)]
    keep = valid[start]
    start, end = start[keep], end[keep]
    return grams[anchor[start]], span_hashes(sums, start, end - 1 + SPAN), start, end - start, part[start]


def _runs(docs: DataFrame, where: bool) -> DataFrame:
    """(m, s) of all runs; with `where` also the text's key and the place: start * 256 + windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in text_groups(batches, ("text",)):
            raw = [raw_text(t) for t in texts]
            keys = np.array([text_key(t) for t in texts], np.int64) if where else None
            for data, number, begin, at in slices(raw):
                m, s, start, windows, part = runs_of(data, at)
                columns = [pa.array(as_long(m)), pa.array(as_long(s))]
                if where:
                    columns += [pa.array(keys[number[part]]), pa.array((start - at[part] + begin[part]) << 8 | windows)]
                yield pa.RecordBatch.from_arrays(columns, ["m", "s", "t", "place"][: len(columns)])

    return map_arrow(docs.select("text"), run, "m long, s long" + ", t long, place long" * where)


# --- transforms --------------------------------------------------------------


class Shard:
    """Transform of segments: rows in the order of their SPAN-prefixes, the symbol before each, and each row's position.

    Each segment ends with an end mark; the marks differ from each other and are less than any byte.
    """

    def __init__(self, bwt: np.ndarray, position: np.ndarray, marks: int):
        self.bwt, self.position, self.marks = bwt, position, marks


def _blocks(keys: np.ndarray) -> np.ndarray:
    """Numbers of the runs of equal keys."""
    return np.cumsum(np.r_[False, keys[1:] != keys[:-1]])


def transform(segments: list[bytes], base: int) -> Shard:
    """Sort a shard's suffixes by SPAN symbols (prefix doubling among rows still tied) and take its transform.

    base: position of the shard's first symbol in the batch.
    """
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    ends = np.cumsum([len(s) + 1 for s in segments]) - 1
    code = text.astype(np.uint64) + _U(len(ends))
    code[ends] = np.arange(len(ends), dtype=np.uint64)
    n = len(code)
    padded = np.r_[code, np.zeros(3, np.uint64)]
    key = padded[:n] << _U(48) | padded[1 : n + 1] << _U(32) | padded[2 : n + 2] << _U(16) | padded[3 : n + 3]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    change = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    first = np.maximum.accumulate(np.where(change, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    depth = 4
    while depth < SPAN:
        step = min(depth, SPAN - depth)
        tied = np.flatnonzero(~(change & np.r_[change[1:], True]))
        if not len(tied):
            break
        rows = order[tied]
        key = rank[rows] << 32 | rank[np.minimum(rows + step, n - 1)]
        by = np.argsort(key, kind="stable")
        order[tied], key = rows[by], key[by]
        again = np.r_[True, key[1:] != key[:-1]]
        change[tied] |= again
        first = np.maximum.accumulate(np.where(change, np.arange(n), 0))
        rank[order[tied]] = first[tied]
        depth += step
    before = text.astype(np.uint16) + np.uint16(1)
    before[ends] = 0
    return Shard(before[order - 1], order + base, len(ends))


def merge(a: Shard, b: Shard) -> tuple[Shard, np.ndarray]:
    """Interleave two transforms; also the block of equal SPAN-prefixes of each merged row."""
    sizes = len(a.bwt), len(b.bwt)
    total = sum(sizes)
    marks = a.marks + b.marks
    ahead = []  # row of the suffix one symbol on, in the concatenation of both shards' rows
    keys = []
    for shard, shift, offset in ((a, 0, 0), (b, sizes[0], a.marks)):
        follow = np.argsort(shard.bwt, kind="stable")
        first = shard.bwt[follow].astype(np.int64) + marks
        first[: shard.marks] = np.arange(shard.marks) + offset
        ahead.append(follow + shift)
        keys.append(first)
    step = np.concatenate(ahead)
    strides = {1: step}
    key = np.concatenate(keys)
    depth = 1
    while True:
        order = np.argsort(key, kind="stable")  # two runs in order: one linear merge
        block = np.empty(total, np.int64)
        block[order] = _blocks(key[order])
        if depth == SPAN:
            break
        by = min(depth, SPAN - depth)
        if by not in strides:
            half = 1 << (by.bit_length() - 1)
            strides[half] = strides.get(half) if half in strides else strides[half // 2][strides[half // 2]]
            far, rest = strides[half], by - half
            while rest:
                bit = 1 << (rest.bit_length() - 1)
                far, rest = strides[bit][far], rest - bit
            strides[by] = far
        key = block << 32 | block[strides[by]]
        depth += by
    shard = Shard(np.concatenate([a.bwt, b.bwt])[order], np.concatenate([a.position, b.position])[order], marks)
    return shard, block[order]


def repeated_starts(segments: list[bytes], shard_bytes: int = SHARD) -> np.ndarray:
    """For the segments, each followed by an end mark, whether the SPAN bytes at a position stand anywhere else."""
    shards: list[tuple[Shard, np.ndarray | None]] = []
    held: list[bytes] = []
    size = base = 0
    total = sum(map(len, segments)) + len(segments)
    for i, s in enumerate(segments):
        held.append(s)
        size += len(s) + 1
        # two shards at least, so that repeats come from merged transforms
        if size >= min(shard_bytes, -(-total // 2)) or i == len(segments) - 1:
            shards.append((transform(held, base), None))
            base += size
            held, size = [], 0
    if len(shards) == 1:
        shards.append((Shard(np.empty(0, np.uint16), np.empty(0, np.int64), 0), None))
    while len(shards) > 1:
        pairs = [shards[i : i + 2] for i in range(0, len(shards), 2)]
        shards = [merge(p[0][0], p[1][0]) if len(p) == 2 else p[0] for p in pairs]
    shard, block = shards[0]
    same = block[1:] == block[:-1]
    out = np.zeros(total, bool)
    out[shard.position[np.r_[same, False] | np.r_[False, same]]] = True
    return out


# --- the operator ------------------------------------------------------------


def _packed(docs: DataFrame, columns: str = "") -> DataFrame:
    """Texts as compressed UTF-8 with their keys, to be moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            rest = [b.column(i) for i, f in enumerate(b.schema) if f.name != "text"]
            names = [f.name for f in b.schema if f.name != "text"]
            yield pa.RecordBatch.from_arrays([pa.array([text_key(t) for t in texts], pa.int64()), pa.array([press.compress(raw_text(t)) for t in texts], pa.binary()), *rest], ["t", "packed", *names])

    names = [c.split()[0] for c in columns.split(", ")] if columns else []
    return map_arrow(docs.select("text", *names), run, "t long, packed binary" + (f", {columns}" if columns else ""))


def _segments(texts: DataFrame) -> DataFrame:
    """Bytes of the wanted runs of each text: (m, s, copies, segment); for hot classes the windows' hashes: (window, t, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for t, packed, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = unpack.decompress(packed)
                rows = [(w["m"], w["s"], w["copies"], raw[w["place"] >> 8 : (w["place"] >> 8) + (w["place"] & 255) + SPAN - 1]) for w in wanted if w["copies"]]
                hot = [w["place"] for w in wanted if not w["copies"]]
                if rows:
                    m, s, c, x = zip(*rows, strict=True)
                    none = pa.nulls(len(m), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(s, pa.int64()), pa.array(c, pa.int64()), pa.array(x, pa.binary()), none, none], names)
                if hot:
                    sums = prefix_sums(np.frombuffer(raw, np.uint8))
                    start = np.concatenate([np.arange(p >> 8, (p >> 8) + (p & 255)) for p in hot])
                    h = as_long(span_hashes(sums, start, start + SPAN))
                    none = pa.nulls(len(h), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(h), none, none, pa.nulls(len(h), pa.binary()), pa.array(np.full(len(h), t)), pa.array(start)], names)

    names = ["m", "s", "copies", "segment", "t", "start"]
    return map_arrow(texts, run, "m long, s long, copies long, segment binary, t long, start long")


def _merged(segments: DataFrame) -> DataFrame:
    """(m, s, spans): the windows of each run that are repeated within its class, as [from, to) pairs in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        last = None

        def settle() -> pa.RecordBatch:
            # neighbours of a class go to different shards, as merging finds repeats between and within shards alike
            found = repeated_starts([x for *_, x in held])
            at, spans = 0, []
            for _, _, copies, x in held:
                flag = found[at : at + len(x) - SPAN + 1] if copies < 2 else np.ones(len(x) - SPAN + 1, bool)
                spans.append(np.flatnonzero(np.diff(np.r_[False, flag, False].astype(np.int8))).tolist())
                at += len(x) + 1
            some = [i for i, x in enumerate(spans) if x]
            return pa.RecordBatch.from_arrays(
                [pa.array([held[i][0] for i in some], pa.int64()), pa.array([held[i][1] for i in some], pa.int64()), pa.array([spans[i] for i in some], pa.list_(pa.int32()))], ["m", "s", "spans"]
            )

        for b in batches:
            for m, s, c, x in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if last == (m, s):
                    continue
                if last and m != last[0] and size >= TOGETHER:
                    yield settle()
                    held, size = [], 0
                last = (m, s)
                held.append((m, s, c, x))
                size += len(x)
        if held:
            yield settle()

    return map_arrow(segments, run, "m long, s long, spans array<int>")


def repeated_spans(docs: DataFrame, hot: int = HOT) -> tuple[DataFrame, list[str]]:
    """(t, spans): for each text key, the window starts that are repeated, as an array of (from, to); and the tables to drop."""
    spark = docs.sparkSession
    some = docs.where("text IS NOT NULL").select("text")
    classes = _runs(some, False).groupBy("m").agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).where("n > 1")
    classes, p1 = save(classes.select("m", F.expr("lo != hi").alias("differ")), "classes")
    runs, p2 = save(_runs(some, True).join(classes, "m"), "runs")

    differ = runs.where("differ")
    reps = differ.groupBy("m", "s").agg(F.count("*").alias("copies"), F.min(F.struct("t", "place")).alias("p")).select("m", "s", "copies", "p.*")
    reps, p3 = save(reps, "run-representatives")
    large = reps.groupBy("m").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("m")
    mixed = reps.join(large, "m", "left_anti")
    split, p4 = save(differ.join(large, "m").groupBy("m", "s", "t", "place").agg(F.count("*").alias("times")), "hot-runs")
    each = split.select("m", "s", F.lit(0).cast("long").alias("copies"), "t", "place")
    wanted = mixed.unionByName(each).groupBy("t").agg(F.collect_list(F.struct("m", "s", "copies", "place")).alias("wanted"))  # a text's own runs
    texts = _packed(some).join(wanted, "t").dropDuplicates(["t"]).select("t", "packed", "wanted")
    segments, p5 = save(_segments(texts), "segments")

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = segments.where("segment IS NOT NULL").select("m", "s", "copies", "segment").repartition(tasks, "m").sortWithinPartitions("m", "s")
    spans = _merged(laid)
    begin = F.shiftright("place", 8)
    pair = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    whole = runs.where("NOT differ").select("t", pair(begin, begin + F.col("place").bitwiseAND(255)).alias("x"))
    parts = differ.join(spans, ["m", "s"]).select(
        "t", F.explode(F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: pair(begin + F.get("spans", i), begin + F.get("spans", i + 1)))).alias("x")
    )
    windows = segments.where("segment IS NULL").select(F.col("m").alias("h"), "t", "start")
    # a window of a hot class: counted once for each text that holds it, with that text's copies
    copies = split.select("t", F.col("times").alias("copies"), F.explode(F.sequence(begin, begin + F.col("place").bitwiseAND(255) - 1)).alias("start"))
    counted = windows.join(copies, ["t", "start"])
    often = counted.groupBy("h").agg(F.sum("copies").alias("n")).where("n > 1").select("h")
    single = counted.join(often, "h").select("t", pair(F.col("start"), F.col("start") + 1).alias("x"))
    found = whole.unionByName(parts).unionByName(single).groupBy("t").agg(F.collect_set("x").alias("spans"))
    out, path = save(found, "spans")
    drop(spark, p1, p2, p3, p4, p5)
    return out, [path]


def _covered(size: int, spans: list[dict]) -> np.ndarray:
    """Bytes covered by the windows that start in the spans."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, [x["a"] for x in spans], 1)
    np.add.at(step, [x["b"] + SPAN - 1 for x in spans], -1)
    return np.cumsum(step[:-1]) > 0


def _cut(raw: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """What is left without the covered bytes, the number of these, and of their maximal runs."""
    if not spans:
        return raw, 0, 0
    gone = _covered(len(raw), spans)
    runs = int((gone & ~np.r_[False, gone[:-1]]).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _cut_text(text: str, spans: list[dict]) -> str:
    """The text without the characters all of whose bytes are covered."""
    data = np.frombuffer(raw_text(text), np.uint8)
    gone = _covered(len(data), spans)
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    partly = np.zeros(character[-1] + 1, bool)
    partly[character[~gone]] = True
    return data[partly[character]].tobytes().decode("utf-8", "surrogatepass")


def repeats_removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document.

    Each byte covered by a SPAN-byte string that starts anywhere else too is removed; matches never cross
    documents and are judged on the input. Null text: empty. Texts shorter than SPAN bytes keep
    everything. A repeated row is a copy like any other, so both lose all. Extra columns are ignored.
    """
    spans, _ = repeated_spans(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            raw = [unpack.decompress(p) if p else b"" for p in b.column(1).to_pylist()]
            cut = [_cut(r, s) for r, s in zip(raw, b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(r) for r in raw], pa.int64()),
                    pa.array([n for _, n, _ in cut], pa.int64()),
                    pa.array([k for _, _, k in cut], pa.int64()),
                    pa.array([hashlib.sha256(left).hexdigest() for left, _, _ in cut], pa.string()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    joined = _packed(docs, "doc_id long").join(spans, "t", "left").select("doc_id", "packed", "spans")
    return map_arrow(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """Documents without their repeated strings; columns as those of docs, n_chars renewed.

    A character goes if all of its bytes are covered. A document that loses text and
    has no word left goes; all others stay.
    """
    spans, _ = repeated_spans(docs)
    key, found = BESIDE + "key", BESIDE + "spans"
    joined = with_text_key(docs).join(spans.toDF(key, found), F.col(TEXT_KEY) == F.col(key), "left").select(*docs.columns, found)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [_cut_text(t, s) if s else t for t, s in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            columns = list(b.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    cut = map_arrow(joined, run, joined.schema)
    return renewed(cut.where(F.col(found).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs)
