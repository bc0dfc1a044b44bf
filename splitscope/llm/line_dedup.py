"""Op 7: fuzzy duplicates of lines by MinHash over character shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitscope.llm import dealt
from splitscope.llm.common import BASE, BESIDE, CACHES, TEXT_KEY, as_long, drop, map_arrow, mix, renewed, save, text_groups, text_key, with_text_key
from splitscope.llm.linking import link_components
from splitscope.llm.phrases import SLOTS, bit_filter, in_filter

#: Characters of a shingle; similarity in percent from which lines are one; bands, and hashes of a band.
#: Lines of one language have less than 1 % of seven-character shingles in common by chance, so four hashes a band keep buckets small.
SHINGLE, PERCENT, BANDS, WIDTH = 7, 85, 10, 4
#: Normalised characters of the shortest line that takes part: every line with a word does. Bands need a whole shingle; shorter lines are alike if they are equal.
SHORTEST = 1
#: Characters that are banded at once: their arrays stay in a core's cache. Lines that a task remembers, to hash and band them once.
TOGETHER, REMEMBERED = 1 << 16, 1 << 16
#: Lines of a bucket up to which its pairs are made (linking's SMALL): larger ones are few, and their lines' prefixes cost less than those pairs.
SMALL = 16
#: Bits of the bitmaps of lines that are compared together, as a power of two.
MARKS = 20
_U = np.uint64
_HASHES = BANDS * WIDTH
_ORDERS = np.argsort(mix(np.arange(_HASHES * _HASHES, dtype=np.uint64).reshape(_HASHES, _HASHES) + _U(7)), axis=1)
_TABLE = (np.arange(BANDS, dtype=np.uint64) + _U(1)) * _U(0xE7037ED1A0B428DB)


def normal_line(line: str) -> str:
    """Lower case, runs of white space as one space, trimmed."""
    return _trimmed(line.lower())


def _trimmed(x: str) -> str:
    """Runs of white space as one space, trimmed. Of white space the space alone is printable: most lines need no split."""
    return x if x.isprintable() and "  " not in x and x[:1] != " " and x[-1:] != " " else " ".join(x.split())


def line_key(normal: str) -> int:
    return int.from_bytes(hashlib.blake2b(normal.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


#: Arrays that a task works in: new ones for each part would be given back to the system and fetched again.
_ROOM: dict[str, np.ndarray] = {}
CACHES.append(_ROOM.clear)


def _room(name: str, n: int, dtype: type = np.uint64) -> np.ndarray:
    """An array of n numbers: zeros, if it is new, else what was left there; kept up to 16 * TOGETHER numbers."""
    if n > 16 * TOGETHER:
        return np.zeros(n, dtype)
    if name not in _ROOM or len(_ROOM[name]) < n:
        _ROOM[name] = np.zeros(max(n, 2 * TOGETHER), dtype)
    return _ROOM[name][:n]


def _grams(points: np.ndarray) -> np.ndarray:
    """Hash of the SHINGLE characters from each position on: a polynomial, each part made of two of half its length. Stands in room that the next call takes."""
    parts = {1: _room("1", len(points))}
    parts[1][:] = points

    def of(n: int) -> np.ndarray:
        if n not in parts:
            right = of(n // 2)
            left = of(n - n // 2)
            m = len(points) - n + 1
            parts[n] = _room(str(n), m)
            np.multiply(left[:m], _U(pow(int(BASE), n // 2, 1 << 64)), out=parts[n])
            parts[n] += right[n - n // 2 :][:m]
        return parts[n]

    h = of(SHINGLE)
    other = parts[1][: len(h)]  # of no use any more
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):  # mix, in place
        np.right_shift(h, _U(shift), out=other)
        h ^= other
        if factor:
            h *= _U(factor)
    return h


def _points(lines: list[str]) -> np.ndarray:
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)


def _torn(sizes: np.ndarray) -> np.ndarray:
    """Positions in lines joined whose shingles run into the next line."""
    return (np.cumsum(sizes)[:-1, None] - np.arange(1, SHINGLE)).ravel()


def _whole_grams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of lines (of SHINGLE characters at least), line after line, and the number of each one's line."""
    sizes = np.array([len(x) for x in lines])
    h = _grams(_points(lines))
    whole = np.ones(len(h), bool)
    whole[_torn(sizes)] = False
    return h[whole], np.repeat(np.arange(len(lines)), sizes - SHINGLE + 1)


def _cuts(sizes: list[int]) -> list[tuple[int, int]]:
    """Spans of items that have about TOGETHER characters."""
    parts = np.cumsum(sizes) // TOGETHER
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(sizes)]
    return list(zip(cuts, cuts[1:], strict=False)) if sizes else []


def _small_parts(lines: list[str]) -> list[list[str]]:
    return [lines[a:b] for a, b in _cuts([len(x) for x in lines])]


def band_keys(lines: list[str]) -> np.ndarray:
    """Keys of the BANDS bands of each line (of SHINGLE characters at least), banded TOGETHER characters at a time."""
    return np.concatenate([_band_keys(x) for x in _small_parts(lines)])


def _band_keys(lines: list[str]) -> np.ndarray:
    """One permutation, _HASHES buckets: the least hash of each bucket is its MinHash; an empty bucket takes
    the value of the first filled one in an order of its own."""
    sizes = np.array([len(x) for x in lines])
    h = _grams(_points(lines))
    upper = _room("upper", len(h))
    np.right_shift(h, _U(32), out=upper)
    h <<= _U(32)
    h |= upper
    h[_torn(sizes)] = ~_U(0)  # the least of no bucket
    upper *= _U(_HASHES)
    upper >>= _U(32)
    at = as_long(upper)
    at += np.repeat(np.arange(0, len(lines) * _HASHES, _HASHES), sizes)[: len(h)]
    least = np.full(len(lines) * _HASHES, ~_U(0))
    np.minimum.at(least, at, h)
    least = least.reshape(-1, _HASHES)
    held = least != ~_U(0)
    line, empty = np.nonzero(~held)
    turn = 0
    while len(line):
        source = _ORDERS[empty, turn]
        found = held[line, source]
        least[line[found], empty[found]] = least[line[found], source[found]]
        line, empty = line[~found], empty[~found]
        turn += 1
    key = np.broadcast_to(_TABLE, (len(lines), BANDS)).copy()
    for i in range(WIDTH):
        key = mix(key + least[:, i::WIDTH])
    return key


_LINES = f"doc_id long, t long, pos int, line long, {dealt.schema(2)}"
_EMPTY = pa.RecordBatch.from_arrays([pa.nulls(0, x) for x in (pa.int64(), pa.int64(), pa.int32(), pa.int64())], ["doc_id", "t", "pos", "line"])


def _beside(a: pa.RecordBatch, b: pa.RecordBatch) -> pa.RecordBatch:
    """The columns of both, one of which has no row: null there."""
    n = max(a.num_rows, b.num_rows)
    wide = [c if len(c) else pa.nulls(n, c.type) for c in (*a.columns, *b.columns)]
    return pa.RecordBatch.from_arrays(wide, [*a.schema.names, *b.schema.names])


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line of SHORTEST characters or more; a row for each document, with pos -1 and its number of lines as `line`;
    and band keys and their lines, dealt by key (kind is null else), of the lines that hold a shingle, the first time that a task meets them."""
    buckets = dealt.n_buckets(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        fresh: list[str] = []
        size = 0
        out = dealt.Parts(buckets, 0, 2)
        none = dealt.deal(np.empty(0, np.int64), buckets, 0, [], 2)

        def banded() -> Iterator[pa.RecordBatch]:
            if fresh:
                lines = np.array([seen[x] for x in fresh], np.int64)
                yield from out.add(as_long(band_keys(fresh)).ravel(), np.repeat(lines, BANDS))

        for ids, texts in text_groups(batches, ("doc_id", "text")):
            keys, counts, pos, line = [], [], [], []
            for text in texts:
                keys.append(text_key(text))
                lines = (text or "").lower().split("\n")  # a line's case doesn't depend on others
                before = len(pos)
                pos.append(-1), line.append(len(lines))
                for p, x in enumerate(lines):
                    x = _trimmed(x)
                    if len(x) < SHORTEST:
                        continue
                    key = seen.get(x)
                    if key is None:
                        key = seen[x] = line_key(x)
                        if len(x) >= SHINGLE:
                            fresh.append(x)
                            size += len(x)
                    pos.append(p), line.append(key)
                counts.append(len(pos) - before)
            at = pa.array(np.repeat(np.arange(len(ids)), counts))
            found = [pa.array(ids, pa.int64()).take(at), pa.array(keys, pa.int64()).take(at), pa.array(pos, pa.int32()), pa.array(line, pa.int64())]
            yield _beside(pa.RecordBatch.from_arrays(found, _EMPTY.schema.names), none)
            if size >= 16 * TOGETHER or len(seen) >= REMEMBERED:
                for x in banded():
                    yield _beside(_EMPTY, x)
                fresh.clear()
                size = 0
            if len(seen) >= REMEMBERED:
                seen.clear()
        for x in (*banded(), *out.rest()):
            yield _beside(_EMPTY, x)

    return map_arrow(docs.select("doc_id", "text"), run, _LINES)


def alike(xs: list[str], ys: list[str]) -> np.ndarray:
    """Whether the sets of shingles of each pair of lines (of SHINGLE characters at least) have the similarity asked for.

    A bitmap of each line's shingles comes first: a bit that one line alone has stands for a shingle that the other lacks.
    For the pairs that this doesn't rule out, the number of a pair stands in the upper bits of its shingles' hashes and the side in the last, so that all sets are counted by one sort.
    """
    number = {x: i for i, x in enumerate(dict.fromkeys((*xs, *ys)))}  # a line of several pairs is hashed once
    h, of = _whole_grams(list(number))
    sizes = np.array([len(x) - SHINGLE + 1 for x in number])
    starts = np.cumsum(sizes) - sizes
    sides = [np.array([number[x] for x in lines]) for lines in (xs, ys)]
    m = 1 << max(6, MARKS - len(number).bit_length())
    held = _room("held", len(number) * m, bool)
    at = of * m + as_long(h & _U(m - 1))
    held[at] = True
    marks = np.packbits(held.reshape(-1, m), axis=1).view(np.uint64)
    held[at] = False
    apart = np.bitwise_count(marks[sides[0]] ^ marks[sides[1]]).sum(axis=1, dtype=np.int64)
    out = (100 + PERCENT) * apart <= (100 - PERCENT) * (sizes[sides[0]] + sizes[sides[1]])  # sizes are those of the sets or more
    left = np.flatnonzero(out)
    if len(left):
        out[left] = _equal_enough(h, starts, sizes, [line[left] for line in sides])
    return out


def _equal_enough(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray, sides: list[np.ndarray]) -> np.ndarray:
    """What alike gives, for the two sides' numbers of lines, whose shingles' hashes are h[start : start + size]."""
    pairs = len(sides[0])
    bits = _U(64 - pairs.bit_length())
    h = h >> _U(64) - bits & ~_U(1)
    keys = []
    for side, line in enumerate(sides):
        n = sizes[line]
        owner = np.repeat(np.arange(pairs), n)
        keys.append(h[np.arange(len(owner)) + (starts[line] - np.cumsum(n) + n)[owner]] | (owner.astype(np.uint64) << bits | _U(side)))
    keys = np.sort(np.concatenate(keys))
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
    count = lambda x: np.bincount((x >> bits).astype(np.int64), minlength=pairs)
    common = count(keys[1:][keys[1:] ^ keys[:-1] == _U(1)])
    return 100 * common >= PERCENT * (count(keys) - common)


def _linked(pairs: DataFrame) -> DataFrame:
    """Pairs of lines whose sets of shingles have the similarity asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            xs, ys = (p.column(c).to_pylist() for c in ("xa", "xb"))
            cuts = _cuts([len(x) + len(y) for x, y in zip(xs, ys, strict=True)])
            keep = [alike(xs[i:j], ys[i:j]) for i, j in cuts]
            if keep:
                yield p.select(["a", "b"]).filter(pa.array(np.concatenate(keep)))

    return map_arrow(pairs, run, "a long, b long")


def _pairs(texts: DataFrame) -> DataFrame:
    """The pairs that linking's _across gives for the prefixes of the lines' sets of shingles; texts: (id, x, label)."""
    buckets = dealt.n_buckets(texts.sparkSession)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for b in batches:
            ids, labels = (b.column(i).to_numpy() for i in (0, 2))
            lines = b.column(1).to_pylist()
            for i, j in _cuts([len(x) for x in lines]):
                h, owner = _whole_grams(lines[i:j])
                order = np.argsort(h)
                order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]
                h, owner = h[order], owner[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]
                yield ids[i:j], labels[i:j], as_long(h[new]), owner[new]

    rows = map_arrow(texts.select("id", "x", "label"), lambda batches: dealt.deal_sets(sets(batches), buckets), dealt.schema(4))
    return dealt.prefix_pairs(rows, PERCENT / 100)


def _slots(t: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two slots of a filter for each place."""
    h = mix(t.view(_U) + pos.astype(np.uint64) * BASE)
    return as_long(h % _U(SLOTS)), as_long((h >> _U(32)) % _U(SLOTS))


def _texts_of(docs: DataFrame, where: DataFrame) -> DataFrame:
    """(id, x): the normalised lines at the places `where` (t, pos, line; a table, as it is read twice).

    A filter of a fixed size rules most other places out, so that few lines leave their documents; a filter that is too full admits more, which changes nothing.
    """

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_slots(*(c.to_numpy() for c in b.columns))))], ["slot"])

    bits = bit_filter(map_arrow(where.select("t", "pos"), slots, "slot long"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            n = np.array([x.count("\n") + 1 for x in texts], np.int64)
            own = np.repeat(np.arange(len(texts)), n)
            pos = np.arange(len(own)) - (np.cumsum(n) - n)[own]
            one, two = _slots(np.array([text_key(x) for x in texts], np.int64)[own], pos)
            at = np.flatnonzero(in_filter(bits, one))
            at = at[in_filter(bits, two[at])]
            held, lines, out = -1, [], []
            for d, p in zip(own[at].tolist(), pos[at].tolist(), strict=True):
                if d != held:
                    held, lines = d, texts[d].split("\n")
                out.append(normal_line(lines[p]))
            yield pa.RecordBatch.from_arrays([pa.array([line_key(x) for x in out], pa.int64()), pa.array(out, pa.string())], ["id", "x"])

    lines = map_arrow(docs.where("text IS NOT NULL").select("text"), cut, "id long, x string")
    return lines.join(where.select(F.col("line").alias("id")).hint("shuffle_hash"), "id", "left_semi").dropDuplicates(["id"])


def duplicate_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Documents (doc_id, t, n_lines), their removed lines (doc_id, t, removed array<int>), and tables to drop.

    Lines are alike if the Jaccard similarity of their character shingles, after normalising, is PERCENT / 100 or
    more; of each component of alike lines the first stays: least doc_id, then text key, then line number.
    Recall of the candidates at the threshold: 1 - (1 - 0.85**4)**10, 0.9994; above it rises steeply.
    """
    spark = docs.sparkSession
    banded, p0 = save(_lines(docs), "banded-lines")
    lines, p1 = save(banded.where("kind IS NULL").select("doc_id", "t", "pos", "line"), "lines")
    found_lines = lines.where("pos >= 0")
    place = F.struct("doc_id", "t", "pos")
    equal, p2 = save(found_lines.groupBy("line").agg(F.count("*").alias("n"), F.min(place).alias("first")), "equal-lines")
    more = []

    def fetch(ids: DataFrame) -> DataFrame:
        where, path = save(equal.join(ids.toDF("line").hint("shuffle_hash"), "line").select("line", "first.t", "first.pos"), "member-places")
        more.append(path)
        return _texts_of(docs, where)

    def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        side = lambda c: texts.select(F.col("id").alias(c), F.col("x").alias(f"x{c}"))
        return _linked(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "xa", "xb"))

    bands = dealt.shared_rows(banded.where("kind IS NOT NULL").select("bucket", "kind", "c0", "c1")).withColumn("n", F.lit(1).cast("long"))
    linked, used = link_components(bands, fetch, verify, None, PERCENT / 100, (p0,), shared=True, pairs_of=_pairs, small=SMALL)
    # of the lines that are not alone: the first of each component
    classes = equal.join(linked.withColumnRenamed("node", "line").hint("shuffle_hash"), "line", "left").where("n > 1 OR component IS NOT NULL").select("line", F.coalesce("component", "line").alias("component"), "first")
    keepers = classes.groupBy("component").agg(F.min("first").alias("keeper"))
    classes, p3 = save(classes.join(keepers, "component").select("line", "keeper"), "line-classes")
    gone = found_lines.select("doc_id", "t", "pos", "line").join(classes.hint("shuffle_hash"), "line").where(~F.struct("doc_id", "t", "pos").eqNullSafe(F.col("keeper")))
    removed, p4 = save(gone.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("pos")).alias("removed")), "removed-lines")
    documents = lines.where("pos = -1").select("doc_id", "t", F.col("line").alias("n_lines"))
    drop(spark, p2, p3, *used, *more)
    return documents, removed, [p1, p4]


def line_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) of every document: which of its lines (from 0) are duplicates of an earlier one.

    Null text: as empty, one empty line, nothing removed; lines without a word are never removed. Rows
    with equal id and text are one document and keep the same lines; null ids are the least. Extra columns are ignored.
    """
    documents, removed, _ = duplicate_lines(docs)
    match = documents["doc_id"].eqNullSafe(removed["doc_id"]) & (documents["t"] == removed["t"])
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    return documents.join(removed, match, "left").select(documents["doc_id"], "n_lines", F.size(gone).cast("long").alias("n_removed"), gone.alias("removed"))


def without_duplicate_lines(docs: DataFrame) -> DataFrame:
    """Documents without their duplicate lines; columns as those of docs, n_chars renewed.

    A document that loses lines and has no word left goes; all others stay.
    """
    _, removed, _ = duplicate_lines(docs)
    doc, key, lines = (BESIDE + x for x in ("doc", "key", "removed"))
    right = removed.toDF(doc, key, lines)
    keyed = with_text_key(docs)
    joined = keyed.join(right, keyed["doc_id"].eqNullSafe(F.col(doc)) & (F.col(TEXT_KEY) == F.col(key)), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(lines, i)), "\n")
    cut = joined.withColumn("text", F.when(F.col(lines).isNull(), F.col("text")).otherwise(left))
    return renewed(cut.where(F.col(lines).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs)
