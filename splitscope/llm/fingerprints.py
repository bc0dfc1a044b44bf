"""Op 1: document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitscope.llm.common import BYTES_A_GROUP, map_arrow, mix, prefix_sums, span_hashes

#: Samples of a fingerprint, each 16 bits wide.
SAMPLES = 64
#: Ranges of ids that are put in order side by side: at most so many (each is read as a stream).
RANGES = 10_000
_U = np.uint64
_AT_ONCE = 16


def _gamma_quantiles(bits: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 2**bits equal steps; its distribution is 1 - (1 + x) exp(-x)."""
    x = np.concatenate([[0.0], np.geomspace(1e-5, 40, 400_000)])
    return np.interp((np.arange(1 << bits) + 0.5) / (1 << bits), 1 - (1 + x) * np.exp(-x), x)


_tables: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of r (16 bits), and logarithms of those of c (20 bits)."""
    if not _tables:
        _tables.extend([_gamma_quantiles(16).astype(np.float32), np.log(_gamma_quantiles(20)).astype(np.float32)])
    return _tables[0], _tables[1]


def samples(hashes: np.ndarray, weights: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """For each weighted term and sample number: its rank ln(a) in the upper 32 bits (so that the
    smallest wins), and an identity of (term, t) below.

    r and c are Gamma(2, 1), b is uniform, all from the term's hash and the sample's
    number alone; t = floor(ln w / r + b), ln a = ln c - r (t - b) - r. The term and t of the least a
    agree between two weighted sets with the probability of their generalised Jaccard similarity.
    """
    rs, cs = tables()
    h = mix(hashes[:, None] + (columns.astype(np.uint64) + _U(1)) * _U(0xD6E8FEB86659FD93))
    r = rs[(h & _U(0xFFFF)).astype(np.int64)]
    b = (h >> _U(36)).astype(np.float32) * np.float32(2.0**-28)
    t = np.floor(np.log(weights).astype(np.float32)[:, None] / r + b)
    a = cs[((h >> _U(16)) & _U(0xFFFFF)).astype(np.int64)] - r * (t - b) - r
    bits = a.view(np.uint32)
    order = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000))
    identity = (h ^ (t.astype(np.int64).view(np.uint64) * _U(0x9E3779B97F4A7C15))) * _U(0xC2B2AE3D27D4EB4F) >> _U(32)
    return order.astype(np.uint64) << _U(32) | identity


def fingerprints(texts: list[str]) -> np.ndarray:
    """Fingerprint of each text, SAMPLES 16-bit numbers; a text without words has zeros.

    Terms are the words between white space. A term's weight is the number of characters
    that it takes in the text: its count times its length.
    """
    number: dict[str, int] = {}
    ids: list[np.ndarray] = []
    for t in texts:
        words = t.split()
        for w in set(words).difference(number):
            number[w] = len(number)
        ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    out = np.zeros((len(texts), SAMPLES), np.uint16)
    if not number:
        return out
    sizes = np.array([len(x) for x in ids])
    terms, counts = np.unique(np.repeat(np.arange(len(texts)), sizes) * len(number) + np.concatenate(ids), return_counts=True)
    owner, word = np.divmod(terms, len(number))
    raw = [w.encode("utf-8", "surrogatepass") for w in number]
    ends = np.cumsum([len(x) for x in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    hashes = span_hashes(prefix_sums(data), np.concatenate([[0], ends[:-1]]), ends)
    lengths = np.array([len(w) for w in number])
    # each (word, weight) is drawn once for all texts of the group
    pairs, where = np.unique(word * (int(counts.max()) + 1) + counts, return_inverse=True)
    term, count = np.divmod(pairs, int(counts.max()) + 1)
    weights = (count * lengths[term]).astype(np.float64)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    for k in range(0, SAMPLES, _AT_ONCE):
        drawn = samples(hashes[term], weights, np.arange(k, k + _AT_ONCE))
        least = np.empty((len(starts), _AT_ONCE), np.uint64)
        i = 0
        while i < len(starts):  # some texts at once: about 2**16 terms, or one text
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + (1 << 16))))
            stop = starts[j] if j < len(starts) else len(owner)
            least[i:j] = np.minimum.reduceat(drawn[where[starts[i] : stop]], starts[i:j] - starts[i], axis=0)
            i = j
        out[owner[starts], k : k + _AT_ONCE] = (least & _U(0xFFFF)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated generalised Jaccard similarity of the rows: the share of samples that agree."""
    return (a == b).mean(1)


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    The edited text ends with the beginning of the next document in descending doc_id
    instead of its own last floor(n_chars/2) characters; after the last comes the first. Null text: empty.
    Texts without words have a fingerprint of zeros, alike among themselves. Equal ids stand in the
    order of their compressed texts; null ids are the least. Extra columns are ignored.

    Ids are cut into ranges of about equal counts; each range is sorted and read as a
    stream, led by a copy of the greatest document of the range below. The ranges' bounds and
    greatest ids (RANGES at most) are all that the driver sees.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    wanted = min(RANGES, 4 * tasks)
    cuts = sorted(set(ids.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / wanted for i in range(1, wanted)], 0.2 / wanted))) if wanted > 1 else []
    bounds = np.array(cuts, np.int64)

    def ranges(x: list) -> np.ndarray:
        known = np.array([v is not None for v in x], bool)
        at = np.searchsorted(bounds, np.array([v or 0 for v in x], np.int64), "left")
        return np.where(known, at, 0)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ranges(x), pa.int64()), b.column(0)], ["range", "doc_id"])

    top = map_arrow(ids, number, "range long, doc_id long").groupBy("range").agg(F.max("doc_id").alias("doc_id")).orderBy("range").collect()
    # the greatest id of a range leads the next one that holds documents; that of the last leads the first
    leads = {r["range"]: (top[(i + 1) % len(top)]["range"], r["doc_id"]) for i, r in enumerate(top)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            x = b.column(0).to_pylist()
            texts = [press.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()]
            at = ranges(x).tolist()
            rows = [(r, False, i, t) for r, i, t in zip(at, x, texts, strict=True)]
            rows += [(leads[r][0], True, i, t) for r, i, t in zip(at, x, texts, strict=True) if leads[r][1] == i]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], ["range", "lead", "doc_id", "packed"])

    dealt = map_arrow(docs.select("doc_id", "text"), deal, "range long, lead boolean, doc_id long, packed binary")
    ordered = dealt.repartition(tasks, "range").sortWithinPartitions("range", F.desc("lead"), F.asc_nulls_first("doc_id"), "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        before = ""
        waiting: list[tuple[int | None, str, str]] = []  # id, text, next text
        size = 0

        def settle() -> pa.RecordBatch:
            nxt = [n for _, _, n in waiting]
            texts = [t for _, t, _ in waiting]
            edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nxt, strict=True)]
            m = len(texts)
            # the next document is the one above in the stream, but for the first of a range
            apart = [i for i in range(m) if i == 0 or nxt[i] is not texts[i - 1]]
            f = fingerprints(texts + edited + [nxt[i] for i in apart])
            own, changed, following = f[:m], f[m : 2 * m], np.empty_like(f[:m])
            following[1:] = own[:-1]
            following[apart] = f[2 * m :]
            as_text = lambda x: [row.tobytes().hex() for row in x.astype(">u2")]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _, _ in waiting], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                    pa.array(as_text(own), pa.string()),
                    pa.array(as_text(changed), pa.string()),
                    pa.array(likeness(own, changed), pa.float64()),
                    pa.array(likeness(own, following), pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for b in batches:
            for lead, doc_id, packed in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                text = unpack.decompress(packed).decode("utf-8", "surrogatepass") if len(packed) else ""
                if not lead:
                    waiting.append((doc_id, text, before))
                    size += len(text)
                    if size >= BYTES_A_GROUP // 2:
                        yield settle()
                        waiting, size = [], 0
                before = text
        if waiting:
            yield settle()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_arrow(ordered, run, schema)
