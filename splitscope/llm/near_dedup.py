"""Op 3: near-duplicate documents by HyperMinHash sketches, with exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitscope.llm.common import BESIDE, as_long, drop, map_arrow, mix, raw_text, save, shingle_hashes, text_groups
from splitscope.llm.linking import link_components

#: Registers of a sketch; bits of a register's mantissa; bands and registers of a band.
BUCKETS, MANTISSA, BANDS, WIDTH = 128, 10, 32, 4
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: An estimate more than so many standard deviations below the threshold rules a pair out; the
#: deviation follows the number of registers that a set of that size fills. Sets below SMALL are verified at once.
DEVIATIONS, SMALL = 5.5, 32
_U = np.uint64
_BITS = BUCKETS.bit_length() - 1
_FIRST = np.arange(BUCKETS, dtype=np.uint64) << _U(64 - _BITS)
#: For each register, all registers in an order of its own: an empty one takes the first filled one's value.
_ORDERS = np.argsort(mix(np.arange(BUCKETS * BUCKETS, dtype=np.uint64).reshape(BUCKETS, BUCKETS) + _U(77)), axis=1)
_TABLE = np.arange(BANDS, dtype=np.uint64) * _U(0xA0761D6478BD642F)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set of sorted distinct 64-bit hashes (not empty).

    The upper bits choose the bucket; of the least remainder there, the register holds
    the number of leading zeros and the MANTISSA bits after the leading one.
    """
    at = np.searchsorted(hashes, _FIRST)
    held = np.r_[at[1:], len(hashes)] > at
    rest = hashes[np.minimum(at, len(hashes) - 1)] << _U(_BITS)
    zeros = np.zeros(BUCKETS, np.int64)
    x = rest.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = x < (_U(1) << _U(64 - step))
        zeros += np.where(low, step, 0)
        x = np.where(low, x << _U(step), x)
    registers = (zeros.astype(np.uint64) << _U(MANTISSA) | (x << _U(1)) >> _U(64 - MANTISSA)).astype(np.uint16)
    empty = np.flatnonzero(~held)
    if len(empty):
        orders = _ORDERS[empty]
        registers[empty] = registers[orders[np.arange(len(empty)), held[orders].argmax(1)]]
    return registers


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of registers."""
    x = registers.reshape(BANDS, WIDTH).astype(np.uint64)
    key = _TABLE.copy()
    for i in range(WIDTH):
        key = mix(key + x[:, i] + _U(1))
    return key


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of the sets behind rows of registers. Registers of different elements agree
    if their zeros do (one time in three) and their mantissas: that share is taken off."""
    chance = 2.0**-MANTISSA / 3
    return np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)


def _sketches(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_groups(batches, ("doc_id", "text")):
            sets = [shingle_hashes(t) for t in texts]
            full = [sketch(s) if len(s) else None for s in sets]
            keys = [as_long(band_keys(r)) if r is not None else np.empty(0, np.int64) for r in full]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([r.tobytes() if r is not None else None for r in full], pa.binary()),
                    pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32), pa.array(np.concatenate(keys), pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_hash", "registers", "keys"],
            )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, set_hash binary, registers binary, keys array<long>")


def _likely(pairs: DataFrame) -> DataFrame:
    """Pairs whose sketches don't rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            if not p.num_rows:
                continue
            registers = [np.frombuffer(b"".join(p.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb")]
            n = np.minimum(p.column("na").to_numpy(), p.column("nb").to_numpy())
            filled = BUCKETS * (1 - np.exp(-n / BUCKETS))
            least = PERCENT / 100 - DEVIATIONS * np.sqrt(PERCENT * (100 - PERCENT) / 1e4 / filled)
            keep = pa.array((n < SMALL) | (estimate(*registers) >= least))
            yield p.select(["a", "b"]).filter(keep)

    return map_arrow(pairs, run, "a long, b long")


def _linked(pairs: DataFrame) -> DataFrame:
    """Pairs whose full sets have the similarity asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        last, held = None, None
        for p in batches:
            keep = []
            for a, ta, tb in zip(p.column("b").to_pylist(), p.column("tb").to_pylist(), p.column("ta").to_pylist(), strict=True):
                if a != last:  # rows stand in the order of b, so a pivot's set is made once
                    last, held = a, shingle_hashes(unpack.decompress(ta).decode("utf-8", "surrogatepass"))
                other = shingle_hashes(unpack.decompress(tb).decode("utf-8", "surrogatepass"))
                common = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(held) + len(other) - common))
            yield p.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(pairs, run, "a long, b long")


def _elements(texts: DataFrame) -> DataFrame:
    """(id, n, key, label) for each shingle of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for i, packed, label in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                s = shingle_hashes(unpack.decompress(packed).decode("utf-8", "surrogatepass"))
                same = (pa.array(np.full(len(s), x, np.int64)) for x in (i, len(s), label))
                yield pa.RecordBatch.from_arrays([next(same), next(same), pa.array(as_long(s)), next(same)], ["id", "n", "key", "label"])

    return map_arrow(texts.select("id", "packed", "label"), run, "id long, n long, key long, label long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Documents are linked if the Jaccard similarity of their sets of 5-word shingles is 0.75 or more; component_id is
    the least id reachable, and that document is kept. Null, empty and word-less texts
    have an empty set, are linked with nothing and kept. Equal sets are one class, whose least id stands for
    it in all that follows. A repeated row has its class; rows with one id and different texts are
    taken as one document. A null id stands for no class: its row gets its class's id and is not kept. Extra columns are ignored.

    Recall of the candidates: a pair of similarity s shares no band with probability
    (1 - s**4)**32, 5e-6 at 0.75. Candidates are confirmed on their full sets.
    """
    spark = docs.sparkSession
    sketches, made = save(_sketches(docs), "sketches")
    classes = sketches.where("set_hash IS NOT NULL").groupBy("set_hash").agg(F.min("doc_id").alias("rep"))
    classes, path = save(classes, "classes")
    reps = sketches.join(classes.where("rep IS NOT NULL"), "set_hash").where("doc_id = rep").select(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), "registers", "keys")
    reps, reps_path = save(reps.dropDuplicates(["id", "registers"]), "representatives")
    # registers and keys are needed of the representatives alone
    sets, sets_path = save(sketches.select("doc_id", "n_shingles", "set_hash"), "sets")
    drop(spark, made)
    bands = reps.select("id", "n", F.explode("keys").alias("key"))
    registers = reps.select("id", "n", "registers")
    likely_tables: list[str] = []

    def fetch(ids: DataFrame) -> DataFrame:
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            press = zstandard.ZstdCompressor(level=3)
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([press.compress(raw_text(t)) for t in b.column(1).to_pylist()], pa.binary())], ["id", "packed"])

        texts = map_arrow(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("id"), "text"), pack, "id long, packed binary")
        return texts.join(ids, "id", "left_semi").dropDuplicates(["id", "packed"])

    def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        side = lambda x: registers.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
        likely, path = save(_likely(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb")).distinct(), "likely")
        likely_tables.append(path)
        side = lambda x: texts.select(F.col("id").alias(x), F.col("packed").alias(f"t{x}"))
        return _linked(likely.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").sortWithinPartitions("b"))

    found, used = link_components(bands, fetch, verify, _elements, PERCENT / 100)
    labels = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("component"))
    out = sets.join(labels, "set_hash", "left")
    single = F.col("set_hash").isNull()
    out = out.select("doc_id", "n_shingles", F.when(single, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    out, _ = save(out, "near-duplicates")
    drop(spark, sets_path, path, reps_path, *likely_tables, *used)
    return out


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The first document of each component of near-duplicates; columns as those of docs.

    Rows are told apart by id and text: rows equal in both are one document, and one id with unrelated texts is so
    many documents. First is the least doc_id, then text key; null ids come last, so such a
    row stays if no document with an id is in its component. Null, empty and word-less texts are linked with nothing.
    """
    node, linked, component = (BESIDE + x for x in ("node", "linked", "component"))
    key = F.xxhash64("doc_id", "text")
    found = near_duplicates(docs.select(key.alias("doc_id"), "text")).select(F.col("doc_id").alias(linked), F.col("component_id").alias(component)).distinct()
    rows = docs.select("doc_id", key.alias(node)).distinct()
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", node)
    first = rows.join(found, F.col(node) == F.col(linked)).groupBy(component).agg(F.min(place).alias("first")).select(F.col(f"first.{node}").alias(node))
    return docs.withColumn(node, key).join(first, node, "left_semi").dropDuplicates([node]).select(*docs.columns)
