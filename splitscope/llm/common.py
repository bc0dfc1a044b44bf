"""Helpers shared by the operators: Arrow mapping, shared tables, hashing in numpy."""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitscope.session import ensure_checkpoint_dir

#: Rows of an Arrow batch handed to Python; texts average some kB, so a batch stays at a few MB.
ROWS_A_BATCH = 512
#: Bytes of text that Python code works on at once (a single longer text is taken alone).
BYTES_A_GROUP = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Spark sends to Python (rows of long texts)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_A_BATCH))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(_returning(fn) if _give_back.get() else fn, schema)


_give_back: ContextVar[bool] = ContextVar("give_back", default=False)


def memory_given_back(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage whose Python tasks give their memory back when they end, caches included.

    Spark keeps Python workers for later tasks, so what one stage held would lie beside the next one's. A job of one
    operator is better off with warm caches and leaves them.
    """

    @functools.wraps(stage)
    def planned(*args, **kw) -> DataFrame:
        token = _give_back.set(True)
        try:
            return stage(*args, **kw)
        finally:
            _give_back.reset(token)

    return planned


def _returning(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


#: What tasks of this worker process keep for later ones: functions that let go of it.
CACHES: list[Callable[[], None]] = []


def give_back() -> None:
    """Empty the caches of this process and return freed memory to the system (where the C library can)."""
    for forget in CACHES:
        forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of the write are deleted once it has ended, as nothing reads them again.
    """
    spark = df.sparkSession
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that no later plan reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        hp.getFileSystem(conf).delete(hp, True)


def text_groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], text: str = "text") -> Iterator[tuple[list, ...]]:
    """Python lists of the named columns, cut so that a group's texts stay near BYTES_A_GROUP."""
    at = columns.index(text)
    for batch in batches:
        lists = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
        start = size = 0
        for i, t in enumerate(lists[at]):
            size += len(t) if t else 0
            if size >= BYTES_A_GROUP:
                yield tuple(x[start : i + 1] for x in lists)
                start, size = i + 1, 0
        if start < len(lists[at]):
            yield tuple(x[start:] for x in lists)


def raw_text(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def text_key(text: str | None) -> int:
    """64-bit key of a text; null as the empty text."""
    return int.from_bytes(hashlib.blake2b(raw_text(text), digest_size=8).digest(), "little", signed=True)


#: Prefix of the columns that stand beside those of a caller's table, and the text key's name there.
BESIDE = "__llm_"
TEXT_KEY = BESIDE + "text_key"


def with_text_key(docs: DataFrame) -> DataFrame:
    """The rows of docs with the key of their text as TEXT_KEY."""
    fields = docs.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.array([text_key(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, keys], [*b.schema.names, TEXT_KEY])

    return map_arrow(docs, run, T.StructType([*fields, T.StructField(TEXT_KEY, T.LongType())]))


def renewed(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """Columns as those of docs, n_chars counted anew."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


# --- hashing -----------------------------------------------------------------

_U = np.uint64
#: Odd base of the polynomial hash modulo 2**64, its inverse, and a random value for each byte.
BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every bit of x over all bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


BYTE_VALUES = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _U(0x632BE59BD9B4E019))

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept up to 2**18 entries."""
    if len(_powers["up"]) < n:
        m = 1 << (n - 1).bit_length()
        made = {}
        for k, b in (("up", BASE), ("down", _INVERSE)):
            x = np.full(m, b, np.uint64)
            x[0] = 1
            made[k] = np.cumprod(x)
        if m > 1 << 18:
            return made["up"][:n], made["down"][:n]
        _powers.update(made)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S[i] = sum of value(byte j) * BASE**j for j < i, so that any span's hash is one difference."""
    up, _ = powers(len(data))
    s = np.empty(len(data) + 1, np.uint64)
    s[0] = 0
    np.cumsum(BYTE_VALUES[data] * up, out=s[1:])
    return s


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) under `sums`; equal bytes give equal values wherever they stand."""
    _, down = powers(max(1, len(sums)))
    return mix((sums[ends] - sums[starts]) * down[starts])


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs without \\x20 and \\x09-\\x0D."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~_SPACE[data]
    step = np.diff(solid)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def shingle_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased.

    Fewer words than `words`: the whole sequence is the one shingle. No word: empty.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    starts, ends = word_spans(data)
    if not len(starts):
        return np.empty(0, np.uint64)
    h = span_hashes(prefix_sums(data), starts, ends)
    n = min(words, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * BASE + h[i : len(h) - n + 1 + i]
    return np.unique(mix(out + _U(n)))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def no_text(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit("")))
