"""Op 2 and op 5: encoding and decoding, and token counts of huge texts.

op 2 merges by a heap of ranks over a linked symbol list and decodes by joining
vocabulary strings. op 5 cuts a huge text into chunks that overlap, encodes
each chunk with offsets, and splices neighbours at a boundary that both agree on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitscope.llm.bpe import vocabulary
from splitscope.llm.common import map_arrow, text_groups


def encode_decode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, ids binary, n_tokens, decoded) of every text; ids are little-endian unsigned 32-bit.

    Null text: as the empty text, which has no ids and decodes to the empty
    string. A row gives a row, repeated or not; further columns are ignored.
    No shuffle: each text is encoded where it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_path)
        for ids, texts in text_groups(batches, ("doc_id", "text")):
            made = v.encode_many(texts, heap=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(made, pa.binary()), pa.array([len(x) // 4 for x in made], pa.int64()), pa.array([v.decode(x) for x in made], pa.string())],
                ["doc_id", "ids", "n_tokens", "decoded"],
            )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids binary, n_tokens long, decoded string")


def encode_decode_digest(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """The digests of encode_decode: SHA-256 of ids and of the decoded text."""
    made = encode_decode(docs, vocabulary_path)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


# --- op 5 --------------------------------------------------------------------

#: Characters of a chunk of a huge text, and of the overlap tried first.
CHUNK, OVERLAP = 1 << 16, 256


def library_offsets(vocabulary_path: str):
    """Encoder of a chunk by the tokenizers library: start and end offsets of its tokens."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path)
    t.no_truncation()
    t.no_padding()

    def encode(chunk: str) -> tuple[np.ndarray, np.ndarray]:
        spans = np.array(t.encode(chunk, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        return spans[:, 0], spans[:, 1]

    return encode


def chunk_tokens(text: str, at: int, end: int, encode) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets in the whole text of the tokens of text[at:end]."""
    starts, ends = encode(text[at:end])
    return starts + at, ends + at


def splice(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], stable) -> tuple[int, int] | None:
    """Cut both token lists where they meet: a position where in each a token ends or
    starts, that `stable` proves to be a boundary of the whole text's tokens too, and from which
    their tokens agree as far as both reach. Returns the number of left tokens kept and right tokens dropped."""
    if not len(right[0]) or not len(left[1]):
        return None
    middle = (right[0][0] + left[1][-1]) // 2
    both = np.intersect1d(right[0], left[0])
    for p in both[np.argsort(np.abs(both - middle), kind="stable")].tolist():
        if stable(p):
            i, j = int(np.searchsorted(left[0], p)), int(np.searchsorted(right[0], p))
            # what stands before p and after p within the overlap is the same in both, but for the cut tokens at the rims
            n = min(len(left[0]) - i, len(right[0]) - j) - 1
            if n < 1 or np.array_equal(left[0][i : i + n], right[0][j : j + n]):
                return i, j
    return None


def count_chunked(text: str, encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text of any length: chunks that overlap, spliced at proven common boundaries.

    A boundary is proven where white space stands before it: the pre-tokenizer
    drops white space and no token, merge or normalisation reaches across it.
    Where an overlap holds none, or the lists don't agree there, the overlap is
    doubled, at last to the rest of the text, whose encoding is then exact.
    """

    def stable(p: int) -> bool:
        return p > 0 and text[p - 1].isspace() and text[p - 1] not in "\x1c\x1d\x1e\x1f"

    n = len(text)
    total, at, end = 0, 0, min(n, chunk)
    held = chunk_tokens(text, at, end, encode)
    while end < n:
        wide = overlap
        while True:
            start, stop = max(at, end - wide), min(n, end - wide + chunk) if wide < chunk else min(n, end + wide)
            stop = max(stop, min(n, end + 1))
            right = chunk_tokens(text, start, stop, encode)
            cut = splice(held, right, stable) if start > at else None
            if cut:
                total += cut[0]
                held = tuple(x[cut[1] :] for x in right)
                at, end = int(held[0][0]), stop
                break
            if start <= at:  # the overlap reaches back to the last splice: encode twice as much from there
                end = min(n, max(stop, at + 2 * (end - at)))
                held = chunk_tokens(text, at, end, encode)
                break
            wide *= 2
    return total + len(held[0])


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text.

    Null text: as empty, 0 bytes and 0 tokens. A row gives a row, repeated or
    not; further columns are ignored. Texts over `chunk` characters go chunk by
    chunk; a task's memory holds one chunk's tokens, however long the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, with_offsets = vocabulary(vocabulary_path), library_offsets(vocabulary_path)
        for ids, texts in text_groups(batches, ("doc_id", "text")):
            short = v.encode_many([t if t and len(t) <= chunk else None for t in texts])
            counts = [len(x) // 4 if not t or len(t) <= chunk else count_chunked(t, with_offsets, chunk, overlap) for t, x in zip(texts, short, strict=True)]
            sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
