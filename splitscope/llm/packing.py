"""Op 6: packing token lists into sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from splitscope.llm.bpe import vocabulary
from splitscope.llm.common import map_arrow, text_groups

#: Windows that are balanced together, and the longest piece that a document's tail is cut into.
WINDOWS, PIECE = 48, 512
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> tuple[list[list[int]], int]:
    """Split items into k sets of near-equal sums (largest differencing method, k ways).

    A partial partition is k sums in falling order, less the smallest. The two
    with the largest differences are merged, the largest sum of one with
    the smallest of the other, until one is left. Returns the items of each set and the largest sum.
    """
    if not sizes:
        return [[] for _ in range(k)], 0
    nodes: list[tuple] = []  # of each merged partition: its two parts and the order of its sums
    heap = []
    for i, n in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = n
        heap.append((-n, i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        nodes.append((i, j, order))
        heapq.heappush(heap, (-int(sums[0]), len(sizes) + len(nodes) - 1, sums))
    # hand the sets' numbers down from the last partition to the items
    labels: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)}
    sets: list[list[int]] = [[] for _ in range(k)]
    for n in range(len(nodes) - 1, -1, -1):
        i, j, order = nodes[n]
        own = np.empty(k, np.int64)
        own[order] = labels.pop(len(sizes) + n)
        labels[i], labels[j] = own, own[::-1]
    for i, own in labels.items():
        sets[own[0]].append(i)
    return sets, max(sum(sizes[i] for i in s) for s in sets)


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most `capacity`: as few as the sum allows, one more whenever one runs over."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        sets, largest = differencing(sizes, k)
        if largest <= capacity:
            return [s for s in sets if s]
        k += 1


def pack_documents(docs: DataFrame, vocabulary_path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents, each id in exactly one, packed into sequences of at most `capacity` ids.

    A document's ids are its text's, then `end_id`; a null text is empty and
    has `end_id` alone. Whole windows of a long document are sequences of their own;
    its tail is cut into pieces of at most PIECE ids, and the tails of neighbouring
    documents are packed together, WINDOWS at a time. Equal rows are packed as often
    as they stand there. No shuffle; sequence ids hold the partition's number, so
    they are unique without coordination.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_path)
        sequence = TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4").tobytes()
        out: list[tuple] = []
        tails: list[tuple] = []
        waiting = 0

        def piece(doc_id, ids: bytes, start: int, stop: int) -> tuple:
            return doc_id, start, stop - start, zlib.crc32(memoryview(ids)[4 * start : 4 * stop]), len(ids) // 4

        def settle() -> None:
            nonlocal sequence, waiting
            for window in pack([p[2] for p in tails], capacity):
                offset = 0
                for i in sorted(window):
                    out.append((*tails[i], sequence, offset))
                    offset += tails[i][2]
                sequence += 1
            tails.clear()
            waiting = 0

        for doc_ids, texts in text_groups(batches, ("doc_id", "text")):
            for doc_id, ids in zip(doc_ids, v.encode_many(texts), strict=True):
                ids += end
                n = len(ids) // 4
                whole = n - n % capacity
                for start in range(0, whole, capacity):
                    out.append((*piece(doc_id, ids, start, start + capacity), sequence, 0))
                    sequence += 1
                parts = -(-(n - whole) // PIECE)
                for i in range(parts):
                    tails.append(piece(doc_id, ids, whole + (n - whole) * i // parts, whole + (n - whole) * (i + 1) // parts))
                waiting += n - whole
                # a tail is shorter than a window, so WINDOWS of them hold what waits, with some room: that they are too few is rare
                if waiting >= (WINDOWS - 1) * capacity:
                    settle()
            if out:
                yield rows(out)
                out = []
        settle()
        if out:
            yield rows(out)

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)


def rows(out: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)
