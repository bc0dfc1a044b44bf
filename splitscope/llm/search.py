"""Op 11: ranked lexical search by range-maximum queries on posting lists.

Documents are cut into shards; a shard holds the posting lists of the items'
terms, sorted by document, and over them a sparse table that answers where the largest
impact of any stretch of a list lies. An item is searched in a shard best-first: the interval of documents
whose summed range maxima are the highest is split at the document of its largest impact, which is scored,
until no interval left can reach the worst of the best found so far, in this shard or earlier ones of the task.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitscope.llm.common import drop, map_arrow, save, text_groups

#: A shard is closed at so many documents, or so many postings.
SHARD_DOCUMENTS, SHARD_POSTINGS = 1 << 14, 1 << 20
#: An interval with at most so many postings is scored as a whole instead of being split further.
LEAF = 4096
#: Term occurrences of the items that are searched together; more items are searched block by block.
BLOCK_TERMS = 1 << 18

#: Bytes of terms stand for themselves, A-Z for a-z, all others for a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SHARD = "ids binary, known binary, lengths binary, terms binary, docs binary, tfs binary"
FOUND = "item_no long, doc_id long, score long"


def terms_of(text: bytes | str | None) -> list[bytes]:
    """Maximal runs of letters, digits and non-ASCII characters, only A-Z lower-cased."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return raw.translate(_FOLD).split()


# --- shards -------------------------------------------------------------------


def index_shards(docs: DataFrame, vocabulary: dict[bytes, int], shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """Shards of the documents: ids and numbers of terms, and the postings of the vocabulary's terms sorted by term and document.

    Documents without a term leave. No shuffle: a shard is a run of documents of one task, sorted by id (null ids last).
    """
    names = [c.split()[0] for c in SHARD.split(", ")]

    def shard(ids: list, lengths: list[np.ndarray], keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        n = np.concatenate(lengths)
        known = np.array([i is not None for i in ids], np.bool_)
        ids64 = np.array([i or 0 for i in ids], np.int64)
        order = np.lexsort((ids64, ~known))
        order = order[n[order] > 0]
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(order))
        key, tf = np.concatenate(keys), np.concatenate(counts)
        term, doc = key % size, place[key // size]
        by = np.lexsort((doc, term))
        columns = [ids64[order], known[order], n[order], term[by].astype(np.int32), doc[by].astype(np.int32), tf[by].astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names)

    size = max(1, len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, keys, counts, postings = [], [], [], [], 0
        for got, texts in text_groups(batches, ("doc_id", "text")):
            split = [terms_of(t) for t in texts]
            n = np.fromiter(map(len, split), np.int64, len(split))
            term = np.fromiter((x for s in split for x in map(vocabulary.get, s, repeat(-1))), np.int64, int(n.sum()))
            doc = np.repeat(np.arange(len(ids), len(ids) + len(split)), n)
            held = term >= 0
            key, count = np.unique(doc[held] * size + term[held], return_counts=True)
            ids += got
            lengths.append(n)
            keys.append(key)
            counts.append(count)
            postings += len(key)
            if len(ids) >= shard_documents or postings >= SHARD_POSTINGS:
                yield shard(ids, lengths, keys, counts)
                ids, lengths, keys, counts, postings = [], [], [], [], 0
        if ids:
            yield shard(ids, lengths, keys, counts)

    return map_arrow(docs.select("doc_id", F.col("text").cast("binary").alias("text")), run, SHARD)


def statistics(shards: DataFrame, size: int) -> tuple[int, int, list[int]]:
    """N, L and the documents of each term over all shards. A task sums its shards up; the driver gets one row for each term of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2, np.int64)
        for b in batches:
            for lengths, terms in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = np.frombuffer(lengths, np.int64)
                total[:size] += np.bincount(np.frombuffer(terms, np.int32), minlength=size)
                total[size:] += len(n), int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2)), pa.array(total)], ["term", "n"])

    summed = map_arrow(shards.select("lengths", "terms"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = [0] * (size + 2)
    for r in summed:
        n[r["term"]] = r["n"]
    return n[size], n[size + 1], n[:size]


def weight(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


class Postings:
    """The posting lists of a shard with their range-maximum table."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, docs: np.ndarray, tfs: np.ndarray, n_terms: int, n_documents: int, n_all: int):
        if len(lengths) and 75 * int(lengths.max()) * n_documents < 1 << 63:
            m = 25 + 75 * lengths * n_documents // max(1, n_all)
        else:
            m = np.array([25 + 75 * n * n_documents // max(1, n_all) for n in lengths.tolist()], np.int64)
        self.width = max(1, len(lengths))
        self.docs = docs.astype(np.int64)
        self.impact = 1_000_000_000 * tfs // (1000 * tfs + 8 * m[self.docs])
        self.keys = terms.astype(np.int64) * self.width + self.docs
        self.first = np.searchsorted(terms, np.arange(n_terms + 1))
        longest = int(np.diff(self.first).max(initial=0))
        levels = max(1, longest.bit_length())
        # peak[k, i]: place of the largest impact among the 2**k postings from i on; stretches never leave their list
        self.peak = np.zeros((levels, len(docs)), np.int32)
        self.peak[0] = np.arange(len(docs))
        for k in range(1, levels):
            half, n = 1 << k - 1, len(docs) - (1 << k) + 1
            a, b = self.peak[k - 1, :n], self.peak[k - 1, half : half + n]
            self.peak[k, :n] = np.where(self.impact[b] > self.impact[a], b, a)
        self.log = np.zeros(longest + 2, np.int64)
        for n in range(2, longest + 2):
            self.log[n] = self.log[n >> 1] + 1

    def largest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Place of the largest impact of each stretch [lo, hi), none of them empty."""
        k = self.log[hi - lo]
        a, b = self.peak[k, lo], self.peak[k, hi - (1 << k)]
        return np.where(self.impact[b] > self.impact[a], b, a)

    def _interval(self, terms: np.ndarray, weights: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple | None:
        """An interval of documents: the bound first, then where it is to be split, and its stretch of each list."""
        live = hi > lo
        if not live.any():
            return None
        terms, weights, lo, hi = terms[live], weights[live], lo[live], hi[live]
        top = self.largest(lo, hi)
        most = weights * self.impact[top]
        return int(most.sum()), int(self.docs[top[most.argmax()]]), terms, weights, lo, hi

    def search(self, terms: np.ndarray, weights: np.ndarray, floor: int, offer, leaf: int = LEAF) -> None:
        """Give offer(places, scores) every document that may score `floor` or more; it returns the floor from then on."""
        heap, serial = [], 0

        def push(x: tuple | None) -> None:
            nonlocal serial
            if x and x[0] >= floor:
                heapq.heappush(heap, (-x[0], serial, x))
                serial += 1

        push(self._interval(terms, weights, self.first[terms], self.first[terms + 1]))
        while heap and -heap[0][0] >= floor:
            bound, at, t, w, lo, hi = heapq.heappop(heap)[2]
            n = hi - lo
            if int(n.sum()) <= leaf:
                floor = offer(*self._scores(bound, w, lo, n))
                continue
            place = np.searchsorted(self.keys, t * self.width + at)
            hit = (place < hi) & (self.docs[np.minimum(place, len(self.docs) - 1)] == at)
            floor = offer(np.array([at]), np.array([int((w[hit] * self.impact[place[hit]]).sum())]))
            push(self._interval(t, w, lo, place))
            push(self._interval(t, w, place + hit, hi))

    def _scores(self, bound: int, weights: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores of all documents of an interval."""
        ends = np.cumsum(n)
        places = np.arange(int(ends[-1])) + np.repeat(lo - (ends - n), n)
        docs, parts = self.docs[places], np.repeat(weights, n) * self.impact[places]
        first = int(docs.min())
        if bound < 1 << 53:  # no sum is above the bound, so doubles hold them exactly
            total = np.bincount(docs - first, parts).astype(np.int64)
        else:
            total = np.zeros(int(docs.max()) - first + 1, np.int64)
            np.add.at(total, docs - first, parts)
        some = np.flatnonzero(total)
        return some + first, total[some]


# --- items --------------------------------------------------------------------


def item_blocks(items: DataFrame, block_terms: int = BLOCK_TERMS) -> Iterator[list[tuple[int, int | None, Counter]]]:
    """(number, item_id, terms with their repeats) of all items, in blocks of about `block_terms` occurrences."""
    block, held = [], 0
    for number, r in enumerate(items.select("item_id", "text").toLocalIterator()):
        terms = Counter(terms_of(r["text"]))
        block.append((number, r["item_id"], terms))
        held += terms.total()
        if held >= block_terms:
            yield block
            block, held = [], 0
    if block:
        yield block


def _search_block(docs: DataFrame, block: list[tuple[int, int | None, Counter]], k: int, shard_documents: int, leaf: int) -> DataFrame:
    """FOUND: of each task, the `k` best documents of each item of the block."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, _, terms in block for t in terms}))}
    size = len(vocabulary)
    shards, path = save(index_shards(docs, vocabulary, shard_documents), "search-shards")
    n_documents, n_all, df = statistics(shards, size)
    weights = np.array([weight(n_documents, x) if x else 0 for x in df], np.int64)
    wanted = []
    for number, _, terms in block:
        at = np.array([vocabulary[t] for t in terms], np.int64)
        w = np.array(list(terms.values()), np.int64) * weights[at] if len(at) else at
        wanted.append((number, at[w > 0], w[w > 0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, bool, int]]] = {number: [] for number, _, _ in wanted}
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                ids, known, lengths, terms, at, tfs = (np.frombuffer(x, t) for x, t in zip(row, (np.int64, np.bool_, np.int64, np.int32, np.int32, np.int64), strict=True))
                lists = Postings(lengths, terms, at, tfs, size, n_documents, n_all)
                for number, t, w in wanted:
                    held = best[number]

                    def offer(places: np.ndarray, scores: np.ndarray, held=held, ids=ids, known=known) -> int:
                        least = held[0][0] if len(held) == k else 1
                        for i in np.flatnonzero(scores >= least).tolist():
                            p = int(places[i])
                            # a null id comes after all others
                            x = (int(scores[i]), bool(known[p]), -int(ids[p]))
                            if len(held) < k:
                                heapq.heappush(held, x)
                            else:
                                heapq.heappushpop(held, x)
                        return held[0][0] if len(held) == k else 1

                    lists.search(t, w, held[0][0] if len(held) == k else 1, offer, leaf)
        rows = [(number, -i if known else None, score) for number, held in best.items() for score, known, i in held]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["item_no", "doc_id", "score"])

    found, done = save(map_arrow(shards, run, FOUND), "search-found")
    drop(docs.sparkSession, path)
    return found


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS, shard_documents: int = SHARD_DOCUMENTS, leaf: int = LEAF) -> DataFrame:
    """(item_id, rank, doc_id, score): the `k` best documents of each item, scores above 0 alone, equal scores by ascending doc_id.

    Null or empty texts of documents have no term and are never found; an item without
    a term, or with terms that no document holds, gives no row. A null doc_id comes after all others of its
    score. Rows of documents that repeat an id or a whole row count, and are ranked, one by one; each row of
    items is an item of its own. Extra columns are ignored. An empty table on either side gives an empty result.

    Items are taken in blocks of about `block_terms` term occurrences, whose terms and
    weights go to the tasks; each block reads all documents. A task hands on at most `k` rows for each item.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in item_blocks(items, block_terms):
        found = _search_block(docs, block, k, shard_documents, leaf)
        names = spark.createDataFrame([(n, i) for n, i, _ in block], "item_no long, item_id long")
        order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = out.unionByName(top.join(names, "item_no").select("item_id", "rank", "doc_id", "score"))
    return out


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
#: DuckDB SQL of search over the tables documents and benchmark.
SQL = f"""
WITH t AS (SELECT doc_id, {_TERMS} FROM documents),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} FROM benchmark) GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
            FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), corpus),
scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms)))))::BIGINT AS score
  FROM q JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (doc_id), corpus GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""
