"""Op 12: collocations of 2 to 4 words from a weighted de Bruijn graph of each language.

Nodes are runs of 3 words, an edge is a run of 4 with its count. Counts of shorter
phrases aren't taken from the texts: a node's is the flow of the edges
that leave it plus the pieces that end with it, and so on down to pairs. Words
alone are counted by the pass that finds the frequent ones. Paths of edges through which a single flow goes are compacted, so that phrases within them are seen once.

Phrases under the threshold can't be parts of any at or above it. So pieces are cut
at words, then between pairs of words, that two filters of a fixed size show to be
too rare; a filter that is too full admits more, which costs time and changes nothing.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitscope.llm.common import BASE, drop, map_arrow, mix, save

#: Least count of a candidate, share (in hundredths) of its occurrences within a longer one that drops it, and phrases reported of a language.
LEAST, CONTAINED, TOP = 30, 80, 2000
#: Bits of each filter.
SLOTS = 1 << 25
#: Bytes of text that are worked on at once, and distinct words, or pairs, that a task holds before it hands them on.
GROUP_BYTES, HELD = 8 << 20, 1 << 19

_BREAK = b"\xff"
#: A-Z as a-z, a tab as a space, and what ends a piece as a byte that no UTF-8 text holds.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 255 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


def tokens(raw: bytes) -> list[bytes]:
    """Words in order, with _BREAK between pieces."""
    return raw.translate(_FOLD).replace(_BREAK, b" \xff ").split()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, texts joined by a break), about GROUP_BYTES at a time."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held[lang].append(text)
            size += len(text)
            if size >= GROUP_BYTES:
                yield from ((k, b"\n".join(v)) for k, v in held.items())
                held.clear()
                size = 0
    yield from ((k, b"\n".join(v)) for k, v in held.items())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("text <> ''").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


# --- filters ------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n): occurrences of every word; the row of a null word has those of all words."""

    def handed(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            c.pop(_BREAK, None)
            words, n = [None, *c], [c.total(), *c.values()]
            for lo in range(0, len(words), 1 << 16):
                part = [w and w.decode("utf-8", "surrogatepass") for w in words[lo : lo + (1 << 16)]]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.string()), pa.array(n[lo : lo + len(part)], pa.int64())], ["lang", "word", "n"])
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, raw in _groups(batches):
            counts[lang].update(tokens(raw))
            if sum(map(len, counts.values())) >= HELD:
                yield from handed(counts)
        yield from handed(counts)

    return map_arrow(_texts(docs), run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def bit_filter(slots: DataFrame) -> np.ndarray:
    """Bits of a filter in which the column slot (0 to SLOTS - 1) is set. SLOTS / 8 bytes reach the driver, however many rows there are."""
    at = F.col("slot") + 1
    parts = slots.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    bits = np.zeros(SLOTS // 8, np.uint8)
    for r in parts:
        bits[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


def in_filter(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7) & 1).astype(bool)


def _word_slot(lang: str, word: bytes) -> int:
    return zlib.crc32(lang.encode("utf-8", "surrogatepass") + b" " + word) % SLOTS


class Words(dict):
    """Numbers of a language's words as a task meets them; number 0 is the break."""

    def __init__(self, lang: str, frequent: np.ndarray):
        self.lang, self.frequent = lang, frequent
        self.words, self.hashes, self.kept = [""], [0], [False]
        self[_BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self.words)
        slot = _word_slot(self.lang, word)
        self.words.append(word.decode("utf-8", "surrogatepass"))
        self.kept.append(bool(self.frequent[slot >> 3] >> (slot & 7) & 1))
        self.hashes.append(int.from_bytes(hashlib.blake2b(word, digest_size=8, key=self.lang.encode("utf-8", "surrogatepass")[:64]).digest(), "little"))
        return i


def _numbered(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[tuple[Words, np.ndarray, np.ndarray, np.ndarray]]:
    """For each group: its words, their numbers in order (a break at the end), which are frequent, and a key of each neighbouring pair."""
    seen: dict[str, Words] = {}
    for lang, raw in _groups(batches):
        if sum(map(len, seen.values())) >= HELD:
            seen = {}
        words = seen.setdefault(lang, Words(lang, frequent))
        split = tokens(raw)
        ids = np.zeros(len(split) + 1, np.int64)
        ids[:-1] = np.fromiter(map(words.__getitem__, split), np.int64, len(split))
        kept, h = np.array(words.kept)[ids], np.array(words.hashes, np.uint64)[ids]
        yield words, ids, kept, mix(h[:-1] * BASE + h[1:])


def pair_slots(docs: DataFrame, frequent: np.ndarray, least: int) -> DataFrame:
    """slot: those of all pairs of neighbouring words found `least` times or more (and of any that share a 64-bit key with others, which a filter may hold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, _, kept, keys in _numbered(batches, frequent):
            held.append(keys[kept[:-1] & kept[1:]])
            size += len(held[-1])
            if size >= 4 * HELD:
                yield summed(held)
                held, size = [], 0
        if size:
            yield summed(held)

    def summed(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int32))], ["key", "n"])

    found = map_arrow(_texts(docs), run, "key long, n int").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return found.select(F.expr(f"key & {SLOTS - 1}L").alias("slot"))


# --- graph --------------------------------------------------------------------


def longest_grams(docs: DataFrame, frequent: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """(lang, gram, words, n): from each word on, the run of 4 words, or the 3 or 2 that are left at the end of a piece, space-joined.

    Pieces are cut where the filters say so: no phrase across a cut reaches the threshold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, ids, kept, keys in _numbered(batches, frequent):
            linked = np.zeros(len(ids) + 2, bool)
            linked[: len(keys)] = kept[:-1] & kept[1:] & in_filter(pairs, (keys & np.uint64(SLOTS - 1)).astype(np.int64))
            at = np.flatnonzero(linked)
            if not len(at):
                continue
            gram, on = [ids[at], ids[at + 1]], np.ones(len(at), bool)
            for k in range(2, 4):
                on = on & linked[at + k - 1]
                gram.append(np.where(on, ids[np.minimum(at + k, len(ids) - 1)], 0))
            first, a = np.unique(gram[0] << 32 | gram[1], return_inverse=True)
            second, b = np.unique(gram[2] << 32 | gram[3], return_inverse=True)
            both, n = np.unique(a * len(second) + b, return_counts=True)
            x, y = first[both // len(second)], second[both % len(second)]
            quads = np.stack([x >> 32, x & 0xFFFFFFFF, y >> 32, y & 0xFFFFFFFF])
            size = (quads > 0).sum(0)
            name = words.words
            for lo in range(0, len(both), 1 << 16):
                part = quads[:, lo : lo + (1 << 16)]
                made = [" ".join([name[i] for i in q if i]) for q in zip(*part.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([words.lang] * len(made), pa.string()), pa.array(made, pa.string()), pa.array(size[lo : lo + len(made)].astype(np.int32)), pa.array(n[lo : lo + len(made)])],
                    ["lang", "gram", "words", "n"],
                )

    return map_arrow(_texts(docs), run, "lang string, gram string, words int, n long").groupBy("lang", "gram", "words").agg(F.sum("n").alias("n"))


def _first(phrase: Column | str, k: Column | int) -> Column:
    """The first k words of a phrase, or the last -k."""
    return F.call_function("substring_index", F.col(phrase) if isinstance(phrase, str) else phrase, F.lit(" "), k if isinstance(k, Column) else F.lit(k))


def flow(longer: DataFrame, ends: DataFrame, words: int) -> DataFrame:
    """(lang, gram, n) of the runs of `words` words: what leaves them into longer runs, and the pieces that end with them."""
    out = longer.select("lang", _first("gram", words).alias("gram"), "n")
    return out.unionByName(ends.where(F.col("words") == words).select("lang", "gram", "n")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def compacted(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, str]:
    """(lang, path, n): the edges, those in a row through nodes that a single flow passes joined to one path of more words. Also the table's path.

    A node is passed by a single flow if an edge into it and one out of it
    each carry its whole count. Edges in a row find the last of their path by doubling
    pointers, each step a table in the shared folder. A path is no longer than the longest piece of a document.
    No cycle is made of such nodes alone: a piece that goes round must come in or begin somewhere.
    """
    spark = edges.sparkSession
    out = edges.select("lang", "gram", "n", _first("gram", 3).alias("node"))
    into = edges.select("lang", F.col("gram").alias("before"), "n", _first("gram", -3).alias("node"))
    single = nodes.select("lang", F.col("gram").alias("node"), "n")
    links = into.join(single, ["lang", "node", "n"]).join(out, ["lang", "node", "n"]).select("lang", F.col("before").alias("gram"), F.col("gram").alias("next"))
    held, path = save(
        edges.join(links, ["lang", "gram"], "left").select("lang", "gram", "n", F.coalesce("next", "gram").alias("last"), F.when(F.col("next").isNotNull(), 1).otherwise(0).cast("long").alias("steps")),
        "paths",
    )
    while True:
        far = held.where("steps > 0").select("lang", F.col("gram").alias("last"), F.col("last").alias("further"), F.col("steps").alias("more"))
        step = held.join(far, ["lang", "last"], "left").select("lang", "gram", "n", F.coalesce("further", "last").alias("last"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        after, new = save(step, "paths")
        before, now = (x.agg(F.sum("steps")).first()[0] for x in (held, after))
        drop(spark, path)
        held, path = after, new
        if before == now:
            break
    row = held.select("lang", "last", "n", F.struct((-F.col("steps")).alias("at"), F.col("gram")).alias("edge"))
    joined = row.groupBy("lang", "last", "n").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    words = F.concat_ws(" ", F.element_at("edges", 1)["gram"], F.transform(F.slice("edges", 2, F.greatest(F.size("edges") - 1, F.lit(0))), lambda x: _first(x["gram"], -1)))
    paths, done = save(joined.select("lang", words.alias("path"), "n"), "paths")
    drop(spark, path)
    return paths, done


def contained(paths: DataFrame, triples: DataFrame) -> DataFrame:
    """(lang, gram, within): for phrases of 2 or 3 words, the largest count of a longer one that holds them."""

    def runs(df: DataFrame, column: str, words: int) -> DataFrame:
        split = F.split(column, " ", -1)
        at = F.sequence(F.lit(1), F.size(split) - words + 1)
        return df.select("lang", F.explode(F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(split, i, words), " ")))).alias("gram"), "n")

    held = runs(paths, "path", 3).unionByName(runs(paths, "path", 2)).unionByName(runs(triples, "gram", 2))
    return held.groupBy("lang", "gram").agg(F.max("n").alias("within"))


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates (lang, gram, a) with l, r and score of their lowest-scoring cut; of equal scores the shortest first part."""
    cut = F.explode(F.sequence(F.lit(1), F.size(F.split("gram", " ", -1)) - 1))
    parts = candidates.select("lang", "gram", "a", cut.alias("k")).withColumns({"first": _first("gram", F.col("k")), "rest": _first("gram", F.col("k") - F.size(F.split("gram", " ", -1)))})
    left = counts.select("lang", F.col("gram").alias("first"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("gram").alias("rest"), F.col("n").alias("r"))
    score = F.expr("CAST(2000000 AS DECIMAL(10, 0)) * CAST(a AS DECIMAL(19, 0)) div (CAST(l AS DECIMAL(19, 0)) + r)")
    each = parts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).select("lang", "gram", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    return each.groupBy("lang", "gram", "a").agg(F.min("cut").alias("cut")).select("lang", "gram", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the `top` best phrases of 2 to 4 words found `least` times or more.

    A null lang counts as `und`; null and empty texts, and texts without a word, give
    nothing. A text counts as often as it stands there. doc_id and extra columns are ignored. An empty
    table, or one without a phrase that is frequent enough, gives an empty result. Equal scores and counts go by the phrase's bytes.
    """
    spark = docs.sparkSession
    enough = F.col("n") >= least
    words, p1 = save(word_counts(docs).where(enough | F.col("word").isNull()), "phrase-words")
    slot = F.crc32(F.concat_ws(" ", "lang", "word").cast("binary")) % SLOTS
    frequent = bit_filter(words.where("word IS NOT NULL").select(slot.alias("slot")))
    totals = words.where("word IS NULL").select("lang", F.col("n").alias("all_words"))
    slots, p0 = save(pair_slots(docs, frequent, least), "phrase-pairs")
    pairs = bit_filter(slots)
    drop(spark, p0)
    grams, p2 = save(longest_grams(docs, frequent, pairs), "phrase-grams")
    n3, p3 = save(flow(grams.where("words = 4"), grams, 3), "phrase-nodes")
    n2, p4 = save(flow(n3, grams, 2), "phrase-nodes")
    counts, p5 = save(
        grams.where((F.col("words") == 4) & enough).select("lang", "gram", "n", F.lit(4).alias("words"))
        .unionByName(n3.where(enough).withColumn("words", F.lit(3)))
        .unionByName(n2.where(enough).withColumn("words", F.lit(2)))
        .unionByName(words.where("word IS NOT NULL").select("lang", F.col("word").alias("gram"), "n", F.lit(1).alias("words"))),
        "phrase-counts",
    )
    drop(spark, p2, p3, p4)
    edges, nodes = counts.where("words = 4"), counts.where("words = 3")
    paths, p6 = compacted(edges, nodes)
    within = contained(paths, nodes.select("lang", "gram", "n"))
    candidates = counts.where("words > 1").select("lang", "gram", F.col("n").alias("a"))
    apart = F.col("within").isNull() | (100 * F.col("within").cast("decimal(19,0)") < CONTAINED * F.col("a").cast("decimal(19,0)"))
    alone = candidates.join(within, ["lang", "gram"], "left").where(apart).select("lang", "gram", "a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "gram")
    best = scored(alone, counts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), F.col("gram").alias("phrase"), "a", "l", "r", F.col("all_words").alias("n"), "score")
    done, _ = save(out, "phrases")
    drop(spark, p1, p5, p6)
    return done


#: DuckDB SQL of collocations over the table documents.
SQL = r"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS (
  SELECT lang, w[i:i + k - 1] AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k))),
f AS (SELECT lang, g, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
cuts AS (
  SELECT c.lang, c.g, c.n AS a, k, x.n AS l, y.n AS r, ((2000000::HUGEINT * c.n) // (x.n + y.n))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1) c
  JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
within AS (
  SELECT lang, sub, max(n) AS n
  FROM (SELECT lang, n, g[i:i + k - 1] AS sub
        FROM (SELECT lang, g, n, k, unnest(range(1, len(g) - k + 2)) AS i FROM f, (SELECT unnest([2, 3]) AS k) WHERE len(g) > k))
  GROUP BY ALL),
ranked AS (
  SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, array_to_string(c.g, ' ')) AS rank,
         array_to_string(c.g, ' ') AS phrase, a, l, r, totals.n AS n, score
  FROM lowest c JOIN totals USING (lang) LEFT JOIN within ON within.lang = c.lang AND within.sub = c.g
  WHERE within.n IS NULL OR 100 * within.n < 80 * a)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
