import random
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from splitscope.llm import phrases
from tests.llm.conftest import CLASHING, ODD


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for p in re.split("[.,;:!?\x0a-\x0d]", low) if (w := re.findall("[^ \t]+", p))]


def brute_force(rows, least=30, top=2000):
    """rows: (lang, text)"""
    out = []
    by_lang = defaultdict(list)
    for lang, text in rows:
        by_lang[lang if lang is not None else "und"] += pieces(text)
    for lang, found in by_lang.items():
        f = Counter(tuple(p[i : i + k]) for p in found for k in range(1, 5) for i in range(len(p) - k + 1))
        n = sum(map(len, found))
        hits = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        longer = defaultdict(int)
        for g, a in hits.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    longer[g[i : i + k]] = max(longer[g[i : i + k]], a)
        ranked = []
        for g, a in hits.items():
            if 100 * longer[g] >= 80 * a and longer[g]:
                continue
            score, _, left, right = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            ranked.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.fixture
def texts(spark):
    def make(rows, tasks=3):
        df = spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string").repartition(tasks)
        return df.withColumns({k: F.lit(v) for k, v in {**CLASHING, "gram": 1, "n": 2, "word": "w", "words": 4, "phrase": 5, "rank": 6, "slot": 7}.items()})

    return make


def prose(seed, words, vocabulary):
    r = random.Random(seed)
    return "".join(r.choice(["W", "w"]) + str(int(vocabulary ** r.random())) + r.choice([" ", " ", " ", " ", "  \t", ". ", ", ", "\n", "\x0b", "\xa0"]) for _ in range(words))


FIXED = "the quick brown fox jumps over the lazy dog; new york city, new york city hall. san marino "
ROWS = (
    [("en", prose(i, 200, 60)) for i in range(40)]
    + [("de", prose(100 + i, 150, 30)) for i in range(20)]
    + [(None, FIXED)] * 40
    + [("und", "new york! " + FIXED.upper())] * 9
    + [("fr", FIXED)] * 14
    + [("es", "a a a a a a a a. " * 12), ("es", "x y x y x y x y x y " * 9)]
    + [("xx", t) for _, t, *_ in ODD]
    + [("", "é ü é ü " * 40), ("a b", "é ü é ü " * 40)]
)


def test_collocations_equal_brute_force(texts):
    want = brute_force(ROWS)
    assert {x[0] for x in want} >= {"en", "de", "und", "es", "xx", "", "a b"} and "fr" not in {x[0] for x in want}
    assert rows_of(phrases.collocations(texts(ROWS, 7))) == want


def test_threshold_and_top(texts):
    rows = [("en", prose(i, 200, 60)) for i in range(10)]
    assert rows_of(phrases.collocations(texts(rows), least=5, top=7)) == brute_force(rows, 5, 7)


def test_small_groups_and_full_filters_change_nothing(texts, monkeypatch):
    """Filters that admit everything leave the counts as they are."""
    monkeypatch.setattr(phrases, "bit_filter", lambda slots: __import__("numpy").full(phrases.SLOTS // 8, 255, "uint8"))
    rows = [("en", prose(i, 120, 40)) for i in range(12)]
    assert rows_of(phrases.collocations(texts(rows))) == brute_force(rows)


def test_paths_are_compacted(texts, spark):
    edges = spark.createDataFrame(
        [("en", "a b c d", 40), ("en", "b c d e", 40), ("en", "c d e f", 40), ("en", "d e f g", 35), ("en", "d e f h", 5), ("en", "z b c x", 30), ("de", "a b c d", 9), ("en", "q q q q", 50)],
        "lang string, gram string, n long",
    )
    nodes = spark.createDataFrame(
        [("en", "a b c", 40), ("en", "b c d", 40), ("en", "c d e", 40), ("en", "d e f", 40), ("en", "e f g", 35), ("en", "z b c", 30), ("en", "b c x", 30), ("de", "b c d", 9), ("en", "q q q", 60)],
        "lang string, gram string, n long",
    )
    paths, _ = phrases.compacted(edges, nodes)
    assert sorted(map(tuple, paths.collect())) == [
        ("de", "a b c d", 9), ("en", "a b c d e f", 40), ("en", "d e f g", 35), ("en", "d e f h", 5), ("en", "q q q q", 50), ("en", "z b c x", 30),
    ]
    within = {(r["lang"], r["gram"]): r["within"] for r in phrases.contained(paths, nodes).collect()}
    assert within["en", "c d e"] == 40 and within["en", "e f"] == 40 and within["en", "f g"] == 35 and within["de", "c d"] == 9 and within["en", "q q"] == 60


def test_scores_beyond_64_bits(spark):
    big = 6_000_000_000_000
    candidates = spark.createDataFrame([("en", "a b", big)], "lang string, gram string, a long")
    counts = spark.createDataFrame([("en", "a", big + 1), ("en", "b", big + 2)], "lang string, gram string, n long")
    assert [tuple(r) for r in phrases.scored(candidates, counts).collect()] == [("en", "a b", big, big + 1, big + 2, 2000000 * big // (2 * big + 3))]


def test_empty_tables(texts):
    assert rows_of(phrases.collocations(texts(ROWS).limit(0))) == []
    assert rows_of(phrases.collocations(texts([("en", None), ("en", " .;"), ("en", "too few")]))) == []


def test_sql_equals_brute_force():
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(ROWS, columns=["lang", "text"]))
    assert sorted(con.execute(phrases.SQL).fetchall()) == brute_force(ROWS)
