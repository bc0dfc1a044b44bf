import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from splitscope.llm import search
from tests.llm.conftest import CLASHING, ODD, sentence

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(rows, items, k=10):
    docs = [(i, Counter(t)) for i, text in rows if (t := terms(text))]
    n_docs, n_all = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        want, scored = terms(text), []
        for i, c in docs:
            m = 100 - 75 + (75 * c.total() * n_docs) // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in want if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def mixed(seed, words=60, vocabulary=300):
    """A text whose words are as uneven as real ones'."""
    r = random.Random(seed)
    return " ".join(f"w{int(vocabulary ** r.random())}" for _ in range(r.randint(1, words)))


@pytest.fixture
def items(spark):
    def make(rows):
        return spark.createDataFrame(rows, "item_id long, text string").withColumns({k: F.lit(v) for k, v in {**CLASHING, "rank": 1, "score": 2, "doc_id": 3, "item_no": 4}.items() if k != "text"})

    return make


def test_terms():
    assert search.terms_of("Ab-C9 É_x\x00ÄB'z²") == [x.encode() for x in terms("Ab-C9 É_x\x00ÄB'z²")] == [x.encode() for x in ["ab", "c9", "É", "x", "Äb", "z²"]]


@pytest.mark.parametrize("leaf, shard, tasks", [(0, 7, 3), (20, 64, 2), (4096, 1 << 14, 8)])
def test_search_equals_brute_force(documents, items, leaf, shard, tasks):
    rows = [(i, mixed(i)) for i in range(400)] + [(1000 + i, mixed(i)) for i in range(0, 60, 3)] + [r[:2] for r in ODD]
    wanted = [(i, mixed(10_000 + i, 25)) for i in range(40)] + [(50, None), (51, ""), (52, "nowhere"), (53, "w1 w1 w1 w250"), (53, "w2"), (None, sentence(5))]
    got = search.search(documents(rows).repartition(tasks), items(wanted), shard_documents=shard, leaf=leaf)
    assert rows_of(got) == sorted(brute_force(rows, wanted), key=str)


def lists_of(rows, vocabulary, df_docs):
    """Postings of all rows as one shard, in this process."""
    counts = [Counter(terms(t)) for _, t in rows]
    data = sorted((vocabulary[t], d, n) for d, c in enumerate(counts) for t, n in c.items() if t in vocabulary)
    term, doc, tf = (np.array(x, np.int64) for x in zip(*data, strict=True))
    lengths = np.array([c.total() for c in counts], np.int64)
    return search.Postings(lengths, term.astype(np.int32), doc.astype(np.int32), tf, len(vocabulary), df_docs, int(lengths.sum()))


@pytest.mark.parametrize("leaf", [0, 30, 4096])
def test_search_of_one_shard(leaf):
    rows = [(i, mixed(i)) for i in range(500)]
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, x in rows for t in terms(x)}))}
    lists = lists_of(rows, vocabulary, len(rows))
    df = Counter(t for _, x in rows for t in set(terms(x)))
    for seed in range(30):
        text = mixed(5000 + seed, 20)
        want = Counter(t for t in terms(text) if t in vocabulary)
        at = np.array([vocabulary[t] for t in want])
        w = np.array([n * search.weight(len(rows), df[t]) for t, n in want.items()])
        found, scored = [], 0

        def offer(places, scores):
            nonlocal scored, found
            scored += len(places)
            found = sorted([*found, *((-int(s), int(p)) for p, s in zip(places, scores, strict=True) if s > 0)])[:10]
            return -found[-1][0] if len(found) == 10 else 1

        lists.search(at, w, 1, offer, leaf)
        assert [(p, -s) for s, p in found] == [(i, s) for _, _, i, s in brute_force(rows, [(0, text)])]
        assert scored <= len(rows)


def test_bounds_leave_documents_unscored():
    """A rare term's documents are found and the others' intervals fall under the bound."""
    rows = [(i, "common words here " + ("rare" if i % 100 == 7 else "else")) for i in range(2000)]
    vocabulary = {"common": 0, "rare": 1}
    scored = []

    def offer(places, scores):
        scored.extend(scores.tolist())
        return sorted(scored)[-10] if len(scored) >= 10 else 1

    lists_of(rows, vocabulary, 2000).search(np.array([0, 1]), np.array([1, 4000]), 1, offer, leaf=0)
    assert len(scored) < 60


def test_largest_of_any_stretch():
    rows = [(i, mixed(i)) for i in range(200)]
    vocabulary = {f"w{i}": i for i in range(1, 300)} | {"x": 0}
    lists = lists_of(rows, vocabulary, 200)
    r = random.Random(1)
    for t in range(300):
        a, b = int(lists.first[t]), int(lists.first[t + 1])
        for _ in range(20 if b > a else 0):
            lo = r.randrange(a, b)
            hi = r.randrange(lo + 1, b + 1)
            assert lists.impact[lists.largest(np.array([lo]), np.array([hi]))[0]] == lists.impact[lo:hi].max()


def test_scores_beyond_doubles_are_exact():
    rows = [(i, mixed(i)) for i in range(50)]
    vocabulary = {f"w{i}": i for i in range(300)}
    lists = lists_of(rows, vocabulary, 50)
    lo, n = lists.first[[1, 2]], np.diff(lists.first)[[1, 2]]
    small = lists._scores(1, np.array([3, 5]), lo, n)
    large = lists._scores(1 << 60, np.array([3, 5]), lo, n)
    assert small[0].tolist() == large[0].tolist() and small[1].tolist() == large[1].tolist()


def test_blocks_of_items_give_the_same(documents, items):
    rows = [(i, mixed(i)) for i in range(80)]
    wanted = [(i, mixed(900 + i, 12)) for i in range(12)]
    got = search.search(documents(rows), items(wanted), block_terms=30)
    assert rows_of(got) == sorted(brute_force(rows, wanted), key=str)


def test_empty_tables(documents, items):
    some = [(1, "a b c")]
    assert rows_of(search.search(documents(some).limit(0), items(some))) == []
    assert rows_of(search.search(documents(some), items(some).limit(0))) == []
    assert rows_of(search.search(documents([(1, None), (2, "--")]), items(some))) == []


def test_sql_equals_brute_force():
    rows = [(i, mixed(i)) for i in range(200)] + [(500, None), (501, ""), (502, "É-x W1"), (503, "É-x W1")]
    wanted = [(i, mixed(900 + i, 12)) for i in range(12)] + [(77, "é É w1"), (78, "zzz"), (79, None)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(wanted, columns=["item_id", "text"]))
    assert sorted(con.execute(search.SQL).fetchall()) == sorted(brute_force(rows, wanted))
