import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from splitscope.llm import dealt, graph, line_dedup, linking, near_dedup, suffix_dedup
from tests.llm.conftest import ODD, sentence


def edited(text: str, seed: int, n: int) -> str:
    r = random.Random(seed)
    words = text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = f"z{r.randrange(10**6)}"
    return " ".join(words)


class Sets:
    """Components by plain union-find."""

    def __init__(self, nodes):
        self.up = {x: x for x in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def unite(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components_of_random_graphs(spark):
    r = random.Random(2)
    for n, m in ((30, 20), (200, 150), (50, 200)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(1000 + i, 1001 + i) for i in range(40)]
        sets = Sets({x for e in edges for x in e})
        for a, b in edges:
            sets.unite(a, b)
        found, _ = graph.components(spark.createDataFrame(edges, "a long, b long"))
        linked = {x for a, b in edges if a != b for x in (a, b)}
        assert dict(map(tuple, found.collect())) == {x: sets.find(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long"))[0].collect() == []


@pytest.mark.parametrize("small", [2, 10, 1000])
def test_linking_finds_all_links_of_a_bucket(spark, monkeypatch, small):
    """Sets of neighbouring numbers in one bucket: most links are not with a pivot."""
    monkeypatch.setattr(linking, "SMALL", small)
    r = random.Random(4)
    sets = {x: set(range(x, x + r.randint(8, 14))) | {1000 + x % 5} for x in r.sample(range(120), 60)}
    share = 0.6

    def alike(a, b):
        return len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])

    rows = [(x, k, len(sets[x])) for x in sets for k in (1, 2 + x % 3)]
    checked = []

    def verify(pairs, texts):
        got = [(p["a"], p["b"]) for p in pairs.collect()]
        checked.extend(got)
        return spark.createDataFrame([p for p in got if alike(*p)], "a long, b long")

    elements = spark.createDataFrame([(x, len(s), k) for x, s in sets.items() for k in s], "id long, n long, key long")
    found, _ = linking.link_components(spark.createDataFrame(rows, "id long, key long, n long"), lambda ids: ids, verify, lambda texts: elements.join(texts, "id", "left_semi"), share)
    u = Sets(sets)
    for a in sets:
        for b in sets:
            if a < b and alike(a, b):
                u.unite(a, b)
    got = dict(map(tuple, found.collect()))
    assert {x: got.get(x, x) for x in sets} == {x: u.find(x) for x in sets}
    assert len(checked) == len(set(checked))


def test_prefixes_hold_what_components_share(spark):
    """A large component of copies and one row that has a passage of theirs: only the passage can lead to a pair."""
    sets = {i: (1, {*range(20), 1000 + i // 2}) for i in range(40)} | {99: (2, {0, 1, 2, *range(2000, 2003)})}
    rows = [(i, label, len(x), k) for i, (label, x) in sets.items() for k in x]
    got = linking._prefixes(spark.createDataFrame(rows, "id long, label long, n long, key long"), 0.5).collect()
    assert got and {r["key"] for r in got} <= {0, 1, 2}
    assert all(18 < r["at"] <= 21 for r in got if r["id"] != 99) and sorted(r["at"] for r in got if r["id"] == 99) == [4]


def test_only_shared_keys_are_dealt_with_their_rows(spark, monkeypatch):
    saved = {}

    def save(df, name):
        table, path = graph.save(df, name)
        saved.setdefault(name, table.count())
        return table, path

    monkeypatch.setattr(linking, "save", save)
    rows = [(i, 100 + i, 4) for i in range(50)] + [(i, i % 2, 4) for i in range(6)] + [(7, 107, 4)] * 3
    none = spark.createDataFrame([], "a long, b long")
    elements = spark.createDataFrame([], "id long, n long, key long, label long")
    found, _ = linking.link_components(spark.createDataFrame(rows, "id long, key long, n long"), lambda ids: ids, lambda pairs, texts: none, lambda texts: elements, 0.5)
    assert found.collect() == [] and saved["shared-keys"] == 2 and saved["members"] == 6


def test_pairs_that_cannot_be_alike_are_not_made(spark):
    """Rows outside the largest component that share rare elements with all of it, but too few: no pair. Rows alike enough meet."""
    share = 0.8
    core = set(range(1000, 1040))
    sets = {i: (1, core | {i}) for i in range(30)}
    sets |= {100 + i: (100 + i, {*range(1000, 1033), *range(2000, 2008)}) for i in range(30)}  # 33 of 49 elements with each copy
    sets |= {200: (200, core | {3000, 3001})}
    sets |= {300 + i: (300 + i, {*range(2000, 2008), *range(1033, 1040), *range(4000 + 40 * i, 4030 + 40 * i)}) for i in range(100)}  # what only one of the two has is common elsewhere
    rows = [(i, label, len(x), k) for i, (label, x) in sets.items() for k in x]
    prefixes = linking._prefixes(spark.createDataFrame(rows, "id long, label long, n long, key long"), share)
    got = {(r["a"], r["b"]) for r in linking._across(prefixes, share, True).collect()}
    want = {(a, b) for a in sets for b in sets if a > b and sets[a][0] != sets[b][0] and len(sets[a][1] & sets[b][1]) >= share * len(sets[a][1] | sets[b][1])}
    assert {(200, i) for i in range(30)} <= want <= got
    assert not any(a in range(100, 130) and b < 30 for a, b in got)


def test_keys_of_several_tables_are_dealt_one_after_the_other(spark, monkeypatch):
    """The same result, no table but one is dealt at a time, and what bands were read from is gone before texts are fetched."""
    saved, seen = [], []
    monkeypatch.setattr(linking, "save", lambda df, name: saved.append(name) or graph.save(df, name))
    sets = {i: {i // 3, 100 + i % 4} for i in range(24)}
    rows = [(i, k, 1) for i, x in sets.items() for k in x]
    schema = "id long, key long, n long"
    held, path = graph.save(spark.createDataFrame(rows, schema), "held")

    def fetch(ids):
        seen.extend(r["id"] for r in ids.collect())
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        assert folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder) is (len(seen) > 24)
        return ids

    def verify(pairs, texts):
        return pairs.where("a div 3 = b div 3").select("a", "b")

    def elements(texts):
        return spark.createDataFrame(rows, "id long, key long, n long").join(texts, "id", "left_semi")

    parts, _ = linking.link_components([held.where("key < 100"), held.where("key >= 100")], fetch, verify, elements, 0.5, (path,))
    assert saved.count("shared-keys") == saved.count("shared-bands") == 2 and sorted(seen) == list(range(24))
    assert dict(map(tuple, parts.collect())) == {i: i // 3 * 3 for i in range(24)}
    seen.extend([-1])
    held, path = graph.save(spark.createDataFrame(rows, schema), "held")
    whole, _ = linking.link_components(held, fetch, verify, elements, 0.5)
    assert dict(map(tuple, whole.collect())) == {i: i // 3 * 3 for i in range(24)}


# --- op 3 ---


def shingles(text):
    words = near_words(text)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected_near(rows):
    sets = {i: shingles(t) for i, t in rows}
    u = Sets(sets)
    items = sorted(sets)
    for x in items:
        for y in items:
            a, b = sets[x], sets[y]
            if x < y and a and b and 100 * len(a & b) >= 75 * len(a | b):
                u.unite(x, y)
    return {i: (len(sets[i]), u.find(i), u.find(i) == i) for i in sets}


def test_near_duplicates_equal_brute_force(documents):
    base = [sentence(i, n) for i, n in enumerate((5, 8, 60, 200, 600, 1500))]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(90):
        t = base[k % len(base)]
        rows.append((100 + k, edited(t, k, k % 12)))
    rows += [(300, base[2].upper()), (301, base[2].replace(" ", "\n\t")), (302, None), (303, ""), (304, " "), (305, "a b c d"), (306, "A b c  d"), (307, "a b c d e")]
    rows += [(400 + k, sentence(3, 200) + " " + sentence(77, k)) for k in range(40)]  # a chain of growing texts
    got = near_dedup.near_duplicates(documents(rows)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == expected_near(rows) and len(got) == len(rows)


def test_near_duplicates_of_odd_rows(documents):
    got = near_dedup.near_duplicates(documents(ODD)).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[6]["component_id"] == by[5]["component_id"] == 5 and not by[6]["kept"]
    assert by[1]["n_shingles"] == 0 and by[1]["kept"] and by[3]["component_id"] == 3
    assert by[None]["component_id"] is None and not by[None]["kept"]
    assert near_dedup.near_duplicates(documents([])).collect() == []
    docs = documents([r for r in ODD if r[0] is not None])
    out = near_dedup.drop_near_duplicates(docs)
    assert out.columns == docs.columns and sorted(r[0] for r in out.collect()) == [1, 2, 3, 4, 5, 7, 9, 10, 11]


def test_drop_keeps_documents_that_are_alike_to_none(documents):
    """Null ids and ids with several texts: a text goes only if its component has another document."""
    a, b, c, d, e = (sentence(8100 + i, 80) for i in range(5))
    rows = [(1, a), (1, b), (1, a), (2, edited(b, 1, 1)), (None, c), (None, c), (None, edited(a, 2, 1)), (None, d), (3, d.upper()), (3, e), (4, None), (4, ""), (None, None)]
    docs = documents(rows)
    out = near_dedup.drop_near_duplicates(docs)
    want = [(1, a), (1, b), (None, c), (3, d.upper()), (3, e), (4, None), (4, ""), (None, None)]
    assert out.columns == docs.columns and sorted(((x["doc_id"], x["text"]) for x in out.collect()), key=str) == sorted(want, key=str)
    # of null ids alone, one stays
    alone = near_dedup.drop_near_duplicates(documents([(None, c), (None, edited(c, 1, 1))])).collect()
    assert len(alone) == 1 and near_dedup.drop_near_duplicates(documents([])).collect() == []


def test_sketch_estimates_similarity():
    r = np.random.default_rng(0)
    errors = []
    for share in (0.2, 0.5, 0.75, 0.9):
        x = np.unique(r.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2))
        n = len(x)
        k = int(n * share)
        a, b = x[: (n + k) // 2], x[(n - k) // 2 :]
        got = near_dedup.estimate(near_dedup.sketch(np.sort(a))[None], near_dedup.sketch(np.sort(b))[None])[0]
        errors.append(abs(got - len(np.intersect1d(a, b)) / len(np.union1d(a, b))))
    assert max(errors) < 5 * 0.045


# --- op 7 ---


def expected_lines(rows):
    places = defaultdict(list)
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            x = " ".join(x.lower().split())
            if len(x) >= line_dedup.SHORTEST:
                places[x].append((i, k))
    u = Sets(places)
    q = line_dedup.SHINGLE
    sets = {x: {x[i : i + q] for i in range(len(x) - q + 1)} for x in places}
    for x in sets:
        for y in sets:
            if x < y and 100 * len(sets[x] & sets[y]) >= line_dedup.PERCENT * len(sets[x] | sets[y]):
                u.unite(x, y)
    groups = defaultdict(list)
    for x, p in places.items():
        groups[u.find(x)] += p
    gone = defaultdict(list)
    for p in groups.values():
        for i, k in sorted(p)[1:]:
            gone[i].append(k)
    return {i: sorted(gone[i]) for i, _ in rows}


def test_lines_equal_brute_force(documents):
    base = [sentence(i, 6 + 3 * i) for i in range(12)]
    r = random.Random(1)
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(0, 6)):
            x = r.choice(base)
            lines.append(r.choice([x, x.upper(), x + ".", edited(x, i, 1), "  " + x, "short", "", sentence(1000 + r.randrange(10**6), 8)]))
        rows.append((i, "\n".join(lines)))
    got = {x["doc_id"]: x["removed"] for x in line_dedup.line_duplicates(documents(rows)).collect()}
    assert got == expected_lines(rows)


def test_lines_of_odd_rows(documents):
    got = line_dedup.line_duplicates(documents(ODD)).collect()
    assert len(got) == len(ODD)
    by = {x["doc_id"]: x for x in got}
    assert by[5]["n_removed"] == 0 and by[6]["removed"] == [0] and by[1]["n_lines"] == 1 and by[3]["n_removed"] == 0
    assert line_dedup.line_duplicates(documents([])).collect() == []
    docs = documents(ODD)
    out = line_dedup.without_duplicate_lines(docs)
    assert out.columns == docs.columns
    left = {x["doc_id"]: x["text"] for x in out.collect()}
    assert 6 not in left and left[1] is None and left[5] == sentence(5) and left[2] == ""


def test_band_keys_find_similar_lines():
    r = random.Random(3)
    hits = 0
    for k in range(200):
        a = sentence(k, 30)
        b = a[:90] + r.choice("xyz") + a[91:]
        x = line_dedup.band_keys([a, b])
        assert (line_dedup.band_keys([a])[0] == x[0]).all()
        hits += bool((x[0] == x[1]).any())
    assert hits == 200


def test_lines_alike_at_085_are_found(documents):
    """One character changed inside lines of 100 to 130: a similarity between 0.85 and 0.9. The limit stands here as a number."""
    rows = []
    for k in range(40):
        a = sentence(7000 + k, 40)[: 100 + k % 31]
        b = a[:50] + "Z" + a[51:]
        sets = [{x[i : i + 7] for i in range(len(x) - 6)} for x in (a.lower(), b.lower())]
        share = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        assert 0.85 <= share < 0.9
        rows += [(2 * k, a), (2 * k + 1, b)]
    got = {x["doc_id"]: x["removed"] for x in line_dedup.line_duplicates(documents(rows)).collect()}
    assert got == {i: [0] * (i % 2) for i, _ in rows}


def test_lines_are_banded_in_small_parts(monkeypatch):
    lines = [sentence(i, 3 + i % 40) for i in range(200)] + ["a" * 5000, "abcdefg"]
    whole = line_dedup.band_keys(lines)
    sizes = []
    part = line_dedup._band_keys
    monkeypatch.setattr(line_dedup, "TOGETHER", 1000)
    monkeypatch.setattr(line_dedup, "_band_keys", lambda x: sizes.append(sum(map(len, x[1:]))) or part(x))
    assert (line_dedup.band_keys(lines) == whole).all() and whole.shape == (202, line_dedup.BANDS)
    assert len(sizes) > 10 and max(sizes) <= 1000


def test_pairs_are_compared_together(monkeypatch):
    """The same links as by sets; repeats within a line count once; no call takes many long lines."""
    r = random.Random(11)
    pairs = [("abcdefg", "abcdefg"), ("a" * 30, "a" * 9), ("abcdefg", "abcdefh"), ("x" * 20_000, "x" * 19_000 + "y")]
    for k in range(300):
        a = sentence(500 + k, r.randint(2, 40))
        b = list(a + a[: 30 * (k % 2)])
        for _ in range(k % 5):
            b[r.randrange(len(b))] = "Z"
        pairs.append((a, "".join(b)))
    sets = [[{x[i : i + 7] for i in range(len(x) - 6)} for x in p] for p in pairs]
    want = [100 * len(a & b) >= 85 * len(a | b) for a, b in sets]
    assert 50 < sum(want) < 250
    assert line_dedup.alike(*map(list, zip(*pairs, strict=True))).tolist() == want
    monkeypatch.setattr(line_dedup, "TOGETHER", 2000)
    cuts = line_dedup._cuts([len(a) + len(b) for a, b in pairs])
    assert [k for i, j in cuts for k in range(i, j)] == list(range(len(pairs))) and len(cuts) > 10 and line_dedup._cuts([]) == []


def test_pairs_far_apart_are_not_counted(monkeypatch):
    """Bitmaps rule out pairs of different lines, none that are alike, and leave nothing behind in the arrays that calls share."""
    counted = []
    count = line_dedup._equal_enough
    monkeypatch.setattr(line_dedup, "_equal_enough", lambda h, starts, sizes, sides: counted.append(len(sides[0])) or count(h, starts, sizes, sides))
    r = random.Random(21)
    xs = [sentence(600 + k, 30) for k in range(200)]
    ys = [x if k % 4 == 0 else x[:60] + "Z" + x[61:] if k % 4 == 1 else sentence(1600 + k, 30) if k % 4 == 2 else x[: len(x) // 2] + sentence(2600 + k, 15) for k, x in enumerate(xs)]
    keys = line_dedup.band_keys(xs)
    for _ in range(3):
        counted.clear()
        assert line_dedup.alike(xs, ys).tolist() == [k % 4 < 2 for k in range(200)] and sum(counted) <= 110
        some = r.sample(range(200), 20)
        assert (line_dedup.band_keys([xs[i] for i in some]) == keys[some]).all()


def test_lines_are_trimmed_as_by_split():
    """Lines with any white space, and printable ones that are taken as they are."""
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    lines = ["", " ", "a", "a b c", " a", "a ", "a  b", "a\u200bb", "\xad", "é 漢 x"] + [x for c in spaces for x in (c, f"a{c}b", f"{c}a", f"a{c}", f"a {c}b")]
    assert [line_dedup._trimmed(x) for x in lines] == [" ".join(x.split()) for x in lines]
    assert line_dedup._trimmed(lines[3]) is lines[3]


def test_texts_of_few_lines_move(spark, documents, monkeypatch):
    """The lines at some places, each once, though texts repeat; of other lines few leave their documents."""
    rows = [(i, "\n".join(f"{sentence(3000 + 40 * i + k, 6)}  {'É' * (k % 3)} " for k in range(40))) for i in range(30)]
    rows += [(100, rows[3][1]), (101, None), (102, ""), (103, rows[4][1].split("\n")[7])]
    places = [(i, p) for i in range(30) for p in (0, 7, 39)]
    want = {line_dedup.line_key(x): x for i, p in places for x in [line_dedup.normal_line(rows[i][1].split("\n")[p])]}
    where = [(line_dedup.line_key(line_dedup.normal_line(rows[i][1].split("\n")[p])), line_dedup.text_key(rows[i][1]), p) for i, p in places]
    moved = []

    def mapped(df, fn, schema, real=line_dedup.map_arrow):
        out = real(df, fn, schema)
        moved.append(out)
        return out

    monkeypatch.setattr(line_dedup, "map_arrow", mapped)
    got = line_dedup._texts_of(documents(rows), spark.createDataFrame(where, "line long, t long, pos int")).collect()
    assert len(got) == len(want) and {x["id"]: x["x"] for x in got} == want
    assert len(places) <= moved[-1].count() <= 110


@pytest.mark.parametrize("full", [False, True])
def test_a_full_filter_changes_nothing(spark, documents, monkeypatch, full):
    rows = [(i, "\n".join(sentence(4000 + 10 * i + k, 6) for k in range(10))) for i in range(10)]
    where = [(line_dedup.line_key(rows[i][1].split("\n")[3]), line_dedup.text_key(rows[i][1]), 3) for i in range(10)]
    if full:
        monkeypatch.setattr(line_dedup, "bit_filter", lambda slots: np.full(line_dedup.SLOTS // 8, 255, np.uint8))
    got = line_dedup._texts_of(documents(rows), spark.createDataFrame(where, "line long, t long, pos int")).collect()
    assert sorted(x["x"] for x in got) == sorted(rows[i][1].split("\n")[3] for i in range(10))


@pytest.mark.parametrize("part", [7, 1 << 18])
def test_prefix_pairs_of_arrays(spark, monkeypatch, part):
    """The pairs that linking's _across gives for the prefix rows, with no row for each pair that an element makes."""
    monkeypatch.setattr(dealt, "PART", part)
    monkeypatch.setattr(dealt, "PAIRS", part)
    r = random.Random(14)
    core = list(range(1000, 1060))
    sets = {}
    for i in range(120):  # a group in which one component is large and others have many rows
        own = set(core) - set(r.sample(core, r.randint(0, 9))) | set(r.sample(range(2000, 2040), r.randint(0, 6)))
        sets[-i if i % 2 else i << 40] = (1 if i < 70 else 100 + i % 25, own)
    for i in range(40):
        sets[5000 + i] = (200 + i % 7, set(r.sample(range(-20, 20), r.randint(1, 12))))
    flat = [(i, label, len(x), k) for i, (label, x) in sets.items() for k in x]
    prefixes = linking._prefixes(spark.createDataFrame(flat, "id long, label long, n long, key long"), 0.7)
    want = {tuple(x) for x in linking._across(prefixes, 0.7, True).select("a", "b").collect()}
    alike = {(a, b) for a in sets for b in sets if a > b and sets[a][0] != sets[b][0] and len(sets[a][1] & sets[b][1]) >= 0.7 * len(sets[a][1] | sets[b][1])}
    assert len(alike) > 500 and alike <= want
    columns = [np.array(c, np.int64) for c in zip(*prefixes.collect(), strict=True)]
    found = list(dealt._across(columns, 0.7))
    assert {tuple(x) for y in found for x in y.tolist()} == want
    own = sorted(sets)
    keys = [(k, j) for j, i in enumerate(own) for k in sorted(sets[i][1])]
    batches = dealt.deal_sets(iter([(np.array(own), np.array([sets[i][0] for i in own]), *(np.array(c) for c in zip(*keys, strict=True)))]), 5)
    table = spark.createDataFrame([tuple(x.values()) for b in batches for x in b.to_pylist()], dealt.schema(4))
    out = dealt.prefix_pairs(table, 0.7)
    assert {tuple(x) for x in out.select("a", "b").collect()} == want
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_short_lines_take_part(documents):
    """Equal lines of any length, and short lines that share all their shingles; other short lines stay."""
    rows = [(1, "Menu\n}\n\n \t\nabcdefg\naaaaaaa"), (2, " menu \n}\nmenus\n\n \nabcdefh"), (3, "x\nABCDEFG\nmen\naaaaaaaaa"), (4, "x\n漢字"), (5, "漢字\nMENU")]
    got = {x["doc_id"]: x["removed"] for x in line_dedup.line_duplicates(documents(rows)).collect()}
    assert got == {1: [], 2: [0, 1], 3: [1, 3], 4: [0], 5: [0, 1]}
    left = {x["doc_id"]: x["text"] for x in line_dedup.without_duplicate_lines(documents(rows)).collect()}
    assert left == {1: rows[0][1], 2: "menus\n\n \nabcdefh", 3: "x\nmen", 4: "漢字"}


def as_dealt(batches):
    """The batches as a task gets them after by_bucket."""
    table = pa.Table.from_batches(list(batches))
    return table.sort_by([("bucket", "ascending"), ("kind", "ascending")]).to_batches(max_chunksize=4)


@pytest.mark.parametrize("part", [3, 40, 1 << 18])
def test_shared_rows_of_arrays(spark, monkeypatch, part):
    """Rows whose key has two ids, also if a key's rows come in parts, repeat, or one key has most rows."""
    monkeypatch.setattr(dealt, "PART", part)
    r = random.Random(9)
    rows = [(r.choice([7, r.randrange(-60, 60)]), r.randrange(-40, 40)) for _ in range(150)]
    rows += [(1000 + i // 3, -i // 3) for i in range(60)] + [(5000, 1)] * 9 + [(5001, 1)] * 4 + [(5001, 2)]
    r.shuffle(rows)
    ids = defaultdict(set)
    for k, i in rows:
        ids[k].add(i)
    want = {(i, k) for k, x in ids.items() if len(x) > 1 for i in x}
    out = dealt.Parts(5, 0, 2)
    batches = [b for k, i in rows for b in out.add(np.array([k]), np.array([i]))] + list(out.rest())
    got = [x for b in dealt._shared(iter(as_dealt(batches))) for x in zip(*b.to_pydict().values(), strict=True)]
    assert set(got) == want
    table = spark.createDataFrame([tuple(x.values()) for b in batches for x in b.to_pylist()], dealt.schema(2))
    assert set(map(tuple, dealt.shared_rows(table).collect())) == want


@pytest.mark.parametrize("part", [7, 100, 1 << 18])
def test_prefix_rows_of_arrays(spark, monkeypatch, part):
    """The rows that _prefixes gives."""
    monkeypatch.setattr(dealt, "PART", part)
    r = random.Random(12)
    sets = {-i if i % 2 else i << 40: (r.randrange(4), set(r.sample(range(-20, 20), r.randint(1, 12))) | {10**15 + i}) for i in range(60)}
    flat = [(i, label, len(x), k) for i, (label, x) in sets.items() for k in x]
    want = linking._prefixes(spark.createDataFrame(flat, "id long, label long, n long, key long"), 0.7)
    ids = sorted(sets)
    groups = []
    for at in range(0, 60, 20):
        own = ids[at : at + 20]
        keys = [(k, j) for j, i in enumerate(own) for k in sorted(sets[i][1])]
        groups.append((np.array(own), np.array([sets[i][0] for i in own]), *(np.array(c) for c in zip(*keys, strict=True))))
    batches = list(dealt.deal_sets(iter(groups), 5))
    placed = dealt._placed(iter(as_dealt(batches)), 3)
    got = [x for b in dealt._ordered(iter(as_dealt(placed)), 0.7) for x in zip(*b.to_pydict().values(), strict=True)]
    rows = sorted(map(tuple, want.collect()))
    assert rows and sorted(got) == rows
    table = spark.createDataFrame([tuple(x.values()) for b in batches for x in b.to_pylist()], dealt.schema(4))
    out = dealt.prefix_rows(table, 0.7)
    assert out.columns == want.columns and sorted(map(tuple, out.collect())) == rows


def test_lines_deal_keys_as_arrays(documents, monkeypatch):
    """Of many lines, few rows are dealt; neither keys nor shingles are rows of their own before they are known to be shared."""
    saved = {}

    def save(df, name):
        table, path = graph.save(df, name)
        saved[name] = table.count()
        return table, path

    monkeypatch.setattr(line_dedup, "save", save)
    monkeypatch.setattr(linking, "save", save)
    rows = [(i, "\n".join(sentence(9000 + 50 * i + k, 12) for k in range(50))) for i in range(20)]
    rows += [(20, rows[0][1].upper())]
    got = {x["doc_id"]: x["removed"] for x in line_dedup.line_duplicates(documents(rows)).collect()}
    assert got == {i: list(range(50)) if i == 20 else [] for i in range(21)}
    assert saved["lines"] == 21 * 51 and "shared-keys" not in saved and "shared-elements" not in saved
    assert saved["banded-lines"] < 21 * 51 + 20 * 50


# --- op 8 ---


def expected_repeats(rows):
    raw = [(i, (t or "").encode()) for i, t in rows]
    n = suffix_dedup.SPAN
    seen = Counter(x[k : k + n] for _, x in raw for k in range(len(x) - n + 1))
    out = []
    for i, x in raw:
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - n + 1):
            if seen[x[k : k + n]] > 1:
                gone[k : k + n] = True
        left = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(x), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def repeat_rows():
    passages = [sentence(900 + i, 60) for i in range(4)]
    rows = [(i, sentence(i, 20) + passages[i % 4] + sentence(50 + i, 25) + (passages[(i + 1) % 4] if i % 3 == 0 else "")) for i in range(40)]
    rows += [(100, "ab" * 400), (101, "é漢" * 200), (102, "x" * 199), (103, "y" * 200), (104, "z" * 201), (105, rows[3][1]), (106, rows[3][1]), (107, None), (108, "")]
    rows += [(200 + k, edited(rows[0][1], k, 2)) for k in range(15)]
    return rows


@pytest.mark.parametrize("hot", [20_000, 3])
def test_repeats_equal_brute_force(documents, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", (hot,))
    rows = repeat_rows()
    got = suffix_dedup.repeats_removed(documents(rows)).collect()
    assert sorted(map(tuple, got), key=str) == expected_repeats(rows)


def test_repeats_of_odd_rows(documents):
    rows = [(r[0], r[1]) for r in ODD]
    got = suffix_dedup.repeats_removed(documents(ODD)).collect()
    assert sorted(map(tuple, got), key=str) == expected_repeats(rows)
    assert suffix_dedup.repeats_removed(documents([])).collect() == []


@pytest.mark.parametrize("shard", [1 << 20, 700, 300])
def test_merged_transforms_equal_brute_force(shard):
    r = random.Random(3)
    n = suffix_dedup.SPAN
    for _ in range(12):
        base = bytes(r.choices(b"abc \xff\x00", k=600))
        segments = []
        for _ in range(r.randint(1, 10)):
            a = r.randint(0, 300)
            x = bytearray(base[a : a + r.randint(n, 300)])
            if r.random() < 0.5:
                x[r.randrange(len(x))] = r.randrange(256)
            segments.append(bytes(x) if r.random() < 0.8 else b"a" * r.randint(n, 500))
        seen = Counter(s[i : i + n] for s in segments for i in range(len(s) - n + 1))
        flags = [x for s in segments for x in [*(i + n <= len(s) and seen[s[i : i + n]] > 1 for i in range(len(s))), False]]
        assert suffix_dedup.repeated_starts(segments, shard).tolist() == flags


def test_long_texts_are_cut_into_overlapping_slices(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 500)
    text = sentence(1, 400).encode()
    starts = []
    for data, _number, begin, at in suffix_dedup.slices([text, b"short", text[:300]]):
        _, _, start, windows, part = suffix_dedup.runs_of(data, at)
        starts += [(int(_number[p]), int(s - at[p] + begin[p] + i)) for s, w, p in zip(start, windows, part, strict=True) for i in range(w)]
    assert sorted(starts) == [(0, i) for i in range(len(text) - 199)] + [(2, i) for i in range(101)]


def test_runs_are_taken_from_small_slices():
    """Arrays of a slice stay in a core's cache; texts are neither lost nor cut by it."""
    texts = [sentence(i, 400).encode() for i in range(300)]
    got = [(data, number) for data, number, _, _ in suffix_dedup.slices(texts)]
    assert max(len(data) for data, _ in got) <= 1 << 17
    assert np.concatenate([n for _, n in got]).tolist() == list(range(300)) and b"".join(d.tobytes() for d, _ in got) == b"".join(texts)


def test_text_without_repeats_keeps_whole_characters(documents):
    shared = "漢字é" * 80
    rows = [(1, "a " + sentence(1) + shared + sentence(2)), (2, sentence(3) + "b" + shared + "c"), (3, shared), (4, None), (5, "plain")]
    docs = documents(rows)
    out = {x["doc_id"]: x for x in suffix_dedup.without_repeats(docs).select("doc_id", "text", "n_chars").collect()}
    assert 3 not in out and out[4]["text"] is None and out[5]["text"] == "plain"
    assert "漢字é漢字é" not in out[1]["text"] and out[1]["text"].startswith("a ") and out[1]["n_chars"] == len(out[1]["text"])
    assert suffix_dedup.without_repeats(docs).columns == docs.columns
    assert docs.where(F.lit(False)).transform(suffix_dedup.without_repeats).collect() == []
