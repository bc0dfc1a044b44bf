import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from splitscope.llm import fingerprints, html, quality, toxicity
from tests.llm.conftest import CLASHING, ODD, sentence

# --- op 1 ---


def test_gamma_quantiles():
    q = fingerprints._gamma_quantiles(12)
    assert np.allclose(1 - (1 + q) * np.exp(-q), (np.arange(4096) + 0.5) / 4096, atol=1e-6)


def weights(text):
    return {w: n * len(w) for w, n in Counter(text.split()).items()}


def jaccard(a, b):
    x, y = weights(a), weights(b)
    over = sum(max(x.get(w, 0), y.get(w, 0)) for w in x.keys() | y.keys())
    return sum(min(x[w], y[w]) for w in x.keys() & y.keys()) / over if over else 1.0


def test_collisions_estimate_generalised_jaccard():
    pairs = []
    for k in range(150):
        a = sentence(k, 60).split()
        b = a[: k % 60] * (1 + k % 3) + sentence(1000 + k, 60 - k % 60).split()
        pairs.append((" ".join(a), " ".join(b)))
    f = fingerprints.fingerprints([x for p in pairs for x in p])
    got = fingerprints.likeness(f[::2], f[1::2])
    errors = got - np.array([jaccard(a, b) for a, b in pairs])
    assert abs(errors.mean()) < 0.02 and errors.std() < 0.075
    again = fingerprints.fingerprints([pairs[7][1], pairs[3][0]])
    assert (again[0] == f[15]).all() and (again[1] == f[6]).all()


@pytest.mark.parametrize("tasks", [1, 8])
def test_fingerprints_of_neighbours(documents, spark, tasks):
    rows = [(i * 3, sentence(i, 5 + i)) for i in range(70)] + [(1, None), (2, ""), (4, "é漢" * 9), (1000, "end of all"), (5, " ")]
    docs = documents(rows).repartition(tasks)
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_neighbours(docs).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for (i, text), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        text, nxt = text or "", nxt or ""
        edited = text[: len(text) - len(text) // 2] + nxt[: len(text) // 2]
        own = fingerprints.fingerprints([text, edited, nxt])
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert [r["fingerprint"], r["edited_fingerprint"]] == [x.astype(">u2").tobytes().hex() for x in own[:2]]
        assert r["near_edited"] == (own[0] == own[1]).mean() and r["near_next"] == (own[0] == own[2]).mean()
    assert len(got) == len(rows)


def test_fingerprints_of_odd_rows(documents):
    got = fingerprints.fingerprint_neighbours(documents(ODD)).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[5]["fingerprint"] == by[6]["fingerprint"] and by[1]["near_next"] == 0 and by[2]["near_next"] == 1
    assert fingerprints.fingerprint_neighbours(documents([])).collect() == []
    alone = fingerprints.fingerprint_neighbours(documents([(3, "just one text")])).first()
    assert alone["near_next"] == 1


# --- op 4 ---

PAGES = [
    ("<html><body><nav><ul><li>Home</li></ul></nav><article><h1>A  title</h1><p>First &amp; text<br>line<p>Second\n <b>bold</b></article><footer>foot</footer>", "A title\n\nFirst & text line\n\nSecond bold"),
    ("<article><p>one</p><div class='ad'>buy</div><p>two</p><aside>x</aside><form><p>f</p></form><p>three</p></article>", "one\n\ntwo\n\nthree"),
    ("<article><p>text</p><section id='comments'><p>first!</p></section></article><article class=comment><p>me too</p></article>", "text"),
    ('<script>var t="</p><article>";</script><style>p{}</style><!-- <article><p>no</p></article> --><main><p>yes &copy; &#233;</p></main>', "yes © é"),
    ("<article><p>cut in a ta<b", "cut in a ta"),
    ("<nav><a href=x>a</a><article><p>left open before</p></article>", "left open before"),
    ("<div class='cookie-notice'>We use</div><div><p>" + "long text " * 20 + "</p></div><div class=x><a>short</a></div>", ("long text " * 20).strip()),
    ("<p>1 < 2 and 3 > 2</p>" + "<p>" + "word " * 30 + "</p>", "1 < 2 and 3 > 2\n\n" + ("word " * 30).strip()),
    ("<article></article>", ""),
    ("", ""),
    (None, ""),
    ("no markup", ""),
    ("<article><table><tr><td>a</td><td>b</td></tr></table><pre>x\n  y</pre></article>", "a\n\nb\n\nx y"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert html.main_text(page) == text


WORDS = "some words of the text " * 6
CUT = [
    # without an article: lists, tables, figures and short stretches between the first surge and the last dive
    (f"<div><p>{WORDS}</p><ul><li>item one</li><li>item two</li></ul><p>{WORDS}</p></div>", [WORDS, "item one", "item two", WORDS]),
    (f"<div><p>{WORDS}</p><table><tr><td>a</td><td>b</td></tr></table><figure><figcaption>what it shows</figcaption></figure></div>", [WORDS, "a", "b", "what it shows"]),
    (f"<div>{WORDS}</div><div>A heading between</div><div>{WORDS * 9}</div><div>after the last</div>", [WORDS, "A heading between", WORDS * 9]),
    (f"<div>before the first</div><section>{WORDS * 20}</section><div><div>{WORDS}</div></div>", [WORDS * 20, WORDS]),
    # lengths choose where the marks name little of the text, or not all of it; what they name stays
    (f"<div><p>{WORDS * 3}</p><p>{WORDS}</p></div><div><article>A teaser</article><article>Another</article></div>", [WORDS * 3, WORDS, "A teaser", "Another"]),
    (f"<article><p>{WORDS}</p></article><div>between</div><div><p>{WORDS * 2}</p></div><div>the end</div>", [WORDS, "between", WORDS * 2]),
    # an article's short parts stay, boxes in it or not
    (f"<article><div><h1>A title</h1></div><div>{WORDS}</div><div>The end.</div></article><article>More</article><div>the end</div>", ["A title", WORDS, "The end.", "More"]),
]


@pytest.mark.parametrize("page,blocks", CUT)
def test_main_text_from_first_surge_to_last_dive(page, blocks):
    assert html.main_text(f"<html><body>{page}</body></html>") == "\n\n".join(x.strip() for x in blocks)


def test_pages_with_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"u{i}" if i % 3 else None, p) for i, (p, _) in enumerate(PAGES)] + [(None, "u", PAGES[0][0]), (0, "u0", PAGES[0][0])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x")})
    got = [tuple(r) for r in html.extract_pages(pages).collect()]
    want = [(i, u, html.main_text(p), len(html.main_text(p))) for i, u, p in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert html.extract_pages(pages.where("1 = 0")).collect() == []
    assert len(html.main_text("<article>" + "<p>x y</p>" * 20_000 + "</article>")) == 20_000 * 5 - 2


# --- op 9 ---


def quality_rows():
    rows = [(i, sentence(i, 40) + "\n" + sentence(100 + i, 10), f"h{i % 2}") for i in range(60)]
    boiler = "Read more  on our Site 2024"
    rows += [(100 + i, f"{boiler}\n{sentence(300 + i, 30)}\n\n{boiler.upper()}", "h0") for i in range(40)]
    rows += [(200 + i, "\n".join([boiler.replace("4", str(i % 10))] * 9), "h0") for i in range(8)]  # depleted
    rows += [(300, "a b c d e f g h " * 6, "h1"), (301, "#*$ %&|<> x " * 10, "h1"), (302, sentence(5, 60) + "\n" + sentence(5, 60), None), (303, "one two three", "h1")]
    rows += [(400, sentence(9, 19), "h1"), (401, "w " * 25, "h1"), (402, " ".join(map(str, range(30))), "h2"), (403, "x\x0by\x0cz\r\n" * 10, "h2")]
    return rows


def test_quality_equals_its_sql(documents):
    rows = quality_rows() + [(500 + r[0], *r[1:]) for r in ODD if r[0] not in (5, None)]  # the SQL tells rows apart by id
    docs = documents(rows, extra=False)
    got = quality.quality_verdicts(documents(rows)).toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.sql(quality.SQL).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a = got[columns].sort_values("doc_id").reset_index(drop=True)
    b = want[columns].sort_values("doc_id").reset_index(drop=True)
    assert a.equals(b.astype(a.dtypes.to_dict()))
    by = got.set_index("doc_id")
    assert not by.kept[[200, 300, 303, 400]].any() and by.kept[[100, 402]].all() and by.n_repeat_words[300] == 48


def test_a_line_of_a_tenth_of_a_large_host_goes(documents):
    """The limit is a number of distinct documents, whatever share of the host they are; copies count once."""
    rows = [(i, sentence(i, 30) + ("\nshared line of the host" if i % 10 == 0 else ""), "big") for i in range(400)]
    rows += [(1000 + i, sentence(9000, 30) + "\nonly in copies", "big") for i in range(60)]
    rows += [(2000 + i, sentence(2000 + i, 30) + "\nin nineteen documents", "big") for i in range(19)]
    got = {r["doc_id"]: r for r in quality.quality_verdicts(documents(rows)).collect()}
    assert {i for i, r in got.items() if r["n_removed_lines"]} == set(range(0, 400, 10)) and all(r["kept"] for r in got.values())
    left = {r["doc_id"]: r["text"] for r in quality.quality_filter(documents(rows)).collect()}
    assert left[10] == sentence(10, 30) and left[1000].endswith("only in copies") and left[2000].endswith("nineteen documents")


def test_repeat_words_by_brute_force(documents):
    import random

    r = random.Random(1)
    texts = [" ".join(r.choices("abc", k=r.randint(0, 60))) for _ in range(60)]
    got = {x["doc_id"]: x["n_repeat_words"] for x in quality.quality_verdicts(documents(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        seen = Counter(windows)
        assert got[i] == len({k + j for k, x in enumerate(windows) if seen[x] > 1 for j in range(8)})


def test_quality_of_odd_rows(documents):
    got = quality.quality_verdicts(documents(ODD)).collect()
    assert len(got) == len(ODD) and quality.quality_verdicts(documents([])).collect() == []
    rows = [*quality_rows(), (5, sentence(5)), (5, sentence(5)), (None, sentence(8))]
    docs = documents(rows)
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    out = [x.asDict() for x in kept.collect()]
    assert sum(x["doc_id"] == 5 for x in out) == 3 and sum(x["doc_id"] is None for x in out) == 1  # 5 is also one of the rows above
    left = next(x for x in out if x["doc_id"] == 100)
    assert left["text"] == sentence(300, 30) + "\n" and left["n_chars"] == len(left["text"])
    assert out[0]["n_tokens"] == CLASHING["n_tokens"]


def test_quality_has_no_python_in_its_plan(documents):
    plan = quality.quality_verdicts(documents([(1, "a")], extra=False))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- op 10 ---


def test_grammar_reads_clauses():
    run = toxicity.grammar().run
    assert run("OIO") == list("-I-")
    assert run("TOI")[2] == "A" and run("TOOOOI")[5] == "I"
    assert run("NOI")[2] == "n" and run("NOOOI")[4] == "I" and run("TNI")[2] == "n"
    assert run("ROTI")[3] == "q" and run("THO")[1] == "T" and run("OHO")[1] == "H"


def test_composition_equals_running_in_turn():
    flip = toxicity.Transducer(0, lambda s, x: (1 - s, "ab"[s] if x == "x" else "c"), "xy")
    count = toxicity.Transducer(0, lambda s, x: ((s + (x == "a")) % 3, s), "abc")
    for word in ("xxyx", "yyxxyx", "x" * 9):
        assert flip.compose(count).run(word) == count.run(flip.run(word))


def toxic_rows():
    insults = ("blorky", "grumfast", "snivelian")
    rows, labels = [], []
    for i in range(600):
        words = sentence(i, 40).split()
        bad = i % 3 == 0
        if bad:
            for k in range(3):
                words.insert(5 + 9 * k, insults[(i + k) % 3] + ("", "en", "ox")[i % 3 if k else 0])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(documents, spark):
    rows, labels = toxic_rows()
    rows += [(700, sentence(3, 40)) for _ in range(3)]
    table = spark.createDataFrame([*labels, (None, 0, 1), (3, None, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(documents(rows), table).toPandas()
    truth = {i: y for i, _, y in labels}
    held = got[got.held_out & got.doc_id.isin(truth)]
    assert 100 < len(held) < 200
    y = held.doc_id.map(truth)
    assert ((held.score >= 0.3) == (held.predicted == 1)).all() and (held.predicted == y).mean() > 0.97
    assert len(got) == len(rows)


def test_toxicity_learns_only_from_training_rows(documents, spark):
    import zlib

    rows, labels = toxic_rows()
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    turned = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, q, y in labels]
    a, b = (toxicity.score_documents(documents(rows), table(x)).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


def test_toxicity_of_odd_rows_and_without_labels(documents, spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(documents(ODD), empty).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] < 0.3 and r["predicted"] == 0 for r in got)
    rows, labels = toxic_rows()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(documents([]), table).collect() == []
    scored = toxicity.score_documents(documents([*rows, *ODD]), table).where("doc_id IS NULL OR doc_id = 9").collect()
    assert all(0 <= r["score"] <= 1 for r in scored)


def test_equal_texts_with_different_labels_are_one_toxic_text(documents, spark):
    import zlib

    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2][:30]
    docs = documents([(i, sentence(1, 30) if k % 3 else sentence(100 + k, 30)) for k, i in enumerate(ids)])
    labels = spark.createDataFrame([(i, 1, int(k == 10)) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    for tasks in (1, 7):
        sample, _ = toxicity.labelled_sample(docs.repartition(tasks), labels)
        got = {r["text"]: r["toxic"] for r in sample.collect()}
        assert sample.count() == len(got) == 11 and {t for t, y in got.items() if y} == {sentence(1, 30)}


# --- op 4, marks and short pages ---


def test_class_tokens_count_as_a_whole():
    page = (
        "<body><nav>menu</nav><article><p class='share-price'>The price of a share rose.</p><div class='article-header'><h1>A title</h1></div>"
        "<section class='job-search-guide'>How to search for jobs.</section><header><h2>Second title</h2><p>by someone</p></header><p class='lead ad'>gone</p>"
        "<div class='cookie-notice'>gone</div><div class=\"x site-footer\">gone</div><div id='ad-box-right'>gone</div><header>only a menu</header></article></body>"
    )
    assert html.main_text(page).split("\n\n") == ["The price of a share rose.", "A title", "How to search for jobs.", "Second title", "by someone"]


def test_pages_of_short_lines_keep_their_largest_stretch():
    assert html.main_text("<div>short</div>") == "short"
    assert html.main_text("<div>a</div><div><p>one line</p><p>and another</p></div><div>b</div>") == "one line\n\nand another"
    assert html.main_text("<nav>a</nav><div class='ad'>b</div>") == "" and html.main_text("<p> </p>") == ""
