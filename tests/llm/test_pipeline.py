"""The pipeline against brute force: each stage's effect, judged on its own input."""

import random
import re

import pytest

import corpus_pipeline
from tests.llm.conftest import sentence
from tests.llm.test_dedup import edited, expected_lines, expected_near


def corpus():
    r = random.Random(9)
    base = [" ".join(sentence(100 * i + k, 12) for k in range(6)).replace(" ", " ") for i in range(12)]
    rows = []
    for i in range(60):
        lines = [sentence(10_000 + 10 * i + k, 14) for k in range(r.randint(3, 7))]
        rows.append((i, "\n".join(lines), f"h{i % 3}"))
    rows += [(100 + i, rows[i][1], "h9") for i in range(8)]  # exact copies
    rows += [(200 + i, edited(base[i % 12], i, 2), "h9") for i in range(36)]  # near copies
    passage = sentence(777, 60)
    rows += [(300 + i, sentence(20_000 + i, 40) + " " + passage + " " + sentence(30_000 + i, 40), "h9") for i in range(6)]
    rows += [(400, "too short", "h0"), (401, None, "h0"), (402, "", None), (403, "same words again and once more here " * 20, "h0")]
    return rows, passage


@pytest.fixture
def stages(documents, spark):
    """Rows of each stage's input and output, in order."""
    rows, passage = corpus()
    docs = documents(rows)
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = corpus_pipeline.save(stage(spark, docs, ""), f"test-{name}")
        seen.append(docs)
    return seen, passage


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_every_stage_does_its_work(stages):
    (docs, quality, lines, near, suffix, packed), passage = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "suffix_dedup", "packing"]
    assert docs.columns == quality.columns == lines.columns == near.columns == suffix.columns

    before, after = texts(docs), texts(quality)
    assert set(before) - set(after) == {400, 401, 402, 403} and all(after[i] == before[i] for i in after)

    before, after = after, texts(lines)
    removed = expected_lines(sorted(before.items()))
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in removed[i]) for i, t in before.items()}
    assert after == {i: t for i, t in want.items() if not removed[i] or re.search(r"\S", t)}
    assert not set(range(100, 108)) & set(after)

    before, after = after, texts(near)
    kept = {i for i, (_, _, k) in expected_near(sorted(before.items())).items() if k}
    assert after == {i: before[i] for i in kept}

    before, after = after, texts(suffix)
    assert all(passage[:100] not in t for t in after.values()) and {300, 305} <= set(after)
    assert all(after[i] == before[i] for i in range(60))

    rows = packed.toPandas()
    assert set(rows.doc_id) == set(after) and rows.groupby("sequence_id").length.sum().max() <= 2048


def test_run_reads_the_whole_table(spark, tmp_path, documents):
    rows, _ = corpus()
    documents(rows, extra=False).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert 60 <= out.select("doc_id").distinct().count() <= len(rows)


def test_empty_table(spark, documents):
    docs = documents([], extra=False)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.collect() == []


def test_stages_of_the_pipeline_give_memory_back(spark):
    """A worker's caches are empty after a task of a stage; a query's tasks leave them."""
    from splitscope.llm import bpe, common
    from splitscope.llm.queries import VOCABULARY

    v = bpe.vocabulary(VOCABULARY)
    v.encode_many(["these words are held"])
    assert len(v.new) >= 4
    assert list(common._returning(lambda x: iter(x))([1, 2])) == [1, 2] and not v.new and not v.merged
    seen = []
    planned = common.memory_given_back(lambda: seen.append(common._give_back.get()))
    planned()
    assert seen == [True] and common._give_back.get() is False


def test_shuffle_files_go_and_the_setting_returns(spark):
    from splitscope.llm import common

    before = spark.conf.get(common.SHUFFLE_CLEANUP)
    table, path = common.save(spark.range(1000).repartition(5).groupBy((common.F.col("id") % 7).alias("k")).count(), "test")
    assert sorted(map(tuple, table.collect())) == [(k, 143 if k < 6 else 142) for k in range(7)]
    assert spark.conf.get(common.SHUFFLE_CLEANUP) == before
    with pytest.raises(Exception, match="lost"):
        common.save(spark.range(3).select(common.F.raise_error(common.F.lit("lost"))), "test")
    assert spark.conf.get(common.SHUFFLE_CLEANUP) == before
    common.drop(spark, path)
