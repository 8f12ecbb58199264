"""The pipeline: every stage on what the one before kept."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

from .test_operators import WORDS, prose  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    path = str(tmp_path_factory.mktemp("sf"))
    rows, labels = [], []
    for i in range(200):
        good = i % 4 > 0
        rows.append((i, prose(60, rng) if good else prose(60, rng).upper().replace(" ", "!! ")))
        labels.append((i, int(good), 0))
    copy = rows[1][1]
    rows += [(500, copy), (501, copy), (502, copy + " " + WORDS[0]), (503, None), (504, ""), (505, "too short"), (None, prose(50, rng))]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(sf_dir + "/documents.parquet")
    columns, ids = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    rules, classified, exact, near = ids
    assert rules == {*range(200), 500, 501, 502, None}
    assert {i for i in classified if i is not None and i < 200} == {i for i in range(200) if i % 4}
    assert classified - exact == {1, 500} and exact - near == {501}
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == near


def test_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(sf_dir + "/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
