"""Nothing is lost in silence: labels, broken dictionaries, null times, doubled verdicts, lost counts."""

import json

import pytest
from pyspark.sql import functions as F

from timberline.operators.bayes import build_scorer, nb_fit, nb_score
from timberline.operators.verdicts import verdict_join
from timberline.operators.windows import fixed_count_windows
from timberline.sources import logs as L
from timberline.streaming import jobs as J


def test_a_third_label_is_an_error(spark):
    docs = spark.createDataFrame([(i, i, ["a", "b"]) for i in range(3)], "line_id long, label int, tokens array<string>")
    with pytest.raises(ValueError, match="neither 0 nor 1"):
        build_scorer(nb_fit(docs))


def test_score_of_documents_without_grams(spark):
    docs = spark.createDataFrame(
        [(1, 0, ["a", "a"]), (2, 1, ["b"]), (3, 0, [])], "line_id long, label int, tokens array<string>")
    model = nb_fit(docs)
    more = docs.union(spark.createDataFrame([(4, 0, ["zz", "zz"]), (5, 0, None)], docs.schema))
    got = {r.line_id: r for r in nb_score(more, model).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert got[3].score_0 == pytest.approx(got[5].score_0)
    # an unseen n-gram counts each time it stands there
    once = nb_score(spark.createDataFrame([(4, 0, ["zz"])], docs.schema), model).first().score_0
    assert got[4].score_0 - got[3].score_0 == pytest.approx(2 * (once - got[3].score_0))


def test_indented_and_broken_dictionaries(spark, tmp_path):
    whole = tmp_path / "whole.json"
    whole.write_text(json.dumps({"q1": {"prediction": "normal", "analysis": "x"}}, indent=2))
    assert [r["query"] for r in L.read_verdicts(spark, str(whole), whole_file=True).collect()] == ["q1"]
    with pytest.raises(Exception):
        L.read_verdicts(spark, str(whole)).collect()
    (tmp_path / "flat.json").write_text('{"content": "a 1", "template": "a <*>"}\n')
    flat = L.read_template_map(spark, str(tmp_path / "flat.json"), flat=True)
    assert [tuple(r) for r in flat.collect()] == [("a 1", "a <*>")]


def test_null_times_come_last(spark):
    lines = spark.createDataFrame(
        [(1, None), (2, "2024-01-01 00:00:01"), (3, "2024-01-01 00:00:00"), (4, None)], "line_id long, t string"
    ).select("line_id", F.to_timestamp("t").alias("ts"))
    got = {r.line_id: r.window_id for r in fixed_count_windows(lines, 2).collect()}
    assert got == {3: 0, 2: 0, 1: 1, 4: 1}


def test_doubled_verdicts_do_not_double_windows(spark):
    queries = spark.createDataFrame([("q", 1), ("r", 2)], "query string, window_id int")
    verdicts = spark.createDataFrame(
        [("q", "anomaly", "a"), ("q", "normal", "b")], "query string, prediction string, analysis string")
    got = {r.window_id: r.prediction for r in verdict_join(queries, verdicts).collect()}
    assert got == {1: "normal", 2: None}
    timed = spark.createDataFrame(
        [("q", "normal", "a", 1), ("q", "anomaly", "b", 3), ("q", "normal", "c", 2)], "query string, prediction string, analysis string, at int")
    got = {r.window_id: r.prediction for r in verdict_join(queries, timed, order="at").collect()}
    assert got == {1: "anomaly", 2: None}


def test_half_written_counts_are_an_error(spark, tmp_path):
    assert J.load_counts(spark, str(tmp_path / "none")) is None
    spark.range(1).write.parquet(str(tmp_path / "half" / "class_counts" / "batch_id=0"))
    with pytest.raises(FileNotFoundError):
        J.load_counts(spark, str(tmp_path / "half"))


def test_first_occurrence_asks_for_a_bound(spark):
    with pytest.raises(ValueError, match="watermark"):
        J.stream_first_occurrence(spark.readStream.format("rate").load(), key="value", ts="timestamp")
