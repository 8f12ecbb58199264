import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from timberline.functions.patterns import WILDCARD
from timberline.functions.text import tokenize_line
from timberline.operators.bayes import nb_fit, nb_score
from timberline.operators.positions import assign_line_id
from timberline.plans.detector import fit_detector, joined_template
from timberline.plans.prepare import prepare_dataset
from timberline.session import list_names, scratch_path, shared_dir
from timberline.sources import logs as L
from timberline.sources import sinks as S
from timberline.streaming import jobs as J


def test_format_groups_and_optional_parts():
    _, numbers, optional = L.format_pattern(L.LOG_FORMATS["Thunderbird"])
    assert numbers["Component"] == 9 and numbers["PID"] == 11 and numbers["Content"] == 12
    assert optional == {"PID"}


def test_parser_drops_and_keeps(spark):
    rows = ["A  b: c", "garbage", " x[7]: y z ", "p\x01q: r", "n: "]
    df = spark.createDataFrame([(r,) for r in rows], "value string")
    out = L.parse_log_format(df, r"<Name>(\[<No>\])?:? <Text>")
    assert {tuple(r) for r in out.collect()} == {
        ("A", None, "b: c"), ("x", "7", "y z"), ("p\x01q", None, "r")
    }


def test_line_ids_follow_file_order(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"part{f}.log").write_text("".join(f"- {f * 100 + i} x\n" if i % 4 else "\n" for i in range(40)))
    raw = L.read_raw_log(spark, str(tmp_path))
    out = assign_line_id(L.parse_log_format(raw, "<Label> <No> <Content>")).orderBy("line_id").collect()
    want = [f * 100 + i for f in range(3) for i in range(40) if i % 4]
    assert [r["line_id"] for r in out] == list(range(1, len(want) + 1))
    assert [int(r["No"]) for r in out] == want


def test_carriage_return_stays_in_the_line(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"a\rb\nc\n")
    assert [r["value"] for r in L.read_raw_log(spark, str(tmp_path)).collect()] == ["a\rb", "c"]


def test_preparation_end_to_end(spark, tmp_path):
    start = 1_700_000_000
    lines = [f"{'FAIL' if i % 9 == 0 else '-'} {start + i * 30} d n t n RAS KERNEL INFO msg {i % 4}" for i in range(100)]
    (tmp_path / "raw.log").write_text("\n".join(lines) + "\nbroken\n")
    (tmp_path / "map.json").write_text(json.dumps({"msg 0": "msg <*>", "msg 1": None}))
    templates = L.read_template_map(spark, str(tmp_path / "map.json"))
    data = prepare_dataset(
        spark, str(tmp_path / "raw.log"), L.LOG_FORMATS["BGL"], templates, 0.8, "fixed", 10, out=str(tmp_path / "out")
    )
    kept = [i for i in range(100) if i % 4 != 1]
    train = {r["line_id"]: r for r in data.train.collect()}
    assert sorted(train) == [i + 1 for i in kept[:60]]
    assert {r["window_id"] for r in train.values()} == set(range(6))
    assert train[1]["event_template"] == "msg <*>" and train[3]["event_template"] == "msg 2"
    ratios = {r["split"]: r for r in data.ratios.collect()}
    assert ratios["train"]["windows"] == 6 and ratios["test"]["windows"] == 2
    assert L.read_sessions(spark, str(tmp_path / "out" / "test")).count() == 15


def test_nested_sessions(spark, tmp_path):
    sessions = [[{"Content": "a", "Label": 0}, {"Content": "b", "Label": 1}], [{"Content": "c", "Label": 0}]]
    (tmp_path / "s.json").write_text("".join(json.dumps(s) + "\n" for s in sessions))
    out = L.read_sessions(spark, str(tmp_path / "s.json"), "nested", "Content string, Label int")
    assert sorted(map(tuple, out.collect())) == [(1, 0, "a", 0), (1, 1, "b", 1), (2, 0, "c", 0)]


def test_verdict_file_of_one_object(spark, tmp_path):
    cache = {"q1": {"prediction": "anomaly", "analysis": "x", "examples": [{"query": "a", "answer": "b"}]},
             "q2\nline": {"prediction": "normal", "analysis": "y"}}
    (tmp_path / "cache.json").write_text(json.dumps(cache))
    got = {r["query"]: r for r in L.read_verdicts(spark, str(tmp_path / "cache.json")).collect()}
    assert got["q1"]["examples"][0]["answer"] == "b" and got["q2\nline"]["prediction"] == "normal"


def test_results_are_appended(spark, tmp_path):
    metrics = spark.createDataFrame([(0.5, 1.0)], "precision double, recall double")
    path = str(tmp_path / "runs")
    for st in (0.5, 0.6):
        S.append_results(metrics, {"st": st, "depth": 4}, path, ["depth"])
    rows = spark.read.option("header", True).csv(path).collect()
    assert len(rows) == 2 and len({r["expname"] for r in rows}) == 1 and len(rows[0]["expname"]) == 8


def test_report_quotes_every_field(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", now')], "id int, text string").coalesce(1)
    S.write_report_csv(df, str(tmp_path / "r"))
    text = next((tmp_path / "r").glob("*.csv")).read_text()
    assert text.splitlines() == ['"id","text"', '"1","say ""hi"", now"']


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir", shared_dir(spark)).rstrip("/")


def _source(spark, df, name):
    path = scratch_path(spark, name)
    df.repartition(3).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, f"unit {i % 7} {'fails' if i % 5 == 0 else 'runs'}", int(i % 5 == 0)) for i in range(60)]
    return spark.createDataFrame(rows, "line_id long, content string, label int")


def test_stream_scores_equal_batch(spark, labelled):
    docs = labelled.withColumn("tokens", tokenize_line("content"))
    model = nb_fit(docs)
    sink = scratch_path(spark, "sink")
    J.stream_score(_source(spark, labelled, "in"), model, sink, scratch_path(spark, "ck")).awaitTermination()
    got = {r["line_id"]: r["prediction"] for r in spark.read.parquet(sink).collect()}
    assert got == {r["line_id"]: r["prediction"] for r in nb_score(docs, model).collect()}


def test_stream_update_tests_then_trains(spark, labelled):
    path, scores = scratch_path(spark, "model"), scratch_path(spark, "scores")
    J.stream_update(_source(spark, labelled, "in"), path, scratch_path(spark, "ck"), scores=scores).awaitTermination()
    total = nb_fit(labelled.withColumn("tokens", tokenize_line("content")))
    got = J.load_counts(spark, path)
    assert sorted(map(tuple, got.ngram_counts.collect())) == sorted(map(tuple, total.ngram_counts.collect()))
    assert sorted(map(tuple, got.class_counts.collect())) == sorted(map(tuple, total.class_counts.collect()))
    # the first batch had no counts to be scored with
    assert spark.read.parquet(scores).select("batch_id").distinct().count() == 2


def test_compacted_counts_score_alike(spark, labelled):
    def source():
        path = scratch_path(spark, "in")
        for i in range(7):
            labelled.filter(F.col("line_id") % 7 == i).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(labelled.schema).option("maxFilesPerTrigger", 1).parquet(path)

    found = []
    for every in (2, 100):
        path, scores = scratch_path(spark, "model"), scratch_path(spark, "scores")
        J.stream_update(source(), path, scratch_path(spark, "ck"), scores=scores, compact_every=every).awaitTermination()
        # files of one second come in no fixed order, so scores are compared by what was counted before
        rows = spark.read.parquet(scores).groupBy("batch_id").count().collect()
        counts = J.load_counts(spark, path)
        found.append((len(rows), sorted(map(tuple, counts.ngram_counts.collect())), sorted(map(tuple, counts.class_counts.collect()))))
        if every == 2:
            assert [n for n in list_names(spark, f"{path}/snapshots") if n.startswith("before=")] == ["before=6"]
            assert [n for n in list_names(spark, f"{path}/ngram_counts") if n.startswith("batch_id=")] == ["batch_id=6"]
            # a replayed batch overwrites its delta and compacts nothing anew
            J.compact_counts(spark, path, 6)
            assert sorted(map(tuple, J.load_counts(spark, path).ngram_counts.collect())) == found[0][1]
            assert J.load_counts(spark, path, before=6).class_counts.agg(F.sum("n")).first()[0] < 60
    assert found[0] == found[1]
    total = nb_fit(labelled.withColumn("tokens", tokenize_line("content")))
    assert found[0][1] == sorted(map(tuple, total.ngram_counts.collect()))


def test_a_cut_off_snapshot_is_not_read(spark, labelled):
    path = scratch_path(spark, "model")
    counts = nb_fit(labelled.withColumn("tokens", tokenize_line("content")))
    for i in range(3):
        counts.class_counts.write.parquet(f"{path}/class_counts/batch_id={i}")
        counts.ngram_counts.write.parquet(f"{path}/ngram_counts/batch_id={i}")
    counts.class_counts.write.parquet(f"{path}/snapshots/before=2/class_counts")  # its other table is missing
    one = counts.class_counts.agg(F.sum("n")).first()[0]
    assert J.load_counts(spark, path).class_counts.agg(F.sum("n")).first()[0] == 3 * one
    J.compact_counts(spark, path, 2)
    assert J.load_counts(spark, path).class_counts.agg(F.sum("n")).first()[0] == 3 * one


def test_streams_take_the_templates_of_a_detector(spark):
    rows = [(i, f"server node closed link {'abcdefg'[i % 7] * 3} {'badly' if i % 5 == 0 else 'today'}", int(i % 5 == 0)) for i in range(60)]
    lines = spark.createDataFrame(rows, "line_id long, content string, label int")
    detector, _ = fit_detector(lines)
    docs = lines.select("line_id", "label").join(joined_template(lines, detector), "line_id")
    assert docs.filter(F.array_contains("tokens", WILDCARD)).count()
    sink, path = scratch_path(spark, "sink"), scratch_path(spark, "model")
    J.stream_score(_source(spark, lines, "in"), detector.counts, sink, scratch_path(spark, "ck"), detector=detector).awaitTermination()
    columns = ["line_id", "score_0", "score_1", "prediction"]
    got = {r["line_id"]: r for r in spark.read.parquet(sink).select(columns).collect()}
    want = nb_score(docs, detector.counts).select(columns).collect()
    assert len(got) == len(want) == 60
    assert all(got[r["line_id"]]["prediction"] == r["prediction"] and got[r["line_id"]]["score_0"] == pytest.approx(r["score_0"]) for r in want)
    J.stream_update(_source(spark, lines, "in"), path, scratch_path(spark, "ck"), detector=detector).awaitTermination()
    assert sorted(map(tuple, J.load_counts(spark, path).ngram_counts.collect())) == sorted(map(tuple, nb_fit(docs).ngram_counts.collect()))


def test_stream_windows_drop_late_lines(spark, tmp_path):
    base = datetime(2024, 1, 1, tzinfo=timezone.utc)
    batches = [[(0, 0), (1, 1)], [(30, 0)], [(31, 0)], [(2, 1)], [(90, 0)]]
    schema = "ts timestamp, label int"
    for n, batch in enumerate(batches):
        rows = [(base + timedelta(minutes=m), label) for m, label in batch]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = (
        J.stream_time_windows(stream, 10, 10, "5 minutes").writeStream.outputMode("append").format("memory")
        .queryName("late_windows").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = {(r["window_start"].minute, r["n_lines"], r["label"]) for r in spark.table("late_windows").collect()}
    # the line of minute 2 comes after its window was closed
    assert (0, 2, 1) in got and (30, 2, 0) in got


def test_stream_first_with_watermark(spark, tmp_path):
    base = datetime(2024, 1, 1, tzinfo=timezone.utc)
    df = spark.createDataFrame(
        [("a", base), ("a", base + timedelta(minutes=1)), ("b", base)], "event_template string, ts timestamp"
    )
    q = (
        J.stream_first_occurrence(_source(spark, df, "in"), watermark="1 hour").writeStream.format("memory")
        .queryName("firsts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    assert sorted(r["event_template"] for r in spark.table("firsts").collect()) == ["a", "b"]


def test_files_of_a_stream_are_bounded(spark, monkeypatch):
    from catalog import streams

    monkeypatch.setattr(streams, "FILE_ROWS", 30)
    stream = streams._stream(spark, spark.range(200).coalesce(1))
    seen = []
    stream.writeStream.foreachBatch(lambda b, i: seen.append(b.count())).trigger(availableNow=True).start().awaitTermination()
    assert sum(seen) == 200
    assert max(seen) <= 4 * 30
