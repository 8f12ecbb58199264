"""Plans and steps that must hold when tables grow, seen on small ones."""

from timberline.operators import mining as M
from timberline.operators import verdicts as V
from timberline.plans.detector import fit_detector
from timberline.session import list_names, passing, scratch_path, shared_dir
from timberline.streaming import jobs as J


def scratch(spark):
    """Names of the scratch tables that lie there now."""
    return set(list_names(spark, f"{shared_dir(spark)}/timberline"))


def kinds(names):
    return {n.rsplit("-", 1)[0] for n in names}


def test_words_of_stored_texts_are_not_broadcast(spark, monkeypatch):
    plans, write = [], V.materialize

    def seen(df, name="step", *args, **kwargs):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name, *args, **kwargs)

    monkeypatch.setattr(V, "materialize", seen)
    templates = spark.createDataFrame(
        [(1, ["a", "b", "<*>"]), (2, ["<*>", "c"]), (3, ["<*>", "<*>", "d"])], "template_id long, tokens array<string>")
    stored = spark.createDataFrame(
        [("a b x", 0, 1), ("y c", 1, 2), ("y z d", 1, 3)], "template string, score int, seq long")
    out = V.feedback_lookup(templates, stored)
    assert sorted(map(tuple, out.collect())) == [(1, 0, 2), (2, 1, 2), (3, 1, 2)]
    candidates = dict(plans)["candidates"]
    assert "Generate" in candidates and "Broadcast" not in candidates


def test_subsuming_leaves_only_its_claims(spark):
    rows = [(1, "g", ["a", "<*>"]), (2, "g", ["a", "b"]), (3, "g", ["<*>", "<*>", "end"]), (4, "g", ["b", "weekend"]), (5, None, ["a", "b"])]
    templates = spark.createDataFrame(rows, "template_id long, group_key string, tokens array<string>")
    before = scratch(spark)
    claims = M.subsume_templates(templates)
    assert kinds(scratch(spark) - before) == {"claims"}
    assert sorted(map(tuple, claims.collect())) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)]


def test_matching_lets_its_index_go_before_texts_meet(spark):
    schema = "template_id long, created_seq long, group_key string, path array<string>, tokens array<string>"
    templates = spark.createDataFrame(
        [(1, 1, "g", [], ["a", "<*>", "b"]), (2, 2, "g", [], ["a", "<*>", "q"]), (3, 3, "g", [], ["c", "d", "e"])], schema)
    lines = spark.createDataFrame(
        [(11, "g", [], ["a", "x", "y", "b"]), (12, "g", [], ["c", "d", "x"]), (13, "g", [], ["z"])],
        "line_id long, group_key string, path array<string>, tokens array<string>")
    before = scratch(spark)
    with passing(spark):
        out = M.match_templates(lines, templates)
        assert kinds(scratch(spark) - before) == {"asking_lines", "known_templates", "pairs"}
        assert sorted(map(tuple, out.collect())) == [(11, 1.0, 1), (12, 0.5, 3)]
    assert scratch(spark) == before


def test_tokens_no_line_holds_are_not_ordered(spark, monkeypatch):
    schema = "template_id long, created_seq long, group_key string, path array<string>, tokens array<string>"
    templates = spark.createDataFrame([(1, 1, "g", [], ["a", "<*>", "b", "u", "v", "w"])], schema)
    lines = spark.createDataFrame([(11, "g", [], ["a", "x", "b"])], "line_id long, group_key string, path array<string>, tokens array<string>")
    written, write = {}, M.materialize
    monkeypatch.setattr(M, "materialize", lambda df, name="step": written.setdefault(name, write(df, name)))
    assert M.match_templates(lines, templates).collect() == []
    assert sorted(written["ordered"].first()["ordered"]) == ["a", "b"] and written["anchored"].isEmpty()


def test_batches_of_a_stream_leave_no_scratch(spark):
    rows = [(i, f"unit {i % 3} sent {'xyz'[i % 3]}", i % 2) for i in range(40)]
    lines = spark.createDataFrame(rows, "line_id long, content string, label int")
    detector, _ = fit_detector(lines)
    source = scratch_path(spark, "source")
    lines.repartition(2).write.parquet(source)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(source)
    before = scratch(spark)
    sink, deltas = scratch_path(spark, "scores"), scratch_path(spark, "deltas")
    J.stream_score(stream, detector.counts, sink, scratch_path(spark, "ck"), detector=detector).awaitTermination()
    J.stream_update(stream, deltas, scratch_path(spark, "ck"), detector=detector).awaitTermination()
    assert spark.read.parquet(sink).count() == 40
    left = kinds(scratch(spark) - before)
    assert left == {"scores", "deltas", "ck", "known_templates", "often", "waiting", "anchored", "loose", "ngrams"}
