import math
import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.functions import text as T
from timberline.functions.patterns import HEX_WORD, MASK_PRESETS, jvm_pattern
from timberline.functions.text import counted_tokens
from timberline.operators import grouping as G
from timberline.operators import positions as P
from timberline.operators import retrieval as R
from timberline.operators import windows as W
from timberline.operators.bayes import nb_fit, nb_score, nb_score_running
from timberline.operators.metrics import binary_metrics, session_rollup
from timberline.operators.retrieval import append_candidates, knn_join
from timberline.operators.verdicts import parse_verdict
from timberline.plans.sessions import analyse_sessions

from model import Bayes


def one(spark, value, column, name="string"):
    return spark.createDataFrame([(value,)], f"v {name}").select(column.alias("o")).head()[0]


def test_tokenizer_rules(spark):
    cases = {
        "core 12 failed": ["core", "12", "failed"],
        "12core failed, now": ["<*>", "failed", "now"],
        "(5) retry": ["5", "retry"],
        "  7 left": ["<*>", "left"],
        " ١ nbsp": ["<*>", "nbsp"],
        "größe_1 näher": ["<*>", "näher"],
        "...": [],
        "": [],
    }
    for text, want in cases.items():
        assert one(spark, text, T.tokenize_line("v")) == want, text
    # masks vanish in the split
    assert one(spark, "at 10.0.0.1 port 80", T.tokenize_line("v", MASK_PRESETS["BGL"])) == ["at", "port"]


def test_hex_mask_uses_unicode_words(spark):
    assert one(spark, "bad éad 0xff dead-beef", T.mask_patterns("v", [HEX_WORD])) == "<*> éad <*> <*>-<*>"
    assert jvm_pattern(r"[\w.]\d\b").startswith(r"[\p{L}\p{N}_.][\p{Nd}](?:")


def test_short_sequences_have_no_ngrams(spark):
    for tokens, n, want in ((["a"], 2, []), ([], 1, []), (["a", "b", "c"], 2, ["a b", "b c"])):
        assert one(spark, tokens, T.ngrams("v", n), "array<string>") == want


def test_verdict_needs_strict_json(spark):
    raw = {
        '{"prediction":"anomaly"}': True,
        'text {"prediction": "normal", "analysis": "x {y}"} text': True,
        '{"prediction":"normal"} and }': False,
        '{"prediction":"normal"}, {"prediction":"normal"}': False,
        '{"prediction":"normal"}, "w": {"a":1}': False,
        '{"prediction":"normal"}] }': False,
        '{"prediction":"maybe"}': False,
        '{"analysis":"x"}': False,
        "none": False,
    }
    df = spark.createDataFrame([(k,) for k in raw], "raw string")
    valid, rejected = parse_verdict(df)
    assert {r["raw"] for r in valid.collect()} == {k for k, ok in raw.items() if ok}
    assert {r["raw"] for r in rejected.collect()} == {k for k, ok in raw.items() if not ok}


@pytest.mark.parametrize("span", [1 << 20, 4])
def test_positions_and_running_counts(spark, span, monkeypatch):
    rng = random.Random(1)
    # one hot session and one hot token
    rows = [(i * 3, "hot" if rng.random() < 0.6 else f"s{i % 5}", rng.randint(1, 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, key string, v long").repartition(5)
    coarse, fine = P.id_cells("id", span)
    got = P.dense_position(df, coarse, fine, ["id"], ["key"], "p").collect()
    totals = P.running_count(df, ["key"], "id", "v", "s", span).collect()
    for key in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == key]
        assert sorted((r["id"], r["p"]) for r in got if r["key"] == key) == [
            (r[0], n + 1) for n, r in enumerate(mine)
        ]
        assert sorted((r["id"], r["s"]) for r in totals if r["key"] == key) == [
            (r[0], sum(x[2] for x in mine[: n + 1])) for n, r in enumerate(mine)
        ]


@pytest.mark.parametrize("frac", [0.0, 0.37, 0.8, 1.0])
def test_split_with_a_hot_second(spark, frac):
    base = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rng = random.Random(2)
    rows = [(i, base + timedelta(seconds=0 if i % 3 else rng.randint(0, 200000))) for i in range(150)]
    df = spark.createDataFrame(rows, "line_id long, ts timestamp")
    order = [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    got = {r["line_id"]: r["split"] for r in P.chronological_split(df, frac).collect()}
    n = int(len(rows) * frac)
    assert got == {i: "train" if p < n else "test" for p, i in enumerate(order)}
    blocks = {r["line_id"]: r["window_id"] for r in W.fixed_count_windows(df, 7).collect()}
    assert blocks == {i: p // 7 for p, i in enumerate(order)}


@pytest.mark.parametrize("w,step", [(5, 5), (5, 2), (2, 7), (600, 5)])
def test_time_windows_equal_loop(spark, w, step):
    base = datetime(2024, 1, 1, 0, 0, 31, tzinfo=timezone.utc)
    rng = random.Random(w * 31 + step)
    rows = [(i, base + timedelta(seconds=rng.randint(0, 3000)), i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "line_id long, ts timestamp, label int")
    got = {(r["window_id"], r["line_id"]) for r in W.sliding_time_windows(df, w, step).collect()}
    first, last = min(r[1] for r in rows), max(r[1] for r in rows)
    want, start, k = set(), first, 0
    while start <= last - timedelta(minutes=w) + timedelta(seconds=1):
        end = start + timedelta(minutes=w) - timedelta(seconds=1)
        want |= {(k, i) for i, t, _ in rows if start <= t <= end}
        start, k = start + timedelta(minutes=step), k + 1
    assert got == want
    sums = {r["window_id"]: r["n_lines"] for r in W.time_window_summary(df, w, step).collect()}
    assert sums == {k: sum(1 for a, _ in want if a == k) for k in {a for a, _ in want}}


@pytest.mark.parametrize("w,stride", [(1, 1), (1, 2), (3, 1), (3, 2), (2, 5)])
def test_count_windows_equal_loop(spark, w, stride):
    rng = random.Random(3)
    # gaps in pos, blank templates, sessions shorter than the window
    sessions = {s: sorted(rng.sample(range(40), n)) for s, n in enumerate([1, 2, 3, 9, 20])}
    rows = [
        (s, p, rng.choice(["", " ", "x", "y", None]), rng.randint(0, 1)) for s, ps in sessions.items() for p in ps
    ]
    df = spark.createDataFrame(rows, "session_id long, pos long, event_template string, label int")
    want = set()
    for s in sessions:
        mine = [r for r in rows if r[0] == s]
        for k, i in enumerate(range(0, len(mine) - w + 1, stride)):
            part = mine[i:i + w]
            text = "\n".join(r[2] for r in part if (r[2] or "").strip())
            want.add((s, k, text, max(r[3] for r in part)))
    got = {(r["session_id"], r["window_id"], r["query"], r["label"]) for r in W.sliding_count_windows(df, w, stride).collect()}
    assert got == want


def test_short_session_is_a_negative_one(spark):
    preds = spark.createDataFrame([(1, 1, 0), (1, None, 1)], "session_id long, prediction int, label int")
    sessions = spark.createDataFrame([(1,), (2,)], "session_id long")
    got = {r[0]: (r[1], r[2]) for r in session_rollup(preds, sessions).collect()}
    assert got == {1: (True, True), 2: (False, False)}


def test_pending_windows_are_reported(spark):
    lines = spark.createDataFrame(
        [(1, 0, "a", 1), (1, 1, "b", 0), (2, 0, "c", 0)], "session_id long, pos long, event_template string, label int"
    )
    verdicts = spark.createDataFrame([("a", "anomaly", "x")], "query string, prediction string, analysis string")
    out = analyse_sessions(lines, verdicts)
    assert {r["query"] for r in out.pending.collect()} == {"b", "c"}
    assert {r["query"]: r["prediction"] for r in out.report.collect()} == {"a": 1, "b": None, "c": None}
    assert out.metrics.head().asDict() == {"precision": 1.0, "recall": 1.0, "f1": 1.0}


def test_metrics_of_nothing(spark):
    df = spark.createDataFrame([(0, 0)], "label int, prediction int")
    assert binary_metrics(df).head().asDict() == {"precision": 0.0, "recall": 0.0, "f1": 0.0}


@pytest.mark.parametrize("labels", [(0, 1), (0,), (1,)])
def test_classifier_edges(spark, labels):
    rng = random.Random(len(labels))
    docs = [
        (i, rng.choices("abcdefgh", k=rng.randint(0, 6)), rng.choice(labels)) for i in range(60)
    ]
    tests = [(i, rng.choices("abcdefghxyz", k=rng.randint(0, 6))) for i in range(60)]
    bayes = Bayes()
    for _, tokens, label in docs:
        bayes.fit(tokens, label)
    model = nb_fit(spark.createDataFrame(docs, "line_id long, tokens array<string>, label int"))
    scored = nb_score(spark.createDataFrame(tests, "line_id long, tokens array<string>"), model)
    got = {r["line_id"]: r["prediction"] for r in scored.collect()}
    assert got == {i: bayes.predict(tokens) for i, tokens in tests}


@pytest.mark.parametrize("block_rows,k", [(None, 3), (7, 3), (7, 30), (4, 90)])
def test_neighbours_equal_scan(spark, block_rows, k):
    rng = np.random.default_rng(5)
    spots = rng.normal(size=(5, 4)) * 10
    vectors = spots[rng.integers(0, 5, 80)] + rng.normal(size=(80, 4)) * 0.3
    vectors[:30] = vectors[0]  # a third are copies
    queries = np.vstack([vectors[::4], rng.normal(size=(10, 4)) * 10])
    cand = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<double>")
    got = {}
    for r in knn_join(asked, cand, k, block_rows=block_rows).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["candidate_id"]))
    for q, v in enumerate(queries):
        dist = ((vectors - v) ** 2).sum(1)
        near = sorted(range(80), key=lambda i: (dist[i], i))[:k]
        assert [c for _, c in sorted(got[q])] == near[::-1]


def test_candidate_ids_go_on(spark):
    old = spark.createDataFrame([(0, "a"), (1, "b")], "id long, text string")
    new = spark.createDataFrame([(9, "d"), (5, "c")], "seq long, text string")
    assert sorted(map(tuple, append_candidates(old, new).collect())) == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]


def test_first_occurrence_keeps_whole_rows(spark):
    rows = [(3, "a", None), (1, "a", "x"), (2, "b", None)]
    df = spark.createDataFrame(rows, "line_id long, event_template string, extra string")
    assert sorted(map(tuple, W.first_occurrence(df, "event_template").collect())) == [(1, "a", "x"), (2, "b", None)]


def test_truncation_is_within_the_hour(spark):
    rows = [(datetime(2024, 1, 1, 5, m, 59, tzinfo=timezone.utc),) for m in (0, 6, 7, 59)]
    df = spark.createDataFrame(rows, "ts timestamp").select(F.date_format(T.truncate_minutes("ts", 7), "HH:mm:ss"))
    assert [r[0] for r in df.collect()] == ["05:00:00", "05:00:00", "05:07:00", "05:56:00"]


def test_scores_are_in_range(spark):
    df = spark.range(300).select(F.concat(F.lit("t"), "id").alias("t"), (F.col("id") % 2).cast("int").alias("l"))
    out = df.select("l", F.get_json_object(T.example_answer("l", "t"), "$.anomaly_score").cast("double").alias("s"))
    for r in out.collect():
        low = 0.9 if r["l"] else 0.0
        assert low - 1e-9 <= r["s"] <= low + 0.1 + 1e-9 and math.isclose(r["s"] * 100, round(r["s"] * 100), abs_tol=1e-6)


@pytest.mark.parametrize("seed, fitted", [(0, 0), (1, 1), (2, 40)])
def test_running_scores_equal_one_line_after_the_other(spark, seed, fitted):
    rng = random.Random(seed)
    words = ["up", "down", "fail", "ok", "x1", "x2", "x3"]
    rows = [(i * 3 + 5, rng.choices(words, k=rng.randint(0, 6)), int(rng.random() < 0.3)) for i in range(120)]
    bayes = Bayes()
    for _, tokens, label in rows[:fitted]:
        bayes.fit(tokens, label)
    frame = spark.createDataFrame(rows, "line_id long, tokens array<string>, label int")
    base = nb_fit(frame.limit(0) if not fitted else spark.createDataFrame(rows[:fitted], frame.schema))
    docs = spark.createDataFrame(rows[fitted:], frame.schema)
    got = {r["line_id"]: r["prediction"] for r in nb_score_running(docs.repartition(3), base).collect()}
    assert len(got) == 120 - fitted
    for i, tokens, label in rows[fitted:]:
        assert got[i] == bayes.predict(tokens), (i, tokens)
        bayes.fit(tokens, label)


def test_running_scores_start_from_the_fitted_ones(spark):
    rows = [(i, ["a", "b", "c"][: 1 + i % 3], i % 2) for i in range(12)]
    docs = spark.createDataFrame(rows, "line_id long, tokens array<string>, label int")
    model = nb_fit(docs)
    first = spark.createDataFrame([(100, ["a", "d"], 1)], docs.schema)
    a, b = nb_score_running(first, model).first(), nb_score(first, model).first()
    assert a["score_0"] == pytest.approx(b["score_0"]) and a["score_1"] == pytest.approx(b["score_1"])
    with pytest.raises(ValueError, match="neither"):
        nb_score_running(first.withColumn("label", F.lit(2)), model)


def test_tokens_counted_where_they_lie(spark):
    rows = [(1, ["b", "a", "b", "ä", "b"]), (2, []), (3, ["x"]), (4, None)]
    got = spark.createDataFrame(rows, "i long, t array<string>").select("i", counted_tokens("t").alias("c")).collect()
    want = {1: [("a", 0, 1), ("b", 1, 3), ("ä", 2, 1)], 2: [], 3: [("x", 0, 1)], 4: None}
    assert {r["i"]: r["c"] and [tuple(x) for x in r["c"]] for r in got} == want


def test_counts_leave_their_line_once(spark):
    """Tokens are shuffled with their counts only; the most frequent ones are chosen before the shuffle."""
    rows = [(i, ["word%d" % (i % 7), "again", "again", f"only{i}"]) for i in range(60)]
    lines = spark.createDataFrame(rows, "line_id long, tokens array<string>")
    top = G.topk_tokens(lines.select("line_id", F.inline(counted_tokens("tokens"))), 1)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("WindowGroupLimit") == 2
    assert {tuple(r["top_tokens"]) for r in top.collect()} == {("again",)}


@pytest.mark.parametrize("vocab", ["online", "frozen"])
@pytest.mark.parametrize("step", [1, 100_000_000])
def test_group_key_by_brute_force(spark, vocab, step):
    rng = random.Random(5)
    words = [f"w{i:03d}" for i in range(300)]
    rows = [(i * step, rng.choices(words, [1 / (j + 1) for j in range(300)], k=rng.randint(0, 12))) for i in range(400)]
    seen, want = Counter(t for _, ts in rows for t in ts) if vocab == "frozen" else Counter(), {}
    for i, ts in rows:
        if vocab == "online":
            seen.update(ts)
        want[i] = " ".join(sorted(sorted(set(ts), key=lambda t: (-seen[t], t))[:3]))
    lines = spark.createDataFrame(rows, "line_id long, tokens array<string>").repartition(3)
    assert {r["line_id"]: r["group_key"] for r in G.group_key(lines, vocab=vocab).collect()} == want


def test_cells_of_sparse_ids_are_joined(spark):
    ids = spark.range(1000).select((F.col("id") * (1 << 21)).alias("i"))
    assert P.cell_starts(ids, "i") == [0]
    starts = P.cell_starts(ids, "i", rows=300)
    assert len(starts) == 4
    df = ids.withColumns({"key": F.col("i") / (1 << 21) % 3, "v": F.lit(1)})
    got = {(r["key"], r["i"]): r["s"] for r in P.running_count(df, ["key"], "i", "v", "s", starts=starts).collect()}
    assert got == {(k % 3, k << 21): k // 3 + 1 for k in range(1000)}


def test_copies_of_blocks_grow_no_faster_than_those_of_queries():
    for visits in (10_000, 1_000_000, 100_000_000):
        chunk = R._chunk_rows(visits, 65_536, 12)
        assert R.QUERY_CHUNK <= chunk <= 65_536
        # copied rows of blocks, but for the few chunks that keep all cores busy
        assert visits / chunk * 65_536 <= max(visits, 4 * 12 * 65_536)


def test_single_precision_is_copied_as_such(spark, monkeypatch):
    kinds = []
    compare = R._compare
    monkeypatch.setattr(R, "_compare", lambda q, *a: kinds.append(q.schema["embedding"].dataType.simpleString()) or compare(q, *a))
    rng = np.random.default_rng(2)
    data = rng.normal(size=(60, 5)).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = R.knn_join(v.withColumnRenamed("id", "query_id"), v, 2, block_rows=16).collect()
    assert set(kinds) == {"array<float>"}
    full = data.astype(np.float64)
    for r in got:
        dist = ((full - full[r["query_id"]]) ** 2).sum(1)
        assert r["distance"] == pytest.approx(dist[r["candidate_id"]], abs=1e-12)
        assert r["candidate_id"] in np.argsort(dist, kind="stable")[:2]


def test_scores_gather_nothing_by_document_and_ngram(spark):
    rows = [(i, i % 2, [f"w{i % 5}", f"only{i}", None] if i else []) for i in range(50)]
    docs = spark.createDataFrame(rows, "line_id long, label int, tokens array<string>")
    scored = nb_score(docs, nb_fit(docs))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    keys = [line.split("Aggregate [")[1].split("]")[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert not [k for k in keys if "line_id" in k and "," in k]
    assert scored.count() == 50
