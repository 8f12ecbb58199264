import copy
import random

import pytest
from pyspark.sql import functions as F

from model import STAR, Bayes, Miner, merge, pattern
from timberline.functions.stopwords import DEFAULT_STOP_WORDS
from timberline.functions.text import matches_pieces, template_pieces, template_to_regex
from timberline.operators import mining as M
from timberline.operators.bayes import NgramCounts
from timberline.operators.grouping import frozen_path, prefix_path
from timberline.operators.verdicts import feedback_lookup
from timberline.plans import detector as D
from timberline.sources.sinks import load_model, save_model

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "node", "fail", "start", "stop", "unit"]


def random_lines(seed, n, hot=0.0, words=WORDS):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if rng.random() < hot:
            tokens = ["alpha", "beta", "gamma", "delta"] + rng.choices(words, k=rng.randint(0, 4))
        else:
            tokens = rng.choices(words, k=rng.randint(0, 7))
        if tokens and rng.random() < 0.2:
            tokens[0] = str(rng.randint(1, 99))
        out.append((i + 1, " ".join(tokens), int("fail" in tokens)))
    return out


def tokens_of(text):
    tokens = text.split(" ") if text else []
    return [STAR] + tokens[1:] if tokens and tokens[0].isdigit() else tokens


def frame(spark, rows):
    return spark.createDataFrame(rows, "line_id long, content string, label int").repartition(3)


@pytest.mark.parametrize("seed,hot,chunk", [(1, 0.0, 4096), (2, 0.5, 7), (3, 0.9, 3)])
def test_mining_equals_ordered_pass(spark, seed, hot, chunk):
    rows = random_lines(seed, 300, hot)
    miner = Miner(3, 4, 2, 0.5, DEFAULT_STOP_WORDS)
    want = {i: miner.add(i, tokens_of(text)) for i, text, _ in rows}
    mined = M.mine_templates(frame(spark, rows), first_chunk=chunk)
    got = {r["line_id"]: r for r in mined.assignments.collect()}
    assert len(got) == len(rows)
    for i, (_, _, cluster, snapshot) in want.items():
        assert got[i]["template_id"] == cluster
        assert got[i]["snapshot"] == snapshot
    sizes = mined.templates.agg(F.sum("size")).head()[0]
    assert sizes == len(rows)
    last = {cluster: snapshot for _, _, cluster, snapshot in want.values()}
    final = {r["template_id"]: r for r in mined.templates.collect()}
    assert set(final) == set(last)
    for tid, r in final.items():
        members = [i for i in want if want[i][2] == tid]
        assert r["tokens"] == want[max(members)][3]
        assert r["group_key"] == want[tid][0] and r["path"] == want[tid][1]
        assert r["label"] == rows[max(members) - 1][2] and r["size"] == len(members)


def test_shared_words_hold_no_template_of_a_wide_leaf():
    leaf = M._Leaf(0.5)
    for i in range(50):
        leaf.add(i, f"a b c u{i} v{i} x{i} y{i}")
    assert len(leaf.ids) == 50
    assert all(len(leaf.by_token.get(t, ())) < 3 for t in "abc")


def test_each_round_tests_a_window(spark, monkeypatch):
    tested, test = [], M._test_rest
    monkeypatch.setattr(M, "_test_rest", lambda rest, *a: tested.append(rest.count()) or test(rest, *a))
    rows = [(i, "g", [], [f"u{i}", f"v{i}"]) for i in range(1, 61)]
    lines = spark.createDataFrame(rows, "line_id long, group_key string, path array<string>, tokens array<string>")
    members, found = M.cluster_leaves(lines, depth=0, first_chunk=4)
    assert sum(tested) < 20
    assert sorted(r["template_id"] for r in found.collect()) == [r["line_id"] for r in members.orderBy("line_id").collect()]


def test_a_leaf_its_lines_go_on_changing_is_one_round(spark, monkeypatch):
    tested, test = [], M._test_rest
    monkeypatch.setattr(M, "_test_rest", lambda rest, *a: tested.append(1) or test(rest, *a))
    rows = [(i, "g", [], [f"u{i}", f"v{i}"]) for i in range(1, 301)]
    lines = spark.createDataFrame(rows, "line_id long, group_key string, path array<string>, tokens array<string>")
    members, found = M.cluster_leaves(lines, depth=0, first_chunk=4)
    assert found.count() == members.count() == 300
    assert not tested


@pytest.mark.parametrize("st", [0.3, 0.5, 0.8])
def test_wide_leaf_equals_every_template_compared(st):
    rng = random.Random(int(st * 10))
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    kinds = [[rng.choices(words, weights)[0] for _ in range(rng.randint(0, 14))] for _ in range(60)]
    leaf, known = M._Leaf(st, words[5:0:-1]), []
    for i in range(700):
        tokens = [t if rng.random() < 0.85 else rng.choice(words + [STAR]) for t in rng.choice(kinds)]
        text, best = " ".join(tokens), (-1.0, -1)
        for slot, (_, template) in enumerate(known):
            both, either = set(template) & set(tokens), set(template) | set(tokens)
            sim = 1.0 if pattern(template).match(text) else len(both) / len(either) if either else 0.0
            best = max(best, (sim, slot))
        if best[0] >= st:
            want = best[1]
            known[want] = known[want][0], merge(known[want][1], tokens)
        else:
            want = len(known)
            known.append((i, tokens))
        assert leaf.add(i, text) == want
        assert list(leaf.tokens[want]) == known[want][1]


def test_two_words_in_common_make_no_candidate():
    rng = random.Random(3)
    leaf = M._Leaf(0.5)
    for i in range(400):
        leaf.add(i, " ".join([f"p{rng.randint(0, 19)}", f"q{rng.randint(0, 19)}", *(f"u{i}{c}" for c in "abcdefgh")]))
    again = [f"p{i}" for i in range(20)] + [f"u{i}a" for i in range(4)]
    assert len(leaf.ids) == 400
    assert sum(len(leaf._near(frozenset([p, q, *"rstuvwxy"]))) for p, q in zip(again, again[1:])) == 0


def test_lines_that_share_frequent_words_are_no_candidates(spark):
    rows = [(i, 1, i, ["a", "b", "c", f"u{i}", f"v{i}", f"w{i}"]) for i in range(20)]
    templates = spark.createDataFrame(rows, "template_id long, leaf long, created_seq long, tokens array<string>")
    lines = templates.select((F.col("template_id") + 10).alias("line_id"), "leaf", F.transform(
        "tokens", lambda t: F.concat(t, F.when(F.length(t) > 1, "x").otherwise(""))).alias("tokens"))
    near = templates.select(F.col("template_id").alias("line_id"), "leaf", "tokens").unionByName(lines.filter("line_id > 20"))
    pairs = M._candidate_pairs(near, templates, 0.5)
    assert sorted(map(tuple, pairs.collect())) == [(i, i) for i in range(20)]


def test_mining_goes_on_from_earlier_lines(spark):
    rows = random_lines(5, 260, 0.4)
    miner = Miner(3, 4, 2, 0.5, DEFAULT_STOP_WORDS)
    want = {i: miner.add(i, tokens_of(text)) for i, text, _ in rows}
    first = M.mine_templates(frame(spark, rows[:150]))
    then = M.mine_templates(frame(spark, rows[150:]), base=first, first_chunk=5)
    got = {r["line_id"]: r for r in then.assignments.collect()}
    for i in range(151, 261):
        assert (got[i]["template_id"], got[i]["snapshot"]) == want[i][2:]
    sizes = {r["template_id"]: r["size"] for r in then.templates.collect()}
    for tid, size in sizes.items():
        assert size == sum(1 for w in want.values() if w[2] == tid)
    assert {r["token"]: r["n"] for r in then.vocab.collect()} == dict(miner.counts)


def test_detector_equals_ordered_pass(spark, tmp_path):
    rows = random_lines(7, 240, 0.3)
    train, test = rows[:160], rows[160:]
    miner, bayes = Miner(3, 4, 2, 0.5, DEFAULT_STOP_WORDS), Bayes()
    for i, text, label in train:
        bayes.fit(miner.add(i, tokens_of(text))[3], label)
    detector, metrics = D.fit_detector(frame(spark, train))
    assert 0 <= metrics.head()["f1"] <= 1
    save_model(detector, str(tmp_path / "model"))
    detector = load_model(spark, str(tmp_path / "model"), D.Detector, {"counts": NgramCounts})
    counts = {(r["ngram"], r["label"]): r["n"] for r in detector.counts.ngram_counts.collect()}
    assert counts == {(t, l): n for t, c in bayes.grams.items() for l, n in c.items() if n}
    lines = frame(spark, test).withColumn("event_template", F.col("content"))
    # every line judged counts for the next
    other, counting, want, seen = copy.deepcopy(miner), copy.deepcopy(bayes), {}, set()
    for i, text, label in test:
        if text not in seen:
            seen.add(text)
            snapshot = other.add(i, tokens_of(text))[3]
            want[i] = counting.predict(snapshot)
            counting.fit(snapshot, label)
    updated, _ = D.detect_lines(lines, detector, update=True)
    assert {r["line_id"]: r["prediction"] for r in updated.collect()} == want
    got, _ = D.detect_lines(lines, detector)
    got = {r["line_id"]: r["prediction"] for r in got.collect()}
    seen, want = set(), {}
    for i, text, _ in test:
        if text not in seen:
            seen.add(text)
            want[i] = bayes.predict(miner.add(i, tokens_of(text))[3])
    assert got == want
    # templates that stay as they are: every line still gets a verdict
    frozen, _ = D.detect_lines(lines, detector, online=False)
    assert {r["line_id"] for r in frozen.collect()} == set(want)


def test_feedback_adds_counts(spark):
    rows = random_lines(9, 80)
    detector, _ = D.fit_detector(frame(spark, rows))
    verdicts = spark.createDataFrame(
        [("unit fail stop", "anomaly"), ("node start", "normal"), ("bad", "maybe")], "query string, prediction string"
    )
    after = D.apply_feedback(detector, verdicts)
    before = {r["label"]: r["n"] for r in detector.counts.class_counts.collect()}
    now = {r["label"]: r["n"] for r in after.counts.class_counts.collect()}
    assert now == {0: before[0] + 1, 1: before[1] + 1}
    assert after.last_seq == 82


@pytest.mark.parametrize("seed", range(4))
def test_prefix_path_equals_tree(spark, seed):
    rng = random.Random(seed)
    rows = [
        (i, rng.choice("xy"), rng.choices(["a", "b", "c", STAR], [4, 3, 2, 1], k=rng.randint(0, 5)))
        for i in range(200)
    ]
    miner = Miner(3, 3, 2, 0.5, [])
    want = {i: miner.add(i, tokens, group=g)[1] for i, g, tokens in rows}
    df = spark.createDataFrame(rows, "line_id long, group_key string, tokens array<string>")
    pathed, branches = prefix_path(df, 3, 2)
    assert {r["line_id"]: r["path"] for r in pathed.collect()} == want
    # the same lines again follow the branches they made
    again = frozen_path(df, branches, 3)
    assert {r["line_id"]: r["path"] for r in again.collect()} == want


def test_pieces_equal_pattern(spark):
    rng = random.Random(0)
    rows = []
    for i in range(600):
        template = rng.choices(["a", "b", "ab", STAR], k=rng.randint(0, 5))
        text = rng.choices(["a", "b", "ab", "c"], k=rng.randint(0, 6))
        rows.append((i, template, " ".join(text)))
    df = spark.createDataFrame(rows, "i long, t array<string>, s string")
    out = df.select(
        "i", matches_pieces("s", template_pieces("t")).alias("m"), template_to_regex("t").alias("r"),
        F.rlike("s", F.concat(F.lit("(?d)"), template_to_regex("t"))).alias("j"),
    ).collect()
    for r in out:
        _, template, text = rows[r["i"]]
        want = bool(pattern(template).match(text))
        assert r["m"] == want == r["j"], (template, text)
        assert M._fits(text, M._pieces(" ".join(template))) == want


def claims_in_order(rows):
    """Claims of an ordered pass, and the claimants of each group in order."""
    want, heads = {}, {}
    for group in {r[1] for r in rows}:
        order = sorted((r for r in rows if r[1] == group), key=lambda r: (-r[2].count(STAR), -len(r[2]), r[0]))
        for tid, _, tokens in order:
            if tid in want:
                continue
            want[tid] = tid
            heads.setdefault(group, []).append((tid, tokens))
            for other, _, others in order:
                if other not in want and pattern(tokens).match(" ".join(others)):
                    want[other] = tid
    return want, heads


@pytest.mark.parametrize("seed", range(6))
def test_subsume_equals_ordered_pass(spark, seed):
    rng = random.Random(seed)
    words = ["a", "b", "ab", "bab", STAR, STAR] if seed % 2 else ["a", "b", "c", STAR]
    rows = [
        (i, rng.choice("xy"), rng.choices(words, k=rng.randint(0, 6))) for i in range(160)
    ]
    df = spark.createDataFrame(rows, "template_id long, group_key string, tokens array<string>")
    got = {r["template_id"]: r["claimant_id"] for r in M.subsume_templates(df).collect()}
    assert got == claims_in_order(rows)[0]


def test_claims_look_again(spark):
    # the first matches the second and the second the third, but the first does not match the third
    rows = [
        (1, "g", ["a", STAR, "b", STAR, STAR, STAR]), (2, "g", ["a", STAR, STAR, "b", STAR]), (3, "g", ["a", "b", "x"]),
        (4, "g", ["a", "b", "x"]), (5, "h", [STAR, STAR, "end"]), (6, "h", ["week", "weekend"]), (7, "h", ["weekend", "off"]),
        (8, "i", []), (9, "i", []), (10, "i", [STAR]), (11, "i", [STAR, STAR]), (12, "i", ["x"]),
    ]
    df = spark.createDataFrame(rows, "template_id long, group_key string, tokens array<string>")
    got = {r["template_id"]: r["claimant_id"] for r in M.subsume_templates(df).collect()}
    assert got == claims_in_order(rows)[0]
    assert (got[2], got[3], got[4], got[6], got[7]) == (1, 3, 3, 5, 7)


@pytest.mark.parametrize("seed", range(3))
def test_reinsertion_equals_ordered_insert(spark, seed):
    rng = random.Random(seed)
    rows = [(i + 1, rng.choice("xyz"), rng.choices(["a", "b", "c", "d", "e", STAR], k=rng.randint(1, 6))) for i in range(90)]
    rows += [(200, "alone", ["q", "r"]), (201, "alone", ["s"])]
    sizes = {r[0]: rng.randint(1, 9) for r in rows}
    df = spark.createDataFrame(
        [(i, g, t, sizes[i], i % 2) for i, g, t in rows],
        "template_id long, group_key string, tokens array<string>, size long, label int")
    claims, heads = claims_in_order(rows)
    changed, found, _, moved = M.reinsert_templates(df, M.subsume_templates(df), 2, 2, 0.5, last_seq=1000)
    groups = {g for i, g, _ in rows if claims[i] != i}
    assert {r[0] for r in changed.collect()} == groups and "alone" not in groups
    miner, new_of = Miner(3, 2, 2, 0.5, []), {}
    order = sorted(((-t.count(STAR), -len(t), i, g, t) for g in groups for i, t in heads[g]))
    for place, (_, _, i, g, t) in enumerate(order, 1001):
        new_of[i] = miner.add(place, t, group=g)[2]
    want = {}
    for root in miner.roots.values():
        nodes = [root]
        while nodes:
            node = nodes.pop()
            nodes += node.kids.values()
            want.update({c["id"]: c["tokens"] for c in node.clusters})
    got = {r["template_id"]: r for r in found.collect()}
    assert {i: r["tokens"] for i, r in got.items()} == want
    mapped = {i: new_of[claims[i]] for i, g, _ in rows if g in groups}
    assert {r["template_id"]: r["new_id"] for r in moved.collect()} == mapped
    for new, r in got.items():
        assert r["size"] == sum(sizes[i] for i in mapped if mapped[i] == new)
        assert r["label"] == max(i for i in mapped if mapped[i] == new) % 2


def test_generalize_and_delta(spark):
    rng = random.Random(4)
    rows = [(i, i % 3, rng.choices(["a", "b", "c", "d"], k=rng.randint(1, 5))) for i in range(30)]
    df = spark.createDataFrame(rows, "line_id long, template_id long, tokens array<string>")
    got = {r["template_id"]: r["tokens"] for r in M.generalize_template(df).collect()}
    for tid in range(3):
        fold = []
        for _, t, tokens in rows:
            if t == tid:
                fold = merge(fold, tokens)
        assert got[tid] == fold
    templates = spark.createDataFrame([(0, "a"), (1, "b"), (4, "c")], "template_id long, template string")
    gone = spark.createDataFrame([(0,), (4,)], "template_id long")
    new = spark.createDataFrame([(0, "x"), (4, "y")], "template_id long, template string")
    recent = spark.createDataFrame([(1,), (4,)], "template_id long")
    out, left = M.apply_template_delta(templates, gone, new, recent)
    assert sorted(map(tuple, out.collect())) == [(1, "b"), (5, "x"), (6, "y")]
    assert [r[0] for r in left.collect()] == [1]


def test_feedback_lookup_equals_scan(spark):
    rng = random.Random(6)
    vocab = ["a", "b", "ab", "ba", STAR]
    templates = [(i, rng.choices(vocab, [3, 3, 2, 2, 4], k=rng.randint(1, 5))) for i in range(80)]
    stored = [(" ".join(rng.choices(vocab[:4], k=rng.randint(1, 4))), rng.random(), i) for i in range(60)]
    got = {
        r["template_id"]: (r["score"], r["level"])
        for r in feedback_lookup(
            spark.createDataFrame(templates, "template_id long, tokens array<string>"),
            spark.createDataFrame(stored, "template string, score double, seq long"),
        ).collect()
    }
    cache = {}
    for text, score, _ in stored:
        cache[text] = score
    for tid, tokens in templates:
        text = " ".join(tokens)
        want = (cache[text], 1) if text in cache else (None, None)
        if text not in cache:
            for s, score in cache.items():
                if pattern(tokens).match(s):
                    want = (score, 2)
        assert got[tid] == want, tokens


def test_feedback_words_carry_no_text(spark, monkeypatch):
    from timberline.operators import verdicts as V

    seen, write = {}, V.materialize
    monkeypatch.setattr(V, "materialize", lambda df, name="step": seen.setdefault(name, write(df, name)))
    text = " ".join(f"word{i}" for i in range(200))
    out = feedback_lookup(
        spark.createDataFrame([(1, ["word0", STAR, "word150", STAR])], "template_id long, tokens array<string>"),
        spark.createDataFrame([(text, 0.5, 7), ("other " + text, 0.1, 8)], "template string, score double, seq long"))
    assert [tuple(r) for r in out.collect()] == [(1, 0.5, 2)]
    # the string that begins with another word is no candidate
    assert seen["candidates"].columns == ["template_id", "_at"] and seen["candidates"].count() == 1


def test_index_serves_many_matches(spark, monkeypatch):
    schema = "template_id long, created_seq long, group_key string, path array<string>, tokens array<string>"
    rows = [(i, i, "g", [], ["a", f"u{i}", STAR, f"w{i % 4}"]) for i in range(12)]
    templates = spark.createDataFrame(rows, schema)
    lines = templates.select((F.col("template_id") + 6).alias("line_id"), "group_key", "path", F.transform(
        "tokens", lambda t: F.when(t == STAR, "x y").otherwise(t)).alias("tokens"))
    plain = M.match_templates(lines, templates).collect()
    index = M.index_templates(templates)
    written, write = [], M.materialize
    monkeypatch.setattr(M, "materialize", lambda df, name="step": written.append(name) or write(df, name))
    assert sorted(M.match_templates(lines, index).collect()) == sorted(plain) != []
    assert "known_templates" not in written


def test_only_asked_leaves_are_indexed(spark, monkeypatch):
    schema = "template_id long, created_seq long, group_key string, path array<string>, tokens array<string>"
    rows = [(i, i, f"g{i % 3}", [], ["a", f"u{i // 3}", STAR, f"w{i % 4}"]) for i in range(30)]
    templates = spark.createDataFrame(rows, schema)
    lines = templates.filter("group_key = 'g1'").withColumnRenamed("template_id", "line_id").drop("created_seq")
    plain = M.match_templates(lines, M.index_templates(templates)).collect()
    written, write = {}, M.materialize
    monkeypatch.setattr(M, "materialize", lambda df, name="step": written.setdefault(name, []).append(write(df, name)) or written[name][-1])
    assert sorted(M.match_templates(lines, templates).collect()) == sorted(plain) and len(plain) == 10
    assert written["known_templates"][0].count() == 10
    # every token of every template is met once, for similar lines and for lines a pattern fits
    assert len(written["ordered"]) == 1 and written["ordered"][0].count() == 10


def test_long_runs_of_wildcards_fit_the_stack(spark):
    tokens = F.concat(F.array(F.lit("a")), F.array_repeat(F.lit(STAR), 40000), F.array(F.lit("b")))
    row = spark.range(1).select(tokens.alias("tokens")).select(
        template_pieces("tokens").alias("pieces"), template_to_regex("tokens").alias("regex")).first()
    assert row["pieces"] == ["a ", "b"] and row["regex"].startswith("^a")


def test_mining_leaves_only_its_result_behind(spark):
    from timberline.session import list_names, shared_dir

    where = f"{shared_dir(spark)}/timberline"
    before = set(list_names(spark, where))
    rows = [(i, f"unit {i % 7} sent {'x' * (i % 5)} {i}", i % 2) for i in range(300)]
    mined = M.mine_templates(spark.createDataFrame(rows, "line_id long, content string, label int"), first_chunk=20)
    left = {n.rsplit("-", 1)[0] for n in set(list_names(spark, where)) - before}
    assert left == {"members", "templates", "vocab", "branches"}
    assert mined.assignments.count() == 300 and mined.templates.agg(F.sum("size")).head()[0] == 300
