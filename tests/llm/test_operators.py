"""The operators against brute force, round trips and awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from timberline.llm import chat, components, exact, fm, html, omh, packing, pieces, rules, s8b, urls  # noqa: E402
from timberline.llm.queries import piece_model, word_tokenizer  # noqa: E402
from timberline.session import scratch_path  # noqa: E402

RNG = random.Random(5)
WORDS = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("n", "r", "st", "l")]
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept string, digest int, label int, "
          "words int, part int, size int, head int, block int, __id int")


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE = prose(120)
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d"), (6, BASE), (7, BASE), (8, BASE + " tail"),
    (9, BASE.replace(BASE.split()[60], "changed", 1)), (10, prose(90)), (11, "x" * 5000), (12, prose(20000)),
    (13, "été 日本 😀 naïve\nline two\n\nline two"), (14, "REPEAT THIS NOW " * 40), (10, None), (None, "no id " + prose(15)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s" + str((i or 0) % 2), len(t or ""), "k", 1, 2, 3, 4, 5, 6, 7, 8) for i, t in TEXTS]
    return spark.createDataFrame(rows + rows[5:6], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# ---------------------------------------------------------------- exact

def test_exact(spark, docs, empty):
    got = {(r.doc_id, r.text_sha256): r for r in exact.exact_dedup(docs).collect()}
    groups = {}
    for i, t in set(TEXTS):
        groups.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), set()).add(i)
    assert len(got) == sum(map(len, groups.values()))
    for (i, sha), r in got.items():
        best = max((x for x in groups[sha] if x is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (best, len(groups[sha]), i == best)
    assert exact.exact_dedup(empty).count() == 0


def test_exact_goes_on_with_an_index(spark, docs):
    path = scratch_path(spark, "index")
    index = exact.DigestIndex(spark, path, buckets=3)
    first = docs.filter("doc_id in (6, 4)")
    exact.exact_dedup(first, index).collect()
    again = exact.DigestIndex(spark, path, buckets=3)
    got = {r.doc_id: r for r in exact.exact_dedup(docs.filter("doc_id in (7, 10) and text is not null"), again).collect()}
    assert (got[7].keep_id, got[7].kept, got[7].group_size) == (6, False, 2)
    assert got[10].kept and again.scan().count() == 3
    plan = docs.select(F.sha2("text", 256).alias("text_sha256")).join(again.read().hint("merge"), "text_sha256", "left_anti")
    assert "Batched" in plan._jdf.queryExecution().toString() and "SortMergeJoin" in plan._jdf.queryExecution().toString()


def test_exact_unique_keeps_columns_and_one_of_repeated_rows(docs):
    kept = exact.exact_unique(docs, exact.exact_dedup(docs))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id in (6, 7)").collect()) == [7]
    assert exact.exact_unique(docs.filter("doc_id = 6"), exact.exact_dedup(docs.filter("doc_id = 6"))).count() == 1


# ---------------------------------------------------------------- quality rules

def naive_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    spans = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    many = {s for s in spans if spans.count(s) > 1} if len(spans) < 1000 else set()
    hit = {i + k for i, s in enumerate(spans) if s in many for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def test_rule_counts(docs, empty):
    got = rules.quality_rules(docs.filter("doc_id <> 10 and doc_id is not null")).collect()
    want = dict(TEXTS)
    for r in got:
        n = naive_counts(want[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, r.doc_id
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and (not r.kept or not r.base_failed)
    assert rules.quality_rules(empty).count() == 0


def test_boilerplate_goes_and_copies_stay(spark):
    rng = random.Random(1)
    notice = "subscribe to our letter for more of this kind every day now"
    rows = [(i, f"{prose(30, rng)}\n{notice}\n{prose(30, rng)}", "h") for i in range(60)]
    rows += [(100 + i, notice, "h") for i in range(3)]
    article = [prose(25, rng) for _ in range(6)]
    for i in range(200):  # copies with a small edit each
        copy = list(article)
        k = rng.randrange(6)
        copy[k] = copy[k].replace(copy[k].split()[3], "edited" + str(i), 1)
        rows.append((1000 + i, "\n".join(copy), "h"))
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    verdicts = rules.quality_rules(d)
    got = {r.doc_id: r for r in verdicts.collect()}
    assert all(got[i].kept and got[i].lost_words == 12 for i in range(60))
    assert not any(got[100 + i].kept for i in range(3))
    assert all(got[1000 + i].kept for i in range(200))
    clean = {r.doc_id: r.text for r in rules.cleaned(d, verdicts).collect()}
    assert len(clean) == 260 and notice not in clean[0] and len(clean[0].split()) == 60


def test_copies_do_not_hide_boilerplate(spark):
    rng = random.Random(3)
    footer = "all rights reserved by the owners of this site and of its parts"
    article = "\n".join(prose(25, rng) for _ in range(6))
    rows = [(i, f"{article}\n{footer}", "third") for i in range(50)]
    rows += [(100 + i, f"{prose(60, rng)}\n{footer}", "third") for i in range(100)]
    shared = [prose(20, rng) for _ in range(17)]
    rows += [(1000 + i, "\n".join([*shared, *(prose(20, rng) for _ in range(3))]), "shared") for i in range(60)]
    articles = ["\n".join(prose(25, rng) for _ in range(4)) for _ in range(25)]
    rows += [(2000 + i, f"{articles[i % 25]}\n{footer}", "copied") for i in range(25 * 24)]
    got = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].kept and got[i].lost_words == 13 for i in [*range(50), *range(100, 200)])
    assert all(not got[1000 + i].kept and got[1000 + i].lost_words == 340 for i in range(60))
    assert all(got[2000 + i].kept and got[2000 + i].lost_words == 13 for i in range(600))


# ---------------------------------------------------------------- classifier

def test_factorisation_machine_identity():
    rng = np.random.default_rng(0)
    x, m = rng.random((5, 7)), fm.FactorisationMachine(0.3, rng.normal(size=7), rng.normal(size=(7, 3)))
    for row, got in zip(x, m.margin(x)):
        pairs = sum((m.factors[i] @ m.factors[j]) * row[i] * row[j] for i, j in itertools.combinations(range(7), 2))
        assert got == pytest.approx(0.3 + row @ m.weight + pairs)


def test_a_repeated_id_is_learnt_from_once(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"text of {i}") for i in range(20)] + [(1, f"again {i}") for i in range(300)], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(fm, "fit", lambda x, y: seen.append((len(x), len(y))))
    fm.train(d, spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int"))
    n = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(20))
    assert seen == [(n, n)]


def test_classifier(spark, docs, empty):
    rng = random.Random(2)
    rows = [(i, prose(60, rng) if i % 2 else prose(60, rng).upper().replace(" ", "!! ")) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(7, None, 0), (None, 1, 0), (9, 5, 1)], "doc_id long, quality int, toxic int")
    model = fm.train(d, labels, sample=200)
    got = fm.score(d, model).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.doc_id % 2 for r in held) > 0.95 * len(held)
    odd = fm.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert fm.score(empty, model).count() == 0 and fm.keep_predicted(docs, model).columns == docs.columns
    assert fm.score(docs, fm.train(docs, labels.limit(0))).filter("predicted = 1").count() == docs.count()


# ---------------------------------------------------------------- near duplicates

def naive_links(texts):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets = {i: grams(t) for i, t in texts.items()}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2)
            if texts[a] != texts[b] and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    texts = {}
    for g in range(12):
        base = prose(150, rng).split()
        for c in range(rng.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts[len(texts)] = " ".join(w)
    passage = prose(60, rng)
    for _ in range(60):  # a passage in many documents brings none together
        texts[len(texts)] = passage + " " + prose(60, rng)
    base = prose(80, rng).split()
    for _ in range(80):  # one large family, some pairs above the limit and some below
        w = list(base)
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts[len(texts)] = " ".join(w)
    links = naive_links(texts)
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[root(a)] = root(b)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in omh.near_duplicates(d).collect()}
    classes = {}
    for i in texts:
        classes.setdefault(root(i), []).append(i)
    assert got == {i: max(c) for c in classes.values() for i in c}


def test_near_duplicates_of_awkward_rows(docs, empty):
    rows = omh.near_duplicates(docs.filter("not (doc_id = 10 and text is null)")).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(TEXTS) - 1
    assert {got[i].class_id for i in (6, 7, 8, 9)} == {9} and got[9].kept and not got[6].kept
    assert got[1].class_id == got[2].class_id == 2 and got[None].class_id is None and got[None].kept
    assert omh.near_duplicates(empty).count() == 0


def test_banded_alignment():
    rng = random.Random(4)
    for _ in range(50):
        a = [rng.randrange(6) for _ in range(rng.randint(0, 30))]
        b = [x for x in a if rng.random() > 0.1] + [rng.randrange(6) for _ in range(rng.randint(0, 3))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert omh.banded_alignment(a, b, 40) == table[-1][-1]


def test_order_minhash_follows_order():
    a = np.arange(1, 200, dtype=np.uint64)
    with np.errstate(over="ignore"):
        same = omh.order_minhash(a)
        turned = omh.order_minhash(np.concatenate([a[100:], a[:100]]))
    assert (same == omh.order_minhash(a)).all() and (same == turned).mean() < 0.6


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert components.components(links.limit(0)).count() == 0


# ---------------------------------------------------------------- tokens

def reference_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokenizer()).encode(text or "", add_special_tokens=False).ids + [2]


def test_simple8b_round_trip():
    rng = random.Random(6)
    for n in (0, 1, 2, 61, 500):
        ids = np.array([rng.choice([0, 1, 3, 500, 49000, 1 << 40, 1 << 62]) for _ in range(n)], np.uint64)
        assert (s8b.unpack(*s8b.pack(ids)) == ids).all()
    zeros = np.zeros(480, np.uint64)
    assert len(s8b.pack(zeros)[0]) == 2


def test_token_files(spark, docs, empty):
    d = docs.filter("doc_id is not null and not (doc_id = 10 and text is null)").dropDuplicates(["doc_id"])
    path = scratch_path(spark, "tokens")
    s8b.write_token_files(d, path, word_tokenizer(), block_ids=300)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in s8b.read_token_files(spark, path).collect())
    at, texts = 0, dict(t for t in TEXTS if t != (10, None))
    for i, start, n, crc in got:
        ids = reference_ids(texts[i])
        assert (start, n, crc) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        at += n
    assert len(got) == d.count() and s8b.token_files(empty, word_tokenizer()).count() == 0


def test_packing(spark, docs, empty):
    rows = packing.pack_documents(docs.repartition(9), word_tokenizer(), group_ids=5000).collect()
    want = {}
    for i, t in [*TEXTS, TEXTS[5]]:
        want.setdefault(i, []).append(reference_ids(t))
    used, windows = {}, {}
    for r in rows:
        used[(r.doc_id, r.doc_tokens)] = used.get((r.doc_id, r.doc_tokens), 0) + r.length
        fits = [ids for ids in want[r.doc_id] if len(ids) == r.doc_tokens]
        assert any(zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for ids in fits)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(used.values()) == sum(len(x) for v in want.values() for x in v)
    padded = 0
    for pieces_ in windows.values():
        end = 0
        for offset, length in sorted(pieces_):
            assert offset == end
            end += length
        assert end <= 4096
        padded += bin(end).count("1") > 1
    assert padded <= 2
    assert packing.pack_documents(empty, word_tokenizer()).count() == 0


def test_sentencepiece(docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    d = docs.filter("doc_id is not null and not (doc_id = 10 and text is null)").dropDuplicates(["doc_id"])
    encoded = pieces.encode(d, piece_model())
    texts = dict(t for t in TEXTS if t != (10, None))
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in encoded.collect()}
    assert got == {i: model.encode(t or "") for i, t in texts.items() if i is not None}
    assert {r.doc_id: r.text for r in pieces.decode(encoded, piece_model()).collect()} == {
        i: t or "" for i, t in texts.items() if i is not None}
    assert pieces.encode(empty, piece_model()).count() == 0


# ---------------------------------------------------------------- urls

def test_urls(spark):
    rows = [(1, "https://A.Example.org/es/x"), (2, "http://example.org/en/12?x"), (3, "http://shop.com/de/1"), (4, "http://shop.com/fr/"),
            (5, None), (6, "no scheme"), (7, "http://x.net?q=/a"), (8, "http://com/de/#"), (9, "ftp://notorg/"), (9, "ftp://notorg/")]
    rows += [(100 + i, f"http://h{i}.com/de/{i}") for i in range(20)] + [(200 + i, f"http://h{i}.org/en/{i}") for i in range(20)]
    rows += [(300, "http://other.com/de"), (301, "http://w.net/zz/1")]
    d = spark.createDataFrame([(i, u, "h", 1) for i, u in rows], "page_id long, url string, host string, tokens int")
    got = {r.page_id: r for r in urls.judge(d).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (got[2].rule, got[2].verdict) == ("example.org/en/1", "block") and got[3].verdict == "block"
    assert got[4].rule == "com/fr/" and got[8].rule == "com/de/" and got[9].rule is None
    assert (got[5].host, got[5].path, got[6].host, got[7].host, got[7].path) == ("", "", "", "x.net", "")
    assert got[5].verdict == "allow" and got[301].verdict == "allow" and urls.judge(d).count() == len(rows)
    assert urls.judge(d.limit(0)).count() == 0


def test_url_rules_against_brute_force(spark):
    rng = random.Random(8)
    baskets = [(sorted(rng.sample("abcdef", rng.randint(1, 4))), rng.choice(["allow", "block", "block"])) for _ in range(80)]
    d = spark.createDataFrame(baskets, "tokens array<string>, verdict string")
    want = {}
    for size in range(1, 5):
        for s in itertools.combinations("abcdef", size):
            has = [v for t, v in baskets if set(s) <= set(t)]
            for v in ("allow", "block"):
                if has and has.count(v) >= 0.05 * len(baskets) and has.count(v) / len(has) >= 0.8:
                    want[(s, v)] = has.count(v) / len(has)
    got = {(tuple(r.antecedent), r.verdict): r.confidence for r in urls.mine(d, 0.05, 0.8).collect()}
    assert got == pytest.approx(want)


# ---------------------------------------------------------------- pages

def page(main, extra=""):
    return (f"<html><head><title>t</title><script>var x='</p>';</script></head><body><nav><ul><li><a href=/>home page</a></li></ul></nav>"
            f"<div class=ad>buy it now</div><article>{main}</article>{extra}<footer>&copy; someone</footer></body></html>")


def test_main_text(spark):
    rng = random.Random(9)
    rows = [(i, f"http://x/{i}", page(f"<h1>{prose(5, rng)}</h1>" + "".join(f"<p>{prose(30, rng)}</p>" for _ in range(4)))) for i in range(60)]
    body = [prose(8, rng), prose(25, rng) + " & more", prose(12, rng)]
    tail = '<div class="comments"><p>I liked this one a lot</p></div><aside>related things to read</aside>'
    rows += [(100, "u", page(f"<h1>{body[0]}</h1><p><b>{body[1].replace('&', '&amp;')}<br><p>  {body[2]}\n", tail)), (101, "u", None), (102, None, ""), (103, "u", "<b>")]
    d = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    trees = html.train(d, sample=40, rounds=8)
    got = {r.page_id: r for r in html.extract(d, trees).collect()}
    assert got[100].text == "\n".join(body) and got[100].n_chars == len(got[100].text)
    assert [got[i].text for i in (101, 102, 103)] == ["", "", ""]
    right = sum(got[i].text.count("\n") == 4 and "buy it now" not in got[i].text for i in range(60))
    assert right == 60 and html.extract(d.limit(0), trees).count() == 0


def test_decoding_never_contradicts():
    rng = np.random.default_rng(1)
    p = html.Page("<div><section><p>one two</p><div><p>three</p><ul><li>four</li></ul></div></section><p>five</p></div>")
    for _ in range(50):
        main = html.decode(p, rng.normal(size=len(p.nodes)) * 5)
        for i, node in enumerate(p.nodes):
            path, at = [], i
            while at >= 0:
                path.append(main[at])
                at = p.nodes[at].parent
            # outside, then main, then cut: main is one stretch of every path
            assert "".join("m" if x else "." for x in path).strip(".").count(".") == 0


# ---------------------------------------------------------------- transcripts

def test_viterbi_in_blocks_equals_one_pass():
    rng = np.random.default_rng(2)
    n = len(chat.STATES)
    model = chat.Model(np.log(rng.dirichlet(np.ones(n))), np.log(rng.dirichlet(np.ones(n), n)), {}, np.zeros(n))
    e = rng.normal(size=(60, n))
    parts = [e[:7], e[7:8], e[8:40], e[40:]]
    ends = chat.chain([chat.transfer(model, x) for x in parts])
    got = [s for x, (a, b) in zip(parts, ends) for s in chat.viterbi(model, x, a, b)]
    assert got == chat.viterbi(model, e, -1, -1)


def test_transcripts(spark):
    rng = random.Random(10)
    turns = []
    for c in range(120):
        for t in range(rng.randint(2, 6)):
            role = ("user", "assistant")[t % 2]
            text = prose(rng.randint(4, 9), rng).capitalize() + "?" if role == "user" else "\n".join(prose(30, rng).capitalize() + "." for _ in range(3))
            turns.append((c, t, role, text))
    lines = chat.transcripts(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    model = chat.fit(lines.filter("conv_id % 5 <> 0"))
    got = {}
    for r in chat.parse(lines.filter("conv_id % 5 = 0").select("conv_id", "pos", "line", F.lit(1).alias("turn_no"), F.lit(2).alias("b1")), model).collect():
        got.setdefault(r.conv_id, []).append((r.turn_no, r.role, r.text))
        assert r.rendered == f"<|{r.role}|>\n{r.text}\n<|end|>"
    right = sum((t, role, text) in got[c] for c, t, role, text in turns if c % 5 == 0)
    assert right > 0.9 * sum(c % 5 == 0 for c, *_ in turns)
    odd = spark.createDataFrame([(None, 0, "User: hi"), (None, 0, "User: hi"), (1, None, None), (2, 5, "x" * 20000)], "conv_id long, pos long, line string")
    assert {(r.conv_id, len(r.text)) for r in chat.parse(odd, model).collect()} == {(None, 2), (1, 0), (2, 20000)}
    assert chat.parse(odd.limit(0), model).count() == 0


def test_a_conversation_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_ROWS", 8)
    lines = spark.createDataFrame([(1, t << 20, f"{'User' if t % 2 == 0 else 'Assistant'}: word number {t}.", ("user", "assistant")[t % 2], True) for t in range(600)],
                                  "conv_id long, pos long, line string, role string, is_start boolean")
    model = chat.fit(lines)
    got = chat.parse(lines, model).orderBy("turn_no").collect()
    assert [(r.turn_no, r.text) for r in got] == [(t, f"word number {t}.") for t in range(600)]


def test_long_turns_are_decoded_in_order(spark):
    rng = random.Random(12)
    named = [f"{('User', 'Assistant')[t % 2]}: " if t % 3 == 0 else "" for t in range(10000)]
    texts = [mark + prose(rng.randint(3, 12), rng).capitalize() + rng.choice(".?") for mark in named]
    rows = [(1, (5 << 20) + n, x) for n, x in enumerate(texts)] + [(2, n, x) for n, x in enumerate(texts)]
    rows += [(3, 7, x) for x in texts[:5000]] + [(4, 0, "User: hi"), (4, 1, "Assistant: ho")]
    fitted = [(9, t << 20, f"{('User', 'Assistant')[t % 2]}: word number {t}.", ("user", "assistant")[t % 2], True) for t in range(50)]
    fitted += [(9, (t << 20) + 1, "more of it.", ("user", "assistant")[t % 2], False) for t in range(50)]
    model = chat.fit(spark.createDataFrame(fitted, "conv_id long, pos long, line string, role string, is_start boolean"))
    got = {}
    for r in chat.parse(spark.createDataFrame(rows, "conv_id long, pos long, line string"), model).orderBy("turn_no").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv in (1, 2, 3, 4):
        lines = [x for _, _, x in sorted(r for r in set(rows) if r[0] == conv)]
        want = []
        for line, state in zip(lines, chat.viterbi(model, model.emissions(lines), -1, -1)):
            role, starts = chat.STATES[state]
            if starts or not want:
                want.append([role, chat.marker(line)[1] if starts else line])
            else:
                want[-1][1] = want[-1][1] + "\n" + line if want[-1][1] else line
        assert got[conv] == [tuple(x) for x in want], conv


def test_features_of_odd_texts():
    t = pa.array(["", "a", "\n\n", "!!! ###", "x" * 10000]).cast(pa.large_string())
    assert np.isfinite(fm.features(t)).all()
