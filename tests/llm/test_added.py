"""Periodic runs, token counts and ranked search against brute force and the library."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from timberline.llm import chat, counts, html, omh, pieces, rules, runs, search  # noqa: E402
from timberline.llm.queries import QUERIES, byte_tokenizer, piece_model, word_tokenizer  # noqa: E402

from .test_operators import TEXTS, docs, empty, prose  # noqa: E402, F401

# ---------------------------------------------------------------- periodic runs


def brute_runs(words):
    found, n = {}, len(words)
    codes = np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if n else np.zeros(0, int)
    for q in range(1, n // 2 + 1):
        same = np.append(codes[q:] == codes[:-q], False)
        i = 0
        for j in np.flatnonzero(~same).tolist():
            if j > i and j - i + q >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plant(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def binary_runs(seed):
    """Texts with runs of long periods that are periodic themselves."""
    rng = random.Random(seed)
    kind = rng.randrange(6)
    if kind == 0:
        return rng.choices("ab", k=rng.randint(0, 500))
    if kind == 1:
        unit = rng.choices("abc", k=rng.randint(1, 120))
        return rng.choices("abc", k=9) + unit * rng.randint(1, 6) + unit[:rng.randint(0, len(unit))]
    if kind == 2:
        return (["a"] * rng.randint(1, 150) + ["b"]) * rng.randint(1, 5) + ["a"] * rng.randint(0, 100)
    if kind == 3:
        return (["a", "b"] * rng.randint(5, 100) + ["a"]) * rng.randint(2, 4) + ["a", "b"] * 20
    if kind == 4:
        a, b = ["a"], ["a", "b"]
        for _ in range(rng.randint(5, 11)):
            a, b = b, b + a
        return b * rng.randint(1, 2)
    out = ["a"]
    for _ in range(rng.randint(5, 9)):
        out = out + ["b" if x == "a" else "a" for x in out]
    return out + out[:rng.randint(0, len(out))]


def test_runs_against_brute_force(spark):
    texts = {i: " ".join(binary_runs(i)) for i in range(150)}
    frame = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, runs string")
    n = 0
    for r in runs.periodic_runs(frame).collect():
        words = texts[r.doc_id].split()
        want = brute_runs(words)
        assert [tuple(x) for x in r.runs] == want
        gone = {i for a, length, q in want for i in range(a + q, a + length)}
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
        n += sum(q > runs.SHORT for _, _, q in want)
    assert n > 500


def test_runs_odd_rows(spark, docs, empty):  # noqa: F811
    rows = TEXTS + [(20, "la " * 50), (21, prose(40) + "\n" + "x y z\t" * 9), TEXTS[5]]
    frame = spark.createDataFrame([(i, t, "r") for i, t in rows], "doc_id long, text string, n_words string")
    want = []
    for i, t in rows:
        words = plant(i, words_of(t)) if i is not None else words_of(t)
        found = brute_runs(words) if len(words) < 5000 else None
        want.append((i, words, found))
    got = runs.periodic_runs(runs.planted(frame)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs]))
    for i, words, found in want:
        assert any(n == len(words) and (found is None or found == x) for n, x in by_id[i])
    assert runs.digest(runs.periodic_runs(empty)).count() == 0


def test_runs_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, prose(rng.randint(0, 300), rng)) for i in range(120)] + [(1000, None), (1001, "a " * 30), (1002, " \n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        words = plant(i, words_of(t))
        found = brute_runs(words)
        best = min(((-n, a, q) for a, n, q in found), default=None)
        r = got[i]
        assert r.n_runs == len(found)
        assert (r.start, r.length, r.period, r.exponent_milli) == (
            (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4)
        gone = {k for a, n, q in found for k in range(a + q, a + n)}
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()


def test_runs_of_a_long_text_in_time(spark):
    # one word, a cut binary pattern and a short period, each of 200,000 words
    rows = [(1, "a " * 200_000), (2, ("a b " * 50_000 + "a ") * 2), (3, "x y z " * 66_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in runs.periodic_runs(frame).select("doc_id", F.size("runs").alias("n"), F.col("runs")[0].alias("r")).collect()}
    assert tuple(got[1].r) == (0, 200_000, 1) and got[1].n == 1
    assert tuple(got[3].r) == (0, 198_000, 3) and got[3].n == 1
    # the two halves, every odd period around the middle, and the whole
    assert got[2].n > 40_000


# ---------------------------------------------------------------- token counts

SPECIAL = "<|endoftext|>"
COUNTED = [t for _, t in TEXTS] + [
    SPECIAL, f"a{SPECIAL}b {SPECIAL} ", "日本語の文章。" * 300, "don't we'll 'tis 'S\t\t x  \n\n y", "a" * 3000, " " * 3000,
    "x y z" * 50, "1234567890" * 90 + "!?" * 80,
]


@pytest.mark.parametrize("path", [byte_tokenizer(), word_tokenizer(), piece_model()])
def test_token_counts(spark, path):
    rows = list(enumerate(COUNTED)) + [(None, "no id"), (3, "again")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted(counts.token_counts(frame, path, piece_chars=64, batch_bytes=500).collect(), key=repr)
    if path.endswith(".model"):
        import sentencepiece
        size = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t))
    else:
        from tokenizers import Tokenizer
        size = lambda t: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids)
    assert sorted(map(tuple, got), key=repr) == sorted(
        ((i, len((t or "").encode()), size(t or "")) for i, t in rows), key=repr)


def test_safe_pieces():
    from tokenizers import Tokenizer
    tokenizer, rng = Tokenizer.from_file(byte_tokenizer()), random.Random(7)
    alphabet = ["a", "Z", "é", "я", "日", "ん", "1", "²", "'", "s", "ll", " ", "  ", "\n", "\t", " ", ".", ",", "。", "<|", "|>", SPECIAL, "😀", "́", "_"]
    for _ in range(400):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 200)))
        pieces = counts.safe_pieces(text, rng.choice([1, 5, 20]))
        assert "".join(pieces) == text
        assert sum(len(tokenizer.encode(p).ids) for p in pieces) == len(tokenizer.encode(text).ids)


def test_balanced():
    assert counts.balanced(np.array([5, 5, 20, 1, 1, 1]), 10) == [(0, 2), (2, 3), (3, 6)]
    assert counts.balanced(np.array([], int)) == []


def test_token_counts_empty(empty):  # noqa: F811
    assert counts.token_counts(empty, byte_tokenizer()).count() == 0


# ---------------------------------------------------------------- ranked search

def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(queries, rows, k):
    listed = [(i, terms_of(t)) for i, t in rows]
    n_docs, total = sum(bool(t) for _, t in listed), sum(len(t) for _, t in listed)
    df = {}
    for _, t in listed:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    asked, out = {}, []
    for item, text in queries:
        asked.setdefault(item, set()).update(terms_of(text))
    for item, want in asked.items():
        scored = []
        for i, t in listed:
            m = 50 + 50 * len(t) * n_docs // total if total else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * t.count(w) // (1000 * t.count(w) + 20 * m))
                for w in want if w in t)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k, first, block", [(50, 1 / 32, 1 << 16), (3, 1 / 500, 8), (1, 1 / 4, 1 << 16)])
def test_search(spark, monkeypatch, k, first, block):
    monkeypatch.setattr(search, "FIRST_SHARE", first)
    monkeypatch.setattr(search, "BLOCK_PAIRS", block)
    rng = random.Random(k)
    common = ["the", "of", "a", "Und", "été"]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else prose(1, rng) for _ in range(n)) + ","
    rows = [(i, text(rng.randint(1, 80))) for i in range(250)]
    rows += [(900 + i, rows[7][1]) for i in range(6)] + [(1000, None), (1001, ""), (1002, "...\x00"), (None, text(20)), (5, "The " * 500), rows[3]]
    queries = [(q, text(12)) for q in range(6)] + [(6, rows[7][1]), (6, "extra words"), (7, None), (8, "?!"), (None, "THE of"), (9, "nowhere else")]
    queries += [(10, " ".join(f"w{i}" for i in range(150)) + " the été " + rows[9][1])]  # more lists than bits of a long
    frame = spark.createDataFrame([(i, t, 0, "u", 1) for i, t in rows], "doc_id long, text string, uid int, terms string, n int")
    asked = spark.createDataFrame([(i, t, 2) for i, t in queries], "item_id long, text string, qid int")
    got = sorted(map(tuple, search.search(asked, frame, k).collect()), key=repr)
    assert got == brute_search(queries, rows, k)


def test_search_empty(spark, empty):  # noqa: F811
    asked = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert search.search(asked, empty).count() == 0
    assert search.search(asked.limit(0), empty.limit(0)).count() == 0
    frame = spark.createDataFrame([(1, "the end")], "doc_id long, text string")
    assert search.search(asked.limit(0), frame).count() == 0
    assert search.search(frame.withColumnRenamed("doc_id", "item_id"), frame).columns == ["item_id", "rank", "doc_id", "score"]


# ---------------------------------------------------------------- rows that share an id, or have none

def test_rules_tell_rows_of_one_id_apart(spark):
    rng = random.Random(12)
    footer = "all rights reserved by the owners of this site and of its parts"
    rows = [(i, f"{prose(30, rng)}\n{footer}", "h", 1, "x") for i in range(60)]
    good, bad, null_good = prose(40, rng), "too short", prose(40, rng)
    rows += [(900, footer + "\n" + footer.upper(), "h", 1, "x"), (900, prose(14, rng), "h", 2, "x"), (7000, good, "h", 3, "x")]
    rows += [(7000, bad, "h", 4, "x"), (None, null_good, "h", 5, "x"), (None, bad, "h", 6, "x"), (None, f"{prose(30, rng)}\n{footer}", "h", 7, "x")]
    rows += [rows[0], rows[0]]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, digest string")
    verdicts = rules.quality_rules(d)
    got = {(r.doc_id, r.n_words, r.kept, r.lost_words) for r in verdicts.collect()}
    assert {(900, 26, False, 26), (900, 14, True, 0), (7000, 40, True, 0), (7000, 2, False, 0)} <= got
    assert {(None, 40, True, 0), (None, 2, False, 0), (None, 43, True, 13)} <= got
    clean = rules.cleaned(d, verdicts)
    assert clean.columns == d.columns
    left = [(r.doc_id, r.text, r.n_chars) for r in clean.collect()]
    assert not any(bad == t or footer in t for _, t, _ in left)
    assert sum(i == 0 for i, _, _ in left) == 3 and len(left) == len(rows) - 3
    assert {(7000, good, 3), (None, null_good, 5)} <= set(left)
    assert all(n == len(t) for i, t, n in left if i is not None and i < 60)


# ---------------------------------------------------------------- pages that leave tags out

@pytest.mark.parametrize("page, lines", [
    ("<html><head><title>x</title><body><article><p>one<p>two", ["one", "two"]),
    ("<head><meta charset=utf-8><title>a</title><article>one</article>", ["one"]),
    ("<head><title>a</title>plain text", ["plain text"]),
    ("<head><script>if (a < b) c()</script><link rel=x><style>p{}</style></head><p>one", ["one"]),
    ("<head><title>never closed<body><p>one</p>", ["one"]),
    ("<title>a <b>bold</b> title</title><p>one", ["one"]),
    ("<body><button>press<p>one</p><p>two</p>", ["one", "two"]),
    ("<body><button><div>press</div></button><p>one</p>", ["one"]),
    ("<body><form><textarea>typed<p>one</p></form><p>two", ["one", "two"]),
    ("<body><select><option>a<option>b</select><p>one", ["one"]),
    ("<body><select><option>a<option>b<p>one", ["one"]),
    ("<p>one <a href=x><span><b><i><u>deep</u></i></b></span></a>", ["one deep"]),
])
def test_omitted_tags(page, lines):
    assert [t for _, t in html.Page(page).blocks] == lines


def test_deep_and_wide_pages_in_time():
    start = time.process_time()
    deep = html.Page("<div>" * 20_000 + "<p>one</p>" + "</div>" * 20_000)
    wide = html.Page("<p>x</p>" * 20_000)
    assert len(deep.blocks) == 1 and len(wide.blocks) == 20_000 and wide.nodes[-1].twins == 19_999
    assert time.process_time() - start < 20


# ---------------------------------------------------------------- transcripts

def test_a_plain_transcript_with_a_model_that_saw_few_systems(spark):
    rng = random.Random(4)
    turns = []
    for c in range(60):
        roles = ["system"] * (c % 20 == 0) + ["user", "assistant"] * rng.randint(1, 3)
        for t, role in enumerate(roles):
            text = prose(rng.randint(4, 9), rng).capitalize() + ("?" if role == "user" else ".")
            turns.append((c, t, role, text if role != "assistant" else text + "\n" + prose(8, rng)))
    model = chat.fit(chat.transcripts(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))
    plain = ["User: what is 6 times 7?", "Assistant: here:", "it is 42", "nothing else of it"]
    other = ["Human: is a: b a pair?", "AI: Answer: yes", "note this: a: b", "Human: thanks!"]
    rows = [(1, i, x) for i, x in enumerate(plain)] + [(2, i, x) for i, x in enumerate(other)]
    got = {}
    for r in chat.parse(spark.createDataFrame(rows, "conv_id long, pos long, line string"), model).orderBy("turn_no").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got[1] == [("user", "what is 6 times 7?"), ("assistant", "here:\nit is 42\nnothing else of it")]
    assert got[2] == [("user", "is a: b a pair?"), ("assistant", "Answer: yes\nnote this: a: b"), ("user", "thanks!")]
    # a value that no line had says nothing for any role
    assert not model.unseen.any() and all(np.isfinite(v).all() for v in model.emit.values())


def test_a_marker_of_another_role_stays(spark):
    lines = spark.createDataFrame([(1, 0, "Answer: forty-two")], "conv_id long, pos long, line string")
    start = np.full(len(chat.STATES), -50.0)
    start[chat.STATES.index(("user", True))] = 0.0
    model = chat.Model(start, np.zeros((len(chat.STATES),) * 2), {}, np.zeros(len(chat.STATES)))
    assert [(r.role, r.text) for r in chat.parse(lines, model).collect()] == [("user", "Answer: forty-two")]


# ---------------------------------------------------------------- pieces

def test_pieces_of_shuffled_input_and_round_trip(spark):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    rng = random.Random(8)
    texts = [t for _, t in TEXTS] + ["日本語の文章です。" * 40, "ab" * 300, "don't, e.g. (this) — «that»!?", "a\tb  c\n\n d", "▁", "x" * 200 + "é" * 200]
    texts += ["".join(rng.choice(["a", "e ", "th", ".", ",", "'s", "日", "😀", "1", "\n", "zz"]) for _ in range(rng.randint(0, 200))) for _ in range(80)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, code int")
    got = {r.doc_id: r for r in pieces.encode(frame.repartition(5), piece_model()).collect()}
    again = {r.doc_id: r for r in pieces.summary(pieces.encode(frame.repartition(3), piece_model()), piece_model()).collect()}
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(frame, piece_model()), piece_model()).collect()}
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == model.encode(t or ""), t
        assert again[i].n_ids == len(got[i].ids) // 4 and again[i].ids_crc32 == zlib.crc32(got[i].ids)
        # the mark that stands for a space is the one character that does not come back
        assert back[i] == (t or "").replace("▁", " ") and again[i].round_trip == ("▁" not in (t or ""))


def test_encoded_documents_are_finished_slice_by_slice(spark):
    frame = spark.createDataFrame([(i, " ".join(f"w{i + k % 7}" for k in range(9000))) for i in range(120)], "doc_id long, text string").coalesce(1)
    run, columns = pieces.summing(piece_model())

    def counted(batches):
        for n, batch in enumerate(batches):
            for done in run([batch]):
                yield done.append_column("n", pa.array([n] * done.num_rows, pa.int64()))

    got = pieces.encode(frame, piece_model(), (counted, columns + ", n long")).collect()
    want = pieces.summary(pieces.encode(frame, piece_model()), piece_model()).collect()
    assert sorted(r[:4] for r in got) == sorted(tuple(r) for r in want) and all(r.round_trip for r in got)
    assert max(r.n for r in got) > 0


def test_parts_of_words():
    pairs = pieces.crossed(piece_model())
    assert "".join(pieces.word_parts("▁word,(x)", pairs)) == "▁word,(x)"
    assert "▁word" in pieces.word_parts("▁word,日本", pairs)


# ---------------------------------------------------------------- near duplicates of rows that share an id

def test_texts_of_one_id_are_compared_each(spark):
    rng = random.Random(21)
    x, y = prose(200, rng), prose(200, rng)
    near = x.replace(x.split()[100], "changed", 1)
    rows = [(1, x), (1, y), (2, near), (3, y), (None, x), (4, prose(200, rng)), (4, prose(200, rng))]
    d = spark.createDataFrame([(i, t, "d", 1) for i, t in rows], "doc_id long, text string, digest string, node int")
    got = {(r.doc_id, r.digest): r for r in omh.near_duplicates(d).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1, sha(x)].class_id == got[2, sha(near)].class_id == 2 and got[1, sha(x)].n_links == 1
    assert got[1, sha(y)].class_id == got[3, sha(y)].class_id == 3
    assert [got[4, sha(t)].kept for i, t in rows if i == 4] == [True, True]
    left = omh.without_near_duplicates(d)
    assert left.columns == d.columns
    assert sorted(map(repr, left.select("doc_id", "text").collect())) == sorted(map(repr, spark.createDataFrame(
        [(i, t) for i, t in rows if i not in (1,)], "doc_id long, text string").collect()))
