"""Quality rules: per-document counts and cross-document line frequency.

A line is boilerplate of its host when more than ``max_docs`` distinct documents of the host have it
*and* these are of more than ``max_docs`` classes of copies. A class counts once whatever its size, so
copies neither make a line boilerplate nor keep other documents from doing so; they are left to
deduplication. The classes are found among the documents with a line in more than ``max_docs``
documents (a frequent line):

- Own content are the lines that are neither frequent nor an edited frequent line, that is half or more
  of their least ``RUNS`` runs of three words are among those of the host's frequent lines. One edit
  touches three runs, so a line with one edit always counts as edited, if it has eight words or more.
- With ``OWN_SHARE`` of its words own or more, a document's class is the least run of its own content.
- With less it is a copy, and its class is its least common line: the run that half of the line's runs
  are at least as common as. Edits take that line out of few copies, so the classes of an article's
  copies hardly grow with their number.

Boilerplate lines are removed; a document that keeps less than ``min_share`` of its words is depleted
and rejected. Counts are combined before each shuffle; texts are not shuffled, only hashes of lines and,
for documents with a frequent line, of runs.

Defined results: a null or empty text has no words and fails the base rules; a null host is a host
of its own; rows that share an id, or have none, are told apart by text and host, equal ones share their
verdict; an empty table gives an empty result. Further columns of any name are not
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from timberline.session import materialize

from .tables import fresh
from .words import Words, inside, slices, sums, texts_of, windows

#: A line in more documents and classes of copies of a host than this is boilerplate.
MAX_DOCS = 20
#: Share of its words that a document must keep.
MIN_SHARE = 0.2
#: A document with a smaller share of own words is a copy; least runs kept of a line.
OWN_SHARE, RUNS = 0.05, 6
#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5

_SPACE = re.compile(r"[\x20\x09-\x0D]+")
PROFILE = (
    "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, digest long, lines array<struct<line:long,words:long,runs:array<int>>>"
)


def repeat_words(words: Words, hashes: np.ndarray, size: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each text that lie in a window of ``size`` words found twice or more in the text."""
    runs, ok = windows(hashes[words.codes], size), inside(words.starts, size)
    owner = words.owners()[:len(runs)]
    at = np.flatnonzero(ok)
    order = at[np.lexsort((runs[at], owner[at]))]
    same = (runs[order[1:]] == runs[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    again = np.zeros(len(runs), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words.codes), bool)
    for k in range(size):
        covered[k:k + len(again)] |= again
    return sums(covered.astype(np.int64), words.starts)


def least_runs(lines: list[str], keep: int = RUNS, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` least distinct hashes (32 bits) of the runs of ``size`` words of each line, and where each line's begin.

    A line of fewer words is one run.
    """
    words = Words(pa.array(lines, pa.large_string()))
    flat, count = words.hashes()[words.codes], words.counts
    owner = words.owners()[:max(len(flat) - size + 1, 0)]
    ok = inside(words.starts, size)
    runs, owner = windows(flat, size)[ok], owner[ok]
    few = np.flatnonzero((count > 0) & (count < size))
    short = [windows(flat[a:b], b - a) for a, b in zip(words.starts[few], words.starts[few + 1])]
    runs = (np.concatenate([runs, *short]) >> np.uint64(32)).astype(np.uint32)
    owner = np.concatenate([owner, few])
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    runs, owner = runs[new], owner[new]
    first = np.searchsorted(owner, np.arange(len(lines)))
    small = np.arange(len(runs)) - first[owner] < keep
    return runs[small].view(np.int32), np.searchsorted(owner[small], np.arange(len(lines) + 1))


def normal_line(line: str) -> str:
    """Lower case, white space squeezed, digits as one digit."""
    return re.sub(r"\d+", "0", _SPACE.sub(" ", line).strip(" ").lower())


def line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(normal_line(line).encode("utf-8", "surrogatepass")) - (1 << 63)


def _lines(text: str) -> tuple[dict[int, int], list[str], int]:
    """Words of each hashed line that has one, the lines in normal form, and how many equal an earlier line."""
    seen, out, normal, dup = {}, {}, [], 0
    for line in text.split("\n"):
        n = sum(1 for w in _SPACE.split(line) if w)
        if not n:
            continue
        if line in seen:
            dup += 1
        else:
            seen[line] = line_hash(line)
            if seen[line] not in out:
                normal.append(normal_line(line))
        out[seen[line]] = out.get(seen[line], 0) + n
    return out, normal, dup


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = texts_of(batch)
        words = Words(texts)
        hashes = words.hashes()
        python = texts.to_pylist()
        lines = [_lines(t) for t in python]
        symbols = [sum(map(t.count, SYMBOLS)) for t in python]
        runs, starts = least_runs([x for _, normal, _ in lines for x in normal])
        each = pa.StructArray.from_arrays([
            pa.array([h for out, _, _ in lines for h in out], pa.int64()),
            pa.array([n for out, _, _ in lines for n in out.values()], pa.int64()),
            pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(runs, pa.int32())),
        ], names=["line", "words", "runs"])
        edges = np.concatenate([[0], np.cumsum([len(out) for out, _, _ in lines])])
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("host"), pa.array(words.counts, pa.int64()),
            pa.array(words.per_text(words.lengths), pa.int64()), pa.array(symbols, pa.int64()),
            pa.array([d for _, _, d in lines], pa.int64()), pa.array(repeat_words(words, hashes), pa.int64()),
            batch.column("digest"), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), each),
        ], names=[c.split()[0] for c in PROFILE.split(", ")])


#: Stands for a null doc_id inside the jobs.
_NO_ID = -(1 << 63)


def _digest(host: F.Column) -> F.Column:
    """With the id, names a row; equal rows share it."""
    return F.xxhash64(F.col("doc_id").isNull(), "text", host)


def profiles(docs: DataFrame, host: str = "source") -> DataFrame:
    """Counts and hashed lines of every document, written once."""
    name = F.coalesce(F.col(host), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"), name.alias("host"),
        _digest(name).alias("digest"))
    return materialize(rows.mapInArrow(_profile, PROFILE), "profiles")


def _exploded(profile: DataFrame) -> DataFrame:
    return profile.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), "digest", "host", "n_words", F.explode("lines").alias("l")).select(
        "doc", "digest", "host", "n_words", F.col("l.line").alias("line"), F.col("l.words").alias("words"), F.col("l.runs").alias("runs"))


def copy_classes(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc, digest, class) of the documents whose lines are ``rows``, given the host's ``frequent`` lines."""
    runs = materialize(rows.select("host", "line", F.size("runs").alias("n"), F.explode("runs").alias("run")).distinct(), "runs")
    common = runs.join(frequent.hint("merge"), ["host", "line"]).groupBy("host", "run").agg(F.sum("n_docs").alias("freq"))
    ranked = runs.join(common.hint("merge"), ["host", "run"]).groupBy("host", "line", "n").agg(
        F.sort_array(F.collect_list(F.struct("freq", "run")), False).alias("f")).filter(2 * F.size("f") >= F.col("n"))
    level = ranked.select("host", "line", F.element_at("f", F.ceil(F.col("n") / 2).cast("int")).alias("level"))
    own = F.col("level").isNull()
    return (
        rows.select("doc", "digest", "host", "n_words", "line", "words", F.col("runs")[0].alias("least"))
        .join(level.hint("merge"), ["host", "line"], "left")
        .groupBy("doc", "digest").agg(
            F.sum(F.when(own, F.col("words")).otherwise(0)).alias("own"), F.max("n_words").alias("n_words"),
            F.min(F.when(own, F.col("least"))).alias("least"), F.min("level").alias("level"))
        .select("doc", "digest", F.when(
            (F.col("own") > 0) & (F.col("own") >= F.lit(OWN_SHARE) * F.col("n_words")), F.col("least").cast("long"))
            .otherwise(F.col("level.run") + F.lit(1 << 32)).alias("class"))
    )


def frequent_lines(profile: DataFrame, max_docs: int = MAX_DOCS) -> tuple[DataFrame, DataFrame]:
    """Lines in more than ``max_docs`` documents of a host, each time they occur, and those that are boilerplate.

    The first are (doc, digest, host, line, words), the second (host, line, n_docs, n_classes).
    """
    lines = _exploded(profile)
    frequent = materialize(
        lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > max_docs), "frequent")
    hits = materialize(
        lines.select("doc", "digest", "host", "line", "words").join(frequent.select("host", "line").hint("merge"), ["host", "line"]), "hits")
    touched = hits.select("doc", "digest").distinct()
    keyed = profile.withColumn("doc", F.coalesce("doc_id", F.lit(_NO_ID)))
    rows = materialize(_exploded(keyed.join(touched.hint("merge"), ["doc", "digest"], "left_semi")), "touched")
    classes = copy_classes(rows, frequent)
    counted = (
        hits.select("doc", "digest", "host", "line").join(classes.hint("merge"), ["doc", "digest"])
        .select("host", "line", "class").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_classes"))
        .filter(F.col("n_classes") > max_docs)
    )
    return hits, materialize(counted.join(frequent, ["host", "line"]).select("host", "line", "n_docs", "n_classes"), "boilerplate")


def quality_rules(
    docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_share: float = MIN_SHARE,
) -> DataFrame:
    """Counts and verdict of every document, with the hashes of the lines to remove.

    ``digest`` tells rows that share a doc_id apart; ``cleaned`` finds the rows by both.
    """
    profile = profiles(docs, host)
    hits, hot = frequent_lines(profile, max_docs)
    # equal rows share their digest, so a line counts once for them
    lost = (
        hits.join(hot.select("host", "line").hint("merge"), ["host", "line"])
        .groupBy("doc", "digest", "line").agg(F.max("words").alias("words"))
        .groupBy("doc", "digest").agg(F.sum("words").alias("lost_words"), F.collect_list("line").alias("removed_lines"))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("lost_words", F.lit(0))
    return (
        profile.drop("lines", "host").withColumn("doc", F.coalesce("doc_id", F.lit(_NO_ID)))
        .join(lost.hint("merge"), ["doc", "digest"], "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (left >= F.lit(min_share) * F.col("n_words")))
        .withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<bigint>")))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                "kept", F.coalesce("lost_words", F.lit(0)).alias("lost_words"), "removed_lines", "digest")
    )


def _cut_part(columns: list[str], gone: str):
    """Rows without their boilerplate lines, a few megabytes of text at a time."""
    def cut(text: str | None, lines: list[int]) -> str | None:
        drop = set(lines)
        return None if text is None else "\n".join(x for x in text.split("\n") if not x.strip() or line_hash(x) not in drop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            text = pa.array(map(cut, batch.column("text").to_pylist(), batch.column(gone).to_pylist()), batch.schema.field("text").type)
            values = {c: batch.column(c) for c in columns} | {"text": text}
            if "n_chars" in values:
                values["n_chars"] = pc.utf8_length(text).cast(batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(values.values()), names=columns)

    return run


def cleaned(docs: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """The kept documents without their boilerplate lines, with all columns of ``docs``.

    Only rows that lose lines go through Python; the others pass as they are.
    """
    key, mark, gone = (fresh(docs, x) for x in ("__key", "__digest", "__gone"))
    keyed = docs.withColumns({
        key: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)), mark: _digest(F.coalesce(F.col(host), F.lit("")))})
    marked = verdicts.filter(~F.col("kept") | (F.size("removed_lines") > 0)).select(
        F.coalesce("doc_id", F.lit(_NO_ID)).alias(key), F.col("digest").alias(mark), "kept", F.col("removed_lines").alias(gone))
    marked = materialize(marked.groupBy(key, mark).agg(F.first("kept").alias("kept"), F.first(gone).alias(gone)), "marked")
    same = keyed.join(marked.select(key, mark).hint("merge"), [key, mark], "left_anti").select(*docs.columns)
    less = keyed.join(marked.filter("kept").drop("kept").hint("merge"), [key, mark]).select(*docs.columns, gone)
    return same.unionByName(less.mapInArrow(_cut_part(docs.columns, gone), docs.schema))
