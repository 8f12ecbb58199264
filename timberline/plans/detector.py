"""The detection agent: fit on labelled lines, take feedback, detect."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import generalize_pair, template_to_regex, tokenize_line
from ..operators.bayes import NgramCounts, add_counts, build_scorer, nb_fit, nb_score, nb_score_running
from ..operators.grouping import frozen_path, group_key
from ..operators.metrics import binary_metrics
from ..operators.mining import (
    FIRST_CHUNK, MinedTemplates, TemplateIndex, match_templates, mine_templates, reinsert_templates, subsume_templates,
)
from ..operators.positions import dense_position, id_cells
from ..operators.windows import first_occurrence
from ..session import materialize, passing


@dataclass
class Detector:
    """Mined templates, vocabulary, branches and n-gram counts with the mining settings."""

    counts: NgramCounts
    templates: DataFrame
    vocab: DataFrame
    branches: DataFrame
    patterns: list = field(default_factory=list)
    heads: list = field(default_factory=list)
    k: int = 3
    depth: int = 4
    max_child: int = 2
    st: float = 0.5
    # the highest line number used so far
    last_seq: int = 0


def fit_detector(
    train_lines: DataFrame,
    patterns: Sequence[str] = (),
    heads: Sequence[str] = (),
    k: int = 3,
    depth: int = 4,
    max_child: int = 2,
    st: float = 0.5,
    n: int = 1,
    vocab: str = "online",
    first_chunk: int = FIRST_CHUNK,
) -> tuple[Detector, DataFrame]:
    """Mine templates, fit counts on each line's template of the moment, score the train set.

    Equal (snapshot, label) pairs are counted before their n-grams are spread out.
    Returns the detector and the one-row metrics of the self-test.
    """
    mined = mine_templates(
        train_lines, patterns, heads, k, depth, max_child, st, vocab, first_chunk=first_chunk
    )
    samples = _samples(mined.assignments)
    counts = nb_fit(samples, n, weight="n").materialize()
    detector = Detector(
        counts, mined.templates, mined.vocab, mined.branches,
        list(patterns), list(heads), k, depth, max_child, st, _last(mined.assignments),
    )
    checked = samples.select("line_id", "label", "n").join(nb_score(samples, counts), "line_id")
    return detector, binary_metrics(checked, weight="n")


def _samples(assignments: DataFrame) -> DataFrame:
    """Distinct (snapshot, label) pairs with their number of lines and first line."""
    return materialize(
        assignments.groupBy(F.col("snapshot").alias("tokens"), "label").agg(
            F.count(F.lit(1)).alias("n"), F.min("line_id").alias("line_id")
        ),
        "samples",
    )


def _last(assignments: DataFrame) -> int:
    return assignments.agg(F.coalesce(F.max("line_id"), F.lit(0))).head()[0]


def _go_on(detector: Detector, lines: DataFrame) -> MinedTemplates:
    """Mine further lines on top of the detector's templates."""
    base = MinedTemplates(None, detector.templates, detector.vocab, detector.branches)
    return mine_templates(
        lines, detector.patterns, detector.heads, detector.k, detector.depth,
        detector.max_child, detector.st, base=base,
    )


def _numbered_after(
    detector: Detector, lines: DataFrame, order: Sequence[Column | str], coarse: Column, fine: Sequence[Column]
) -> DataFrame:
    """Lines with consecutive ``_seq`` behind everything the detector has seen, in order."""
    last = detector.last_seq
    placed = dense_position(lines, coarse, fine, order, out="_seq")
    return materialize(placed.withColumn("_seq", F.col("_seq") + F.lit(last)), "numbered")


def apply_feedback(detector: Detector, verdicts: DataFrame, query: str = "query") -> Detector:
    """Mine the verdicts' texts as further lines and count them, class 1 for anomaly, else 0.

    A table has no order of its own, so verdicts come in the fixed order of their text's hash.
    """
    known = verdicts.filter(F.col("prediction").isin("anomaly", "normal")).select(
        F.col(query).alias("content"),
        (F.col("prediction") == "anomaly").cast("int").alias("label"),
    )
    h = F.xxhash64("content")
    lines = _numbered_after(
        detector, known, [h, "content"], F.shiftright(h, 48), [F.shiftright(h, 32)]
    ).withColumnRenamed("_seq", "line_id")
    mined = _go_on(detector, lines)
    added = nb_fit(_samples(mined.assignments), detector.counts.n, weight="n")
    return replace(
        detector,
        counts=add_counts(detector.counts, added).materialize(),
        templates=mined.templates, vocab=mined.vocab, branches=mined.branches,
        last_seq=max(detector.last_seq, _last(mined.assignments)),
    )


def merge_detector(detector: Detector) -> tuple[Detector, DataFrame]:
    """Merge templates that others absorb, and rebuild the tree of every group in which that happened.

    Returns the detector that goes on from there and ``(template_id, new_id)`` for the templates replaced;
    lists of recent templates follow it. Groups without a merge keep their templates, ids and branches.
    """
    claims = materialize(subsume_templates(detector.templates), "claims")
    changed, found, branches, moved = reinsert_templates(
        detector.templates, claims, detector.depth, detector.max_child, detector.st, detector.last_seq)
    columns = detector.templates.columns
    fresh = found.withColumns({"template": F.array_join("tokens", " "), "regex": template_to_regex("tokens")})
    kept = detector.templates.join(changed, "group_key", "left_anti")
    old = detector.branches.join(changed, "group_key", "left_anti")
    last = found.agg(F.coalesce(F.max("template_id"), F.lit(0))).first()[0]
    return replace(
        detector,
        templates=materialize(kept.select(*columns).unionByName(fresh.select(*columns)), "templates"),
        branches=materialize(old.unionByName(branches.select(*old.columns)), "branches"),
        last_seq=max(detector.last_seq, last),
    ), moved


def joined_template(
    lines: DataFrame, detector: Detector, content: str = "content", index: TemplateIndex | None = None
) -> DataFrame:
    """``(line_id, tokens)``: the line's template after the line joined it, tree unchanged.

    Lines look up the fitted vocabulary, branches and templates, which stay as they are; a line
    without a similar template stands for itself, with the wildcards of its path.  A caller with many
    tables of lines gives the templates' ``index``, so that it is built once.
    """
    base = lines.select(
        "line_id",
        *[h for h in detector.heads if h in lines.columns],
        tokenize_line(content, detector.patterns).alias("tokens"),
    )
    keyed = group_key(base, detector.k, detector.heads, detector.vocab)
    placed = materialize(
        frozen_path(keyed, detector.branches, detector.depth).withColumn(
            "tokens", F.concat("path", F.slice("tokens", detector.depth + 1, 1 << 30))
        ),
        "placed",
    )
    matches = match_templates(placed, index or detector.templates, detector.st)
    chosen = matches.select("line_id", "template_id").join(
        detector.templates.select("template_id", F.col("tokens").alias("template")), "template_id"
    )
    return placed.join(chosen, "line_id", "left").select(
        "line_id",
        F.when(F.col("template").isNull(), F.col("tokens"))
        .otherwise(generalize_pair("template", "tokens")).alias("tokens"),
    )


def detect_lines(
    lines: DataFrame,
    detector: Detector,
    dedupe: bool = True,
    online: bool = True,
    emphasize: bool = True,
    template: str = "event_template",
    update: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Predictions ``(line_id, label, score_0, score_1, prediction)`` and their metrics.

    With ``dedupe`` only the first line of each template, in line order, is judged.  ``online``
    lets the judged lines go on shaping the templates as they pass; otherwise the fitted
    templates stay as they are.  ``update`` counts every judged line under its label once it is
    judged, so each is scored with the fitted counts and those of all lines before it.
    """
    with passing(lines.sparkSession):
        if dedupe:
            lines = first_occurrence(lines, template)
        if update:
            score = lambda docs, key: nb_score_running(
                docs.join(judged.select(key, "label"), key), detector.counts, emphasize, order=key)
        else:
            scorer = build_scorer(detector.counts, emphasize)
            score = lambda docs, key: nb_score(docs, scorer, doc_id=key)
        if online:
            coarse, fine = id_cells("line_id")
            judged = _numbered_after(detector, lines, ["line_id"], coarse, fine)
            rows = judged.withColumnRenamed("line_id", "_line").withColumnRenamed("_seq", "line_id")
            mined = _go_on(detector, rows)
            docs = mined.assignments.select(F.col("line_id").alias("_seq"), F.col("snapshot").alias("tokens"))
            scored = score(docs, "_seq")
            predictions = judged.select("line_id", "_seq", template, "label").join(scored, "_seq").drop("_seq")
        else:
            judged = materialize(lines, "judged")
            # scoring reads its documents more than once
            scored = score(materialize(joined_template(judged, detector), "joined"), "line_id")
            predictions = judged.select("line_id", template, "label").join(scored, "line_id")
        predictions = materialize(predictions, "predictions", stay=True)
    return predictions, binary_metrics(predictions)


def fit_token_model(lines: DataFrame, n: int = 1, patterns: Sequence[str] = ()) -> NgramCounts:
    """Counts on the lines' own tokens, without template mining."""
    docs = lines.select("line_id", "label", tokenize_line("content", patterns).alias("tokens"))
    return nb_fit(materialize(docs, "docs"), n)


def detect_tokens(
    lines: DataFrame,
    model: NgramCounts,
    dedupe: bool = True,
    emphasize: bool = True,
    patterns: Sequence[str] = (),
    template: str = "event_template",
) -> DataFrame:
    """Predictions on the lines' own tokens, without template mining."""
    if dedupe:
        lines = first_occurrence(lines, template)
    docs = materialize(
        lines.select("line_id", "label", tokenize_line("content", patterns).alias("tokens")), "docs"
    )
    scored = nb_score(docs, model, emphasize)
    return docs.select("line_id", "label").join(scored, "line_id")
