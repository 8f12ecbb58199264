"""Expert verdicts: parsing, joining with queries, feedback look-up, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.patterns import WILDCARD
from ..functions.text import join_tokens, matches_pieces, template_pieces, template_to_regex
from ..session import materialize

_VERDICT = "struct<prediction:string,analysis:string>"

# letters of a literal's end that a word is looked up by
TAIL = 4


def _parsed(text: Column) -> Column:
    """The JSON object spanning the first ``{`` to the last ``}``; null unless strictly valid.

    ``from_json`` ignores what follows the first value.  Reading the text both as the only
    element of an array and as the only field of an object leaves no room for trailing text.
    """
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    as_array = F.from_json(F.concat(F.lit("["), body, F.lit("]")), f"array<{_VERDICT}>")
    as_field = F.from_json(F.concat(F.lit('{"v":'), body, F.lit("}")), f"v {_VERDICT}")
    return F.when((F.size(as_array) == 1) & as_field["v"].isNotNull(), as_array[0])


def parse_verdict(df: DataFrame, col: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Split answers into valid ones (with ``prediction``, ``analysis``) and rejected ones."""
    tagged = df.withColumn("_v", _parsed(F.col(col)))
    ok = F.coalesce(F.col("_v.prediction").isin("anomaly", "normal"), F.lit(False))
    valid = tagged.filter(ok).withColumns(
        {"prediction": F.col("_v.prediction"), "analysis": F.col("_v.analysis")}
    ).drop("_v")
    return valid, tagged.filter(~ok).drop("_v")


def distinct_queries(windows: DataFrame, query: str = "query") -> DataFrame:
    """Unique queries with the number of windows that ask them."""
    return windows.groupBy(query).agg(F.count(F.lit(1)).alias("n_windows"))


def verdict_join(
    queries: DataFrame, verdicts: DataFrame, query: str = "query", order: str | None = None
) -> DataFrame:
    """Queries with their cached verdict; null where none is known.

    A query judged more than once has one verdict, so no window is doubled: with ``order`` the
    last one by that column, as a cache that is written over holds it. Without it a table has no
    last entry, and the greatest (prediction, analysis) stands.
    """
    verdict = F.struct("prediction", "analysis")
    last = F.max_by(verdict, F.struct(order, verdict)) if order else F.max(verdict)
    one = verdicts.groupBy(query).agg(last.alias("_v"))
    return queries.join(one.select(query, "_v.prediction", "_v.analysis"), query, "left")


def pending_queries(queries: DataFrame, verdicts: DataFrame, query: str = "query") -> DataFrame:
    """Distinct queries still to be judged."""
    return queries.select(query).distinct().join(verdicts.select(query), query, "left_anti")


def verdict_report(window_preds: DataFrame, extra: tuple[str, ...] = ("session_id", "window_id")) -> DataFrame:
    """Prediction, label, query, analysis and whether they agree, per window."""
    prediction = F.when(F.col("prediction") == "anomaly", 1).when(
        F.col("prediction") == "normal", 0
    )
    keep = [c for c in extra if c in window_preds.columns]
    return window_preds.select(
        *keep,
        prediction.alias("prediction"),
        F.col("label").cast("int").alias("label"),
        "query",
        "analysis",
        (prediction == F.col("label").cast("int")).alias("correct"),
    )


def _anchor(tokens: Column) -> Column:
    """A literal token that any string matching the template's pattern has as a whole word.

    A token counts if it is not glued to a preceding wildcard run, because squeezing a run of
    wildcards swallows the blank after it.  The longest such token is the most selective.
    """
    usable = F.filter(
        tokens,
        lambda x, i: (x != WILDCARD)
        & ~((i > 1) & (F.get(tokens, i - 1) == WILDCARD) & (F.get(tokens, i - 2) == WILDCARD)),
    )
    return F.get(F.array_sort(usable, lambda a, b: F.length(b) - F.length(a)), F.lit(0))


def feedback_lookup(
    templates: DataFrame,
    feedback: DataFrame,
    level: int = 2,
    template_id: str = "template_id",
    tokens: str = "tokens",
) -> DataFrame:
    """Two-level score look-up of templates in stored feedback.

    ``feedback(template, score, seq)`` holds stored template strings.  Level 1 is the exact
    string; level 2 lets the template's pattern match the stored strings, the last stored one
    wins.  A string stored again keeps its place and takes the new score.  A template token is
    the wildcard or a literal.
    """
    stored = feedback.groupBy("template").agg(
        F.min("seq").alias("seq"), F.max_by("score", "seq").alias("score")
    )
    base = templates.select(template_id, tokens, join_tokens(tokens).alias("template")).hint("merge")
    # a number in place of the string, which is fixed once it is written
    stored = materialize(stored.withColumn("_at", F.monotonically_increasing_id()), "stored")
    direct = materialize(base.join(stored.drop("_at"), "template", "left"), "direct")
    found = direct.filter(F.col("seq").isNotNull()).select(
        template_id, "score", F.lit(1).alias("level")
    )
    missed = direct.filter(F.col("seq").isNull()).select(template_id, tokens)
    none = missed.select(
        template_id, F.lit(None).cast(stored.schema["score"].dataType).alias("score"),
        F.lit(None).cast("int").alias("level"),
    )
    if level < 2:
        return found.unionByName(none)

    # level 2 as an equi join on a word the stored string must hold and, if the pattern begins with one,
    # on the first; words carry the number of their string, and only what meets gets its text
    first = F.get(tokens, F.lit(0))
    patterns = missed.select(
        template_id,
        template_to_regex(tokens).alias("regex"),
        template_pieces(tokens).alias("pieces"),
        _anchor(F.col(tokens)).alias("word"),
        F.when(first == WILDCARD, F.lit("")).otherwise(first).alias("head"),
        F.get(F.filter(tokens, lambda x: x != WILDCARD), F.lit(0)).alias("literal"),
    )
    split = F.split("template", " ")
    # Spark takes a written table for as large as its compressed files, however many rows become of each, so
    # what grows with the input is never left to it to broadcast
    words = stored.select(
        "_at", split[0].alias("first"), F.explode(F.array_distinct(split)).alias("word")).hint("merge")
    anchors = patterns.filter(F.col("word").isNotNull()).select(template_id, "word", "head")
    headed = words.join(anchors.filter("head <> ''"), (F.col("first") == F.col("head")) & (words["word"] == anchors["word"]))
    headless = words.join(anchors.filter("head = ''").drop("head"), "word")
    # without such a word, every literal ends some word of the string: join on the last letters, as
    # many as the literal has, up to four
    ends = F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.lit(TAIL)), lambda k: F.right("word", k)))
    tailed = (
        patterns.filter(F.col("word").isNull() & F.col("literal").isNotNull())
        .select(template_id, F.expr(f"right(literal, {TAIL})").alias("tail"))
        .join(words.filter("word <> ''").select("_at", F.explode(ends).alias("tail")).distinct().hint("merge"), "tail")
    )
    pairs = materialize(
        headed.select(template_id, "_at").union(headless.select(template_id, "_at"))
        .union(tailed.select(template_id, "_at")), "candidates")
    # a wildcard does not reach over a line break, so text with one takes the pattern itself
    hit = F.when(
        F.col("template").contains("\n"), F.expr("template rlike concat('(?d)', regex)")
    ).otherwise(matches_pieces("template", F.col("pieces")))
    matches = (
        pairs.hint("merge").join(patterns.select(template_id, "regex", "pieces"), template_id).hint("merge").join(stored, "_at")
        .filter(hit)
        .groupBy(template_id).agg(F.max_by("score", "seq").alias("score"))
    )
    # a pattern of wildcards alone matches every stored line
    last = stored.filter(~F.col("template").contains("\n")).agg(F.max_by("score", "seq")).scalar()
    free = patterns.filter(F.col("literal").isNull()).select(
        template_id, last.alias("score")
    )
    second = matches.unionByName(free)
    rest = missed.select(template_id).hint("merge").join(second, template_id, "left").select(
        template_id, "score", F.when(F.col("score").isNotNull(), 2).alias("level")
    )
    return found.unionByName(rest)
