"""Scalar and array functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from timberline.functions import text as T
from timberline.functions.patterns import CORE_ID, FILE_PATH, IPV4, MASK_PRESETS, NUMBER
from timberline.operators.verdicts import parse_verdict

from . import inputs as I
from .registry import query

LINE_MASKS = [CORE_ID, IPV4, NUMBER, FILE_PATH]


def _joined(arr):
    return F.array_join(arr, " ")


@query("derive_label", f"with {I.RAW} select line_id, cast(split_part(value, ' ', 1) <> '-' as int) label from raw_lines")
def derive_label(spark, sf):
    raw = I.raw_lines(spark, sf).withColumn("Label", F.split_part("value", F.lit(" "), F.lit(1)))
    return T.derive_label(raw, "Label").select("line_id", "label")


@query(
    "to_event_time",
    f"""with {I.RAW} select line_id, strftime(t, '%Y-%m-%d %H:%M:%S') ts, strftime(t, '%Y-%m-%dT%H:%M:%S') ts_iso
    from (select line_id, make_timestamp(split_part(value, ' ', 2)::bigint * 1000000) t from raw_lines)""",
)
def to_event_time(spark, sf):
    raw = I.raw_lines(spark, sf).withColumn("Timestamp", F.split_part("value", F.lit(" "), F.lit(2)))
    out = T.to_event_time(raw, "Timestamp")
    return out.select("line_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "ts_iso")


@query(
    "truncate_minutes",
    f"""with {I.EVENTS} select line_id,
    strftime(date_trunc('hour', ts) + to_minutes((minute(ts) // 7) * 7), '%Y-%m-%d %H:%M:%S') ts from event_lines""",
)
def truncate_minutes(spark, sf):
    e = I.event_lines(spark, sf)
    return e.select("line_id", F.date_format(T.truncate_minutes("ts", 7), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("drop_blank_templates", f"with {I.TURNS} select * from turns where trim(event_template) <> ''")
def drop_blank_templates(spark, sf):
    return T.drop_blank_templates(I.turns(spark, sf))


@query(
    "mask_patterns",
    f"""with {I.LINES} select line_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(content,
    'core\\.\\p{{Nd}}+', '<*>', 'g'), '(\\p{{Nd}}+\\.){{3}}\\p{{Nd}}+', '<*>', 'g'),
    '\\p{{Nd}}+(?:\\.\\p{{Nd}}+)?', '<*>', 'g'), '\\/[a-zA-Z0-9_:\\-\\.\\/]+', '<*>', 'g') masked from lines""",
)
def mask_patterns(spark, sf):
    return I.lines(spark, sf).select("line_id", T.mask_patterns("content", LINE_MASKS).alias("masked"))


@query(
    "mask_preset",
    f"""with {I.RAW} select line_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(value,
    'core\\.\\d+', '<*>', 'g'), '(\\d+\\.){{3}}\\d+', '<*>', 'g'), '\\b(0x)?[0-9a-fA-F]+\\b', '<*>', 'g'),
    '\\d+(?:\\.\\d+)?', '<*>', 'g') masked from raw_lines""",
)
def mask_preset(spark, sf):
    return I.raw_lines(spark, sf).select(
        "line_id", T.mask_patterns("value", MASK_PRESETS["BGL"]).alias("masked")
    )


@query("tokenize_line", f"with {I.TOKENS} select line_id, array_to_string(tokens, ' ') tokens from tokens")
def tokenize_line(spark, sf):
    return I.lines(spark, sf).select("line_id", _joined(T.tokenize_line("content")).alias("tokens"))


@query(
    "ngrams",
    f"""with {I.TOKENS} select line_id, array_to_string(tokens, '|') one,
    array_to_string(list_transform(generate_series(1, length(tokens) - 1),
      lambda i: tokens[i] || ' ' || tokens[i + 1]), '|') two from tokens""",
)
def ngrams(spark, sf):
    t = I.lines(spark, sf).withColumn("tokens", T.tokenize_line("content"))
    return t.select(
        "line_id",
        F.array_join(T.ngrams("tokens", 1), "|").alias("one"),
        F.array_join(T.ngrams("tokens", 2), "|").alias("two"),
    )


@query(
    "vocab_tokens",
    f"with {I.TOKENS} select line_id, array_to_string({I.sql_vocab_tokens('tokens')}, ' ') words from tokens",
)
def vocab_tokens(spark, sf):
    return I.lines(spark, sf).select(
        "line_id", _joined(T.vocab_tokens(T.tokenize_line("content"))).alias("words")
    )


# words of at most two letters become the wildcard, so that runs of it occur
_BLANKED = "list_transform(tokens, lambda x: case when length(x) < 3 then '<*>' else x end)"


def _blanked(tokens):
    return F.transform(tokens, lambda x: F.when(F.length(x) < 3, "<*>").otherwise(x))


@query(
    "collapse_runs",
    f"""with {I.TOKENS} select line_id, array_to_string(list_filter(b, lambda x, i:
    not (x = '<*>' and i > 1 and b[i - 1] = '<*>')), ' ') tokens from (select line_id, {_BLANKED} b from tokens)""",
)
def collapse_runs(spark, sf):
    t = I.lines(spark, sf).withColumn("tokens", _blanked(T.tokenize_line("content")))
    return t.select("line_id", _joined(T.collapse_runs("tokens")).alias("tokens"))


SQL_REGEX = (
    "'^' || replace(regexp_replace(regexp_replace(array_to_string({}, ' '), '(<\\*>\\s?){{2,}}', '<*>', 'g'), "
    "'([ -/:-@\\[-`{{-~])', '\\\\\\1', 'g'), '\\<\\*\\>', '(.*?)') || '$'"
)


@query(
    "template_to_regex",
    f"with {I.TOKENS} select line_id, {SQL_REGEX.format('b')} regex from (select line_id, {_BLANKED} b from tokens)",
)
def template_to_regex(spark, sf):
    t = I.lines(spark, sf).withColumn("tokens", _blanked(T.tokenize_line("content")))
    return t.select("line_id", T.template_to_regex("tokens").alias("regex"))


@query(
    "strip_patterns",
    f"""with {I.LINES} select line_id, nullif(regexp_replace(regexp_replace(content, '[A-Z][a-z]+', '', 'g'),
    '\\p{{Nd}}+', '', 'g'), '') stripped from lines""",
)
def strip_patterns(spark, sf):
    return I.lines(spark, sf).select("line_id", T.strip_patterns("content", ["[A-Z][a-z]+", r"\d+"]).alias("stripped"))


@query(
    "parse_verdict",
    f"""with {I.TURNS}, {I.VERDICTS} select query, true valid, prediction, analysis from verdicts union all
    select query, false, null, null from raw_verdicts where query not in (select query from verdicts)""",
)
def parse_verdict_query(spark, sf):
    valid, rejected = parse_verdict(I.raw_verdicts(spark, sf))
    none = F.lit(None).cast("string")
    return valid.select("query", F.lit(True).alias("valid"), "prediction", "analysis").unionByName(
        rejected.select("query", F.lit(False).alias("valid"), none.alias("prediction"), none.alias("analysis"))
    )


_NEXT = """pairs as (select line_id, tokens a,
  lead(tokens) over (partition by session_id order by pos) b from tokens)"""


def _pairs(spark, sf):
    """Each line with the next line of its document; a document has bounded lines here."""
    t = I.lines(spark, sf).withColumn("a", T.tokenize_line("content"))
    nxt = Window.partitionBy("session_id").orderBy("pos")
    return t.withColumn("b", F.lead("a").over(nxt)).filter(F.col("b").isNotNull())


@query(
    "token_jaccard",
    f"""with {I.TOKENS}, {_NEXT} select line_id, round(length(list_intersect(a, b)) /
    nullif(length(list_distinct(list_concat(a, b))), 0), 6) sim from pairs where b is not null""",
)
def token_jaccard(spark, sf):
    return _pairs(spark, sf).select("line_id", F.round(T.token_jaccard("a", "b"), 6).alias("sim"))


@query(
    "token_set_algebra",
    f"""with {I.TOKENS}, {_NEXT} select line_id, array_to_string(list_sort(list_intersect(a, b)), ' ') common,
    array_to_string(list_sort(list_distinct(list_concat(a, b))), ' ') either from pairs where b is not null""",
)
def token_set_algebra(spark, sf):
    return _pairs(spark, sf).select(
        "line_id",
        _joined(F.array_sort(T.token_intersection("a", "b"))).alias("common"),
        _joined(F.array_sort(T.token_union("a", "b"))).alias("either"),
    )


SQL_PAIR = (
    "case when length({a}) = 0 then {b} else list_transform(case when length({b}) > length({a}) then {b} else {a} end, "
    "lambda x: case when list_contains({a}, x) and list_contains({b}, x) then x else '<*>' end) end"
)


@query(
    "generalize_pair",
    f"""with {I.TOKENS}, {_NEXT} select line_id, array_to_string({SQL_PAIR.format(a='a', b='b')}, ' ') by_set,
    array_to_string(case when length(a) = 0 then b else list_transform(a, lambda x, i:
      case when b[i] is not distinct from x then x else '<*>' end) end, ' ') by_position
    from pairs where b is not null""",
)
def generalize_pair(spark, sf):
    return _pairs(spark, sf).select(
        "line_id",
        _joined(T.generalize_pair("a", "b")).alias("by_set"),
        _joined(T.generalize_pair("a", "b", "positional")).alias("by_position"),
    )


SQL_ANSWER = (
    "'{{\"prediction\": \"' || case when {l} = 1 then 'anomaly' else 'normal' end || '\", \"anomaly_score\": ' || "
    "round(case when {l} = 1 then (('0x' || substr(md5({t}), 1, 8))::bigint % 11 + 90) / 100 "
    "else (('0x' || substr(md5({t}), 1, 8))::bigint % 11) / 100 end, 2)::double::varchar || '}}'"
)


@query(
    "example_answer",
    f"with {I.LINES} select line_id, {SQL_ANSWER.format(l='label', t='content')} answer from lines",
)
def example_answer(spark, sf):
    return I.lines(spark, sf).select("line_id", T.example_answer("label", "content").alias("answer"))


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_prompt(examples: str, query: str) -> str:
    """Prompt text of a list of ``{'query', 'answer'}`` structs and a query."""
    shot = "'[sample] ' || e.query || chr(10) || '[label] ' || e.answer || chr(10)"
    return (
        f"replace('[task] ' || {_lit(T.INSTRUCTION)} || chr(10) || "
        f"coalesce(array_to_string(list_transform({examples}, lambda e: {shot}), ''), '') || "
        f"'[format] ' || {_lit(T.OUTPUT_RULES)} || chr(10) || '[entry] ' || {query}, '<*>', '')"
    )


@query(
    "build_prompt",
    f"""with {I.TURNS} select session_id, pos, {sql_prompt("[{'query': 'known <*> text', 'answer': 'normal'}]", "event_template")}
    prompt from turns""",
)
def build_prompt(spark, sf):
    shot = F.array(F.struct(F.lit("known <*> text").alias("query"), F.lit("normal").alias("answer")))
    t = I.turns(spark, sf).withColumn("examples", shot)
    return T.build_prompt(t, query_col="event_template").select("session_id", "pos", "prompt")
