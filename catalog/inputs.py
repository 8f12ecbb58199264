"""Log-shaped inputs derived from the given tables, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from timberline.functions.patterns import LEADING_SPACE, NON_WORD_RUN
from timberline.functions.stopwords import DEFAULT_STOP_WORDS
from timberline.operators.positions import chronological_split
from timberline.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- text lines of documents

def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per text line of a document, labelled by its document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    toxic = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return (
        docs.join(toxic, "doc_id", "left")
        .select(
            F.col("doc_id").alias("session_id"),
            F.coalesce(F.col("toxic"), F.lit(0)).cast("int").alias("label"),
            F.col("lang").alias("level"),
            F.posexplode(F.split("text", "\n")).alias("pos", "content"),
        )
        .select(
            "session_id", "pos", (F.col("session_id") * 100000 + F.col("pos") + 1).alias("line_id"),
            "content", F.col("content").alias("event_template"), "label", "level",
        )
    )


LINES = """
lines as (
  select session_id, (i - 1)::int pos, session_id * 100000 + i line_id, content,
         content event_template, label, level
  from (select d.doc_id session_id, generate_subscripts(string_split(d.text, chr(10)), 1) i,
               unnest(string_split(d.text, chr(10))) content,
               coalesce(b.toxic, 0)::int label, d.lang as level
        from documents d left join labels b on d.doc_id = b.doc_id))"""

SPLIT_LINES = LINES + """,
split_lines as (
  select *, case when row_number() over (order by line_id) <= floor(count(*) over () * 0.8::double)
            then 'train' else 'test' end split from lines)"""


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chronological_split(lines(spark, sf_dir), 0.8, ts=None)


def sql_tokens(text: str) -> str:
    """DuckDB expression: the tokens of an unmasked line."""
    return (
        f"list_filter(list_transform(string_split_regex(regexp_replace({text}, '{LEADING_SPACE}', ''), "
        f"'{NON_WORD_RUN}'), lambda x, i: case when i = 1 and regexp_matches(x, '\\p{{Nd}}') "
        "then '<*>' else x end), lambda x: x <> '')"
    )


SQL_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in DEFAULT_STOP_WORDS) + "]"


def sql_vocab_tokens(tokens: str) -> str:
    return f"list_filter({tokens}, lambda x: length(x) > 2 and not list_contains({SQL_STOP}, lower(x)))"


TOKENS = SPLIT_LINES + f""",
tokens as materialized (select *, {sql_tokens('content')} tokens from split_lines)"""


# ---------------------------------------------------------------- timed event lines

def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(table(spark, sf_dir, "events"), "event_id")
    return e.select(
        (F.col("event_id") + 1).alias("line_id"),
        F.col("user_id").alias("session_id"),
        F.date_trunc("second", "ts").alias("ts"),
        F.col("event_type").alias("event_template"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


EVENTS = """
event_lines as (
  select event_id + 1 line_id, user_id session_id, date_trunc('second', ts) ts,
         event_type event_template, cast(event_type = 'error' as int) label from events)"""


# ---------------------------------------------------------------- short sessions

def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("pos"),
        F.when(F.length("text") % 11 == 0, F.lit("")).otherwise(F.col("text")).alias("event_template"),
        (F.length("text") % 7 == 0).cast("int").alias("label"),
    )


TURNS = """
turns as (
  select conv_id session_id, turn pos, case when length(text) % 11 = 0 then '' else text end event_template,
         cast(length(text) % 7 = 0 as int) label from conversations)"""


def raw_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw answers for the texts of assistant turns; the other texts are still to be judged."""
    c = table(spark, sf_dir, "conversations")
    kind = F.length("query") % 5
    return (
        c.filter((F.col("role") == "assistant") & (F.length("text") % 11 != 0))
        .select(F.col("text").alias("query")).distinct()
        .withColumn(
            "raw",
            F.when(kind == 0, '{"prediction":"anomaly","analysis":"a"}')
            .when(kind == 1, 'Result: {"prediction":"normal","analysis":"b"} end')
            .when(kind == 2, "no json")
            .when(kind == 3, '{"prediction":"maybe","analysis":"c"}')
            .otherwise('{"prediction":"normal",\n"analysis":"d"}'),
        )
    )


# blank texts never become a query, so they have no verdict
VERDICTS = """
raw_verdicts as (
  select query, case length(query) % 5
    when 0 then '{"prediction":"anomaly","analysis":"a"}'
    when 1 then 'Result: {"prediction":"normal","analysis":"b"} end'
    when 2 then 'no json'
    when 3 then '{"prediction":"maybe","analysis":"c"}'
    else '{"prediction":"normal",' || chr(10) || '"analysis":"d"}' end raw
  from (select distinct event_template query from turns t join conversations c
          on t.session_id = c.conv_id and t.pos = c.turn
        where role = 'assistant' and event_template <> '')),
bodies as (select query, raw, regexp_extract(raw, '(?s)\\{.*\\}', 0) body from raw_verdicts),
verdicts as (
  select query, body->>'prediction' prediction, body->>'analysis' analysis
  from (select query, case when json_valid(body) then body::json end body from bodies where body <> '')
  where body->>'prediction' in ('anomaly', 'normal'))"""


# ---------------------------------------------------------------- raw text logs

def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supercomputer-shaped text lines."""
    e = spread(table(spark, sf_dir, "events"), "event_id")
    return e.select(
        (F.col("event_id") + 1).alias("line_id"),
        F.concat_ws(
            " ",
            F.when(F.col("event_type") == "error", "FAIL").otherwise("-"),
            F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"),
            F.date_format("ts", "yyyy.MM.dd"),
            F.concat(F.lit("R"), "user_id"),
            F.date_format("ts", "yyyy-MM-dd-HH.mm.ss"),
            F.concat(F.lit("R"), "user_id"),
            F.lit("RAS"), F.lit("KERNEL"), F.upper("event_type"),
            F.concat(
                F.lit("unit "), (F.col("event_id") % 17).cast("string"), F.lit(" reported "),
                "event_type", F.lit(" "), "props",
            ),
        ).alias("value"),
    )


RAW = """
raw_lines as (
  select event_id + 1 line_id, concat_ws(' ', case when event_type = 'error' then 'FAIL' else '-' end,
    floor(epoch(ts))::bigint::varchar, strftime(ts, '%Y.%m.%d'), 'R' || user_id,
    strftime(ts, '%Y-%m-%d-%H.%M.%S'), 'R' || user_id, 'RAS', 'KERNEL', upper(event_type),
    'unit ' || (event_id % 17) || ' reported ' || event_type || ' ' || props) as value from events)"""

# the columns a parser must find, straight from the table
PARSED = """
parsed as (
  select event_id + 1 line_id, case when event_type = 'error' then 1 else 0 end label,
    date_trunc('second', ts) ts, 'R' || user_id node, upper(event_type) level,
    'unit ' || (event_id % 17) || ' reported ' || event_type || ' ' || props content from events)"""


def raw_lines_pid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster-shaped text lines: half with a process id, some that do not parse."""
    e = spread(table(spark, sf_dir, "events"), "event_id")
    line = F.concat(
        F.lit("- 1 d u m 1 t loc app"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]:")))
        .otherwise(":"),
        F.lit(" "), "event_type",
    )
    return e.select(
        (F.col("event_id") + 1).alias("line_id"),
        F.when(F.col("event_id") % 10 == 9, "garbage").otherwise(line).alias("value"),
    )


# ---------------------------------------------------------------- vectors

def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        F.col("embedding"),
        (F.col("label") >= 5).cast("int").alias("label"),
        F.concat(F.lit("item <*> "), "vec_id").alias("text"),
    )


VECTORS = """
vectors as (
  select vec_id id, embedding::double[] embedding, cast(label >= 5 as int) label,
         'item <*> ' || vec_id as text from embeddings)"""
