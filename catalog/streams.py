"""Streaming forms, run to the end of their input and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators.bayes import nb_fit
from timberline.operators.grouping import vocab_counts
from timberline.plans.detector import Detector, fit_token_model
from timberline.session import materialize, passing, scratch_path
from timberline.streaming import jobs as J

from . import inputs as I
from .counts import FIT, SCORE_COLS, scored_columns, sql_score
from .registry import query
from .templates import SQL_TEMPLATES, blanked_templates, split_tokens
from .text import SQL_PAIR


# most rows of a file, so that a batch of a few files stays as small however large the table is
FILE_ROWS = 100_000


def _stream(spark, df):
    """The rows, in files of bounded size, as a stream of several micro-batches.

    ``timberline.stream.filesPerTrigger`` sets the files of a batch.
    """
    path = scratch_path(spark, "stream_in")
    df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    files = spark.conf.get("timberline.stream.filesPerTrigger", "4")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


_ALL = "test as (select line_id, label, tokens from tokens where split = 'test')"


@query("stream_score", f"with {I.TOKENS}, {FIT}, {_ALL}, {sql_score('test')} select {SCORE_COLS} from scored")
def stream_score(spark, sf):
    lines = I.split_lines(spark, sf)
    model = fit_token_model(lines.filter("split = 'train'"))
    test = lines.filter("split = 'test'").select("line_id", "content", "label")
    sink = scratch_path(spark, "scores")
    J.stream_score(_stream(spark, test), model, sink, scratch_path(spark, "ck")).awaitTermination()
    return scored_columns(spark.read.parquet(sink))


@query(
    "stream_update",
    f"""with {I.TOKENS}, grams as (select unnest(tokens) ngram, label from tokens)
    select ngram, label, count(*) n from grams group by all""",
)
def stream_update(spark, sf):
    lines = I.lines(spark, sf).select("line_id", "content", "label")
    path = scratch_path(spark, "deltas")
    J.stream_update(_stream(spark, lines), path, scratch_path(spark, "ck")).awaitTermination()
    return J.load_counts(spark, path).ngram_counts


# the template each test line joins: leaves are (language, first word), a word no template begins with is the wildcard
_JOINED = f"""{SQL_TEMPLATES}, heads as (select distinct level, head from templates),
  placed as (select l.line_id, l.label, l.level, case when h.head is null and len(l.tokens) > 0
      then list_concat(['<*>'], l.tokens[2:]) else l.tokens end tokens
    from tokens l left join heads h on l.level = h.level and l.tokens[1] = h.head where l.split = 'test'),
  pairs as (select p.line_id, t.template_id, case when regexp_matches(array_to_string(p.tokens, ' '), t.regex) then 1.0::double
      else length(list_intersect(p.tokens, t.tokens))::double / nullif(length(list_distinct(list_concat(p.tokens, t.tokens))), 0) end sim
    from placed p join templates t on p.level = t.level and p.tokens[1] is not distinct from t.head),
  best as (select line_id, arg_max(template_id, (sim, template_id)) template_id, max(sim) sim from pairs group by line_id),
  test as (select p.line_id, p.label, case when t.tokens is null then p.tokens else {SQL_PAIR.format(a='t.tokens', b='p.tokens')} end tokens
    from placed p left join best b on p.line_id = b.line_id and b.sim >= 0.5 left join templates t using (template_id))"""


def _detector(spark, sf):
    """A detector of the blanked train lines as templates, grouped by language, with the counts of the train tokens."""
    with passing(spark):
        tokens = split_tokens(spark, sf)
        templates = blanked_templates(tokens).drop("regex").withColumn("group_key", F.concat("group_key", F.lit("-")))
        templates = materialize(templates, "templates", stay=True)
        heads = F.array_sort(F.collect_set(F.col("path")[0]))
        branches = templates.filter(F.size("path") > 0).groupBy("group_key").agg(heads.alias("kept")).select(
            "group_key", F.array().cast("array<string>").alias("path"), "kept", F.lit(False).alias("is_open"))
        train = tokens.filter("split = 'train'")
        return Detector(
            counts=nb_fit(train).materialize(stay=True), templates=templates,
            vocab=materialize(vocab_counts(train), "vocab", stay=True), branches=materialize(branches, "branches", stay=True),
            heads=["level"], k=0, depth=1, st=0.5)


@query(
    "stream_score_templates",
    f"with {I.TOKENS}, {FIT}, {_JOINED}, {sql_score('test')} select {SCORE_COLS} from scored",
)
def stream_score_templates(spark, sf):
    """Arriving lines scored as the stored template each joins."""
    lines = I.split_lines(spark, sf)
    detector, sink = _detector(spark, sf), scratch_path(spark, "scores")
    test = lines.filter("split = 'test'").select("line_id", "content", "label", "level")
    J.stream_score(_stream(spark, test), detector.counts, sink, scratch_path(spark, "ck"), detector=detector).awaitTermination()
    return scored_columns(spark.read.parquet(sink))


@query(
    "stream_update_templates",
    f"with {I.TOKENS}, {_JOINED}, grams as (select unnest(tokens) ngram, label from test) select ngram, label, count(*) n from grams group by all",
)
def stream_update_templates(spark, sf):
    """Counts of the templates that arriving lines join, compacted every few batches."""
    lines = I.split_lines(spark, sf)
    test = lines.filter("split = 'test'").select("line_id", "content", "label", "level")
    path = scratch_path(spark, "deltas")
    J.stream_update(
        _stream(spark, test), path, scratch_path(spark, "ck"), detector=_detector(spark, sf), compact_every=2).awaitTermination()
    return J.load_counts(spark, path).ngram_counts


@query("stream_first_occurrence", f"with {I.LINES} select distinct event_template from lines")
def stream_first_occurrence(spark, sf):
    lines = I.lines(spark, sf).select("line_id", "event_template")
    sink = scratch_path(spark, "firsts")
    q = (
        J.stream_first_occurrence(_stream(spark, lines), unbounded=True).writeStream.format("parquet")
        .option("path", sink).option("checkpointLocation", scratch_path(spark, "ck"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(sink).select("event_template")


@query(
    "stream_time_windows",
    f"""with {I.EVENTS} select strftime(s, '%Y-%m-%d %H:%M:%S') window_start, count(*) n_lines, max(label) label
    from (select label, unnest([time_bucket(interval 15 minute, ts), time_bucket(interval 15 minute, ts) - interval 15 minute]) s
      from event_lines) group by s""",
)
def stream_time_windows(spark, sf):
    # windows are appended once the watermark has passed them; the files are in no order of time, so
    # the delay covers the whole table, and a closing line far ahead lets the last windows out
    lines = I.event_lines(spark, sf).select("ts", "label")
    path, sink = scratch_path(spark, "stream_in"), scratch_path(spark, "windows")
    lines.write.parquet(path)
    stream = spark.readStream.schema(lines.schema).option(
        "maxFilesPerTrigger", spark.conf.get("timberline.stream.filesPerTrigger", "4")).parquet(path)
    checkpoint = scratch_path(spark, "ck")
    closing = spark.range(1).select(F.lit("9000-01-01").cast("timestamp").alias("ts"), F.lit(0).alias("label"))
    for more in (None, closing):
        if more is not None:
            more.write.mode("append").parquet(path)
        q = (
            J.stream_time_windows(stream, 30, 15, "36500 days").writeStream.outputMode("append").format("parquet")
            .option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        q.awaitTermination()
    return spark.read.parquet(sink).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
