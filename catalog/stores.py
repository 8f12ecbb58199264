"""Sources, sinks and the preparation plan; files go to the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators.bayes import NgramCounts
from timberline.operators.positions import assign_line_id
from timberline.operators.metrics import binary_metrics
from timberline.operators.verdicts import parse_verdict
from timberline.operators.windows import first_occurrence
from timberline.plans.detector import detect_tokens, fit_token_model
from timberline.plans.prepare import map_templates, prepare_dataset
from timberline.session import scratch_path
from timberline.sources import logs as L
from timberline.sources import sinks as S

from . import inputs as I
from .counts import FIT, _FIRST, SQL_METRICS, sql_score
from .registry import query


def _log_file(spark, raw):
    """The raw lines as text files in line order."""
    path = scratch_path(spark, "raw")
    raw.orderBy("line_id").select("value").write.text(path)
    return path


@query("read_raw_log", f"with {I.RAW} select value from raw_lines")
def read_raw_log(spark, sf):
    return L.read_raw_log(spark, _log_file(spark, I.raw_lines(spark, sf))).select("value")


@query(
    "parse_log_format",
    f"with {I.PARSED} select line_id, node, level, content, case label when 1 then 'FAIL' else '-' end flag from parsed",
)
def parse_log_format(spark, sf):
    out = L.parse_log_format(I.raw_lines(spark, sf), L.LOG_FORMATS["BGL"])
    return out.select(
        "line_id", F.col("Node").alias("node"), F.col("Level").alias("level"),
        F.col("Content").alias("content"), F.col("Label").alias("flag"),
    )


@query(
    "parse_log_format_optional",
    """select event_id + 1 line_id, 'loc' as location, 'app' component,
    case when event_id % 2 = 0 then event_id::varchar end pid, event_type as content
    from events where event_id % 10 <> 9""",
)
def parse_log_format_optional(spark, sf):
    out = L.parse_log_format(I.raw_lines_pid(spark, sf), L.LOG_FORMATS["Thunderbird"])
    return out.select(
        "line_id", F.col("Location").alias("location"), F.col("Component").alias("component"),
        F.col("PID").alias("pid"), F.col("Content").alias("content"),
    )


@query("assign_line_id", f"with {I.PARSED} select line_id, level, content from parsed")
def assign(spark, sf):
    raw = L.read_raw_log(spark, _log_file(spark, I.raw_lines(spark, sf)))
    out = assign_line_id(L.parse_log_format(raw, L.LOG_FORMATS["BGL"]))
    return out.select("line_id", F.col("Level").alias("level"), F.col("Content").alias("content"))


@query("read_sessions", f"with {I.SPLIT_LINES} select * from split_lines")
def read_sessions(spark, sf):
    path = scratch_path(spark, "sessions")
    L.write_sessions(I.split_lines(spark, sf), path)
    return L.read_sessions(spark, path)


MAP = """template_map as (
  select distinct content, case when level <> 'CLICK' then regexp_replace(content, '\\{.*\\}', '<*>') end template
  from parsed)"""


def template_map(spark, sf):
    """Content to template of the raw lines; clicks have none."""
    parsed = L.parse_log_format(I.raw_lines(spark, sf), L.LOG_FORMATS["BGL"])
    template = F.when(F.col("Level") != "CLICK", F.regexp_replace("Content", r"\{.*\}", "<*>"))
    return parsed.select(F.col("Content").alias("content"), template.alias("template")).distinct()


@query("read_template_map", f"with {I.PARSED}, {MAP} select content, template from template_map")
def read_template_map(spark, sf):
    path = scratch_path(spark, "template_map")
    pairs = template_map(spark, sf).select(
        F.to_json(F.create_map("content", "template"), {"ignoreNullFields": "false"}).alias("value")
    )
    pairs.write.text(path)
    return L.read_template_map(spark, path)


@query("read_verdicts", f"with {I.TURNS}, {I.VERDICTS} select query, prediction, analysis from verdicts")
def read_verdicts(spark, sf):
    path = scratch_path(spark, "verdicts")
    L.write_verdicts(parse_verdict(I.raw_verdicts(spark, sf))[0].drop("raw"), path)
    return L.read_verdicts(spark, path).select("query", "prediction", "analysis")


@query(
    "write_report_csv",
    f"""with {I.LINES} select session_id, line_id, event_template, label from (
    select *, row_number() over (partition by event_template order by line_id) r from lines) where r = 1""",
)
def write_report_csv(spark, sf):
    path = scratch_path(spark, "report")
    unique = first_occurrence(I.lines(spark, sf), "event_template")
    S.write_report_csv(unique.select("session_id", "line_id", "event_template", "label"), path)
    return spark.read.option("header", True).option("escape", '"').schema(
        "session_id long, line_id long, event_template string, label int"
    ).csv(path)


_PARAMS = {"depth": 4, "st": 0.5, "topk": 3}


@query(
    "append_results",
    f"""with {I.TOKENS}, {FIT}, {_FIRST}, {sql_score('test')}
    select substr(sha256('{{"depth": 4, "topk": 3}}'), 1, 8) expname, 4 depth, 0.5::double st, 3 topk,
      round(precision, 6) as precision, round(recall, 6) recall, round(f1, 6) f1
    from ({SQL_METRICS.format('scored')})""",
)
def append_results(spark, sf):
    lines = I.split_lines(spark, sf)
    model = fit_token_model(lines.filter("split = 'train'"))
    m = binary_metrics(detect_tokens(lines.filter("split = 'test'"), model))
    path = scratch_path(spark, "results")
    rounded = m.select(*[F.round(c, 6).alias(c) for c in m.columns])
    record = S.append_results(rounded, _PARAMS, path, keys=["depth", "topk"])
    return spark.read.option("header", True).schema(record.schema).csv(path)


@query(
    "save_load_model",
    f"with {I.TOKENS}, {FIT} select ngram, label, n from ngram_counts",
)
def save_load_model(spark, sf):
    path = scratch_path(spark, "model")
    S.save_model(fit_token_model(I.split_lines(spark, sf).filter("split = 'train'")), path)
    return S.load_model(spark, path, NgramCounts).ngram_counts


_CONTENT_MAP = """template_map as (
  select distinct content, case when content not like '%ing%'
    then regexp_replace(content, '[A-Z][a-z]+', '<*>', 'g') end template
  from split_lines where split = 'train')"""


@query(
    "map_templates",
    f"""with {I.SPLIT_LINES}, {_CONTENT_MAP} select line_id, case when m.content is null then l.content
    else coalesce(m.template, '') end event_template from split_lines l left join template_map m on l.content = m.content""",
)
def map_templates_query(spark, sf):
    lines = I.split_lines(spark, sf)
    template = F.when(
        ~F.col("content").contains("ing"), F.regexp_replace("content", "[A-Z][a-z]+", "<*>")
    )
    known = lines.filter("split = 'train'").select("content", template.alias("template")).distinct()
    return map_templates(lines, known).select("line_id", "event_template")


def _prepared(w: int, step: int) -> str:
    return f"""{I.PARSED}, {MAP}, typed as (
  select * from (select line_id, ts, label, coalesce(m.template, '') event_template
    from parsed p left join template_map m on p.content = m.content) where trim(event_template) <> ''),
marked as (select *, case when row_number() over (order by ts, line_id) <= floor(count(*) over () * 0.8::double)
  then 'train' else 'test' end split from typed),
bounds as (select split, epoch(min(ts))::bigint t0, epoch(max(ts))::bigint t1 from marked group by split),
starts as (select split, (s - t0) // {step * 60} window_id, s from (
  select split, t0, unnest(generate_series(t0, t1 - {w * 60} + 1, {step * 60})) s from bounds)),
members as (select s.split, s.window_id, e.line_id, e.event_template, e.label from starts s join marked e
  on e.split = s.split and epoch(e.ts) >= s.s and epoch(e.ts) <= s.s + {w * 60 - 1})"""


def _dataset(spark, sf, w, step):
    path = _log_file(spark, I.raw_lines(spark, sf))
    return prepare_dataset(
        spark, path, L.LOG_FORMATS["BGL"], template_map(spark, sf), 0.8, "time", w, step
    )


@query(
    "prepare_dataset",
    f"with {_prepared(60, 60)} select split, window_id, line_id, event_template, label from members",
)
def prepare(spark, sf):
    data = _dataset(spark, sf, 60, 60)
    cols = ["split", "window_id", "line_id", "event_template", "label"]
    return data.train.select(*cols).unionByName(data.test.select(*cols))


@query(
    "prepare_dataset_ratios",
    f"""with {_prepared(5, 5)} select split, count(*) filter (label = 1) anomaly_windows, count(*) windows,
    round(count(*) filter (label = 1) / count(*), 6) ratio
    from (select split, window_id, max(label) label from members group by all) group by split""",
)
def prepare_ratios(spark, sf):
    return _dataset(spark, sf, 5, 5).ratios.withColumn("ratio", F.round("ratio", 6))
