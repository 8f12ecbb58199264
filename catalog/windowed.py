"""Positions, splits, time and count windows, first occurrences, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators import positions as P
from timberline.operators import verdicts as V
from timberline.operators import windows as W
from timberline.operators.metrics import session_rollup
from timberline.operators.verdicts import parse_verdict
from timberline.plans.sessions import analyse_sessions

from . import inputs as I
from .counts import SQL_METRICS, sql_windows
from .registry import query

FMT = "yyyy-MM-dd HH:mm:ss"


def _stamp(col):
    return F.date_format(col, FMT)


@query(
    "order_lines",
    f"with {I.EVENTS} select line_id, strftime(ts, '%Y-%m-%d %H:%M:%S') ts from event_lines",
)
def order_lines(spark, sf):
    return W.order_lines(I.event_lines(spark, sf)).select("line_id", _stamp("ts").alias("ts"))


def _time_windows(w, step):
    name = f"sliding_time_windows_{w}_{step}"
    sql = f"""with {I.EVENTS}, {sql_windows(w, step)} select window_id, line_id,
    strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') window_start from members"""

    @query(name, sql)
    def run(spark, sf):
        out = W.sliding_time_windows(I.event_lines(spark, sf), w, step)
        return out.select("window_id", "line_id", _stamp("window_start").alias("window_start"))


for _w, _s in ((60, 60), (60, 15), (5, 10)):
    _time_windows(_w, _s)


@query(
    "order_windows",
    f"""with {I.EVENTS}, {sql_windows(60, 15)} select window_id, count(*) n_lines, max(label) label,
    strftime(min(ts), '%Y-%m-%d %H:%M:%S') first_ts, strftime(make_timestamp(any_value(s) * 1000000),
    '%Y-%m-%d %H:%M:%S') window_start from members group by window_id""",
)
def order_windows(spark, sf):
    out = W.order_windows(W.time_window_summary(I.event_lines(spark, sf), 60, 15))
    return out.select(
        "window_id", "n_lines", "label", _stamp("first_ts").alias("first_ts"),
        _stamp("window_start").alias("window_start"),
    )


@query(
    "fixed_count_windows",
    f"with {I.EVENTS} select line_id, (row_number() over (order by ts, line_id) - 1) // 64 window_id from event_lines",
)
def fixed_count_windows(spark, sf):
    return W.fixed_count_windows(I.event_lines(spark, sf), 64).select("line_id", "window_id")


def sql_count_windows(w: int, stride: int) -> str:
    return f"""placed as (select *, row_number() over (partition by session_id order by pos) - 1 p from turns),
count_windows as (
  select a.session_id, a.p // {stride} window_id, max(b.label) label,
    coalesce(string_agg(b.event_template, chr(10) order by b.p) filter (trim(b.event_template) <> ''), '') query
  from placed a join placed b on a.session_id = b.session_id and b.p >= a.p and b.p < a.p + {w}
  where a.p % {stride} = 0 group by a.session_id, a.p having count(*) = {w})"""


def _count_windows(w, stride):
    @query(
        f"sliding_count_windows_{w}_{stride}",
        f"with {I.TURNS}, {sql_count_windows(w, stride)} select session_id, window_id, query, label from count_windows",
    )
    def run(spark, sf):
        return W.sliding_count_windows(I.turns(spark, sf), w, stride)


for _w, _s in ((1, 1), (3, 1), (3, 2)):
    _count_windows(_w, _s)


@query(
    "chronological_split",
    f"""with {I.EVENTS} select line_id, case when row_number() over (order by ts, line_id)
    <= floor(count(*) over () * 0.8::double) then 'train' else 'test' end split from event_lines""",
)
def chronological_split(spark, sf):
    return P.chronological_split(I.event_lines(spark, sf), 0.8).select("line_id", "split")


@query(
    "recent_templates",
    f"""with {I.EVENTS} select session_id, max(line_id) last_seq from event_lines group by session_id
    order by last_seq desc limit 10""",
)
def recent_templates(spark, sf):
    return W.recent_templates(I.event_lines(spark, sf), 10, "session_id")


@query(
    "first_occurrence",
    f"""with {I.LINES} select session_id, pos, line_id, content, event_template, label, level from (
      select *, row_number() over (partition by event_template order by line_id) r from lines) where r = 1""",
)
def first_occurrence(spark, sf):
    return W.first_occurrence(I.lines(spark, sf), "event_template")


# ---------------------------------------------------------------- queries and verdicts

def _verdicts(spark, sf):
    return parse_verdict(I.raw_verdicts(spark, sf))[0]


def _base(w: int, stride: int) -> str:
    return f"{I.TURNS}, {I.VERDICTS}, {sql_count_windows(w, stride)}"


@query(
    "distinct_queries",
    f"with {I.TURNS}, {sql_count_windows(3, 1)} select query, count(*) n_windows from count_windows group by query",
)
def distinct_queries(spark, sf):
    return V.distinct_queries(W.sliding_count_windows(I.turns(spark, sf), 3, 1))


@query(
    "verdict_join",
    f"""with {_base(1, 1)} select query, n_windows, prediction, analysis from
    (select query, count(*) n_windows from count_windows group by query) left join verdicts using (query)""",
)
def verdict_join(spark, sf):
    queries = V.distinct_queries(W.sliding_count_windows(I.turns(spark, sf)))
    return V.verdict_join(queries, _verdicts(spark, sf))


@query(
    "pending_queries",
    f"with {_base(1, 1)} select distinct query from count_windows where query not in (select query from verdicts)",
)
def pending_queries(spark, sf):
    return V.pending_queries(W.sliding_count_windows(I.turns(spark, sf)), _verdicts(spark, sf))


_REPORT = """report as (
  select session_id, window_id, case prediction when 'anomaly' then 1 when 'normal' then 0 end prediction, label,
    query, analysis from count_windows left join verdicts using (query))"""
_SESSIONS = """sessions as (
  select session_id, coalesce(p, false) prediction, coalesce(l, false) label
  from (select distinct session_id from turns) left join
    (select session_id, bool_or(prediction = 1) p, bool_or(label = 1) l from report group by session_id)
  using (session_id))"""


@query("verdict_report", f"with {_base(1, 1)}, {_REPORT} select *, prediction = label correct from report")
def verdict_report(spark, sf):
    return V.verdict_report(V.verdict_join(W.sliding_count_windows(I.turns(spark, sf)), _verdicts(spark, sf)))


@query("session_rollup", f"with {_base(3, 2)}, {_REPORT}, {_SESSIONS} select session_id, prediction, label from sessions")
def session_rollup_query(spark, sf):
    lines = I.turns(spark, sf)
    windows = W.sliding_count_windows(lines, 3, 2)
    report = V.verdict_report(V.verdict_join(windows, _verdicts(spark, sf)))
    return session_rollup(report, lines)


@query(
    "analyse_sessions",
    f"""with {_base(1, 1)}, {_REPORT}, {_SESSIONS} select session_id, prediction, label,
    (select count(distinct query) from count_windows where query not in (select query from verdicts)) pending,
    round(precision, 6) as precision, round(recall, 6) recall, round(f1, 6) f1 from sessions,
    ({SQL_METRICS.format("(select prediction::int prediction, label::int label from sessions)")})""",
)
def analyse(spark, sf):
    out = analyse_sessions(I.turns(spark, sf), _verdicts(spark, sf))
    metrics = out.metrics.select(F.struct(*[F.round(c, 6).alias(c) for c in out.metrics.columns])).scalar()
    pending = out.pending.select(F.count(F.lit(1))).scalar()
    return (
        out.sessions.withColumn("pending", pending).withColumn("m", metrics)
        .select("session_id", "prediction", "label", "pending", "m.precision", "m.recall", "m.f1")
    )
