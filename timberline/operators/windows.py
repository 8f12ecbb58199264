"""Time and count windows, first occurrences and recency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.text import is_blank
from .positions import dense_position, id_cells, time_cells


def order_lines(lines: DataFrame, ts: str = "ts", line_id: str = "line_id") -> DataFrame:
    """Lines by whole second, then id."""
    return lines.orderBy(F.unix_seconds(F.col(ts)), line_id)


def _with_window_range(lines: DataFrame, bounds_of: DataFrame, window_min: int, step_min: int, ts: str):
    width, step = window_min * 60, step_min * 60
    second = F.unix_seconds(F.col(ts))
    # one-row scalar subquery: first and last second of the data
    bounds = bounds_of.select(
        F.struct(F.min(second).alias("t0"), F.max(second).alias("t1"))
    ).scalar()
    tagged = lines.withColumn("_b", bounds).withColumn("_rel", second - F.col("_b.t0"))
    last = F.floor((F.col("_b.t1") - F.col("_b.t0") - width + 1) / step)
    lo = F.greatest(F.lit(0), F.ceil((F.col("_rel") - width + 1) / step))
    hi = F.least(last, F.floor(F.col("_rel") / step))
    ids = F.explode(F.when(lo <= hi, F.sequence(lo, hi)))
    start = F.timestamp_seconds(F.col("_b.t0") + F.col("window_id") * step)
    return (
        tagged.withColumn("window_id", ids).withColumn("window_start", start).drop("_b", "_rel")
    )


def sliding_time_windows(
    lines: DataFrame, window_min: int, step_min: int, ts: str = "ts"
) -> DataFrame:
    """One row per line and window holding it.

    Windows start at the first second of the data, every ``step_min`` minutes, as long as the
    whole window fits; a line computes its own windows, so there is no range join.
    """
    return _with_window_range(lines, lines, window_min, step_min, ts)


def time_window_summary(
    lines: DataFrame, window_min: int, step_min: int, ts: str = "ts", label: str = "label"
) -> DataFrame:
    """Lines, any-label and first line time per time window.

    Lines are reduced to one row per second before they are spread over their windows.
    """
    second = F.timestamp_seconds(F.unix_seconds(F.col(ts)))
    per_second = lines.groupBy(second.alias("ts")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.max(label).alias("label")
    )
    spread = _with_window_range(per_second, lines.select(F.col(ts).alias("ts")), window_min, step_min, "ts")
    return spread.groupBy("window_id", "window_start").agg(
        F.sum("n_lines").alias("n_lines"),
        F.max("label").alias("label"),
        F.min("ts").alias("first_ts"),
    )


def order_windows(windows: DataFrame, by: str = "first_ts") -> DataFrame:
    """Windows by the time of their first line."""
    return windows.orderBy(by, "window_id")


def fixed_count_windows(
    lines: DataFrame, w: int, ts: str | None = "ts", line_id: str = "line_id"
) -> DataFrame:
    """Blocks of ``w`` lines in time order; the last block may be short."""
    coarse, fine = time_cells(ts, line_id) if ts else id_cells(line_id)
    placed = dense_position(lines, coarse, fine, [line_id], out="_pos")
    return placed.withColumn("window_id", F.floor((F.col("_pos") - 1) / w)).drop("_pos")


def sliding_count_windows(
    lines: DataFrame,
    w: int = 1,
    stride: int = 1,
    session: str = "session_id",
    pos: str = "pos",
    template: str = "event_template",
    label: str = "label",
) -> DataFrame:
    """Per session, windows of ``w`` lines every ``stride`` lines; only full windows.

    Each line names the windows it belongs to and a window is gathered by its own key, so a
    long session spreads over as many groups as it has windows, each of ``w`` rows.
    """
    base = lines.select(session, pos, template, label)
    coarse, fine = id_cells(pos)
    placed = dense_position(base, coarse, fine, [pos], partition=[session], out="_pos").withColumn(
        "_pos", F.col("_pos") - 1
    )
    if w == 1:
        windows = placed.filter(F.col("_pos") % stride == 0).select(
            session,
            F.floor(F.col("_pos") / stride).alias("window_id"),
            F.when(is_blank(template), F.lit("")).otherwise(F.col(template)).alias("query"),
            F.col(label).alias("label"),
        )
        return windows
    lo = F.greatest(F.lit(0), F.ceil((F.col("_pos") - w + 1) / stride))
    hi = F.floor(F.col("_pos") / stride)
    spread = placed.withColumn("window_id", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    gathered = spread.groupBy(session, "window_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(label).alias("label"),
        F.array_sort(
            F.collect_list(F.struct("_pos", F.coalesce(F.col(template), F.lit("")).alias("t")))
        ).alias("_rows"),
    )
    texts = F.transform(F.filter("_rows", lambda r: ~is_blank(r["t"])), lambda r: r["t"])
    return gathered.filter(F.col("_n") == w).select(
        session, "window_id", F.array_join(texts, "\n").alias("query"), "label"
    )


def recent_templates(
    assignments: DataFrame, n: int = 10, id_col: str = "template_id", seq: str = "line_id"
) -> DataFrame:
    """The ``n`` most recently touched template ids."""
    return (
        assignments.groupBy(id_col).agg(F.max(seq).alias("last_seq"))
        .orderBy(F.desc("last_seq")).limit(n)
    )


def first_occurrence(lines: DataFrame, key: str, order: Sequence[str] = ("line_id",)) -> DataFrame:
    """The first line per key; copies are merged before the shuffle."""
    rest = [c for c in lines.columns if c != key]
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return (
        lines.groupBy(key).agg(F.min_by(F.struct(*rest), rank).alias("_first"))
        .select(*[F.col(key) if c == key else F.col(f"_first.{c}").alias(c) for c in lines.columns])
    )
