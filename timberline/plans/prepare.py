"""Raw log to labelled windows of a train and a test set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import derive_label, drop_blank_templates, to_event_time
from ..operators.metrics import anomaly_ratio
from ..operators.positions import assign_line_id, chronological_split
from ..operators.windows import fixed_count_windows, sliding_time_windows
from ..session import materialize
from ..sources.logs import parse_log_format, read_raw_log, write_sessions


def map_templates(
    lines: DataFrame, template_map: DataFrame, content: str = "content", out: str = "event_template"
) -> DataFrame:
    """Template per line content; the content itself when the map lacks it.

    A content mapped to null gives an empty template.  Spark broadcasts the map when its
    measured size allows; otherwise contents shared by many lines are split by the skew join.
    """
    known = template_map.select(
        F.col("content").alias(content),
        F.coalesce("template", F.lit("")).alias("_template"),
        F.lit(True).alias("_known"),
    )
    return (
        lines.join(known, content, "left")
        .withColumn(out, F.when(F.col("_known"), F.col("_template")).otherwise(F.col(content)))
        .drop("_template", "_known")
    )


@dataclass
class PreparedData:
    """Window lines of both splits and their anomaly ratios."""

    train: DataFrame
    test: DataFrame
    ratios: DataFrame


def window_lines(lines: DataFrame, window_type: str, w: int, step: int) -> DataFrame:
    if window_type == "time":
        return sliding_time_windows(lines, w, step)
    if window_type == "fixed":
        return fixed_count_windows(lines, w)
    raise ValueError(f"unknown window type {window_type!r}")


def prepare_lines(
    lines: DataFrame, frac: float = 0.8, window_type: str = "time", w: int = 60, step: int = 60
) -> PreparedData:
    """Split typed lines ``(line_id, ts, event_template, label, …)`` and cut them into windows.

    Each split is windowed on its own, anchored at its own first second.
    """
    marked = chronological_split(drop_blank_templates(lines), frac)
    parts = {
        name: window_lines(marked.filter(F.col("split") == name), window_type, w, step)
        for name in ("train", "test")
    }
    ratios = None
    for name, part in parts.items():
        row = anomaly_ratio(part).select(F.lit(name).alias("split"), "*")
        ratios = row if ratios is None else ratios.unionByName(row)
    return PreparedData(parts["train"], parts["test"], ratios)


def parse_lines(raw: DataFrame, fmt: str) -> DataFrame:
    """Raw lines in file order to typed lines with a consecutive id over those that parse."""
    parsed = assign_line_id(parse_log_format(raw, fmt)).drop("file", "block", "row")
    typed = to_event_time(derive_label(parsed, "Label"), "Timestamp")
    return typed.withColumn("content", F.col("Content"))


def prepare_dataset(
    spark: SparkSession,
    path: str,
    fmt: str,
    template_map: DataFrame,
    frac: float = 0.8,
    window_type: str = "time",
    w: int = 60,
    step: int = 60,
    out: str | None = None,
) -> PreparedData:
    """The whole preparation from a raw log; windows are written to ``out`` when given."""
    lines = parse_lines(read_raw_log(spark, path), fmt)
    named = materialize(map_templates(lines, template_map), "typed_lines")
    data = prepare_lines(named, frac, window_type, w, step)
    if out:
        write_sessions(data.train, f"{out}/train")
        write_sessions(data.test, f"{out}/test")
    return data
