"""The backbone analyser: windows, queries, verdicts, session results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.metrics import binary_metrics, session_rollup
from ..operators.verdicts import distinct_queries, pending_queries, verdict_join, verdict_report
from ..operators.windows import sliding_count_windows
from ..session import materialize


@dataclass
class SessionAnalysis:
    """Per-window report, per-session results, queries still to be judged, metrics."""

    report: DataFrame
    sessions: DataFrame
    pending: DataFrame
    metrics: DataFrame


def analyse_sessions(
    lines: DataFrame, verdicts: DataFrame, w: int = 1, stride: int = 1
) -> SessionAnalysis:
    """Judge sessions by the cached verdicts of their windows.

    ``verdicts(query, prediction, analysis)`` holds valid verdicts only.  A window without a
    verdict has a null prediction, counts as not anomalous and is listed as pending.
    """
    windows = materialize(sliding_count_windows(lines, w, stride), "windows")
    # each distinct query meets the verdicts once
    judged = verdict_join(distinct_queries(windows), verdicts).drop("n_windows")
    report = verdict_report(windows.join(judged, "query"))
    sessions = session_rollup(report, lines)
    pending = pending_queries(windows, verdicts)
    metrics = binary_metrics(sessions)
    return SessionAnalysis(report, sessions, pending, metrics)
