"""Structured Streaming forms of scoring, updating, deduplication and windowing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tokenize_line
from ..operators.bayes import NgramCounts, add_counts, build_scorer, nb_fit, nb_score
from ..operators.mining import TemplateIndex, index_templates
from ..plans.detector import Detector, joined_template
from ..session import drop_path, list_names, materialize, passing, path_exists, tidy


def _start(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool
) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _index(detector: Detector | None) -> TemplateIndex | None:
    return index_templates(detector.templates, detector.st) if detector else None


def _docs(lines: DataFrame, detector: Detector | None = None, index: TemplateIndex | None = None) -> DataFrame:
    """Tokens of the template each line joins, of the line itself without a detector."""
    if detector is None:
        return lines.select("line_id", "label", tokenize_line("content").alias("tokens"))
    lines = lines.persist()
    return lines.select("line_id", "label").join(joined_template(lines, detector, index=index), "line_id")


def stream_score(
    stream: DataFrame, model: NgramCounts, sink: str, checkpoint: str, once: bool = True,
    detector: Detector | None = None,
) -> StreamingQuery:
    """Score arriving lines ``(line_id, content, label)`` with fixed counts.

    With a ``detector`` a line is scored as the frozen template it joins; its heads are further columns.
    A micro-batch writes its own folder of ``sink``, so a replay replaces its rows.
    """
    scorer, index = build_scorer(model), _index(detector)

    def each(batch: DataFrame, batch_id: int) -> None:
        # what a batch writes on its way goes with it, else it would add up over the stream
        with passing(batch.sparkSession), tidy(batch.sparkSession):
            docs = materialize(_docs(batch, detector, index), "docs")
            docs.select("line_id", "label").join(nb_score(docs, scorer), "line_id").write.mode(
                "overwrite"
            ).parquet(f"{sink}/batch_id={batch_id}")
            batch.unpersist()

    return _start(stream, each, checkpoint, once)


_TABLES = ("class_counts", "ngram_counts")


def stream_update(
    stream: DataFrame,
    model_path: str,
    checkpoint: str,
    base: NgramCounts | None = None,
    scores: str | None = None,
    once: bool = True,
    detector: Detector | None = None,
    compact_every: int = 32,
) -> StreamingQuery:
    """Test, then train: score a micro-batch with the counts so far, then add its own counts.

    With a ``detector`` a line counts as the frozen template it joins; its heads are further columns.
    Counts are kept as one delta per batch id; a replayed batch overwrites its delta, and
    ``load_counts`` adds them up.  Every ``compact_every`` batches the deltas so far become one
    snapshot, so a batch reads one snapshot and at most that many deltas, however long the stream runs.
    """

    index = _index(detector)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # what a batch writes on its way goes with it, else it would add up over the stream
        with passing(spark), tidy(spark):
            docs = materialize(_docs(batch, detector, index), "docs")
            if batch_id and batch_id % compact_every == 0:
                compact_counts(spark, model_path, batch_id)
            if scores:
                before = load_counts(spark, model_path, base, before=batch_id)
                if before is not None:
                    nb_score(docs, before).write.mode("overwrite").parquet(f"{scores}/batch_id={batch_id}")
            delta = nb_fit(docs)
            for name in _TABLES:
                getattr(delta, name).write.mode("overwrite").parquet(f"{model_path}/{name}/batch_id={batch_id}")
            batch.unpersist()

    return _start(stream, each, checkpoint, once)


def _written(spark, model_path: str, before: int | None) -> tuple[int, list[int]]:
    """(the batch id the newest complete snapshot ends before, 0 without one; ids of the later deltas)."""
    def ids(folder: str, prefix: str, marks: tuple[str, ...]) -> list[int]:
        out = [int(n.removeprefix(prefix)) for n in list_names(spark, folder) if n.startswith(prefix)]
        return [i for i in out if (before is None or i < before + (prefix == "before=")) and all(
            path_exists(spark, f"{folder}/{prefix}{i}/{m}_SUCCESS") for m in marks)]

    start = max(ids(f"{model_path}/snapshots", "before=", tuple(f"{t}/" for t in _TABLES)), default=0)
    classes, grams = (sorted(i for i in ids(f"{model_path}/{t}", "batch_id=", ("",)) if i >= start) for t in _TABLES)
    # a batch that was cut off left one table only; its replay writes both
    whole = sorted(set(classes) & set(grams))
    if not whole and not start and (classes or grams) and before is None:
        raise FileNotFoundError(f"{model_path} holds only one of class_counts and ngram_counts")
    return start, whole


def _sum_written(spark, model_path: str, start: int, deltas: list[int]) -> NgramCounts | None:
    tables = []
    for name in _TABLES:
        paths = [f"{model_path}/snapshots/before={start}/{name}"] * (start > 0) + [f"{model_path}/{name}/batch_id={i}" for i in deltas]
        tables.append(spark.read.parquet(*paths) if paths else None)
    if tables[0] is None:
        return None
    return add_counts(NgramCounts(tables[0].limit(0), tables[1].limit(0)), NgramCounts(*tables))


def compact_counts(spark, model_path: str, before: int) -> None:
    """Turn the snapshot and deltas of all batches before ``before`` into one snapshot, then drop them.

    Batches before a running one are finished for good, so their deltas never change again. A snapshot
    counts once both of its tables are committed; what it replaces is deleted after that.
    """
    start, deltas = _written(spark, model_path, before)
    if not deltas or start >= before:
        return
    counts = _sum_written(spark, model_path, start, deltas)
    for name in _TABLES:
        getattr(counts, name).write.mode("overwrite").parquet(f"{model_path}/snapshots/before={before}/{name}")
    for name in _TABLES:
        for i in deltas:
            drop_path(spark, f"{model_path}/{name}/batch_id={i}")
    if start:
        drop_path(spark, f"{model_path}/snapshots/before={start}")


def load_counts(
    spark, model_path: str, base: NgramCounts | None = None, before: int | None = None
) -> NgramCounts | None:
    """Counts of all written batches (or those before a batch id) on top of ``base``."""
    found = _sum_written(spark, model_path, *_written(spark, model_path, before))
    if found is None:  # nothing written yet
        return base
    return found if base is None else add_counts(base, found)


def stream_first_occurrence(
    stream: DataFrame, key: str = "event_template", ts: str = "ts", watermark: str | None = None,
    unbounded: bool = False,
) -> DataFrame:
    """Each key only when first seen; with a watermark, first within that delay.

    Without a watermark every key is kept for ever, which must be asked for (``unbounded``).
    """
    if watermark is None:
        if not unbounded:
            raise ValueError("give a watermark, or unbounded=True to keep every key for ever")
        return stream.dropDuplicates([key])
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def stream_time_windows(
    stream: DataFrame,
    window_min: int,
    step_min: int,
    watermark: str,
    origin: int = 0,
    ts: str = "ts",
    label: str = "label",
) -> DataFrame:
    """Lines and any-label per event-time window; ``origin`` (epoch seconds) anchors them.

    A stream has no first second, so the anchor is given and the windows at the edges count.
    Lines later than ``watermark`` behind the newest are left out.
    """
    start = f"{origin % (step_min * 60)} seconds"
    return (
        stream.withWatermark(ts, watermark)
        .groupBy(F.window(ts, f"{window_min} minutes", f"{step_min} minutes", start))
        .agg(F.count(F.lit(1)).alias("n_lines"), F.max(label).alias("label"))
        .select(F.col("window.start").alias("window_start"), "n_lines", "label")
    )
