"""Exact deduplication against a persistent digest index, in DataFrame operations only.

The index is a table bucketed and sorted by the SHA-256 of the text. A batch of documents is
reduced to one row per digest, anti-joined to the index by sort-merge (the index side needs no
shuffle) and the new digests are appended. The verdict of every document is a join with the index.

Defined results: a null text counts as empty; texts are compared unchanged; the row with the
largest ``doc_id`` of a batch stays, unless the index had the text before, then the indexed row
does; rows that repeat both id and text are one document and come out as one row; a null id is the
smallest; an empty table gives an empty result. Only ``doc_id`` and the text are read, so further
columns of any name do no harm.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from timberline.session import scratch_path

from .tables import fresh


class DigestIndex:
    """A persistent table of digests at ``path``; open the same path again to go on with it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, name: str | None = None):
        self.spark, self.path = spark, path
        self.name = name or f"digests_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(
            f"create table if not exists {self.name} (text_sha256 string, keep_id bigint, group_size bigint) "
            f"using parquet clustered by (text_sha256) sorted by (text_sha256) into {self.buckets} buckets "
            f"location '{path}'"
        )

    def read(self) -> DataFrame:
        """The index as a bucketed table: joins on the digest need no shuffle of it."""
        return self.spark.table(self.name)

    def scan(self) -> DataFrame:
        """The same rows as plain files, so that a join may deal out a hot digest anew."""
        return self.spark.read.schema(self.read().schema).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        (
            rows.repartition(self.buckets, "text_sha256").write.mode("append").format("parquet")
            .bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.name)
        )


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: (doc_id, text_sha256)."""
    return (
        docs.select("doc_id", F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_sha256"))
        .distinct()
    )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every document, after indexing ``docs``.

    ``group_size`` counts the documents that brought the text into the index, and those of this
    batch if the text was indexed before.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark, scratch_path(spark, "digests"))
    rows = digests(docs, text)
    batch = rows.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    known = index.read().select("text_sha256").hint("merge")
    had = not index.read().isEmpty()
    before = batch.join(index.read().hint("merge").select("text_sha256"), "text_sha256", "left_semi") if had else None
    repeats = None
    if before is not None:
        repeats = before.select("text_sha256", F.col("group_size").alias("again"))
        path = scratch_path(spark, "repeats")
        repeats.write.parquet(path)
        repeats = spark.read.schema(repeats.schema).parquet(path)
    index.append(batch.join(known, "text_sha256", "left_anti"))
    entries = index.scan()
    if repeats is not None:
        entries = entries.join(repeats, "text_sha256", "left").select(
            "text_sha256", "keep_id", (F.col("group_size") + F.coalesce("again", F.lit(0))).alias("group_size"))
    return (
        rows.join(entries.hint("merge"), "text_sha256")
        .select(
            "doc_id", "keep_id", "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
        )
    )


def exact_unique(docs: DataFrame, verdicts: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their own columns; rows repeated in id and text stay once."""
    lowest = F.lit(-(1 << 63))
    key, sha = fresh(docs, "__key"), fresh(docs, "__sha")
    keys = verdicts.filter("kept").select(F.coalesce("doc_id", lowest).alias(key), F.col("text_sha256").alias(sha))
    rows = docs.withColumns({
        key: F.coalesce("doc_id", lowest), sha: F.sha2(F.coalesce(F.col(text), F.lit("")), 256)})
    kept = rows.join(keys.hint("merge"), [key, sha], "left_semi")
    return kept.dropDuplicates([key, sha]).select(*docs.columns)


EXACT_SQL = """
with d as (select distinct doc_id, sha256(coalesce("text", '')) text_sha256 from documents)
select doc_id, max(doc_id) over w keep_id, count(*) over w group_size,
       doc_id is not distinct from max(doc_id) over w kept, text_sha256
from d window w as (partition by text_sha256)"""
