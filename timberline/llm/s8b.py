"""Token-id files in Simple-8b: 64-bit words, each a 4-bit selector and as many ids as fit in 60 bits.

A file is a Parquet part of blocks in ascending order of document ids. A block holds whole
documents: their ids as little-endian words, the exceptions (ids of 60 bits or more, stored as zero
in the words), and the offset of each document, so a block decodes by array operations alone. Spark's
writer commits the parts, so a lost executor leaves neither gaps nor doubles.

Defined results: a null or empty text is the end id alone; a null doc_id sorts first; rows with
equal ids follow one another in no fixed order; an empty table gives no part and an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from timberline.session import scratch_path

from .tokens import word_encoder
from .words import slices, texts_of

#: Fixed values of the coding: selector -> (ids in a word, bits of each).
SELECTORS = [
    (240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
]
#: Ids after which a block is closed.
BLOCK_IDS = 1 << 16

BLOCKS = "part int, block int, first long, n_ids long, doc_ids array<bigint>, offsets array<bigint>, words binary, escape_at array<bigint>, escapes binary"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, positions of the escapes, escaped values) of unsigned ids."""
    ids = np.asarray(ids, np.uint64)
    escape_at = np.flatnonzero(ids >= np.uint64(1 << 60))
    escapes = ids[escape_at]
    if len(escape_at):
        ids = ids.copy()
        ids[escape_at] = 0
    n = len(ids)
    # bits of every id, and for a selector the most of the ids it would take, by maxima over powers of two
    bits_of = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    for k in np.flatnonzero(ids >= np.uint64(1 << 53)):
        bits_of[k] = int(ids[k]).bit_length()
    most = {1: bits_of}
    while 2 * max(most) <= n:
        p = max(most)
        most[2 * p] = np.maximum(most[p][:-p], most[p][p:])
    best = np.full(n, len(SELECTORS) - 1, np.uint8)
    for selector in range(len(SELECTORS) - 2, -1, -1):
        count, bits = SELECTORS[selector]
        if count > n:
            continue
        p = 1 << (count.bit_length() - 1)
        first = n - count + 1
        fits = np.maximum(most[p][:first], most[p][count - p:count - p + first]) <= bits
        best[:first][fits] = selector
    counts = np.array([c for c, _ in SELECTORS])
    step, at, i = counts[best].tolist(), [], 0
    while i < n:
        at.append(i)
        i += step[i]
    at = np.array(at, np.int64)
    chosen = best[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(chosen == selector)
        if len(mine) and bits:
            for k in range(count):
                words[mine] |= ids[at[mine] + k] << np.uint64(k * bits)
    return words, escape_at, escapes


def unpack(words: np.ndarray, escape_at=(), escapes=()) -> np.ndarray:
    words = np.asarray(words, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS])[chosen]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for selector, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(chosen == selector)
        if len(mine) and bits:
            at, low = ends[mine] - count, np.uint64((1 << bits) - 1)
            for k in range(count):
                out[at + k] = (words[mine] >> np.uint64(k * bits)) & low
    if len(escape_at):
        out[np.asarray(escape_at)] = escapes
    return out


def _encode_part(path: str, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, block, first = word_encoder(path), TaskContext.get().partitionId(), 0, 0
        for batch in slices(batches, "text"):
            ids, starts = encoder.encode(texts_of(batch))
            docs, a = batch.column("doc_id"), 0
            while a < len(docs):
                b = max(a + 1, int(np.searchsorted(starts, starts[a] + block_ids, "right")) - 1)
                words, escape_at, escapes = pack(ids[starts[a]:starts[b]])
                yield pa.RecordBatch.from_arrays([
                    pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()),
                    pa.array([int(starts[b] - starts[a])], pa.int64()),
                    pa.array([docs[a:b].to_pylist()], pa.list_(pa.int64())),
                    pa.array([(starts[a:b + 1] - starts[a]).tolist()], pa.list_(pa.int64())),
                    pa.array([words.astype("<u8").tobytes()], pa.binary()),
                    pa.array([escape_at.tolist()], pa.list_(pa.int64())),
                    pa.array([escapes.astype("<u8").tobytes()], pa.binary()),
                ], names=["part", "block", "first", "n_ids", "doc_ids", "offsets", "words", "escape_at", "escapes"])
                first += int(starts[b] - starts[a])
                block, a = block + 1, b

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text and write the blocks below ``path`` in ascending doc_id order."""
    (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        .mapInArrow(_encode_part(tokenizer, block_ids), BLOCKS)
        .write.parquet(path)
    )


def block_ids_of(row: dict) -> np.ndarray:
    """All ids of a block, as read."""
    return unpack(np.frombuffer(row["words"], "<u8"), row["escape_at"], np.frombuffer(row["escapes"], "<u8"))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            raw, edges = block_ids_of(row).astype("<u4").tobytes(), row["offsets"]
            n = len(row["doc_ids"])
            yield pa.RecordBatch.from_arrays([
                pa.array([row["part"]] * n, pa.int32()),
                pa.array([row["first"] + e for e in edges[:-1]], pa.int64()),
                pa.array(row["doc_ids"], pa.int64()),
                pa.array([b - a for a, b in zip(edges, edges[1:])], pa.int64()),
                pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(edges, edges[1:])], pa.int64()),
            ], names=["part", "in_part", "doc_id", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files: (doc_id, start, n_tokens, ids_crc32) of every document."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # one row for each part; the parts are in ascending order of doc_id
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    docs = blocks.mapInArrow(_decode, "part int, in_part long, doc_id long, n_tokens long, ids_crc32 long")
    return docs.join(offsets, "part").select(
        "doc_id", (F.col("before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the files and read them back."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer)
    return read_token_files(docs.sparkSession, path)
