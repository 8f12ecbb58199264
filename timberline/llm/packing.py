"""Hierarchical packing of documents into sequences of several context sizes.

Every task encodes its texts and packs them in groups of bounded size. A document longer than the
largest context gives whole sequences first; the rest is routed to the smallest context that holds
it. Contexts are packed from the longest down: a piece opens a sequence and its gap is filled from
shorter contexts, cutting the last filler; a piece that finds no filler is cut to shorter contexts.
So every sequence is full, but for less than the shortest context per task. Those tails of eight
tasks each share one last sequence (the only padded ones). The sequences of a group are dealt to
training steps so that steps of a group have near equal attention cost.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; a null
doc_id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from timberline.session import materialize

from .tokens import word_encoder
from .words import slices, texts_of

#: Context sizes, longest first.
TIERS = (4096, 2048, 1024, 512)
#: Ids packed together; pieces left over go on to the next group of the task.
GROUP_IDS = 1 << 21
#: Ids in a training step.
STEP_IDS = 1 << 17
#: Tails that share a sequence: eight of less than 512 ids always fit 4096.
TAILS = TIERS[0] // TIERS[-1]

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "context long, step_id long, tail int"
)


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list]], list]:
    """Pack items of the given lengths: ([(context, [(item, start, length), ...]), ...], tail pieces).

    Each sequence is exactly full; the tail holds less than the shortest context.
    """
    full: list[tuple[int, list]] = []
    queues: dict[int, deque] = {t: deque() for t in tiers}

    def route(piece: tuple[int, int, int]) -> None:
        queues[min(t for t in tiers if t >= piece[2])].append(piece)

    for item, n in enumerate(lengths):
        whole = n - n % tiers[0]
        for start in range(0, whole, tiers[0]):
            full.append((tiers[0], [(item, start, tiers[0])]))
        if n > whole:
            route((item, whole, n - whole))
    for k, context in enumerate(tiers[:-1]):
        queue, shorter = queues[context], tiers[k + 1:]
        while queue:
            piece = queue.popleft()
            filled, gap = [piece], context - piece[2]
            while gap:
                # the largest piece that surely fits, else the smallest there is, cut
                source = next((t for t in shorter if t <= gap and queues[t]), None) or next(
                    (t for t in reversed(shorter) if queues[t]), None)
                if source is None:
                    break
                item, start, n = queues[source].popleft()
                use = min(n, gap)
                filled.append((item, start, use))
                gap -= use
                if use < n:
                    route((item, start + use, n - use))
            if not gap:
                full.append((context, filled))
                continue
            # no filler is left: the pieces go on in shorter contexts
            for item, start, n in filled:
                while n > shorter[0]:
                    route((item, start, shorter[0]))
                    start, n = start + shorter[0], n - shorter[0]
                route((item, start, n))
    least, now, room = tiers[-1], [], tiers[-1]
    for item, start, n in queues[least]:
        while n:
            use = min(n, room)
            now.append((item, start, use))
            start, n, room = start + use, n - use, room - use
            if not room:
                full.append((least, now))
                now, room = [], least
    return full, now


def steps_of(sequences: list[tuple[int, list]], step_ids: int = STEP_IDS) -> list[int]:
    """Deal sequences to steps, back and forth in order of attention cost."""
    steps = max(1, round(sum(c for c, _ in sequences) / step_ids))
    cost = [sum(n * n for _, _, n in pieces) for _, pieces in sequences]
    out = [0] * len(sequences)
    for rank, k in enumerate(sorted(range(len(sequences)), key=lambda i: (-cost[i], i))):
        turn, at = divmod(rank, steps)
        out[k] = at if turn % 2 == 0 else steps - 1 - at
    return out


class _Task:
    """Packs the documents of one task, group by group."""

    def __init__(self, part: int, group_ids: int):
        self.part, self.group_ids = part, group_ids
        self.sequences = self.steps = 0
        self.items: list[tuple] = []  # (doc_id, start in document, ids, ids of the whole document)
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.items.append((doc_id, 0, ids, len(ids)))
        self.held += len(ids)

    def rows(self, sequences, first_sequence: int, steps, tail: int) -> Iterator[tuple]:
        for k, (context, pieces) in enumerate(sequences):
            offset = 0
            for item, start, n in pieces:
                doc_id, before, ids, whole = self.items[item]
                crc = zlib.crc32(ids[start:start + n].astype("<u4").tobytes())
                yield (doc_id, before + start, n, crc, whole, (self.part << 32) + first_sequence + k, offset,
                       context, (self.part << 32) + steps[k], tail)
                offset += n

    def flush(self, last: bool = False) -> pa.RecordBatch:
        full, tail = pack_lengths([len(x[2]) for x in self.items])
        steps = [self.steps + s for s in steps_of(full)]
        rows = list(self.rows(full, self.sequences, steps, 0))
        self.sequences += len(full)
        self.steps = max(steps, default=self.steps - 1) + 1
        if last and tail:
            rows += self.rows([(TIERS[0], tail)], self.sequences, [self.steps], 1)
        self.items = [
            (self.items[i][0], self.items[i][1] + a, self.items[i][2][a:a + n].copy(), self.items[i][3])
            for i, a, n in tail
        ]
        self.held = sum(len(x[2]) for x in self.items)
        kinds = [pa.int64()] * 9 + [pa.int32()]
        columns = list(zip(*rows)) if rows else [()] * 10
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in PIECES.split(", ")])


def _pack_part(path: str, group_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = word_encoder(path), _Task(TaskContext.get().partitionId(), group_ids)
        for batch in slices(batches, "text"):
            ids, starts = encoder.encode(texts_of(batch))
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                task.add(doc_id, ids[starts[k]:starts[k + 1]])
                if task.held >= group_ids:
                    yield task.flush()
        yield task.flush(last=True)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, group_ids: int = GROUP_IDS) -> DataFrame:
    """One row per piece; texts are read where they lie, without a shuffle."""
    pieces = materialize(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .mapInArrow(_pack_part(tokenizer, group_ids), PIECES), "pieces")
    # a task has one tail of a few pieces at most
    part = F.shiftright("sequence_id", 32)
    group = F.floor(part / TAILS)
    before = Window.partitionBy(group).orderBy("sequence_id", "offset").rowsBetween(Window.unboundedPreceding, -1)
    tails = pieces.filter("tail = 1").withColumns({
        "offset": F.coalesce(F.sum("length").over(before), F.lit(0)),
        "sequence_id": F.shiftleft(group.cast("bigint"), 32) + F.lit((1 << 32) - 1),
    })
    return pieces.filter("tail = 0").unionByName(tails).drop("tail")
