"""Chat transcripts to turns: a hidden Markov model over speaker markers and line features.

A state is a role and whether the line starts a turn. Start, transition and emission counts are
aggregated by Spark from labelled transcripts into a few hundred numbers. Lines are decoded in blocks
of bounded size: each block yields the best score from every entering to every leaving state
(a max-plus matrix); the matrices of a transcript are chained, which fixes the states at the block
edges; then every block is decoded on its own. So the result is the Viterbi path of the whole
transcript, whatever its length. Turns are rendered as ``<|role|>``, text and ``<|end|>``.

Defined results: lines are ordered by ``pos``, equal positions by text; a row repeated in all of
conv_id, pos and line counts once; a null line is empty, a null position comes first, a null conv_id
is a transcript of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from timberline.session import materialize

ROLES = ("system", "user", "assistant")
STATES = [(r, s) for r in ROLES for s in (True, False)]
#: Speaker names by role, as written before a colon or in brackets.
SPEAKERS = {
    "system": ("system", "instructions", "setup"),
    "user": ("user", "human", "question", "customer", "q"),
    "assistant": ("assistant", "ai", "bot", "answer", "agent", "a"),
}
_ROLE = {name: r for r, names in SPEAKERS.items() for name in names}
_MARK = re.compile(
    r"^\s*(?:[#*>\[<|\s]*)(" + "|".join(sorted(_ROLE, key=len, reverse=True)) + r")(?:\s*[\]>|*]+\s*:?|\s*:)\s*", re.IGNORECASE)
#: Lines' worth of the share among all lines in a state's share of a feature value.
PRIOR = 1.0
#: Positions of a block (256 turns), and the rows it is cut into where it has more.
SPAN_BITS, BLOCK_ROWS = 28, 4096


def marker(line: str) -> tuple[str, str]:
    """(role named by a speaker marker or '', the line without it)."""
    found = _MARK.match(line)
    return (_ROLE[found[1].lower()], line[found.end():]) if found else ("", line)


def observations(line: str) -> tuple[str, ...]:
    """Discrete features of a line, one value of each kind."""
    role, rest = marker(line)
    n = len(rest)
    return (
        "m=" + role, "n=" + str(min(n.bit_length(), 10)), "q=" + str(rest.rstrip().endswith("?")),
        "c=" + ("up" if rest[:1].isupper() else "low" if rest[:1].islower() else "other"),
        "s=" + str(min(sum(map(rest.count, ".!?")), 6)),
    )


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: dict
    #: what a value never met says of each state: as much of every one
    unseen: np.ndarray

    def emissions(self, lines: list[str]) -> np.ndarray:
        """Log-odds of each state by each line's features."""
        out = np.zeros((len(lines), len(STATES)))
        for k, line in enumerate(lines):
            for o in observations(line):
                out[k] += self.emit.get(o, self.unseen)
        return out


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of a batch of labelled lines, counted."""
    for batch in batches:
        lines = [line or "" for line in batch.column("line").to_pylist()]
        found = Counter(
            (role, starts, o) for role, starts, line in zip(batch.column("role").to_pylist(), batch.column("is_start").to_pylist(), lines)
            for o in observations(line))
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.bool_()),
            pa.array([k[2] for k in found], pa.string()), pa.array(list(found.values()), pa.int64()),
        ], names=["role", "is_start", "o", "n"])


def _marker_share(named: str, role: str, starts: bool) -> float:
    """How many lines of a state name a role before anything is known of it: its own when a turn starts, else none."""
    if starts:
        return {role: 0.7, "": 0.28}.get(named, 0.01)
    return 0.97 if not named else 0.01


def fit(lines: DataFrame) -> Model:
    """From labelled ``lines(conv_id, pos, line, role, is_start)``."""
    index = {s: k for k, s in enumerate(STATES)}
    w = Window.partitionBy("conv_id", F.shiftright("pos", SPAN_BITS)).orderBy("pos", "line")
    rows = lines.select(
        "conv_id", "pos", "role", "is_start", "line",
        F.lag("role").over(w).alias("before"), F.lag("is_start").over(w).alias("before_start"))
    moves = rows.groupBy("before", "before_start", "role", "is_start").count().collect()  # at most 7 x 6 rows
    seen = (
        lines.select("role", "is_start", "line").mapInArrow(_observed, "role string, is_start boolean, o string, n long")
        .groupBy("role", "is_start", "o").agg(F.sum("n").alias("n")).collect()  # at most 6 x 40 rows
    )
    start, step = np.ones(len(STATES)), np.full((len(STATES), len(STATES)), 0.5)
    for r in moves:
        if (to := index.get((r.role, r.is_start))) is None:
            continue
        at = index.get((r.before, r.before_start))
        if at is None:
            start[to] += r["count"]
        else:
            step[at, to] += r["count"]
    counts: dict[str, np.ndarray] = {}
    for r in seen:
        if (k := index.get((r.role, r.is_start))) is not None:
            counts.setdefault(r.o, np.zeros(len(STATES)))[k] += r.n
    # a state's share of a value leans towards the value's share among all lines, so that a rare state is
    # not taken for what it was merely never seen with; markers lean towards the role they name
    for role in ("", *ROLES):
        counts.setdefault("m=" + role, np.zeros(len(STATES)))
    totals = {kind: sum((v for o, v in counts.items() if o[0] == kind), np.zeros(len(STATES))) for kind in {o[0] for o in counts}}
    emit = {}
    for o, v in counts.items():
        total = totals[o[0]]
        share = (v.sum() + 0.5) / (total.sum() + 1)
        lean = np.array([_marker_share(o[2:], *state) for state in STATES]) if o[0] == "m" else share
        emit[o] = np.log((v + PRIOR * lean) / (total + PRIOR)) - np.log(share)
    # a turn opens with a start: a continuation cannot follow another role's line
    for a, (ra, _) in enumerate(STATES):
        for b, (rb, starts) in enumerate(STATES):
            if not starts and ra != rb:
                step[a, b] = 1e-9
    for b, (_, starts) in enumerate(STATES):
        if not starts:
            start[b] = 1e-9
    return Model(
        np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True)),
        emit, np.zeros(len(STATES)))


def transfer(model: Model, emissions: np.ndarray) -> np.ndarray:
    """Best score of a block from each state before it (last row: the transcript's start) to each last state."""
    now = np.vstack([model.step, model.start]) + emissions[0]
    for e in emissions[1:]:
        now = (now[:, :, None] + model.step[None]).max(1) + e
    return now


def viterbi(model: Model, emissions: np.ndarray, enter: int, leave: int) -> list[int]:
    """States of a block between a given state before it (-1: the start) and a given last state."""
    now = (model.start if enter < 0 else model.step[enter]) + emissions[0]
    back = np.zeros((len(emissions), len(STATES)), int)
    for k in range(1, len(emissions)):
        score = now[:, None] + model.step
        back[k] = score.argmax(0)
        now = score.max(0) + emissions[k]
    path = [int(now.argmax()) if leave < 0 else leave]
    for k in range(len(emissions) - 1, 0, -1):
        path.append(int(back[k, path[-1]]))
    return path[::-1]


def chain(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(state before, last state) of every block of one transcript, in order."""
    now, back = matrices[0][-1], []
    for m in matrices[1:]:
        score = now[:, None] + m[:-1]
        back.append(score.argmax(0))
        now = score.max(0)
    last = [int(now.argmax())]
    for b in reversed(back):
        last.append(int(b[last[-1]]))
    last.reverse()
    return list(zip([-1, *last[:-1]], last))


#: Stands for a null conv_id inside the jobs.
_NO_ID = -(1 << 63)


def blocks_of(lines: DataFrame) -> DataFrame:
    """Distinct lines with their block (b1, b2), in the order of position and text: 256 turns, cut where larger.

    Lines of larger blocks are sorted over all tasks, and every ``BLOCK_ROWS`` of a task make a block.
    """
    rows = lines.select(
        F.coalesce("conv_id", F.lit(_NO_ID)).alias("conv_id"), F.coalesce("pos", F.lit(-1)).cast("long").alias("pos"),
        F.coalesce("line", F.lit("")).alias("line")).distinct()
    rows = rows.withColumn("b1", F.shiftright("pos", SPAN_BITS))
    large = materialize(
        rows.groupBy("conv_id", "b1").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK_ROWS).select("conv_id", "b1"), "large")
    if large.isEmpty():
        return rows.withColumn("b2", F.lit(0).cast("long"))
    cut = rows.join(large.hint("merge"), ["conv_id", "b1"], "left_semi").select("conv_id", "pos", "line", "b1")
    cut = cut.repartitionByRange("conv_id", "pos", "line").sortWithinPartitions("conv_id", "pos", "line")
    # the id goes up along the sorted rows, and each task's begin at a multiple of 2^33
    cut = cut.withColumn("b2", F.expr(f"monotonically_increasing_id() div {BLOCK_ROWS}"))
    rest = rows.join(large.hint("merge"), ["conv_id", "b1"], "left_anti").select("conv_id", "pos", "line", "b1")
    return rest.withColumn("b2", F.lit(0).cast("long")).unionByName(cut)


def _rows(block: pa.Table) -> list[dict]:
    return sorted(block.to_pylist(), key=lambda r: (r["pos"], r["line"]))


def parse(lines: DataFrame, model: Model) -> DataFrame:
    """(conv_id, turn_no, role, text, rendered) of every recovered turn of ``lines(conv_id, pos, line)``."""
    keys = ["conv_id", "b1", "b2"]
    rows = materialize(blocks_of(lines), "lines")

    def edges(key: tuple, block: pa.Table) -> pa.Table:
        m = transfer(model, model.emissions([r["line"] for r in _rows(block)]))
        return pa.table({**dict(zip(keys, ([k.as_py()] for k in key))), "m": pa.array([m.ravel().tolist()], pa.list_(pa.float64()))},
                        schema=pa.schema([(k, pa.int64()) for k in keys] + [("m", pa.list_(pa.float64()))]))

    def chained(key: tuple, blocks: pa.Table) -> pa.Table:
        order = sorted(blocks.to_pylist(), key=lambda r: (r["b1"], r["b2"]))
        found = chain([np.array(r["m"]).reshape(len(STATES) + 1, len(STATES)) for r in order])
        return pa.table({**{k: pa.array([r[k] for r in order], pa.int64()) for k in keys},
                         "enter": pa.array([a for a, _ in found], pa.int64()), "leave": pa.array([b for _, b in found], pa.int64())})

    def decoded(key: tuple, block: pa.Table) -> pa.Table:
        order = _rows(block)
        lines = [r["line"] for r in order]
        path = viterbi(model, model.emissions(lines), order[0]["enter"], order[0]["leave"])
        out: list[dict] = []
        for line, state in zip(lines, path):
            role, starts = STATES[state]
            if starts or not out:
                # only a marker that names the role found is taken off
                named, rest = marker(line)
                body = rest if starts and named == role else line
                out.append({"part": len(out), "role": role, "starts": starts, "text": body})
            else:
                # a marker alone on its line is no part of the text
                out[-1]["text"] = out[-1]["text"] + "\n" + line if out[-1]["text"] else line
        return pa.table({
            **{k: pa.array([key[i].as_py()] * len(out), pa.int64()) for i, k in enumerate(keys)},
            "part": pa.array([o["part"] for o in out], pa.int64()), "role": pa.array([o["role"] for o in out]),
            "starts": pa.array([o["starts"] for o in out]), "text": pa.array([o["text"] for o in out])})

    schema = ", ".join(f"{k} long" for k in keys)
    matrices = rows.groupBy(*keys).applyInArrow(edges, schema + ", m array<double>")
    ends = materialize(matrices.groupBy("conv_id").applyInArrow(chained, schema + ", enter long, leave long"), "edges")
    known = rows.join(ends.hint("merge"), keys)
    parts = materialize(known.groupBy(*keys).applyInArrow(decoded, schema + ", part long, role string, starts boolean, text string"), "parts")
    # a block that opens inside a turn goes on with the turn before
    w = Window.partitionBy("conv_id").orderBy("b1", "b2").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy(*keys).agg(F.sum(F.col("starts").cast("long")).alias("n"), F.min(F.when(F.col("part") == 0, F.col("starts").cast("long"))).alias("opens"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    numbered = parts.join(before.hint("merge"), keys).withColumn("turn_no", F.col("before") + F.col("part") + F.col("opens") - 1)
    turns = numbered.groupBy("conv_id", "turn_no").agg(
        F.max("role").alias("role"), F.sort_array(F.collect_list(F.struct("b1", "b2", "part", "text"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["text"]), "\n")
    return turns.select(F.when(F.col("conv_id") != _NO_ID, F.col("conv_id")).alias("conv_id"), "turn_no", "role", text.alias("text"),
                        F.concat(F.lit("<|"), "role", F.lit("|>\n"), text, F.lit("\n<|end|>")).alias("rendered"))


#: Marker styles of transcripts made from the conversations table: (before, after) the speaker's name.
STYLES = (("", ": "), ("### ", ":\n"), ("[", "] "), ("**", "**: "), ("<", "> "))


def transcripts(conversations: DataFrame) -> DataFrame:
    """Lines of plain-text transcripts with their true role, made from turns.

    A conversation has one marker style and one name per role, by its id; a quarter of the turns, by
    conversation and turn, carry no marker.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.xxhash64("conv_id", F.lit(1)), F.lit(len(names))) + 1).cast("int"))
    name = F.lit(None).cast("string")
    for role, names in SPEAKERS.items():
        name = F.when(F.col("role") == role, F.initcap(pick(names[:3]))).otherwise(name)
    left = F.element_at(F.array(*[F.lit(a) for a, _ in STYLES]), (style + 1).cast("int"))
    right = F.element_at(F.array(*[F.lit(b) for _, b in STYLES]), (style + 1).cast("int"))
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) == 0
    text = F.coalesce("text", F.lit(""))
    shown = F.when(bare | name.isNull(), text).otherwise(F.concat(left, name, right, text))
    return conversations.select("conv_id", "turn", "role", F.posexplode(F.split(shown, "\n")).alias("n", "line")).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        (F.shiftleft(F.coalesce("turn", F.lit(-1)).cast("long"), 20) + F.col("n")).alias("pos"), "line", "role",
        (F.col("n") == 0).alias("is_start"))
