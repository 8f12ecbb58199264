"""Periodic runs of words: maximal stretches that repeat with a smallest period, and the text without the repeats.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are equal) of at
least ``max(MIN_WORDS, 2 q)`` words that no neighbouring word extends with the same period. All runs of
every text are found, whatever their period:

- Periods up to ``SHORT`` by direct scans, one for each lag.
- Longer ones by minimizers on scales ``w`` = 16, 32, 64 ... words, scale ``w`` for periods from 2w to 4w.
  Every window of ``w`` positions has its minimum, the leftmost least hash of four words; minima of a
  scale come from those of the scale below. A run's window and the window a period later are equal, so
  both minima are picked, a period apart and with equal names (a name is a hash of the ``w`` words from
  there). Pairs of equal names between 2w and 4w apart are the seeds; a seed is extended by comparing
  words, so hashes decide where to look and words what is found.
- Equal names that overlap by half lie in a run of a short period and would make pairs by the square.
  They are taken as one cluster with that short run's ends. A run of a longer period through two clusters
  lines up their starts or their ends, or turns where one meets the other; just these seeds are tried.

Of stretches with the same ends the smallest period is the run. Time is about n log n for a text of n
words. Texts are not shuffled; memory is some arrays as long as the words of a slice of texts, or of one
text when that is longer.

Defined results: a null or empty text has no words and no runs; rows that repeat an id are judged each; a
null ``doc_id`` stays null; an empty table gives an empty result. Further columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .words import Words, mix, slices, texts_of

MIN_WORDS = 12
#: Longest period found by direct scans; the least scale is half of it.
SHORT = 32
#: Words of the hash that orders positions.
ORDER = 4
#: Text bytes worked on at once.
SLICE = 2 << 20

RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the stretches of consecutive positions in an ascending list."""
    if not len(same):
        return same, same
    breaks = np.flatnonzero(np.diff(same) != 1)
    return same[np.append(0, breaks + 1)], same[np.append(breaks, len(same) - 1)] + 1


def short_periods(codes: np.ndarray, owner: np.ndarray, longest: int = SHORT, least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, end, period) of stretches with periods up to ``longest``."""
    out = []
    for lag in range(1, min(longest, len(codes) - 1) + 1):
        first, end = stretches(np.flatnonzero((codes[lag:] == codes[:-lag]) & (owner[lag:] == owner[:-lag])))
        long = end - first >= max(lag, least - lag)
        out += [(a, b + lag, lag) for a, b in zip(first[long].tolist(), end[long].tolist())]
    return out


class _Text:
    """Words of one text with ways to extend a repeat."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes

    def ends(self, at: int, lag: int) -> tuple[int, int]:
        """The longest stretch [a, b) around ``at`` whose words equal those ``lag`` later; empty if ``at`` is none."""
        codes, n = self.codes, len(self.codes) - lag
        if not 0 <= at < n or codes[at] != codes[at + lag]:
            return at, at
        b, size = at + 1, 64
        while b < n:
            stop = min(b + size, n)
            differ = np.flatnonzero(codes[b:stop] != codes[b + lag:stop + lag])
            if len(differ):
                b += int(differ[0])
                break
            b, size = stop, 2 * size
        a, size = at, 64
        while a > 0:
            stop = max(a - size, 0)
            differ = np.flatnonzero(codes[stop:a] != codes[stop + lag:a + lag])
            if len(differ):
                a = stop + int(differ[-1]) + 1
                break
            a, size = stop, 2 * size
        return a, b

    def period(self, at: int, size: int, multiple: int) -> int:
        """The smallest period of the ``size`` words from ``at``, given that ``multiple`` is one."""
        part = self.codes[at:at + size]
        for d in range(1, multiple // 2 + 1):
            if multiple % d == 0 and (part[d:] == part[:-d]).all():
                return d
        return multiple


def _clusters(places: list[int], gap: int) -> list[tuple[int, int, int]]:
    """(first, last, least step) of chains of places at most ``gap`` apart."""
    out, first, last, step = [], places[0], places[0], 0
    for p in places[1:]:
        if p - last <= gap:
            step = min(step, p - last) if step else p - last
        else:
            out.append((first, last, step))
            first, step = p, 0
        last = p
    return [*out, (first, last, step)]


def seeds(text: _Text, places: list[int], w: int) -> set[tuple[int, int]]:
    """(period, place) to extend, from the places of one name of ``w`` words."""
    found, chains = set(), _clusters(places, w // 2)
    step = next((s for _, _, s in chains if s), 0)
    if step:
        # the name has this period: clusters are runs of it, known by their ends
        ends = []
        for first, _, _ in chains:
            a, b = text.ends(first, step)
            ends.append((a, b + step))
        step = text.period(places[0], w, step)
    for k, (x, _, _) in enumerate(chains):
        for j in range(k + 1, len(chains)):
            y = chains[j][0]
            if not step:
                if y - x >= 4 * w:
                    break
                if y - x >= 2 * w:
                    found.add((y - x, x))
                continue
            (a0, a1), (b0, b1) = ends[k], ends[j]
            if (a0, a1) == (b0, b1):
                continue
            if b0 - a0 >= 4 * w and b1 - a1 >= 4 * w and b0 - a1 > 0:
                break
            for q in (b0 - a0, b1 - a1):
                if 2 * w <= q < 4 * w:
                    # a place both copies surely share, if the shift is a period at all
                    found.update((q, p) for p in (max(a0, b0 - q), min(a1, b1 - q) - 1))
            if 0 <= a1 - b0 < step:
                most = min(a1 - a0, b1 - b0, 4 * w - 1)
                low = 2 * w + (y - x - 2 * w) % step
                found.update((q, min(a1, b1 - q) - 1) for q in range(low, most + 1, step))
    return found


def long_periods(codes: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of stretches with periods above ``SHORT``, of all texts of a slice."""
    out = []
    w = SHORT // 2
    # texts too short for the least long period end here
    big = np.flatnonzero(np.diff(starts) > 2 * SHORT)
    if not len(big):
        return out
    at = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in big])
    owner = np.repeat(big, np.diff(starts)[big])
    with np.errstate(over="ignore"):
        name = hashes[codes[at]]
        for s in (1, 2):  # names of 2 and 4 words
            name = _doubled(name, s)
        key = mix(name)
        least = np.arange(len(at))
        size = 1
        while size < w:
            if size >= ORDER:
                name = _doubled(name, size)
            least = _least(key, least, size)
            size *= 2
        # from here names and windows are of w words
        while True:
            # windows and names that lie in their text
            end = starts[owner + 1] - at
            # a name starts anywhere in its window, so both need 2 w words
            inside = np.flatnonzero(end >= 2 * w)
            if not len(inside):
                return out
            picked = np.unique(least[inside])
            order = np.lexsort((picked, name[picked], owner[picked]))
            picked = picked[order]
            same = (name[picked[1:]] == name[picked[:-1]]) & (owner[picked[1:]] == owner[picked[:-1]])
            first, last = stretches(np.flatnonzero(same))
            tried: dict[int, set] = {}
            for a, b in zip(first.tolist(), last.tolist()):
                places = picked[a:b + 1]
                base = int(starts[owner[places[0]]])
                text = _Text(codes[base:int(starts[owner[places[0]] + 1])])
                tried.setdefault(int(owner[places[0]]), set()).update(seeds(text, (at[places] - base).tolist(), w))
            for k, pairs in tried.items():
                base, text = int(starts[k]), _Text(codes[starts[k]:starts[k + 1]])
                before = (0, 0, 0)
                for q, p in sorted(pairs):
                    if q == before[0] and p < before[2]:
                        continue  # in the stretch found last
                    a, b = text.ends(p, q)
                    before = (q, a, b)
                    if b - a >= q:
                        out.append((base + a, base + b + q, q))
            # on to the next scale, with the texts that are long enough for it
            name, least = _doubled(name, w), _least(key, least, w)
            w *= 2
            if not (np.diff(starts) >= 4 * w).any():
                return out


def _doubled(name: np.ndarray, size: int) -> np.ndarray:
    """Names of twice ``size`` words; those that reach past the end are of no use."""
    out = name * np.uint64(0x9E3779B97F4A7C15)
    out[:-size] += mix(name[size:]) if size < len(name) else np.uint64(0)
    return mix(out)


def _least(key: np.ndarray, least: np.ndarray, size: int) -> np.ndarray:
    """Places of the leftmost minima of windows of twice ``size`` positions."""
    out = least.copy()
    if size < len(least):
        left, right = least[:-size], least[size:]
        out[:-size] = np.where(key[right] < key[left], right, left)
    return out


def find_runs(codes: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Rows (text, start, end, period), ordered; ``codes`` are the words of all texts, ``hashes`` those of the codes."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    found = np.array(short_periods(codes, owner) + long_periods(codes, starts, hashes), np.int64).reshape(-1, 3)
    # of equal ends the smallest period
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[new]
    text = owner[found[:, 0]] if len(found) else np.zeros(0, np.int64)
    base = starts[text]
    found = np.column_stack([text, found[:, 0] - base, found[:, 1] - base, found[:, 2]])
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def _runs_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE):
        texts = texts_of(batch)
        words = Words(texts)
        runs = find_runs(words.codes, words.starts, words.hashes())
        text, start, end, period = runs.T
        # words after a run's first period go
        change = np.zeros(len(words.codes) + 1, np.int64)
        np.add.at(change, words.starts[text] + start + period, 1)
        np.add.at(change, words.starts[text] + end, -1)
        stay = np.cumsum(change[:-1]) == 0
        kept = words.codes[stay]
        edges = np.concatenate([[0], np.cumsum(np.bincount(words.owners()[stay], minlength=batch.num_rows))])
        words_kept = pa.array(words.vocabulary, pa.string()).take(pa.array(kept))
        collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), words_kept), " ")
        each = pa.StructArray.from_arrays(
            [pa.array(start), pa.array(end - start), pa.array(period)], names=["start", "length", "period"])
        at = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(words.counts), pa.ListArray.from_arrays(at, each), collapsed,
        ], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: all runs, and the words no run repeats joined by one space."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_runs_part, RUNS)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by hash repeats a part of itself up to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g, n = F.floor(F.col("__h") / 10), F.size("__w")
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    turned = F.transform(F.col("__w"), lambda w, i: F.when(i < a, w).otherwise(
        F.element_at("__w", (a + (i - a) % p + 1).cast("int"))))
    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"), h.alias("__h"))
    out = out.withColumn("__w", F.when(F.col("__h") % 10 == 0, words))
    return out.select("doc_id", F.when(n > 0, F.concat_ws(" ", turned)).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Of the runs of each row: how many, the longest, and hashes of all runs and of the text without repeats."""
    longest = F.element_at(F.array_sort("runs", _longest), 1)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = F.when(F.size("runs") > 0, longest)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def _longest(a: Column, b: Column) -> Column:
    """Greatest length, then smallest start, then period."""
    def by(x: Column, y: Column) -> Column:
        return F.signum(x - y).cast("int")

    first, second, third = by(b["length"], a["length"]), by(a["start"], b["start"]), by(a["period"], b["period"])
    return F.when(first != 0, first).when(second != 0, second).otherwise(third)
