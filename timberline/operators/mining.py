"""Template mining: leaf clustering, matching, merging."""

from __future__ import annotations

import math
import re
import sys
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import chain, groupby, islice, takewhile
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.patterns import WILDCARD
from ..functions.text import (
    matches_pieces, template_pieces, template_to_regex, token_jaccard, tokenize_line,
)
from ..session import materialize, passing, release
from .grouping import group_key, prefix_path, vocab_counts
from .positions import dense_position, id_cells

# lines of one leaf handled in order per round: the least in the first round, and the most in any
FIRST_CHUNK = 4096
MAX_CHUNK = 1 << 18
# lines and templates of a leaf that say which of its tokens are frequent
WARM_ROWS = 2048


# ---------------------------------------------------------------- matching (native)

def _similarity(text: Column, tokens: Column, template: Column, pieces: Column) -> Column:
    return F.when(matches_pieces(text, pieces), F.lit(1.0)).otherwise(
        F.coalesce(token_jaccard(template, tokens), F.lit(0.0))
    )


def _prefix(ordered: Column, size: Column, st: float) -> Column:
    """Tokens of which two lists of similarity ``st`` must have one in common, with what must follow it.

    ``ordered`` ends a list of ``size`` distinct tokens in an order common to both; ``room`` is how many
    tokens the other list can have at most if the token is the first they share.
    """
    before = size - F.size(ordered)
    last = size - F.greatest(F.lit(1), F.ceil(size * st - 1e-9)).cast("int")
    room = lambda i: (size - before - i) * ((1 + st) / st) - size + 1e-6
    numbered = F.transform(ordered, lambda t, i: F.struct(t.alias("t"), room(i).alias("room"), size.alias("size")))
    return F.slice(numbered, 1, F.greatest(F.lit(0), last + 1 - before))


def _whole_words(tokens: Column) -> Column:
    """Literals that any text the pattern matches holds as whole words.

    After two wildcards in a row the blank is swallowed, so a literal may be the end of a word.
    """
    return F.filter(
        tokens,
        lambda x, i: (x != WILDCARD)
        & ~((i > 1) & (F.get(tokens, i - 1) == WILDCARD) & (F.get(tokens, i - 2) == WILDCARD)),
    )


def _literals(tokens: Column | str) -> Column:
    return F.filter(tokens, lambda t: t != WILDCARD)


def _loose(templates: DataFrame) -> DataFrame:
    """Templates whose pattern needs no whole word: every literal follows two wildcards, or there is none."""
    return templates.filter((F.size("tokens") > 0) & (F.size(_whole_words(F.col("tokens"))) == 0))


def _loose_pairs(texts: DataFrame, loose: DataFrame) -> DataFrame:
    """Candidate ``(text_id, template_id)`` for loose patterns with a literal, by the ends of words.

    ``texts(home, text_id, tokens)``, ``loose(home, template_id, tokens)``. Such a literal ends a
    word of any text the pattern matches, so texts ask with the endings of their words, of the lengths
    their home has literals of.
    """
    longest = F.array_max(F.transform(_literals("tokens"), lambda t: F.struct(F.length(t).alias("n"), t.alias("end"))))
    ends = loose.select("home", "template_id", longest.alias("l")).filter("l is not null").select(
        "home", "template_id", "l.n", "l.end")
    wanted = ends.select("home", "n").distinct()
    endings = F.transform(F.filter("tokens", lambda t: F.length(t) >= F.col("n")), lambda t: F.right(t, F.col("n")))
    asking = texts.join(wanted, "home").select("home", "text_id", "n", F.explode(F.array_distinct(endings)).alias("end"))
    return asking.join(ends, ["home", "n", "end"]).select("text_id", "template_id")


def _open_templates(loose: DataFrame) -> DataFrame:
    """Templates of wildcards only, which match every text but the empty one's neighbours by similarity."""
    return loose.filter(F.size(_literals("tokens")) == 0)


@dataclass
class TemplateIndex:
    """Templates with the tokens they wait under, written once for any number of matches."""

    templates: DataFrame
    often: DataFrame
    waiting: DataFrame
    anchored: DataFrame
    loose: DataFrame


def index_templates(templates: DataFrame, st: float = 0.5, leaf: Sequence[str] = ("group_key", "path")) -> TemplateIndex:
    """The index ``match_templates`` looks lines up in; a stream builds it once, not for each batch."""
    known = _known(templates, leaf)
    return TemplateIndex(known, *_waiting(known, st))


def _known(templates: DataFrame, leaf: Sequence[str]) -> DataFrame:
    # written first: tokens that are still to be computed would be computed again for each use
    return materialize(templates.select(
        "template_id", "created_seq", F.struct(*leaf).alias("_home"),
        F.xxhash64(*leaf).alias("leaf"), "tokens",
    ), "known_templates")


def _by_rank() -> Column:
    """Tokens by the number ``n`` of templates that hold them, the wildcard last."""
    rank = F.when(F.col("t") == WILDCARD, F.lit(1 << 60)).otherwise(F.col("n"))
    return F.sort_array(F.collect_list(F.struct(rank.alias("r"), "t")))["t"]


def _waiting(
    templates: DataFrame, st: float, lines: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Templates per token, what a template waits under for similar lines and for lines its pattern fits, loose templates.

    With ``lines`` given, tokens that no line of the leaf holds are left out: they cannot be shared, so a
    template is as if they came first in its order, and a pattern that needs one of them fits no line.
    """
    sized = templates.select("leaf", "template_id", F.array_distinct("tokens").alias("own"))
    held = sized.select("leaf", "template_id", F.size("own").alias("size"), F.explode("own").alias("t"))
    often = held.groupBy("leaf", "t").agg(F.count(F.lit(1)).alias("n"))
    if lines is not None:
        often = often.join(lines.select("leaf", F.explode("tokens").alias("t")).distinct(), ["leaf", "t"], "left_semi")
    often = materialize(often, "often")
    # written between the two shuffles, so that they need not lie on disk together
    counted = materialize(held.join(often, ["leaf", "t"]), "counted")
    ordered = materialize(counted.groupBy("leaf", "template_id", "size").agg(_by_rank().alias("ordered")), "ordered")
    release(counted, always=True)
    waiting = materialize(
        ordered.select("leaf", "template_id", F.inline(_prefix(F.col("ordered"), F.col("size"), st))), "waiting")
    needed = F.array_distinct(_whole_words(F.col("tokens")))
    patterns = templates.filter(F.array_contains("tokens", WILDCARD)).select("template_id", needed.alias("needed"))
    met = ordered.join(patterns, "template_id").withColumn("words", F.array_intersect("ordered", "needed"))
    anchored = materialize(
        met.filter((F.size("words") > 0) & (F.size("words") == F.size("needed")))
        .select("leaf", "template_id", F.get("words", F.lit(0)).alias("t")), "anchored")
    release(ordered, always=lines is None)
    return often, waiting, anchored, materialize(_loose(templates), "loose")


def _candidate_pairs(
    lines: DataFrame, templates: DataFrame, st: float,
    index: tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Distinct ``(line_id, template_id)`` that can be similar; ``leaf`` is a hash of the leaf.

    Tokens have an order in each leaf, by the number of its templates that hold them, so a token all of
    them share comes last and one that none holds first. Two lists of similarity ``st`` share one of their
    first tokens, and enough must follow it; a template waits and a line asks under these only. A pattern
    also waits under the rarest word it needs, for which a line asks with all its tokens, and if it needs
    none, under the end of a word. Of the templates of wildcards only, which match every line alike, a
    leaf's latest meets its lines.
    """
    return _asked_pairs(lines, templates, st, index or _waiting(templates, st, lines))[0]


def _asked_pairs(
    lines: DataFrame, templates: DataFrame, st: float, index: tuple[DataFrame, DataFrame, DataFrame, DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """``_candidate_pairs`` of an index, and the written table they read besides."""
    often, waiting, anchored, loose = index
    sized = lines.select("leaf", "line_id", F.array_distinct("tokens").alias("own"))
    asking = materialize(
        sized.select("leaf", "line_id", F.size("own").alias("own"), F.explode("own").alias("t"))
        .join(often, ["leaf", "t"]).groupBy("leaf", "line_id", "own").agg(_by_rank().alias("ordered")),
        "asking",
    )
    near = (
        asking.select("leaf", "line_id", F.inline(_prefix(F.col("ordered"), F.col("own"), st)))
        .withColumnsRenamed({"size": "own", "room": "own_room"})
        .join(waiting, ["leaf", "t"]).filter("own <= room and size <= own_room").select("line_id", "template_id")
    )
    fitting = asking.select("leaf", "line_id", F.explode("ordered").alias("t")).join(anchored, ["leaf", "t"])
    # empty templates and empty lines
    empty = lines.filter(F.size("tokens") == 0).select("leaf", "line_id").join(
        templates.filter(F.size("tokens") == 0).select("leaf", "template_id"), "leaf")
    pairs = near.union(fitting.select("line_id", "template_id")).union(empty.select("line_id", "template_id"))
    if not loose.isEmpty():
        texts = lines.select(F.col("leaf").alias("home"), F.col("line_id").alias("text_id"), "tokens")
        latest = _open_templates(loose).groupBy("leaf").agg(
            F.max_by("template_id", F.struct("created_seq", "template_id")).alias("template_id"))
        pairs = pairs.union(_loose_pairs(texts, loose.withColumnRenamed("leaf", "home"))).union(
            lines.select("leaf", "line_id").join(latest, "leaf").select("line_id", "template_id"))
    return pairs.distinct(), asking


def match_templates(
    lines: DataFrame,
    templates: DataFrame | TemplateIndex,
    st: float = 0.5,
    line_id: str = "line_id",
    tokens: str = "tokens",
    leaf: Sequence[str] = ("group_key", "path"),
) -> DataFrame:
    """``(line_id, sim, template_id)``: the most similar template of the line's leaf, from ``st`` up.

    Similarity is 1 if the template's pattern matches the joined tokens, else the share of
    common tokens; ties go to the later template.  Lines and templates meet on words they must
    share to be that similar, so a wide leaf does not compare everything with everything.  An index of
    the templates (``index_templates``, with the same ``st`` and ``leaf``) serves any number of matches.
    """
    if st <= 0:
        raise ValueError("st must be positive")
    ours = materialize(lines.select(
        F.col(line_id).alias("line_id"), F.struct(*leaf).alias("_home"),
        F.xxhash64(*leaf).alias("leaf"), F.col(tokens).alias("tokens"),
    ), "asking_lines")
    if isinstance(templates, TemplateIndex):
        known, own = templates.templates, ()
        index = templates.often, templates.waiting, templates.anchored, templates.loose
    else:
        # a template meets lines of its own leaf only, so the others need no index
        asked = ours.select(F.col("leaf").alias("_asked")).distinct()
        known = _known(templates.join(asked, F.xxhash64(*leaf) == F.col("_asked"), "left_semi"), leaf)
        own = index = _waiting(known, st, ours)
    pairs, asking = _asked_pairs(ours, known, st, index)
    pairs = materialize(pairs, "pairs")
    release(asking, *own)
    sim = _similarity(F.array_join("tokens", " "), F.col("tokens"), F.col("_t"), F.col("_pieces"))
    return (
        pairs.join(ours.drop("leaf"), "line_id")
        .join(known.select("template_id", "created_seq", F.col("_home").alias("_other"), F.col("tokens").alias("_t")), "template_id")
        .filter(F.col("_home") == F.col("_other"))
        # made of what meets only, so that pieces are not shuffled
        .withColumn("_pieces", template_pieces("_t"))
        .select("line_id", F.struct(sim.alias("sim"), "created_seq", "template_id").alias("_best"))
        .groupBy("line_id").agg(F.max("_best").alias("_best"))
        .select(
            F.col("line_id").alias(line_id), F.col("_best.sim").alias("sim"),
            F.col("_best.template_id").alias("template_id"),
        )
        .filter(F.col("sim") >= st)
    )


# ---------------------------------------------------------------- leaf clustering

def _pieces(text: str) -> list[str]:
    return re.sub(r"(?:<\*>\s?){2,}", WILDCARD, text).split(WILDCARD)


def _fits(text: str, pieces: list[str]) -> bool:
    """``matches_pieces`` for one text."""
    if len(pieces) == 1:
        return text == pieces[0]
    first, last = pieces[0], pieces[-1]
    end = len(text) - len(last)
    if end < len(first) or not text.startswith(first) or not text.endswith(last):
        return False
    at = len(first)
    for piece in pieces[1:-1]:
        at = text.find(piece, at, end)
        if at < 0:
            return False
        at += len(piece)
    return True


class _Leaf:
    """Templates of one leaf while its lines pass by in order.

    Three indexes keep a line from meeting every template of a wide leaf: literal templates by their
    text, patterns by the rarest words they need, and templates by their rarest tokens.  Two lists of
    similarity ``st`` share at least that part of the larger, so in any fixed order of tokens their first
    ones, all but that many and one more, have one in common, and with each further one another.  Here
    the token met last comes first, then those of ``common`` from the rarest on, and the wildcard is last.
    A template waits for three hits, or fewer if its further tokens are in too many others.

    Tokens are interned and a template is one tuple of them, so a leaf takes about as much as its texts.
    What a template no longer holds stays in the index: it only makes candidates, which are all compared.
    """

    def __init__(self, st: float, common: Sequence[str] = ()):
        self.st = st
        self.ids: list[int] = []
        self.tokens: list[tuple[str, ...]] = []
        self.sizes = array("i")
        # as many common tokens make the template a candidate
        self.wants = array("b")
        self.needs: list[tuple[str, ...]] = []
        self.by_text: dict[str, set[int]] = {}
        self.by_anchor: dict[str | None, set[int]] = {}
        self.by_token: dict[str, array] = {}
        # a token's place in the order, the highest first; of ``common`` the first is the rarest
        self.met: dict[str, int] = {t: -1 - i for i, t in enumerate(common)} | {WILDCARD: -1 << 60}
        self.held: dict[str, int] = {}
        self.seen: dict[str, int] = {}
        self.changes = 0

    def put(self, template_id: int, tokens: Sequence[str]) -> int:
        slot = len(self.ids)
        self.ids.append(template_id)
        self.tokens.append(())
        self.sizes.append(0)
        self.wants.append(1)
        self.needs.append(())
        self._set(slot, tuple(map(sys.intern, tokens)))
        return slot

    def _first(self, words: frozenset) -> tuple[list[str], list[str]]:
        """Tokens of which a list of similarity ``st`` must have one among its own, and the next two."""
        need = max(1, math.ceil(self.st * len(words) - 1e-9))
        unmet = len(self.met)
        ordered = sorted(words, key=lambda t: self.met.get(t, unmet), reverse=True)
        at = len(words) - need + 1
        return ordered[:at], ordered[at:at + 2]

    def _set(self, slot: int, tokens: tuple[str, ...]) -> None:
        kept = self.tokens[slot]
        old, new = frozenset(kept), frozenset(tokens)
        for t in tokens:
            self.met.setdefault(t, len(self.met))
        for t in old - new:
            self.held[t] -= 1
        for t in new - old:
            self.held[t] = self.held.get(t, 0) + 1
        first, further = self._first(new)
        often = max(2, len(self.ids) / 4)
        further = list(takewhile(lambda t: self.held[t] <= often, further))
        self.wants[slot] = 1 + len(further)
        posted = frozenset(self._first(old)[0])
        for t in first + further:
            if t not in posted:
                self.by_token.setdefault(t, array("i")).append(slot)
        if WILDCARD not in old:
            self.by_text.get(" ".join(kept), set()).discard(slot)
        elif slot in (waiting := self.by_anchor[next(iter(self.needs[slot]), None)]):
            waiting.discard(slot)
        self.tokens[slot], self.sizes[slot], self.needs[slot] = tokens, len(new), ()
        if WILDCARD not in new:
            self.by_text.setdefault(" ".join(tokens), set()).add(slot)
        else:
            # after two wildcards in a row a literal may be the end of a word only
            whole = {
                t for i, t in enumerate(tokens)
                if t != WILDCARD and not (i > 1 and tokens[i - 1] == WILDCARD == tokens[i - 2])
            }
            self.needs[slot] = tuple(sorted(whole, key=self.held.__getitem__)[:4])
            self.by_anchor.setdefault(next(iter(self.needs[slot]), None), set()).add(slot)
        # the answer for a text seen before may be another one now
        self.seen.clear()
        self.changes += 1

    def _near(self, words: frozenset) -> set[int]:
        """Templates that can be similar by common tokens."""
        first, further = self._first(words)
        hits = array("i")
        for t in first + further:
            hits.extend(self.by_token.get(t, ()))
        if not hits:
            return set()
        slots = np.frombuffer(hits, np.int32)
        sizes = np.frombuffer(self.sizes, np.int32)[slots]
        slots = np.sort(slots[(sizes >= self.st * len(words) - 1e-6) & (sizes * self.st <= len(words) + 1e-6)])
        wants = np.frombuffer(self.wants, np.int8)[slots]
        found: set[int] = set()
        for n in (1, 2, 3):
            again = slots[n - 1:] == slots[:len(slots) - n + 1]
            found.update(slots[n - 1:][again & (wants[n - 1:] <= n)].tolist())
        return found

    def _nearest(self, text: str, words: frozenset) -> int | None:
        best = (-1.0, -1)
        for slot in self.by_text.get(text, ()):
            best = max(best, (1.0, slot))
        for anchor in (None, *words):
            for slot in self.by_anchor.get(anchor, ()):
                if slot > best[1] and words.issuperset(self.needs[slot]) and _fits(text, _pieces(" ".join(self.tokens[slot]))):
                    best = (1.0, slot)
        for slot in self._near(words) if self.st > 0 else range(len(self.ids)):
            common = len(words.intersection(self.tokens[slot]))
            union = self.sizes[slot] + len(words) - common
            if union:
                best = max(best, (common / union, slot))
        return best[1] if best[0] >= self.st else None

    def add(self, line_id: int, text: str) -> int:
        slot = self.seen.get(text)
        if slot is not None:
            return slot
        tokens = text.split(" ") if text else []
        words = frozenset(tokens)
        slot = self._nearest(text, words)
        if slot is None:
            return self.put(line_id, tokens)
        old = self.tokens[slot]
        shared = words.intersection(old)
        base = tokens if len(tokens) > len(old) else old
        merged = tuple(sys.intern(t) if t in shared else WILDCARD for t in base) if old else tuple(map(sys.intern, tokens))
        if merged != old:
            self._set(slot, merged)
        else:
            self.seen[text] = slot
        return slot


_STEP_SCHEMA = "kind int, leaf string, line_id long, template_id long, template string"


def _cluster_in_order(st: float, least: int, calm: int):
    """Lines sorted by (leaf, kind, order) in; assignments (1), closing templates (0) and lines done (2) out.

    A leaf's lines are taken from the first on, at least ``least`` and until ``calm`` in a row have changed
    nothing; where lines go on changing it, that is all of them.
    """

    def clustered(rows: Iterator[tuple]) -> Iterator[tuple]:
        for name, own in groupby(rows, itemgetter(0)):
            head = list(islice(own, WARM_ROWS))
            counts = Counter(t for *_, text in head for t in set(text.split(" "))) if len(head) > 1 else {}
            leaf = _Leaf(st, sorted((t for t, n in counts.items() if n > 1 and t != WILDCARD), key=lambda t: (counts[t], t)))
            done = quiet = 0
            for _, kind, order, text in chain(head, own):
                if kind == 0:
                    leaf.put(order, text.split(" ") if text else [])
                    continue
                if done >= least and quiet >= calm:
                    break
                before = leaf.changes
                slot = leaf.add(order, text)
                done, quiet = done + 1, quiet + 1 if leaf.changes == before else 0
                yield 1, name, order, leaf.ids[slot], " ".join(leaf.tokens[slot])
            for i, t in zip(leaf.ids, leaf.tokens):
                yield 0, name, None, i, " ".join(t)
            yield 2, name, done, None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = clustered(row for b in batches for row in zip(b["leaf"], b["kind"], b["ord"], b["text"]))
        while part := list(islice(out, 4096)):
            frame = pd.DataFrame(part, columns=["kind", "leaf", "line_id", "template_id", "template"])
            yield frame.astype({"line_id": "Int64", "template_id": "Int64"})

    return run


def _split_text(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def cluster_leaves(
    lines: DataFrame,
    st: float = 0.5,
    depth: int = 4,
    first_chunk: int = FIRST_CHUNK,
    max_chunk: int = MAX_CHUNK,
    base_templates: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Cluster the lines of each leaf in order.

    ``lines(line_id, group_key, path, tokens)``; the leaves start with ``base_templates``, whose
    ids are below all line ids.  Returns assignments ``(line_id, template_id,
    snapshot)``, the snapshot being the template after the line joined it, and templates
    ``(template_id, group_key, path, tokens, created_seq)``.  A template's id is the id of the
    line that opened it.

    A line goes to the most similar template of its leaf if the similarity reaches ``st``, and
    generalises it at once; else it opens a new one.  That order matters only where a line
    changes a template.  Hence:

    1. new leaves with one distinct sequence need no work;
    2. of the others, a bounded chunk of lines is taken in order, until a stretch of them changes nothing;
    3. a window of the lines behind it is tested in parallel against the templates reached, and those
       before the first line that would change anything are final;
    4. the leaf goes on from there, or from the window's end, with the next, larger chunk. The window
       widens fourfold as long as it changes nothing, so a settled leaf needs few rounds, and a leaf whose
       lines go on changing it is not tested to its end in every round.

    The result is the one of a single ordered pass, and no task holds a whole hot leaf.
    """
    spark = lines.sparkSession
    text = F.array_join(F.concat("path", F.slice("tokens", depth + 1, 1 << 30)), " ")
    # the path has no line break, so the last one separates the two parts
    leaf = F.concat_ws("\n", "group_key", F.array_join("path", " "))
    schema = "leaf string, template_id long, template string"
    state = spark.createDataFrame([], schema)
    rows = materialize(lines.select("line_id", leaf.alias("leaf"), text.alias("text")), "leaf_lines")
    texts = rows.groupBy("leaf", "text").agg(
        F.min("line_id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    leaves = materialize(
        texts.groupBy("leaf").agg(
            F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"), F.min("first").alias("first")
        ),
        "leaves",
    )
    if base_templates is not None:
        state = base_templates.select(
            leaf.alias("leaf"), "template_id", F.array_join("tokens", " ").alias("template")
        )
        untouched = state.join(leaves.select("leaf"), "leaf", "left_anti")
        state = materialize(state.join(leaves.select("leaf"), "leaf", "left_semi"), "state")
        started = state.select("leaf").distinct()
        leaves = leaves.join(started.withColumn("old", F.lit(True)), "leaf", "left")
    else:
        leaves = leaves.withColumn("old", F.lit(None).cast("boolean"))
    trivial = (F.col("texts") == 1) & F.col("old").isNull()
    plain = leaves.filter(trivial).select("leaf", F.col("first").alias("template_id"))
    assigned = [
        rows.join(plain, "leaf").select("line_id", "template_id", F.col("text").alias("snapshot"))
    ]
    templates = [
        rows.join(plain, (rows["leaf"] == plain["leaf"]) & (rows["line_id"] == plain["template_id"]))
        .select(rows["leaf"], "template_id", F.col("text").alias("template"))
    ]

    if base_templates is not None:
        templates.append(untouched)
    busy = leaves.filter(~trivial).select("leaf", "n")
    coarse, fine = id_cells("line_id")
    mixed = materialize(
        dense_position(rows.join(busy.select("leaf"), "leaf"), coarse, fine, ["line_id"], ["leaf"], "pos"),
        "mixed_lines",
    )
    frontier = busy.withColumns({"start": F.lit(1).cast("long"), "look": F.lit(first_chunk).cast("long")})
    chunk = first_chunk
    # few bytes but much work: not to be put together into fewer tasks
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    while not frontier.isEmpty():
        ahead = mixed.join(frontier, "leaf")
        in_chunk = F.col("pos") < F.col("start") + max_chunk
        feed = ahead.filter((F.col("pos") >= F.col("start")) & in_chunk).select(
            "leaf", F.lit(1).alias("kind"), F.col("line_id").alias("ord"), "text"
        ).unionByName(
            state.select(
                "leaf", F.lit(0).alias("kind"), F.col("template_id").alias("ord"),
                F.col("template").alias("text"),
            )
        )
        stepped = materialize(
            feed.repartition(tasks, "leaf").sortWithinPartitions("leaf", "kind", "ord")
            .mapInPandas(_cluster_in_order(st, chunk, first_chunk), _STEP_SCHEMA),
            "clustered",
        )
        assigned.append(
            stepped.filter("kind = 1").select("line_id", "template_id", F.col("template").alias("snapshot"))
        )
        reached = stepped.filter("kind = 0").select("leaf", "template_id", "template")
        done = stepped.filter("kind = 2").select("leaf", F.col("line_id").alias("done"))
        open_leaves = frontier.join(done, "leaf").withColumn("start", F.col("start") + F.col("done")).drop("done").filter("start <= n")
        if open_leaves.isEmpty():
            templates.append(reached)
            break
        rest = mixed.join(open_leaves, "leaf").filter(
            (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("look")))
        with passing(spark):
            tested = materialize(
                _test_rest(rest, reached.join(open_leaves.select("leaf"), "leaf", "left_semi"), st),
                "tested", stay=True,
            )
        cuts = tested.filter("changes").groupBy("leaf").agg(F.min("first_pos").alias("cut"))
        beyond = F.col("start") + F.col("look")
        cuts = materialize(
            open_leaves.join(cuts, "leaf", "left").select(
                "leaf", "n", F.coalesce("cut", beyond).alias("start"),
                F.when(F.col("cut").isNull(), F.col("look") * 4).otherwise(F.lit(first_chunk)).cast("long").alias("look"),
            ).filter(F.col("start") <= F.col("n")),
            "cuts",
        )
        final = (
            rest.drop("n", "start", "look").join(tested.select("leaf", "text", "template_id", "template"), ["leaf", "text"])
            .join(cuts.select("leaf", F.col("start").alias("cut")), "leaf", "left")
            .filter(F.col("cut").isNull() | (F.col("pos") < F.col("cut")))
        )
        assigned.append(final.select("line_id", "template_id", F.col("template").alias("snapshot")))
        templates.append(reached.join(cuts.select("leaf"), "leaf", "left_anti"))
        state = reached.join(cuts.select("leaf"), "leaf", "left_semi")
        frontier = cuts
        chunk = min(chunk * 4, max_chunk)

    def union(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts)

    split_at = F.length("leaf") - F.length(F.substring_index("leaf", "\n", -1))
    found = union(templates).select(
        "template_id",
        F.substring("leaf", F.lit(1), split_at - 1).alias("group_key"),
        _split_text(F.substring_index("leaf", "\n", -1)).alias("path"),
        _split_text("template").alias("tokens"),
        F.col("template_id").alias("created_seq"),
    )
    members = union(assigned).select("line_id", "template_id", _split_text("snapshot").alias("snapshot"))
    return members, found


def _test_rest(rest: DataFrame, reached: DataFrame, st: float) -> DataFrame:
    """Per distinct sequence of the window: its template and whether it would change the leaf."""
    distinct = materialize(
        rest.groupBy("leaf", "text").agg(
            F.min("pos").alias("first_pos"), F.min("line_id").alias("line_id")
        ).withColumn("tokens", _split_text("text")),
        "rest",
    )
    known = reached.withColumn("tokens", _split_text("template")).withColumn(
        "created_seq", F.col("template_id")
    )
    best = match_templates(distinct, known, st, leaf=["leaf"]).select("line_id", "template_id")
    own, kept = F.col("tokens"), _split_text("template")
    same = (F.size(own) <= F.size(kept)) & F.forall(
        kept, lambda t: (t == WILDCARD) | F.array_contains(own, t)
    )
    return (
        distinct.join(best, "line_id", "left")
        .join(reached.select("template_id", "template"), "template_id", "left")
        .select(
            "leaf", "text", "first_pos", "template_id", "template",
            (F.col("template_id").isNull() | ~same).alias("changes"),
        )
    )


# ---------------------------------------------------------------- mining

@dataclass
class MinedTemplates:
    """Assignments ``(line_id, template_id, snapshot, label)``, templates, vocabulary, branches."""

    assignments: DataFrame
    templates: DataFrame
    vocab: DataFrame
    branches: DataFrame


def mine_templates(
    lines: DataFrame,
    patterns: Sequence[str] = (),
    heads: Sequence[str] = (),
    k: int = 3,
    depth: int = 4,
    max_child: int = 2,
    st: float = 0.5,
    vocab: str = "online",
    content: str = "content",
    line_id: str = "line_id",
    label: str = "label",
    first_chunk: int = FIRST_CHUNK,
    base: MinedTemplates | None = None,
) -> MinedTemplates:
    """Mine templates from lines in ``line_id`` order.

    With ``base`` the lines follow those mined before: vocabulary, branches and templates go on
    from there.  Their ids must then be above all earlier ones.
    """
    with passing(lines.sparkSession):
        return _mined(lines, patterns, heads, k, depth, max_child, st, vocab, content, line_id, label, first_chunk, base)


def _mined(
    lines: DataFrame, patterns: Sequence[str], heads: Sequence[str], k: int, depth: int, max_child: int, st: float, vocab: str,
    content: str, line_id: str, label: str, first_chunk: int, base: MinedTemplates | None,
) -> MinedTemplates:
    """``mine_templates``; only the tables of the result stay."""
    spark = lines.sparkSession
    with passing(spark):
        rows = materialize(
            lines.select(
                F.col(line_id).cast("long").alias("line_id"),
                F.col(label).alias("label"),
                *[h for h in heads if h in lines.columns],
                tokenize_line(content, patterns).alias("tokens"),
            ),
            "tokens",
        )
        keyed = materialize(
            group_key(rows, k, heads, vocab, base_vocab=base.vocab if base else None)
            .select("line_id", "label", "tokens", "group_key"),
            "keyed", stay=True,
        )
    pathed, branches = prefix_path(
        keyed, depth, max_child, base_branches=base.branches if base else None
    )
    members, found = cluster_leaves(
        pathed, st, depth, first_chunk, base_templates=base.templates if base else None
    )
    members = materialize(members.join(keyed.select("line_id", "label"), "line_id"), "members", stay=True)
    sizes = members.groupBy("template_id").agg(
        F.count(F.lit(1)).alias("size"), F.max_by("label", "line_id").alias("label"),
        F.max("line_id").alias("_seq"),
    )
    words = vocab_counts(keyed)
    if base:
        earlier = base.templates.select("template_id", "size", "label", F.lit(-1).cast("long").alias("_seq"))
        sizes = sizes.unionByName(earlier).groupBy("template_id").agg(
            F.sum("size").alias("size"), F.max_by("label", "_seq").alias("label")
        )
        words = words.unionByName(base.vocab).groupBy("token").agg(F.sum("n").alias("n"))
    templates = materialize(found.join(sizes, "template_id"), "templates", stay=True)
    return MinedTemplates(
        members,
        # text and pattern follow from the tokens, so they are made where they are read
        templates.select(
            "template_id", "group_key", "path", "tokens",
            F.array_join("tokens", " ").alias("template"),
            template_to_regex("tokens").alias("regex"),
            "size", "label", "created_seq",
        ),
        materialize(words, "vocab", stay=True),
        materialize(branches, "branches", stay=True),
    )


def cluster_sizes(assignments: DataFrame, id_col: str = "template_id") -> DataFrame:
    """Lines per template."""
    return assignments.groupBy(id_col).agg(F.count(F.lit(1)).alias("size"))


def cluster_label(
    assignments: DataFrame, id_col: str = "template_id", label: str = "label", seq: str = "line_id"
) -> DataFrame:
    """Label of the last line that hit each template."""
    return assignments.groupBy(id_col).agg(F.max_by(label, seq).alias("label"))


def generalize_template(
    members: DataFrame, id_col: str = "template_id", tokens: str = "tokens", seq: str = "line_id"
) -> DataFrame:
    """Template of whole clusters from their member sequences.

    Folding the sequences in order keeps the first longest list and, of it, the tokens that all
    members share.  Both are plain aggregates, so no cluster is gathered in one place.
    """
    shared = (
        members.select(id_col, F.explode(F.array_distinct(tokens)).alias("token"))
        .groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("hits"))
    )
    base = members.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(tokens, F.struct(-F.size(tokens), F.col(seq))).alias("base"),
    )
    spread = base.select(id_col, "n", F.posexplode_outer("base").alias("i", "token"))
    kept = F.when(F.col("hits") == F.col("n"), F.col("token")).otherwise(F.lit(WILDCARD))
    return (
        spread.join(shared, [id_col, "token"], "left")
        .groupBy(id_col)
        # bounded by the length of one line
        .agg(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", kept.alias("t"))))).alias("p"))
        .select(id_col, F.transform("p", lambda x: x["t"]).alias("tokens"))
    )


def attach_templates(
    lines: DataFrame, assignments: DataFrame, templates: DataFrame, line_id: str = "line_id"
) -> DataFrame:
    """Label every line with the final template of its cluster; null when it has none."""
    names = templates.select("template_id", "template")
    links = assignments.select(line_id, "template_id").join(names, "template_id")
    return (
        lines.drop("event_template")
        .join(links.select(line_id, F.col("template").alias("event_template")), line_id, "left")
    )


# ---------------------------------------------------------------- merging

def _fitting_pairs(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Candidate ``(text_id, template_id)``: patterns of a text's group that are before it and may match it.

    A pattern waits under its rarest whole word, and under its first token if that is a literal; a text asks
    for each of its words, with its own first token and without one. Group, first token and word are one
    hash, since what meets is compared anyway, and a hash with the number of its patterns is one integer.
    """
    spark = texts.sparkSession
    bits = 44
    key = lambda head, word: F.xxhash64("home", head, word).bitwiseAND(F.lit((1 << bits) - 1))
    first = F.coalesce(F.get("tokens", F.lit(0)), F.lit(""))
    with passing(spark):
        words = F.when(F.size("tokens") == 0, F.array(F.lit(""))).otherwise(F.array_distinct(_whole_words(F.col("tokens"))))
        held = (
            patterns.select("home", "template_id", "place", F.when(first == WILDCARD, F.lit("")).otherwise(first).alias("head"), F.explode(words).alias("word"))
            .select("template_id", "place", (F.col("head") == "").alias("headless"), key("head", "word").alias("key"))
        )
        often = held.groupBy("key").agg(F.least(F.count(F.lit(1)), F.lit((1 << 19) - 1)).alias("n"))
        rarest = F.min(F.shiftleft("n", bits).bitwiseOR(F.col("key"))).bitwiseAND(F.lit((1 << bits) - 1))
        keyed = materialize(
            held.join(often, "key").groupBy("template_id", "place", "headless").agg(rarest.alias("key")), "keyed")
        heads = F.array(F.when(first == WILDCARD, F.lit("")).otherwise(first))
        if not keyed.filter("headless").isEmpty():
            heads = F.array_distinct(F.concat(heads, F.array(F.lit(""))))
        words = F.when(F.size("tokens") == 0, F.array(F.lit(""))).otherwise(F.array_distinct(_literals("tokens")))
        asks = (
            texts.select("home", F.col("template_id").alias("text_id"), F.col("place").alias("own"), heads.alias("heads"), F.explode(words).alias("word"))
            .select("home", "text_id", "own", F.explode("heads").alias("head"), "word")
            .select("text_id", "own", key("head", "word").alias("key"))
        )
        before = (F.col("place") < F.col("own")) | ((F.col("place") == F.col("own")) & (F.col("template_id") < F.col("text_id")))
        pairs = asks.join(keyed, "key").filter(before).select("text_id", "template_id")
        loose = materialize(_loose(patterns), "loose")
        if not loose.isEmpty():
            named = texts.select("home", F.col("template_id").alias("text_id"), "tokens", F.col("place").alias("own"))
            by_end = _loose_pairs(named, loose).join(loose.select("template_id", "place"), "template_id").join(
                named.select("text_id", "own"), "text_id").filter(before)
            # of the patterns of wildcards only the first of a group stands for all
            open_first = _open_templates(loose).groupBy("home").agg(F.min(F.struct("place", "template_id")).alias("_o"))
            by_home = named.join(open_first.select("home", "_o.place", "_o.template_id"), "home").filter(before)
            pairs = pairs.union(by_end.select("text_id", "template_id")).union(by_home.select("text_id", "template_id"))
        return materialize(pairs, "pairs", stay=True)


def _first_matches(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(text_id, first)``: the earliest pattern of a text's group, by place, that is before it and matches it.

    Both are ``(template_id, home, tokens, place)``. Partial minima are taken before the shuffle.
    """
    return (
        _fitting_pairs(texts, patterns)
        .join(texts.select(F.col("template_id").alias("text_id"), F.col("home").alias("_home"), F.array_join("tokens", " ").alias("text")), "text_id")
        .join(patterns.select("template_id", "home", "place", "tokens"), "template_id")
        .filter(F.col("home") == F.col("_home")).withColumn("pieces", template_pieces("tokens"))
        .filter(matches_pieces("text", F.col("pieces")))
        .groupBy("text_id").agg(F.min(F.struct("place", "template_id")).alias("first"))
    )


def subsume_templates(templates: DataFrame) -> DataFrame:
    """``(template_id, claimant_id)``: which template absorbs which inside its group.

    In the order of most wildcards, then longest, then id, each template not yet claimed claims every
    unclaimed one its pattern matches. So a template that no earlier one matches is a claimant, and one
    whose earliest match is a claimant belongs to it. Patterns mostly match what their matches match, and
    then every template is settled in one look-up. The rest, whose earliest match is itself claimed, look
    again among the templates that are not, until none is left; the first of them in order always is
    settled.
    """
    spark = templates.sparkSession
    wild = F.size(F.filter("tokens", lambda t: t == WILDCARD))
    # most wildcards, then longest, as one integer; ids break ties
    place = -(wild.cast("long") * (1 << 32)) - F.size("tokens")
    with passing(spark):
        base = materialize(templates.select("template_id", F.col("group_key").alias("home"), "tokens", place.alias("place")), "ranked")
        left, heads, parts = base, None, []
        while True:
            patterns = left if heads is None else left.unionByName(base.join(heads, "template_id", "left_semi"))
            with passing(spark):
                first = _first_matches(left, patterns).select(
                    F.col("text_id").alias("template_id"), F.col("first.template_id").alias("claimant_id"))
                looked = materialize(left.select("template_id").join(first, "template_id", "left"), "looked", stay=True)
            found = looked.filter("claimant_id is null").select("template_id")
            heads = found if heads is None else heads.union(found)
            owned = looked.join(heads.withColumnRenamed("template_id", "claimant_id"), "claimant_id", "left_semi")
            parts += [found.withColumn("claimant_id", F.col("template_id")), owned.select("template_id", "claimant_id")]
            ids = materialize(
                looked.filter("claimant_id is not null").join(owned.select("template_id"), "template_id", "left_anti").select("template_id"), "left")
            if ids.isEmpty():
                return materialize(reduce(DataFrame.unionByName, parts), "claims", stay=True)
            left = base.join(ids, "template_id", "left_semi")


def merge_templates(
    templates: DataFrame, claims: DataFrame
) -> DataFrame:
    """One row per claimant with the members' lines and ids merged into it."""
    sized = claims.join(templates.select("template_id", "size"), "template_id")
    merged = sized.groupBy(F.col("claimant_id").alias("template_id")).agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n_merged")
    )
    return templates.drop("size").join(merged, "template_id")


def reinsert_templates(
    templates: DataFrame, claims: DataFrame, depth: int = 4, max_child: int = 2, st: float = 0.5, last_seq: int = 0,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Put the merged templates of every group in which one absorbed another through a new prefix tree.

    ``templates(template_id, group_key, tokens, size, label)``, ``claims`` as ``subsume_templates`` gives
    them. The claimants of such a group arrive in their order of merging as sequences of their own tokens:
    they are cut along new branches, and where they are similar they join and generalise once more.

    Returns the groups that changed, their new templates ``(template_id, group_key, path, tokens,
    created_seq, size, label)``, their branches, and ``(template_id, new_id)`` for every old template of
    these groups. New ids follow ``last_seq``; sizes add up and the label is that of the youngest member.
    """
    known = templates.select("template_id", "group_key", "tokens", "size", "label")
    joined = claims.filter("template_id <> claimant_id").select(F.col("claimant_id").alias("template_id"))
    changed = materialize(known.join(joined, "template_id", "left_semi").select("group_key").distinct(), "changed")
    wild = F.size(F.filter("tokens", lambda t: t == WILDCARD))
    _, fine = id_cells("template_id")
    heads = claims.filter("template_id = claimant_id").select("template_id")
    ours = known.join(changed, "group_key", "left_semi")
    merged = (
        ours.join(heads, "template_id", "left_semi")
        .withColumn("rank", F.struct((-wild).alias("w"), (-F.size("tokens")).alias("l")))
    )
    order = materialize(
        dense_position(merged, F.col("rank"), fine, ["template_id"], out="_pos")
        .select("template_id", "group_key", "tokens", (F.col("_pos") + last_seq).alias("line_id")), "order")
    pathed, branches = prefix_path(order.select("line_id", "group_key", "tokens"), depth, max_child)
    members, found = cluster_leaves(pathed, st, depth)
    moved = materialize(
        claims.join(order.select(F.col("template_id").alias("claimant_id"), "line_id"), "claimant_id")
        .join(members.select("line_id", F.col("template_id").alias("new_id")), "line_id").select("template_id", "new_id"), "moved")
    sums = ours.join(moved, "template_id").groupBy(F.col("new_id").alias("template_id")).agg(
        F.sum("size").alias("size"), F.max_by("label", "template_id").alias("label"))
    return changed, materialize(found.join(sums, "template_id"), "reinserted"), branches, moved


def apply_template_delta(
    templates: DataFrame,
    removed_ids: DataFrame,
    replacements: DataFrame,
    recent: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Remove merged templates, add replacements under new ids, clean the recent list."""
    gone = removed_ids.select("template_id").distinct()
    kept = templates.join(gone, "template_id", "left_anti")
    top = templates.agg(F.coalesce(F.max("template_id"), F.lit(-1)).alias("m")).scalar()
    coarse, fine = id_cells("template_id")
    fresh = (
        dense_position(replacements, coarse, fine, ["template_id"], out="_pos")
        .withColumn("template_id", F.col("_pos") + top).drop("_pos")
    )
    left = recent.join(gone, "template_id", "left_anti") if recent is not None else None
    return kept.unionByName(fresh, allowMissingColumns=True), left
