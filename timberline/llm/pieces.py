"""SentencePiece encoding and decoding with a BPE piece model, on a relational lattice.

A text becomes words (runs of the space mark and what follows, lines apart), cut between any two characters
that no piece holds side by side: no merge can cross there. Every distinct part of the corpus is encoded once: its substrings of bounded length are exploded and equi-joined to the
piece table (tens of thousands of rows, broadcast), the matches are grouped as edges of the word, and a
Spark higher-order aggregate folds Viterbi over the positions. In a BPE model a path is valid if every
two neighbouring pieces are: no merge across their border comes before the merges that made them. Such
a path is unique, so the best edge into each position is the one that fits the best edge before it,
and the result is that of the sentencepiece library. The limits of each piece (when its heads and tails
are consumed inside it) are part of the piece table.

Documents are codes over the words of their task, written once and never shuffled; words meet their ids
once per task, so the shuffles carry distinct words. Ids are put together for a slice of documents at a
time, and a summary of them is all that leaves the task. Characters the model lacks become byte pieces.

Defined results: a null or empty text has no ids; a part longer than ``LONG`` code points (no word
of the usual scripts, but a run of one character) is folded in its task by the same rule in linear memory; repeated rows are encoded each; an empty table gives an
empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import functools
import itertools
import operator
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from timberline.session import discard, materialize, scratch_path

from .words import slices, texts_of

SPACE = "▁"
#: Code points of a word folded in Spark.
LONG = 64
#: Words whose edges are grouped in one task, some 100 MB: the sort below the grouping stays in memory.
TASK_WORDS = 1 << 15
#: Input bytes, by Spark's estimate, of one task's documents, which meet the ids of all their words in one task.
PART_BYTES = 16 << 20
#: What is done with batches of encoded rows in their task, and the columns it makes.
Finish = tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]
#: Text bytes of the documents coded at once, and bytes of codes of those whose ids are looked up at once.
SLICE_TEXT, SLICE_CODES = 3 << 20, 1 << 20
_UNITS = re.compile(f"{SPACE}+[^{SPACE}\\n]*|\\n[^{SPACE}\\n]*")
_NEVER = 1 << 30


def _merges(text: str, rank: dict[str, int]) -> list[tuple[int, int, int]] | None:
    """Merges (start, middle, end) that build ``text`` from characters by rank, or None if it stays apart."""
    parts = [(i, i + 1) for i in range(len(text))]
    made = []
    while len(parts) > 1:
        best = min(((rank.get(text[a[0]:b[1]], _NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))))
        if best[0] == _NEVER:
            return None
        a, b = parts[best[1]], parts[best[1] + 1]
        made.append((a[0], a[1], b[1]))
        parts[best[1]:best[1] + 2] = [(a[0], b[1])]
    return made


@functools.cache
def piece_table(path: str) -> tuple[tuple, ...]:
    """(piece, id, rank, tails, heads): when each tail and head of the piece is consumed inside it.

    ``tails[k]`` is the rank of the merge that consumes the part made of the last k + 1 characters, -1 if
    there is no such part, and never for the whole piece; ``heads`` likewise.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = {
        model.id_to_piece(i): i for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))}
    order = {p: k for k, p in enumerate(sorted(names, key=lambda p: -model.get_score(names[p])))}
    rank = {p: order[p] for p in names if len(p) > 1}
    out = []
    for piece, i in names.items():
        made = _merges(piece, rank)
        if made is None:
            continue
        n = len(piece)
        tails, heads = [-1] * n, [-1] * n
        tails[n - 1] = heads[n - 1] = _NEVER
        for a, m, b in made:
            here = rank[piece[a:b]]
            if b == n:
                tails[n - m - 1] = here
            if a == 0:
                heads[m - 1] = here
        # only parts on the outer edge last until then
        out.append((piece, i, rank.get(piece, -1), tuple(tails), tuple(heads)))
    return tuple(out)


def byte_id(path: str) -> int:
    """Id of the byte piece for 0."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).piece_to_id("<0x00>")


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts as the model sees them, one text behind the other, and their number in each.

    The model sees a leading space mark and spaces marked, so all words but those after a line break begin
    with a mark; a run of spaces belongs to the word behind it. Words come without their first mark, or
    with the line break before them.
    """
    odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE)), pc.starts_with(texts, " "))
    if pc.any(odd).as_py():
        marked = [_UNITS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts.to_pylist()]
        words = [w[1:] if w[0] == SPACE else w for w in itertools.chain.from_iterable(marked)]
        return pa.array(words, pa.large_string()), np.array(list(map(len, marked)), np.int64)
    words = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    counts, some = pc.list_value_length(words).to_numpy(), pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
    return words.flatten().filter(pa.array(np.repeat(some, counts))), counts * some


def fold_long(word: str, table: dict) -> list[int]:
    """The same fold in Python for a very long word: memory of the word, time of its edges."""
    n, longest = len(word), max(map(len, table))
    last: list[tuple | None] = [None] * (n + 1)  # (start, piece entry) into each position
    crossing = lambda p: [
        (s, e, table[word[s:e]][1]) for s in range(max(0, p - longest + 1), p)
        for e in range(p + 1, min(n, s + longest) + 1) if word[s:e] in table]
    near: dict[int, list] = {}
    for e in range(1, n + 1):
        for s in range(max(0, e - longest), e):
            entry = table.get(word[s:e])
            if entry is None:
                continue
            before = last[s]
            if before is not None and before[1] is not None:
                if s not in near:
                    near[s] = crossing(s)
                    near.pop(s - 2 * longest, None)
                start, (_, _, tails, _) = before
                if any(x >= start and y <= e and r < tails[s - x - 1] and r <= entry[3][y - s - 1] for x, y, r in near[s]):
                    continue
            last[e] = (s, entry)
            break
        else:
            last[e] = (e - 1, None)
    out, p = [], n
    while p:
        s, entry = last[p]
        out.append(entry[0] if entry else -ord(word[s]))
        p = s
    return out[::-1]


@functools.cache
def crossed(path: str) -> frozenset[str]:
    """Pairs of characters that stand side by side in a piece. Between any other two no merge is possible."""
    return frozenset(p[i:i + 2] for p, *_ in piece_table(path) for i in range(len(p) - 1))


def word_parts(word: str, pairs: frozenset[str]) -> list[str]:
    """A word cut where no piece can cross; the ids of the parts in order are those of the word."""
    cuts = [i for i, pair in enumerate(map(operator.add, word, word[1:]), 1) if pair not in pairs]
    return [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)])]


class _Parts(dict):
    """Codes of parts of words in the order they are met, four bytes each."""

    def __missing__(self, part: str) -> bytes:
        code = self[part] = len(self).to_bytes(4, "little")
        return code


class _Cuts:
    """Words of ``units`` cut together as ``word_parts`` cuts each, line breaks apart.

    Characters have classes, and a table says which of them stand side by side in a piece.
    """

    def __init__(self, pairs: frozenset[str]):
        chars = sorted(set("".join(pairs)))
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[list(map(ord, chars))] = np.arange(1, len(chars) + 1)
        self.beside = np.zeros((len(chars) + 1,) * 2, bool)
        for a, b in pairs:
            self.beside[self.classes[ord(a)], self.classes[ord(b)]] = True

    def parts(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """Parts of all words, one word's behind another's, and their number in each."""
        full = [w if w[:1] == "\n" else SPACE + w for w in words]
        joined = "".join(full)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds, starts = self.classes[chars], np.cumsum([0, *map(len, full)])
        cut = np.ones(len(chars) + 1, bool)
        cut[1:-1] = ~self.beside[kinds[:-1], kinds[1:]] | (chars[:-1] == 10)
        cut[starts] = True
        edges = np.flatnonzero(cut)
        places = edges.tolist()
        return [joined[i:j] for i, j in zip(places, places[1:])], np.diff(np.searchsorted(edges, starts))


def _gather(flat: np.ndarray, length: np.ndarray, at: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lists ``at`` of those that lie in ``flat`` joined, and where each begins and the last ends."""
    if start is None:
        start = np.cumsum(length) - length
    ends = np.concatenate([[0], np.cumsum(length[at])])
    return flat[np.repeat(start[at] - ends[:-1], length[at]) + np.arange(ends[-1])], ends


def _planes(codes: np.ndarray) -> bytes:
    """Codes by byte, lowest bytes first: small codes leave planes of zeros, which compress to nothing."""
    return codes.view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()


_CODED = "part int, doc_id long, text_crc32 long, codes binary, code int, word string"


def _code_part(path: str):
    """Rows of documents, as codes over the parts of words met in the task, and rows of new parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, cuts, known = TaskContext.get().partitionId(), _Cuts(crossed(path)), _Parts()
        for batch in slices(batches, "text", SLICE_TEXT):
            told, texts = len(known), texts_of(batch)
            words, counts = units(texts)
            coded = words.dictionary_encode()
            parts, length = cuts.parts(coded.dictionary.to_pylist())
            flat = np.frombuffer(b"".join(map(known.__getitem__, parts)), "<i4")
            codes, ends = _gather(flat, length, coded.indices.to_numpy())
            ends = ends[np.cumsum(counts)].tolist()
            out = [_planes(codes[a:b]) for a, b in zip([0, *ends], ends)]
            crcs = list(map(zlib.crc32, texts.cast(pa.large_binary()).to_pylist()))
            new = list(itertools.islice(known, told, None))
            n, m = batch.num_rows, len(new)
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * (n + m), pa.int32()), pa.concat_arrays([batch.column("doc_id"), pa.nulls(m, pa.int64())]),
                pa.array(crcs + [None] * m, pa.int64()), pa.array(out + [None] * m, pa.binary()),
                pa.array([None] * n + list(range(told, told + m)), pa.int32()), pa.array([None] * n + new, pa.string()),
            ], names=[c.split()[0] for c in _CODED.split(", ")])

    return run


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """Edges of every word: substrings joined to the piece table, grouped by word; other columns stay.

    ``words`` is partitioned by ``word``, so the grouping needs no shuffle.
    """
    n = F.length("word")
    # a very long word keeps one row
    short = n <= LONG
    spans = words.select("word", "places", n.alias("n"), F.explode(F.sequence(F.lit(0), F.when(short, n - 1).otherwise(0))).alias("s"))
    last = F.when(short, F.least(F.col("s") + longest, "n")).otherwise(1)
    spans = spans.select("word", "places", "s", F.explode(F.sequence(F.col("s") + 1, last)).alias("e"))
    edges = spans.withColumn("piece", F.substring("word", F.col("s") + 1, F.col("e") - F.col("s"))).join(F.broadcast(pieces), "piece", "left")
    # substrings that are no piece go before the grouping, but for one row that keeps the word and its places
    first = (F.col("s") == 0) & (F.col("e") == 1)
    kept = F.when(F.col("id").isNotNull(), F.struct("e", "s", "id", "rank", "tails", "heads"))
    edges = edges.filter(F.col("id").isNotNull() | first).select("word", F.when(first, F.col("places")).alias("places"), kept.alias("edge"))
    return edges.groupBy("word").agg(
        F.first("places", ignorenulls=True).alias("places"), F.array_sort(F.collect_list("edge")).alias("edges")).withColumn("n", n)


def best_edges(edges: Column) -> Column:
    """Viterbi: the best edge into each position by its index in ``edges``, 0 for a character without a piece."""
    def blocked(v: Column) -> Column:
        """A merge across the border of ``v.a`` and ``v.b`` comes before those that made them."""
        at = v["b"]["s"]
        return F.exists(edges, lambda x: (x["s"] < at) & (x["e"] > at) & (x["s"] >= v["a"]["s"]) & (x["e"] <= v["b"]["e"])
                        & (x["rank"] < F.get(v["a"]["tails"], at - x["s"] - 1)) & (x["rank"] <= F.get(v["b"]["heads"], x["e"] - at - 1)))

    def step(chosen: Column, b: Column) -> Column:
        i, edge = b["i"], b["edge"]
        before = F.get(chosen, edge["s"] - 1)
        # one-element arrays bind the two neighbours for the test
        pair = F.array(F.struct(F.get(edges, before - 1).alias("a"), edge.alias("b")))
        fits = (edge["s"] == 0) | F.coalesce(before == 0, F.lit(True)) | ~F.exists(pair, blocked)
        skipped = F.array_repeat(F.lit(0), edge["e"] - 1 - F.size(chosen))
        return F.when(F.size(chosen) >= edge["e"], chosen).when(fits, F.concat(chosen, skipped, F.array(i))).otherwise(chosen)

    empty = F.array().cast("array<int>")
    numbered = F.transform(edges, lambda x, i: F.struct((i + 1).alias("i"), x.alias("edge")))
    return F.aggregate(numbered, empty, step)


def ids_along(n: Column, edges: Column, word: Column, chosen: Column) -> Column:
    """Ids of the path that ends at the last position, followed back over the chosen edges."""
    empty = F.array().cast("array<int>")

    def back(state: Column, i: Column) -> Column:
        """Over the chosen edges from the last position down; ``p`` is the position still to be explained."""
        edge, p = F.get(edges, i["l"] - 1), i["p"]
        lost = F.array(-F.ascii(F.substring(word, p, F.lit(1))))
        return F.when(state["p"] != p, state).otherwise(F.struct(
            F.when(i["l"] == 0, p - 1).otherwise(edge["s"]).alias("p"),
            F.concat(F.when(i["l"] == 0, lost).otherwise(F.array(edge["id"])), state["ids"]).alias("ids")))

    # positions after the last chosen edge are characters without a piece
    filled = F.concat(chosen, F.array_repeat(F.lit(0), n - F.size(chosen)))
    places = F.reverse(F.transform(filled, lambda l, i: F.struct(l.alias("l"), (i + 1).alias("p"))))
    return F.aggregate(places, F.struct(n.alias("p"), empty.alias("ids")), back)["ids"]


def encode_words(words: DataFrame, model: str) -> DataFrame:
    """(places, ids, word) of ``words(word, places)``; an unknown character c is -code point.

    A very long word has no ids yet and comes with its text; other words come without.
    """
    table = piece_table(model)
    pieces = words.sparkSession.createDataFrame(
        [(p, i, r, list(t), list(h)) for p, i, r, t, h in table],
        "piece string, id int, rank int, tails array<int>, heads array<int>")
    short = F.col("n") <= LONG
    found = lattice(words, pieces, max(len(p) for p, *_ in table)).withColumn(
        "chosen", F.when(short, best_edges(F.col("edges"))))
    return found.select(
        "places", F.when(short, ids_along(F.col("n"), F.col("edges"), F.col("word"), F.col("chosen"))).alias("ids"),
        F.when(~short, F.col("word")).alias("word"))


_IDS = "doc_id long, ids binary, text_crc32 long"


def _joined(model: str, finish: Finish | None):
    """Documents of a part meet the ids of its words; only what ``finish`` makes of a slice of them is kept."""
    zero = byte_id(model)

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        code = words.column("code").to_numpy()
        lists = pa.concat_arrays([c.cast(pa.list_(pa.int32())) for c in words.column("ids").chunks] or [pa.array([], pa.list_(pa.int32()))])
        flat, length = lists.flatten().to_numpy(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        start = np.cumsum(length) - length
        at = np.flatnonzero(pc.is_valid(words.column("word")).to_numpy())
        if len(at):  # very long words are folded here
            lookup = {p: (i, r, t, h) for p, i, r, t, h in piece_table(model)}
            more = [fold_long(words.column("word")[int(k)].as_py(), lookup) for k in at]
            sizes = np.array([len(x) for x in more])
            start[at], length[at] = len(flat) + np.cumsum(sizes) - sizes, sizes
            flat = np.concatenate([flat, *(np.array(x, np.int32) for x in more)])
        place = np.zeros(int(code.max()) + 1 if len(code) else 0, np.int64)
        place[code] = np.arange(len(code))

        lost = flat < 0  # characters the model lacks, byte by byte
        if lost.any():
            chars = [chr(-i).encode() for i in flat[lost].tolist()]
            size = np.ones(len(flat), np.int64)
            size[lost] = list(map(len, chars))
            moved = np.concatenate([[0], np.cumsum(size)])
            start, length = moved[start], moved[start + length] - moved[start]
            flat = np.repeat(flat, size)
            flat[flat < 0] = zero + np.frombuffer(b"".join(chars), np.uint8).astype(np.int32)

        def ids_of(codes: list[bytes]) -> list[bytes]:
            ids, ends = _gather(flat, length, place[np.concatenate(list(map(_from_planes, codes)))], start)
            ends = (4 * ends[np.cumsum([len(c) // 4 for c in codes])]).tolist()
            raw = ids.astype("<u4").tobytes()
            return [raw[a:b] for a, b in zip([0, *ends], ends)]

        encoded = (
            pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(ids_of(b.column("codes").to_pylist()), pa.binary()), b.column("text_crc32")],
                names=["doc_id", "ids", "text_crc32"])
            for b in slices(docs.to_batches(), "codes", SLICE_CODES))
        # words come from documents of their part, so there are some
        return pa.Table.from_batches(finish[0](encoded) if finish else encoded)

    return run


def _parts(rows: DataFrame) -> int:
    """Tasks that share words: one for each core, or of ``PART_BYTES`` of input, as far as there are splits."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(1, min(rows.rdd.getNumPartitions(), max(rows.sparkSession.sparkContext.defaultParallelism, size // PART_BYTES)))


def encode(docs: DataFrame, model: str, finish: Finish | None = None) -> DataFrame:
    """(doc_id, ids, text_crc32) with ids as little-endian unsigned 32-bit integers.

    With ``finish``, what it makes of batches of these rows, and the columns of that, are written instead
    of the ids, which then never leave their task nor lie in it all at once.

    Codes are made once, in a table bucketed by the task that made them: whatever order the input comes
    in, documents and words agree, and the documents meet the ids of their words without a shuffle.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    name, path = f"coded_{uuid.uuid4().hex}", scratch_path(spark, "coded")
    parts = _parts(rows)
    (
        rows.coalesce(parts).mapInArrow(_code_part(model), _CODED).write.bucketBy(parts, "part")
        .option("path", path).option("compression", "zstd").saveAsTable(name)
    )
    coded = spark.table(name)
    words = coded.filter("word is not null").select("word", "part", "code")
    words = words.repartition(words.count() // TASK_WORDS + 1, "word").groupBy("word").agg(
        F.collect_list(F.struct("part", "code")).alias("places"))
    found = encode_words(words, model).select(F.explode("places").alias("p"), "ids", "word").select("p.part", "p.code", "ids", "word")
    given = coded.filter("codes is not null").select("part", "doc_id", "text_crc32", "codes")
    ids = given.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_joined(model, finish), finish[1] if finish else _IDS)
    out = materialize(ids, "ids")
    spark.sql(f"drop table {name}")
    discard(spark, path)
    return out


def _plain_pieces(model: str) -> pa.Array:
    """The bytes each id stands for."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    return pa.array([
        bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else m.id_to_piece(i).replace(SPACE, " ").encode()
        for i in range(m.get_piece_size())], pa.large_binary())


def _text_bytes(ids: list[bytes], pieces: pa.Array) -> Iterator[memoryview]:
    """Texts: pieces joined, without the leading space."""
    joined = pieces.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
    # the pieces of all texts lie behind one another
    ends = np.frombuffer(joined.buffers()[1], np.int64)[np.cumsum([0, *(len(x) // 4 for x in ids)])].tolist()
    data = memoryview(joined.buffers()[2] or b"")
    return (data[a + 1:b] for a, b in zip(ends, ends[1:]))


def summing(model: str) -> Finish:
    """(doc_id, n_ids, ids_crc32, round_trip) of encoded rows: whether the ids decode to the text they were made of."""
    pieces = _plain_pieces(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            same = [zlib.crc32(t) == c for t, c in zip(_text_bytes(ids, pieces), batch.column("text_crc32").to_pylist())]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(same, pa.bool_()),
            ], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean"


def summary(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, round_trip) from (doc_id, ids, text_crc32)."""
    return encoded.select("doc_id", "ids", "text_crc32").mapInArrow(*summing(model))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): pieces joined, bytes put together, the leading space taken off."""
    pieces = _plain_pieces(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], "ids"):
                out = [str(t, "utf-8", "replace") for t in _text_bytes(part.column("ids").to_pylist(), pieces)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
