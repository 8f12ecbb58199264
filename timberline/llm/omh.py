"""Near-duplicate documents by Order MinHash.

A document is the sequence of its word 5-mers, repeated ones labelled by occurrence. Each of
``SKETCHES`` sketches takes the ``MINIMA`` least 5-mers under its own hash and keeps them in text order;
documents that agree in a sketch meet in a bucket. Order makes the sketch follow edit similarity:
moved text changes it, as it changes an alignment. A pair is linked when the Jaccard similarity of
its distinct 5-mers is at least 0.8 and a banded alignment of its words confirms it.

Equal texts are one class before any sketch. Inside a bucket a few leaders (least hashes of the id,
by several orders) are compared with all members. What then still stands apart from the largest class
of its bucket meets the other classes: directly in a small bucket, and in a large one through the rarest
5-mers of both, which is exact. So no candidate link between classes is lost, while a group of near
copies costs a few pairs a member and a passage that many documents share brings none together.

Defined results: words are runs of other than ASCII white space, unchanged; null and empty texts are
one class (equal texts); a text of fewer than five words has one 5-mer, all its words; repeated rows
are one document, as are rows that share an id; a text that has only null ids is a class of its own;
an empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from timberline.session import materialize

from .components import components
from .tables import fresh
from .words import Words, mix, slices, texts_of, windows

K = 5
MINIMA = 4
SKETCHES = 20
SIMILARITY = 0.8
#: Orders by which the leaders of a bucket are chosen.
ORDERS = 3
#: Rows of a bucket whose classes are compared directly; larger buckets go through rare k-mers.
SMALL = 32
#: Members of the largest class that the others of a large bucket try first.
LEADERS = 6
#: Documents compared with as many others in one task.
BLOCK = 128

_SEEDS = np.random.default_rng(20).integers(1, 1 << 63, SKETCHES, np.uint64)


def shingles(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the word k-mers of a text; all its words as one k-mer if it has fewer."""
    return windows(hashes, min(k, len(hashes))) if len(hashes) else np.zeros(0, np.uint64)


def occurrences(kmers: np.ndarray) -> np.ndarray:
    """How often each k-mer stood earlier in the text."""
    order = np.argsort(kmers, kind="stable")
    ordered = kmers[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    rank = np.arange(len(kmers)) - np.repeat(first, np.diff(np.append(first, len(kmers))))
    out = np.empty(len(kmers), np.uint64)
    out[order] = rank
    return out


def order_minhash(kmers: np.ndarray, minima: int = MINIMA, seeds: np.ndarray = _SEEDS) -> np.ndarray:
    """One key per sketch: the least labelled k-mers in text order, hashed."""
    labelled = mix(kmers + occurrences(kmers) * np.uint64(0xD6E8FEB86659FD93))
    take = min(minima, len(kmers))
    at = np.empty((len(seeds), take), np.int64)
    rows = max(1, (1 << 18) // len(kmers))  # a long text is not multiplied by all sketches at once
    for s in range(0, len(seeds), rows):
        value = (labelled[None, :] ^ seeds[s:s + rows, None]) * np.uint64(0x9FB21C651E98DF25)
        value ^= value >> np.uint64(32)
        at[s:s + rows] = np.argpartition(value, take - 1, axis=1)[:, :take]
    at.sort(axis=1)
    out = np.zeros(len(seeds), np.uint64)
    for k in range(take):
        out = (out + labelled[at[:, k]]) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
    return mix(out).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words = Words(texts_of(batch))
        flat = _word_hashes(words)
        keys, counts = [], []
        with np.errstate(over="ignore"):
            for a, b in zip(words.starts[:-1], words.starts[1:]):
                kmers = shingles(flat[a:b])
                keys.append(order_minhash(kmers).tolist() if len(kmers) else [])
                counts.append(len(np.unique(kmers)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("digest"), pa.array(counts, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
            names=["doc_id", "digest", "size", "keys"])


def _word_hashes(words: Words) -> np.ndarray:
    """32 bits for each word: a k-mer is told apart by five of them."""
    return (words.hashes() >> np.uint64(32))[words.codes]


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words = Words(texts_of(batch))
        flat = _word_hashes(words).astype("<u4")
        bodies = [flat[a:b].tobytes() for a, b in zip(words.starts[:-1], words.starts[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bodies, pa.binary())], names=["doc_id", "words"])


def body(words: bytes) -> np.ndarray:
    return np.frombuffer(words, "<u4").astype(np.uint64)


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, size, keys): distinct k-mers and sketch keys, written once; texts are read where they lie."""
    rows = docs.select("doc_id", "digest", "text").mapInArrow(_sketch, "doc_id long, digest string, size int, keys array<bigint>")
    return materialize(rows, "sketches")


def bodies(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, words) of the texts named in ``nodes(doc_id, head, digest)``, written once."""
    rows = docs.select(F.col("doc_id").alias("head"), "digest", "text").join(nodes.hint("merge"), ["head", "digest"])
    chosen = rows.select("doc_id", "text").dropDuplicates(["doc_id"])
    return materialize(chosen.mapInArrow(_bodies, "doc_id long, words binary"), "words")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of distinct k-mers; two texts without words are equal."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(len(a) + len(b) - shared, 1) if len(a) + len(b) else 1.0


def banded_alignment(a: list, b: list, band: int) -> int:
    """Words matched by the best alignment of ``a`` and ``b`` within ``band`` of the diagonal.

    One bit per word of ``a`` between the common ends (bit-parallel longest common subsequence): time
    grows with the words of ``b`` times those of ``a`` over the bits of a machine word, memory with the
    words of ``a`` for every distinct one.
    """
    lead = 0
    for x, y in zip(a, b):
        if x != y:
            break
        lead += 1
    trail = 0
    for x, y in zip(reversed(a[lead:]), reversed(b[lead:])):
        if x != y:
            break
        trail += 1
    a, b = a[lead:len(a) - trail], b[lead:len(b) - trail]
    if not a or not b:
        return lead + trail
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    window, row = (1 << (2 * band + 1)) - 1, full
    for j, y in enumerate(b):
        inside = window << (j - band) if j >= band else window >> (band - j)
        match = where.get(y, 0) & inside
        if match:
            hit = row & match
            row = ((row + hit) | (row - hit)) & full
    return lead + trail + len(a) - row.bit_count()


def similar(x: bytes, y: bytes, threshold: float = SIMILARITY) -> bool:
    """Distinct 5-mers shared, then word alignment: both at least ``threshold``."""
    a, b = body(x), body(y)
    if jaccard(np.unique(shingles(a)), np.unique(shingles(b))) < threshold:
        return False
    longest = max(len(a), len(b))
    band = max(8, int(np.ceil(longest * 2 * (1 - threshold))))
    return banded_alignment(a.tolist(), b.tolist(), band) >= threshold * longest


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        with np.errstate(over="ignore"):
            good = [similar(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [c.filter(pa.array(good, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], names=["a", "b"])


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The links among distinct candidate pairs (a, b), written once."""
    both = (
        pairs.join(words.select(F.col("doc_id").alias("a"), F.col("words").alias("x")).hint("merge"), "a")
        .join(words.select(F.col("doc_id").alias("b"), F.col("words").alias("y")).hint("merge"), "b")
    )
    return materialize(both.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"), "verified")


def _reach(size, other) -> F.Column:
    """Sizes that allow the similarity at all."""
    return (F.col(size) >= F.lit(SIMILARITY) * F.col(other)) & (F.col(other) >= F.lit(SIMILARITY) * F.col(size))


def _kmers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        with np.errstate(over="ignore"):
            found = [np.unique(shingles(body(w))).view(np.int64) for w in batch.column("words").to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))),
            pa.array(np.concatenate([np.zeros(0, np.int64), *found]), pa.int64()),
        ], names=["doc_id", "kmer"])


def _unit_links(key: tuple, unit: pa.Table) -> pa.Table:
    """Links between the documents of two blocks: shared 5-mers of all by array operations, then alignment."""
    rows = unit.to_pylist()
    left, right = [r for r in rows if r["side"] == 0], [r for r in rows if r["side"] == 1]
    found = []
    with np.errstate(over="ignore"):
        sets = [np.unique(shingles(body(r["words"]))) for r in right]
        sizes = np.array([len(x) for x in sets])
        values, flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        for r in left:
            own = np.unique(shingles(body(r["words"])))
            has = np.isin(values, own, assume_unique=True)
            total = np.concatenate([[0], np.cumsum(has[flat])])
            shared = total[edges[1:]] - total[edges[:-1]]
            for k in np.flatnonzero(shared >= SIMILARITY * (len(own) + sizes - shared)):
                q = right[k]
                if q["label"] != r["label"] and similar(r["words"], q["words"]):
                    found.append((min(r["doc_id"], q["doc_id"]), max(r["doc_id"], q["doc_id"])))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def block_links(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Links between classes of large buckets; exact.

    Two sets of size m and n with the similarity share a k-mer among the (1 - s) m + 1 rarest of
    each, so a passage that all documents of a bucket share brings none together. Documents lie in
    blocks of about ``BLOCK`` of one class, or of those apart from one class; two blocks are compared
    if documents of both share such a k-mer. Only links leave a task, never pairs.
    """
    apart = F.col("label") != F.col("top")
    docs = rows.groupBy("doc_id").agg(
        F.first("label").alias("label"), F.first("size").alias("size"), F.max(apart).alias("apart"), F.min(F.when(apart, F.col("top"))).alias("home"))
    docs = docs.withColumn("home", F.coalesce("home", "label"))
    homes = docs.groupBy("home", "apart").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    docs = materialize(docs.join(homes.hint("merge"), ["home", "apart"]).select(
        "doc_id", "label", "size", "apart", F.xxhash64("home", "apart", F.pmod(F.xxhash64("doc_id"), "blocks")).alias("block")), "blocks")
    kmers = materialize(
        words.join(docs.select("doc_id").hint("merge"), "doc_id", "left_semi")
        .mapInArrow(_kmers, "doc_id long, kmer long"), "kmers")
    # a k-mer of one document brings nothing together; it only takes a place among the rarest
    often = kmers.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ranked = kmers.join(often.hint("merge"), "kmer").groupBy("doc_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("n", "kmer"))), lambda x: x["kmer"]).alias("k"))
    alone = F.col("size") - F.size("k")
    take = F.col("size") - F.ceil(F.col("size") * F.lit(SIMILARITY - 1e-9)).cast("int") + 1 - alone
    rare = materialize(
        ranked.join(docs.hint("merge"), "doc_id").filter(take > 0)
        .select("block", "apart", F.explode(F.slice("k", F.lit(1), take)).alias("kmer")).distinct(), "rare")
    units = materialize(
        rare.filter("apart").select("kmer", F.col("block").alias("p"))
        .join(rare.select("kmer", F.col("block").alias("q"), "apart").hint("merge"), "kmer")
        .filter("not apart or p <= q").select("p", "q").distinct(), "units")
    texts = words.join(docs.hint("merge"), "doc_id").select("doc_id", "label", "block", "words")
    sides = [
        units.withColumn("block", F.col(name)).join(texts.hint("merge"), "block")
        .select("p", "q", F.lit(side).alias("side"), "doc_id", "label", "words")
        for side, name in enumerate("pq")
    ]
    return materialize(sides[0].unionByName(sides[1]).groupBy("p", "q").applyInArrow(_unit_links, "a long, b long").distinct(), "verified")


def bucket_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of different classes inside buckets of bounded size."""
    left = rows.filter("label <> top").select(
        "sketch", "key", F.col("doc_id").alias("p"), F.col("label").alias("pl"), F.col("size").alias("ps"), "top")
    right = rows.select("sketch", "key", F.col("doc_id").alias("q"), F.col("label").alias("ql"), F.col("size").alias("qs"))
    return left.hint("merge").join(right.hint("merge"), ["sketch", "key"]).filter(
        (F.col("pl") != F.col("ql")) & _reach("ps", "qs") & ((F.col("ql") == F.col("top")) | (F.col("p") < F.col("q")))
    ).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the buckets that still hold several classes, with the bucket's largest class ``top``."""
    placed = members.select("doc_id", "size", "sketch", "key", "n").join(
        labels.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left"
    ).withColumn("label", F.coalesce("label", "doc_id"))
    largest = placed.groupBy("sketch", "key", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("sketch", "key").agg(
        F.max(F.struct("m", "label")).alias("top"), F.count(F.lit(1)).alias("classes")
    ).filter("classes > 1").select("sketch", "key", F.col("top.label").alias("top"))
    return materialize(placed.join(largest.hint("merge"), ["sketch", "key"]), "open")


def leader_pairs(rows: DataFrame, leaders: int = LEADERS) -> DataFrame:
    """Documents apart from the largest class of their bucket, each with some members of that class."""
    chosen = rows.filter("label = top").groupBy("sketch", "key").agg(F.array_distinct(F.array(*[
        F.min(F.struct(F.xxhash64("doc_id", "sketch", F.lit(r)).alias("order"), "doc_id", "size")) for r in range(leaders)
    ])).alias("leaders")).select("sketch", "key", F.explode("leaders").alias("l"))
    chosen = chosen.select("sketch", "key", F.col("l.doc_id").alias("leader"), F.col("l.size").alias("leader_size"))
    return rows.filter("label <> top").join(chosen.hint("merge"), ["sketch", "key"]).filter(_reach("size", "leader_size")).select(
        F.least("leader", "doc_id").alias("a"), F.greatest("leader", "doc_id").alias("b")).distinct()


def near_links(sketches: DataFrame, docs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels(node, label), links(a, b)) over distinct texts, which ``sketches`` knows by a number as doc_id.

    ``nodes(doc_id, head, digest)`` says which row of ``docs(doc_id, digest, text)`` a number stands for.
    """
    entries = sketches.select("doc_id", "size", F.posexplode("keys").alias("sketch", "key"))
    entries = entries.withColumn("order", F.xxhash64("doc_id", F.col("sketch") % ORDERS))
    leaders = entries.groupBy("sketch", "key").agg(
        F.min(F.struct("order", "doc_id", "size")).alias("leader"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1").select("sketch", "key", "n", F.col("leader.doc_id").alias("leader"), F.col("leader.size").alias("leader_size"))
    # only rows that share a bucket
    members = materialize(entries.drop("order").join(leaders.hint("merge"), ["sketch", "key"]), "members")
    tried = materialize(
        members.filter((F.col("doc_id") != F.col("leader")) & _reach("size", "leader_size"))
        .select(F.least("leader", "doc_id").alias("a"), F.greatest("leader", "doc_id").alias("b")).distinct(), "pairs")
    # the words of documents that share a bucket, fetched in one pass
    words = bodies(docs, nodes.join(members.select("doc_id").distinct().hint("merge"), "doc_id"))
    links = verified(tried, words)
    labels = components(links)
    # documents apart from the largest class of a large bucket try more members of that class first
    again = leader_pairs(open_buckets(members.filter(F.col("n") > SMALL), labels)).join(
        tried.hint("merge"), ["a", "b"], "left_anti")
    again = materialize(again, "pairs")
    found = verified(again, words)
    links, tried = links.unionByName(found), tried.unionByName(again)
    labels = components(links, labels)
    rest = open_buckets(members, labels)
    small = bucket_pairs(rest.filter(F.col("n") <= SMALL)).distinct().join(tried.hint("merge"), ["a", "b"], "left_anti")
    found = verified(small, words).unionByName(block_links(rest.filter(F.col("n") > SMALL), words))
    if not found.isEmpty():
        labels = components(found.unionByName(links), labels)
    return labels, links.unionByName(found)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size, n_links, kept, digest) of every document; ``digest`` is its text's SHA-256.

    ``class_id`` is the largest doc_id of the class, the document that stays; ``n_links`` counts the
    verified links of the document's text to different texts.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("digest", F.sha2("text", 256))
    member = materialize(texts.select("doc_id", "digest").distinct(), "digests")
    # one row per different text, by its largest id, with a number: several texts may share an id
    heads = materialize(
        member.groupBy("digest").agg(F.max("doc_id").alias("head"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()), "heads")
    named = texts.filter("doc_id is not null")
    nodes = heads.filter("head is not null").select(F.col("node").alias("doc_id"), "head", "digest")
    sketches = sketched(named).withColumnRenamed("doc_id", "head").join(nodes.hint("merge"), ["head", "digest"])
    sketches = sketches.select("doc_id", "size", "keys").dropDuplicates(["doc_id"])
    labels, links = near_links(materialize(sketches, "sketches"), named, nodes)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    heads = heads.join(labels.hint("merge"), "node", "left").join(degree.hint("merge"), "node", "left")
    # a text without an id, or alone, is its own class
    heads = heads.withColumn("class_key", F.coalesce(F.col("label").cast("string"), "digest"))
    classes = heads.groupBy("class_key").agg(F.max("head").alias("class_id"), F.sum("copies").alias("class_size"))
    heads = materialize(heads.join(classes.hint("merge"), "class_key").select(
        "digest", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links")), "heads")
    return member.join(heads.hint("merge"), "digest").select(
        "doc_id", "class_id", "class_size", "n_links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "digest")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without the documents that a class has beside the one that stays."""
    key, mark = fresh(docs, "__key"), fresh(docs, "__digest")
    gone = near_duplicates(docs).filter("not kept and doc_id is not null").select(F.col("doc_id").alias(key), F.col("digest").alias(mark))
    rows = docs.withColumns({key: F.col("doc_id").cast("bigint"), mark: F.sha2(F.coalesce("text", F.lit("")), 256)})
    return rows.join(gone.hint("merge"), [key, mark], "left_anti").select(*docs.columns)
