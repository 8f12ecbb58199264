"""Ranked lexical search without random access (NRA): the best documents of every query, with exact scores.

Lists: each query term has a list of (document, impact), cut by falling impact into ``BANDS`` bands, a
table partitioned by band. The score of a document is the sum of weight times impact over the query's
terms; weights belong to terms, so a band's top impact bounds what the rest of its list can still add.

Reading: a query reads each of its lists from the top, band by band, first those that take most off the
bound of their list for the postings they hold, in rounds that double. After a round a document's lower
bound is what was read of it; its upper bound adds, for each list in which it was not met, what that list
can still give. With the k-th best lower bound as the bar,

- a query is open while the rests of its lists together reach the bar: a document never met may still win;
- then it is closed: documents whose upper bound is below the bar go, and later reads only add to the
  documents that are left;
- it is resolved when lower and upper bounds agree for all that are left. They then hold the k best, all
  ties with the last, and exact scores.

Which lists hold a document is kept as bits. Lists and states are one table bucketed by document, with a
row for each document and band: a round is a scan of the bands it needs, a grouping by document without a
shuffle, and array sums over a batch of documents; a common term's list is spread over all buckets. The
plan, the bars and the rests of a block of queries go through the driver; they grow with the block, which
is bounded, not with the documents. Survivors never do.

Defined results: a null or empty text has no terms; documents without a term count for nothing; rows that
repeat an id are documents of their own, of which one with equal score and id comes in no fixed order;
queries that share an id are one query with the terms of all its rows, and a null id is an id; a null
doc_id sorts after the others at equal scores; a query no document matches has no rows; empty tables give
an empty result. Only the id and text columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from timberline.session import discard, materialize, scratch_path

from .words import Words, slices, texts_of

TOP = 50
#: Bands of impact in a list; impacts are below a million.
BANDS, IMPACTS = 16, 1_000_000
#: Share of a query's postings it reads in its first round.
FIRST_SHARE = 1 / 32
#: Distinct query terms that are sent to tasks to drop other terms early; with more, all are kept.
SENT_TERMS = 200_000
#: Pairs of query and term searched together: the plan of a block goes to all tasks and through the driver.
BLOCK_PAIRS = 1 << 16
#: Bits of one long that mark lists.
BITS = 62

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPLIT = bytes(
    b if b >= 128 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

DOC_TERMS = "uid long, doc_id long, n long, terms array<string>, tfs array<int>"


def folded(texts: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased and every other ASCII character that is no letter or digit as a space."""
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = data.slice(int(edges[0]), int(edges[-1] - edges[0])).to_pybytes() if data is not None else b""
    return pa.Array.from_buffers(
        pa.large_string(), len(texts),
        [None, pa.py_buffer((edges - edges[0]).tobytes()), pa.py_buffer(raw.translate(_SPLIT))])


def _terms_part(known: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text"):
            words = Words(folded(texts_of(batch)))
            owner, size = words.owners(), max(len(words.vocabulary), 1)
            codes = words.codes.astype(np.int64)
            if known is not None:
                mine = np.fromiter((w in known for w in words.vocabulary), bool, len(words.vocabulary))[codes]
                owner, codes = owner[mine], codes[mine]
            pairs, tf = np.unique(owner * size + codes, return_counts=True)
            edges = np.searchsorted(pairs // size, np.arange(batch.num_rows + 1)).astype(np.int32)
            names = pa.array(words.vocabulary, pa.string()).take(pa.array(pairs % size))
            yield pa.RecordBatch.from_arrays([
                pa.array(uid + np.arange(batch.num_rows)), batch.column("doc_id"), pa.array(words.counts),
                pa.ListArray.from_arrays(edges, names), pa.ListArray.from_arrays(edges, pa.array(tf, pa.int32())),
            ], names=["uid", "doc_id", "n", "terms", "tfs"])
            uid += batch.num_rows

    return run


def document_terms(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Terms of every document with their counts, written once; only those of ``vocabulary`` if it is small.

    ``uid`` names a row; it is made while the table is written and read from there ever after.
    """
    known = None
    if vocabulary is not None and vocabulary.count() <= SENT_TERMS:
        known = frozenset(r.term for r in vocabulary.select("term").collect())
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    return materialize(rows.mapInArrow(_terms_part(known), DOC_TERMS), "terms")


def query_terms(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qid, item_id) and (qid, term), one row for each query and for each of its terms."""
    text = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pairs = materialize(
        queries.select("item_id", F.explode(F.regexp_extract_all(text, F.lit(f"({TERM})"))).alias("term")).distinct(), "pairs")
    items = materialize(pairs.select("item_id").distinct().withColumn("qid", F.monotonically_increasing_id()), "items")
    return items, materialize(pairs.join(items, pairs["item_id"].eqNullSafe(items["item_id"])).select("qid", "term"), "query-terms")


class Lists:
    """Impact lists and the state of a search in one table, bucketed by document and partitioned by band.

    A row of a band from 0 up holds a document's terms of that band (``keys``) and their impacts
    (``amounts``); a row of a negative band is a document's state: for each query in ``keys`` its lower
    bound and, as bits, the lists in which it was met. All rows of a document lie in one bucket, so a
    round adds up what it reads without a shuffle.
    """

    KIND = "uid long, keys array<int>, amounts array<long>, met array<long>, band int"

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.name, self.path = f"lists_{uuid.uuid4().hex}", scratch_path(spark, "lists")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def append(self, rows: DataFrame) -> None:
        (
            rows.select(*[c.split()[0] for c in self.KIND.split(", ")])
            .write.partitionBy("band").bucketBy(self.buckets, "uid").sortBy("uid").option("path", self.path)
            .mode("append").saveAsTable(self.name)
        )

    def read(self, bands: list[int]) -> DataFrame:
        return self.spark.table(self.name).filter(F.col("band").isin(bands))

    def forget(self, band: int) -> None:
        self.spark.sql(f"alter table {self.name} drop if exists partition (band = {band})")
        discard(self.spark, f"{self.path}/band={band}")

    def close(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
        discard(self.spark, self.path)


def _impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L, in 64-bit integers."""
    m = 50 + 50 * n * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _bands(impacts: np.ndarray) -> np.ndarray:
    return BANDS - 1 - impacts * BANDS // IMPACTS


def _ragged(values: np.ndarray, edges: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, kind))


def _lists_part(key_of: dict[str, int], n_docs: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("terms")
            coded = names.flatten().dictionary_encode()
            key = np.array([key_of.get(w, -1) for w in coded.dictionary.to_pylist()] or [-1])
            key = key[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(names.offsets.to_numpy()))
            tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            mine = key >= 0
            key, owner = key[mine], owner[mine]
            value = _impacts(tf[mine], batch.column("n").to_numpy(zero_copy_only=False)[owner], n_docs, n_terms)
            # one row for each document and band
            row = owner * BANDS + _bands(value)
            order = np.argsort(row, kind="stable")
            rows, first = np.unique(row[order], return_index=True)
            edges = np.append(first, len(row))
            yield pa.RecordBatch.from_arrays([
                batch.column("uid").take(pa.array(rows // BANDS)), _ragged(key[order], edges, pa.int32()),
                _ragged(value[order], edges, pa.int64()), pa.nulls(len(rows), pa.list_(pa.int64())), pa.array(rows % BANDS, pa.int32()),
            ], names=["uid", "keys", "amounts", "met", "band"])

    return run


def reading_plan(lists: Lists, asked: DataFrame, n_docs: int) -> DataFrame:
    """(key, band, query, at, weight, bound, round): when a query reads a band, and the most the band gives.

    A band's worth is what reading it takes off its list's bound, for each posting; no band is worth more
    than those above it. A query reads by worth, in rounds of ``FIRST_SHARE`` of its postings, then twice,
    four times ... as many.
    """
    postings = lists.read(list(range(BANDS))).select("band", F.explode(F.arrays_zip("keys", "amounts")).alias("p"))
    heads = materialize(
        postings.groupBy(F.col("p.keys").alias("key"), "band").agg(F.count(F.lit(1)).alias("df"), F.max("p.amounts").alias("top")), "heads")
    weight = F.floor(1000 * F.log((2 * n_docs + 2) / (2 * F.sum("df") + 1))).cast("long")
    weights = heads.groupBy("key").agg(weight.alias("weight")).filter("weight > 0")
    plan = asked.join(weights, "key").join(heads, "key").withColumn("bound", F.col("weight") * F.col("top")).filter("bound > 0")
    down = Window.partitionBy("query", "at").orderBy("band")
    worth = (F.col("bound") - F.lead("bound", 1, 0).over(down)) / F.col("df")
    plan = plan.withColumn("worth", worth).withColumn("worth", F.min("worth").over(down))
    so_far = F.sum("df").over(Window.partitionBy("query").orderBy(F.desc("worth"), "at", "band")) - F.col("df")
    share = so_far / F.sum("df").over(Window.partitionBy("query"))
    return plan.withColumn("round", F.floor(F.log2(share / FIRST_SHARE + 1)).cast("long")).select(
        "key", "band", "query", "at", "weight", "bound", "round")


@dataclass
class Bounds:
    """Of every query: the k-th best lower bound, what its lists can still give, and that of each list."""

    bar: np.ndarray
    rest: np.ndarray
    rests: np.ndarray

    @property
    def open(self) -> np.ndarray:
        return self.rest >= self.bar

    def upper(self, query: np.ndarray, lower: np.ndarray, met: np.ndarray) -> np.ndarray:
        """``met`` has a column of bits for every ``BITS`` lists."""
        out = lower + self.rest[query]
        for at in range(self.rests.shape[1]):
            out -= ((met[:, at // BITS] >> (at % BITS)) & 1) * self.rests[query, at]
        return out


@dataclass
class Step:
    """The bands a round reads: those of slot (key, band) lie from ``edges[slot]`` on in the other arrays."""

    edges: np.ndarray
    query: np.ndarray
    at: np.ndarray
    weight: np.ndarray


def _stands(bounds: Bounds | None, query: np.ndarray, lower: np.ndarray, met: np.ndarray) -> np.ndarray:
    """States that may still be among the best."""
    if bounds is None:
        return np.ones(len(query), bool)
    out = bounds.open[query]
    late = np.flatnonzero(~out)
    out[late] = bounds.upper(query[late], lower[late], met[late]) >= bounds.bar[query[late]]
    return out


def _read_part(step: Step, bounds: Bounds | None, queries: int, masks: int, band: int):
    """Add the postings of a round to the states of their documents."""
    def state(batch: pa.RecordBatch):
        held = batch.column("held")
        doc = np.repeat(np.arange(batch.num_rows), np.diff(held.offsets.to_numpy()))
        query = held.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        lower = batch.column("lower").flatten().to_numpy(zero_copy_only=False)
        met = batch.column("met").flatten().to_numpy(zero_copy_only=False).reshape(-1, masks)
        keep = _stands(bounds, query, lower, met)
        return doc[keep] * queries + query[keep], lower[keep], met[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            had, lower, met = state(batch)
            keys = batch.column("keys")
            key = keys.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            value = batch.column("amounts").flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(keys.offsets.to_numpy()))
            slot = key * BANDS + _bands(value)
            count = step.edges[slot + 1] - step.edges[slot]
            ends = np.cumsum(count)
            one = np.repeat(step.edges[slot] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)
            query = step.query[one]
            pair = np.repeat(doc, count) * queries + query
            gain = step.weight[one] * np.repeat(value, count)
            if bounds is not None:  # a closed query takes no new documents
                place = np.minimum(np.searchsorted(had, pair), max(len(had) - 1, 0))
                keep = bounds.open[query] | ((had[place] == pair) if len(had) else False)
                one, pair, gain = one[keep], pair[keep], gain[keep]
            bits = np.zeros((len(one), masks), np.int64)
            at = step.at[one]
            bits[np.arange(len(one)), at // BITS] = np.left_shift(1, at % BITS)
            pair, gain, bits = np.append(had, pair), np.append(lower, gain), np.concatenate([met, bits])
            order = np.argsort(pair, kind="stable")
            pairs, first = np.unique(pair[order], return_index=True)
            lower = np.add.reduceat(gain[order], first) if len(first) else gain
            # a list holds a document once, so adding bits unites them
            met = np.add.reduceat(bits[order], first, axis=0) if len(first) else bits
            docs, edges = np.unique(pairs // queries, return_index=True)
            edges = np.append(edges, len(pairs))
            yield pa.RecordBatch.from_arrays([
                batch.column("uid").take(pa.array(docs)), _ragged(pairs % queries, edges, pa.int32()), _ragged(lower, edges, pa.int64()),
                _ragged(met.ravel(), edges * masks, pa.int64()), pa.array(np.full(len(docs), band), pa.int32()),
            ], names=["uid", "keys", "amounts", "met", "band"])

    return run


def _live_part(bounds: Bounds, masks: int):
    """States that may still be among the best, with what is unknown of their scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("keys")
            doc = np.repeat(np.arange(batch.num_rows), np.diff(held.offsets.to_numpy()))
            query = held.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            lower = batch.column("amounts").flatten().to_numpy(zero_copy_only=False)
            met = batch.column("met").flatten().to_numpy(zero_copy_only=False).reshape(-1, masks)
            keep = _stands(bounds, query, lower, met)
            doc, query, lower = doc[keep], query[keep], lower[keep]
            yield pa.RecordBatch.from_arrays([
                batch.column("uid").take(pa.array(doc)), pa.array(query), pa.array(lower),
                pa.array(bounds.upper(query, lower, met[keep]) - lower),
            ], names=["uid", "query", "score", "unknown"])

    return run


class _Reader:
    """The rounds of the search of one block of queries."""

    def __init__(self, lists: Lists, plan: dict[str, np.ndarray], queries: int, keys: int, width: int, k: int):
        self.lists, self.plan, self.queries, self.keys, self.k = lists, plan, queries, keys, k
        self.width, self.masks = width, (width - 1) // BITS + 1
        self.rounds = int(plan["round"].max()) + 1
        self.bounds: Bounds | None = None
        self.state = 0

    def _step(self, first: int, last: int) -> tuple[Step, list[int]]:
        p = self.plan
        now = np.flatnonzero((p["round"] >= first) & (p["round"] <= last))
        slot = p["key"][now] * BANDS + p["band"][now]
        now = now[np.argsort(slot, kind="stable")]
        edges = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=self.keys * BANDS))])
        return Step(edges, p["query"][now], p["at"][now], p["weight"][now]), np.unique(p["band"][now]).tolist()

    def read(self, first: int, last: int) -> None:
        """Read the bands of rounds ``first`` to ``last`` and set the bounds anew."""
        step, bands = self._step(first, last)
        postings, old = F.col("band") >= 0, F.col("band") < 0
        docs = self.lists.read(bands + [self.state] * (self.state < 0)).groupBy("uid").agg(
            F.flatten(F.collect_list(F.when(postings, F.col("keys")))).alias("keys"),
            F.flatten(F.collect_list(F.when(postings, F.col("amounts")))).alias("amounts"),
            F.flatten(F.collect_list(F.when(old, F.col("keys")))).alias("held"),
            F.flatten(F.collect_list(F.when(old, F.col("amounts")))).alias("lower"),
            F.flatten(F.collect_list(F.when(old, F.col("met")))).alias("met"),
        )
        self.lists.append(docs.mapInArrow(_read_part(step, self.bounds, self.queries, self.masks, self.state - 1), Lists.KIND))
        if self.state < 0:
            self.lists.forget(self.state)
        self.state -= 1
        self._set_bounds(last)

    def _set_bounds(self, last: int) -> None:
        states = self.lists.read([self.state]).select(F.explode(F.arrays_zip("keys", "amounts")).alias("s")).select(
            F.col("s.keys").alias("query"), F.col("s.amounts").alias("lower"))
        bar = np.zeros(self.queries, np.int64)
        best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("lower")))
        found = states.select("query", "lower", best.alias("r")).filter(F.col("r") <= self.k).groupBy("query").agg(
            F.max(F.when(F.col("r") == self.k, F.col("lower"))).alias("bar")).filter("bar is not null").collect()
        for r in found:
            bar[r["query"]] = r["bar"]
        p = self.plan
        later = p["round"] > last
        rests = np.zeros((self.queries, self.width), np.int64)
        np.maximum.at(rests, (p["query"][later], p["at"][later]), p["bound"][later])
        self.bounds = Bounds(bar, rests.sum(1), rests)

    def live(self) -> DataFrame:
        return self.lists.read([self.state]).select("uid", "keys", "amounts", "met").mapInArrow(
            _live_part(self.bounds, self.masks), "uid long, query long, score long, unknown long")

    def run(self) -> DataFrame:
        """Rounds until every query is resolved; afterwards ``score`` is exact."""
        first, width = 0, 1
        while first < self.rounds:
            last = min(first + width, self.rounds) - 1
            self.read(first, last)
            if not (self.bounds.open & (self.bounds.rest > 0)).any():
                # no document comes in any more: done if no score is unknown, else more rounds at once
                if not self.live().filter("unknown > 0").count():
                    break
                width *= 2
            first = last + 1
        return self.live().select("uid", "query", "score")


def _search_block(terms: DataFrame, pairs: pa.Table, n_docs: int, n_terms: int, k: int) -> DataFrame | None:
    """(uid, qid, score) of all documents that may be among the best of a block's queries."""
    spark = terms.sparkSession
    qids, query = np.unique(pairs["qid"].to_numpy(), return_inverse=True)
    names = pairs["term"].combine_chunks().dictionary_encode()
    key = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((key, query))
    at = np.arange(len(order)) - np.searchsorted(query[order], np.arange(len(qids)))[query[order]]
    asked = spark.createDataFrame(pa.table({"query": query[order], "key": key[order], "at": at}))
    lists = Lists(spark)
    key_of = dict(zip(names.dictionary.to_pylist(), range(len(names.dictionary))))
    lists.append(
        terms.select("uid", "n", "terms", "tfs").mapInArrow(_lists_part(key_of, n_docs, n_terms), Lists.KIND)
        .repartition(lists.buckets, "uid"))
    plan = reading_plan(lists, asked, n_docs).toArrow()
    found = None
    if plan.num_rows:
        arrays = {c: plan[c].to_numpy().astype(np.int64) for c in plan.column_names}
        reader = _Reader(lists, arrays, len(qids), len(key_of), int(at.max()) + 1, k)
        named = spark.createDataFrame(pa.table({"query": np.arange(len(qids)), "qid": qids}))
        found = materialize(reader.run().filter("score > 0").join(named, "query").select("uid", "qid", "score"), "found")
    lists.close()
    return found


def search(queries: DataFrame, docs: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every query, equal scores by ascending doc_id."""
    spark = queries.sparkSession
    items, pairs = query_terms(queries)
    terms = document_terms(docs, pairs.select("term").distinct())
    # the two counts every weight and length needs
    n_docs, n_terms = terms.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = spark.createDataFrame([], "uid long, qid long, score long")
    blocks = -(-pairs.count() // BLOCK_PAIRS)
    for block in range(blocks if n_docs else 0):
        part = pairs.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).toArrow()
        rows = _search_block(terms, part, n_docs, n_terms, k) if part.num_rows else None
        found = found if rows is None else found.union(rows)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "uid"))
    return (
        found.join(terms.select("uid", "doc_id"), "uid").withColumn("rank", place).filter(F.col("rank") <= k)
        .join(items, "qid").select("item_id", "rank", "doc_id", "score")
    )


SEARCH_SQL = r"""
WITH folded AS (
  SELECT row_number() OVER () AS uid, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '%(t)s') AS ts
  FROM documents),
words AS (SELECT uid, doc_id, len(ts) AS n, unnest(ts) AS term FROM folded),
tfs AS (SELECT uid, doc_id, n, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT count(*) FILTER (len(ts) > 0)::BIGINT AS nd, sum(len(ts))::BIGINT AS l FROM folded),
weights AS (
  SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tfs, sizes GROUP BY term, nd),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '%(t)s')) AS term FROM benchmark),
scores AS (
  SELECT item_id, uid, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))))::BIGINT AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term), sizes GROUP BY item_id, uid, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, uid)::INTEGER AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
""" % {"t": TERM}
