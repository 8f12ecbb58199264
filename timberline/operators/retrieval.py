"""Exact nearest neighbours by squared L2 distance, and growth of the candidate table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .positions import dense_position, id_cells

# values (rows x dimension) of one candidate block, 32 MB as doubles
BLOCK_VALUES = 1 << 22
# queries compared with one block in one go: the least, so that small tables use all cores, see _chunk_rows
QUERY_CHUNK = 1024
MAX_PIVOTS = 256


def append_candidates(
    candidates: DataFrame, new_rows: DataFrame, order: str = "seq", id_col: str = "id"
) -> DataFrame:
    """Add rows with consecutive ids after the present ones, in the order of ``order``."""
    top = candidates.agg(F.coalesce(F.max(id_col), F.lit(-1)).alias("m")).scalar()
    coarse, fine = id_cells(order)
    fresh = dense_position(new_rows, coarse, fine, [order], out="_pos")
    fresh = fresh.withColumn(id_col, F.col("_pos") + top)
    return candidates.unionByName(fresh.select(*candidates.columns))


def topk_neighbours(
    distances: DataFrame,
    k: int,
    query: str = "query_id",
    candidate: str = "candidate_id",
    distance: str = "distance",
) -> DataFrame:
    """The ``k`` nearest per query (ties: smaller id); ``rank`` 1 is the nearest.

    The limit is applied in every partition before the shuffle.
    """
    nearest = Window.partitionBy(query).orderBy(distance, candidate)
    return distances.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    if len(column) == 0:
        return np.empty((0, dim))
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _nearest_pivot(pivots: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                gap = np.sqrt(_squared(_matrix(batch["embedding"], pivots.shape[1]), pivots))
                cell = gap.argmin(axis=1)
                yield batch.assign(cell=cell, radius=gap[np.arange(len(cell)), cell])

    return run


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def _block_topk(k: int):
    """Top-k of one block of candidates for one chunk of queries."""

    def run(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "candidate_id": [], "distance": []}
        if len(queries) and len(block):
            dim = len(block["embedding"].iloc[0])
            cand, ids = _matrix(block["embedding"], dim), block["id"].to_numpy()
            step = max(1, (1 << 22) // len(cand))
            for lo in range(0, len(queries), step):
                part = queries.iloc[lo:lo + step]
                q = _matrix(part["embedding"], dim)
                rough = _squared(q, cand)
                kth = np.partition(rough, min(k, len(cand)) - 1, axis=1)[:, min(k, len(cand)) - 1]
                # rounding room of the product form, then exact distances of what is left
                slack = 1e-9 * (1.0 + (q * q).sum(1) + (cand * cand).sum(1).max())
                for row, qid in enumerate(part["query_id"]):
                    close = np.flatnonzero(rough[row] <= kth[row] + slack[row])
                    diff = cand[close] - q[row]
                    dist = (diff * diff).sum(1)
                    pick = np.lexsort((ids[close], dist))[:k]
                    out["query_id"].extend([qid] * len(pick))
                    out["candidate_id"].extend(ids[close][pick])
                    out["distance"].extend(dist[pick])
        return pd.DataFrame(out).astype(
            {"query_id": "int64", "candidate_id": "int64", "distance": "float64"}
        )

    return run


def _chunk_rows(visits: int, block_rows: int, cores: int) -> int:
    """Queries of a chunk: a few chunks for each core, and as many rows as a block once there is work for all.

    A block is copied for each chunk and a query for each block, so with chunks much smaller than blocks
    the copies of blocks outgrow those of queries.
    """
    return max(QUERY_CHUNK, min(block_rows, math.ceil(visits / (4 * cores))))


def _compare(queries: DataFrame, blocks: DataFrame, visits: DataFrame, k: int, block_rows: int) -> DataFrame:
    """Distances of the visited (query, block) pairs, reduced to ``k`` per pair of chunks.

    A block wanted by many queries is copied once per chunk of them, so a group holds at most
    one block and about as many queries.
    """
    chunk_rows = _chunk_rows(visits.count(), block_rows, queries.sparkSession.sparkContext.defaultParallelism)
    wanted = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).alias("chunks"))
    left = (
        visits.join(wanted, "block")
        .withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")))
        .join(queries, "query_id")
        .select("block", "chunk", "query_id", "embedding")
    )
    right = (
        blocks.select("block", "id", "embedding").join(wanted, "block")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
        .select("block", "chunk", "id", "embedding")
    )
    return (
        left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk"))
        .applyInPandas(_block_topk(k), "query_id long, candidate_id long, distance double")
    )


def knn_join(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    query_id: str = "query_id",
    candidate_id: str = "id",
    embedding: str = "embedding",
    block_rows: int | None = None,
) -> DataFrame:
    """Exact ``k`` nearest candidates per query: ``(query_id, candidate_id, distance, rank)``.

    ``distance`` is the squared L2 distance and ``rank`` counts the farthest of the ``k`` as 1,
    the order in which examples are delivered.  With fewer than ``k`` candidates, fewer rows.

    Candidates are put into cells around pivots and cells into blocks of bounded size.  Each
    query first looks into the blocks around its own pivot; the k-th distance found there and
    the triangle inequality tell which other blocks can hold a nearer one, and only those are
    visited.  The pruning is exact: a block is skipped only if its bound exceeds that distance.
    """
    # single precision is copied as such and compared in double
    given = {df.schema[embedding].dataType.simpleString() for df in (queries, candidates)}
    kind = "array<float>" if given == {"array<float>"} else "array<double>"
    cand = materialize(
        candidates.select(
            F.col(candidate_id).cast("long").alias("id"),
            F.col(embedding).cast(kind).alias("embedding"),
        ),
        "candidates",
    )
    qs = materialize(
        queries.select(
            F.col(query_id).cast("long").alias("query_id"),
            F.col(embedding).cast(kind).alias("embedding"),
        ),
        "queries",
    )
    n = cand.count()
    if n == 0:
        return cand.sparkSession.createDataFrame(
            [], "query_id long, candidate_id long, distance double, rank int"
        )
    dim = len(cand.select("embedding").head()[0])
    rows = block_rows or max(k, BLOCK_VALUES // dim)
    # as many pivots as blocks, at most MAX_PIVOTS vectors on the driver
    n_pivots = min(MAX_PIVOTS, math.ceil(n / rows))
    pivots = _matrix(
        cand.orderBy(F.xxhash64("id"), "id").limit(n_pivots).toPandas()["embedding"], dim
    )

    celled = materialize(
        cand.mapInPandas(
            _nearest_pivot(pivots), f"id long, embedding {kind}, cell int, radius double"
        ),
        "celled",
    )
    sizes = celled.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / rows).alias("parts"), F.max("radius").alias("reach")
    )
    # rings of equal width around the pivot, then hash parts: copies fall apart by id
    ring = F.least(
        F.floor(F.coalesce(F.try_divide("radius", "reach"), F.lit(0.0)) * F.col("parts")),
        F.col("parts") - 1,
    )
    ringed = celled.join(F.broadcast(sizes), "cell").withColumn("ring", ring)
    rings = ringed.groupBy("cell", "ring").agg(F.ceil(F.count(F.lit(1)) / rows).alias("slices"))
    blocks = materialize(
        ringed.join(rings, ["cell", "ring"])
        .withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")))
        .withColumn("block", F.concat_ws("-", "cell", "ring", "slice"))
        .select("block", "cell", "radius", "id", "embedding"),
        "blocks",
    )
    extents = blocks.groupBy("cell", "block").agg(
        F.min("radius").alias("near"), F.max("radius").alias("far"), F.count(F.lit(1)).alias("n")
    )

    # distance of every query to every pivot: an array of at most MAX_PIVOTS values
    located = materialize(
        qs.mapInPandas(_pivot_gaps(pivots), "query_id long, cell int, gaps array<double>"), "gaps"
    )

    def bound(gap):
        """No candidate between ``near`` and ``far`` of the pivot is nearer to the query."""
        return F.greatest(F.lit(0.0), gap - F.col("far"), F.col("near") - gap)

    # first visit: the most promising blocks of the query's own cell until k rows are at hand
    own = located.select("query_id", "cell", F.get("gaps", "cell").alias("gap")).join(extents, "cell")
    by_bound = Window.partitionBy("query_id").orderBy("bound", "block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    visited = materialize(
        own.withColumn("bound", bound(F.col("gap")))
        .withColumn("before", F.coalesce(F.sum("n").over(by_bound), F.lit(0)))
        .filter(F.col("before") < k)
        .select("query_id", "block"),
        "visits",
    )
    first = materialize(topk_neighbours(_compare(qs, blocks, visited, k, rows), k), "first")
    kth = first.groupBy("query_id").agg(F.max("distance").alias("kth"), F.count(F.lit(1)).alias("got"))

    # second visit: every block that can hold a nearer candidate; whole cells fall out first
    cells = extents.groupBy("cell").agg(F.min("near").alias("near"), F.max("far").alias("far"))
    limit = F.when(F.col("got") < k, F.lit(float("inf"))).otherwise(F.sqrt("kth"))
    # bound and limit are rounded values, so leave room on the safe side
    in_reach = bound(F.col("gap")) <= F.col("limit") * (1 + 1e-6) + 1e-6
    open_cells = (
        located.join(kth, "query_id")
        .select("query_id", limit.alias("limit"), F.posexplode("gaps").alias("cell", "gap"))
        .join(F.broadcast(cells), "cell")  # at most MAX_PIVOTS rows
        .filter(in_reach)
        .select("query_id", "limit", "cell", "gap")
    )
    open_blocks = (
        open_cells.join(extents, "cell").filter(in_reach)
        .select("query_id", "block")
        .join(visited, ["query_id", "block"], "left_anti")
    )
    second = _compare(qs, blocks, materialize(open_blocks, "visits"), k, rows)
    found = topk_neighbours(first.drop("rank").unionByName(second), k)
    farthest_first = Window.partitionBy("query_id").orderBy(F.desc("distance"), F.desc("candidate_id"))
    return found.withColumn("rank", F.row_number().over(farthest_first))


def _pivot_gaps(pivots: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                gap = np.sqrt(_squared(_matrix(batch["embedding"], pivots.shape[1]), pivots))
                yield pd.DataFrame({
                    "query_id": batch["query_id"].to_numpy(),
                    "cell": gap.argmin(axis=1).astype(np.int32),
                    "gaps": list(gap),
                })

    return run


def examples_of(
    neighbours: DataFrame, candidates: DataFrame, candidate_id: str = "id",
    text: str = "text", answer: str = "answer",
) -> DataFrame:
    """``(query_id, examples)``: the neighbours' texts and answers, farthest first."""
    named = candidates.select(
        F.col(candidate_id).alias("candidate_id"), F.col(text).alias("query"), F.col(answer).alias("answer")
    )
    return (
        neighbours.join(named, "candidate_id")
        # k rows per query
        .groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "query", "answer"))).alias("e"))
        .select(
            "query_id",
            F.transform(
                "e", lambda x: F.struct(x["query"].alias("query"), x["answer"].alias("answer"))
            ).alias("examples"),
        )
    )
