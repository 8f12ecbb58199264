"""Nearest neighbours, candidates and example prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators import retrieval as R
from timberline.operators.positions import chronological_split
from timberline.plans.examples import example_candidates, retrieve_examples

from . import inputs as I
from .registry import query
from .text import SQL_ANSWER, sql_prompt

_DIST = "list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _knn(k: int) -> str:
    return f"""pairs as (select q.id query_id, c.id candidate_id, {_DIST} distance from vectors q cross join vectors c),
near as (select *, row_number() over (partition by query_id order by distance, candidate_id) r from pairs),
knn as (select query_id, candidate_id, distance,
  row_number() over (partition by query_id order by distance desc, candidate_id desc) rank from near where r <= {k})"""


def _neighbours(spark, sf, k):
    v = I.vectors(spark, sf)
    return R.knn_join(v.select(F.col("id").alias("query_id"), "embedding"), v, k)


@query(
    "knn_join",
    f"with {I.VECTORS}, {_knn(3)} select query_id, candidate_id, rank, round(distance, 6) distance from knn",
)
def knn_join(spark, sf):
    return _neighbours(spark, sf, 3).withColumn("distance", F.round("distance", 6))


@query(
    "topk_neighbours",
    f"""with {I.VECTORS}, {_knn(2)} select query_id, candidate_id, round(distance, 6) distance,
    row_number() over (partition by query_id order by distance, candidate_id) rank from knn""",
)
def topk_neighbours(spark, sf):
    wider = _neighbours(spark, sf, 4).drop("rank")
    return R.topk_neighbours(wider, 2).withColumn("distance", F.round("distance", 6))


@query(
    "append_candidates",
    f"""with {I.VECTORS}, base as (select row_number() over (order by id) - 1 id, text from vectors where label = 0)
    select id, text from base union all
    select (select max(id) from base) + row_number() over (order by id), text from vectors where label = 1""",
)
def append_candidates(spark, sf):
    v = I.vectors(spark, sf).withColumnRenamed("id", "seq")
    none = v.select(F.col("seq").alias("id"), "text").limit(0)
    base = R.append_candidates(none, v.filter("label = 0").select("seq", "text"))
    return R.append_candidates(base, v.filter("label = 1").select("seq", "text"))


@query(
    "retrieve_examples",
    f"""with {I.VECTORS},
    cut as (select *, row_number() over (order by id) p, floor(count(*) over () * 0.8::double) n from vectors),
    cand as (select p - 1 id, text, embedding, {SQL_ANSWER.format(l='label', t='text')} answer from cut where p <= n),
    pairs as (select q.id query_id, q.text query, c.text, c.answer, {_DIST} distance, c.id cid
      from cut q cross join cand c where q.p > q.n),
    near as (select *, row_number() over (partition by query_id order by distance, cid) r from pairs),
    shots as (select query_id, query, list({{'query': text, 'answer': answer}} order by distance desc, cid desc) examples
      from near where r <= 2 group by all)
    select query_id, {sql_prompt('examples', 'query')} prompt from shots""",
)
def retrieve(spark, sf):
    v = chronological_split(I.vectors(spark, sf), 0.8, ts=None, line_id="id")
    train = v.filter("split = 'train'").withColumnRenamed("id", "line_id").withColumnRenamed("text", "event_template")
    test = v.filter("split = 'test'").select(F.col("id").alias("query_id"), F.col("text").alias("query"), "embedding")
    return retrieve_examples(test, example_candidates(train), 2).select("query_id", "prompt")
