"""Labelled examples per query and the prompt made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.text import build_prompt, example_answer
from ..operators.positions import dense_position, id_cells
from ..operators.retrieval import examples_of, knn_join
from ..operators.windows import first_occurrence


def example_candidates(
    lines: DataFrame, template: str = "event_template", order: Sequence[str] = ("line_id",)
) -> DataFrame:
    """``(id, text, answer, embedding)`` from the first labelled line of each template."""
    unique = first_occurrence(lines, template, order)
    coarse, fine = id_cells(order[-1])
    numbered = dense_position(unique, coarse, fine, list(order), out="_pos")
    return numbered.select(
        (F.col("_pos") - 1).alias("id"),
        F.col(template).alias("text"),
        example_answer("label", template).alias("answer"),
        "embedding",
    )


def retrieve_examples(queries: DataFrame, candidates: DataFrame, k: int = 1) -> DataFrame:
    """``(query_id, query, examples, prompt)`` for queries ``(query_id, query, embedding)``."""
    found = examples_of(knn_join(queries, candidates, k), candidates)
    none = F.array().cast("array<struct<query:string,answer:string>>")
    joined = queries.select("query_id", "query").join(found, "query_id", "left").withColumn(
        "examples", F.coalesce("examples", none)
    )
    return build_prompt(joined)
