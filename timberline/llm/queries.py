"""Registered queries of the operators, each over its whole table, and their DuckDB twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, counts, exact, fm, html, omh, packing, pieces, rules, runs, s8b, search, urls
from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def word_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def byte_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_model()
    return pieces.encode(table(spark, sf_dir, "documents"), model, pieces.summing(model))


@query
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


ORACLE["op3_exact_dedup"] = exact.EXACT_SQL


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of every conversation's transcript, by a model of four fifths of the conversations."""
    lines = chat.transcripts(table(spark, sf_dir, "conversations"))
    known = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 != 0
    return chat.parse(lines, chat.fit(lines.filter(known)))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents")).drop("removed_lines", "digest")


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())


@query
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.train(pages))


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fm.score(docs, fm.train(docs, table(spark, sf_dir, "labels")))


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.near_duplicates(table(spark, sf_dir, "documents")).drop("digest")


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s8b.token_files(table(spark, sf_dir, "documents"), word_tokenizer())


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.periodic_runs(runs.planted(table(spark, sf_dir, "documents"))))


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counts.token_counts(table(spark, sf_dir, "documents"), byte_tokenizer())
    return found.withColumn("over_limit", F.col("n_tokens") > 1024)


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


ORACLE["op13_ranked_search"] = search.SEARCH_SQL
