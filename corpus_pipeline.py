"""From raw documents to packed sequences: five stages, each over all its predecessor kept.

Every stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the
next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timberline.llm import exact, fm, omh, packing, rules
from timberline.llm.queries import word_tokenizer
from timberline.llm.tables import table
from timberline.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove boilerplate lines; rejected documents go."""
    return rules.cleaned(docs, rules.quality_rules(docs))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of low quality go."""
    return fm.keep_predicted(docs, fm.train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact.exact_unique(docs, exact.exact_dedup(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return omh.without_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that stay, in sequences of several context sizes."""
    return packing.pack_documents(docs, word_tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("packing", pack),
]

#: The stages after the first rest on hashes, a trained model and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
