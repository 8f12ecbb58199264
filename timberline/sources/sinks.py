"""Reports, run records and fitted models on storage."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_report_csv(df: DataFrame, path: str, quote_all: bool = True, mode: str = "overwrite") -> None:
    """CSV with a header; all fields quoted, or only where needed."""
    (
        df.write.mode(mode).option("header", True).option("quoteAll", quote_all)
        .option("escape", '"').csv(path)
    )


def run_id(params: Mapping[str, object], keys: Sequence[str] | None = None) -> str:
    """Sorted-key JSON of the chosen parameters, the text that is hashed to the run id."""
    chosen = {k: params[k] for k in (keys if keys is not None else params)}
    return json.dumps(chosen, sort_keys=True)


def append_results(
    metrics_df: DataFrame,
    params: Mapping[str, object],
    path: str | None = None,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """One run record: id, all parameters, metrics.  Appended to ``path`` when given."""
    chosen = run_id(params, keys)
    record = metrics_df.select(
        F.substring(F.sha2(F.lit(chosen), 256), 1, 8).alias("expname"),
        *[F.lit(v).alias(k) for k, v in params.items()],
        *metrics_df.columns,
    )
    if path:
        record.write.mode("append").option("header", True).csv(path)
    return record


def save_model(model, path: str) -> None:
    """One Parquet table per relation of a model, plus its plain settings."""
    spark = None
    settings = {}
    for field in fields(model):
        value = getattr(model, field.name)
        if isinstance(value, DataFrame):
            spark = value.sparkSession
            value.write.mode("overwrite").parquet(f"{path}/{field.name}")
        elif hasattr(value, "__dataclass_fields__"):
            save_model(value, f"{path}/{field.name}")
        else:
            settings[field.name] = value
    if spark is None:
        raise ValueError("the model holds no table")
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "settings string").write.mode(
        "overwrite"
    ).json(f"{path}/_settings_json")


def load_model(spark: SparkSession, path: str, kind: type, nested: Mapping[str, type] | None = None):
    """Load a model of dataclass ``kind``; ``nested`` names the classes of nested models."""
    text = spark.read.schema("settings string").json(f"{path}/_settings_json").head()[0]
    values = json.loads(text)
    for field in fields(kind):
        if field.name in values:
            continue
        if nested and field.name in nested:
            values[field.name] = load_model(spark, f"{path}/{field.name}", nested[field.name])
        else:
            values[field.name] = spark.read.parquet(f"{path}/{field.name}")
    return kind(**values)
