"""Raw logs, session data and dictionaries as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.patterns import OUTER_SPACE, jvm_pattern
from ..operators.positions import assign_line_id

# fixed values: line formats of the two public data sets
LOG_FORMATS = {
    "BGL": "<Label> <Timestamp> <Date> <Node> <DateTime> <NodeRepeat> <Type> <Component> <Level> <Content>",
    "Thunderbird": r"<Label> <Timestamp> <Date> <User> <Month> <Day> <Time> <Location> <Component>(\[<PID>\])?:? <Content>",
}


_SEPARATOR = "\x01"


def read_raw_log(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, row, value)``; lines end at ``\\n`` only.

    (file, block, row) is the file order: a block is one input split and ``row`` grows in it.
    """
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )


def format_pattern(fmt: str) -> tuple[str, dict[str, int], set[str]]:
    """JVM pattern of a line format, group number per header, headers that may be absent.

    ``<A>`` is a field, a run of blanks any white space, all else raw pattern text.
    """
    parts, headers = [], []
    for piece in re.split(r"(<[^<>]+>)", fmt):
        if piece.startswith("<") and piece.endswith(">"):
            headers.append(piece[1:-1])
            parts.append("(.*?)")
        else:
            parts.append(jvm_pattern(re.sub(" +", lambda _: r"\s+", piece)))
    pattern = "^" + "".join(parts) + "$"
    # a group opened before a header and closed by an optional quantifier makes it optional
    numbers, optional, opened, count = {}, set(), [], 0
    names = iter(headers)
    for token in re.finditer(r"\\.|\[(?:\\.|[^\]])*\]|\(\?:|\(\.\*\?\)|\(|\)[?*]?", pattern):
        text = token.group()
        if text == "(.*?)":
            count += 1
            name = next(names)
            numbers[name] = count
            for group in opened:
                group.append(name)
        elif text == "(":
            count += 1
            opened.append([])
        elif text == "(?:":
            opened.append([])
        elif text.startswith(")"):
            inside = opened.pop()
            if len(text) > 1:
                optional.update(inside)
    # (?d): a line ends at \n alone
    return "(?d)" + pattern, numbers, optional


def parse_log_format(df: DataFrame, fmt: str, value: str = "value") -> DataFrame:
    """One text column per header of the format; lines that do not fit are dropped.

    All fields come out of one pass of the pattern: the match is rewritten as the groups with
    a separator between them.  A line that holds the separator itself is read group by group.
    """
    pattern, numbers, optional = format_pattern(fmt)
    line = F.regexp_replace(F.col(value), OUTER_SPACE, "")
    text = F.col("_line")
    groups = F.array(*[F.regexp_extract(text, pattern, n) for n in numbers.values()])
    joined = F.regexp_replace(text, pattern, _SEPARATOR.join(f"${n}" for n in numbers.values()))
    parts = F.when(
        text.contains(_SEPARATOR) | F.lit(len(numbers) == 1), F.when(text.rlike(pattern), groups)
    ).otherwise(F.split(joined, _SEPARATOR, -1))
    fields = {}
    for i, name in enumerate(numbers):
        field = F.get("_parts", F.lit(i))
        fields[name] = F.nullif(field, F.lit("")) if name in optional else field
    # a filter on the parts would be pushed below them and match each line twice, so lines that do
    # not fit are dropped by an explode of none or one
    fitting = F.filter(F.array(parts), lambda p: F.size(p) == len(numbers))
    return (
        df.withColumn("_line", line).withColumn("_parts", F.explode(fitting))
        .withColumns(fields).drop("_line", "_parts", value)
    )


def read_sessions(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None
) -> DataFrame:
    """Flat session lines.

    ``parquet`` and ``json`` hold one record per line of a session.  ``nested`` holds one JSON
    array of line records per text line, each a session, numbered by ``session_id``.
    """
    if fmt == "nested":
        if schema is None:
            raise ValueError("nested sessions need the schema of a line record")
        raw = read_raw_log(spark, path)
        sessions = assign_line_id(raw, out="session_id")
        records = F.from_json("value", f"array<struct<{schema}>>")
        return sessions.select("session_id", F.posexplode(records).alias("pos", "r")).select(
            "session_id", "pos", "r.*"
        )
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.format(fmt).load(path)


def write_sessions(
    lines: DataFrame, path: str, fmt: str = "parquet", by: str | None = "split", mode: str = "overwrite"
) -> None:
    """Flat session lines, one folder per split.

    Sessions are not nested on write, so a very long one needs no single record.
    """
    writer = lines.write.mode(mode).format(fmt)
    if by and by in lines.columns:
        writer = writer.partitionBy(by)
    writer.save(path)


def _objects(spark: SparkSession, path: str, value_type: str, whole_file: bool) -> DataFrame:
    """Entries of JSON objects, one object per text line or one (indented or not) per file.

    Text that is no such object is an error, never an empty result.
    """
    text = spark.read.text(path, wholetext=True) if whole_file else spark.read.text(path, lineSep="\n")
    entries = F.from_json("value", f"map<string,{value_type}>", {"mode": "FAILFAST"})
    return text.filter(F.trim("value") != "").select(F.explode(entries).alias("key", "entry"))


def read_template_map(spark: SparkSession, path: str, whole_file: bool = False, flat: bool = False) -> DataFrame:
    """``(content, template)`` from JSON objects; a template may be null.

    ``whole_file`` reads one object per file, as people write it. A dictionary too large for that is
    kept ``flat``: one ``{"content": ..., "template": ...}`` per line.
    """
    if flat:
        return spark.read.schema("content string, template string").option("mode", "FAILFAST").json(path)
    return _objects(spark, path, "string", whole_file).select(
        F.col("key").alias("content"), F.col("entry").alias("template")
    )


def read_verdicts(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """``(query, prediction, analysis, examples)`` from JSON objects, cache or human feedback.

    ``whole_file`` reads one object per file, as people write it.
    """
    entry = "struct<prediction:string,analysis:string,examples:array<struct<query:string,answer:string>>>"
    return _objects(spark, path, entry, whole_file).select(F.col("key").alias("query"), "entry.*")


def write_verdicts(verdicts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Verdicts as JSON objects, one per text line, readable by ``read_verdicts``."""
    rest = [c for c in verdicts.columns if c != "query"]
    entry = F.create_map(F.col("query"), F.struct(*rest))
    verdicts.select(F.to_json(entry).alias("value")).write.mode(mode).text(path)
