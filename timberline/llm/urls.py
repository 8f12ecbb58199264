"""URL filters: host and path rules, then association rules of URL tokens mined from what the rules judge.

Pages that a rule judges are the labelled rows. Their URL tokens and verdict are the baskets of Spark's
parallel FP-growth; frequent token sets that imply a verdict with enough confidence and support become
association rules. A rule is indexed under its least frequent token, so a page looks up only rules
that one of its tokens names, and a candidate is kept if the page has all its tokens. The rule with
most tokens wins, then confidence, then support, then block. Pages are matched once per distinct token
set, so a hot host costs one row per set.

Defined results: a null url, or one without ``://``, has an empty host and path, no tokens and is
allowed; a page no rule fits is allowed; repeated rows are judged each; with nothing labelled no rule
is mined; an empty table gives an empty result. Only ``page_id`` and ``url`` are read.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from timberline.session import materialize

#: Host and path rules of the filter: fixed values.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
MIN_SUPPORT = 0.002
#: Labelled pages that a rule needs at least, in small tables.
MIN_PAGES = 5
MIN_CONFIDENCE = 0.9
DEFAULT = "allow"


def host_of(url: str) -> Column:
    raw = F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def tokens_of(host: Column, path: Column, url: str) -> Column:
    """Distinct sorted tokens: top-level label, other host words, path words by depth of the first, query keys."""
    labels = F.split(host, r"\.")
    words = lambda text, mark: F.transform(F.filter(
        F.split(F.regexp_replace(F.lower(text), r"\d+", "0"), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.concat(F.lit(mark), w))
    query = F.coalesce(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("k="), F.lower(F.substring_index(x, "=", 1))))
    top = F.when(host == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("t="), F.element_at(labels, -1))))
    rest = F.array_join(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), " ")
    first = F.regexp_extract(path, r"^/([^/]*)/", 1)
    deeper = F.filter(words(F.regexp_replace(path, r"^/[^/]*/", "/"), "w="), lambda w: w != "w=0")
    return F.array_sort(F.array_distinct(F.concat(top, words(rest, "h="), words(first, "p="), deeper, keys)))


def mine(tokens: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Association rules (antecedent, verdict, confidence, support, anchor) from ``tokens(tokens, verdict)``."""
    baskets = tokens.filter("verdict is not null").select(
        F.concat("tokens", F.array(F.concat(F.lit("y="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    is_label = lambda x: x.startswith("y=")
    rules = model.associationRules.filter(is_label(F.col("consequent")[0]) & ~F.exists("antecedent", is_label)).select(
        F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 3, 100).alias("verdict"), "confidence", "support")
    singles = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    anchors = rules.select("antecedent", F.explode("antecedent").alias("token")).join(singles, "token").groupBy("antecedent").agg(
        F.min_by("token", F.struct("freq", "token")).alias("anchor"))
    return rules.join(anchors, "antecedent")


def match(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """Best rule for each distinct token set: (key, said, antecedent, confidence)."""
    named = keys.select("key", "tokens", F.explode("tokens").alias("anchor"))
    hits = named.join(rules.hint("merge"), "anchor").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = hits.groupBy("key").agg(F.max(F.struct(
        F.size("antecedent").alias("n"), "confidence", "support", "verdict", "antecedent")).alias("best"))
    return best.select("key", F.col("best.verdict").alias("said"), F.col("best.antecedent").alias("antecedent"), F.col("best.confidence").alias("confidence"))


def judge(pages: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, by, antecedent, confidence) of every page."""
    urls = pages.select("page_id", "url", host_of("url").alias("host"), path_of("url").alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = urls.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"),
                       tokens_of(F.col("host"), F.col("path"), "url").alias("tokens"))
    rows = materialize(rows.withColumn("key", F.array_join("tokens", " ")), "urls")
    labelled = rows.filter("verdict is not null").count()
    if not labelled:
        return rows.select("page_id", "host", "path", "rule", F.lit(DEFAULT).alias("verdict"), F.lit("default").alias("by"),
                           F.lit(None).cast("array<string>").alias("antecedent"), F.lit(None).cast("double").alias("confidence"))
    mined = materialize(mine(rows, max(min_support, min(1.0, MIN_PAGES / labelled)), min_confidence), "rules")
    said = materialize(match(rows.groupBy("key").agg(F.first("tokens").alias("tokens")), mined), "said")
    return rows.join(said.hint("merge"), "key", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", "said", F.lit(DEFAULT)).alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule").when(F.col("said").isNotNull(), "mined").otherwise("default").alias("by"),
        "antecedent", "confidence",
    )
