"""Count-based n-gram classifier over token sequences."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import ngrams
from ..session import materialize
from .positions import cell_starts, running_counts

SMOOTHING = 1e-5
# n-grams with at least this share of all occurrences are joined from a broadcast table of at
# most 1 / HOT_SHARE rows
HOT_SHARE = 1e-4


@dataclass
class NgramCounts:
    """``class_counts(label, n, first_seq)`` and ``ngram_counts(ngram, label, n)``."""

    class_counts: DataFrame
    ngram_counts: DataFrame
    n: int = 1

    def materialize(self, stay: int = 0) -> "NgramCounts":
        return NgramCounts(
            materialize(self.class_counts, "class_counts", stay),
            materialize(self.ngram_counts, "ngram_counts", stay),
            self.n,
        )


def nb_fit(
    docs: DataFrame,
    n: int = 1,
    tokens: str = "tokens",
    label: str = "label",
    order: str = "line_id",
    weight: str | None = None,
) -> NgramCounts:
    """Documents per class and occurrences per (n-gram, class).

    ``weight`` holds the number of copies a row stands for.
    """
    w = F.col(weight) if weight else F.lit(1)
    class_counts = docs.groupBy(F.col(label).alias("label")).agg(
        F.sum(w).alias("n"), F.min(order).alias("first_seq")
    )
    ngram_counts = (
        docs.select(F.explode(ngrams(tokens, n)).alias("ngram"), F.col(label).alias("label"), w.alias("_w"))
        .groupBy("ngram", "label").agg(F.sum("_w").alias("n"))
    )
    return NgramCounts(class_counts, ngram_counts, n)


def add_counts(a: NgramCounts, b: NgramCounts) -> NgramCounts:
    """Counts after further documents; classes keep their earliest sequence number."""
    classes = a.class_counts.unionByName(b.class_counts).groupBy("label").agg(
        F.sum("n").alias("n"), F.min("first_seq").alias("first_seq")
    )
    grams = a.ngram_counts.unionByName(b.ngram_counts).groupBy("ngram", "label").agg(
        F.sum("n").alias("n")
    )
    return NgramCounts(classes, grams, a.n)


def label_mass(ngram_counts: DataFrame) -> DataFrame:
    """Per class: distinct n-grams, occurrences and mean occurrences per distinct n-gram."""
    return ngram_counts.groupBy("label").agg(
        F.count(F.lit(1)).alias("ngrams"),
        F.sum("n").alias("occurrences"),
        F.avg("n").alias("mean_count"),
    )


def ngram_totals(ngram_counts: DataFrame) -> DataFrame:
    """One row per n-gram with its count in each class."""
    return ngram_counts.groupBy("ngram").agg(
        F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("n"))), F.lit(0)).alias("n0"),
        F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("n"))), F.lit(0)).alias("n1"),
        F.sum("n").alias("total"),
    )


@dataclass
class Scorer:
    """Log terms per known n-gram and the constants of everything else."""

    terms: DataFrame  # ngram, t0, t1, total
    hot_floor: float
    unseen: tuple[float, float]
    priors: dict[int, float]
    first_class: int
    n: int

    def verdict(self, s0: Column, s1: Column) -> Column:
        if len(self.priors) == 1:
            return F.lit(next(iter(self.priors)))
        wins = s1 > s0 if self.first_class == 0 else s1 >= s0
        return wins.cast("int")


def build_scorer(model: NgramCounts, emphasize: bool = True) -> Scorer:
    """Turn counts into log terms once, so that scoring only adds them up.

    A term is log((count in class + a) / (count in all classes + a V)).  With ``emphasize``, an
    n-gram never seen in class 1 gets log((mean class-1 count + 1) / (count + V)) there, which
    leans towards the anomaly.  V is the number of distinct fitted n-grams.
    """
    totals = materialize(ngram_totals(model.ngram_counts), "ngrams")
    stats = totals.agg(
        F.count(F.lit(1)).alias("v"),
        F.coalesce(F.sum("n1"), F.lit(0)).alias("mass1"),
        F.count_if(F.col("n1") > 0).alias("seen1"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("mass"),
    ).head()
    # the scores are of two classes: another label is an error, not a document to leave out
    other = model.class_counts.filter(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).head()
    if other is not None:
        raise ValueError(f"label {other['label']!r} is neither 0 nor 1")
    classes = {r["label"]: r for r in model.class_counts.orderBy("label").collect()}
    if not classes:
        raise ValueError("the model holds no class")
    n_docs = sum(r["n"] for r in classes.values())
    mean1 = stats["mass1"] / stats["seen1"] if stats["seen1"] else 0.0
    # an empty model leaves no n-gram to compare with
    v = max(stats["v"], 1)

    def smooth(count, total):
        return (count + SMOOTHING) / (total + SMOOTHING * v)

    lean = (mean1 + 1) / (F.col("total") + v)
    p1 = smooth(F.col("n1"), F.col("total"))
    if emphasize:
        p1 = F.when(F.col("n1") == 0, lean).otherwise(p1)
    terms = totals.select(
        "ngram",
        F.log(smooth(F.col("n0"), F.col("total"))).alias("t0"),
        F.log(p1).alias("t1"),
        "total",
    )
    unseen1 = (mean1 + 1) / v if emphasize else smooth(0, 0)
    return Scorer(
        terms=terms,
        hot_floor=max(1.0, stats["mass"] * HOT_SHARE),
        unseen=(math.log(smooth(0, 0)), math.log(unseen1)),
        priors={c: math.log(r["n"] / n_docs) for c, r in classes.items()},
        first_class=min(classes.values(), key=lambda r: r["first_seq"])["label"],
        n=model.n,
    )


def nb_score(
    docs: DataFrame,
    model: NgramCounts | Scorer,
    emphasize: bool = True,
    tokens: str = "tokens",
    doc_id: str = "line_id",
) -> DataFrame:
    """``(doc_id, score_0, score_1, prediction)`` per document.

    Frequent n-grams meet their terms in a broadcast join of bounded size; only the rare rest
    is shuffled by n-gram.  Documents without n-grams are scored on the priors.
    """
    scorer = model if isinstance(model, Scorer) else build_scorer(model, emphasize)
    grams = ngrams(tokens, scorer.n)
    # frequent n-grams are looked up where they lie and added up per document; the others keep their key for
    # the shuffled look-up, and nothing is gathered by document and n-gram before it
    exploded = docs.select(doc_id, F.explode(grams).alias("ngram"))
    hot = scorer.terms.filter(F.col("total") >= scorer.hot_floor).select("ngram", "t0", "t1")
    rare = scorer.terms.filter(F.col("total") < scorer.hot_floor).select("ngram", "t0", "t1")
    warm = exploded.join(F.broadcast(hot), "ngram").select(doc_id, "t0", "t1")
    cold = (
        exploded.filter("ngram is not null").join(F.broadcast(hot.select("ngram")), "ngram", "left_anti")
        .join(rare, "ngram", "left")
        .select(doc_id, *[F.coalesce(f"t{c}", F.lit(scorer.unseen[c])).alias(f"t{c}") for c in (0, 1)])
    )
    none = docs.select(doc_id, F.lit(0.0).alias("t0"), F.lit(0.0).alias("t1"))
    sums = warm.unionByName(cold).unionByName(none).groupBy(doc_id).agg(F.sum("t0").alias("t0"), F.sum("t1").alias("t1"))
    # a class without documents cannot win and has no score
    prior = {c: F.lit(scorer.priors.get(c)).cast("double") for c in (0, 1)}
    scored = sums.select(
        doc_id, (F.col("t0") + prior[0]).alias("score_0"), (F.col("t1") + prior[1]).alias("score_1")
    )
    return scored.withColumn("prediction", scorer.verdict(F.col("score_0"), F.col("score_1")))


def nb_score_running(
    docs: DataFrame,
    base: NgramCounts,
    emphasize: bool = True,
    tokens: str = "tokens",
    label: str = "label",
    order: str = "line_id",
) -> DataFrame:
    """``(order, score_0, score_1, prediction)`` where every document is first scored, then counted.

    A document meets the counts of ``base`` and of all documents before it by the unique integer
    ``order``, as a pass over one document after the other would. What it needs of them are running sums:
    of its n-grams by n-gram, of documents, distinct n-grams and class-1 occurrences over all documents.
    So the pass is four windows over bounded cells, not a loop. Scores are those of ``nb_score``.
    """
    # dealt out: late documents, as those judged mostly are, lie in a few files
    tasks = 2 * docs.sparkSession.sparkContext.defaultParallelism
    rows = materialize(
        docs.select(F.col(order).cast("long").alias("_i"), F.col(label).alias("_label"), ngrams(tokens, base.n).alias("_grams"))
        .repartition(tasks, "_i"), "running_docs")
    other = rows.select("_label").union(base.class_counts.select("label")).filter(
        ~F.coalesce(F.col("_label").isin(0, 1), F.lit(False))).head()
    if other is not None:
        raise ValueError(f"label {other[0]!r} is neither 0 nor 1")
    known = ngram_totals(base.ngram_counts).select(F.col("ngram").alias("_g"), F.col("n0").alias("b0"), F.col("n1").alias("b1"))
    one = F.col("_label") == 1
    held = (
        rows.select("_i", "_label", F.explode("_grams").alias("_g"))
        .groupBy("_g", "_i", "_label").agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({"_own0": F.when(~one, F.col("_n")).otherwise(0), "_own1": F.when(one, F.col("_n")).otherwise(0)})
    )
    starts = cell_starts(rows.select("_i"), "_i")
    counted = running_counts(held, ["_g"], "_i", {"_r0": "_own0", "_r1": "_own1"}, starts=starts).join(known, "_g", "left")
    n0 = F.coalesce("b0", F.lit(0)) + F.col("_r0") - F.col("_own0")
    n1 = F.coalesce("b1", F.lit(0)) + F.col("_r1") - F.col("_own1")
    counted = materialize(counted.select("_i", "_label", "_n", n0.alias("_n0"), n1.alias("_n1")), "running_grams")
    # what a document adds to the totals: n-grams seen for the first time, in any class and in class 1
    added = counted.groupBy("_i").agg(
        F.count_if(F.col("_n0") + F.col("_n1") == 0).alias("_new"),
        F.sum(F.when(one, F.col("_n")).otherwise(0)).alias("_mass1"),
        F.count_if(one & (F.col("_n1") == 0)).alias("_new1"),
    )
    own = {"_docs0": "_is0", "_docs1": "_is1", "_v": "_new", "_ones": "_mass1", "_seen1": "_new1"}
    steps = rows.select("_i", "_label").join(added, "_i", "left").na.fill(0, ["_new", "_mass1", "_new1"]).withColumns(
        {"_is0": (~one).cast("long"), "_is1": one.cast("long")})
    totals = running_counts(steps, [], "_i", own)
    start = materialize(ngram_totals(base.ngram_counts), "ngrams").agg(
        F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n1"), F.lit(0)).alias("ones"), F.count_if(F.col("n1") > 0).alias("seen1")).head()
    classes = {r["label"]: r for r in base.class_counts.collect()}
    held_before = {
        "_docs0": classes[0]["n"] if 0 in classes else 0, "_docs1": classes[1]["n"] if 1 in classes else 0,
        "_v": start["v"], "_ones": start["ones"], "_seen1": start["seen1"],
    }
    if classes:  # a class met later comes second
        first = min(classes.values(), key=lambda r: r["first_seq"])["label"]
    else:
        lowest = rows.agg(F.min_by("_label", "_i")).head()[0]
        first = 0 if lowest is None else lowest
    totals = totals.select("_i", *[(F.col(c) - F.col(v) + F.lit(held_before[c])).alias(c) for c, v in own.items()])
    v, mean1 = F.greatest("_v", F.lit(1)), F.coalesce(F.try_divide("_ones", "_seen1"), F.lit(0.0))
    total = F.col("_n0") + F.col("_n1")

    def smooth(count: Column) -> Column:
        return (count + SMOOTHING) / (total + SMOOTHING * v)

    p1 = smooth(F.col("_n1"))
    if emphasize:
        p1 = F.when(F.col("_n1") == 0, (mean1 + 1) / (total + v)).otherwise(p1)
    sums = counted.join(totals, "_i").groupBy("_i").agg(
        F.sum(F.col("_n") * F.log(smooth(F.col("_n0")))).alias("_t0"), F.sum(F.col("_n") * F.log(p1)).alias("_t1"))
    n_docs = F.col("_docs0") + F.col("_docs1")
    score = {c: F.when(F.col(f"_docs{c}") > 0, F.coalesce(f"_t{c}", F.lit(0.0)) + F.log(F.col(f"_docs{c}") / n_docs)) for c in (0, 1)}
    wins = F.col("score_1") > F.col("score_0") if first == 0 else F.col("score_1") >= F.col("score_0")
    verdict = F.when(F.col("score_1").isNull() & F.col("score_0").isNull(), F.lit(None).cast("int")).when(
        F.col("score_1").isNull(), 0).when(F.col("score_0").isNull(), 1).otherwise(wins.cast("int"))
    return totals.join(sums, "_i", "left").select(
        F.col("_i").alias(order), score[0].alias("score_0"), score[1].alias("score_1")).withColumn("prediction", verdict)
