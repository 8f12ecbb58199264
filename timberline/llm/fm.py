"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a document is w0 + <w, x> + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), through a
logistic curve: all pairwise interactions in time linear in the features present. Training uses at
most ``sample`` labelled rows (least hashes of the id, so the choice does not hang on partitions)
outside the held-out fold; their features are computed in tasks and only these vectors, of fixed
width, reach the driver. Scoring is one pass over the texts without a shuffle.

Defined results: a null or empty text is scored as a document without words; rows that repeat an id
are scored each; labels that are null or other than 0 and 1 are not learnt from; with no labels of
both classes the score is the share of label 1 (1.0 without any label); an empty table gives an
empty result. The score never uses labels, lang, source or doc_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .rules import SYMBOLS, repeat_words
from .words import Words, slices, sums, texts_of

#: Labelled rows learnt from at most.
SAMPLE = 6000
#: Hashed word features.
WORD_BINS = 512
FACTORS = 8
THRESHOLD = 0.3

_LETTER = re.compile(r"[^\W\d_]")
STATS = 16


def word_flags(vocabulary: list[str]) -> np.ndarray:
    """Per distinct word: shouted, ends in marks, no letter, has a symbol, has a digit, starts upper."""
    out = np.zeros((len(vocabulary), 6))
    for k, w in enumerate(vocabulary):
        letters = w.isupper() and len(w) > 1
        out[k] = (letters, not w[-1:].isalnum() and w[-1:] not in ".,;:", _LETTER.search(w) is None,
                  any(c in SYMBOLS for c in w), any(c.isdigit() for c in w), w[:1].isupper())
    return out


def features(texts: pa.Array) -> np.ndarray:
    """Dense feature rows (float32): hashed word shares, then structure statistics and metadata."""
    words = Words(texts)
    hashes = words.hashes()
    n, count = len(texts), np.maximum(words.counts, 1)
    x = np.zeros((n, WORD_BINS + STATS), np.float32)
    bins = (hashes % np.uint64(WORD_BINS)).astype(np.int64)[words.codes]
    shares = np.bincount(words.owners() * WORD_BINS + bins, minlength=n * WORD_BINS).reshape(n, WORD_BINS)
    x[:, :WORD_BINS] = np.sqrt(shares / count[:, None])
    flags = word_flags(words.vocabulary)
    python = texts.to_pylist()
    chars = np.array([len(t) for t in python])
    lines = np.array([t.count("\n") + 1 for t in python])
    symbols = np.array([sum(map(t.count, SYMBOLS)) for t in python])
    bangs = np.array([t.count("!") + t.count("?") for t in python])
    pairs = np.unique(words.owners() * max(len(words.vocabulary), 1) + words.codes)
    distinct = np.bincount(pairs // max(len(words.vocabulary), 1), minlength=n)
    same = np.concatenate([[False], words.codes[1:] == words.codes[:-1]])
    stats = [
        *(words.per_text(flags[:, k]) / count for k in range(flags.shape[1])),
        words.per_text(words.lengths) / count / 10,
        symbols / np.maximum(chars, 1) * 5,
        bangs / np.maximum(chars, 1) * 5,
        distinct / count,
        repeat_words(words, hashes) / count,
        sums(same.astype(np.int64), words.starts) / count,
        np.log1p(words.counts) / 8,
        np.log1p(chars) / 10,
        np.log1p(lines) / 5,
        np.log1p(words.counts / lines) / 5,
    ]
    for k, s in enumerate(stats):
        x[:, WORD_BINS + k] = s
    return x


@dataclass
class FactorisationMachine:
    bias: float
    weight: np.ndarray
    factors: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        crossed = ((x @ self.factors) ** 2).sum(1) - (x ** 2) @ (self.factors ** 2).sum(1)
        return self.bias + x @ self.weight + 0.5 * crossed

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, factors: int = FACTORS, rounds: int = 300, rate: float = 0.04,
        decay: float = 2e-4, seed: int = 7) -> FactorisationMachine:
    """Full-batch Adam on the logistic loss, with weight decay."""
    share = float(y.mean()) if len(y) else 1.0
    width = x.shape[1]
    if not len(y) or share in (0.0, 1.0):
        edge = float(np.clip(share, 1e-6, 1 - 1e-6))
        return FactorisationMachine(float(np.log(edge / (1 - edge))), np.zeros(width), np.zeros((width, factors)))
    rng = np.random.default_rng(seed)
    x = np.ascontiguousarray(x, np.float32)
    y, square, f4 = y.astype(np.float32), x ** 2, np.float32
    p = [np.array([np.log(share / (1 - share))], f4), np.zeros(width, f4),
         rng.normal(0, 0.05, (width, factors)).astype(f4)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, rounds + 1):
        xv = x @ p[2]
        margin = p[0] + x @ p[1] + f4(0.5) * ((xv ** 2).sum(1) - square @ (p[2] ** 2).sum(1))
        e = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / f4(len(y))
        grads = [np.array([e.sum()]), x.T @ e + f4(decay) * p[1],
                 x.T @ (xv * e[:, None]) - p[2] * (square.T @ e)[:, None] + f4(decay) * p[2]]
        for k, g in enumerate(grads):
            m[k] = f4(0.9) * m[k] + f4(0.1) * g
            v[k] = f4(0.999) * v[k] + f4(0.001) * g * g
            p[k] = p[k] - f4(rate / (1 - 0.9 ** t)) * m[k] / (np.sqrt(v[k] / f4(1 - 0.999 ** t)) + f4(1e-8))
    return FactorisationMachine(float(p[0][0]), p[1].astype(np.float64), p[2].astype(np.float64))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        x = features(texts_of(batch))
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])


def held_out(doc_id) -> F.Column:
    """True for the fold that is never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorisationMachine:
    """Fit on at most ``sample`` labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("label")).filter(
        "label in (0, 1) and __id is not null")
    known = known.filter(~held_out("__id")).groupBy("__id").agg(F.max("label").alias("label"))
    # one bounded top-k of hashed ids: a few numbers a row, combined in tasks
    chosen = known.join(docs.select(F.col("doc_id").alias("__id")).distinct(), "__id", "left_semi").orderBy(
        F.xxhash64("__id"), "__id").limit(sample)
    # one row of a repeated id, that of the least text hash
    rows = docs.select(F.col("doc_id").alias("__id"), "text").join(F.broadcast(chosen), "__id").groupBy("__id", "label").agg(
        F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "label")
    got = rows.mapInArrow(_vectors, "label int, x binary").toPandas()
    if not len(got):
        return fit(np.zeros((0, WORD_BINS + STATS), np.float32), np.zeros(0))
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), -1)
    return fit(x, got["label"].to_numpy(np.float64))


def score(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = model.score(features(texts_of(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_predicted(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """The documents predicted 1, with all their columns, in one pass without a shuffle."""
    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        out = np.zeros(len(text))
        batch = pa.RecordBatch.from_arrays([pa.array(text, pa.string())], names=["text"])
        at = 0
        for part in slices(iter([batch]), "text"):
            out[at:at + len(part)] = model.score(features(texts_of(part)))
            at += len(part)
        return pd.Series(out)

    return docs.filter(scored("text") >= threshold)
