"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed n-grams (3 to 5 code points, lower case, white space as one kind of blank) of the
whole text. The log-count ratio of an n-gram between toxic and other labelled texts scales its feature; logistic
regression learns the weights on the scaled features. Ratio times weight is one table, and a score is the sum of its entries.

Nulls and empty texts have no n-grams and score the bias. Repeated rows score alike. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import held_out, labelled_sample, sampled_features

BITS = 18
_MULTIPLY = np.uint32(2654435761)


def gram_buckets(text: str | None) -> np.ndarray:
    """Buckets of all n-grams of the text, with repeats."""
    a = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le"), "<u4")
    a = np.where(a <= 32, np.uint32(32), a)
    if len(a) < 3:
        return np.zeros(0, np.int64)
    mix = lambda v: (v * _MULTIPLY) ^ ((v * _MULTIPLY) >> np.uint32(15))
    two = mix(a[:-1] + np.uint32(0x9E3779B9)) + a[1:]
    three = mix(two[:-1]) + a[2:]
    four = mix(three[:-1]) + a[3:]
    five = mix(four[:-1]) + a[4:]
    return np.concatenate([(v * _MULTIPLY) >> np.uint32(32 - BITS) for v in (three, four, five)]).astype(np.int64)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def grams_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: np.unique(gram_buckets(t)).astype(np.int32))


class RatioModel:
    """Bias, and for each bucket ratio times weight."""

    def __init__(self, bias: float, table: np.ndarray):
        self.bias, self.table = bias, table

    def score_all(self, texts) -> np.ndarray:
        seen, out = np.zeros(1 << BITS, bool), np.empty(len(texts))
        for i, text in enumerate(texts):
            h = gram_buckets(text)
            if len(h) < 1 << (BITS - 4):
                h = np.unique(h)
                out[i] = self.bias + self.table[h].sum()
            else:
                seen[h] = True
                out[i] = self.bias + self.table[seen].sum()
                seen[h] = False
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 0.5, l2: float = 5.0, steps: int = 80) -> RatioModel:
    """Log-count ratios, then logistic regression on the scaled features by accelerated gradient steps.

    One class only, or no rows: the model is the constant log odds, smoothed by one row of each class.
    """
    y = np.asarray(y, float)
    bias, size = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), 1 << BITS
    if len(np.unique(y)) < 2:
        return RatioModel(bias, np.zeros(size))
    p, q = np.zeros(size), np.zeros(size)
    for r, toxic in zip(rows, y, strict=True):  # a row holds each of its buckets once
        (p if toxic else q)[r] += 1
    seen = p + q
    ratio = np.log(((p + alpha) / (y.sum() + 2 * alpha)) / ((q + alpha) / ((1 - y).sum() + 2 * alpha)))
    ratio[seen < 3] = 0
    strong = np.abs(ratio) > 0.7
    kept = [r[strong[r]].astype(np.int32) for r in rows]
    idx, doc = np.concatenate(kept), np.repeat(np.arange(len(kept), dtype=np.int32), [len(r) for r in kept])
    del kept
    names, idx = np.unique(idx, return_inverse=True)
    r, n = ratio[names], len(rows)
    w, m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    w[-1] = bias
    for t in range(1, steps + 1):
        margin = np.bincount(doc, (w[:-1] * r)[idx], n) + w[-1]
        err = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y
        g = np.append(np.bincount(idx, err[doc], len(names)) * r / n + l2 / n * w[:-1], err.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6) * (1 - t / (steps + 1))
    table = np.zeros(size)
    table[names] = w[:-1] * r
    return RatioModel(float(w[-1]), table)


def train_toxicity(docs: DataFrame, labels: DataFrame, bound: int = 5000, most_grams: int = 40_000_000) -> RatioModel:
    """Fit on at most ``bound`` labelled documents that aren't held out, with at most ``most_grams`` distinct n-grams summed over
    documents (160 MB on the driver); everything else covers all rows."""
    got = sampled_features(labelled_sample(docs, labels, "toxic", bound), grams_udf(F.col("text")), most_grams)
    rows = [np.asarray(part) for chunk in got.column("features").chunks for part in np.split(chunk.values.to_numpy(), chunk.offsets.to_numpy()[1:-1])]
    return fit_ratio(rows, np.array(got.column("label").to_pylist(), float))


def toxicity_score(docs: DataFrame, model: RatioModel, text: str = "text") -> Column:
    """A column with the score of each whole text, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = shared.value
        for texts in batches:
            yield pd.Series(fitted.score_all(texts.tolist()))

    return score(F.col(text))


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, bound: int = 5000) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted (1 if score >= threshold)."""
    model = train_toxicity(docs, labels, bound)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity_score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
