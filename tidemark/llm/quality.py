"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a fixed vector of surface statistics. Training bins every statistic at sample quantiles and boosts
shallow trees cyclically, one statistic after the other and then chosen pairs of statistics; a tree over bins is a table,
so a fitted model is one lookup table for each statistic and pair. Scoring adds table entries by bin, vectorised over
the texts of a batch.

Nulls and empty texts score like the text without words. Repeated rows score alike. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import held_out, labelled_sample, sampled_features

FEATURES = (
    "log_chars", "log_words", "mean_word", "longest_word", "upper_share", "caps_words", "title_words", "digit_share",
    "space_share", "symbol_share", "bang_rate", "pipe_rate", "mark_rate", "comma_rate", "stop_rate", "distinct_words",
    "adjacent_same", "top_word", "distinct_pairs", "line_rate", "same_lines", "mean_line", "ends_closed", "starts_upper",
)
_UPPER = re.compile(r"[A-ZÀ-Þ]")
_PUNCT = re.compile(r"[^\w\s]")
_MARKS = re.compile(r"[*#$%&]")


def text_features(text: str | None) -> list[float]:
    """The statistics named in FEATURES, over the whole text; null counts as empty."""
    text = text or ""
    words, lines = text.split(), text.split("\n")
    n, k, m = max(len(text), 1), max(len(words), 1), len(lines)
    pairs = len(words) - 1
    counts = Counter(words)
    stripped = text.rstrip()
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / k, np.log1p(max(map(len, words), default=0)),
        len(_UPPER.findall(text)) / n, sum(map(str.isupper, words)) / k, sum(map(str.istitle, words)) / k,
        len(re.findall(r"\d", text)) / n, (n - sum(map(len, words))) / n, len(_PUNCT.findall(text)) / n,
        text.count("!") / k, text.count("|") / k, len(_MARKS.findall(text)) / k, text.count(",") / k,
        text.count(".") / k, len(counts) / k, sum(map(eq, words, words[1:])) / max(pairs, 1),
        max(counts.values(), default=0) / k, len(set(zip(words, words[1:]))) / max(pairs, 1), m / k,
        1 - len(set(lines)) / m, np.log1p(len(text) / m), float(stripped[-1:] in (".", "!", "?", '"')),
        float(text[:1].isupper()),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features_udf(texts: pd.Series) -> pd.Series:
    return texts.map(text_features)


class AdditiveModel:
    """Lookup tables over bins: one for each statistic, one for each chosen pair."""

    def __init__(self, cuts, coarse, base, tables, pairs, pair_tables):
        self.cuts, self.coarse, self.base, self.tables, self.pairs, self.pair_tables = cuts, coarse, base, tables, pairs, pair_tables

    @staticmethod
    def bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1) if len(x) else np.zeros((0, len(cuts)), int)

    def margin(self, x: np.ndarray) -> np.ndarray:
        fine, coarse = self.bins(x, self.cuts), self.bins(x, self.coarse)
        out = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            out += t[fine[:, j]]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[coarse[:, a], coarse[:, b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g * g / (h + l2)


def _best_cut(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, int]:
    """Best two-way cut of a row of bins: gain over no cut, and the first bin on the right."""
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(cg):
        return 0.0, 0
    total = _gain(g.sum(), h.sum(), l2)
    gains = _gain(cg, ch, l2) + _gain(g.sum() - cg, h.sum() - ch, l2) - total
    at = int(np.argmax(gains))
    return float(gains[at]), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, l2: float = 1.0) -> np.ndarray:
    """A tree of at most ``leaves`` leaves over ordered bins, as the table of its leaf values."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        options = [(*_best_cut(g[a:b], h[a:b], l2), i) for i, (a, b) in enumerate(parts)]
        gain, cut, i = max(options)
        if gain <= 1e-9:
            break
        a, b = parts[i]
        parts[i : i + 1] = [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, l2: float = 1.0) -> tuple[float, np.ndarray]:
    """A tree over a grid: a cut along one axis, then a cut of each side along the other. Returns gain and table."""
    best, table = -1.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        rows_g, rows_h = gg.sum(1), hh.sum(1)
        _, cut = _best_cut(rows_g, rows_h, l2)
        if not cut:
            continue
        gain, out = -_gain(rows_g.sum(), rows_h.sum(), l2), np.zeros_like(gg)
        for part in (slice(0, cut), slice(cut, None)):
            pg, ph = gg[part].sum(0), hh[part].sum(0)
            _, c = _best_cut(pg, ph, l2)
            for cols in (slice(0, c), slice(c, None)):
                sg, sh = pg[cols].sum(), ph[cols].sum()
                gain += _gain(sg, sh, l2)
                out[part, cols] = sg / (sh + l2)
        if gain > best:
            best, table = float(gain), out.T if flip else out
    return best, table


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, fine: int = 48, coarse: int = 10, n_pairs: int = 8, pair_rounds: int = 60) -> AdditiveModel:
    """Cyclic boosting of main effects, then of the ``n_pairs`` pairs that explain most of what is left.

    One class only, or no rows: the model is the constant log odds, smoothed by one row of each class.
    """
    x = np.nan_to_num(np.asarray(x, float).reshape(-1, len(FEATURES)))
    y = np.asarray(y, float)
    grid = lambda k: [np.unique(np.quantile(x[:, j], np.linspace(0, 1, k + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    cuts, rough = grid(fine), grid(coarse)
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    tables = [np.zeros(len(c) + 1) for c in cuts]
    model = AdditiveModel(cuts, rough, base, tables, [], [])
    if len(np.unique(y)) < 2:
        return model
    fb, cb, margin = model.bins(x, cuts), model.bins(x, rough), np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, t in enumerate(tables):
            g, h = slopes()
            step = rate * shallow_tree(np.bincount(fb[:, j], g, len(t)), np.bincount(fb[:, j], h, len(t)))
            t += step
            margin += step[fb[:, j]]
    g, h = slopes()
    shapes, found = [len(c) + 1 for c in rough], []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            key, size = cb[:, a] * shapes[b] + cb[:, b], shapes[a] * shapes[b]
            gain, _ = pair_tree(np.bincount(key, g, size).reshape(shapes[a], -1), np.bincount(key, h, size).reshape(shapes[a], -1))
            found.append((-gain, a, b, key))
    found = sorted(found, key=lambda f: f[:3])[:n_pairs]
    model.pairs = [(a, b) for _, a, b, _ in found]
    model.pair_tables = [np.zeros((shapes[a], shapes[b])) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (_, a, b, key), t in zip(found, model.pair_tables, strict=True):
            g, h = slopes()
            _, step = pair_tree(np.bincount(key, g, t.size).reshape(t.shape), np.bincount(key, h, t.size).reshape(t.shape))
            t += rate * step
            margin += rate * step.ravel()[key]
    return model


def train_quality(docs: DataFrame, labels: DataFrame, bound: int = 8000) -> AdditiveModel:
    """Fit on at most ``bound`` labelled documents that aren't held out; everything else covers all rows."""
    got = sampled_features(labelled_sample(docs, labels, "quality", bound), features_udf(F.col("text")), bound * 100)
    x = np.array(got.column("features").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit_additive(x, np.array(got.column("label").to_pylist(), float))


def quality_score(docs: DataFrame, model: AdditiveModel, text: str = "text") -> Column:
    """A column with the score of each whole text, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = shared.value
        for texts in batches:
            x = np.array([text_features(t) for t in texts], float).reshape(-1, len(FEATURES))
            yield pd.Series(fitted.score(x))

    return score(F.col(text))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, bound: int = 8000) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted (1 if score >= threshold)."""
    model = train_quality(docs, labels, bound)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
