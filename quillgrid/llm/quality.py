"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives a few dozen figures (lengths, shares of character classes, repetition).  Each figure
is cut into bins, and boosting goes round the features in turn: a tree of at most three leaves over
the bins of one feature takes a small step towards the residual and is added to that feature's lookup
table.  The pairs of features with the largest remaining gain then get tables of their own in the same
way.  A score is the sum of the looked-up values through the logistic function.

It learns from at most ``TRAIN_ROWS`` labelled rows and scores every whole text.  Null counts as an
empty text, which gets the score of its figures like any other; an empty table gives no rows; without
a single label every score is 0.5.  Extra columns stay, repeated rows are scored alike.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import claim_worker, held_out, table
from .labelled import TRAIN_ROWS, training_ids, training_rows

MOD, REST = 3, 1
N_BINS, PAIR_BINS, ROUNDS, PAIRS, RATE = 32, 8, 150, 8, 0.1
_CLASS = np.zeros(256, dtype=np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c",
                             b".", b",", b"!?", b"|", b"#$%&*@^~+=<>\\/", b"\"'`()[]{}", b"-_:;"), 1):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _k
_CLASS[128:] = 14


def features(text: str) -> list[float]:
    """The figures of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=codes, minlength=15)
    share = kinds / max(n, 1)
    p = codes[codes > 0] / max(n, 1)
    words = raw.lower().split()
    w = max(len(words), 1)
    unique = len(set(words))
    again = sum(map(operator.eq, words, words[1:]))
    pairs = len(set(pairwise(words)))
    lines = raw.split(b"\n")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return [
        np.log1p(n), np.log1p(len(words)), float(sizes.mean()) if len(words) else 0.0, float(sizes.max(initial=0)),
        float((sizes <= 3).sum() / w), unique / w, again / w, pairs / max(w - 1, 1), *share[1:].tolist(),
        float(-(p * np.log(p)).sum()), len(set(lines)) / len(lines), np.log1p(len(lines)), n / len(lines) / 1000,
        kinds[6] / w, kinds[7] / w, kinds[8] / w, kinds[9] / w, kinds[10] / w, kinds[2] / max(kinds[1] + kinds[2] + kinds[14], 1),
        float(raw[-1:] in b".!?") if n else 0.0, unique / np.sqrt(w),
    ]


N_FEATURES = len(features(""))


def matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float64).reshape(-1, N_FEATURES)


def _leaves(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a tree of at most three leaves over ordered bins, from sums of gradients and Hessians."""
    out = np.full(len(g), g.sum() / (h.sum() + 1.0))
    segments = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None, None)
        for a, b in segments:
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            left, right = cg[:-1] ** 2 / (ch[:-1] + 1.0), (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1.0)
            gain = left + right - cg[-1] ** 2 / (ch[-1] + 1.0)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], (a, b), a + i + 1)
        if best[1] is None:
            break
        (a, b), m = best[1], best[2]
        segments = [s for s in segments if s != (a, b)] + [(a, m), (m, b)]
        for x, y in ((a, m), (m, b)):
            out[x:y] = g[x:y].sum() / (h[x:y].sum() + 1.0)
    return out


def _cell_leaves(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of one cut on each of two axes over a grid of bins."""
    k = g.shape[0]
    cg, ch = np.zeros((k + 1, k + 1)), np.zeros((k + 1, k + 1))
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = lambda c: (c[1:-1, 1:-1], c[1:-1, -1:] - c[1:-1, 1:-1], c[-1:, 1:-1] - c[1:-1, 1:-1],
                       c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + c[1:-1, 1:-1])
    gain = sum(x**2 / (y + 1.0) for x, y in zip(parts(cg), parts(ch)))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    for x in (slice(0, i + 1), slice(i + 1, k)):
        for y in (slice(0, j + 1), slice(j + 1, k)):
            out[x, y] = g[x, y].sum() / (h[x, y].sum() + 1.0)
    return out


class AdditiveModel:
    """Lookup tables of single features and of pairs."""

    def __init__(self):
        self.bias, self.edges, self.tables, self.pairs, self.coarse = 0.0, [], [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, n_pairs: int = PAIRS) -> "AdditiveModel":
        if not len(y):
            return self
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(rate / (1 - rate)))
        qs = lambda v, k: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1]))
        self.edges = [qs(x[:, j], N_BINS) for j in range(x.shape[1])]
        self.coarse = [qs(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
        bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        f = np.full(len(y), self.bias)
        for _ in range(rounds):
            for j, b in enumerate(bins):
                p = 1 / (1 + np.exp(-f))
                k = len(self.tables[j])
                step = RATE * _leaves(np.bincount(b, y - p, k), np.bincount(b, p * (1 - p), k))
                self.tables[j] += step
                f += step[b]
        cells = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.coarse)]
        p = 1 / (1 + np.exp(-f))
        sums = lambda i, j, v: np.bincount(cells[i] * PAIR_BINS + cells[j], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
        gains = []
        for i in range(x.shape[1]):
            for j in range(i):
                g, h = sums(i, j, y - p), sums(i, j, p * (1 - p))
                v = _cell_leaves(g, h)
                gains.append((float((2 * v * g - v * v * h).sum()), i, j))
        self.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in sorted(gains, reverse=True)[:n_pairs]]
        for _ in range(rounds // 3):
            for i, j, t in self.pairs:
                p = 1 / (1 + np.exp(-f))
                step = RATE * _cell_leaves(sums(i, j, y - p), sums(i, j, p * (1 - p)))
                t += step
                f += step[cells[i], cells[j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            f += t[np.searchsorted(e, x[:, j], side="right")]
        for i, j, t in self.pairs:
            f += t[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-f))


@F.pandas_udf(ArrayType(DoubleType()))
def _features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    claim_worker("quality")
    for texts in batches:
        yield texts.map(features)


def learn(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fit on at most ``rows`` labelled documents outside the held-out third; only their figures reach the driver."""
    ids = training_ids(labels, "quality", held_out(F.col("doc_id"), MOD, REST), rows)
    pdf = training_rows(documents, ids).select("doc_id", F.xxhash64("text").alias("h"), "y", _features("text").alias("x")).toPandas()
    pdf = pdf.sort_values(["doc_id", "h"])  # sums of floats, and so ties, are the same however the rows are dealt
    x = np.array(pdf["x"].tolist(), dtype=np.float64).reshape(-1, N_FEATURES)
    return AdditiveModel().fit(x, pdf["y"].to_numpy(dtype=np.float64))


def with_quality(documents: DataFrame, model: AdditiveModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``documents`` with the score of every whole text."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim_worker("quality")
        for texts in batches:
            yield pd.Series(model.score(matrix(texts)))

    return documents.withColumn(name, score(F.coalesce(F.col(text_col), F.lit(""))))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    out = with_quality(docs.withColumn("held_out", held_out(F.col("doc_id"), MOD, REST)), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
