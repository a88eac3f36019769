"""Toxicity by a factorisation machine over hashed terms.

The terms of a text are its words and their first four and five letters, hashed; a text either has a
term or not.  From at most ``TRAIN_ROWS`` labelled rows the terms that go with the label beyond chance
(likelihood ratio) are chosen, and the machine learns a weight for each and a vector of factors, whose
products weigh every pair of terms (an insult together with a mention of a group).  Scoring takes
time in proportion to the terms of a text, as pairs come from squares of sums.

Null counts as an empty text; a text without known terms gets the base score; without labels every
score is 0.  An empty table gives no rows.  Repeated rows are scored alike, extra columns stay.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import held_out, table
from .labelled import TRAIN_ROWS, training_ids, training_rows

MOD, REST, THRESHOLD = 4, 2, 0.3
HASH_BITS, MAX_TERMS, MIN_RATIO = 22, 2048, 24.0
FACTORS, EPOCHS, STEP, DECAY = 8, 25, 0.1, 1e-4
CACHED_WORDS = 300_000
WORD = re.compile(r"[^\W\d_]+")
_BUCKETS = (1 << HASH_BITS) - 1


def word_terms(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its first letters."""
    parts = [word] + [f"^{n}{word[:n]}" for n in (4, 5) if len(word) > n]
    return tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) & _BUCKETS for p in parts)


def terms(text: str) -> set[int]:
    return {t for w in set(WORD.findall(text.lower())) for t in word_terms(w)}


@F.pandas_udf(ArrayType(IntegerType()))
def _terms(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: np.fromiter(sorted(terms(t)), np.int32))


class FactorisationMachine:
    """Logistic factorisation machine over the presence of chosen hashed terms."""

    def __init__(self, chosen: list[int]):
        self.index = {t: i for i, t in enumerate(chosen)}
        self.bias, self.w, self.v = -20.0, np.zeros(len(chosen)), np.zeros((len(chosen), FACTORS))

    def raw(self, ids: list[int]) -> float:
        v = self.v[ids]
        return float(self.bias + self.w[ids].sum() + 0.5 * (v.sum(0) ** 2 - (v**2).sum(0)).sum())

    def fit(self, rows: list[list[int]], y: np.ndarray, seed: int = 7) -> "FactorisationMachine":
        rng = np.random.default_rng(seed)
        m = len(self.index)
        rate = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
        self.bias = float(np.log(rate / (1 - rate)))
        if not m:
            return self
        self.v = rng.normal(0, 0.01, (m, FACTORS))
        gb, gw, gv = 1e-6, np.full(m, 1e-6), np.full((m, FACTORS), 1e-6)
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 256):
                part = order[at : at + 256]
                x = np.zeros((len(part), m))
                for i, r in enumerate(part):
                    x[i, rows[r]] = 1
                s = x @ self.v
                f = self.bias + x @ self.w + 0.5 * ((s**2).sum(1) - (x @ (self.v**2)).sum(1))
                d = (1 / (1 + np.exp(-np.clip(f, -30, 30))) - y[part]) / len(part)
                dw = x.T @ d + DECAY * self.w
                dv = x.T @ (d[:, None] * s) - (x.T @ d)[:, None] * self.v + DECAY * self.v
                db = d.sum()
                gb, gw, gv = gb + db**2, gw + dw**2, gv + dv**2
                self.bias -= STEP * db / np.sqrt(gb)
                self.w -= STEP * dw / np.sqrt(gw)
                self.v -= STEP * dv / np.sqrt(gv)
        return self


def _ratio(n: np.ndarray, k: np.ndarray, total: int, pos: int) -> np.ndarray:
    """Likelihood ratio of a term's label counts against the base rate."""
    part = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0.0)
    p = pos / total
    return 2 * (part(k, n * p) + part(n - k, n * (1 - p)) + part(pos - k, (total - n) * p) + part(total - n - pos + k, (total - n) * (1 - p)))


def learn(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> FactorisationMachine:
    """Fit on at most ``rows`` labelled documents outside the held-out quarter.

    The chosen terms (at most ``MAX_TERMS``) and the sampled rows' use of them reach the driver.
    """
    ids = training_ids(labels, "toxic", held_out(F.col("doc_id"), MOD, REST), rows)
    sample = training_rows(documents, ids).select("doc_id", "y", _terms("text").alias("t")).cache()
    total, pos = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not total or not pos or pos == total:
        model = FactorisationMachine([])
        model.bias = -20.0 if not pos else 20.0
        return model
    counts = sample.select("y", F.explode("t").alias("t")).groupBy("t").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    strong = counts.filter((F.col("n") >= 4) & (F.abs(F.col("k") - F.col("n") * (pos / total)) > 2 * F.sqrt(F.col("n") * (pos / total))))
    top = strong.orderBy(F.desc(F.abs(F.col("k") - F.col("n") * (pos / total)) / F.sqrt("n")), "t").limit(4 * MAX_TERMS).toPandas()
    top["r"] = _ratio(top["n"].to_numpy(float), top["k"].to_numpy(float), total, pos)
    chosen = top[top["r"] >= MIN_RATIO].sort_values(["r", "t"], ascending=[False, True])["t"].head(MAX_TERMS).tolist()
    model = FactorisationMachine(chosen)
    wanted = F.array(*[F.lit(t) for t in chosen]) if chosen else F.array().cast("array<int>")
    pdf = sample.select("doc_id", "y", F.array_intersect("t", wanted).alias("t")).toPandas().sort_values("doc_id")
    sample.unpersist()
    return model.fit([[model.index[t] for t in r] for r in pdf["t"]], pdf["y"].to_numpy(float))


def with_toxicity(documents: DataFrame, model: FactorisationMachine, text_col: str = "text", name: str = "score") -> DataFrame:
    """``documents`` with the score of every whole text."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index, known = model.index, {}

        class Known(dict):
            def __missing__(self, word):
                found = tuple(index[t] for t in word_terms(word) if t in index)
                if len(self) >= CACHED_WORDS:
                    self.clear()
                self[word] = found
                return found

        known = Known()

        def one(text):
            ids = set()
            for found in map(known.__getitem__, set(WORD.findall(text.lower()))):
                if found:
                    ids.update(found)
            return model.raw(sorted(ids))

        for texts in batches:
            f = np.fromiter(map(one, texts), float, len(texts))
            yield pd.Series(1 / (1 + np.exp(-np.clip(f, -30, 30))))

    return documents.withColumn(name, score(F.coalesce(F.col(text_col), F.lit(""))))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    out = with_toxicity(docs.withColumn("held_out", held_out(F.col("doc_id"), MOD, REST)), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
