"""Language identification of mixed texts.

The script of a word (ranges of code points) narrows the languages to those that were learned in that
script.  Each word gets a score for each language from the frequencies of its letter groups (two and
three letters, with marks for its start and end) and of the word itself; Viterbi then finds the best
sequence of languages under a penalty for each switch.  Runs of one language are the spans; the
language with most words is the text's.

Counts are learned from at most ``TRAIN_ROWS`` documents with a language.  A null text or one without
a letter is ``und`` with score 0; so is every text if nothing could be learned.  An empty table gives
no rows.  Repeated rows are judged alike, extra columns stay.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

MOD, REST = 3, 1
TRAIN_ROWS, MAX_GRAMS, MIN_COUNT = 3_000, 120_000, 3
PENALTY, WEIGHT, CACHED_WORDS = 6.0, 3.0, 250_000
WORD = re.compile(r"[^\W\d_]+")
# starts of ranges of code points and the script from there on
SCRIPTS = [(0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"),
           (0x900, "indic"), (0xE00, "thai"), (0x1100, "hangul"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
           (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"),
           (0xFB50, "arabic"), (0x10000, "other"), (0x20000, "han")]
_STARTS = [s for s, _ in SCRIPTS]


def script(word: str) -> str:
    """Script of a word's first letter."""
    return SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


def grams(word: str) -> list[str]:
    """Letter groups of a word with its ends marked, and the word itself."""
    w = f"<{word}>"
    out = [w[i : i + 3] for i in range(len(w) - 2)]
    out += [w[i : i + 2] for i in range(len(w) - 1)]
    out.append("=" + word)
    return out


class LanguageModel:
    """Scores of words by language and the best spans of a text."""

    def __init__(self, langs: list[str], index: dict[str, int], scores: np.ndarray, scripts: dict[str, np.ndarray]):
        self.langs, self.index, self.scripts = langs, index, scripts
        self.scores = scores  # a row for each known group

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: mean over its known letter groups, less where the script rules a language out."""
        get = self.index.get
        ids = [[i for i in map(get, grams(w)) if i is not None] for w in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
        ends = np.cumsum(np.concatenate([np.zeros((1, len(self.langs))), self.scores[flat]]), axis=0)
        at = np.concatenate([[0], np.cumsum(sizes)])
        out = WEIGHT * (ends[at[1:]] - ends[at[:-1]]) / np.maximum(sizes, 1)[:, None]
        for i, w in enumerate(words):
            fits = self.scripts.get(script(w))
            if fits is None or not fits.all():
                out[i] += 0.0 if fits is None else np.where(fits, 0.0, -50.0)
        return out

    def paths(self, rows: list[np.ndarray], penalty: float = PENALTY) -> list[np.ndarray]:
        """Best language of each word for each array of word scores, all texts step by step together."""
        order = [i for i in sorted(range(len(rows)), key=lambda i: -len(rows[i])) if len(rows[i])]
        kind = np.min_scalar_type(len(self.langs))
        out: list[np.ndarray] = [np.zeros(0, kind)] * len(rows)
        if not order:
            return out
        sizes = np.array([len(rows[i]) for i in order])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        flat = np.concatenate([rows[i] for i in order])
        alive = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # texts with more than t words
        stay, best = np.zeros(flat.shape, bool), np.zeros(len(flat), kind)
        last = np.zeros(len(order), kind)
        state = flat[starts]
        for t in range(len(alive)):
            a = alive[t]
            if t:
                state = state[:a]
                at = starts[:a] + t
                b = state.argmax(1)
                top = state[np.arange(a), b] - penalty
                stay[at], best[at] = state >= top[:, None], b
                state = np.maximum(state, top[:, None]) + flat[at]
            ends = alive[t + 1] if t + 1 < len(alive) else 0
            if ends < a:
                last[ends:a] = state[ends:a].argmax(1)
        path, now = np.zeros(len(flat), kind), last.copy()
        for t in range(len(alive) - 1, -1, -1):
            at, cur = starts[: alive[t]] + t, now[: alive[t]]
            path[at] = cur
            now[: alive[t]] = np.where(stay[at, cur], cur, best[at])
        for i, s, n in zip(order, starts, sizes):
            out[i] = path[s : s + n]
        return out


class Labeller:
    """Applies a model to batches of texts, keeping the scores of the words met so far."""

    def __init__(self, model: LanguageModel):
        self.model, self.rows, self.table = model, {}, np.zeros((1 << 12, len(model.langs)), np.float32)

    def _learn(self, words: list[str]) -> None:
        n = len(self.rows)
        if n + len(words) > len(self.table):
            grown = np.zeros((max(2 * len(self.table), n + len(words)), self.table.shape[1]), np.float32)
            grown[:n] = self.table[:n]
            self.table = grown
        self.table[n : n + len(words)] = self.model.word_scores(words)
        self.rows.update(zip(words, range(n, n + len(words))))

    def label(self, texts: list[str | None], penalty: float = PENALTY) -> list[tuple[list[str], np.ndarray]]:
        """Words and best language index of each, for every text."""
        if len(self.rows) > CACHED_WORDS:
            self.rows.clear()
        words = [WORD.findall((t or "").lower()) for t in texts]
        if not self.model.langs:
            return [(w, np.zeros(0, np.int8)) for w in words]
        new = set().union(*words).difference(self.rows)
        if new:
            self._learn(list(new))
        ids = [np.fromiter(map(self.rows.__getitem__, w), np.int64, len(w)) for w in words]
        return list(zip(words, self.model.paths([self.table[i] for i in ids], penalty)))

    def document(self, words: list[str], path: np.ndarray) -> tuple[str, float]:
        """Language of most words and its share; ``und`` without a letter."""
        if not self.model.langs or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        n = np.bincount(path, minlength=len(self.model.langs))
        return self.model.langs[int(n.argmax())], float(n.max() / n.sum())


def spans(words: list[str], path: np.ndarray, langs: list[str]) -> list[tuple[int, int, str]]:
    """Runs of one language: first word, word after the last, language."""
    if not len(path):
        return []
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    return [(a, b, langs[path[a]]) for a, b in zip(cuts, cuts[1:]) if a < b]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, Counter] = {}
    kinds: dict[str, Counter] = {}
    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"]):
            c, k = counts.setdefault(lang, Counter()), kinds.setdefault(lang, Counter())
            for w, n in Counter(WORD.findall(text.lower())).items():
                k["#" + script(w)] += n
                for g in grams(w):
                    c[g] += n
    for part in (counts, kinds):
        for lang, c in part.items():
            yield pd.DataFrame({"lang": lang, "gram": list(c), "n": list(c.values())})


def learn(documents: DataFrame, rows: int = TRAIN_ROWS) -> LanguageModel:
    """Counts from at most ``rows`` documents outside the held-out third; at most ``MAX_GRAMS`` groups reach the driver."""
    known = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), MOD, REST))
    ids = known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id", "left_semi").select("lang", "text")
    counts = sample.mapInPandas(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = (
        counts.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("n"))
        .filter((F.col("n") >= MIN_COUNT) | F.col("gram").startswith("#")).orderBy(F.desc("n"), "gram").limit(MAX_GRAMS).toPandas()
    )
    langs = sorted({lang for by in top["by"] for lang in by})
    if not langs:
        return LanguageModel([], {}, np.zeros((0, 0)), {})
    n = np.array([[by.get(lang, 0) for lang in langs] for by in top["by"]], dtype=np.float64).reshape(-1, len(langs))
    is_script = top["gram"].str.startswith("#").to_numpy(bool) & (top["gram"].str.len() > 1).to_numpy(bool)
    p = (n + 0.5) / (n[~is_script].sum(0) + 0.5 * max((~is_script).sum(), 1))
    logs = np.log(p) - np.log(p).max(1, initial=-99, keepdims=True) if len(langs) else p
    index = {g: i for i, g in enumerate(top["gram"][~is_script])}
    scripts = {g[1:]: v / max(v.sum(), 1) > 1e-3 for g, v, x in zip(top["gram"], n, is_script) if x and v.sum() >= 20}
    return LanguageModel(langs, index, np.maximum(logs[~is_script], -6.0), scripts)


def with_language(documents: DataFrame, model: LanguageModel, text_col: str = "text", batch: int = 256) -> DataFrame:
    """``documents`` with lang_pred, score and spans (start, end, lang in words) of every whole text."""

    @F.pandas_udf("lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(model)
        for texts in batches:
            rows = []
            values = texts.tolist()
            for at in range(0, len(values), batch):
                for words, path in labeller.label(values[at : at + batch]):
                    rows.append((*labeller.document(words, path), [dict(zip(("start", "end", "lang"), s)) for s in spans(words, path, model.langs)]))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "spans"])

    cols = [c for c in documents.columns if c not in ("lang_pred", "score", "spans", "__l")]
    return documents.select(*cols, label(F.coalesce(F.col(text_col), F.lit(""))).alias("__l")).select(*cols, "__l.*")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs)
    out = with_language(docs.select("doc_id", "text", held_out(F.col("doc_id"), MOD, REST).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))
