"""Quality rules: base rules, and gradient-boosted trees over document statistics.

The statistics of all documents are computed once, where they are read, and judged in the same pass.
Trees are fitted on at most
``FIT_ROWS`` labelled documents (those with the smallest hash of their id), by histograms of
feature bins, with the sign of chosen features' effect held: more symbols, repeated lines or
repeated words never raise a verdict. The trees are flattened into node arrays and scored for
whole batches at once. The threshold leaves ``KEEP`` of the good documents of a held-out quarter
of the fitted documents in.

Defined cases: a null text has no words; a document without an id or a label takes no part in the
fit; of different labels of one document each counts; with labels of one kind, or none, the base rules alone
decide; equal rows get equal values; an empty table gives an empty result; other columns are
ignored (``good_documents`` returns them as they are).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, release, smallest_hashes, table, text_parts

FIT_ROWS = 16_000
KEEP = 0.995
#: Characters of texts whose words are numbered together.
CHUNK_CHARS = 4_000_000

FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "punctuation", "non_ascii", "line_words", "top_word", "short_words", "shouts")
#: Sign of the effect of a feature on the verdict, where it is held.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1, "shouts": -1}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_WORD = re.compile(WORD)
_BLANK = " \t\n\x0b\x0c\r"


def statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Base counts (rows of ``BASE``) and features (rows of ``FEATURES``) of texts."""
    base, feats = np.zeros((len(texts), len(BASE)), np.int64), np.zeros((len(texts), len(FEATURES)))
    start = 0
    while start < len(texts):
        end, chars = start, 0
        while end < len(texts) and (end == start or chars < CHUNK_CHARS):
            chars += len(texts[end])
            end += 1
        found = [_WORD.findall(t) for t in texts[start:end]]
        numbers: dict[str, int] = {}
        for i, words in enumerate(found, start):
            codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
            base[i], feats[i] = _one(texts[i], words, codes)
        start = end
    return base, feats


def _one(text: str, words: list[str], codes: np.ndarray) -> tuple[tuple[int, ...], tuple[float, ...]]:
    n = len(words)
    word_chars = len(text) - sum(map(text.count, _BLANK))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    dup_lines = len(lines) - len(set(lines))
    repeats = 0
    if n > 3:
        size = int(codes.max()) + 1
        if size < 1 << 20:
            keys = (codes[:-2] * size + codes[1:-1]) * size + codes[2:]
        else:  # more numbers than three fit into 63 bits: number the pairs first
            _, pairs = np.unique(codes[:-1] * size + codes[1:], return_inverse=True)
            keys = pairs[:-1] * size + codes[2:]
        _, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(counts[at] > 1)
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[twice + k] = True
        repeats = int(hit.sum())
    by = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    upper, letters, digits = int(by[65:91].sum()), int(by[65:91].sum() + by[97:123].sum()), int(by[48:58].sum())
    punctuation = int(by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum())
    size, few = max(1, int(by.sum())), max(1, n)
    top = np.bincount(codes - codes.min()).max() if n else 0
    feats = (
        np.log1p(n), word_chars / few, symbols / few, dup_lines / max(1, len(lines)), repeats / few, len(np.unique(codes)) / few, upper / max(1, letters),
        digits / size, punctuation / size, by[128:].sum() / size, n / max(1, len(lines)), top / few, sum(len(w) < 3 for w in words) / few, text.count("!") / few,
    )
    return (n, word_chars, symbols, dup_lines, repeats), feats


class Trees:
    """Boosted trees as flat node arrays: of each node its feature (-1: leaf), bound, left child and value."""

    def __init__(self, depth: int = 4, rounds: int = 60, rate: float = 0.2, bins: int = 48, least: float = 10.0, penalty: float = 1.0):
        self.depth, self.rounds, self.rate, self.bins, self.least, self.penalty = depth, rounds, rate, bins, least, penalty
        self.feature, self.bound, self.left, self.value, self.roots = [], [], [], [], []
        self.bias, self.threshold = 0.0, -np.inf

    def fit(self, x: np.ndarray, y: np.ndarray, signs: list[int]) -> Trees:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            root = self._grow(binned, edges, p - y, p * (1 - p), signs)
            self.roots.append(root)
            score += self._tree(root, x)
        for k in ("feature", "left", "roots"):
            setattr(self, k, np.array(getattr(self, k), np.int32))
        self.bound, self.value = np.array(self.bound), np.array(self.value)
        return self

    def _grow(self, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, signs: list[int]) -> int:
        def leaf(rows: np.ndarray, low: float, high: float) -> float:
            return float(np.clip(-g[rows].sum() / (h[rows].sum() + self.penalty), low, high))

        def new(n: int = 1) -> int:
            at = len(self.feature)
            for xs, v in ((self.feature, -1), (self.bound, 0.0), (self.left, -1), (self.value, 0.0)):
                xs.extend([v] * n)
            return at

        root = new()
        todo = [(root, np.arange(len(g)), 0, -np.inf, np.inf)]
        while todo:
            node, rows, depth, low, high = todo.pop()
            best = None
            if depth < self.depth and len(rows) >= 2 * self.least:
                G, H = g[rows].sum(), h[rows].sum()
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, f]
                    gl, hl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1], np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                    wl, wr = np.clip(-gl / (hl + self.penalty), low, high), np.clip(-(G - gl) / (H - hl + self.penalty), low, high)
                    gain = gl**2 / (hl + self.penalty) + (G - gl) ** 2 / (H - hl + self.penalty) - G**2 / (H + self.penalty)
                    gain[(nl < self.least) | (len(rows) - nl < self.least) | (signs[f] * (wr - wl) < 0)] = -np.inf
                    k = int(np.argmax(gain))
                    if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                        best = (gain[k], f, k, (wl[k] + wr[k]) / 2)
            if best is None:
                self.value[node] = self.rate * leaf(rows, low, high)
                continue
            _, f, k, mid = best
            go = binned[rows, f] <= k
            self.feature[node], self.bound[node], self.left[node] = f, float(edges[f][k]), new(2)
            # Both sides of a held feature stay on their side of the middle, all the way down.
            a, b = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[signs[f]]
            todo += [(self.left[node], rows[go], depth + 1, *a), (self.left[node] + 1, rows[~go], depth + 1, *b)]
        return root

    def _tree(self, root: int, x: np.ndarray) -> np.ndarray:
        feature, bound, left, value = (np.asarray(v) for v in (self.feature, self.bound, self.left, self.value))
        at, rows = np.full(len(x), root), np.arange(len(x))
        for _ in range(self.depth):
            f = feature[at]
            inner = f >= 0
            at = np.where(inner, left[at] + (x[rows, np.maximum(f, 0)] > bound[at]), at)
        return value[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for root in self.roots:
            out += self._tree(root, x)
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, ids: np.ndarray | None = None) -> Trees | None:
    """Trees of labelled rows (1: good); null where the labels don't hold both kinds.

    Rows of one of ``ids`` are all fitted on or all held out.
    """
    if len(np.unique(y)) < 2:
        return None
    signs = [MONOTONE.get(f, 0) for f in FEATURES]
    number = np.arange(len(y)) if ids is None else np.unique(ids, return_inverse=True)[1]
    held = number % 4 == 3
    if len(np.unique(y[~held])) < 2:
        held[:] = False
    model = Trees().fit(x[~held], y[~held], signs)
    good = model.score(x[held & (y == 1)]) if (held & (y == 1)).any() else model.score(x[y == 1])
    model.threshold = float(min(np.quantile(good, 1 - KEEP), 0.0))
    return model


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Trees | None:
    """Trees of ``docs`` (doc_id, text) that have a label.

    The sample is chosen by ids alone; its at most ``rows`` ids go to where the texts are, and only
    features come back. Of rows with one id and different texts, one is fitted on.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    few = cut(smallest_hashes(texts.select("doc_id").join(marks, "doc_id").distinct(), "doc_id", rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "features": list(statistics([t or "" for t in b["text"]])[1])})

    found = texts.join(F.broadcast(few), "doc_id").mapInPandas(run, "doc_id long, quality int, features array<double>")
    got = found.groupBy("doc_id", "quality").agg(F.min("features").alias("features")).toPandas().sort_values(["doc_id", "quality"])
    x = np.array(got["features"].tolist()).reshape(-1, len(FEATURES))
    return fit_trees(x, got["quality"].to_numpy(), got["doc_id"].to_numpy())


JUDGED = "doc_id long, " + ", ".join(f"{x} long" for x in BASE) + ", base_failed boolean, kept boolean, score double"


def verdicts(texts: list[str | None], model: Trees | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base counts, whether the base rules fail, whether a text is kept, and the trees' score (NaN where there are none)."""
    base, feats = statistics([t or "" for t in texts])
    failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
    score = np.full(len(base), np.nan) if model is None else model.score(feats)
    return base, failed, ~failed & (np.isnan(score) | (score >= (0 if model is None else model.threshold))), score


def judge(docs: DataFrame, model: Trees | None) -> DataFrame:
    """The base counts of every row of ``docs`` (doc_id, text), whether it is ``kept``, and its ``score``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            base, failed, kept, score = verdicts(list(b["text"]), model)
            yield pd.DataFrame({"doc_id": b["doc_id"]} | {x: base[:, i] for i, x in enumerate(BASE)} | {"base_failed": failed, "kept": kept, "score": score})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, JUDGED)


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept: the base rules and the trees agree."""
    model = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_parts(batches):
            yield b.filter(pa.array(verdicts(texts, model)[2], pa.bool_()))
        release()

    # The trees are small and go with the task: rows are judged in passing, none is shuffled.
    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, learn(docs, table(spark, sf_dir, "labels")))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op8_quality`` that SQL can say, from the same operator."""
    return judge(table(spark, sf_dir, "documents"), None).select("doc_id", *BASE, "base_failed")


COUNTS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 2),
k AS (SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS g FROM g),
n AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM k),
h AS (SELECT doc_id, count(DISTINCT j) AS hit FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM n WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM
      (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
  coalesce(hit, 0)::BIGINT AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(hit, 0) > 50 * len(ws) AS base_failed
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN l USING (doc_id)"""
