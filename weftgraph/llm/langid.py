"""Language identification by interpolated Kneser-Ney character models.

Letters are lower-cased and cut into words with a blank at either end; a model of order 5 per
language is counted over all words of the labelled training documents (words first, then their
5-grams, from which the lower orders' continuation counts follow). The 5 orders' discounts come
from all counts, and every counted n-gram is kept. Probabilities are computed in Spark, order by
order. A model of up to ``MODEL_BYTES`` is sent to the executors, as sorted hash arrays with the
languages' log-probabilities side by side; a larger one stays in tables, and the distinct words of
the texts are scored by joins with it.

A text goes to the language with the lowest cross-entropy per character. ``score`` is a softmax
whose sharpness is fitted on at most ``CALIBRATION_ROWS`` training documents; ``accepted`` is false
where the best cross-entropy is beyond what 99.9 % of those have in their own language.

Defined cases: a null text or one without a letter is ``und`` with score 0; with no training row,
all are ``und``; a null ``doc_id`` counts as the text ``''`` for the fold; equal rows get equal
values; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, smallest_hashes, table

ORDER = 5
MODEL_BYTES = 64 << 20
CALIBRATION_ROWS = 2000
#: Characters scored at once, and words whose scores a worker keeps.
CHUNK_CHARS, KNOWN_WORDS = 2_000_000, 300_000
#: Letters, and numbers that are neither digits nor letters (such as superscripts).
LETTERS = re.compile(r"[^\W\d_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def _fold() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4


def letter_words(text: str) -> list[str]:
    """Runs of letters (``\\p{L}+``) of a text in lower case, as they are cut for training."""
    found = LETTERS.findall(text.lower())
    if not found or "".join(found).isalpha():
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def _hashes(points: np.ndarray) -> np.ndarray:
    """Of rows of code points; rows of different lengths are never compared."""
    h = np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(points.shape[1]):
            h = (h + points[:, k].astype(np.uint64) + np.uint64(1)) * BASE
            h ^= h >> np.uint64(29)
    return h


def _points(grams: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le"), "<u4").reshape(-1, n)


class Model:
    """Log-probabilities of n-grams and back-off weights of contexts, by order."""

    def __init__(self, langs: list[str], grams: list[tuple[np.ndarray, np.ndarray]], contexts: list[tuple[np.ndarray, np.ndarray]], floor: np.ndarray):
        self.langs, self.grams, self.contexts, self.floor = langs, grams, contexts, floor
        self.sharp, self.limit = 10.0, np.inf
        self._known: dict[str, int] = {}
        self._rows = np.zeros((1024, len(langs) + 1), np.float32)

    def __getstate__(self):
        return self.__dict__ | {"_known": {}, "_rows": np.zeros((1024, len(self.langs) + 1), np.float32)}

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Values of ``h``, NaN where there is none."""
        if not len(keys):
            return np.full((len(h), values.shape[1]), np.nan, np.float32)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        out = values[at]
        out[keys[at] != h] = np.nan
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """Per word: the sum of log-probabilities by language, and at last the number of characters."""
        pad = " " * (ORDER - 1)
        points = np.frombuffer((pad + pad.join(w + " " for w in words) if words else "").encode("utf-32-le"), "<u4")
        sizes = np.array([len(w) for w in words]) + ORDER
        starts = np.cumsum(sizes) - sizes
        use = np.ones(len(points), bool)
        for k in range(ORDER - 1):
            use[starts + k] = False
        ends = np.flatnonzero(use)  # each is the last character of an n-gram
        total = np.full((len(ends), len(self.langs)), np.nan, np.float32)
        back = np.zeros_like(total)
        for n in range(ORDER, 0, -1):
            rows = np.lib.stride_tricks.sliding_window_view(points, n)[ends - n + 1]
            got = self._find(*self.grams[n - 1], _hashes(rows)) + back
            total = np.where(np.isnan(total), got, total)
            if n > 1:
                if not np.isnan(total).any():
                    break
                back = back + np.nan_to_num(self._find(*self.contexts[n - 1], _hashes(rows[:, :-1])), nan=0.0)
        total = np.where(np.isnan(total), self.floor + back, total)
        firsts = np.cumsum(sizes - ORDER + 1) - (sizes - ORDER + 1)
        return np.column_stack([np.add.reduceat(total, firsts, axis=0), sizes - ORDER + 1])

    def texts(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per character by language; infinite for texts without a letter."""
        found = [letter_words(t) for t in texts]
        if len(self._known) > KNOWN_WORDS:
            self._known.clear()
        every = list(chain.from_iterable(found))
        at = list(map(self._known.get, every))
        if None in at:
            new = list({w for w, k in zip(every, at) if k is None})
            for start in range(0, len(new), 100_000):
                part = new[start : start + 100_000]
                known = len(self._known)
                while known + len(part) > len(self._rows):
                    self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
                self._rows[known : known + len(part)] = self.words(part)
                self._known.update(zip(part, range(known, known + len(part))))
            at = list(map(self._known.__getitem__, every))
        out = np.full((len(texts), len(self.langs)), np.inf)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        some = np.flatnonzero(sizes)
        if len(some):
            firsts = (np.cumsum(sizes) - sizes)[some]
            sums = np.add.reduceat(self._rows[np.array(at, np.int64)].astype(np.float64), firsts, axis=0)
            out[some] = -sums[:, :-1] / sums[:, -1:]
        return out

    def decide(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the best language (-1: none), its score, and whether it is accepted."""
        some = np.isfinite(h).all(axis=1)
        best = np.where(some, np.argmin(np.where(np.isfinite(h), h, np.inf), axis=1), -1)
        low = np.where(some, h.min(axis=1), 0.0)
        with np.errstate(over="ignore", invalid="ignore"):
            p = np.where(some, 1 / np.exp(-self.sharp * (h - low[:, None])).sum(axis=1), 0.0)
        return best, np.nan_to_num(p), some & (low <= self.limit)


def _counts(train: DataFrame) -> list[DataFrame]:
    """(lang, g, a) by order: counts at the highest, numbers of left neighbours below it."""
    words = (
        train.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
        .groupBy("lang", "w")
        .agg(F.count("*").alias("n"))
        .withColumn("w", F.concat(F.lit(" " * (ORDER - 1)), "w", F.lit(" ")))
    )
    top = (
        words.select("lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - ORDER + 1), lambda i: F.substring("w", i, F.lit(ORDER)))).alias("g"))
        .groupBy("lang", "g")
        .agg(F.sum("n").alias("a"))
    )
    out = [cut(top)]
    for _ in range(ORDER - 1):
        out.append(out[-1].groupBy("lang", F.substring("g", 2, ORDER).alias("g")).agg(F.count("*").alias("a")))
    return out[::-1]


class Tables:
    """A model in tables, for as many n-grams as there are."""

    def __init__(self, langs: list[str], grams: list[DataFrame], floor: dict[str, float]):
        self.langs, self.grams, self.floor = langs, grams, floor
        self.sharp, self.limit = 10.0, np.inf

    decide = Model.decide

    def entropies(self, docs: DataFrame) -> DataFrame:
        """(text_key, h) of the texts in ``docs`` that have a letter: cross-entropy per character by language.

        Copies of a text add to sums and to lengths alike, so they change nothing.
        """

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for key, text in zip(b["text_key"], b["text"]):
                    rows += [(key, w, c) for w, c in Counter(letter_words(text or "")).items()]
                yield pd.DataFrame(rows, columns=["text_key", "w", "c"])

        words = docs.select(_text_key(), "text").mapInPandas(run, "text_key binary, w string, c long")
        padded = F.concat(F.lit(" " * (ORDER - 1)), "w", F.lit(" "))
        cuts = cut(words.select("w").distinct().select("w", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))).alias("g")))
        asked = [cuts.select("g").distinct()]
        for n in range(ORDER - 1, 0, -1):
            asked.append(asked[-1].select(F.substring("g", 2, n).alias("g")).distinct())
        floor = F.array(*[F.lit(self.floor[x]) for x in self.langs])
        scored = None
        for n, (grams, want) in enumerate(zip(self.grams, asked[::-1]), 1):
            got = want.join(grams.where(~F.col("context")).select("g", F.col("v").alias("own")).hint("merge"), "g", "left")
            if n == 1:
                below = floor
            else:
                contexts = grams.where("context").select(F.col("g").alias("h"), F.col("v").alias("back"))
                got = got.withColumn("h", F.substring("g", 1, n - 1)).join(contexts.hint("merge"), "h", "left").withColumn("u", F.substring("g", 2, n - 1))
                got = got.join(scored.select(F.col("g").alias("u"), F.col("p").alias("lower")).hint("merge"), "u")
                below = F.when(F.col("back").isNull(), F.col("lower")).otherwise(F.zip_with("lower", "back", lambda x, y: x + F.coalesce(y, F.lit(0.0))))
            p = F.when(F.col("own").isNull(), below).otherwise(F.zip_with("own", below, lambda x, y: F.coalesce(x, y)))
            scored = cut(got.select("g", p.alias("p")))
        sums = [F.sum(F.col("p")[i]).alias(f"l{i}") for i in range(len(self.langs))]
        by_word = cuts.join(scored.hint("merge"), "g").groupBy("w").agg(*sums)
        totals = [(-F.sum(F.col("c") * F.col(f"l{i}")) / F.sum(F.col("c") * (F.length("w") + 1))) for i in range(len(self.langs))]
        return words.join(by_word.hint("merge"), "w").groupBy("text_key").agg(F.array(*totals).alias("h"))


def _text_key() -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("text_key")


def _in_tables(tables: list[DataFrame], langs: list[str], discount: dict[tuple[str, int], float]) -> Tables:
    """The same estimate as in arrays, order by order: (g, context, v) with a value for each language, null where it has none."""

    def side_by_side(t: DataFrame, key: str, context: bool) -> DataFrame:
        one = [F.max(F.when(F.col("lang") == x, F.log("v"))) for x in langs]
        return t.groupBy(F.col(key).alias("g")).agg(F.array(*one).alias("v")).withColumn("context", F.lit(context))

    grams, floor, below = [], {}, None
    discounts = tables[0].sparkSession.createDataFrame([(x, n, d) for (x, n), d in discount.items()], "lang string, n int, d double")
    for n, t in enumerate(tables, 1):
        t = _with_contexts(t, n).join(discounts.where(F.col("n") == n).drop("n"), "lang").withColumn("weight", F.col("d") * F.col("m") / F.col("s"))
        if n == 1:
            t = t.withColumn("lower", 1 / (F.col("m") + 1.0))
            floor = {r.lang: float(np.log(r.weight / (r.m + 1.0))) for r in t.groupBy("lang").agg(F.first("weight").alias("weight"), F.first("m").alias("m")).collect()}
        else:
            t = t.withColumn("u", F.substring("g", 2, n - 1)).join(below.hint("merge"), ["lang", "u"])
        t = cut(t.withColumn("v", F.greatest(F.col("a") - F.col("d"), F.lit(0.0)) / F.col("s") + F.col("weight") * F.col("lower")))
        below = t.select("lang", F.col("g").alias("u"), F.col("v").alias("lower"))
        one = side_by_side(t, "g", False)
        if n > 1:
            one = one.unionByName(side_by_side(t.withColumn("v", F.least("weight", F.lit(1.0))), "h", True))
        grams.append(cut(one))
    return Tables(langs, grams, floor)


def _measured(tables: list[DataFrame]) -> tuple[list[str], dict[tuple[str, int], float], int]:
    """Languages, the discount of each language and order, and the number of n-grams."""
    whole = None
    for n, t in enumerate(tables, 1):
        one = t.groupBy("lang").agg(F.count("*").alias("k"), F.count_if(F.col("a") == 1).alias("once"), F.count_if(F.col("a") == 2).alias("twice")).withColumn("n", F.lit(n))
        whole = one if whole is None else whole.unionByName(one)
    # One row per language and order.
    rows = whole.collect()
    discount = {(r.lang, r.n): min(0.95, max(0.1, r.once / max(1, r.once + 2 * r.twice))) for r in rows}
    return sorted({r.lang for r in rows}), discount, sum(r.k for r in rows)


def _with_contexts(t: DataFrame, n: int) -> DataFrame:
    """(lang, g, h, a, s, m): the n-grams with the sum and the number of those that share their context ``h``."""
    t = t.withColumn("h", F.substring("g", 1, n - 1) if n > 1 else F.lit(""))
    return t.join(t.groupBy("lang", "h").agg(F.sum("a").alias("s"), F.count("*").alias("m")).hint("merge"), ["lang", "h"])


def _in_arrays(model: Tables) -> Model:
    """The same model in sorted hash arrays: hashes and values are made in the tasks, the driver joins them up."""
    k = len(model.langs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                grams = list(b["g"])
                values = np.array([[np.nan if x is None else x for x in v] for v in b["v"]], np.float32)
                yield pd.DataFrame({"h": _hashes(_points(grams, len(grams[0]))).view(np.int64), "context": b["context"], "v": [x.tobytes() for x in values]})

    grams, contexts = [], []
    for t in model.grams:
        # Grams and contexts of one table differ in length.
        parts = [t.where(F.col("context") == c).mapInPandas(run, "h long, context boolean, v binary").select("h", "v").toArrow() for c in (False, True)]
        arrays = []
        for p in parts:
            h = p.column("h").to_numpy().view(np.uint64)
            v = np.frombuffer(b"".join(p.column("v").to_pylist()), np.float32).reshape(-1, k)
            order = np.argsort(h)
            arrays.append((h[order], v[order]))
        grams.append(arrays[0])
        contexts.append(arrays[1])
    return Model(model.langs, grams, contexts, np.array([model.floor[x] for x in model.langs], np.float32))


def fit(train: DataFrame, most: int = MODEL_BYTES) -> Model | Tables | None:
    """The model of ``train`` (text, lang), in arrays up to ``most`` bytes, else in tables; null if there is no labelled text with a letter."""
    tables = _counts(train)
    langs, discount, size = _measured(tables)
    if not langs:
        return None
    model = _in_tables(tables, langs, discount)
    # There are no more contexts than n-grams.
    return _in_arrays(model) if 2 * size * (8 + 4 * len(langs)) <= most else model


def calibrate(model: Model | Tables, sample: pd.DataFrame, h: np.ndarray) -> None:
    """Sets the sharpness of the score and the bound of acceptance from labelled texts and their cross-entropies."""
    own = np.array([model.langs.index(x) for x in sample["lang"]], int)
    some = np.isfinite(h).all(axis=1)
    h, own = h[some], own[some]
    if not len(h):
        return
    z = -(h - h.min(axis=1, keepdims=True))

    def loss(b: float) -> float:
        return float(np.mean(np.log(np.exp(b * z).sum(axis=1)) - b * z[np.arange(len(own)), own]))

    model.sharp = min((0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0), key=loss)
    model.limit = float(np.quantile(h[np.arange(len(own)), own], 0.999))


IDENTIFIED = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean, cross_entropy double"


def identify(docs: DataFrame, model: Model | Tables | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted, cross_entropy) of every row of ``docs``."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (_fold() == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    if isinstance(model, Tables):
        return _identify_in_tables(slim, model)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            texts = [t or "" for t in b["text"]]
            pred, score, ok, low = ["und"] * len(b), np.zeros(len(b)), np.zeros(len(b), bool), np.full(len(b), np.nan)
            start = 0
            while m is not None and start < len(b):
                end, chars = start, 0
                while end < len(b) and (end == start or chars < CHUNK_CHARS):
                    chars += len(texts[end])
                    end += 1
                h = m.texts(texts[start:end])
                best, score[start:end], ok[start:end] = m.decide(h)
                pred[start:end] = [m.langs[k] if k >= 0 else "und" for k in best]
                low[start:end] = np.where(best >= 0, h.min(axis=1), np.nan)
                start = end
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": pred, "score": score, "accepted": ok, "cross_entropy": low})

    return slim.mapInPandas(run, IDENTIFIED)


def _identify_in_tables(slim: DataFrame, model: Tables) -> DataFrame:
    langs, sharp, limit = model.langs, model.sharp, model.limit

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rule = Tables(langs, [], {})
        rule.sharp, rule.limit = sharp, limit
        for b in batches:
            h = np.array([np.full(len(langs), np.inf) if x is None else x for x in b["h"]], float).reshape(len(b), len(langs))
            best, score, ok = rule.decide(h)
            pred = [langs[k] if k >= 0 else "und" for k in best]
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": pred, "score": score, "accepted": ok, "cross_entropy": np.where(best >= 0, h.min(axis=1), np.nan)})

    joined = slim.select("doc_id", "held_out", _text_key()).join(model.entropies(slim).hint("merge"), "text_key", "left")
    return joined.select("doc_id", "held_out", "h").mapInPandas(run, IDENTIFIED)


def learn(docs: DataFrame, most: int = MODEL_BYTES) -> Model | Tables | None:
    """Model of the rows of ``docs`` that are not held out and have a ``lang``."""
    train = docs.where("text is not null and lang is not null").where(_fold() != 2).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    model = fit(train, most)
    if model is not None:
        few = smallest_hashes(train, "doc_id", CALIBRATION_ROWS).select("text", "lang")
        if isinstance(model, Tables):
            few = cut(few)
            few = few.select(_text_key(), "text", "lang").join(model.entropies(few), "text_key").toPandas()
            h = np.array(few["h"].tolist(), float).reshape(len(few), len(model.langs))
        else:
            few = few.toPandas()
            h = model.texts(list(few["text"]))
        calibrate(model, few, h)
    return model


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
