"""Language models keep every n-gram, in arrays and in tables."""

import math
import random

import numpy as np

from weftgraph.llm import langid


def test_small_bound_loses_nothing(spark):
    rng = random.Random(21)
    letters = {"aa": "abcdeklmo", "bb": "degrstuvw", "cc": "aghinquxz"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randrange(2, 9)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.randrange(1, 25))), lang) for i in range(240) for lang in [rng.choice(list(letters))]]
    rows += [(500, None, "aa"), (501, "12 !?", "bb"), (502, "é𝒳 ǆabc İx", None), (503, rows[0][1], "aa"), (503, rows[0][1], "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    arrays, tables = langid.learn(df), langid.learn(df, most=100)
    assert isinstance(arrays, langid.Model) and isinstance(tables, langid.Tables)
    assert arrays.sharp == tables.sharp and abs(arrays.limit - tables.limit) < 1e-4
    near = lambda a, b: math.isnan(a) and math.isnan(b) or abs(a - b) < 1e-4
    key = lambda r: r.doc_id
    a, b = (sorted(langid.identify(df, m).collect(), key=key) for m in (arrays, tables))
    assert len(a) == len(b) == len(rows)
    for x, y in zip(a, b):
        assert (x.doc_id, x.held_out, x.lang_pred) == (y.doc_id, y.held_out, y.lang_pred)
        assert near(x.cross_entropy if x.cross_entropy is not None else math.nan, y.cross_entropy if y.cross_entropy is not None else math.nan) and abs(x.score - y.score) < 1e-3


def labelled(spark, seed, texts, size):
    rng = random.Random(seed)
    letters = {"aa": "abcdeklmorst", "bb": "abcdegrstuvw", "cc": "abdeghinrstu"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randrange(2, 6)))
    rows = [(i, " ".join(word(lang) for _ in range(size)), lang) for i in range(texts) for lang in [rng.choice(list(letters))]]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_probabilities_sum_to_one(spark):
    rows, df = labelled(spark, 31, 300, 12)
    model = langid.learn(df)
    letters = sorted({c for _, t, _ in rows for c in t})

    def p(context, c):
        total, back = np.full(len(model.langs), np.nan), np.zeros(len(model.langs))
        for n in range(len(context) + 1, 0, -1):
            points = langid._points([context[len(context) - n + 1 :] + c], n)
            got = model._find(*model.grams[n - 1], langid._hashes(points))[0] + back
            total = np.where(np.isnan(total), got, total)
            if n > 1:
                back = back + np.nan_to_num(model._find(*model.contexts[n - 1], langid._hashes(points[:, :-1]))[0])
        return np.exp(np.where(np.isnan(total), model.floor + back, total))

    for context in ["    ", "   a", "  st", "abst", "rs a", "gggg", "t"]:
        mass = sum(p(context, c) for c in letters)
        # What letters that a language lacks get is shared by them: each one's floor counts once.
        lacking = np.array([sum(1 for c in letters if c not in "".join(t for _, t, x in rows if x == lang)) for lang in model.langs])
        one = p(context, "\u0416")
        assert np.allclose(mass - lacking * one + one, 1, atol=1e-4), (context, mass)


def test_words_are_cut_as_in_training(spark):
    rows, df = labelled(spark, 32, 60, 5)
    texts = ["a\u00b2b c3d e_f \u00bd", "\u0130x \u01c6 \u2160v \u00aa"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    cut = {r.i: r.w for r in df.selectExpr("i", r"regexp_extract_all(lower(text), '\\p{L}+', 0) AS w").collect()}
    assert [langid.letter_words(t) for t in texts] == [cut[0], cut[1]]


def test_close_languages_held_out(spark):
    """Alphabets that mostly overlap, short texts: far from certain, and the scores say so."""
    rows, df = labelled(spark, 33, 1500, 6)
    lang = {i: x for i, _, x in rows}
    got = [r for r in langid.identify(df, langid.learn(df)).collect() if r.held_out]
    right = sum(r.lang_pred == lang[r.doc_id] for r in got) / len(got)
    assert len(got) > 250 and 0.85 < right <= 1
    assert abs(sum(r.score for r in got) / len(got) - right) < 0.08
