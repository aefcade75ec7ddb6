"""Removal of repeated byte strings against brute force over all starts."""

import hashlib
import random

import numpy as np
import pytest

from weftgraph.llm import suffix

SCHEMA = "doc_id long, text string, key string, run string"


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for doc_id, text in order:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - suffix.LENGTH + 1):
            s = data[i : i + suffix.LENGTH]
            if s in seen:
                gone[i : i + suffix.LENGTH] = True
            seen.add(s)
        spans = sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc_id] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    shared = [words(rng, n) for n in (10, 25, 40, 120)]
    docs = []
    for i in range(160):
        parts = [words(rng, rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared)[rng.randrange(30) :], words(rng, rng.randrange(20))]
        docs.append((i * 3 - 40, " ".join(parts)))
    docs += [(1000, docs[5][1]), (1001, docs[5][1] + " tail"), (1002, "a" * 700), (1003, "ab" * 300), (1004, None), (1005, ""), (1006, "x" * 99), (1007, "x" * 100), (1008, "é" * 90 + "ü" * 90), (1009, "é" * 90 + "ü" * 90)]
    rng.shuffle(docs)
    return docs


def result(spark, docs):
    df = spark.createDataFrame([(i, t, "k", "r") for i, t in docs], SCHEMA).repartition(5)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df).collect()}


@pytest.mark.parametrize("least,together", [(20, 16_000_000), (2, 16_000_000), (2, 1)])
def test_like_brute_force(spark, monkeypatch, least, together):
    """Also with frequent grams dealt apart, and with little put together before rows are dealt."""
    real = suffix.frequent_grams
    monkeypatch.setattr(suffix, "frequent_grams", lambda texts: real(texts, least=least))
    monkeypatch.setattr(suffix, "TOGETHER_BYTES", together)
    docs = corpus(7)
    assert result(spark, docs) == brute(docs)


def test_order_of_ids_decides(spark):
    rng = random.Random(3)
    t = words(rng, 60)
    got = result(spark, [(5, t), (2, t), (9, "new " + t)])
    assert got[2][1] == 0 and got[5][1] == len(t) and got[9][1] == len(t)


def test_repeated_rows_and_null_ids(spark):
    rng = random.Random(4)
    t, u = words(rng, 50), words(rng, 50)
    df = spark.createDataFrame([(1, t, "", ""), (1, t, "", ""), (None, u, "", ""), (3, u, "", "")], SCHEMA)
    rows = suffix.remove_repeats(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in rows) == [(False, 1, 0), (False, 1, 0), (False, 3, len(u)), (True, 0, 0)]


def test_one_id_with_two_texts(spark):
    rng = random.Random(5)
    t = words(rng, 50)
    df = spark.createDataFrame([(1, t, "", ""), (1, t + " more", "", "")], SCHEMA)
    assert sorted(r.n_removed for r in suffix.remove_repeats(df).collect()) == [0, len(t)] or sum(r.n_removed > 0 for r in suffix.remove_repeats(df).collect()) == 1


def test_empty_table(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_equal_rows_in_one_partition(spark):
    """Also with a passage whose surroundings differ, so that its positions are ranked."""
    rng = random.Random(6)
    t, u, shared = words(rng, 50), words(rng, 50), words(rng, 40)
    docs = [(1, t), (2, f"{words(rng, 20)} {shared} {words(rng, 20)}"), (3, f"{words(rng, 20)} {shared} {words(rng, 20)}"), (4, u)]
    want = brute(docs)
    assert want[1][1] == want[2][1] == 0 and want[3][1] > 100
    for parts in (1, 5):
        df = spark.createDataFrame([(i, x, "", "") for i, x in docs + docs], SCHEMA).coalesce(1).repartition(parts)
        rows = suffix.remove_repeats(df).collect()
        assert len(rows) == 2 * len(docs) and all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in rows)


def test_pieces_of_long_texts(monkeypatch):
    docs = corpus(9)
    monkeypatch.setattr(suffix, "PIECE_BYTES", 150)
    got = {}
    for own, begin, data, bounds in suffix._chunks([t for _, t in docs]):
        piece, lo, hi, *_ = suffix.anchors_of(data, bounds)
        for k, a, b in zip(own[piece], lo + begin[piece], hi + begin[piece]):
            got.setdefault(int(k), []).extend(range(a, b + 1))
    for k, (_, t) in enumerate(docs):
        assert sorted(got.get(k, [])) == list(range(max(0, len((t or "").encode()) - suffix.LENGTH + 1)))


def test_text_beyond_the_numbers_of_positions(spark):
    rng = np.random.default_rng(10)
    long = bytes(rng.integers(97, 123, 17_000_000, dtype=np.uint8)).decode()
    edge = long[suffix.PIECE_BYTES - 300 : suffix.PIECE_BYTES + 300]
    got = result(spark, [(1, long), (2, edge)])
    assert got[1][:2] == (len(long), 0) and got[2][:2] == (600, 600)
