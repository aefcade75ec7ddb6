"""The pipeline's stages, each against brute force on what the one before it kept."""

import os
import re
import zlib
from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from test_operators import brute_components, brute_spans  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def test_stages(spark, tmp_path):
    from weftgraph.llm import tokens

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, [docs.collect()]
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert name == "packing" or out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.collect())
    raw, good, single, masked, mixed, packed = kept
    assert 0.4 * len(raw) < len(good) < len(raw) and set(good) <= set(raw)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    fine = [r for r in raw if labels.get(r.doc_id) == 1 and words(r.text) >= 200]
    assert sum(r in good for r in fine) >= 0.9 * len(fine)
    parts = brute_components([(r.doc_id, r.text) for r in good], 5, 80)
    assert {r.doc_id for r in single} == {c for _, c in parts.values()}
    assert {r.doc_id for r in masked} == {r.doc_id for r in single} and any("[SECRET]" in r.text for r in masked) == any(brute_spans(r.text) for r in single)
    assert not [r for r in masked for s in brute_spans(r.text) if "SECRET" not in r.text[s[0] : s[3]]]
    before = {r.doc_id: r for r in single}
    assert all(r == before[r.doc_id] for r in masked if "[SECRET]" not in r.text)
    assert set(mixed) <= set(masked) and max(Counter(r.doc_id for r in mixed).values()) <= 2
    total = sum(words(r.text) for r in masked)
    assert 1.3 * total < sum(words(r.text) for r in mixed) < 1.6 * total
    ids = tokens.encoder(tokens.vocabulary_path())
    want = Counter((r.doc_id, zlib.crc32(ids.encode(r.text) + (0).to_bytes(4, "little"))) for r in mixed)
    assert sum(p.length for p in packed) == sum(len(ids.encode(r.text)) // 4 + 1 for r in mixed)
    assert {p.doc_id for p in packed} == {i for i, _ in want}


def test_near_duplicates_leave_small_estimates(spark, monkeypatch):
    """What the second stage writes on the way carries no size estimate that grows with its joins."""
    from weftgraph.llm import graph, minhash

    bits, cut = [], minhash.cut

    def spy(df):
        out = cut(df)
        bits.append(out._jdf.queryExecution().analyzed().stats().sizeInBytes().bit_length())
        return out

    monkeypatch.setattr(graph, "cut", spy)
    monkeypatch.setattr(minhash, "cut", spy)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    dict(pipeline.STAGES)["near_duplicates"](spark, docs, DATA)
    assert len(bits) > 8 and max(bits) <= 64


@pytest.mark.parametrize("stage", ["quality", "near_duplicates"])
def test_workers_hold_parts_of_a_batch(spark, monkeypatch, stage):
    """A worker makes Python's objects of a part of an Arrow batch at a time, however many texts there are in one."""
    import tracemalloc

    import pyarrow as pa
    from weftgraph.llm import minhash, quality

    class Docs:
        schema = None

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            self.run = run
            return self

    monkeypatch.setattr(quality, "learn", lambda *_: None)
    texts = [" ".join(f"{i:03}{j:02}" * 200 for j in range(60)) for i in range(600)]
    texts[5], texts[6], texts[7] = None, "", "é" * 600_000
    batch = pa.RecordBatch.from_pydict({"doc_id": [None, *range(1, 600)], "text": texts})
    docs = quality.good_documents(Docs(), None) if stage == "quality" else minhash.sketches(Docs(), 5)
    whole = sum(len(t or "") for t in texts)
    list(docs.run(iter([batch.slice(0, 2)])))  # what is imported or made once
    tracemalloc.start()
    sizes, got = [], []
    for b in docs.run(iter([batch.slice(0, 0), batch])):
        sizes.append(b.num_rows)
        got += b.column(0).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    kept = [i for i, t in enumerate(texts) if stage != "quality" or len((t or "").split()) >= 50]
    assert got == [i or None for i in kept] and len(sizes) > 10
    assert whole > 36e6 and peak < whole / 2


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_llm_queries_like_sql(spark):
    import duckdb

    from weftgraph.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    for name, sql in ORACLES.items():
        want = con.execute(sql)
        columns = sorted(c[0] for c in want.description)
        at = [[c[0] for c in want.description].index(c) for c in columns]
        got = QUERIES[name](spark, DATA)
        rows = lambda xs: sorted([f"{v:.9g}" if isinstance(v, float) else str(v) for v in x] for x in xs)
        assert sorted(got.columns) == columns and rows([r[c] for c in columns] for r in got.collect()) == rows([x[i] for i in at] for x in want.fetchall())
