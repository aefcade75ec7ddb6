"""Registered queries take whole texts, whole graphs and settled ranks."""

import math

import pytest

from weftgraph.plans import catalog

SOURCES = ("src0", "src1")
FILLER = "filler word " * 40


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """Documents whose searched words and ends come after more than 200 characters."""
    rows = [(i, FILLER + ("en the " if i % 3 == 0 else "") + f"end{i}", "en", SOURCES[i % 2]) for i in range(12)]
    d = str(tmp_path_factory.mktemp("documents"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    return d, rows


def test_embedding_text_is_whole(spark, documents):
    d, rows = documents
    got = {r.id: r.text for r in catalog.QUERIES["P5_P6_names"](spark, d).collect()}
    assert got == {f"doc:{i}": f"sourceDoc_{source} {lang} {text}" for i, text, lang, source in rows}


def test_benchmark_reads_whole_texts(spark, documents):
    d, rows = documents
    lines = [f"doc:{i} sourceDoc_{source} ({lang}) {text}" for i, text, lang, source in rows]
    got = catalog.QUERIES["C2_A10_benchmark"](spark, d).collect()
    # A line may end in the path of its file; costs count at least the whole text.
    assert len(got) == 4 and all(r.whole >= sum(math.ceil(len(x) / 4) for x in lines) for r in got)
    by = {(r.query, r.budget): r for r in got}
    assert by["en the", 1000].nodes_selected < len(rows) == by["en the", 4000].nodes_selected


def settled(ids, edges, alpha=0.85, rounds=100, tolerance=1e-6):
    """Ranks by plain power iteration."""
    n = len(ids)
    out = {i: sum(w for a, _, w in edges if a == i) for i in ids}
    rank = dict.fromkeys(ids, 1 / n)
    for _ in range(rounds):
        mass = sum(rank[i] for i in ids if not out[i])
        new = {i: (alpha * mass + 1 - alpha) / n for i in ids}
        for a, b, w in edges:
            new[b] += alpha * rank[a] * w / out[a]
        change, rank = sum(abs(new[i] - rank[i]) for i in ids), new
        if change < n * tolerance:
            break
    top = max(rank.values())
    return {i: r / top for i, r in rank.items()}


def test_ranks_settle(spark, documents):
    d, rows = documents
    ids = [f"doc:{i}" for i, *_ in rows]
    want = settled(ids, [(f"doc:{i}", f"doc:{i + 2}", 1.0) for i, *_ in rows[:-2]])
    got = {r.id: r.structural for r in catalog.QUERIES["G4_G5_combined_score"](spark, d).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in ids)
    first = {i: r for i, r in settled(ids, [(f"doc:{i}", f"doc:{i + 2}", 1.0) for i, *_ in rows[:-2]], rounds=3).items()}
    assert any(abs(first[i] - want[i]) > 1e-3 for i in ids)


def test_benchmark_and_entity_ranks_use_defaults(spark, documents, monkeypatch):
    asked = []
    whole = catalog.rank.pagerank
    monkeypatch.setattr(catalog.rank, "pagerank", lambda g, *args, **params: asked.append((args, params)) or whole(g, *args, **params))
    monkeypatch.setattr(catalog, "entity_graph", catalog.document_graph)
    catalog.QUERIES["G1_G2_pagerank"](spark, documents[0])
    catalog.QUERIES["C2_A10_benchmark"](spark, documents[0])
    assert asked == [((), {}), ((), {})]


@pytest.fixture
def entities(spark, monkeypatch):
    """A graph with nodes of all six types; edges lead from each to the next."""
    types = ("region", "nation", "supplier", "customer", "part", "order")
    rows = [(f"{t}:{'1' * (k + 1)}", f"{t.title()}{k}", t, "about", f"schema/{t}.sql") for t in types for k in range(3)]
    edges = [(a[0], b[0], "to", 1.0) for a, b in zip(rows, rows[1:])]
    g = catalog.PropertyGraph(spark.createDataFrame(rows, "id string, label string, type string, description string, source_file string"), spark.createDataFrame(edges, "src string, dst string, relation string, weight double"))
    monkeypatch.setattr(catalog, "entity_graph", lambda *_: g)
    return rows


def test_viz_shows_all_types(spark, entities):
    got = {r.id: r.size for r in catalog.QUERIES["P20_P21_viz"](spark, "").collect()}
    scores = {r[0]: len(r[0]) * 7 % 50 for r in entities}
    lo, hi = min(scores.values()), max(scores.values())
    assert got.keys() == scores.keys() and all(abs(got[i] - (14 + 18 * (s - lo) / (hi - lo))) <= 0.0051 for i, s in scores.items())


def test_selection_takes_all_types(spark, entities):
    cost = lambda r: math.ceil(len(f"{r[0]} {r[1]} ({r[2]}) {r[3]} -> {r[4]}") / 4)
    scores = {r[0]: round((len(r[0]) * 37 + len(r[1]) * 11) % 101 / 100, 2) for r in entities}
    want, left = [], 300
    for r in sorted(entities, key=lambda r: (-scores[r[0]], r[0])):
        if scores[r[0]] >= 0.2 and cost(r) <= left:
            want.append(r[0])
            left -= cost(r)
    got = [r.id for r in catalog.QUERIES["G9_select_without_boost"](spark, "").orderBy("pos").collect()]
    assert got == want and {"part", "order", "customer"} & {i.split(":")[0] for i in got}
    scored = {r[0] for r in spark.createDataFrame(entities, "id string, label string, type string, description string, source_file string").selectExpr("id", "pmod(xxhash64(id), 1000) / 1000 AS s").where("s >= 0.3").collect()}
    boosted = catalog.QUERIES["G9_select_with_boost"](spark, "").where("budget = 4000").collect()
    assert {r.id for r in boosted} == scored and {"part", "order"} & {i.split(":")[0] for i in scored}
