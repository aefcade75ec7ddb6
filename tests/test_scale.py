"""What only shows on larger tables: ids that repeat, files of one write, what a single task takes."""

import math
import os

import pytest

from weftgraph.functions import text as X
from weftgraph.operators import analytics, rank
from weftgraph.plans import graph
from weftgraph.plans.materialize import cut
from weftgraph.sources import graphs, index, logs


def test_similar_entries_with_one_id_stay_single(spark):
    rows = [(1, "open the file", 2700, 80), (1, "close the file", 2800, 80), (2, "the", 2900, 80), (3, "other words", 2900, 80)]
    history = spark.createDataFrame(rows, "id long, query string, tokens_used long, nodes_total long")
    got = sorted((r.id, r.tokens_used) for r in analytics.similar_queries(history, "the file", 0.01).collect())
    assert got == [(1, 2700), (1, 2800), (2, 2900)]


def test_savings_of_a_half_go_up(spark):
    # 1182 / 4000 * 100 is 29.549999999999997 as a double; SQL has 29.6.
    rows = spark.createDataFrame([(2818, 80), (4000, 80), (5000, 80), (1, 0)], "used long, nodes long")
    got = [r.s for r in rows.select(X.savings_percent(rows.used, rows.nodes).alias("s")).collect()]
    assert got == [29.6, 0.0, 0.0, 0.0]


def test_files_of_one_write_go_by_number(spark, tmp_path):
    path = str(tmp_path / "log")
    for name in ("a", "b"):
        spark.range(0, 6, 1, 3).selectExpr(f"to_json(struct(concat('{name}', id) AS query)) AS value").write.mode("append").text(path)
    own = {f: open(f"{path}/{f}").read()[10] for f in os.listdir(path) if f.startswith("part-")}
    # Tasks of a write end in any order, those of the first before those of the second.
    for f, name in own.items():
        at = 1_700_000_000 + (1000 if name == "b" else 0) - int(f[5:10])
        os.utime(f"{path}/{f}", (at, at))
    (tmp_path / "log" / "old.json").write_text('{"query": "c"}\n')
    os.utime(tmp_path / "log" / "old.json", (1_600_000_000, 1_600_000_000))
    want = ["c", *[f"a{i}" for i in range(6)], *[f"b{i}" for i in range(6)]]
    assert [r.query for r in logs.read_session(spark, path).collect()] == want
    assert [r.query for r in logs.read_session(spark, path, 4).collect()] == want[-4:]


def test_percentiles_are_exact_and_not_of_one_task(spark):
    values = [None, *[float(x * x % 997) for x in range(500)], 5.0, 5.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    got = analytics.percentiles(rows, "v")
    known = sorted(v for v in values if v is not None)

    def at(q):
        k = q * (len(known) - 1)
        low, high = known[math.floor(k)], known[math.ceil(k)]
        return round(low + (high - low) * (k - math.floor(k)), 6)

    row = got.first()
    assert (row.p50, row.p75, row.p90, row.p95) == tuple(map(at, (0.5, 0.75, 0.9, 0.95)))
    assert (row.n, row.low, row.high, row.total) == (503, known[0], known[-1], sum(known))
    none = analytics.percentiles(rows.where("v is null"), "v").first()
    assert none.n == 1 and none.p50 is None and none.p95 is None
    # An aggregate that holds a column's values in one buffer grows with them.
    assert "percentile(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_tables_are_dealt_to_more_tasks_as_they_grow(spark, tmp_path, monkeypatch):
    sizes = []
    for n in (2_000, 200_000):
        spark.range(n).selectExpr("id AS l_orderkey", "xxhash64(id) AS l_partkey").coalesce(1).write.parquet(f"{tmp_path}/{n}")
        sizes.append(sum(os.path.getsize(f"{tmp_path}/{n}/{f}") for f in os.listdir(f"{tmp_path}/{n}") if f.endswith(".parquet")))
    monkeypatch.setattr(graph, "SHARE", 100_000)
    dealt = [graph.dealt(spark.read.parquet(f"{tmp_path}/{n}"), "l_orderkey", "l_partkey") for n in (2_000, 200_000)]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [d.rdd.getNumPartitions() for d in dealt] == [max(least, -(-s // 100_000)) for s in sizes]
    assert sizes[1] > 1_000_000 and dealt[1].count() == 200_000
    # Its key is enough for what is grouped by it and more: no second shuffle, no larger tasks.
    plan = dealt[1].groupBy("l_orderkey", "l_partkey").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_rounds_of_ranks_shuffle_no_edges(spark, monkeypatch):
    nodes = spark.range(40).selectExpr("concat('n', id) AS id")
    edges = spark.range(120).selectExpr("concat('n', id % 40) AS src", "concat('n', id * 7 % 31) AS dst", "1.0D AS weight")
    wrote = []
    monkeypatch.setattr(rank, "cut", lambda df, **how: wrote.append((df, cut(df, **how))) or wrote[-1][1])
    got = {r.id: r.rank for r in rank.pagerank(graph.PropertyGraph(nodes, edges), iterations=3, tolerance=None).collect()}
    want = {f"n{i}": 1 / 40 for i in range(40)}
    for _ in range(3):
        new = dict.fromkeys(want, 0.15 / 40 + 0.85 * sum(want[i] for i in want if int(i[1:]) >= 40) / 40)
        for i in range(120):
            new[f"n{i * 7 % 31}"] += 0.85 * want[f"n{i % 40}"] / 3
        want = new
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    # The shares of edges once, then a write a round.
    assert len(wrote) == 4
    steps = wrote[0][1].withColumnRenamed("src", "id")
    plan = steps.join(wrote[1][1].hint("merge"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_graph_files_stay_small_and_others_are_not_parsed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graphs, "FILE_ROWS", 10)
    nodes = spark.range(40).coalesce(1).selectExpr("concat('n', id) AS id", "concat('N', id) AS label")
    edges = spark.range(39).coalesce(1).selectExpr("concat('n', id) AS src", "concat('n', id + 1) AS dst", "'next' AS relation", "1.0D AS weight")
    g = graph.PropertyGraph(nodes, edges)
    graphs.write_graphml(g, str(tmp_path / "g"))
    graphs.write_csv(g, str(tmp_path / "c"))
    parts = lambda p: [f for f in os.listdir(tmp_path / p) if f.startswith("part-")]
    assert [len(parts(p)) for p in ("g/nodes", "g/edges", "c/nodes", "c/relationships")] == [4, 4, 4, 4]
    (tmp_path / "g" / "key.xml").write_text('<graphml><key id="d" for="edge" attr.name="weight"/></graphml>')
    held = graphs._holding(spark, str(tmp_path / "g"), ("key", "node", "edge"))
    assert [len(held[t]) for t in ("key", "node", "edge")] == [1, 4, 4]
    back = graphs.read_graphml(spark, str(tmp_path / "g"))
    assert back.nodes.count() == 40 and sorted((r.src, r.dst, r.relation) for r in back.edges.collect()) == sorted((f"n{i}", f"n{i + 1}", "next") for i in range(39))
    # All ends of CSV edges are nodes: nodes don't read relationships.
    read = graphs.read_csv(spark, str(tmp_path / "c/nodes"), str(tmp_path / "c/relationships")).nodes
    assert read.count() == 40 and not [f for f in read.inputFiles() if "relationships" in f]


def test_parsed_rows_are_read_by_kind(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(index, "assemble", lambda parsed, ignore: seen.append(parsed))
    index.index_files(spark.createDataFrame([("a/A.java", "package a;\nclass A {\n  int f() { return 1; }\n}\n")], "path string, content string"))
    nodes = seen[0].where("kind = 'node'")
    assert "PartitionFilters: [isnotnull(kind" in nodes._jdf.queryExecution().executedPlan().toString()
    assert {r.b for r in nodes.collect()} >= {"A", "f"} and sorted(r.kind for r in seen[0].select("kind").distinct().collect()) == ["edge", "export", "node"]


def test_media_of_a_batch_are_made_in_parts(monkeypatch):
    pa = pytest.importorskip("pyarrow")
    audio = pytest.importorskip("weftgraph.llm.audio")
    at_once = []
    whole = audio.decode_many
    monkeypatch.setattr(audio, "decode_many", lambda media: at_once.append(sum(map(len, media))) or whole(media))
    texts = [None, "", *["some text " * 10_000] * 60]
    batch = pa.RecordBatch.from_arrays([pa.array([None, *range(1, 62)], pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    made = list(audio.digested(iter([batch])))
    assert [i for b in made for i in b.column(0).to_pylist()] == [None, *range(1, 62)]
    assert [n for b in made for n in b.column(1).to_pylist()] == [len(t or "") for t in texts]
    assert len(made) == len(at_once) > 2 and max(at_once) < 2 * audio.CHUNK_BYTES
