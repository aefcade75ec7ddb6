"""The command line, reports, views, settings, federation, changes and evaluation."""

import functools
import json
import os
import re
import subprocess

import pytest
from pyspark.sql import functions as F

from weftgraph import cli, config
from weftgraph.functions import text as X
from weftgraph.operators import analytics, evaluate, rank
from weftgraph.operators import select as S
from weftgraph.plans import federation, reports, view
from weftgraph.plans.graph import PropertyGraph
from weftgraph.sources import changes, graphs, index, logs

NODES = [
    ("app", "app", "module", "code", "Source file app.py", "app.py"), ("app.sign_in", "sign_in", "function", "code", "checks a password", "app.py"),
    ("store", "store", "module", "code", "", "store.py"), ("store.Users", "Users", "class", "code", "user rows <b> & more", "store.py"),
    ("tests.check", "check", "function", "code", "", "tests/test_app.py"), ("mail", "mail", "module", "code", "sends letters", "mail.py"),
]
EDGES = [("app", "app.sign_in", "contains"), ("app.sign_in", "store.Users", "calls"), ("tests.check", "app.sign_in", "calls"), ("store", "store.Users", "contains"), ("mail", "store.Users", "calls")]


def as_json(path, nodes=NODES, edges=EDGES):
    keys = ("id", "label", "type", "file_type", "description", "source_file")
    path.write_text(json.dumps({"nodes": [dict(zip(keys, n)) for n in nodes], "links": [{"source": a, "target": b, "relation": r, "weight": 1.0} for a, b, r in edges]}))
    return str(path)


@pytest.fixture
def graph(spark, tmp_path):
    return graphs.load(spark, as_json(tmp_path / "g.json"))


def ran(spark, *argv, provider=None):
    said = []
    return cli.main([str(x) for x in argv], spark, said.append, provider), "\n".join(map(str, said))


def test_every_command(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(rank, "pagerank", functools.partial(rank.pagerank, iterations=2))
    old = as_json(tmp_path / "old.json")
    new = as_json(tmp_path / "new.json", [*NODES[:-1], ("pay", "pay", "module", "code", "", "pay.py"), ], [*EDGES[:-1], ("pay", "app.sign_in", "calls")])
    folder, page = tmp_path / "log", tmp_path / "page.html"
    code, text = ran(spark, "run", "password check", "-g", old, "--log-dir", folder, "--viz", page, "--explain", "--suggest")
    assert code == 0 and "sign_in" in text and "semantic" in text and "<canvas" in page.read_text()
    assert ran(spark, "run", "store users", "-g", old, "--log-dir", folder, "-f", "json")[0] == 0
    assert logs.read_audit(spark, str(folder / "audit")).count() == 2
    code, text = ran(spark, "advisor", "password", "--log-dir", folder)
    assert code == 0 and "tokens, confidence" in text
    assert "node" in ran(spark, "audit", "--log-dir", folder)[1]
    assert "6 nodes, 5 links" in ran(spark, "stats", "-g", old)[1]
    code, text = ran(spark, "diff", old, new, "--viz", tmp_path / "d.html", "--budget", 500)
    assert code == 0 and "1 added, 1 removed" in text and text.index("removed | mail") < text.index("added | pay") and "severity" in text
    assert "[END OF CONTEXT]" in ran(spark, "export", "users", "-g", old, "-f", "chatgpt")[1]
    code, text = ran(spark, "benchmark", "-g", old, "-q", "password", "-q", "users", "-b", 50, "--output", tmp_path / "b.json")
    assert code == 0 and "best" in text and len(json.loads((tmp_path / "b.json").read_text())) == 2
    assert ran(spark, "benchmark", "-g", old, "-q", "x", "--price-model", "none")[0] == 1 and "no price" in capsys.readouterr().err
    code, text = ran(spark, "explain", "Users", "-g", old)
    assert code == 0 and "- mail" in text and "Further" in text
    code, text = ran(spark, "impact", "store.py", "-g", old, "--output", "json", "--viz", tmp_path / "i.html")
    assert code == 0 and json.loads(text[: text.rindex("}") + 1])["direct"] == 2
    assert "Advice" in ran(spark, "impact", "store.py", "-g", old)[1]
    assert "structure-1" in ran(spark, "eval", "-g", old, "--dry-run")[1] and ran(spark, "eval", "-g", old)[0] == 1
    assert ran(spark, "session", "--log-dir", folder)[0] == 1
    (folder / "session").mkdir()
    assert logs.append_session(spark, str(folder / "session"), "q one", 100, {"tokens_used": 50, "nodes_total": 4, "nodes_selected": 2}, "2024-01-01T00:00:00")
    assert "75.0%  q one" in ran(spark, "session", "--log-dir", folder)[1]
    assert not logs.append_session(spark, str(tmp_path / "absent"), "q", 1, {})
    assert ran(spark, "config", "set", "provider", "openai", "--config-dir", tmp_path / "c")[0] == 0
    assert '"provider": "openai"' in ran(spark, "config", "show", "--config-dir", tmp_path / "c")[1]
    assert ran(spark, "config", "set", "color", "red", "--config-dir", tmp_path / "c")[0] == 1
    with pytest.raises(SystemExit):
        cli.main(["no-such-command"])


def test_index_and_init(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib/a.py").write_text("def one():\n    return 1\n")
    (tmp_path / "b.py").write_text("from lib.a import one\n\ndef two():\n    return one()\n")
    code, text = ran(spark, "index", tmp_path)
    assert code == 0 and "python (2)" in text
    g = graphs.load(spark, str(tmp_path / "graph.json"))
    assert g.edges.where("src = 'b.two' and dst = 'lib.a.one'").count() == 1
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b", "-c", "user.name=n", "commit", "-q", "--allow-empty", "-m", "x"], check=True)
    subprocess.run(["git", "-C", str(tmp_path), "add", "."], check=True)
    subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b", "-c", "user.name=n", "commit", "-q", "-m", "y"], check=True)
    (tmp_path / "lib/a.py").write_text("def one():\n    return 1\n\ndef three():\n    return one()\n")
    (tmp_path / "notes.txt").write_text("no source")
    assert changes.in_git(str(tmp_path)) and not changes.in_git("/")
    assert [r.source_file for r in changes.changed_files(spark, str(tmp_path)).collect()] == ["lib/a.py"]
    # Who imports the changed file is indexed again, too.
    again = {(r.source_file, r.depth) for r in changes.to_index_again(g, changes.changed_files(spark, str(tmp_path))).collect()}
    assert again == {("lib/a.py", 0), ("b.py", 1)}
    assert ran(spark, "index", tmp_path, "--smart")[0] == 0
    new = graphs.load(spark, str(tmp_path / "graph.json"))
    assert new.nodes.where("id = 'lib.a.three'").count() == 1 and new.nodes.where("id = 'b.two'").count() == 1
    (tmp_path / ".mcp.json").write_text('{"mcpServers": {"other": {}}, "kept": 1}')
    assert ran(spark, "init", tmp_path)[0] == 0
    saved = json.loads((tmp_path / ".mcp.json").read_text())
    assert saved["kept"] == 1 and set(saved["mcpServers"]) == {"other", "weftgraph"}


def test_views_are_safe_and_bounded(graph):
    nasty = graph.nodes.withColumn("label", F.lit("</script><b>"))
    page = view.page(PropertyGraph(nasty, graph.edges), graph.nodes.select("id", F.lit(0.5).alias("score")), "a <b> title", most=4)
    data = json.loads(re.search(r'id="data">(.*?)</script>', page, re.S)[1])
    assert len(data["nodes"]) == 4 and data["left"] == 2 and page.count("</script>") == 2 and "a &lt;b&gt; title" in page
    assert all(14 <= n["size"] <= 32 for n in data["nodes"])
    rings = {r.id: (r.kind, r.score) for r in view.impact_scores(graph.nodes.sparkSession.createDataFrame([("a", "owned"), ("a", "safe"), ("b", "transitive"), ("c", "direct")], "id string, kind string")).collect()}
    assert rings == {"a": ("owned", 1.0), "b": ("transitive", 0.3), "c": ("direct", 0.6)}


def test_relation_between_nodes(graph):
    assert reports.relation(graph, "app", "app.sign_in") == "contains" == reports.relation(graph, "app.sign_in", "app")
    assert reports.relation(graph, "app", "mail") == "related"


def test_parser_lines(spark):
    rows = lambda n: spark.createDataFrame([(f"l{k}", 9 - k) for k in range(n)], "language string, files int")
    assert reports.parsers(rows(2)) == "Parsers: l0 (9), l1 (8)" and reports.parsers(rows(5)).count("\n") == 2


def test_labels():
    assert federation.labels_of(["a/x.json", "b/y.json"]) == ["x", "y"]
    assert federation.labels_of(["one/made-out/graph.json", "two/made-out/graph.json", "graph.json"]) == ["one", "two", "graph3"]
    assert federation.labels_of(["p/graph.json", "p/graph.json"]) == ["p", "graph2"]
    assert federation.checked_labels(2, None) == ["graph1", "graph2"]
    for bad in (["a"], ["a", "a"]):
        with pytest.raises(ValueError):
            federation.checked_labels(2, bad)


def test_merged_files(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "q").mkdir()
    g = federation.load_merged(spark, [as_json(tmp_path / "p/graph.json"), as_json(tmp_path / "q/graph.json")])
    assert g.nodes.count() == 12 and g.nodes.where("id = 'p::app'").count() == 1 and g.edges.where("src = 'q::app'").count() == 1


def test_settings(tmp_path):
    folder = str(tmp_path / "c")
    assert config.resolve(folder=folder, env={}) == config.Settings()
    assert config.resolve(folder=folder, env={"OPENAI_API_KEY": "k1"}).api_key == "k1"
    config.write("provider", "ollama", folder)
    config.write("temperature", "warm", folder)
    config.write("api_key", "secret99", folder)
    got = config.resolve(folder=folder, env={"OPENAI_API_KEY": "k1"})
    assert (got.provider, got.temperature, got.api_key) == ("ollama", 0.3, "secret99") and config.resolve("openai", folder=folder, env={}).provider == "openai"
    assert config.masked(config.read(folder))["api_key"] == "…et99"
    with pytest.raises(config.ConfigError):
        config.write("provider", "nobody", folder)
    assert config.find_graph(str(tmp_path)) is None
    (tmp_path / "my-out").mkdir()
    (tmp_path / "my-out/graph.json").write_text("{}")
    assert config.find_graph(str(tmp_path)).endswith("my-out/graph.json")


def test_evaluation(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text(json.dumps({"questions": [{"id": 1, "question": "who?", "ground_truth": "users"}, {"id": 2, "question": "fail?", "ground_truth": "x"}, {"id": 3, "question": "odd?", "ground_truth": "y"}]}))
    asked = evaluate.read_questions(spark, str(path))
    assert asked.count() == 3 and evaluate.example_questions(spark).groupBy("area").count().where("count = 5").count() == 3
    for bad in ("[]", "{}", "no json", '[{"id": 1}]'):
        path.write_text(bad)
        with pytest.raises(evaluate.EvaluationError):
            evaluate.read_questions(spark, str(path))

    def provider(prompt):
        if "fail?" in prompt:
            raise TimeoutError("too slow")
        if "odd?" in prompt:
            return "no verdict"
        return 'So: {"score_a": 0.9, "score_b": 1.4, "reasoning": "r"}' if "Answer B" in prompt else "an answer"

    each, whole = evaluate.evaluate(asked.withColumn("context", F.lit("c")).withColumn("tokens", F.lit(10)), "all of it", 100, provider)
    got = {r.id: r for r in each.collect()}
    assert (got["1"].score_with, got["1"].score_without, got["1"].error) == (0.9, 1.0, None)
    assert got["2"].error == "TimeoutError: too slow" and "no two scores" in got["3"].error
    assert tuple(whole.first())[:3] == (1, 2, 0.0)


def test_embedding_provider(spark):
    texts = spark.createDataFrame([("a", "xx"), ("b", None), ("c", "y")], "id string, text string")
    got = {r.id: r.vector for r in rank.embed(texts, lambda ts: [[len(t), 1] for t in ts], 2).collect()}
    assert got == {"a": [2.0, 1.0], "b": [0.0, 1.0], "c": [1.0, 1.0]}
    with pytest.raises(Exception, match="vectors for"):
        rank.embed(texts, lambda ts: []).collect()


def test_prices_and_tokens(spark):
    assert analytics.price_of("gpt-4o-mini") == 0.15
    with pytest.raises(ValueError):
        analytics.price_of("x")
    df = spark.createDataFrame([(2_000_000, "gpt-4.1"), (1, "default")], "t long, m string")
    assert [r.c for r in df.select(analytics.cost_usd(F.col("t"), F.col("m")).alias("c")).collect()] == [4.0, 3e-06]
    with pytest.raises(Exception, match="no price"):
        df.withColumn("m", F.lit("x")).select(analytics.cost_usd(F.col("t"), F.col("m"))).collect()
    public_tokenizers = pytest.importorskip("public_tokenizers")
    texts = spark.createDataFrame([("hello world",), (None,), ("<|endoftext|>",)], "s string")
    counts = [r.n for r in texts.select(X.bpe_tokens("s", public_tokenizers.path("byte_bpe_50k.json")).alias("n")).collect()]
    assert counts[0] == 2 and counts[1] == 0 and counts[2] > 1


def test_bare_types(spark):
    want = {"&mut Foo": "Foo", "Option<Bar>": "Bar", "Vec<Box<dyn crate::a::Baz>>": "Baz", "Map<String, X>": "Map", "java.util.List<Item>": "Item", "Item[]": "Item", "&'a str": "str", "int": "int"}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.b for r in df.select("t", X.bare_type("t").alias("b")).collect()} == want


def test_pruned_choice_is_the_same(spark):
    """Leaving out what can't be chosen changes nothing: against the plain greedy choice over all nodes."""
    import random

    rng = random.Random(71)
    ids = [f"n{k}" for k in range(300)]
    scores, costs = {i: round(rng.random(), 3) for i in ids}, {i: rng.randrange(1, 12) for i in ids}
    links = {(rng.choice(ids), rng.choice(ids)) for _ in range(500)}
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    g = PropertyGraph(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame([(a, b, "x", 1.0) for a, b in links], "src string, dst string, relation string, weight double"))
    rows = spark.createDataFrame([("q", i, s) for i, s in scores.items()], "query string, id string, score double")
    cost = spark.createDataFrame(list(costs.items()), "id string, cost long")
    budgets = spark.createDataFrame([("q", 40), ("q", 15)], "query string, budget long")
    for decay, least in ((0.7, 0.15), (0.5, 0.3), (0.9, 0.6), (0.5, 0.0), (0.0, 0.2)):
        kept = {i: s for i, s in scores.items() if s >= least}
        got = S.select(g, rows, budgets, decay, least, cost).collect()
        for b in (40, 15):
            mine = [(r.id, r.cost) for r in sorted(got, key=lambda r: r.pos) if r.budget == b]
            assert mine == [(i, c) for i, c, _ in S.greedy(kept, costs, near, b, decay)], (decay, least, b)
    plain = [r.id for r in S.select_without_boost(rows.join(cost, "id").where("score >= 0.2"), 40).orderBy("pos").collect()]
    assert plain == [i for i, _, _ in S.greedy({i: s for i, s in scores.items() if s >= 0.2}, costs, {}, 40, 0.0)]


def test_pagerank_plan_stays_small(spark, graph):
    one, many = (rank.pagerank(graph, iterations=n, tolerance=None)._jdf.queryExecution().optimizedPlan().toString() for n in (1, 12))
    assert many.count("\n") == one.count("\n")


def test_session_log_keeps_its_order(spark, tmp_path):
    folder = tmp_path / "s"
    folder.mkdir()
    (folder / "1.jsonl").write_text('{"ts": "2024-03-01", "query": "late"}\n{"query": "no time"}\n[1]\n{"ts": "20\n')
    os.utime(folder / "1.jsonl", (1, 1))
    (folder / "0.jsonl").write_text('{"ts": "2024-01-01", "query": "early, but written last"}\n')
    assert [r.query for r in logs.read_session(spark, str(folder)).collect()] == ["late", "no time", "early, but written last"]
    assert [r.query for r in logs.read_session(spark, str(folder), 2).collect()] == ["no time", "early, but written last"]
