"""Readers, writers, parsers, streams, renderers and the service."""

import json

import pytest

from weftgraph.plans import render, service
from weftgraph.plans.graph import PropertyGraph
from weftgraph.sources import code, graphs, index, logs, parsers
from weftgraph.streaming import live

NODES = [("login", "login", "function", "Checks a password", "auth/login.py"), ("user", "UserModel", "class", "Stores users", "models/user.py"), ("pool", "Pool", "class", "Connections", "db/pool.py")]
EDGES = [("login", "user", "calls", 2.0), ("user", "pool", "depends_on", 1.0)]


@pytest.fixture
def graph(spark):
    return PropertyGraph(spark.createDataFrame(NODES, "id string, label string, type string, description string, source_file string"), spark.createDataFrame(EDGES, "src string, dst string, relation string, weight double"))


def ids(g):
    return sorted(r.id for r in g.nodes.collect())


def links(g):
    return sorted((r.src, r.dst, r.relation) for r in g.edges.collect())


def test_json_graph_with_upserts_and_bare_ends(spark, tmp_path):
    p = tmp_path / "g.json"
    p.write_text(json.dumps({"nodes": [{"id": "a", "label": "A"}, {"id": "b", "label": "B", "type": "class"}, {"id": "a", "label": "A2"}], "links": [{"source": "a", "target": "b", "relation": "calls"}, {"source": "a", "target": "zz", "relation": "calls"}]}))
    g = graphs.load(spark, str(p))
    assert ids(g) == ["a", "b", "zz"] and {r.id: r.label for r in g.nodes.collect()} == {"a": "A2", "b": "B", "zz": None}
    assert links(g) == [("a", "b", "calls"), ("a", "zz", "calls")]


@pytest.mark.parametrize("text", ['{"nodes": []}', '{"nodes": [{"id": "a"}]}', "not json", "[1]", '{"nodes": [{"label": "a"}]}'])
def test_bad_json_graphs(spark, tmp_path, text):
    p = tmp_path / "g.json"
    p.write_text(text)
    with pytest.raises(graphs.GraphError):
        graphs.load(spark, str(p))


def test_missing_graph(spark, tmp_path):
    with pytest.raises(graphs.GraphError):
        graphs.load(spark, str(tmp_path / "none.json"))


def test_format_detection():
    assert graphs.detect_format(["nodes", "links"], ["id"]) == "links"
    assert graphs.detect_format(["nodes", "edges"], ["id", "label"]) == "generic"
    assert graphs.detect_format(["nodes", "edges"], ["id", "label", "type"]) == "links"


def test_graphml_file(spark, tmp_path):
    p = tmp_path / "g.graphml"
    p.write_text('<?xml version="1.0"?><graphml><key id="d0" for="node" attr.name="name" attr.type="string"/><key id="d1" for="node" attr.name="kind" attr.type="string"/><key id="d2" for="edge" attr.name="label" attr.type="string"/><graph edgedefault="directed"><node id="n1"><data key="d0">One</data><data key="d1">class</data></node><node id="n2"/><edge source="n1" target="n2"><data key="d2">calls</data></edge></graph></graphml>')
    g = graphs.load(spark, str(p))
    assert {r.id: (r.label, r.type) for r in g.nodes.collect()} == {"n1": ("One", "class"), "n2": ("n2", None)}
    assert links(g) == [("n1", "n2", "calls")]


def test_round_trips(spark, tmp_path, graph):
    graphs.write_graphml(graph, str(tmp_path / "x"))
    back = graphs.read_graphml(spark, str(tmp_path / "x"))
    assert ids(back) == ids(graph) and links(back) == links(graph)
    graphs.write_csv(graph, str(tmp_path / "c"))
    back = graphs.read_csv(spark, str(tmp_path / "c/nodes"), str(tmp_path / "c/relationships"))
    assert ids(back) == ids(graph) and links(back) == links(graph)
    assert {r.id: r.label for r in back.nodes.collect()}["user"] == "UserModel"


def test_csv_aliases_and_dangling(spark, tmp_path):
    (tmp_path / "nodes.csv").write_text(":ID,:LABEL,name,extra\na,Class,Alpha,1\nb,Func,,\n")
    (tmp_path / "rels.csv").write_text(":START_ID,:END_ID,:TYPE\na,b,CALLS\na,nope,CALLS\n,b,CALLS\n")
    g = graphs.read_csv(spark, str(tmp_path / "nodes.csv"), str(tmp_path / "rels.csv"))
    assert {r.id: (r.label, r.type, r.extra) for r in g.nodes.collect()} == {"a": ("Alpha", "Class", "1"), "b": ("b", "Func", None)}
    assert links(g) == [("a", "b", "CALLS")]


def test_logs(spark, tmp_path):
    entry = spark.createDataFrame([("2024-01-01T00:00:00", "q", 10, 5, 1, 7, "g", ["a"])], logs.AUDIT)
    logs.append(entry, str(tmp_path / "audit"))
    logs.append(entry, str(tmp_path / "audit"))
    assert logs.read_audit(spark, str(tmp_path / "audit")).count() == 2
    (tmp_path / "s.jsonl").write_text('{"ts": "1", "query": "a"}\nbroken\n[1]\n{"ts": "2", "query": "b"}\n')
    assert [r.query for r in logs.read_session(spark, str(tmp_path / "s.jsonl")).collect()] == ["a", "b"]
    assert [r.query for r in logs.read_session(spark, str(tmp_path / "s.jsonl"), 1).collect()] == ["b"]


def test_blocks_of_code():
    text = "x = 1\ndef f():\n    a\n\n    b\n\ny = 2\n"
    assert code.block(text, 2, False) == "def f():\n    a\n\n    b"
    assert code.block("function f() {\n  if (x) {\n  }\n}\nrest", 1, True) == "function f() {\n  if (x) {\n  }\n}"
    assert code.block(text, 99, False) is None and code.block(text, None, False) is None and code.block(None, 1, False) is None


PY = '''import os
from app.helpers import run as go

class Base:
    def close(self): pass

class Pay(Base):
    def charge(self, n=go()):
        self.close()
        go(n)
        def inner(): return Pay()
        return inner()

def main():
    p = Pay()
    p.charge(1)
    p = None
    p.charge(2)
    os.getcwd()
'''


def parsed(path, text):
    module = path.rpartition(".")[0].replace("/", ".")
    nodes, edges = parsers.parse(path, text, module)
    return {n[0]: n[2] for n in nodes}, {(s, d, r) for s, d, r, _ in edges}, {(s, x) for s, d, r, x in edges if x}


def test_python():
    nodes, edges, pending = parsed("app/pay.py", PY)
    assert nodes["app.pay"] == "module" and nodes["app.pay.Pay.charge.inner"] == "function" and nodes["app.pay.import_app_helpers_go"] == "import"
    calls = {(s, d) for s, d, r in edges if r == "calls"}
    assert {("app.pay.Pay.charge", "app.pay.Base.close"), ("app.pay.Pay.charge.inner", "app.pay.Pay"), ("app.pay.main", "app.pay.Pay"), ("app.pay.main", "app.pay.Pay.charge"), ("app.pay.Pay.charge", "app.pay.Pay.charge.inner")} <= calls
    assert ("app.pay.Pay", "app.helpers.run") in pending and ("app.pay.Pay.charge", "app.helpers.run") in pending and ("app.pay.main", "os.getcwd") in pending
    assert parsers.parse("x.py", "def (", "x") == ([], [])


SNIPPETS = {
    "a/s.ts": ("import { check, hash as h } from './lib/util';\nexport class Svc extends Base {\n  run(x: string): void {\n    this.stop(); h(x); // check()\n  }\n  stop() { }\n}\nexport const go = async (a) => { new Svc(); start(); };\nfunction start() { }\n", {"a.s.Svc": "class", "a.s.Svc.run": "function", "a.s.go": "function", "a.s.start": "function"}, {("a.s.Svc.run", "a.s.Svc.stop", "calls"), ("a.s.go", "a.s.start", "calls"), ("a.s.Svc", "Base", "extends")}),
    "a/m.go": ('package auth\n\nimport (\n\t"fmt"\n\th "example.com/x/hash/v2"\n)\n\ntype Store struct { n int }\n\nfunc (s *Store) Get(k string) int {\n\treturn s.find(k)\n}\nfunc (s *Store) find(k string) int { return 1 }\nfunc Login() { h.Sum(1); helper() }\nfunc helper() {}\n', {"a.m.Store": "class", "a.m.Store.Get": "function", "a.m.Login": "function"}, {("a.m.Store.Get", "a.m.Store.find", "calls"), ("a.m.Login", "a.m.helper", "calls")}),
    "a/P.java": ("package com.acme;\nimport com.acme.util.Text;\npublic class P extends Q implements R {\n  public P(int a) { }\n  public int add(int b) { return this.twice(b) + twice(b); }\n  private int twice(int c) { return c; }\n}\n", {"a.P.P": "class", "a.P.P.add": "method", "a.P.P.P": "constructor"}, {("a.P.P.add", "a.P.P.twice", "calls"), ("a.P.P", "Q", "extends"), ("a.P.P", "R", "implements")}),
    "a/l.rs": ("use crate::util::{hash, text::{trim as t}};\npub struct Point { x: i32 }\nimpl Shape for Point {\n    pub fn area(&self) -> i32 { self.side() }\n    fn side(&self) -> i32 { hash(1); 2 }\n}\nfn main() { run(); }\nfn run() {}\n", {"a.l.Point": "struct", "a.l.Point.area": "function", "a.l.main": "function"}, {("a.l.Point.area", "a.l.Point.side", "calls"), ("a.l.main", "a.l.run", "calls"), ("a.l.Point", "Shape", "implements")}),
    "a/c.cs": ("using System.Text;\nnamespace App {\n  public class Car : Base, IDrive {\n    public Car() { }\n    public int Speed { get; set; }\n    public void Go(int n) { }\n  }\n}\n", {"a.c.App": "namespace", "a.c.App.Car": "class", "a.c.App.Car.Go": "method", "a.c.App.Car.Speed": "property"}, {("a.c.App.Car", "Base", "extends"), ("a.c.App.Car", "IDrive", "implements")}),
    "a/r.rb": ("require 'json'\nmodule Auth\n  class User < Base\n    attr_reader :name\n    def login\n      1\n    end\n    def out?\n    end\n  end\nend\n", {"a.r.Auth": "module", "a.r.Auth.User": "class", "a.r.Auth.User.login": "method", "a.r.Auth.User.out?": "method"}, {("a.r.Auth.User", "Base", "extends")}),
    "a/p.php": ("<?php\nnamespace App;\nuse Lib\\Tool;\nclass A extends B {\n  public $x;\n  public function go() { }\n}\nfunction f() { }\n", {"a.p.A": "class", "a.p.A.go": "method", "a.p.f": "function", "a.p.A.x": "property"}, {("a.p.A", "B", "extends")}),
    "a/k.kt": ("package x\nimport y.Z\nclass K(val a: Int) : Base() {\n  fun go() { }\n}\nobject O { fun at() = 1 }\n", {"a.k.K": "class", "a.k.K.go": "function", "a.k.O": "object"}, {("a.k.K", "Base", "extends")}),
    "a/s.scala": ("import a.b.C\nclass S extends T with U {\n  def go(): Int = { 1 }\n  val x = 1\n}\n", {"a.s.S": "class", "a.s.S.go": "def", "a.s.S.x": "val"}, {("a.s.S", "T", "extends"), ("a.s.S", "U", "with")}),
    "a/w.swift": ("import UIKit\nstruct W: Shape {\n  var x: Int\n  func go() { }\n}\n", {"a.w.W": "struct", "a.w.W.go": "function", "a.w.W.x": "property"}, {("a.w.W", "Shape", "conforms_to")}),
    "a/c.c": ("#include <stdio.h>\n#define MAX 3\nstruct node { int a; };\nstatic int add(int a, int b) {\n  return a;\n}\n", {"a.c.MAX": "macro", "a.c.node": "struct", "a.c.add": "function"}, set()),
    "a/d.cpp": ("#include \"x.h\"\nnamespace n {\nclass D {\npublic:\n  int go() { return 1; }\n};\n}\n", {"a.d.n": "namespace", "a.d.n.D": "class", "a.d.n.D.go": "method"}, set()),
    "a/l.lua": ("local M = {}\nlocal j = require('json')\nfunction M.go() end\nfunction M:at() end\nlocal function f() end\n", {"a.l.M": "module", "a.l.M.go": "function", "a.l.M.at": "method", "a.l.f": "function"}, set()),
    "a/e.ex": ("defmodule App.User do\n  use Base\n  defstruct [:a]\n  def go(x) do\n    x\n  end\n  defp at, do: 1\nend\n", {"a.e.App_User": "module", "a.e.App_User.go": "function", "a.e.App_User.__struct__": "struct"}, set()),
    "a/p.ps1": ("Import-Module Az\nfunction Get-It {\n  1\n}\nclass C {\n  [int] Go() { return 1 }\n}\n", {"a.p.Get-It": "function", "a.p.C": "class", "a.p.C.Go": "method"}, set()),
}


@pytest.mark.parametrize("path", SNIPPETS)
def test_languages(path):
    text, want, want_edges = SNIPPETS[path]
    nodes, edges, _ = parsed(path, text)
    assert {k: nodes.get(k) for k in want} == want
    assert want_edges <= edges
    assert [k for k, v in nodes.items() if v == "import"] and all(("a", 1) for _ in nodes)


def test_calls_across_files(spark):
    files = spark.createDataFrame([("app/helpers.py", "def run(x): pass\n"), ("app/pay.py", PY), ("go/auth/a.go", "package auth\nfunc Login() {}\n"), ("go/main.go", 'package main\nimport "example.com/go/auth"\nfunc main() { auth.Login() }\n'), ("web/lib/util.ts", "export function check() { }\n"), ("web/s.ts", "import { check } from './lib/util';\nfunction go() { check(); }\n"), ("node_modules/x.py", "def y(): pass\n"), ("amb/one/m.py", "def f(): pass\n"), ("amb/two/m.py", "def f(): pass\n"), ("amb/use.py", "from m import f\ndef g(): f()\n")], "path string, content string")
    g = index.index_files(files.where(code.wanted(files.path)))
    found = links(g)
    assert ("app.pay.Pay.charge", "app.helpers.run", "calls") in found
    assert ("go.main.main", "go.auth.a.Login", "calls") in found
    assert ("web.s.go", "web.lib.util.check", "calls") in found
    assert not [x for x in found if x[0] == "amb.use.g" and x[2] == "calls"] and not [i for i in ids(g) if i.startswith("node_modules")]
    assert ids(index.index_files(files, ["type:import", "file:amb/*"])) == [i for i in ids(index.index_files(files)) if "import_" not in i and not i.startswith("amb")]
    again = index.reindex(g, files.where("path <> 'app/pay.py'").unionByName(spark.createDataFrame([("app/pay.py", "def only(): pass\n")], "path string, content string")), spark.createDataFrame([("app/pay.py",)], "source_file string"))
    assert [i for i in ids(again) if i.startswith("app.pay")] == ["app.pay", "app.pay.only"]


def test_scan_and_watch(spark, tmp_path):
    (tmp_path / "src/pkg").mkdir(parents=True)
    (tmp_path / "src/build").mkdir()
    (tmp_path / "src/pkg/a.py").write_text("def f(): pass\n")
    (tmp_path / "src/build/b.py").write_text("def g(): pass\n")
    (tmp_path / "src/notes.txt").write_text("no")
    assert [r.path for r in code.scan(spark, str(tmp_path / "src")).collect()] == ["pkg/a.py"]
    got = []
    live.watch(spark, str(tmp_path / "src"), lambda g, n: got.append(ids(g)), str(tmp_path / "ck"), once=True).awaitTermination()
    assert got == [["pkg.a", "pkg.a.f"]]


def test_tail_and_usage(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/1.jsonl").write_text('{"ts": "2024-01-01T00:10:00", "query": "a", "tokens": 5}\nbad\n')
    got = []
    tail = lambda: live.tail_sessions(spark, str(tmp_path / "log"), lambda b, n: got.extend(r.query for r in b.collect()), str(tmp_path / "ck"), once=True).awaitTermination()
    tail()
    (tmp_path / "log/2.jsonl").write_text('{"ts": "2024-01-01T00:20:00", "query": "b", "tokens": 6}\n')
    tail()
    assert got == ["a", "b"]
    q = live.usage(spark, str(tmp_path / "log")).writeStream.format("memory").queryName("usage").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.queries, r.tokens) for r in spark.table("usage").collect()] == [(2, 11)]


STATS = {"nodes_selected": 3, "nodes_total": 7, "tokens_used": 58, "tokens_budget": 100, "coverage_pct": 42.9}


def test_renderers(spark, graph):
    scores = spark.createDataFrame([("user", 0.5), ("login", 0.9), ("pool", 0.5)], "id string, score double")
    text = render.subgraph(graph, STATS, "markdown", scores, "auth")
    assert text.index("### login (function), score 0.90") < text.index("### Pool") < text.index("### UserModel") and "- login calls user" in text and "4 nodes are not shown" in text
    data = json.loads(render.subgraph(graph, STATS, "json", scores))
    assert [n["id"] for n in data["nodes"]] == ["login", "pool", "user"] and data["nodes"][0]["file_path"] == "auth/login.py" and data["stats"] == STATS
    assert "  - id: login\n    label: login\n" in render.subgraph(graph, STATS, "yaml", scores)
    assert [render.yaml_scalar(x) for x in (None, True, 3, "a: b", "true", "plain", "1.5", "")] == ["null", "true", "3", '"a: b"', '"true"', "plain", '"1.5"', '""']
    for target in render.TARGETS:
        assert render.NODES_HEAD in render.context(graph, STATS, "auth", target)
    with pytest.raises(ValueError):
        render.subgraph(graph, STATS, "xml")
    with pytest.raises(ValueError):
        render.context(graph, STATS, "q", "other")


def call(s, name, **args):
    return s.answer(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": args}}))


def test_service(graph):
    state = {"v": 1, "ok": True}

    def load():
        if not state["ok"]:
            raise OSError("gone")
        return graph

    s = service.Service(load, lambda: state["v"])
    assert s.answer("{")["error"]["code"] == -32700 and s.answer("[]")["error"]["code"] == -32600
    assert s.answer('{"jsonrpc": "2.0", "id": 1, "method": "nope"}')["error"]["code"] == -32601
    assert s.answer('{"jsonrpc": "2.0", "method": "ping"}') is None and s.answer('{"jsonrpc": "2.0", "id": 1, "method": "ping"}')["result"] == {}
    assert call(s, "other")["error"]["code"] == -32602 and call(s, "query", query=" ")["error"]["code"] == -32602 and call(s, "query", query="a", budget=1.5)["error"]["code"] == -32602
    assert "login" in call(s, "query", query="login password", budget=200.0)["result"]["content"][0]["text"]
    assert call(s, "explain", node="zzzzqqq")["result"]["isError"] and not call(s, "explain", node="login")["result"]["isError"]
    assert not call(s, "impact", file="models/user.py")["result"]["isError"]
    state.update(v=2, ok=False)
    assert not call(s, "impact", file="models/user.py")["result"]["isError"]
    out = []
    s.serve(["\n", '{"jsonrpc": "2.0", "id": 7, "method": "ping"}'], out.append)
    assert json.loads(out[0])["id"] == 7 and len(out) == 1
