"""Calls across files by the rules of Java, Rust and TypeScript."""

import pytest

from weftgraph.sources import index

FILES = {
    "j/text/Joiner.java": "package shop.text;\npublic class Joiner {\n  public Joiner(int n) { }\n  public static String glue(String a) { return a; }\n  public String tie(String a) { return a; }\n}\n",
    "j/text/Other.java": "package shop.text;\npublic class Other {\n  public static int near() { return Joiner.glue(null).length(); }\n}\n",
    "j/more/Joiner.java": "package shop.more;\npublic class Joiner {\n  public static String glue(String a) { return a; }\n}\n",
    "j/app/Main.java": (
        "package shop.app;\nimport shop.text.Joiner;\nimport static shop.text.Other.near;\n"
        "public class Main {\n  private Joiner field;\n"
        "  int a() { return Joiner.glue(null).length(); }\n  Object b() { return new Joiner(1); }\n  int c() { return near(); }\n"
        "  String d(Joiner given) { return given.tie(null); }\n  String e() { return field.tie(null); }\n}\n"
    ),
    "j/app/Wild.java": "package shop.app;\nimport shop.text.*;\nimport shop.more.*;\npublic class Wild {\n  int a() { return Other.near(); }\n  String b() { return Joiner.glue(null); }\n}\n",
    "r/core/src/lib.rs": "pub mod util;\npub mod shape;\nuse crate::util::run;\npub fn start() { run(); util::deep::dig(); crate::util::stop(); }\n",
    "r/core/src/util/mod.rs": "pub mod deep;\npub fn run() {}\npub fn stop() { self::deep::dig(); }\n",
    "r/core/src/util/deep.rs": "use super::*;\npub fn dig() { run(); super::stop(); super::super::start(); }\npub mod tests {\n    pub fn check() { super::dig(); }\n}\n",
    "r/core/src/shape.rs": "pub struct Box2 { n: i32 }\nimpl Box2 {\n    pub fn new() -> Box2 { Box2 { n: 1 } }\n    pub fn area(&self) -> i32 { 1 }\n}\n",
    "r/tool/src/main.rs": "use core::shape::{self, Box2};\nfn main() { let b = Box2::new(); b.area(); }\nfn other(x: &Box2) { x.area(); shape::missing(); }\n",
    "t/lib/math.ts": "export function add() { }\nexport class Sum {\n  total(): number { return 1; }\n}\n",
    "t/lib/index.ts": "export function all() { }\n",
    "t/one.ts": "export default function only() { }\n",
    "t/app/page.ts": (
        "import { add as plus, Sum } from '../lib/math';\nimport { all } from '../lib';\nimport one from '../one.js';\nimport two from '../lib/math';\n"
        "import * as m from '../lib/math';\nimport { add } from 'elsewhere/math';\n"
        "export function a() { plus(); }\nexport function b() { all(); }\nexport function c() { one(); two(); }\nexport function d() { m.add(); }\n"
        "export function e() { const s = new Sum(); s.total(); }\nexport function f() { add(); }\n"
    ),
}


@pytest.fixture(scope="module")
def calls(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string").repartition(3)
    return {(r.src, r.dst) for r in index.index_files(files).edges.where("relation = 'calls'").collect()}


def of(calls, start):
    return {(s, d) for s, d in calls if s.startswith(start)}


def test_java(calls):
    assert of(calls, "j.") == {
        ("j.text.Other.Other.near", "j.text.Joiner.Joiner.glue"),
        ("j.app.Main.Main.a", "j.text.Joiner.Joiner.glue"),
        ("j.app.Main.Main.b", "j.text.Joiner.Joiner"),
        ("j.app.Main.Main.c", "j.text.Other.Other.near"),
        ("j.app.Main.Main.d", "j.text.Joiner.Joiner.tie"),
        ("j.app.Main.Main.e", "j.text.Joiner.Joiner.tie"),
        ("j.app.Wild.Wild.a", "j.text.Other.Other.near"),
        # Wild.b: two packages have a Joiner.
    }


def test_rust(calls):
    lib, util, deep = "r.core.src.lib", "r.core.src.util.mod", "r.core.src.util.deep"
    shape, tool = "r.core.src.shape.Box2", "r.tool.src.main"
    assert of(calls, "r.") == {
        (f"{lib}.start", f"{util}.run"), (f"{lib}.start", f"{deep}.dig"), (f"{lib}.start", f"{util}.stop"),
        (f"{util}.stop", f"{deep}.dig"),
        (f"{deep}.dig", f"{util}.run"), (f"{deep}.dig", f"{util}.stop"), (f"{deep}.dig", f"{lib}.start"),
        (f"{deep}.tests.check", f"{deep}.dig"),
        (f"{tool}.main", f"{shape}.new"), (f"{tool}.main", f"{shape}.area"), (f"{tool}.other", f"{shape}.area"),
    }


def test_typescript(calls):
    assert of(calls, "t.app") == {
        ("t.app.page.a", "t.lib.math.add"),
        ("t.app.page.b", "t.lib.index.all"),
        ("t.app.page.c", "t.one.only"),
        ("t.app.page.d", "t.lib.math.add"),
        ("t.app.page.e", "t.lib.math.Sum"),
        ("t.app.page.e", "t.lib.math.Sum.total"),
        # c: the default of a module with two symbols is not known; f: a package is no file here.
    }
