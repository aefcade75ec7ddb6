"""Registered queries over the driver's tables, each with the SQL that another engine runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.operators import analytics, rank, relational, resolve, traverse
from weftgraph.operators import select as S
from weftgraph.plans import view
from weftgraph.plans.graph import DOCUMENT_SQL, ENTITY_SQL, PropertyGraph, build, document_graph, entity_graph, first_wins
from weftgraph.sources import graphs, index, logs
from weftgraph.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Tokens of a text in DuckDB, as functions.text.tokenize makes them.
def _tok(x: str) -> str:
    split = f"regexp_replace(regexp_replace({x}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    p, o = f"regexp_extract_all(lower({split}), '[a-z0-9]+')", f"regexp_extract_all(lower({x}), '[a-z0-9]+')"
    # A struct, so that both lists are made once and not for every token.
    return f"list_transform([{{'p': {p}, 'o': {o}}}], lambda s: CASE WHEN s.p = s.o THEN s.p ELSE list_concat(s.p, list_filter(s.o, lambda t: NOT list_contains(s.p, t))) END)[1]"


_E, _D = f"WITH {ENTITY_SQL}", f"WITH {DOCUMENT_SQL}"
_NOISE = ", ".join(f"'{w}'" for w in X.NOISE_WORDS)
_TEST = X.TEST_PATHS


# ---- projections and scalar functions

@query("P1_tokenize", f"{_D} SELECT id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT id, {_tok('description')} AS t FROM d)")
def p1(spark, d):
    g = document_graph(spark, d)
    return g.nodes.select("id", X.tokenize("description").alias("t")).select("id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query("P2_subject_tokens", f"{_E} SELECT id, array_to_string(list_filter({_tok('label')}, lambda t: length(t) >= 3 AND NOT list_contains([{_NOISE}], t) AND NOT regexp_matches(t, '^[0-9]+$')), ' ') AS tokens FROM n")
def p2(spark, d):
    return entity_graph(spark, d).nodes.select("id", F.array_join(X.subject_tokens("label"), " ").alias("tokens"))


_LINE = "concat_ws(' ', id, nullif(label, ''), CASE WHEN type <> '' THEN '(' || type || ')' END, nullif(description, ''), CASE WHEN source_file <> '' THEN '-> ' || source_file END)"


@query("P3_P4_node_cost", f"{_E} SELECT id, {_LINE} AS line, ceil(length({_LINE}) / 4.0)::BIGINT AS cost FROM n")
def p3(spark, d):
    line = X.serialised(*map(F.col, ("id", "label", "type", "description", "source_file")))
    return entity_graph(spark, d).nodes.select("id", line.alias("line"), X.estimated_tokens(line).alias("cost"))


@query("P5_P6_names", f"{_D} SELECT id, concat_ws(' ', nullif(label, ''), coalesce(nullif(type, ''), nullif(file_type, '')), nullif(description, '')) AS text, CASE WHEN type IN ('function', 'method') THEN label || '()' ELSE label END AS name FROM d")
def p5(spark, d):
    n = document_graph(spark, d).nodes
    return n.select("id", X.embedding_text(F.col("label"), F.col("type"), F.col("file_type"), F.col("description")).alias("text"), X.display_name(F.col("label"), F.col("type")).alias("name"))


@query("P7_P8_P9_P11_P23_paths", f"""{_D} SELECT id, source_file AS path, regexp_matches(source_file, '{_TEST}') OR starts_with(list_last(string_split(id, '.')), 'test_') AS is_test,
 (label = list_last(string_split(source_file, '/'))) AS is_file, replace(translate(regexp_replace(source_file, '\\.[^./]*$', ''), '- ', '__'), '/', '.') AS file_id,
 CASE length(id) % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE '' END AS tag FROM d""")
def p7(spark, d):
    n = document_graph(spark, d).nodes
    path = X.normal_path(F.concat(F.lit("./"), F.col("source_file")))
    return n.select("id", path.alias("path"), X.is_test(F.col("id"), F.col("source_file")).alias("is_test"), X.is_file_node(F.lit("document"), F.col("label"), F.col("source_file")).alias("is_file"), X.file_id(F.col("source_file")).alias("file_id"), X.language_tag(F.concat("source_file", F.when(F.length("id") % 3 == 0, ".PY").when(F.length("id") % 3 == 1, ".ts").otherwise(""))).alias("tag"))


@query("P10_P12_locations", """SELECT doc_id, (doc_id + 1)::INT AS line, (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS last_line FROM documents""")
def p10(spark, d):
    t = _t(spark, d, "documents")
    return t.select("doc_id", X.line_of(F.concat(F.lit("L"), (F.col("doc_id") + 1).cast("string"))).alias("line"), X.line_at(F.col("text"), F.length("text")).alias("last_line"))


@query("P13_to_P19_buckets", """SELECT o_orderkey, CASE WHEN k >= 6 THEN 'HIGH' WHEN k >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
 CASE WHEN x >= 0.5 THEN 'high' WHEN x >= 0.2 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN x > 0.7 THEN 'red' WHEN x > 0.3 THEN 'yellow' ELSE 'green' END AS colour,
 CASE WHEN k = 0 THEN 'NONE' WHEN k >= 10 THEN 'HIGH' WHEN k >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
 CASE WHEN k > 0 THEN round(greatest(0, k * 50 - o_custkey % 300) / (k * 50)::DOUBLE * 100, 1) ELSE 0.0 END AS savings
 FROM (SELECT *, (o_orderkey % 14)::BIGINT AS k, (o_orderkey % 100) / 100.0::DOUBLE AS x FROM orders)""")
def p13(spark, d):
    o = _t(spark, d, "orders").withColumn("k", F.col("o_orderkey") % 14).withColumn("x", F.col("o_orderkey") % 100 / 100.0)
    return o.select("o_orderkey", X.risk(F.col("k")).alias("risk"), X.severity(F.col("x")).alias("severity"), X.severity_colour(F.col("x")).alias("colour"), X.confidence(F.col("k")).alias("confidence"), X.savings_percent(F.col("o_custkey") % 300, F.col("k")).alias("savings"))


@query("P20_P21_viz", f"""{_E}, s AS (SELECT id, label, type, (length(id) * 7 % 50)::DOUBLE AS score FROM n), m AS (SELECT min(score) AS lo, max(score) AS hi FROM s)
 SELECT id, CASE WHEN regexp_matches(list_last(string_split(list_last(string_split(trim(label), '.')), '/')), '^[A-Z]') THEN 'class' ELSE 'default' END AS kind,
 round(14 + 18 * (score - lo) / (hi - lo), 2) AS size, '#1f2a36' AS dark, replace(replace(label, '&', '&amp;'), '<', '&lt;') AS html FROM s, m""")
def p20(spark, d):
    n = entity_graph(spark, d).nodes.select("id", "label", "type", (F.length("id") * 7 % 50).cast("double").alias("score"))
    m = n.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return n.join(F.broadcast(m)).select("id", X.viz_type(F.col("type"), F.lit("code"), F.col("label"), ("function", "class", "module")).alias("kind"), X.viz_size(F.col("score"), F.col("lo"), F.col("hi")).alias("size"), X.darken(F.lit("#253240")).alias("dark"), X.escape_html(F.col("label")).alias("html"))


@query("P27_P28_imports", """SELECT page_id, CASE WHEN s AND w THEN 'static_wildcard' WHEN s THEN 'static' WHEN w THEN 'wildcard' ELSE 'class' END AS kind, list_last(string_split(regexp_replace(p, '/v[0-9]+$', ''), '/')) AS package, NOT contains(string_split(p, '/')[1], '.') AS stdlib
 FROM (SELECT page_id, page_id % 2 = 0 AS s, page_id % 3 = 0 AS w, regexp_extract(url, '//(.*)$', 1) || '/v2' AS p FROM pages)""")
def p27(spark, d):
    p = _t(spark, d, "pages")
    target = F.concat(F.when(F.col("page_id") % 2 == 0, F.lit("static ")).otherwise(""), F.lit("a.b"), F.when(F.col("page_id") % 3 == 0, F.lit(".*")).otherwise(""))
    path = F.concat(F.regexp_extract("url", "//(.*)$", 1), F.lit("/v2"))
    return p.select("page_id", X.import_kind(target).alias("kind"), X.go_package(path).alias("package"), X.is_go_stdlib(path).alias("stdlib"))


@query("P25_resolve_module", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'lib/' || source WHEN 1 THEN 'src/app/' || source WHEN 2 THEN 'src/' || source END AS path FROM documents""")
def p25(spark, d):
    spec = F.when(F.col("doc_id") % 4 == 0, "@/lib/").when(F.col("doc_id") % 4 == 1, "./").when(F.col("doc_id") % 4 == 2, "../").otherwise("")
    return _t(spark, d, "documents").select("doc_id", X.resolve_module(F.lit("src/app"), F.concat(spec, F.col("source"))).alias("path"))


# ---- graph building, filters, joins

@query("S3_upsert", """WITH r AS (SELECT user_id AS id, event_id AS ord, CASE WHEN event_id % 3 <> 0 THEN event_type END AS kind, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events),
 m AS (SELECT id, arg_max(kind, ord) FILTER (kind IS NOT NULL) AS kind, arg_max(value, ord) FILTER (value IS NOT NULL) AS value FROM r GROUP BY id),
 x AS (SELECT DISTINCT dst FROM (SELECT user_id * 2 AS dst FROM events) WHERE dst NOT IN (SELECT id FROM m))
 SELECT id, kind, value FROM m UNION ALL SELECT dst, NULL, NULL FROM x""")
def s3(spark, d):
    e = _t(spark, d, "events")
    nodes = e.select(F.col("user_id").alias("id"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"), F.col("event_id").alias("ord"))
    edges = e.select(F.col("user_id").alias("src"), (F.col("user_id") * 2).alias("dst"), F.lit("next").alias("relation"), F.col("event_id").alias("ord"))
    return build(nodes, edges).nodes.select("id", "kind", "value")


@query("F2_F3_ignore", f"""{_D}, k AS (SELECT * FROM d WHERE NOT (type = 'de' OR regexp_matches(source_file, '^corpus/src1[^/]*/.*$') OR regexp_matches(id, '^doc:.*7$')))
 SELECT 'node' AS what, id AS a, '' AS b FROM k UNION ALL SELECT 'edge', src, dst FROM l WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""")
def f2(spark, d):
    rules = relational.parse_ignore(["# noise", "", "type:de", "file:corpus/src1*/*", "id:doc:*7", "other:x"])
    g = relational.apply_ignore(document_graph(spark, d), rules)
    return g.nodes.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.lit("").alias("b")).unionByName(g.edges.select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b")))


@query("F7_nodes_in_file", f"{_D} SELECT id FROM d WHERE ends_with(source_file, '/' || (SELECT 'en_' || min(doc_id) || '.txt' FROM documents WHERE lang = 'en'))")
def f7(spark, d):
    name = _t(spark, d, "documents").where("lang = 'en'").agg(F.min("doc_id")).first()[0]
    return traverse.nodes_in_file(document_graph(spark, d), f"./en_{name}.txt").select("id")


@query("F10_J2_known_endpoints", f"{_E}, k AS (SELECT id FROM n WHERE type NOT IN ('order', 'region')) SELECT src, dst, relation FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def f10(spark, d):
    return entity_graph(spark, d).where(~F.col("type").isin("order", "region")).edges.select("src", "dst", "relation")


@query("A2_A3_degrees", f"""{_E}, i AS (SELECT dst AS id, count(*) AS k FROM e GROUP BY 1), o AS (SELECT src AS id, count(*) AS k, sum(weight) AS w FROM e GROUP BY 1)
 SELECT n.id, coalesce(i.k, 0)::BIGINT AS in_degree, coalesce(o.k, 0)::BIGINT AS out_degree, coalesce(o.w, 0.0) AS out_weight, round((coalesce(i.k, 0) + coalesce(o.k, 0)) / (2.0::DOUBLE * ((SELECT count(*) FROM n) - 1)), 9) AS centrality
 FROM n LEFT JOIN i USING (id) LEFT JOIN o USING (id)""")
def a2(spark, d):
    g = entity_graph(spark, d)
    rows = relational.with_degrees(g)
    total = g.nodes.agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(total)).select("id", "in_degree", "out_degree", "out_weight", F.round((F.col("in_degree") + F.col("out_degree")) / (2 * (F.col("n") - 1)), 9).alias("centrality"))


@query("A12_dependents", f"""{_E}, c AS (SELECT DISTINCT src, dst FROM e WHERE relation <> 'contains')
 SELECT dst AS id, count(*) FILTER (NOT starts_with(src, 'customer:1')) AS production, count(*) FILTER (starts_with(src, 'customer:1')) AS tests FROM c JOIN n ON n.id = c.src GROUP BY 1""")
def a12(spark, d):
    g = entity_graph(spark, d)
    file = F.when(F.col("id").startswith("customer:1"), "tests/test_customer.sql").otherwise(F.col("source_file"))
    return relational.dependents(PropertyGraph(g.nodes.withColumn("source_file", file), g.edges))


@query("A1_A7_counts", f"{_E} SELECT type, count(*) AS nodes FROM n GROUP BY type")
def a1(spark, d):
    return relational.type_counts(entity_graph(spark, d))


@query("K3_most_depended_on", f"{_E} SELECT dst AS id, count(*) AS in_degree FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def k3(spark, d):
    return relational.most_depended_on(entity_graph(spark, d))


@query("U1_first_wins", "SELECT user_id AS id, arg_min(event_type, event_id) AS event_type, arg_min(value, event_id) AS value FROM events GROUP BY user_id")
def u1(spark, d):
    rows = _t(spark, d, "events").select(F.col("user_id").alias("id"), "event_type", "value", F.col("event_id").alias("ord"))
    return first_wins(rows, ["id"]).select("id", "event_type", "value")


@query("U2_edge_dedup", """WITH x AS (SELECT l_partkey AS src, l_suppkey AS dst, CASE WHEN l_quantity > 40 THEN 'bulk' END AS pending, l_shipmode AS relation, l_orderkey * 10 + l_linenumber AS ord FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem))
 SELECT src, dst, pending, arg_min(relation, ord) AS relation FROM x GROUP BY ALL""")
def u2(spark, d):
    x = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.when(F.col("l_quantity") > 40, "bulk").alias("pending"), F.col("l_returnflag").alias("relation"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return relational.dedup_edges(x).select("src", "dst", "pending", "relation")


def _two(spark, d) -> dict[str, PropertyGraph]:
    c = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("label"))
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("label"))
    link = lambda n: n.select(F.col("id").alias("src"), (F.col("id").cast("long") + 1).cast("string").alias("dst"), F.lit("next").alias("relation"))
    return {"sales": PropertyGraph(c, link(c)), "supply": PropertyGraph(s, link(s))}


@query("U3_F10_federate", """WITH c AS (SELECT c_custkey AS k FROM customer), s AS (SELECT s_suppkey AS k FROM supplier)
 SELECT 'sales::' || k AS a, '' AS b, 'sales' AS project FROM c UNION ALL SELECT 'supply::' || k, '', 'supply' FROM s
 UNION ALL SELECT 'sales::' || k, 'sales::' || (k + 1), 'edge' FROM c WHERE k + 1 IN (SELECT k FROM c) UNION ALL SELECT 'supply::' || k, 'supply::' || (k + 1), 'edge' FROM s WHERE k + 1 IN (SELECT k FROM s)""")
def u3(spark, d):
    g = relational.federate(_two(spark, d))
    return g.nodes.select(F.col("id").alias("a"), F.lit("").alias("b"), F.col("_project").alias("project")).unionByName(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit("edge").alias("project")))


@query("A6_A7_federation_stats", """WITH i AS (SELECT c_custkey AS k, 'sales' AS project FROM customer UNION ALL SELECT s_suppkey, 'supply' FROM supplier), m AS (SELECT k, count(*) AS c FROM i GROUP BY k)
 SELECT project, count(*) AS nodes, count(*) FILTER (c > 1) AS collisions FROM i JOIN m USING (k) GROUP BY project""")
def a6(spark, d):
    return relational.federation_stats(_two(spark, d))


def _snapshots(spark, d) -> tuple[PropertyGraph, PropertyGraph]:
    g = document_graph(spark, d)
    k = F.substring("id", 5, 20).cast("long")
    new = g.where(k % 10 != 1)
    label = F.when(k % 7 == 0, F.concat("label", F.lit("_v2"))).otherwise(F.col("label"))
    return g.where(k % 10 != 0), PropertyGraph(new.nodes.withColumn("label", label), new.edges)


_SNAP = f"""{_D}, k AS (SELECT *, substr(id, 5)::BIGINT AS k FROM d), o AS (SELECT id, label, type, source_file FROM k WHERE k % 10 <> 0), w AS (SELECT id, CASE WHEN k % 7 = 0 THEN label || '_v2' ELSE label END AS label, type, source_file FROM k WHERE k % 10 <> 1),
 oe AS (SELECT src, dst FROM l WHERE src IN (SELECT id FROM o) AND dst IN (SELECT id FROM o)), we AS (SELECT src, dst FROM l WHERE src IN (SELECT id FROM w) AND dst IN (SELECT id FROM w)),
 ds AS (SELECT coalesce(o.id, w.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN w.id IS NULL THEN 'removed' WHEN o.label IS DISTINCT FROM w.label OR o.type IS DISTINCT FROM w.type THEN 'modified' ELSE 'unchanged' END AS status FROM o FULL JOIN w ON o.id = w.id),
 de AS (SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, CASE WHEN a.src IS NULL THEN 'added' ELSE 'removed' END AS status FROM oe a FULL JOIN we b ON a.src = b.src AND a.dst = b.dst WHERE a.src IS NULL OR b.src IS NULL),
 wc AS (SELECT w.id, count(x.e) / (2.0::DOUBLE * ((SELECT count(*) FROM w) - 1)) AS c FROM w LEFT JOIN (SELECT src AS e FROM we UNION ALL SELECT dst FROM we) x ON x.e = w.id GROUP BY w.id),
 oc AS (SELECT o.id, count(x.e) / (2.0::DOUBLE * ((SELECT count(*) FROM o) - 1)) AS c FROM o LEFT JOIN (SELECT src AS e FROM oe UNION ALL SELECT dst FROM oe) x ON x.e = o.id GROUP BY o.id)"""


@query("G18_diff_nodes", f"{_SNAP} SELECT id, status FROM ds")
def g18(spark, d):
    return relational.diff_nodes(*_snapshots(spark, d))


@query("G18_diff_edges", f"{_SNAP} SELECT src, dst, status FROM de")
def g18e(spark, d):
    return relational.diff_edges(*_snapshots(spark, d))


@query("A15_diff_impact", f"""{_SNAP}, t AS (SELECT id FROM ds WHERE status <> 'unchanged' UNION SELECT src FROM de UNION SELECT dst FROM de), v AS (SELECT round(least(1.0, avg(coalesce(wc.c, oc.c, 0.0))), 6)::DOUBLE AS impact_score FROM t LEFT JOIN wc USING (id) LEFT JOIN oc USING (id))
 SELECT impact_score, CASE WHEN impact_score >= 0.5 THEN 'high' WHEN impact_score >= 0.2 THEN 'medium' ELSE 'low' END AS severity FROM v""")
def a15(spark, d):
    return relational.diff_impact(*_snapshots(spark, d))


@query("K2_review_shortlist", f"{_SNAP} SELECT id, status, round(c, 9) AS centrality FROM ds JOIN wc USING (id) WHERE status IN ('added', 'modified') ORDER BY c DESC, id LIMIT 5")
def k2(spark, d):
    return relational.review_shortlist(*_snapshots(spark, d)).select("id", "status", F.round("centrality", 9).alias("centrality"))


@query("G19_at_risk", f"""{_SNAP}, c AS (SELECT id FROM ds WHERE status IN ('added', 'modified')), x AS (SELECT src AS a, dst AS b FROM we UNION SELECT dst, src FROM we)
 SELECT DISTINCT b AS id, round(wc.c, 9) AS centrality FROM x JOIN c ON c.id = x.a JOIN wc ON wc.id = x.b WHERE b NOT IN (SELECT id FROM c)""")
def g19(spark, d):
    return relational.at_risk(*_snapshots(spark, d)).select("id", F.round("centrality", 9).alias("centrality"))


@query("G20_diff_view", f"{_SNAP} SELECT id, status, CASE WHEN status = 'unchanged' THEN 0.4 ELSE 1.0 END::DOUBLE AS score FROM ds")
def g20(spark, d):
    return relational.diff_view(*_snapshots(spark, d))[0].select("id", "status", "score")


@query("U7_incremental_merge", f"""{_SNAP}, f AS (SELECT DISTINCT source_file FROM o WHERE id LIKE '%3'), gone AS (SELECT id FROM o WHERE source_file IN (SELECT source_file FROM f)),
 nn AS (SELECT id, label FROM w WHERE source_file IN (SELECT source_file FROM f)), n2 AS (SELECT id, label FROM o WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT id, label FROM nn WHERE id NOT IN (SELECT id FROM o WHERE id NOT IN (SELECT id FROM gone)))
 SELECT id AS a, label AS b FROM n2 UNION ALL
 SELECT src, dst FROM (SELECT src, dst FROM oe WHERE src NOT IN (SELECT id FROM gone) UNION SELECT src, dst FROM we WHERE src IN (SELECT id FROM nn)) WHERE src IN (SELECT id FROM n2) AND dst IN (SELECT id FROM n2)""")
def u7(spark, d):
    old, new = _snapshots(spark, d)
    files = old.nodes.where("id like '%3'").select("source_file").distinct()
    nodes = new.nodes.join(files, "source_file", "left_semi")
    fresh = PropertyGraph(nodes, new.edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi"))
    g = relational.incremental_merge(old, fresh, files)
    return g.nodes.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))


# ---- traversal

_BFS = """x AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
 h0 AS (SELECT {seed} AS id, 0 AS depth), h1 AS (SELECT DISTINCT b AS id, 1 AS depth FROM x JOIN h0 ON x.a = h0.id WHERE b NOT IN (SELECT id FROM h0)),
 h2 AS (SELECT DISTINCT b AS id, 2 AS depth FROM x JOIN h1 ON x.a = h1.id WHERE b NOT IN (SELECT id FROM h0) AND b NOT IN (SELECT id FROM h1))"""


@query("G12_G13_neighbourhood", f"{_E}, {_BFS.format(seed=chr(39) + 'supplier:1' + chr(39))} SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2")
def g12(spark, d):
    g = entity_graph(spark, d)
    return traverse.around(g, g.nodes.where("id = 'supplier:1'"), 2)


_IMPACT = """own AS (SELECT id FROM n WHERE id IN ('supplier:1', 'supplier:2', 'nation:3')), b AS (SELECT DISTINCT dst AS id, src AS near FROM e WHERE relation <> 'contains'), q AS (SELECT * FROM b WHERE near NOT IN (SELECT id FROM own)),
 d1 AS (SELECT DISTINCT near AS id FROM q WHERE id IN (SELECT id FROM own)), d2 AS (SELECT DISTINCT near AS id FROM q WHERE id IN (SELECT id FROM d1) AND near NOT IN (SELECT id FROM d1)),
 f AS (SELECT id, 'owned' AS kind FROM own UNION ALL SELECT id, 'direct' FROM d1 UNION ALL SELECT id, 'transitive' FROM d2 UNION ALL SELECT id, 'safe' FROM own WHERE id NOT IN (SELECT id FROM b))"""


def _owned(g):
    return g.nodes.where("id in ('supplier:1', 'supplier:2', 'nation:3')")


@query("G14_impact", f"{_E}, {_IMPACT} SELECT id, kind FROM f")
def g14(spark, d):
    g = entity_graph(spark, d)
    return traverse.impact(g, _owned(g), 2)


@query("A14_impact_summary", f"""{_E}, {_IMPACT}, c AS (SELECT count(*) FILTER (kind = 'owned') AS owned, count(*) FILTER (kind = 'direct') AS direct, count(*) FILTER (kind = 'transitive') AS transitive, count(*) FILTER (kind = 'safe') AS safe FROM f)
 SELECT owned, direct, transitive, safe, round((direct + transitive) / (SELECT count(*) FROM n)::DOUBLE, 4) AS impact_score, CASE WHEN direct >= 6 THEN 'HIGH' WHEN direct >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM c""")
def a14(spark, d):
    g = entity_graph(spark, d)
    return traverse.impact_summary(g, traverse.impact(g, _owned(g), 2)).select("owned", "direct", "transitive", "safe", "impact_score", "risk")


@query("A13_K9_affected_files", f"{_E}, {_IMPACT} SELECT source_file, count(*) AS dependents FROM f JOIN n USING (id) WHERE kind IN ('direct', 'transitive') AND source_file <> 'schema/supplier.sql' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def a13(spark, d):
    g = entity_graph(spark, d)
    return traverse.impact_files(g, traverse.impact(g, _owned(g), 2), "./schema/supplier.sql")


@query("K6_highest_risk", f"""{_E}, own AS (SELECT * FROM n WHERE source_file = 'schema/nation.sql'), k AS (SELECT dst AS id, count(DISTINCT src) AS c FROM e WHERE relation <> 'contains' AND src NOT IN (SELECT id FROM own) GROUP BY 1)
 SELECT own.id, coalesce(c, 0)::BIGINT AS dependents FROM own LEFT JOIN k USING (id) ORDER BY 2 DESC, length(own.id), own.id LIMIT 1""")
def k6(spark, d):
    g = entity_graph(spark, d)
    return traverse.highest_risk(g, g.nodes.where("source_file = 'schema/nation.sql'"))


@query("G16_frontier", f"{_E}, {_BFS.format(seed=chr(39) + 'customer:1' + chr(39))}, u AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2) SELECT u.id, depth FROM u JOIN n USING (id) WHERE type <> 'nation'")
def g16(spark, d):
    g = entity_graph(spark, d)
    return traverse.frontier(g, g.nodes.where("id = 'customer:1'").select("id"), 2, ("nation",))


@query("G21_G22_expand_dependencies", f"""{_E}, r AS (SELECT DISTINCT b.source_file AS id, a.source_file AS near FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE relation IN ('imports_from', 'contains') AND a.source_file <> b.source_file)
 SELECT 'schema/part.sql' AS id, 0 AS depth UNION ALL SELECT near, 1 FROM r WHERE id = 'schema/part.sql'""")
def g22(spark, d):
    g = entity_graph(spark, d)
    return traverse.expand_dependencies(g, g.nodes.where("source_file = 'schema/part.sql'").select(F.col("source_file").alias("id")), 2)


# ---- scores

_Q = "en Doc sourceDoc the"
_WORDS = rank.query_terms(_Q)
_TERMS = sorted(set(_WORDS))


def _tfidf_sql(nodes: str, text: str) -> str:
    c = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS c{i}" for i, w in enumerate(_TERMS))
    df = ", ".join(f"ln((count(*) + 1) / (count(*) FILTER (c{i} > 0) + 1)::DOUBLE) + 1 AS i{i}" for i in range(len(_TERMS)))
    m = [f"(c{i} / greatest(len(t), 1)::DOUBLE * i{i})" for i in range(len(_TERMS))]
    q = [f"({_WORDS.count(w)} / {len(_WORDS)}::DOUBLE * i{i})" for i, w in enumerate(_TERMS)]
    dot, a, b = " + ".join(f"{x} * {y}" for x, y in zip(m, q)), " + ".join(f"{x} * {x}" for x in m), " + ".join(f"{x} * {x}" for x in q)
    return f"""tt AS (SELECT id, {_tok(text)} AS t FROM {nodes}), tc AS (SELECT id, t, {c} FROM tt), td AS (SELECT {df} FROM tc),
 sem AS (SELECT id, CASE WHEN sqrt({a}) * sqrt({b}) > 0 THEN ({dot}) / (sqrt({a}) * sqrt({b})) ELSE 0.0 END AS semantic FROM tc, td)"""


_DOCTEXT = "label || ' ' || coalesce(description, '')"


@query("G3_A4_A5_tfidf", f"{_D}, {_tfidf_sql('d', _DOCTEXT)} SELECT id, round(semantic, 6) AS semantic FROM sem")
def g3(spark, d):
    return rank.tfidf(document_graph(spark, d).nodes, _Q).select("id", F.round("semantic", 6).alias("semantic"))


@query("K1_top_by_score", f"{_D}, {_tfidf_sql('d', _DOCTEXT)} SELECT id, round(semantic, 6) AS score FROM sem ORDER BY 2 DESC, 1 LIMIT 20")
def k1(spark, d):
    return rank.tfidf(document_graph(spark, d).nodes, _Q).select("id", F.round("semantic", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


def _pagerank_sql(n: str, e: str, rounds: int) -> str:
    out = f"ow AS (SELECT src, sum(weight) AS w FROM {e} GROUP BY src), nn AS (SELECT count(*)::DOUBLE AS k FROM {n}), r0 AS (SELECT id, 1 / k AS r FROM {n}, nn)"
    for i in range(1, rounds + 1):
        out += f""", g{i} AS (SELECT x.dst AS id, sum(p.r * x.weight / ow.w) AS g FROM {e} x JOIN ow ON ow.src = x.src JOIN r{i - 1} p ON p.id = x.src GROUP BY 1),
 m{i} AS (SELECT coalesce(sum(r), 0) AS m FROM r{i - 1} WHERE id NOT IN (SELECT src FROM ow)),
 r{i} AS (SELECT p.id, 0.85 * coalesce(g, 0) + 0.85 * m / k + 0.15 / k AS r FROM r{i - 1} p LEFT JOIN g{i} USING (id), m{i}, nn)"""
    return out


@query("G1_G2_pagerank")
def g1(spark, d):
    r = rank.pagerank(entity_graph(spark, d))
    top = r.agg(F.max("rank").alias("top"))
    return r.join(F.broadcast(top)).select("id", F.round(F.col("rank") / F.col("top"), 7).alias("structural"))


# Ranks until they settle are beyond SQL (tests hold them against brute force); this is the operator with a number of rounds.
@query("G1_G2_pagerank_rounds", f"{_E}, {_pagerank_sql('n', 'e', 4)} SELECT id, round(r / (SELECT max(r) FROM r4), 7) AS structural FROM r4")
def g1_rounds(spark, d):
    r = rank.pagerank(entity_graph(spark, d), iterations=4, tolerance=None)
    top = r.agg(F.max("rank").alias("top"))
    return r.join(F.broadcast(top)).select("id", F.round(F.col("rank") / F.col("top"), 7).alias("structural"))


@query("G4_G5_combined_score")
def g4(spark, d):
    r = lambda c: F.round(c, 6).alias(c)
    return rank.score(document_graph(spark, d), _Q).select("id", r("score"), r("structural"), r("semantic"))


@query("G4_G5_combined_score_rounds", f"""{_D}, {_pagerank_sql('d', 'l', 3)}, {_tfidf_sql('d', _DOCTEXT)},
 s AS (SELECT d.id, file_type, r / (SELECT max(r) FROM r3) AS st, semantic FROM d JOIN r3 USING (id) JOIN sem USING (id))
 SELECT id, round(CASE WHEN file_type = 'code' THEN least(1.0, 0.4 * st + 0.6 * semantic + 0.3) ELSE 0.4 * st + 0.6 * semantic END, 6)::DOUBLE AS score, round(st, 6) AS structural, round(semantic, 6) AS semantic FROM s""")
def g4_rounds(spark, d):
    r = lambda c: F.round(c, 6).alias(c)
    return rank.score(document_graph(spark, d), _Q, iterations=3, tolerance=None).select("id", r("score"), r("structural"), r("semantic"))


@query("G6_G7_embeddings", "SELECT a.vec_id, round(greatest(0.0, least(1.0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)::DOUBLE AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def g6(spark, d):
    v = _t(spark, d, "embeddings")
    return rank.embedding_scores(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), v.where("vec_id = 0").select(F.col("embedding").alias("wanted"))).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


_HIST = """h AS (SELECT conv_id * 100 + turn AS id, text AS query, (length(text) + 2600)::BIGINT AS tokens_used, (conv_id % 90 + 10)::BIGINT AS nodes_total FROM conversations WHERE role = 'user' AND trim(coalesce(text, '')) <> '')"""
_HQ = "the theand inging que der"


def _history(spark, d) -> DataFrame:
    c = _t(spark, d, "conversations").where("role = 'user' and trim(coalesce(text, '')) <> ''")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("query"), (F.length("text") + 2600).cast("long").alias("tokens_used"), (F.col("conv_id") % 90 + 10).alias("nodes_total"))


_SIM = f"""{_HIST}, a AS (SELECT id, query FROM h UNION ALL SELECT NULL, '{_HQ}'), k AS (SELECT id, unnest({_tok('query')}) AS term FROM a), tf AS (SELECT id, term, count(*) AS c FROM k GROUP BY ALL), ln_ AS (SELECT id, count(*) AS n FROM k GROUP BY ALL), df AS (SELECT term, count(*) AS c FROM tf GROUP BY term),
 w AS (SELECT tf.id, tf.term, tf.c / ln_.n::DOUBLE * (ln(((SELECT count(*) FROM a) + 1) / (df.c + 1)::DOUBLE) + 1) AS w FROM tf JOIN ln_ ON tf.id IS NOT DISTINCT FROM ln_.id JOIN df ON df.term = tf.term),
 nm AS (SELECT id, sqrt(sum(w * w)) AS n FROM w GROUP BY ALL), qq AS (SELECT term, w AS q FROM w WHERE id IS NULL),
 dt AS (SELECT w.id, sum(w.w * q) / (max(nm.n) * (SELECT n FROM nm WHERE id IS NULL)) AS s FROM w JOIN qq USING (term) JOIN nm ON nm.id = w.id WHERE w.id IS NOT NULL GROUP BY w.id)"""


@query("G11_query_similarity", f"WITH {_SIM} SELECT h.id, round(coalesce(s, 0.0), 6)::DOUBLE AS similarity FROM h LEFT JOIN dt ON dt.id = h.id")
def g11(spark, d):
    return rank.query_similarities(_history(spark, d), _HQ).select("id", F.round("similarity", 6).alias("similarity"))


@query("C1_F5_F6_K7_similar_queries", f"WITH {_SIM} SELECT h.id, query, round(s, 4) AS similarity, tokens_used, nodes_total, round(greatest(0, nodes_total * 50 - tokens_used) / (nodes_total * 50)::DOUBLE * 100, 1)::DOUBLE AS savings_pct FROM h JOIN dt USING (id) WHERE s >= 0.05")
def c1s(spark, d):
    return analytics.similar_queries(_history(spark, d), _HQ, 0.05)


@query("C1_A11_budget_advice", f"""WITH {_SIM}, f AS (SELECT tokens_used, round(greatest(0, nodes_total * 50 - tokens_used) / (nodes_total * 50)::DOUBLE * 100, 1) AS sv FROM h JOIN dt USING (id) WHERE s >= 0.3), b AS (SELECT coalesce(ceil(quantile_cont(tokens_used::DOUBLE, 0.75)), 4000)::BIGINT AS budget, count(*) AS k, avg(sv) AS sv FROM f)
 SELECT budget, k AS "similar", CASE WHEN k = 0 THEN 'NONE' WHEN k >= 10 THEN 'HIGH' WHEN k >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, coalesce((SELECT round(avg(least(1.0, budget / tokens_used::DOUBLE)) * 100, 1) FROM f), 0.0)::DOUBLE AS expected_coverage, round(coalesce(sv, 0.0), 1)::DOUBLE AS expected_savings, round(budget / 1e6 * 3.0, 6)::DOUBLE AS cost_usd FROM b""")
def c1(spark, d):
    return analytics.recommend_budget(_history(spark, d), _HQ)


@query("A8_top_nodes", "SELECT user_id AS node, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, min(event_id) LIMIT 10")
def a8(spark, d):
    e = _t(spark, d, "events").select(F.col("event_id").alias("ord"), F.array("user_id").alias("top_nodes"))
    return analytics.top_nodes(e, 10)


@query("A9_A10_percentiles", """SELECT count(*) AS n, round(avg(l_extendedprice), 6) AS mean, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.75), 6) AS p75, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95,
 min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(sum(l_extendedprice), 2) AS total FROM lineitem""")
def a9(spark, d):
    return analytics.percentiles(_t(spark, d, "lineitem"), "l_extendedprice").withColumn("total", F.round("total", 2))


@query("A16_discriminative_tokens", f"""{_E}, x AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), s AS (SELECT DISTINCT b AS id FROM x WHERE a = 'supplier:1'),
 t AS (SELECT id, unnest(list_distinct(list_filter({_tok('label')}, lambda t: length(t) >= 3 AND NOT list_contains([{_NOISE}], t) AND NOT regexp_matches(t, '^[0-9]+$')))) AS token FROM n),
 lo AS (SELECT token, count(*) AS here FROM t WHERE id IN (SELECT id FROM s) GROUP BY 1), gl AS (SELECT token, count(*) AS every_ FROM t GROUP BY 1),
 r AS (SELECT token, here / (SELECT count(*) FROM s)::DOUBLE * ln((SELECT count(*) FROM n) / (1 + every_)::DOUBLE) AS score FROM lo JOIN gl USING (token) WHERE here > 1 OR (SELECT count(*) FROM s) = 1 ORDER BY 2 DESC, 1 LIMIT 5)
 SELECT token, round(score, 6) AS score FROM r WHERE score > 0""")
def a16(spark, d):
    g = entity_graph(spark, d)
    near = relational.neighbours(g.edges).where("id = 'supplier:1'").select(F.col("near").alias("id"))
    return analytics.discriminative_tokens(g, near, 5).select("token", F.round("score", 6).alias("score"))


@query("A17_languages", "SELECT CASE source WHEN 'src0' THEN 'python' WHEN 'src1' THEN 'go' ELSE 'rust' END AS language, count(*) AS files FROM documents GROUP BY 1")
def a17(spark, d):
    ext = F.when(F.col("source") == "src0", ".py").when(F.col("source") == "src1", ".GO").otherwise(".rs")
    return analytics.languages(_t(spark, d, "documents").select(F.concat(F.lit("a/"), F.col("source"), ext).alias("path")))


@query("A18_evaluation", """WITH r AS (SELECT (event_id % 10) / 10.0::DOUBLE AS a, (event_id % 7) / 7.0::DOUBLE AS b, event_id % 50 + 1 AS t, event_id % 300 + 100 AS u, CASE WHEN event_id % 11 = 0 THEN 'timeout' END AS error FROM events), g AS (SELECT * FROM r WHERE error IS NULL)
 SELECT count(*) AS judged, (SELECT count(*) FROM r WHERE error IS NOT NULL) AS errors, round(count(*) FILTER (a > b) / greatest(count(*), 1)::DOUBLE * 100, 1) AS win_rate, round(avg(a), 4) AS mean_with, round(avg(b), 4) AS mean_without, round(sum(a) / sum(t), 8) AS quality_per_token, round((1 - sum(t) / sum(u)::DOUBLE) * 100, 1) AS savings_pct FROM g""")
def a18(spark, d):
    e, k = _t(spark, d, "events"), F.col("event_id")
    return analytics.evaluation(e.select((k % 10 / 10.0).alias("score_with"), (k % 7 / 7.0).alias("score_without"), (k % 50 + 1).alias("tokens_with"), (k % 300 + 100).alias("tokens_without"), F.when(k % 11 == 0, "timeout").alias("error")))


@query("C5_judge_replies", """SELECT event_id AS id, CASE WHEN event_id % 9 <> 0 THEN least(1.0, (event_id % 15) / 10.0) END::DOUBLE AS score_a, CASE WHEN event_id % 9 <> 0 THEN 0.5 END::DOUBLE AS score_b, CASE WHEN event_id % 9 <> 0 THEN event_type END AS reasoning FROM events""")
def c5(spark, d):
    k = F.col("event_id")
    body = F.concat(F.lit('Verdict:\n{"score_a": '), (k % 15 / 10.0).cast("string"), F.lit(', "score_b": 0.5, "reasoning": "'), F.col("event_type"), F.lit('"}\nend'))
    return analytics.parse_verdicts(_t(spark, d, "events").select(k.alias("id"), F.when(k % 9 != 0, body).otherwise("no object").alias("reply")))


@query("G23_G24_P18_profiles", f"""{_E}, x AS (SELECT DISTINCT src, dst, relation FROM e), dp AS (SELECT dst AS id, count(DISTINCT src) AS production FROM x WHERE relation <> 'contains' GROUP BY 1), ce AS (SELECT src AS id, count(DISTINCT dst) AS callees FROM x GROUP BY 1), pa AS (SELECT dst AS id, min(src) AS parent FROM x WHERE relation = 'contains' GROUP BY 1),
 f AS (SELECT n.id, coalesce(production, 0) AS p, coalesce(callees, 0) AS c, parent FROM n LEFT JOIN dp USING (id) LEFT JOIN ce USING (id) LEFT JOIN pa USING (id))
 SELECT id, p AS production, 0::BIGINT AS tests, c AS callees, parent, CASE WHEN p > 10 THEN 'central utility' WHEN p >= 5 AND c >= 5 THEN 'orchestrator' WHEN p >= 5 THEN 'shared utility' WHEN p = 0 AND c >= 5 THEN 'entry point' WHEN p = 0 AND c = 0 THEN 'isolated' ELSE 'leaf' END AS role,
 CASE WHEN p >= 6 THEN 'HIGH' WHEN p >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk, round(p / (SELECT count(*) FROM n)::DOUBLE * 100, 1) AS dependents_share FROM f""")
def g23(spark, d):
    return analytics.profiles(entity_graph(spark, d))


# By id, by label in another case, by the last part of an id, and a name that nothing has.
@query("K4_find_node", f"""{_E}, t AS (SELECT replace(id, ':', '.') AS id, label FROM n), m AS (SELECT n_name AS name FROM nation WHERE n_nationkey = 7),
 a AS (SELECT id, label, 0 AS tier FROM t WHERE id = 'nation.7'),
 b AS (SELECT id, label, CASE WHEN id = name THEN 0 ELSE 1 END AS tier FROM t, m WHERE lower(label) = lower(name) ORDER BY tier, id LIMIT 1),
 c AS (SELECT id, label, 2 AS tier FROM t WHERE ends_with(lower(id), '.24') ORDER BY id LIMIT 1)
 SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def k4(spark, d):
    g = entity_graph(spark, d)
    dotted = PropertyGraph(g.nodes.withColumn("id", F.replace("id", F.lit(":"), F.lit("."))), g.edges)
    name = _t(spark, d, "nation").where("n_nationkey = 7").first()["n_name"]
    found = [analytics.find_node(dotted, x).select("id", "label", "tier") for x in ("nation.7", name.swapcase(), "24", "no such node")]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


# ---- resolution and intervals

_DOTS = "replace(translate(regexp_extract(url, '//([^?#]*)', 1), '/', '.'), '..', '.')"


def _dotted(spark, d) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", F.replace(F.translate(F.regexp_extract("url", "//([^?#]*)", 1), "/", "."), F.lit(".."), F.lit(".")).alias("id"))


_SUFFIX = f"""i AS (SELECT DISTINCT {_DOTS} AS id FROM pages), p AS (SELECT id, string_split(id, '.') AS a FROM i), s AS (SELECT id, array_to_string(a[k:], '.') AS suffix FROM (SELECT id, a, unnest(range(1, len(a) + 1)) AS k FROM p)), u AS (SELECT suffix, min(id) AS id FROM s GROUP BY 1 HAVING count(*) = 1)"""


@query("X1_J8_suffix_index", f"WITH {_SUFFIX} SELECT suffix, id FROM u")
def x1(spark, d):
    return resolve.suffix_index(_dotted(spark, d))


@query("X2_J9_resolve_suffix", f"""WITH {_SUFFIX}, q AS (SELECT page_id AS key, string_split('x.' || {_DOTS}, '.') AS a FROM pages), t AS (SELECT key, k, array_to_string(a[k:], '.') AS suffix FROM (SELECT key, a, unnest(range(1, len(a) + 1)) AS k FROM q))
 SELECT key, arg_min(u.id, k) AS id FROM t JOIN u USING (suffix) GROUP BY key""")
def x2(spark, d):
    ids = _dotted(spark, d)
    return resolve.resolve_suffix(ids.select(F.col("page_id").alias("key"), F.concat(F.lit("x."), "id").alias("name")), resolve.suffix_index(ids))


@query("J9_longest_prefix", f"""WITH m AS (SELECT DISTINCT regexp_extract({_DOTS}, '^([^.]*\\.[^.]*)', 1) AS id FROM pages UNION SELECT regexp_extract({_DOTS}, '^([^.]*\\.[^.]*\\.[^.]*)', 1) FROM pages WHERE page_id % 2 = 0), q AS (SELECT page_id AS key, string_split({_DOTS}, '.') AS a FROM pages),
 t AS (SELECT key, k, array_to_string(a[1:k], '.') AS id FROM (SELECT key, a, unnest(range(1, len(a) + 1)) AS k FROM q)) SELECT key, arg_max(t.id, k) AS id FROM t JOIN m USING (id) GROUP BY key""")
def j9(spark, d):
    ids = _dotted(spark, d)
    two, three = F.regexp_extract("id", r"^([^.]*\.[^.]*)", 1).alias("id"), F.regexp_extract("id", r"^([^.]*\.[^.]*\.[^.]*)", 1).alias("id")
    return resolve.longest_prefix(ids.select(F.col("page_id").alias("key"), F.col("id").alias("name")), ids.select(two).unionByName(ids.where("page_id % 2 = 0").select(three)))


_SPANS = """sp AS (SELECT doc_id AS file, 'outer' AS name, 0 AS st, n_chars AS en FROM documents UNION ALL SELECT doc_id, 'half', n_chars // 4, n_chars // 2 FROM documents UNION ALL SELECT doc_id, 'inner', n_chars // 3, n_chars // 3 + 20 FROM documents), pt AS (SELECT doc_id AS file, unnest([5, n_chars // 3 + 2, n_chars // 2 + 1]) AS at_ FROM documents)"""


def _spans(spark, d) -> tuple[DataFrame, DataFrame]:
    n, t = F.col("n_chars"), _t(spark, d, "documents")
    part = lambda k: F.floor(n / k).cast("long")
    s = lambda name, a, b: F.struct(F.lit(name).alias("name"), a.cast("long").alias("start"), b.cast("long").alias("end"))
    spans = t.select(F.col("doc_id").alias("file"), F.explode(F.array(s("outer", F.lit(0), n), s("half", part(4), part(2)), s("inner", part(3), part(3) + 20))).alias("s")).select("file", "s.name", "s.start", "s.end")
    return t.select(F.col("doc_id").alias("file"), F.explode(F.array(F.lit(5).cast("long"), part(3) + 2, part(2) + 1)).alias("at")), spans


@query("J10_innermost_span", f"WITH {_SPANS} SELECT p.file, p.at_ AS \"at\", arg_min(name, [en - st, st]) AS name FROM (SELECT DISTINCT * FROM pt) p JOIN sp ON sp.file = p.file AND st < at_ AND at_ < en GROUP BY ALL")
def j10(spark, d):
    points, spans = _spans(spark, d)
    return resolve.innermost(points, spans)


@query("J11_last_span", f"WITH {_SPANS} SELECT p.file, p.at_ AS \"at\", arg_min(name, [-st, -en]) AS name FROM (SELECT DISTINCT * FROM pt) p JOIN sp ON sp.file = p.file AND st <= at_ AND at_ < en GROUP BY ALL")
def j11(spark, d):
    points, spans = _spans(spark, d)
    return resolve.innermost(points, spans, "last", strict=False)


@query("A20_X5_packages", "SELECT source || doc_id % 97 AS package, min(lang) AS dir FROM documents GROUP BY 1 HAVING count(DISTINCT lang) = 1")
def a20(spark, d):
    return resolve.packages(_t(spark, d, "documents").select(F.concat("source", (F.col("doc_id") % 97).cast("string")).alias("package"), F.col("lang").alias("dir")))


# ---- selection and benchmark

@query("G9_select_without_boost", f"""{_E}, c AS (SELECT id, round(((length(id) * 37 + length(label) * 11) % 101) / 100.0, 2)::DOUBLE AS score, ceil(length({_LINE}) / 4.0)::BIGINT AS cost FROM n),
 o AS (SELECT list({{'id': id, 'cost': cost}} ORDER BY score DESC, id) AS xs FROM c WHERE score >= 0.2),
 r AS (SELECT list_reduce(list_transform(xs, lambda x: {{'left_': 300::BIGINT, 'ids': [x.id], 'cost': x.cost}}), lambda a, x: CASE WHEN x.cost <= a.left_ THEN {{'left_': a.left_ - x.cost, 'ids': list_concat(a.ids, x.ids), 'cost': 0::BIGINT}} ELSE a END, {{'left_': 300::BIGINT, 'ids': []::VARCHAR[], 'cost': 0::BIGINT}}) AS a FROM o)
 SELECT (k - 1)::INT AS pos, a.ids[k] AS id FROM (SELECT a, unnest(range(1, len(a.ids) + 1)) AS k FROM r)""")
def g9(spark, d):
    n = entity_graph(spark, d).nodes
    line = X.serialised(*map(F.col, ("id", "label", "type", "description", "source_file")))
    rows = n.select("id", F.round((F.length("id") * 37 + F.length("label") * 11) % 101 / 100.0, 2).alias("score"), X.estimated_tokens(line).alias("cost"))
    return S.select_without_boost(rows.where("score >= 0.2"), 300)


@query("G9_select_with_boost")
def g9b(spark, d):
    g = entity_graph(spark, d)
    scores = g.nodes.select(F.lit("q").alias("query"), "id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("score"))
    return S.select(g, scores, spark.range(1).select(F.lit("q").alias("query"), F.explode(F.array(F.lit(1000).cast("long"), F.lit(4000).cast("long"))).alias("budget")), 0.5, 0.3)


@query("C2_A10_benchmark")
def c2(spark, d):
    return analytics.benchmark(document_graph(spark, d), ["en the", "source Doc"], (1000, 4000))


@query("J13_query_budget_pairs", "SELECT q.event_type AS query, b.budget FROM (SELECT DISTINCT event_type FROM events) q, (SELECT unnest([1000, 4000, 8000])::BIGINT AS budget) b")
def j13(spark, d):
    return analytics.query_budget_pairs(_t(spark, d, "events").select(F.col("event_type").alias("query")))


@query("S15_S17_session_tail", "SELECT event_type AS query, event_id::INT AS tokens FROM events ORDER BY event_id DESC LIMIT 20")
def s17(spark, d):
    path = _scratch(spark, "session")
    # In the order of the log; entries without a time stay, what is no object goes.
    entry = F.to_json(F.struct(F.when(F.col("event_id") % 3 > 0, F.col("ts").cast("string")).alias("ts"), F.col("event_type").alias("query"), F.col("event_id").cast("int").alias("tokens")))
    _t(spark, d, "events").orderBy("event_id").select(F.concat(entry, F.lit("\n[1]\n{\"ts\": \"20")).alias("value")).write.text(path)
    return logs.read_session(spark, path, 20).select("query", "tokens")


@query("U8_suggestion_dedup", f"""WITH k AS (SELECT conv_id * 100 + turn AS id, array_to_string(list_sort(list_distinct({_tok('coalesce(text, chr(32))')})), ' ') AS key FROM conversations) SELECT key, min(id) AS id FROM k GROUP BY key""")
def u8(spark, d):
    c = _t(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.coalesce("text", F.lit(" ")).alias("query"))
    return analytics.first_of_equal_queries(c)


@query("K8_viz_top", f"{_E}, g AS (SELECT dst AS id, count(*) AS k FROM e GROUP BY 1) SELECT id, k AS score FROM g ORDER BY k DESC, id LIMIT 50")
def k8(spark, d):
    counts = entity_graph(spark, d).edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("score"))
    return view.shown_nodes(counts)


@query("R1_rank_column", f"{_D}, {_tfidf_sql('d', _DOCTEXT)} SELECT row_number() OVER (ORDER BY round(semantic, 6) DESC, id)::INT AS rank, id FROM sem ORDER BY 1 LIMIT 50")
def r1(spark, d):
    top = rank.tfidf(document_graph(spark, d).nodes, _Q).select("id", F.round("semantic", 6).alias("s")).orderBy(F.desc("s"), "id").limit(50)
    return top.select(F.row_number().over(Window.orderBy(F.desc("s"), "id")).alias("rank"), "id")


# ---- sources, sinks, parsers and streams: written to the shared folder and read back

def _scratch(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder (a private one where none is set, as in tests)."""
    import tempfile
    from uuid import uuid4

    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='wg-')}/{name}-{uuid4().hex}"


_EDGE_DIGEST = "SELECT src, dst, relation FROM e"


@query("S4_S5_S10_graphml", f"{_E} {_EDGE_DIGEST}")
def s4(spark, d):
    path = _scratch(spark, "graphml")
    graphs.write_graphml(entity_graph(spark, d), path)
    return graphs.read_graphml(spark, path).edges.select("src", "dst", "relation")


@query("S6_S7_S11_csv", f"{_E} SELECT id, label, type, coalesce(description, '') AS description FROM n")
def s6(spark, d):
    path, g = _scratch(spark, "csv"), entity_graph(spark, d)
    graphs.write_csv(g, path)
    return graphs.read_csv(spark, f"{path}/nodes", f"{path}/relationships").nodes.select("id", "label", "type", "description")


@query("S14_S15_S16_logs", "SELECT event_type AS query, count(*) AS entries, sum(event_id)::BIGINT AS tokens FROM events GROUP BY event_type")
def s14(spark, d):
    path = _scratch(spark, "audit")
    logs.append(_t(spark, d, "events").select(F.col("event_type").alias("query"), F.col("event_id").cast("int").alias("tokens_used")), path)
    return logs.read_audit(spark, path).groupBy("query").agg(F.count("*").alias("entries"), F.sum("tokens_used").alias("tokens"))


@query("I1_X7_index_python", """WITH f AS (SELECT 'pkg.s' || (doc_id % 7) || '.m' || doc_id AS m, 'Doc' || doc_id AS c FROM documents),
 p AS (SELECT m, c, m || '.' || c AS k FROM f)
 SELECT m AS src, m || '.helper' AS dst, 'contains' AS relation FROM p UNION ALL SELECT m, k, 'contains' FROM p UNION ALL SELECT k, k || '.run', 'contains' FROM p UNION ALL SELECT k, k || '.stop', 'contains' FROM p
 UNION ALL SELECT k || '.run', m || '.helper', 'calls' FROM p UNION ALL SELECT k || '.run', k || '.stop', 'calls' FROM p UNION ALL SELECT k || '.stop', k, 'calls' FROM p""")
def i1(spark, d):
    name = F.col("doc_id").cast("string")
    text = F.format_string("def helper():\n    pass\n\nclass Doc%1$s:\n    def run(self):\n        helper()\n        return self.stop()\n\n    def stop(self):\n        return Doc%1$s()\n", name)
    files = _t(spark, d, "documents").select(F.concat(F.lit("pkg/s"), (F.col("doc_id") % 7).cast("string"), F.lit("/m"), name, F.lit(".py")).alias("path"), text.alias("content"))
    return index.index_files(files).edges.select("src", "dst", "relation")


@query("I3_X5_index_go_calls", """SELECT 'cmd.c' || doc_id || '.main.main' AS src, 'lib.p' || doc_id || '.a.Run' AS dst FROM documents""")
def i3(spark, d):
    name = F.col("doc_id").cast("string")
    docs = _t(spark, d, "documents")
    lib = docs.select(F.concat(F.lit("lib/p"), name, F.lit("/a.go")).alias("path"), F.format_string("package p%1$s\n\nfunc Run() {}\n", name).alias("content"))
    cmd = docs.select(F.concat(F.lit("cmd/c"), name, F.lit("/main.go")).alias("path"), F.format_string('package main\n\nimport "example.com/lib/p%1$s"\n\nfunc main() { p%1$s.Run() }\n', name).alias("content"))
    return index.index_files(lib.unionByName(cmd)).edges.where("relation = 'calls'").select("src", "dst")


def _calls_of(spark, d, shapes: dict[str, str]) -> DataFrame:
    """Calls of the files that each document's id makes of ``shapes`` (path, content; ``@`` is the id)."""
    files = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(c).alias("content")) for p, c in shapes.items()])
    name = F.col("doc_id").cast("string")
    made = _t(spark, d, "documents").select(name.alias("name"), F.inline(files))
    filled = made.select(*[F.replace(c, F.lit("@"), F.col("name")).alias(c) for c in ("path", "content")])
    return index.index_files(filled).edges.where("relation = 'calls'").select("src", "dst")


def _calls_sql(pairs: list[tuple[str, str]]) -> str:
    rows = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    return f"SELECT replace(a, '@', doc_id::VARCHAR) AS src, replace(b, '@', doc_id::VARCHAR) AS dst FROM documents, (VALUES {rows}) t(a, b)"


JAVA = {
    "j@/text/Joiner.java": "package s@.text;\npublic class Joiner {\n  public static String glue(String a) { return a; }\n  public String tie(String a) { return a; }\n}\n",
    "j@/text/Near.java": "package s@.text;\npublic class Near {\n  public static String at() { return Joiner.glue(null); }\n}\n",
    "j@/more/Joiner.java": "package s@.more;\npublic class Joiner {\n  public static String glue(String a) { return a; }\n}\n",
    "j@/Main.java": "package s@.app;\nimport s@.text.Joiner;\nimport static s@.text.Near.at;\npublic class Main {\n  Object a() { return new Joiner(); }\n"
    "  String b() { return at(); }\n  String c(Joiner it) { return it.tie(null); }\n}\n",
    "j@/Wild.java": "package s@.app;\nimport s@.text.*;\nimport s@.more.*;\npublic class Wild {\n  String a() { return Near.at(); }\n  String b() { return Joiner.glue(null); }\n}\n",
}


@query("X3_java_calls", _calls_sql([
    ("j@.text.Near.Near.at", "j@.text.Joiner.Joiner.glue"), ("j@.Main.Main.a", "j@.text.Joiner.Joiner"), ("j@.Main.Main.b", "j@.text.Near.Near.at"),
    ("j@.Main.Main.c", "j@.text.Joiner.Joiner.tie"), ("j@.Wild.Wild.a", "j@.text.Near.Near.at"),
]))
def x3(spark, d):
    return _calls_of(spark, d, JAVA)


RUST = {
    "r@/src/lib.rs": "pub mod util;\nuse crate::util::run;\npub fn start() { run(); util::deep::dig(); }\n",
    "r@/src/util/mod.rs": "pub mod deep;\npub fn run() {}\n",
    "r@/src/util/deep.rs": "use super::*;\npub fn dig() { run(); super::super::start(); }\n",
    "r@/src/shape.rs": "pub struct Square { n: i32 }\nimpl Square {\n    pub fn new() -> Square { Square { n: 1 } }\n    pub fn area(&self) -> i32 { 1 }\n}\n",
    "tool@/src/main.rs": "use r@::shape::{self, Square};\nfn main() { let b = Square::new(); b.area(); shape::missing(); }\n",
}


@query("X4_rust_calls", _calls_sql([
    ("r@.src.lib.start", "r@.src.util.mod.run"), ("r@.src.lib.start", "r@.src.util.deep.dig"), ("r@.src.util.deep.dig", "r@.src.util.mod.run"),
    ("r@.src.util.deep.dig", "r@.src.lib.start"), ("tool@.src.main.main", "r@.src.shape.Square.new"), ("tool@.src.main.main", "r@.src.shape.Square.area"),
]))
def x4(spark, d):
    return _calls_of(spark, d, RUST)


TYPESCRIPT = {
    "t@/lib/math.ts": "export function add() { }\nexport class Sum {\n  total(): number { return 1; }\n}\n",
    "t@/lib/index.ts": "export function all() { }\n",
    "t@/one.ts": "export default function only() { }\n",
    "t@/app/page.ts": "import { add as plus, Sum } from '../lib/math';\nimport { all } from '../lib';\nimport one from '../one.js';\nimport * as m from '../lib/math';\n"
    "import { add } from 'elsewhere/math';\nexport function a() { plus(); all(); one(); add(); }\nexport function b() { m.add(); const s = new Sum(); s.total(); }\n",
}


@query("X6_typescript_calls", _calls_sql([
    ("t@.app.page.a", "t@.lib.math.add"), ("t@.app.page.a", "t@.lib.index.all"), ("t@.app.page.a", "t@.one.only"),
    ("t@.app.page.b", "t@.lib.math.add"), ("t@.app.page.b", "t@.lib.math.Sum"), ("t@.app.page.b", "t@.lib.math.Sum.total"),
]))
def x6(spark, d):
    return _calls_of(spark, d, TYPESCRIPT)


@query("T2_session_stream", "SELECT event_type AS query, count(*) AS entries FROM events GROUP BY event_type")
def t2(spark, d):
    source, out, ck = (_scratch(spark, x) for x in ("sessions", "tailed", "progress"))
    _t(spark, d, "events").select(F.to_json(F.struct(F.col("ts").cast("string").alias("ts"), F.col("event_type").alias("query"))).alias("value")).unionByName(spark.createDataFrame([("not an entry",)], "value string")).write.text(source)
    live.tail_sessions(spark, source, lambda b, n: b.write.mode("append").parquet(out), ck, once=True).awaitTermination()
    return spark.read.parquet(out).groupBy("query").agg(F.count("*").alias("entries"))
