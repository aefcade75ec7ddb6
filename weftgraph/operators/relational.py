"""Degrees, filters, set operations, federation, incremental merge and diff."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.plans.graph import PropertyGraph, first_wins, inside


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, out_weight) of the ends of ``edges``, in one aggregate."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.coalesce("weight", F.lit(1.0)).alias("w")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.lit(0.0).alias("w")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"), F.sum("e.w").alias("out_weight"))


def with_degrees(g: PropertyGraph) -> DataFrame:
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return g.nodes.join(degrees(g.edges), "id", "left").select(*g.nodes.columns, zero("in_degree", 0), zero("out_degree", 0), zero("out_weight", 0.0))


def centrality(g: PropertyGraph) -> DataFrame:
    """(id, centrality): degree centrality, (in + out) / (2 (n - 1)); 0 in a graph of one node."""
    total = g.nodes.agg(F.count("*").alias("n"))
    value = F.when(F.col("n") > 1, (F.col("in_degree") + F.col("out_degree")) / (2 * (F.col("n") - 1))).otherwise(0.0)
    # One row: its size is bounded by what it is.
    return with_degrees(g).join(F.broadcast(total)).select("id", value.alias("centrality"))


def dependents(g: PropertyGraph) -> DataFrame:
    """(id, production, tests): distinct callers of each called node, containers aside."""
    calls = g.edges.where("relation <> 'contains'").select("src", "dst").distinct()
    src = g.nodes.select(F.col("id").alias("src"), X.is_test(F.col("id"), F.col("source_file")).alias("test"))
    return calls.join(src, "src").groupBy(F.col("dst").alias("id")).agg(F.count_if(~F.col("test")).alias("production"), F.count_if("test").alias("tests"))


def type_counts(g: PropertyGraph) -> DataFrame:
    """(type, nodes)."""
    return g.nodes.groupBy("type").agg(F.count("*").alias("nodes"))


def most_depended_on(g: PropertyGraph, n: int = 10) -> DataFrame:
    """(id, in_degree) of the ends with most incoming edges, equals by id."""
    counts = g.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    return counts.orderBy(F.desc("in_degree"), "id").limit(n)


def parse_ignore(lines: list[str]) -> dict[str, list[str]]:
    """Rules ``type:``, ``file:`` and ``id:``; blank lines, comments and other prefixes are skipped."""
    rules: dict[str, list[str]] = {"type": [], "file": [], "id": []}
    for line in map(str.strip, lines):
        kind, colon, what = line.partition(":")
        if line and line[0] != "#" and colon and kind.strip() in rules and what.strip():
            rules[kind.strip()].append(what.strip())
    return rules


def ignored(rules: dict[str, list[str]]) -> F.Column:
    path = F.coalesce("source_file", F.lit(""))
    kind = F.coalesce(F.col("type"), F.lit("")).isin(*rules["type"]) if rules["type"] else F.lit(False)
    return kind | X.matches_any(path, rules["file"]) | X.matches_any(X.basename(path), rules["file"]) | X.matches_any(F.col("id"), rules["id"])


def apply_ignore(g: PropertyGraph, rules: dict[str, list[str]]) -> PropertyGraph:
    return g.where(~ignored(rules)) if any(rules.values()) else g


def dedup_edges(edges: DataFrame) -> DataFrame:
    """First edge of each (src, dst, pending) by ``ord``: the relation is not part of the key."""
    return first_wins(edges, ["src", "dst", "pending"])


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, near): neighbours in either direction."""
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("near")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("near"))).where("id <> near").distinct()


def federate(graphs: dict[str, PropertyGraph]) -> PropertyGraph:
    """One graph of several: ids prefixed by the graph's label, dangling edges dropped. One graph passes as it is."""
    if len(graphs) == 1:
        return next(iter(graphs.values()))
    tagged = lambda name, c: F.concat_ws("::", F.lit(name), F.col(c)).alias(c)
    nodes = [g.nodes.select(tagged(k, "id"), *[c for c in g.nodes.columns if c != "id"], F.lit(k).alias("_project")) for k, g in graphs.items()]
    edges = [inside(g.edges, g.nodes.select("id")).select(tagged(k, "src"), tagged(k, "dst"), *[c for c in g.edges.columns if c not in ("src", "dst")]) for k, g in graphs.items()]
    merge = lambda dfs: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    return PropertyGraph(merge(nodes), merge(edges))


def federation_stats(graphs: dict[str, PropertyGraph]) -> DataFrame:
    """(project, nodes, collisions): distinct ids of each graph, and how many of them another has too."""
    ids = reduce(DataFrame.unionByName, [g.nodes.select("id", F.lit(k).alias("project")) for k, g in graphs.items()]).distinct()
    shared = ids.groupBy("id").agg(F.count("*").alias("graphs"))
    return ids.join(shared, "id").groupBy("project").agg(F.count("*").alias("nodes"), F.count_if(F.col("graphs") > 1).alias("collisions"))


def incremental_merge(old: PropertyGraph, new: PropertyGraph, files: DataFrame) -> PropertyGraph:
    """Replaces what comes from ``files`` (source_file): its nodes, and the edges that start from them."""
    gone = old.nodes.join(files, "source_file", "left_semi").select("id")
    nodes = first_wins(old.nodes.join(gone, "id", "left_anti").withColumn("ord", F.lit(0)).unionByName(new.nodes.withColumn("ord", F.lit(1)), allowMissingColumns=True), ["id"])
    kept = old.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").select(*old.edges.columns)
    edges = first_wins(kept.withColumn("ord", F.lit(0)).unionByName(new.edges.withColumn("ord", F.lit(1)), allowMissingColumns=True), ["src", "dst"]).drop("ord")
    nodes = nodes.drop("ord")
    return PropertyGraph(nodes, inside(edges, nodes.select("id")))


def diff_nodes(old: PropertyGraph, new: PropertyGraph) -> DataFrame:
    """(id, status): added, removed, modified (label or type) or unchanged, in one full outer join."""
    side = lambda g, p: g.nodes.select("id", F.col("label").alias(f"{p}_label"), F.col("type").alias(f"{p}_type"), F.lit(True).alias(p))
    same = F.col("a_label").eqNullSafe(F.col("b_label")) & F.col("a_type").eqNullSafe(F.col("b_type"))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~same, "modified").otherwise("unchanged")
    return side(old, "a").join(side(new, "b"), "id", "full_outer").select("id", status.alias("status"))


def diff_edges(old: PropertyGraph, new: PropertyGraph) -> DataFrame:
    side = lambda g, p: g.edges.select("src", "dst").distinct().withColumn(p, F.lit(True))
    return side(old, "a").join(side(new, "b"), ["src", "dst"], "full_outer").where("a is null or b is null").select("src", "dst", F.when(F.col("a").isNull(), "added").otherwise("removed").alias("status"))


def diff_impact(old: PropertyGraph, new: PropertyGraph) -> DataFrame:
    """One row: mean centrality (in the new graph, else in the old) of what changed, at most 1."""
    nodes, edges = diff_nodes(old, new).where("status <> 'unchanged'"), diff_edges(old, new)
    touched = nodes.select("id").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("id"))).distinct()
    now, before = centrality(new).withColumnRenamed("centrality", "now"), centrality(old).withColumnRenamed("centrality", "before")
    value = touched.join(now, "id", "left").join(before, "id", "left").select(F.coalesce("now", "before", F.lit(0.0)).alias("c"))
    return value.agg(F.round(F.least(F.lit(1.0), F.coalesce(F.avg("c"), F.lit(0.0))), 6).alias("impact_score")).withColumn("severity", X.severity(F.col("impact_score")))


def review_shortlist(old: PropertyGraph, new: PropertyGraph, n: int = 5) -> DataFrame:
    """The most central changed nodes of the new graph."""
    changed = diff_nodes(old, new).where("status in ('added', 'modified')")
    return changed.join(centrality(new), "id").orderBy(F.desc("centrality"), "id").limit(n)


def at_risk(old: PropertyGraph, new: PropertyGraph) -> DataFrame:
    """Neighbours of added and modified nodes that are not changed themselves, with their centrality."""
    changed = diff_nodes(old, new).where("status in ('added', 'modified')").select("id")
    near = neighbours(new.edges).join(changed, "id", "left_semi").select(F.col("near").alias("id")).distinct()
    return near.join(changed, "id", "left_anti").join(centrality(new), "id")


def diff_view(old: PropertyGraph, new: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """Nodes of both graphs stamped with their status and a score, and the new graph's edges."""
    marks = diff_nodes(old, new)
    every = new.nodes.unionByName(old.nodes.join(new.nodes, "id", "left_anti"), allowMissingColumns=True)
    return every.join(marks, "id").withColumn("score", F.when(F.col("status") == "unchanged", 0.4).otherwise(1.0)), new.edges
