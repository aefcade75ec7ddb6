"""Bounded breadth-first search and what is built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.operators.relational import neighbours
from weftgraph.plans.graph import PropertyGraph
from weftgraph.plans.materialize import cut

#: Hops that stay one lazy plan; further ones cut its lineage.
LAZY_HOPS = 3


def reach(seeds: DataFrame, steps: DataFrame, hops: int) -> DataFrame:
    """(id, depth): what ``seeds`` (id) reach over ``steps`` (id, near) within ``hops``, seeds at 0.

    A frontier is joined with the steps and rid of what has been seen: every node is expanded
    once, cycles end by themselves.
    """
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in range(1, hops + 1):
        found = frontier.select("id").join(steps, "id").select(F.col("near").alias("id")).distinct()
        frontier = found.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth))
        if hops > LAZY_HOPS:
            frontier = cut(frontier)
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
    return seen


def around(g: PropertyGraph, seeds: DataFrame, hops: int) -> DataFrame:
    return reach(seeds, neighbours(g.edges), hops)


def callers(g: PropertyGraph) -> DataFrame:
    """(id, near): from a node to what depends on it; containers are no dependents."""
    return g.edges.where("relation <> 'contains'").select(F.col("dst").alias("id"), F.col("src").alias("near")).distinct()


def affected(g: PropertyGraph, changed: DataFrame, hops: int) -> PropertyGraph:
    """The subgraph within ``hops`` of the changed ids that are in the graph."""
    return g.induced(around(g, changed.join(g.nodes, "id", "left_semi"), hops))


def nodes_in_file(g: PropertyGraph, path: str) -> DataFrame:
    """Nodes of a file: those with exactly this path, else those whose path ends in it."""
    want = X.normal_path(F.lit(path))
    own = X.normal_path(F.coalesce("source_file", F.lit("")))
    hits = g.nodes.withColumn("exact", own == want).where(F.col("exact") | own.endswith(F.concat(F.lit("/"), want)))
    return hits.withColumn("any_exact", F.bool_or("exact").over(Window.partitionBy())).where("exact or not any_exact").drop("exact", "any_exact")


def impact(g: PropertyGraph, owned: DataFrame, hops: int = 2) -> DataFrame:
    """(id, kind): nodes of the file (``owned``), its direct and transitive dependents, and safe nodes (nothing calls them)."""
    ids = owned.select("id").distinct()
    back = callers(g)
    outside = back.join(ids.withColumnRenamed("id", "near"), "near", "left_anti").select("id", "near")
    levels = reach(ids, outside, hops)
    safe = ids.join(back.select("id").distinct(), "id", "left_anti")
    return (
        levels.select("id", F.when(F.col("depth") == 0, "owned").when(F.col("depth") == 1, "direct").otherwise("transitive").alias("kind"))
        .unionByName(safe.withColumn("kind", F.lit("safe")))
    )


def impact_summary(g: PropertyGraph, found: DataFrame) -> DataFrame:
    """One row: counts, share of the graph, risk and advice."""
    n = lambda k: F.count_if(F.col("kind") == k)
    total = g.nodes.agg(F.count("*").alias("total"))
    return (
        found.agg(n("owned").alias("owned"), n("direct").alias("direct"), n("transitive").alias("transitive"), n("safe").alias("safe"))
        .join(F.broadcast(total))
        .withColumn("impact_score", F.round((F.col("direct") + F.col("transitive")) / F.greatest("total", F.lit(1)), 4))
        .withColumn("risk", X.risk(F.col("direct")))
        .withColumn("advice", X.edit_advice(F.col("risk"), F.col("direct"), F.col("owned")))
    )


def impact_files(g: PropertyGraph, found: DataFrame, path: str, n: int = 10) -> DataFrame:
    """Files of the dependents with their counts, the most first."""
    hits = found.where("kind in ('direct', 'transitive')").join(g.nodes, "id").where("source_file <> ''")
    other = hits.where(X.normal_path(F.col("source_file")) != X.normal_path(F.lit(path)))
    return other.groupBy("source_file").agg(F.count("*").alias("dependents")).orderBy(F.desc("dependents"), "source_file").limit(n)


def highest_risk(g: PropertyGraph, owned: DataFrame) -> DataFrame:
    """Of a file's nodes the one with most dependents outside it; definitions before the file's own node."""
    ids = owned.select("id")
    outside = callers(g).join(ids, "id", "left_semi").join(ids.withColumnRenamed("id", "near"), "near", "left_anti").groupBy("id").agg(F.count("*").alias("dependents"))
    rows = owned.join(outside, "id", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0)))
    rows = rows.withColumn("is_file", X.is_file_node(F.col("type"), F.col("label"), F.col("source_file")))
    return rows.orderBy("is_file", F.desc("dependents"), F.length("id"), "id").limit(1).select("id", "dependents")


def frontier(g: PropertyGraph, selected: DataFrame, hops: int = 2, skip: tuple[str, ...] = ("import",)) -> DataFrame:
    """Nodes within ``hops`` of the selection and not in it; types in ``skip`` are walked through but not returned."""
    near = around(g, selected, hops).where("depth > 0")
    return near.join(g.nodes.where(~F.coalesce(F.col("type").isin(*skip), F.lit(False))), "id", "left_semi").select("id", "depth")


def referrers(g: PropertyGraph) -> DataFrame:
    """(id, near): from a file to the files that import from it or contain what is in it."""
    file = lambda c, p: g.nodes.where("source_file <> ''").select(F.col("id").alias(c), F.col("source_file").alias(p))
    links = g.edges.where("relation in ('imports_from', 'contains')").join(file("src", "near"), "src").join(file("dst", "id"), "dst")
    return links.select("id", "near").where("id <> near").distinct()


def expand_dependencies(g: PropertyGraph, files: DataFrame, hops: int) -> DataFrame:
    """Files (id, depth) to be indexed again when ``files`` (id) change."""
    return reach(files, referrers(g), hops)
