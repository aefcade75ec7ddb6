"""Property graphs as pairs of DataFrames, and graphs derived from the driver's tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_COLUMNS = ("id", "label", "type", "file_type", "description", "source_file", "source_location")


@dataclass
class PropertyGraph:
    """``nodes`` have at least ``id``; ``edges`` have ``src``, ``dst``, ``relation`` and ``weight``."""

    nodes: DataFrame
    edges: DataFrame

    def induced(self, keep: DataFrame) -> PropertyGraph:
        """The subgraph of the nodes whose ``id`` is in ``keep``."""
        ids = keep.select("id").distinct()
        return PropertyGraph(self.nodes.join(ids, "id", "left_semi"), inside(self.edges, ids))

    def written(self) -> PropertyGraph:
        """The same graph, written to the shared folder: what is asked of it again is not derived again."""
        from weftgraph.plans.materialize import cut

        return PropertyGraph(cut(self.nodes), cut(self.edges))

    def where(self, condition: Column) -> PropertyGraph:
        nodes = self.nodes.where(condition)
        return PropertyGraph(nodes, inside(self.edges, nodes.select("id")))


def inside(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids``."""
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def first_wins(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The first row of each key by ``order``, in one aggregate (no window, partial on the map side)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """One row per key; every attribute takes its last value that is not null."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return rows.groupBy(*keys).agg(*[last(c) for c in rest], F.min(order).alias(order)) if rest else rows.groupBy(*keys).agg(F.min(order).alias(order))


def build(nodes: DataFrame, edges: DataFrame, known: bool = False) -> PropertyGraph:
    """A graph of raw rows with ``ord``: merged by key, and a bare node for every end that has none.

    Where all ends are ``known`` to be nodes, nodes don't depend on edges.
    """
    merged, links = upsert(nodes, ["id"]).drop("ord"), upsert(edges, ["src", "dst"]).drop("ord")
    if known:
        return PropertyGraph(merged, links)
    ends = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(merged, "id", "left_anti")
    return PropertyGraph(merged.unionByName(ends, allowMissingColumns=True), links)


#: Bytes of a table's files that one task of an aggregate takes.
SHARE = 8 << 20


def dealt(table: DataFrame, key: str, *others: str) -> DataFrame:
    """(key, others) of a table, dealt out by ``key`` to tasks of which none takes more when the table grows.

    A task that reads a split, or shuffled blocks that are put together, has up to 128 MB of a
    table's columns, and its aggregates hold a row for each of their groups.
    """
    size = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    parts = max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(str(size)) // SHARE))
    return table.select(key, *others).repartition(parts, key)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers, parts and orders, with links between them."""
    t = lambda n: _read(spark, sf_dir, n)
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))

    def nodes(kind: str, id_: str, label: Column, about: Column) -> DataFrame:
        return t(kind if kind != "order" else "orders").select(key(kind, id_).alias("id"), label.alias("label"), F.lit(kind).alias("type"), about.alias("description"), F.lit(f"schema/{kind}.sql").alias("source_file"))

    every = [
        nodes("region", "r_regionkey", F.col("r_name"), F.lit("")),
        nodes("nation", "n_nationkey", F.col("n_name"), F.lit("")),
        nodes("customer", "c_custkey", F.col("c_name"), F.col("c_mktsegment")),
        nodes("supplier", "s_suppkey", F.col("s_name"), F.lit("")),
        nodes("part", "p_partkey", F.col("p_name"), F.concat_ws(" ", "p_brand", "p_type")),
        nodes("order", "o_orderkey", F.concat(F.lit("Order"), F.col("o_orderkey").cast("string")), F.col("o_orderpriority")),
    ]
    link = lambda df, a, b, rel: df.select(a.alias("src"), b.alias("dst"), F.lit(rel).alias("relation"), F.lit(1.0).alias("weight"))
    lines = t("lineitem")
    links = [
        link(t("nation"), key("nation", "n_nationkey"), key("region", "n_regionkey"), "part_of"),
        link(t("customer"), key("customer", "c_custkey"), key("nation", "c_nationkey"), "located_in"),
        link(t("supplier"), key("supplier", "s_suppkey"), key("nation", "s_nationkey"), "located_in"),
        link(dealt(t("orders"), "o_orderkey", "o_custkey"), key("order", "o_orderkey"), key("customer", "o_custkey"), "placed_by"),
        dealt(lines, "l_orderkey", "l_partkey").groupBy("l_orderkey", "l_partkey").agg(F.count("*").cast("double").alias("weight")).select(key("order", "l_orderkey").alias("src"), key("part", "l_partkey").alias("dst"), F.lit("contains").alias("relation"), "weight"),
        link(dealt(lines, "l_partkey", "l_suppkey").distinct(), key("part", "l_partkey"), key("supplier", "l_suppkey"), "supplied_by"),
    ]
    n, e = every[0], links[0]
    for x in every[1:]:
        n = n.unionByName(x)
    for x in links[1:]:
        e = e.unionByName(x)
    return PropertyGraph(n, e)


def document_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Documents; each is linked to the next of its language and source."""
    from pyspark.sql import Window

    docs = _read(spark, sf_dir, "documents")
    n = docs.select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"),
        F.concat(F.lit("sourceDoc_"), F.col("source")).alias("label"),
        F.col("lang").alias("type"),
        F.when(F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 4 == 0, "code").otherwise("document").alias("file_type"),
        F.col("text").alias("description"),
        F.concat_ws("/", F.lit("corpus"), "source", F.concat(F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("source_file"),
    )
    w = Window.partitionBy("lang", "source").orderBy("doc_id")
    e = docs.select("doc_id", F.lead("doc_id").over(w).alias("next")).where("next is not null").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("src"), F.concat(F.lit("doc:"), F.col("next").cast("string")).alias("dst"), F.lit("precedes").alias("relation"), F.lit(1.0).alias("weight"))
    return PropertyGraph(n, e)


#: The same graphs for the oracle: common table expressions n(ode)s, e(dge)s, and d(ocument node)s, l(inks).
ENTITY_SQL = """
n AS (
  SELECT 'region:' || r_regionkey AS id, r_name AS label, 'region' AS type, '' AS description, 'schema/region.sql' AS source_file FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation', '', 'schema/nation.sql' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'customer', c_mktsegment, 'schema/customer.sql' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier', '', 'schema/supplier.sql' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'part', p_brand || ' ' || p_type, 'schema/part.sql' FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'Order' || o_orderkey, 'order', o_orderpriority, 'schema/order.sql' FROM orders),
e AS (
  SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'part_of' AS relation, 1.0::DOUBLE AS weight FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located_in', 1.0 FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in', 1.0 FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'placed_by', 1.0 FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'contains', count(*)::DOUBLE FROM lineitem GROUP BY ALL
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'supplied_by', 1.0 FROM lineitem)"""

DOCUMENT_SQL = """
d AS (SELECT 'doc:' || doc_id AS id, 'sourceDoc_' || source AS label, lang AS type,
        CASE WHEN regexp_extract(source, '([0-9]+)$', 1)::INT % 4 = 0 THEN 'code' ELSE 'document' END AS file_type,
        text AS description, 'corpus/' || source || '/' || lang || '_' || doc_id || '.txt' AS source_file FROM documents),
l AS (SELECT 'doc:' || doc_id AS src, 'doc:' || nxt AS dst, 'precedes' AS relation, 1.0::DOUBLE AS weight
      FROM (SELECT doc_id, lead(doc_id) OVER (PARTITION BY lang, source ORDER BY doc_id) AS nxt FROM documents) WHERE nxt IS NOT NULL)"""
