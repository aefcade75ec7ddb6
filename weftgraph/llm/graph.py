"""Connected components of edge lists, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Parts that the links of one node are dealt to.
PARTS = 16


def _meet(links: DataFrame, on: str, other: str, few: DataFrame) -> DataFrame:
    """``links`` with ``m`` of ``few`` (u, m) by ``on``, null if there is none; a node's links are dealt to parts."""
    dealt = links.withColumn("part", F.pmod(F.xxhash64(other), F.lit(PARTS)))
    spread = few.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    return dealt.join(spread, (dealt[on] == spread.u) & (dealt.part == spread.p), "left").select("a", "b", "m")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): each node of ``edges`` (a, b) with the smallest node it reaches.

    Every round moves each node's links to the smallest of its neighbours; edges end as stars
    around their component's smallest node. Only nodes between others are looked up: those with a
    smaller and a larger neighbour, then those with several smaller ones. A star's centre is neither,
    so its links stay where they are, and no task has to hold all links of one node.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        middle = both.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("x")).where("m < a and a < x").select(F.col("a").alias("u"), "m")
        large = _meet(now, "b", "a", middle).select("a", F.coalesce("m", "b").alias("b")).distinct()
        several = large.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("x")).where("m < x").select(F.col("a").alias("u"), "m")
        joined = _meet(large, "a", "b", several).withColumn("m", F.coalesce("m", "b"))
        small = joined.select(F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("e")).where("e.x <> e.m")
        now = cut(small.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # Every node but a component's smallest has one edge by now: to that.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
