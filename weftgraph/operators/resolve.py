"""Name resolution by suffixes and prefixes, and interval containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suffixes(dotted: Column) -> Column:
    """All dotted suffixes of a name, itself first."""
    parts = F.split(dotted, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def prefixes(dotted: Column) -> Column:
    """All dotted prefixes of a name, the longest first."""
    parts = F.split(dotted, r"\.")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def suffix_index(ids: DataFrame) -> DataFrame:
    """(suffix, id) of the suffixes that one id alone has."""
    every = ids.select("id").distinct().select("id", F.explode(suffixes(F.col("id"))).alias("suffix"))
    return every.groupBy("suffix").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("suffix", "id")


def resolve_suffix(names: DataFrame, index: DataFrame) -> DataFrame:
    """(key, id): each name's longest suffix that the index holds."""
    tries = names.select("key", F.posexplode(suffixes(F.col("name"))).alias("pos", "suffix"))
    return tries.join(index, "suffix").groupBy("key").agg(F.min_by("id", "pos").alias("id"))


def longest_prefix(names: DataFrame, modules: DataFrame) -> DataFrame:
    """(key, id): the longest prefix of each name that is one of ``modules`` (id)."""
    tries = names.select("key", F.posexplode(prefixes(F.col("name"))).alias("pos", "id"))
    return tries.join(modules.select("id").distinct(), "id").groupBy("key").agg(F.min_by("id", "pos").alias("id"))


def innermost(points: DataFrame, spans: DataFrame, pick: str = "innermost", strict: bool = True) -> DataFrame:
    """(file, at, name): the span of ``spans`` (file, name, start, end) around each of ``points`` (file, at).

    ``pick``: the narrowest (first of equals), or the ``first`` or ``last`` to start. Joined within
    a file by ranges; a file's spans are bounded by its length.
    """
    low = F.col("start") < F.col("at") if strict else F.col("start") <= F.col("at")
    key = {"innermost": F.struct(F.col("end") - F.col("start"), "start", "name"), "first": F.struct("start", "end", "name"), "last": F.struct(-F.col("start"), -F.col("end"), "name")}[pick]
    return points.join(spans, "file").where(low & (F.col("at") < F.col("end"))).groupBy("file", "at").agg(F.min_by("name", key).alias("name"))


def unique_candidate(pending: DataFrame, exports: DataFrame, keys: list[str]) -> DataFrame:
    """(src, id): pooled candidates of each (src, symbol); more than one means none."""
    pooled = pending.join(exports, keys).select("src", "symbol", "id").distinct()
    return pooled.groupBy("src", "symbol").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1 and src <> id").select("src", "symbol", "id")


def packages(symbols: DataFrame) -> DataFrame:
    """(package, dir) of Go-like packages that one directory alone claims; ``main`` can't be imported."""
    pairs = symbols.where("package <> 'main'").select("package", "dir").distinct()
    return pairs.groupBy("package").agg(F.count("*").alias("n"), F.min("dir").alias("dir")).where("n = 1").select("package", "dir")


def running_rank(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """``rows`` (of a bounded report) with their place in ``order``."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)))
