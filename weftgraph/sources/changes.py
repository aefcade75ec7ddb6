"""What changed in a source tree since the last commit, and which files that touches."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import traverse
from weftgraph.operators.relational import incremental_merge
from weftgraph.plans.graph import PropertyGraph
from weftgraph.sources import code, index

SECONDS = 30
#: Edits, what is staged, and files that git doesn't know yet.
LISTS = (("diff", "--name-only", "--relative", "-z", "HEAD"), ("diff", "--name-only", "--relative", "-z", "--cached"), ("ls-files", "--others", "--exclude-standard", "-z"))


def _git(root: str, *args: str) -> str | None:
    """Output of a git command, null if it fails."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=SECONDS, check=False)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout if done.returncode == 0 else None


def in_git(root: str) -> bool:
    return (_git(root, "rev-parse", "--is-inside-work-tree") or "").strip() == "true"


def changed_files(spark: SparkSession, root: str) -> DataFrame:
    """(source_file): source files below ``root`` that differ from the last commit, deleted ones too."""
    names = {n for args in LISTS for n in (_git(root, *args) or "").split("\0") if n}
    found = spark.createDataFrame([(n,) for n in sorted(names)], "source_file string")
    return found.where(code.wanted(F.col("source_file")))


def referrers(g: PropertyGraph) -> DataFrame:
    """(id, near): from a file to files that refer to it, by edges, or by an import whose label names its module.

    An import names the module with the longest id that the label is, or begins with up to a dot.
    """
    imports = g.nodes.where("type = 'import' and source_file <> ''").select(F.col("source_file").alias("near"), F.replace("label", F.lit("/"), F.lit(".")).alias("label"))
    modules = g.nodes.where("type = 'module' and source_file <> ''").select(F.col("id").alias("module"), F.col("source_file").alias("id"))
    parts = F.split("label", r"\.")
    heads = imports.distinct().select("near", "label", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("module"))
    named = heads.join(modules, "module").groupBy("near", "label").agg(F.max_by("id", F.struct(F.length("module"), "module")).alias("id"))
    return traverse.referrers(g).unionByName(named.where("id <> near").select("id", "near")).distinct()


def to_index_again(g: PropertyGraph, changed: DataFrame, hops: int = 1) -> DataFrame:
    """(source_file, depth): changed files and those that refer to them, within ``hops``."""
    files = changed.select(F.col("source_file").alias("id"))
    return traverse.reach(files, referrers(g), hops).select(F.col("id").alias("source_file"), "depth")


def reindex_changed(old: PropertyGraph, spark: SparkSession, root: str, hops: int = 1) -> PropertyGraph:
    """``old`` with what git says has changed, and what refers to it, parsed anew."""
    again = to_index_again(old, changed_files(spark, root), hops).select("source_file")
    new = index.index_files(code.scan(spark, root).join(again.withColumnRenamed("source_file", "path"), "path", "left_semi"))
    return incremental_merge(old, new, again)
