"""Source trees: which files count, and the block of code that a node stands for."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text as X

#: Folders that no scan enters (and any that ends in .egg-info), and suffixes with a parser.
SKIPPED = (".git", "__pycache__", "node_modules", ".venv", "venv", "dist", "build", ".mypy_cache", ".ruff_cache", ".pytest_cache", "coverage", ".tox", ".eggs", "vendor")
LANGUAGES = {
    "python": (".py",), "typescript": (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), "go": (".go",), "java": (".java",), "rust": (".rs",), "csharp": (".cs",), "ruby": (".rb",), "php": (".php",),
    "kotlin": (".kt", ".kts"), "scala": (".scala",), "swift": (".swift",), "c": (".c", ".h"), "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"), "lua": (".lua",), "elixir": (".ex", ".exs"), "powershell": (".ps1", ".psm1"),
}
BRACED = (".ts", ".tsx", ".js", ".jsx", ".go")
MAX_LINES, MAX_NODES = 100, 30


def language(path: str) -> str | None:
    return next((k for k, suffixes in LANGUAGES.items() if path.lower().endswith(suffixes)), None)


def wanted(path: Column) -> Column:
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1))
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    every = [s for suffixes in LANGUAGES.values() for s in suffixes]
    return suffix.isin(every) & ~F.arrays_overlap(folders, F.array(*[F.lit(s) for s in SKIPPED])) & ~F.exists(folders, lambda f: f.endswith(".egg-info"))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to ``root``, content) of the source files below it; links are not followed out of it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return relative(files, root)


def relative(files: DataFrame, root: str) -> DataFrame:
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    path = F.substring(F.col("path"), F.instr(F.col("path"), F.lit(base)) + len(base), F.length("path"))
    return files.select(path.alias("path"), F.decode("content", "utf-8").alias("content")).where(wanted(F.col("path")))


def block(content: str | None, line: int | None, braced: bool, most: int = MAX_LINES) -> str | None:
    """The block that starts at a line: up to the balance of its braces, or while lines are indented below it."""
    lines = (content or "").splitlines()
    if line is None or not 0 < line <= len(lines):
        return None
    part = [x.rstrip() for x in lines[line - 1 : line - 1 + most]]
    if braced:
        depth = 0
        for n, x in enumerate(part, 1):
            depth += x.count("{") - x.count("}")
            if depth == 0 and "{" in "".join(part[:n]):
                return "\n".join(part[:n])
        return "\n".join(part)
    if not part[0]:
        return None
    indent = lambda x: len(x) - len(x.lstrip())
    end = next((n for n, x in enumerate(part[1:], 1) if x and indent(x) <= indent(part[0])), len(part))
    return "\n".join(part[:end]).rstrip("\n")


def with_code(nodes: DataFrame, files: DataFrame, most_nodes: int = MAX_NODES) -> DataFrame:
    """``nodes`` with ``code_block``, for selections of up to ``most_nodes`` (larger ones get none)."""
    if len(nodes.limit(most_nodes + 1).select("id").take(most_nodes + 1)) > most_nodes:
        return nodes.withColumn("code_block", F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def cut_out(content: pd.Series, line: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([block(c, None if pd.isna(n) else int(n), str(p).lower().endswith(BRACED)) for c, n, p in zip(content, line, path)], dtype=object)

    content = files.select(F.col("path").alias("source_file"), "content")
    return nodes.join(content, "source_file", "left").withColumn("code_block", F.when(F.col("content").isNotNull(), cut_out("content", X.line_of(F.col("source_location")), "source_file"))).drop("content")


def each_file(files: DataFrame, rows_of, schema: str) -> DataFrame:
    """Rows that ``rows_of(path, content)`` makes of each file, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            rows: list[tuple] = []
            for path, content in zip(b["path"], b["content"]):
                rows += rows_of(path, content or "")
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)
