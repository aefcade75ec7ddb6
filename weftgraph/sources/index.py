"""A graph of a source tree: files are parsed one by one, all that crosses files is joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.operators.relational import apply_ignore, incremental_merge, parse_ignore
from weftgraph.operators.resolve import resolve_suffix, suffixes
from weftgraph.plans.graph import PropertyGraph, first_wins, inside
from weftgraph.plans.materialize import cut, stored
from weftgraph.sources import code, parsers

PARSED = "kind string, a string, b string, c string, n long, path string"


def _rows(path: str, content: str) -> list[tuple]:
    head, dot, _ = path.rpartition(".")
    module = (head if dot else path).replace("-", "_").replace(" ", "_").replace("/", ".")
    nodes, edges = parsers.parse(path, content, module)
    rows = [("node", *n, path) for n in nodes]
    rows += [("edge", s, d, f"{relation}\n{symbol or ''}", i, path) for i, (s, d, relation, symbol) in enumerate(edges)]
    return rows + [("export", id_, name, None, 0, path) for id_, name in parsers.exported(path, module, nodes)]


def _exported(id_: Column, path: Column) -> Column:
    """The dotted name by which other files call a symbol: of Go its folder's, of TS and Rust without index files."""
    file = X.file_id(path)
    folder = F.replace(F.regexp_replace(path, "/?[^/]*$", ""), F.lit("/"), F.lit("."))
    own = F.substring(id_, F.length(file) + 1, F.length(id_))
    plain = F.regexp_replace(F.concat(file, own), r"\.(index|mod|lib|main|__init__)(?=\.)", "")
    return F.when(path.endswith(".go"), F.concat(folder, own)).otherwise(plain)


def _chosen(waiting: DataFrame, parsed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, id, relation, weight) of calls with choices: the first group that is found, if one symbol alone answers."""
    named = parsed.where("kind = 'export'").select(F.col("a").alias("id"), F.col("b").alias("name")).distinct()
    named = named.join(nodes.select("id"), "id", "left_semi")
    groups = waiting.select("src", "symbol", "relation", "weight", F.posexplode(F.split(F.expr("substr(symbol, 2)"), ";")).alias("place", "group"))
    names = groups.withColumn("name", F.explode(F.split("group", ","))).drop("group")
    keys = ["src", "symbol", "relation", "weight"]
    # Least and greatest id say whether there is one, without a list of all.
    pooled = names.join(named, "name").groupBy(*keys, "place").agg(F.min("id").alias("id"), F.max("id").alias("most"))
    first = pooled.groupBy(*keys).agg(F.min_by(F.struct("id", "most"), "place").alias("it"))
    return first.where("it.id = it.most").select("src", F.col("it.id").alias("id"), "relation", "weight")


def assemble(parsed: DataFrame, ignore: list[str] | None = None) -> PropertyGraph:
    """The graph of parsed rows: first definition of an id, ignored nodes out, calls resolved across files."""
    nodes = parsed.where("kind = 'node'").select(F.col("a").alias("id"), F.col("b").alias("label"), F.col("c").alias("type"), F.lit("code").alias("file_type"), F.when(F.col("c") == "module", F.concat(F.lit("Source file "), F.col("path"))).otherwise("").alias("description"), F.col("path").alias("source_file"), F.concat(F.lit("L"), F.col("n").cast("string")).alias("source_location"), F.struct("path", "n").alias("ord"))
    split = F.split("c", "\n")
    edges = parsed.where("kind = 'edge'").select(F.col("a").alias("src"), F.col("b").alias("dst"), split[0].alias("relation"), F.nullif(split[1], F.lit("")).alias("symbol"), F.lit(1.0).alias("weight"), F.struct("path", "n").alias("ord"))
    g = PropertyGraph(cut(first_wins(nodes, ["id"])), edges)
    if ignore:
        g = apply_ignore(g, parse_ignore(ignore))
    direct, waiting = g.edges.where("symbol is null"), g.edges.where("symbol is not null and symbol not like '=%'")
    chosen = _chosen(g.edges.where("symbol like '=%'"), parsed, g.nodes)
    exports = g.nodes.where(F.col("type").isin(sorted(parsers.CALLABLE))).select("id", _exported(F.col("id"), F.col("source_file")).alias("name"))
    # A name that two symbols answer to resolves to none; one part alone names no module.
    claims = exports.select("id", F.explode(suffixes(F.col("name"))).alias("suffix")).where("instr(suffix, '.') > 0")
    index = claims.groupBy("suffix").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("suffix", "id")
    wanted = waiting.withColumn("key", F.concat_ws("\n", "src", "symbol"))
    found = resolve_suffix(wanted.select("key", F.col("symbol").alias("name")).distinct(), index)
    suffixed = wanted.join(found, "key").select("src", "id", "relation", "weight")
    last = F.struct(F.lit("~").alias("path"), F.lit(0).cast("long").alias("n")).alias("ord")
    crossing = suffixed.unionByName(chosen).where("src <> id").select("src", F.col("id").alias("dst"), "relation", "weight", last)
    every = direct.drop("symbol").unionByName(crossing)
    return PropertyGraph(g.nodes.drop("ord"), first_wins(inside(every, g.nodes.select("id")), ["src", "dst"]))


def index_files(files: DataFrame, ignore: list[str] | None = None) -> PropertyGraph:
    """The graph of ``files`` (path, content)."""
    return assemble(stored(code.each_file(files, _rows, PARSED), "kind"), ignore)


def index_project(spark: SparkSession, root: str, ignore: list[str] | None = None) -> PropertyGraph:
    return index_files(code.scan(spark, root), ignore)


def reindex(old: PropertyGraph, files: DataFrame, changed: DataFrame) -> PropertyGraph:
    """``old`` with the files of ``changed`` (source_file) parsed anew from ``files``; removed files just go."""
    new = index_files(files.join(changed.withColumnRenamed("source_file", "path"), "path", "left_semi"))
    return incremental_merge(old, new, changed)


def parser_summary(files: DataFrame) -> DataFrame:
    """(language, files) of the languages present."""
    suffixes = [(s, k) for k, v in code.LANGUAGES.items() for s in v]
    names = F.create_map(*[F.lit(x) for kv in suffixes for x in kv])
    return files.select(names[F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))].alias("language")).where("language is not null").groupBy("language").agg(F.count("*").alias("files"))
