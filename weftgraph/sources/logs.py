"""Query logs as JSON lines: appended by runs, read back strictly (audit) or leniently (session)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import savings_percent

AUDIT = "timestamp string, query string, budget int, tokens_used int, nodes_selected int, nodes_total int, graph_path string, top_nodes array<string>"
SESSION = "ts string, query string, budget int, nodes int, tokens int, savings_pct double"


def append(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Every entry; a malformed line is an error, blank ones are skipped."""
    return spark.read.schema(AUDIT).option("mode", "FAILFAST").json(path)


def append_session(spark: SparkSession, path: str, query: str, budget: int, stats: dict, at: str | None = None) -> bool:
    """Appends one entry with its savings, if the folder is there: its presence is the user's consent."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return False
    now = F.lit(at) if at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    used, total = F.lit(int(stats.get("tokens_used", 0))), F.lit(int(stats.get("nodes_total", 0)))
    row = spark.range(1).select(
        now.alias("ts"), F.lit(query).alias("query"), F.lit(budget).alias("budget"), F.lit(int(stats.get("nodes_selected", 0))).alias("nodes"),
        used.alias("tokens"), savings_percent(used, total).alias("savings_pct"),
    )
    append(row.coalesce(1), path)
    return True


#: Where a line stands in a log: writes by age, their parts by number, blocks of a file, rows of a block.
PLACE = ("_age", "_write", "_part", "_file", "_block", "_row")
#: Names that Spark gives the files of one write: number, then an id of the write.
_PART = r"part-(\d+)-([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})[^/]*$"


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value and ``PLACE``) of the lines of a log.

    Tasks finish the files of one write in any order, so these go by number; a write is as old as
    the last of its files. Any other file is a write by itself.
    """
    meta, file = F.col("_metadata"), F.col("_metadata.file_path")
    own = lambda k: F.regexp_extract(file, _PART, k)
    write = F.when(own(2) == "", file).otherwise(F.concat(F.regexp_extract(file, "^(.*/)", 1), own(2)))
    # Of a binary file nothing is read but what is asked for: this lists files.
    files = spark.read.format("binaryFile").load(path).select(file.alias("_file"), write.alias("_write"), F.coalesce(own(1).try_cast("long"), F.lit(0)).alias("_part"), meta.file_modification_time.alias("_at"))
    places = files.withColumn("_age", F.max("_at").over(Window.partitionBy("_write"))).drop("_at")
    lines = spark.read.text(path).select("value", file.alias("_file"), meta.file_block_start.alias("_block"), F.monotonically_increasing_id().alias("_row"))
    # One row a file; a join by file would put all lines of one into a task.
    return lines.join(F.broadcast(places), "_file").select("value", *PLACE)


def read_session(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """Entries of a session log in the order of the log, without malformed lines; with ``last``, the latest ones."""
    rows = parsed_session(log_lines(spark, path))
    if last is not None and last > 0:
        rows = rows.orderBy(*[F.col(c).desc() for c in PLACE]).limit(last)
    return rows.orderBy(*PLACE).drop(*PLACE)


def parsed_session(lines: DataFrame) -> DataFrame:
    """``lines`` (value and others) as entries; what is no JSON object goes, what an entry lacks is null."""
    entries = lines.where(F.json_object_keys("value").isNotNull()).withColumn("e", F.from_json("value", SESSION))
    return entries.select("e.*", *[c for c in lines.columns if c != "value"])
