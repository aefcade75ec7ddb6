"""Continuous runs: session logs as they grow, source folders indexed as files arrive.

A file source sees new files, not bytes added to one: writers leave a file for each flush. Runs
take what is there and end (``once``), or go on until they are stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.plans.graph import PropertyGraph
from weftgraph.sources import code, index
from weftgraph.sources.logs import parsed_session

#: The reader's fixed columns; a stream must name them.
FILES = "path string, modificationTime timestamp, length long, content binary"


def _started(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of a folder of session logs as a stream; malformed lines go."""
    return parsed_session(spark.readStream.text(folder))


def tail_sessions(spark: SparkSession, folder: str, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    return _started(sessions(spark, folder), each, checkpoint, once)


def usage(spark: SparkSession, folder: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Queries and tokens by window of event time; state goes once the watermark has passed it."""
    return sessions(spark, folder).withColumn("at", F.to_timestamp("ts")).withWatermark("at", late).groupBy(F.window("at", window)).agg(F.count("*").alias("queries"), F.sum("tokens").alias("tokens"))


def watch(spark: SparkSession, root: str, each: Callable[[PropertyGraph, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Indexes the whole of ``root`` again whenever files have come."""

    def again(batch: DataFrame, n: int) -> None:
        if not batch.isEmpty():
            each(index.index_project(batch.sparkSession, root), n)

    files = spark.readStream.schema(FILES).format("binaryFile").option("recursiveFileLookup", True).load(root)
    return _started(code.relative(files, root).select("path"), again, checkpoint, once)
