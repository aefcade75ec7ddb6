"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    A private one is only made where none is named and all runs on this machine.
    """
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (named.get() if named.isDefined() else None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="wg-ckpt-")
    if named.isEmpty():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame, dealt: bool = False) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and goes on from there; survives lost executors.

    ``dealt``: how its rows are dealt out and sorted stays known, so joins and groupings by that key need
    no shuffle. An adaptive plan doesn't tell, so this one is planned without.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if not dealt:
        return df.checkpoint()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # A frame keeps the plan that it has once been given: this one is new.
        return df.select("*").checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def dealt_by(df: DataFrame, key: str) -> DataFrame:
    """``df`` written, dealt out by ``key`` and sorted by it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartition(parts, key).sortWithinPartitions(key), dealt=True)


def stored(df: DataFrame, by: str) -> DataFrame:
    """``df`` written as columns, in a folder for each of the few values of ``by``, for those that read some of both."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid4().hex}"
    df.write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
