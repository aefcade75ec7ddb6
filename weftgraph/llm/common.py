"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


#: Spark's estimate for a size that it does not know.
UNKNOWN_SIZE = (1 << 63) - 1


def cut(df: DataFrame) -> DataFrame:
    """Materialises an intermediate in the shared checkpoint folder and cuts its lineage.

    A checkpoint keeps the estimate of its size, and a join's is the product of its sides': over
    rounds of joins the number itself fills the driver. Beyond that of an unknown size it says
    nothing, so there it is dropped.
    """
    shared_folder(df.sparkSession)
    kept = df.checkpoint()
    spark, plan = kept.sparkSession, kept._jdf.queryExecution().analyzed()
    if plan.stats().sizeInBytes() <= UNKNOWN_SIZE:
        return kept
    jvm = spark.sparkContext._jvm
    none = jvm.scala.Option.empty()
    plan = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), spark._jsparkSession, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def smallest_hashes(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The ``rows`` rows of ``df`` with the smallest hashes of ``key``.

    A bound on the hash, from the number of rows, leaves about twice as many before they are
    sorted: what tasks send on doesn't grow with their number.
    """
    span = 1 << 30
    h = F.pmod(F.xxhash64(key), F.lit(span))
    n = df.count()
    few = df if n <= 2 * rows else df.where(h < F.lit(2 * rows * span // n))
    return few.orderBy(h, key).limit(rows)


#: Bytes of texts that a task turns into Python's objects at a time.
PART_BYTES = 1_000_000


def text_parts(batches: Iterator[pa.RecordBatch], size: int = PART_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of ``batches``, in order, and the texts of each: about ``size`` bytes of them, or one longer text.

    What a worker holds beside an Arrow batch doesn't grow with the batch.
    """
    for b in batches:
        if not b.num_rows:
            continue
        texts = b.column(b.schema.get_field_index("text")).cast(pa.string())
        length = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(length) - length) // size
        cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
        for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            yield b.slice(x, y - x), texts.slice(x, y - x).to_pylist()


def release() -> None:
    """Gives freed memory back to the system: a worker that waits for its next task shares its machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words of a text, inside code generation; null gives 0."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def whole_number(name: str) -> Column:
    return F.col(name).cast("long").alias(name)
