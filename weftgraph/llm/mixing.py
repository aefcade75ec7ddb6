"""Mixing sources to target weights along a time-varying curriculum.

Each source follows a weight curve over training time t in [0, 1], piecewise linear between
knots; its integral is the source's weight. Targets share a token budget by weight, capped at a
multiple of what a source holds; the excess is shared again until no source is above its cap.
The stream of a source is its documents in a fixed pseudo-random order, begun again when it is
used up; an occurrence of a document gets the time at which the source's cumulative demand
reaches the middle of it, found by inverting the integrated curve. A range sort by that time
gives the training order.

Prefix sums are distributed: documents fall into cells (source, slice of the hash order) of
bounded mean size; a cell that many rows of one id have made large is split by a number of the row.
Cells are summed first, then blocks of ``BLOCK_CELLS`` cells; the running sums of blocks meet by
source, those of cells by block. One row per source meets in one task, to rank the sources.

Defined cases: a null or blank text has size 0 and is never taken; a null ``source`` is a source
of its own, last in order; a null ``doc_id`` hashes as the empty string; equal rows are documents
of their own; an empty table gives an empty result; other columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, word_count

Curve = Sequence[tuple[float, float]]

#: Weights 5, 2 and 1 by their integrals: early emphasis, then late, then flat.
CURVES: tuple[Curve, ...] = (((0.0, 6.5), (1.0, 3.5)), ((0.0, 1.0), (0.5, 2.0), (1.0, 3.0)), ((0.0, 1.0), (1.0, 1.0)))
#: Mean number of documents in a cell of a source's order.
CELL_ROWS = 4000
#: Cells of a block; times the mean from which on a cell is split.
BLOCK_CELLS, HEAVY = 4096, 8


def integral(curve: Curve) -> float:
    return sum((t2 - t1) * (v1 + v2) / 2 for (t1, v1), (t2, v2) in zip(curve, curve[1:]))


def inverse(curve: Curve, share: Column) -> Column:
    """The time at which the integrated curve reaches ``share`` (0 to 1) of its whole."""
    whole, done, out = integral(curve), 0.0, None
    for (t1, v1), (t2, v2) in zip(curve, curve[1:]):
        area = (t2 - t1) * (v1 + v2) / 2
        rest, slope = share * whole - F.lit(done), (v2 - v1) / (t2 - t1)
        # v1*x + slope*x^2/2 = rest, in the form that stays exact as slope goes to 0.
        x = 2 * rest / (v1 + F.sqrt(F.greatest(F.lit(0.0), v1 * v1 + 2 * slope * rest)))
        at = F.least(F.lit(t2), F.lit(t1) + F.greatest(F.lit(0.0), x))
        done += area
        out = F.when(share * whole <= done, at) if out is None else out.when(share * whole <= done, at)
    return out.otherwise(F.lit(float(curve[-1][0])))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``sizes`` (source, size of the whole source) with its curve's number and its target.

    Sources in order of cap per weight: the capped ones are a prefix, so one running sum settles
    the repeated sharing. One row per source meets in one task, whatever the number of documents.
    """
    one = Window.orderBy(F.col("source").isNull(), "source")
    by = Window.orderBy("ratio", "rank")
    before, after, all_ = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("curve") + 1).cast("int"))
    return (
        sizes.withColumn("rank", F.row_number().over(one))
        .withColumn("curve", (F.col("rank") - 1) % len(weights))
        .withColumn("w", w)
        .withColumn("limit", F.col("source_size") * cap)
        .withColumn("ratio", F.col("limit") / F.col("w"))
        .withColumn("budget", F.sum("source_size").over(all_) * share)
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("rest_w", F.sum("w").over(after))
        .withColumn("capped", F.col("limit") * F.col("rest_w") <= F.col("left") * F.col("w"))
        .withColumn("free", F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("limit"))).over(all_), F.lit(0.0)))
        .withColumn("free_w", F.sum(F.when(~F.col("capped"), F.col("w"))).over(all_))
        .withColumn("target", F.when(F.col("capped"), F.col("limit")).otherwise(F.col("free") * F.col("w") / F.col("free_w")))
        .select("source", "source_size", "curve", "target")
    )


def mix(docs: DataFrame, size: Column, share: float = 1.5, cap: float = 2.0, curves: Sequence[Curve] = CURVES, whole: bool = False, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``docs`` with ``__wg_source_size``, ``__wg_target``, ``__wg_taken`` and ``__wg_at``.

    ``__wg_at`` holds the times of the document's occurrences. A source takes exactly its target,
    rounded to one word, the last document in part; with ``whole``, a document is taken if the
    middle of it lies before the target.
    """
    base = (
        docs.withColumn("__wg_size", size)
        .withColumn("__wg_sk", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")))
        .withColumn("__wg_h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    )
    n = max(1, -(-docs.count() // cell_rows))
    cell = F.floor(F.conv(F.substring("__wg_h", 1, 7), 16, 10).cast("long") * F.lit(n) / F.lit(1 << 28)).cast("int")
    # Only what can't be told apart by its hash is told apart by a number of the row: equal rows may
    # change places, which changes no result.
    placed = base.withColumn("__wg_cell", cell)
    first = placed.groupBy("__wg_sk", "__wg_cell").agg(F.count("*").alias("rows"))
    heavy = cut(first.where(F.col("rows") > HEAVY * cell_rows).select("__wg_sk", "__wg_cell", F.ceil(F.col("rows") / cell_rows).alias("__wg_parts")))
    # At most rows / (HEAVY * cell_rows) of them; without any, nothing is joined.
    if heavy.isEmpty():
        placed = placed.withColumn("__wg_part", F.lit(0).cast("long")).withColumn("__wg_first", F.lit(0).cast("long"))
    else:
        # A row's number has to be the same whenever it is read, so it is written.
        number = F.pmod(F.xxhash64(F.monotonically_increasing_id(), "__wg_size"), F.lit(1 << 20))
        placed = cut(placed.withColumn("__wg_y", number)).join(heavy, ["__wg_sk", "__wg_cell"], "left")
        placed = placed.withColumn("__wg_part", F.coalesce(F.floor(F.col("__wg_y") * F.col("__wg_parts") / F.lit(1 << 20)), F.lit(0)))
        placed = placed.withColumn("__wg_first", F.when(F.col("__wg_parts").isNull(), F.lit(0)).otherwise(F.col("__wg_y"))).drop("__wg_parts")
    where = ["__wg_sk", "__wg_cell", "__wg_part"]
    cells = cut(placed.groupBy(*where).agg(F.first("source").cast("string").alias("source"), F.sum("__wg_size").alias("n")))
    per = targets(cells.groupBy("__wg_sk").agg(F.first("source").alias("source"), F.sum("n").cast("long").alias("source_size")).drop("__wg_sk"), [integral(c) for c in curves], share, cap)
    per = per.withColumn("sk", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    # Running sums: of blocks by source, of cells by block.
    before = lambda by, order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("block", F.floor(F.col("__wg_cell") / BLOCK_CELLS))
    blocks = cells.groupBy("__wg_sk", "block").agg(F.sum("n").alias("n")).withColumn("upto", F.coalesce(F.sum("n").over(before(["__wg_sk"], ["block"])), F.lit(0))).drop("n")
    offsets = (
        cells.join(blocks, ["__wg_sk", "block"])
        .withColumn("__wg_from", F.col("upto") + F.coalesce(F.sum("n").over(before(["__wg_sk", "block"], ["__wg_cell", "__wg_part"])), F.lit(0)))
        .join(per, F.col("__wg_sk") == F.col("sk"))
        .select(*where, "__wg_from", F.col("source_size").alias("__wg_source_size"), F.col("target").alias("__wg_target"), F.col("curve").alias("__wg_curve"))
    )
    inside = Window.partitionBy(*where).orderBy("__wg_first", "__wg_h", "doc_id", "__wg_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        placed.join(offsets, where)
        .withColumn("__wg_from", F.col("__wg_from") + F.sum("__wg_size").over(inside) - F.col("__wg_size"))
        .withColumn("__wg_goal", F.floor(F.col("__wg_target") + 0.5).cast("long"))
    )
    rounds = F.array(*[F.lit(k) for k in range(max(1, -int(-cap // 1)))])

    def took(k: Column) -> Column:
        left = F.col("__wg_goal") - (F.col("__wg_from") + k * F.col("__wg_source_size"))
        if whole:
            return F.when(2 * left > F.col("__wg_size"), F.col("__wg_size")).otherwise(F.lit(0))
        return F.greatest(F.lit(0), F.least(F.col("__wg_size"), left))

    uses = F.filter(F.transform(rounds, lambda k: F.struct(took(k).alias("n"), (F.col("__wg_from") + k * F.col("__wg_source_size") + took(k) / 2).alias("mid"))), lambda u: u.n > 0)

    def when(mid: Column) -> Column:
        share_ = F.least(F.lit(1.0), mid / F.col("__wg_target"))
        out = F.when(F.col("__wg_curve") == 0, inverse(curves[0], share_))
        for i, c in enumerate(curves[1:], 1):
            out = out.when(F.col("__wg_curve") == i, inverse(c, share_))
        return out

    return (
        placed.withColumn("__wg_uses", uses)
        .withColumn("__wg_taken", F.aggregate("__wg_uses", F.lit(0).cast("long"), lambda a, u: a + u.n))
        .withColumn("__wg_at", F.transform("__wg_uses", lambda u: when(u.mid)))
        .select(*[F.col(f"`{c}`") for c in docs.columns], "__wg_size", "__wg_source_size", "__wg_target", "__wg_taken", "__wg_at")
    )


def training_order(docs: DataFrame, **params) -> DataFrame:
    """Whole documents in training order, repeated as often as the mix takes them; columns as given."""
    # The stream of columns carries the text: its key is not unique where rows repeat.
    mixed = mix(docs, word_count(F.col("text")), whole=True, **params)
    return (
        mixed.withColumn("__wg_t", F.explode("__wg_at"))
        .orderBy("__wg_t", "doc_id")
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    mixed = mix(sized, F.col("size"))
    return mixed.select(
        "doc_id",
        "size",
        F.col("__wg_source_size").alias("source_size"),
        F.col("__wg_target").alias("target"),
        F.col("__wg_taken").alias("taken"),
        F.round(F.element_at(F.col("__wg_at"), F.when(F.size("__wg_at") > 0, F.lit(1))), 9).alias("position"),
    ).orderBy("position", "doc_id")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM s),
w AS (SELECT *, [5.0, 2.0, 1.0][((rank - 1) % 3 + 1)::INT]::DOUBLE AS w, (rank - 1) % 3 AS curve, source_size * 2.0::DOUBLE AS lim, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM r),
p AS (SELECT *, budget - coalesce(sum(lim) OVER (ORDER BY lim / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
        sum(w) OVER (ORDER BY lim / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM w),
c AS (SELECT *, lim * rest_w <= lft * w AS capped FROM p),
t AS (SELECT source, source_size, curve, CASE WHEN capped THEN lim ELSE
        (budget - coalesce(sum(lim) FILTER (capped) OVER (), 0)) * w / (sum(w) FILTER (NOT capped) OVER ()) END AS target FROM c),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.curve, floor(t.target + 0.5)::BIGINT AS goal,
        (sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS pos0
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, greatest(0, least(size, goal - pos0)) AS k1, greatest(0, least(size, goal - pos0 - source_size)) AS k2 FROM o),
f AS (SELECT *, least(1.0, (pos0 + k1 / 2.0::DOUBLE) / target)::DOUBLE AS x FROM k)
SELECT doc_id, size, source_size, target, (k1 + k2)::BIGINT AS taken,
  round(CASE WHEN k1 = 0 THEN NULL
    WHEN curve = 0 THEN 2 * 5 * x / (6.5 + sqrt(greatest(0.0, 6.5 * 6.5 - 6 * 5 * x)))
    WHEN curve = 1 THEN 2 * 2 * x / (1 + sqrt(1 + 4 * 2 * x))
    ELSE x END, 9)::DOUBLE AS position
FROM f"""
