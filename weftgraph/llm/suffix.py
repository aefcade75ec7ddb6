"""Removal of repeated byte strings, by distributed prefix doubling over a sparse set of positions.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document with
a smaller id, or earlier in the same one.

Positions are ranked in three rounds, at growing offsets; in each, Spark sorts the ranks, and what
is unique is dropped, until the threshold is reached:

1. 25 bytes, at anchors. The anchor of a string is the leftmost of its ``GRAM``-byte grams with the
   smallest hash, so equal strings have equal anchors, and the strings of neighbouring starts mostly
   share one: about one position in thirty is an anchor. A unique gram rules out all its strings.
   Anchors with equal surroundings (all strings that hang on them) repeat each other as a whole: all
   but the first go. On go the first ones of grams with more than one kind of surroundings.
2. 63 bytes: the gram with the 38 bytes after it, for the starts that reach that far, with the 38
   bytes before it for the others. What is unique is dropped.
3. 100 bytes, at every start that is left: the pair of the rank at the start and the rank 50 bytes on.
   All but the first of equal pairs go.

What is equal within a batch of texts is put together before it is dealt out, so an equal string
is one row for each batch, not for each document. Grams that are frequent in different surroundings
(found in a bounded sample; that only chooses where rows are dealt to) are dealt by gram and
surroundings and pass round 1 unasked. No round gathers the positions of a gram in one task.

Ranks are hashes. Surroundings are equal where their gram's 64-bit hash and a 64-bit hash to another
base are; strings where the hashes of both halves are. Bytes are not compared again.

Defined cases: a null text is empty; texts below ``LENGTH`` bytes lose nothing; a null ``doc_id``
comes first; rows with one ``doc_id`` and different texts are documents in the order of a hash of
their texts; equal rows are one document and get equal values; an empty table gives an empty
result; other columns are ignored. Texts may have any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

LENGTH, GRAM = 100, 25
#: Bytes beside a gram in the second round; a start reaches as far on one side of it.
BESIDE = (LENGTH - GRAM + 1) // 2
HALF = LENGTH // 2
#: Bytes hashed together; of a gram's hash the upper ``_BITS`` bits choose the anchor, the others number positions.
CHUNK_BYTES, _BITS = 2_000_000, 40
#: Bytes from which a text is cut into pieces that share ``LENGTH - 1`` bytes, so that each string is in one of them.
PIECE_BYTES = 2_000_000
#: Bytes of texts whose equal strings are put together before they are dealt out.
TOGETHER_BYTES = 16_000_000
#: Strings hashed together in the later rounds.
ROWS_AT_ONCE = 12_000
#: Documents of the sample that frequent grams are found in, least number of their surroundings there, and most grams.
SAMPLE_ROWS, HOT_COUNT, HOT_MOST = 20_000, 20, 100_000
_BASES = np.array([0x9E3779B97F4A7C55, 0xC2B2AE3D27D4EB4F], np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(h: np.ndarray, by: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(by)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, to ``n`` at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        n = max(n, CHUNK_BYTES + 1)
        both = (_BASES[base], np.uint64(pow(int(_BASES[base]), -1, 1 << 64)))
        _powers[base] = tuple(np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, b, np.uint64))]) for b in both)
    return _powers[base]


class Hashes:
    """Of all strings of a buffer, from one running sum, to one of two bases."""

    def __init__(self, data: np.ndarray, base: int = 0):
        up, self.down = _power(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def grams(self, n: int) -> np.ndarray:
        k = len(self.sums) - n
        return (self.sums[n:] - self.sums[:k]) * self.down[:k]


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int, bytes]]:
    """(text, where it begins in the text, bytes) of the pieces of texts; their strings are those of the texts, each once."""
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(data) - LENGTH + 1), PIECE_BYTES - LENGTH + 1):
            yield i, at, data[at : at + PIECE_BYTES]


def _chunks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text of each piece, where the piece begins in it, the pieces' bytes together, where each begins and the last ends)."""
    held, size = [], 0

    def together() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        own, at, parts = zip(*held)
        return np.array(own), np.array(at), np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    for piece in _pieces(texts):
        held.append(piece)
        size += len(piece[2])
        if size >= CHUNK_BYTES:
            yield together()
            held, size = [], 0
    if held:
        yield together()


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from minima to the left and right of block bounds."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of starts that share an anchor: (text, first start, last start, anchor, gram, surroundings), places within the text."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none, none
    width = LENGTH - GRAM + 1
    grams = _mix(Hashes(data).grams(GRAM), 0xD6E8FEB86659FD93)
    low_bits = np.uint64((1 << 64 - _BITS) - 1)
    at = (_lowest((grams & ~low_bits) | np.arange(len(grams), dtype=np.uint64), width) & low_bits).astype(np.int64)
    starts = np.arange(len(at))
    text = np.searchsorted(bounds, starts, "right") - 1
    valid = starts + LENGTH <= bounds[text + 1]
    starts, text, at = starts[valid], text[valid], at[valid]
    if not len(starts):
        return none, none, none, none, none, none
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(starts) - 1]])
    lo, hi, anchor, own = starts[first], starts[last], at[first], text[first]
    around = _mix(Hashes(data, 1).of(lo, hi + LENGTH), 0xA0761D6478BD642F) + _mix(((anchor - lo) * 1024 + (hi - lo)).astype(np.uint64), 0xE7037ED1A0B428DB)
    begin = bounds[own]
    return own, lo - begin, hi - begin, anchor - begin, grams[anchor].view(np.int64), around.view(np.int64)


# A run of starts, its first and its length, is packed into a number. As a mark (what repeats) a run
# has up to 4096 starts; with its anchor, up to 128.

def _marks(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (lo << 12) | (n - 1)


def _merged(ids: np.ndarray, versions: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, version, mark) of runs, neighbours of one text put together as far as a mark goes."""
    order = np.lexsort((lo, versions, ids))
    ids, versions, lo, n = ids[order], versions[order], lo[order], n[order]
    if not len(ids):
        return ids, versions, lo
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (versions[1:] != versions[:-1]) | (lo[1:] != (lo + n)[:-1])])
    first = np.flatnonzero(new)
    size = np.add.reduceat(n, first)
    parts = -(-size // 4096)
    at = np.repeat(first, parts)
    step = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * 4096
    return ids[at], versions[at], _marks(lo[at] + step, np.minimum(4096, np.repeat(size, parts) - step))


def _first_of(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Which of the rows in ``order`` differ from the one before them."""
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    return new


def _alone(*columns: np.ndarray) -> np.ndarray:
    """A number of its own for each row."""
    h = np.full(len(columns[0]), 0x2545F4914F6CDD1D, np.uint64)
    for c in columns:
        h = _mix(h + c.view(np.uint64), 0x9FB21C651E98DF25)
    return h.view(np.int64)


#: ``again``: known to repeat; such a row is dealt by a number of its own and ``run`` is a mark.
RUNS = "deal long, key long, around long, hot boolean, again boolean, id long, version long, run long"


def _dealt(ids: np.ndarray, versions: np.ndarray, key: np.ndarray, around: np.ndarray, lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    """Runs as rows of ``RUNS``: of equal surroundings the first; the others repeat."""
    order = np.lexsort((lo, versions, ids, around, key))
    new = _first_of(order, key, around)
    heads, others = order[new], order[~new]
    frequent = hot[np.minimum(np.searchsorted(hot, key[heads]), len(hot) - 1)] == key[heads] if len(hot) else np.zeros(len(heads), bool)
    deal = np.where(frequent, _alone(key[heads], around[heads]), key[heads])
    run = (lo[heads] << 14) | ((anchor - lo)[heads] << 7) | (hi - lo)[heads]
    i, v, marks = _merged(ids[others], versions[others], lo[others], (hi - lo)[others] + 1)
    own = _alone(i, v, marks)
    columns = [
        np.concatenate([deal, own]), np.concatenate([key[heads], own]), np.concatenate([around[heads], own]), np.concatenate([frequent, np.zeros(len(i), bool)]),
        np.repeat([False, True], [len(heads), len(i)]), np.concatenate([ids[heads], i]), np.concatenate([versions[heads], v]), np.concatenate([run, marks]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in RUNS.split(", ")])


def _runs(texts: DataFrame, hot: np.ndarray) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, versions = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "version"))
            held: list[list[np.ndarray]] = []
            size = 0
            for texts_of, begin, data, bounds in _chunks(b.column("text").to_pylist()):
                piece, lo, hi, anchor, key, around = anchors_of(data, bounds)
                own, before = texts_of[piece], begin[piece]
                held.append([ids[own], versions[own], key, around, lo + before, hi + before, anchor + before])
                size += len(data)
                if size >= TOGETHER_BYTES:
                    yield _dealt(*(np.concatenate(x) for x in zip(*held)), sent.value)
                    held, size = [], 0
            if held:
                yield _dealt(*(np.concatenate(x) for x in zip(*held)), sent.value)

    return texts.mapInArrow(run, RUNS)


def frequent_grams(texts: DataFrame, rows: int = SAMPLE_ROWS, least: int = HOT_COUNT) -> np.ndarray:
    """Sorted grams with at least ``least`` different surroundings in a sample of about ``rows`` documents.

    They are few (each takes ``least`` of the sample's anchors, and no more than ``HOT_MOST`` are
    returned), and results don't depend on them.
    """
    span = 1 << 20
    share = max(1, min(span, rows * span // max(1, texts.count())))
    seen = _runs(texts.where(F.pmod(F.xxhash64("id", "version"), F.lit(span)) < share), np.zeros(0, np.int64)).where("not again")
    found = seen.select("key", "around").distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r.key for r in found.orderBy(F.desc("n"), "key").limit(HOT_MOST).collect()], np.int64))


def first_round(texts: DataFrame, hot: np.ndarray) -> DataFrame:
    """(id, version, run, again): marks of what repeats, and the runs that the next round has to tell apart."""
    of_class, of_gram = ["deal", "key", "around"], Window.partitionBy("deal", "key")
    ranked = (
        _runs(texts, hot)
        .repartition("deal")
        .withColumn("nth", F.row_number().over(Window.partitionBy(*of_class).orderBy("id", "version", "run")))
        .withColumn("low", F.min("around").over(of_gram))
        .withColumn("high", F.max("around").over(of_gram))
    )
    repeats = F.col("again") | (F.col("nth") > 1)
    lo, n = F.shiftright("run", 14), F.col("run").bitwiseAND(127)
    mark = F.when(F.col("again"), F.col("run")).when(F.col("nth") > 1, F.shiftleft(lo, 12) + n).otherwise(F.col("run"))
    return ranked.where(repeats | F.col("hot") | (F.col("low") != F.col("high"))).select("id", "version", mark.alias("run"), repeats.alias("again"))


def _with_text(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts with their ``runs``; a text is shuffled once however often it is asked for."""
    return texts.join(wanted.groupBy("id", "version").agg(F.collect_list("run").alias("runs")).hint("shuffle_hash"), ["id", "version"])


def _in_parts(b: pd.DataFrame, cut_out) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(id, version) of rows and what ``cut_out`` makes of text bytes and runs, about ``ROWS_AT_ONCE`` at a time."""
    ids, versions, rows = [], [], []
    for i, version, text, runs in zip(b["id"], b["version"], b["text"], b["runs"]):
        data = text.encode("utf-8", "surrogatepass")
        for at in range(0, len(runs), ROWS_AT_ONCE):
            got = cut_out(data, np.asarray(runs[at : at + ROWS_AT_ONCE], np.int64))
            rows += got
            ids += [i] * len(got)
            versions += [version] * len(got)
            if len(rows) >= ROWS_AT_ONCE:
                yield np.array(ids, np.int64), np.array(versions, np.int64), rows
                ids, versions, rows = [], [], []
    if rows:
        yield np.array(ids, np.int64), np.array(versions, np.int64), rows


def _sides(data: bytes, runs: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(first start, starts, the 63 bytes that all of them hold) of a run's starts, by the side of the gram they reach to."""
    out = []
    for r in runs.tolist():
        lo, anchor, hi = r >> 14, (r >> 14) + (r >> 7 & 127), (r >> 14) + (r & 127)
        middle = max(lo, anchor - BESIDE + 1)
        if middle <= hi:
            out.append((middle, hi - middle + 1, data[anchor : anchor + GRAM + BESIDE]))
        if lo < middle:
            out.append((lo, min(hi + 1, middle) - lo, data[anchor - BESIDE : anchor + GRAM]))
    return out


def second_round(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, version, run) of the starts whose gram and its neighbours on one side are not unique; ``run`` is a mark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, versions, rows in _in_parts(b, _sides):
                lo, n, parts = zip(*rows)
                data = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, GRAM + BESIDE)
                rank = np.zeros(len(rows), np.uint64)
                for k in range(GRAM + BESIDE):
                    rank = (rank + data[:, k] + np.uint64(1)) * _BASES[1]
                rank = _mix(rank, 0x8EBC6AF09C88C6E3).view(np.int64)
                marks = _marks(np.array(lo, np.int64), np.array(n, np.int64))
                # Of ranks met twice here, one asks on; all of them are known to stay.
                order = np.argsort(rank, kind="stable")
                new = _first_of(order, rank)
                known = np.zeros(len(rows), bool)
                known[order] = ~new | np.append(~new[1:], False)
                rank[order[~new]] = _alone(ids, versions, marks)[order[~new]]
                yield pd.DataFrame({"rank": rank, "known": known, "id": ids, "version": versions, "run": marks})

    ranks = _with_text(texts, wanted).mapInPandas(run, "rank long, known boolean, id long, version long, run long")
    return ranks.withColumn("n", F.count("*").over(Window.partitionBy("rank"))).where("known or n > 1").select("id", "version", "run")


def _strings(data: bytes, runs: np.ndarray) -> list[tuple[int, int, bytes]]:
    return [(r >> 12, (r & 4095) + 1, data[r >> 12 : (r >> 12) + (r & 4095) + LENGTH]) for r in runs.tolist()]


def third_round(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, version, run) of the starts in ``wanted`` whose string starts earlier, too; ``run`` is a mark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, versions, rows in _in_parts(b, _strings):
                lo, n, parts = (np.array(x, np.int64) if k < 2 else x for k, x in enumerate(zip(*rows)))
                begin = np.cumsum([0] + [len(p) for p in parts])[:-1]
                h = Hashes(np.frombuffer(b"".join(parts), np.uint8))
                row = np.repeat(np.arange(len(rows)), n)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                p, at, i, v = begin[row] + step, lo[row] + step, ids[row], versions[row]
                rank = _mix(h.of(p, p + HALF), 0x8EBC6AF09C88C6E3).view(np.int64)
                rest = _mix(h.of(p + HALF, p + LENGTH), 0x589965CC75374CC3).view(np.int64)
                order = np.lexsort((at, v, i, rest, rank))
                new = _first_of(order, rank, rest)
                heads, others = order[new], order[~new]
                yield pd.DataFrame({"rank": rank[heads], "next": rest[heads], "again": False, "id": i[heads], "version": v[heads], "run": at[heads] << 12})
                i, v, marks = _merged(i[others], v[others], at[others], np.ones(len(others), np.int64))
                yield pd.DataFrame({"rank": _alone(i, v, marks), "next": np.int64(0), "again": True, "id": i, "version": v, "run": marks})

    pairs = _with_text(texts, wanted).mapInPandas(run, "rank long, next long, again boolean, id long, version long, run long")
    equal = Window.partitionBy("rank", "next").orderBy("id", "version", "run")
    return pairs.withColumn("nth", F.row_number().over(equal)).where("again or nth > 1").select("id", "version", "run")


OUT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cover(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` bytes the strings of the marked runs cover."""
    edge = np.zeros(n + 1, np.int32)
    if len(runs):
        np.add.at(edge, runs >> 12, 1)
        np.add.at(edge, (runs >> 12) + (runs & 4095) + LENGTH, -1)
    return np.cumsum(edge[:n]) > 0


def _removed(marked: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, runs in zip(b["text"], b["runs"]):
                data = (text or "").encode("utf-8", "surrogatepass")
                if runs is None or not len(runs):
                    rows.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                    continue
                gone = cover(len(data), np.asarray(runs, np.int64))
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                rows.append((len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return marked.mapInPandas(run, OUT_SCHEMA)


def repeated_runs(texts: DataFrame) -> DataFrame:
    """(id, version, run) of all strings in ``texts`` (id, version, text) that also start earlier; ``run`` is a mark."""
    ranked = cut(first_round(texts, frequent_grams(texts)))
    left = second_round(texts, ranked.where("not again"))
    return ranked.where("again").select("id", "version", "run").unionByName(third_round(texts, left))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``; see ``OUT_SCHEMA``."""
    least = F.lit(-(1 << 63)).cast("long")
    text = F.col("text").cast("string")
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("id"))
    # Ids are read alone; only where some repeat is a document told apart by its text too.
    unique = ids.groupBy("id").count().where("count > 1").isEmpty()
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("id"), (F.lit(0).cast("long") if unique else F.xxhash64(text)).alias("version"), text.alias("text"))
    # Equal rows are one document: its strings are counted once, its marks go to all of them.
    once = texts if unique else texts.dropDuplicates(["id", "version"])
    marks = repeated_runs(once).groupBy("id", "version").agg(F.collect_list("run").alias("runs"))
    marked = texts.join(marks.hint("shuffle_hash"), ["id", "version"], "left")
    return _removed(marked.select(F.when(F.col("id") != least, F.col("id")).alias("doc_id"), "text", "runs"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: Every start of every text, in hexadecimal; for the small tables of the check.
ORACLE = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents),
pieces AS (
    SELECT doc_id, base, substr(digits, 2 * base + 1, 1198) AS piece
    FROM (SELECT doc_id, digits, unnest(range(0, strlen(digits) // 2 - 99, 500)) AS base FROM texts)
), starts AS (
    SELECT doc_id, base + pos AS pos, substr(piece, 2 * pos + 1, 200) AS string
    FROM (SELECT doc_id, base, piece, unnest(range(0, least(500, strlen(piece) // 2 - 99))) AS pos FROM pieces)
), repeats AS (
    SELECT doc_id, pos FROM starts QUALIFY row_number() OVER (PARTITION BY string ORDER BY doc_id, pos) > 1
), marked AS (
    SELECT doc_id, pos, coalesce(pos > lag(pos) OVER w + 100, true) AS opens FROM repeats WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), numbered AS (SELECT doc_id, pos, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM marked),
runs AS (SELECT doc_id, run, min(pos) AS low, max(pos) + 100 AS high FROM numbered GROUP BY ALL),
gaps AS (
    SELECT doc_id, low, high, lag(high, 1, 0) OVER (PARTITION BY doc_id ORDER BY low) AS after FROM runs
), kept AS (
    SELECT doc_id, count(*) AS n_spans, sum(high - low) AS n_removed, max(high) AS last,
        string_agg(substr(digits, 2 * after + 1, 2 * (low - after)), '' ORDER BY low) AS part
    FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(strlen(digits) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
    CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(part || substr(digits, 2 * last + 1), digits))) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""
