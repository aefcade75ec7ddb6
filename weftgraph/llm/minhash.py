"""Near-duplicates by MinHash bands with sequential Bayesian verification.

Documents with equal shingle sets are one class, spoken for by its smallest id. Two levels find the
links between classes:

1. Members of a band's bucket are compared by their signatures, batch by batch; a pair is dropped
   when the posterior probability that it is similar enough falls below ``MISS``. Ids and
   signatures travel, no texts. Of the pairs left, as many are kept as connect what is connected.
2. What these pairs connect is a cluster. Its texts meet in one task, or in several chunks of
   bounded size; pairs are pruned by the same bounds, and survivors are verified on their full sets.
   Pairs that are already connected are not compared.

Dissimilar texts that share a bucket, or are chained through buckets of others, end at the first
level: their texts are not sent at all. A bucket or cluster of several chunks takes two rounds.
First every chunk is solved with a few common members in each. Then what is still outside of the
group's largest component visits the other chunks: as signatures, and as texts only where the
bounds leave a member that it could be linked with. Members of the largest component need no
comparison with each other. So no link between components is lost, a large group of copies costs
little more than its rows, and a task holds one chunk and some visitors at a time.

Sets are of 64-bit hashes of shingles: "full sets" are sets of these. With 32 bands of 5 rows, a
pair at the threshold of 0.85 (0.8) shares no band with a probability of 7e-9 (3e-6).

Defined cases: a null text or one without words has no shingles and is linked with nothing; rows
with one ``doc_id`` are one document; a null ``doc_id`` is linked with nothing, its component is
null and it is kept; equal rows get equal values; an empty table gives an empty result; other
columns are ignored (``one_of_each`` returns them as they are).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, release, table, text_parts
from .graph import components

BANDS, ROWS, BATCH = 32, 5, 16
HASHES = BANDS * ROWS
#: Chosen probability of dropping a pair that is similar enough.
MISS = 1e-7
#: Members and shingles of a chunk, common members of a group's chunks, and visitors held at a time.
CHUNK_MEMBERS, CHUNK_SHINGLES, HUBS, VISITORS = 3000, 1_500_000, 32, 500

_WORD = re.compile(WORD)
_LOWER = {c: c + 32 for c in range(65, 91)}
_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles of each text."""
    import xxhash

    known: dict[str, int] = {}
    out, digest = [], xxhash.xxh3_64_intdigest
    for text in texts:
        words = _WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())
        new = {w for w in words if w not in known}
        known.update((w, digest(w.encode("utf-8", "surrogatepass"))) for w in new)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(n, len(words))
        if not k:
            out.append(h)
            continue
        s = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            s = _mix(s + h[i : len(h) - k + 1 + i])
        out.append(np.unique(s))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """``HASHES`` minima, 16 bits of each: two different minima look equal once in 65,536 times."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 512):
        low = np.minimum(low, (s[at : at + 512, None] * _A + _B).min(axis=0))
    return (_mix(low) >> np.uint64(48)).astype(np.uint16)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Keys of the bands of signatures (rows)."""
    h = np.zeros(sig.shape[:-1] + (BANDS,), np.uint64)
    for part in np.moveaxis(sig.reshape(*sig.shape[:-1], BANDS, ROWS), -1, 0):
        h = _mix(h * np.uint64(3) + part)
    return h.view(np.int64)


def least_matches(percent: int, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, least matches to go on): the posterior of a uniform prior, P(S >= t | m of n), is a binomial tail."""
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def similar(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


SKETCH = "doc_id long, n_shingles long, set_key binary, signature binary"


def sketches(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b, texts in text_parts(batches):
            rows = [(len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s).tobytes() if len(s) else b"") for s in shingle_sets([t or "" for t in texts], n)]
            size, key, sig = zip(*rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "set_key", "signature"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SKETCH)


def bucket_cells(classes: DataFrame) -> DataFrame:
    """(id, bucket) of ``classes`` (id, signature), a row for each band."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        band = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            if len(b):
                keys = band_keys(_signatures(b["signature"])).view(np.uint64)
                yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), BANDS), "bucket": _mix(keys + band).view(np.int64).ravel()})

    return classes.select("id", "signature").mapInPandas(run, "id long, bucket long")


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, HASHES)


class Chunk:
    """Members that are compared with each other or with visitors; ``label`` says what is connected already.

    Pairs whose signatures the bounds don't rule out are linked; with ``texts``, those that are
    similar on their full sets.
    """

    def __init__(self, ids: np.ndarray, label: np.ndarray, size: np.ndarray, sig: np.ndarray, sets: list[np.ndarray] | None, percent: int):
        self.ids, self.label, self.size, self.sig, self.sets, self.percent = ids, label.copy(), size, sig, sets, percent
        self.limits = least_matches(percent)
        self._lists = None

    def _intersections(self, own: np.ndarray, js: np.ndarray) -> np.ndarray:
        if len(js) <= 8:
            return np.array([len(np.intersect1d(own, self.sets[j], assume_unique=True)) for j in js])
        if self._lists is None:
            every = np.concatenate(self.sets)
            owner = np.repeat(np.arange(len(self.sets)), self.size)
            order = np.argsort(every, kind="stable")
            self._lists = every[order], owner[order]
        keys, owners = self._lists
        lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(owners[at], minlength=len(self.sets))[js]

    def _possible(self, js: np.ndarray, label: int, size: int, sig: np.ndarray) -> np.ndarray:
        """Of members ``js``, those outside of ``label`` that the bounds don't rule out, the most similar first."""
        js = js[self.label[js] != label]
        # Sizes alone rule out the most unequal pairs.
        a, b = np.minimum(self.size[js], size), np.maximum(self.size[js], size)
        js = js[100 * a >= self.percent * b]
        matches = np.zeros(len(js), int)
        for end, least in self.limits:
            if not len(js):
                break
            matches += (self.sig[js, end - BATCH : end] == sig[end - BATCH : end]).sum(axis=1)
            go = matches >= least
            js, matches = js[go], matches[go]
        return js[np.argsort(-matches, kind="stable")]

    def links(self, js: np.ndarray, id_: int, label: int, size: int, sig: np.ndarray, own: np.ndarray | None) -> Iterator[tuple[int, int]]:
        """Links of one member or visitor with members ``js``; what becomes connected on the way is skipped."""
        js = self._possible(js, label, size, sig)
        while len(js):
            part, js = js[:64], js[64:]
            both = None if own is None else self._intersections(own, part)
            for k, j in enumerate(part):
                if self.label[j] != label and (own is None or similar(size, int(self.size[j]), int(both[k]), self.percent)):
                    yield int(id_), int(self.ids[j])
                    self.label[self.label == self.label[j]] = label
            js = js[self.label[js] != label]

    def inner(self) -> Iterator[tuple[int, int]]:
        every = np.arange(len(self.ids))
        for i in every[:-1]:
            yield from self.links(every[i + 1 :], self.ids[i], self.label[i], int(self.size[i]), self.sig[i], self.sets and self.sets[i])


def _small_groups(b: pd.DataFrame, percent: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Links of the groups of two and three that begin and end in ``b``, all at once, and the rows of the others."""
    group, chunk, ids, size = (b[c].to_numpy() for c in ("group", "chunk", "id", "size"))
    start = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (chunk[1:] != chunk[:-1])])
    length = np.diff(np.r_[start, len(b)])
    # The first and the last group may go on in other batches.
    inner = np.zeros(len(start), bool)
    inner[1:-1] = True
    two, three = start[inner & (length == 2)], start[inner & (length == 3)]
    sig, limits = _signatures(b["signature"]), least_matches(percent)

    def close(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
        matches = np.zeros(len(at), int)
        for end, least in limits:
            matches += (sig[i[at], end - BATCH : end] == sig[j[at], end - BATCH : end]).sum(axis=1)
            go = matches >= least
            at, matches = at[go], matches[go]
        out = np.zeros(len(i), bool)
        out[at] = True
        return out

    ab, bc, ac = close(three, three + 1), close(three + 1, three + 2), close(three, three + 2)
    ac &= ~(ab & bc)
    pair = close(two, two + 1)
    i = np.concatenate([two[pair], three[ab], three[bc] + 1, three[ac]])
    j = np.concatenate([two[pair] + 1, three[ab] + 1, three[bc] + 2, three[ac] + 2])
    left = np.repeat(~(inner & (length >= 2) & (length <= 3)), length)
    return pd.DataFrame({"a": ids[i], "b": ids[j]}), b[left]


def _solve(members: DataFrame, n: int, percent: int, visits: str | None = None) -> DataFrame:
    """Links (a, b) in the chunks of ``members`` (group, chunk, id, label, visitor, and size and signature, or text).

    With ``visits``, visitors are compared with members: ``links`` gives their links, ``asks`` the
    (id, chunk) of visitors that the bounds leave a possible link.
    """
    exact = "text" in members.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk: Chunk | None = None
        held: list[pd.DataFrame] = []
        out: list[tuple[int, int]] = []
        now: tuple[int, int] | None = None
        was_visitor = False

        def arrays(rows: list[pd.DataFrame]) -> tuple:
            b = pd.concat(rows, ignore_index=True)
            if not exact:
                return b["id"].to_numpy(), b["label"].to_numpy(), b["size"].to_numpy(), _signatures(b["signature"]), None
            sets = shingle_sets(list(b["text"]), n)
            return b["id"].to_numpy(), b["label"].to_numpy(), np.array([len(x) for x in sets]), np.array([signature(x) for x in sets]), sets

        def settle(visitors: bool) -> None:
            """Members that are all here, or visitors, are compared."""
            nonlocal chunk, held
            if not held:
                return
            rows, held = held, []
            if not visitors:
                if sum(map(len, rows)) > 1 or visits:
                    chunk = Chunk(*arrays(rows), percent)
                    if not visits:
                        out.extend(chunk.inner())
            elif chunk is not None:
                every = np.arange(len(chunk.ids))
                ids, labels, sizes, sigs, sets = arrays(rows)
                for i, id_ in enumerate(ids):
                    if visits == "asks":
                        if len(chunk._possible(every, labels[i], int(sizes[i]), sigs[i])):
                            out.append((int(id_), now[1]))
                    else:
                        out.extend(chunk.links(every, id_, labels[i], int(sizes[i]), sigs[i], sets and sets[i]))

        for b in batches:
            if not exact and not visits and len(b):
                found, b = _small_groups(b, percent)
                yield found
            key = b["group"].to_numpy(), b["chunk"].to_numpy(), b["visitor"].to_numpy(bool)
            new = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])) + 1
            for x, y in zip([0, *new], [*new, len(b)]):
                own, visitor = (int(key[0][x]), int(key[1][x])), bool(key[2][x])
                if own != now or visitor != was_visitor:
                    settle(now is not None and was_visitor)
                    if own != now:
                        chunk = None
                now, was_visitor = own, visitor
                for at in range(x, y, VISITORS):
                    held.append(b.iloc[at : min(y, at + VISITORS)])
                    if visitor and sum(map(len, held)) >= VISITORS:
                        settle(True)
            yield pd.DataFrame(out, columns=["a", "b"])
            out.clear()
        if now is not None:
            settle(was_visitor)
            yield pd.DataFrame(out, columns=["a", "b"])
        chunk = None
        release()

    payload = ["text"] if exact else ["size", "signature"]
    dealt = members.select("group", "chunk", "visitor", "id", "label", *payload).repartition("group", "chunk").sortWithinPartitions("group", "chunk", "visitor", "id")
    return dealt.mapInPandas(run, "a long, b long")


def _in_chunks(members: DataFrame, count: DataFrame) -> DataFrame:
    """``members`` (group, id) with ``count`` (group, chunks, members) and the chunk of each."""
    return members.join(count, "group").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))


def _connect(placed: DataFrame, signed: DataFrame, texts: DataFrame | None, n: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what is connected in each group of ``placed`` (group, id, chunk, chunks, members)."""

    def solve(rows: DataFrame, exact: bool, visits: str | None = None) -> DataFrame:
        # A text or signature is looked up once for a row, however many chunks the row goes to.
        full = rows.join(texts if exact else signed, "id").withColumn("chunk", F.explode("at")).drop("at")
        return _solve(full.withColumn("visitor", F.col("chunk") != F.col("own")) if visits else full, n, percent, visits)

    exact = texts is not None
    hub = (F.col("chunks") > 1) & (F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.lit(1), F.floor(F.col("members") / HUBS))) == 0)
    everywhere = F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))
    first = placed.withColumn("at", F.when(hub, everywhere).otherwise(F.array("chunk"))).withColumn("label", F.col("id")).withColumn("visitor", F.lit(False))
    links = cut(solve(first.drop("chunk"), exact))
    large = placed.where("chunks > 1")
    if large.isEmpty():
        return links
    labels = components(links)
    named = cut(large.join(labels, large.id == labels.node, "left").withColumn("label", F.coalesce("component", "id")).drop("node", "component"))
    most = named.groupBy("group", "label").agg(F.count("*").alias("k")).groupBy("group").agg(F.max(F.struct("k", "label")).alias("m")).select("group", F.col("m.label").alias("main"))
    rows = named.join(most, "group").withColumn("outside", F.col("label") != F.col("main")).withColumnRenamed("chunk", "own")
    visitors = rows.where("outside").withColumn("at", F.array_except(everywhere, F.array("own")))
    hosts = rows.withColumn("at", F.array("own"))
    if exact:
        asks = solve(visitors.unionByName(hosts), False, "asks").select(F.col("a").alias("id"), F.col("b").cast("int").alias("to"))
        asks = cut(asks.groupBy("id").agg(F.collect_set("to").alias("at")))
        visitors = visitors.drop("at").join(asks, "id")
        visited = asks.select(F.explode("at").alias("own"), "id").join(rows.select("id", "group"), "id").select("group", "own").distinct()
        hosts = hosts.join(visited, ["group", "own"], "left_semi")
    return cut(links.unionByName(solve(visitors.unionByName(hosts.select(*visitors.columns)), exact, "links")))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    sketch = cut(sketches(docs, n))
    classes = (
        sketch.where("n_shingles > 0 and doc_id is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("size"), F.first("signature").alias("signature"))
    )
    classes = cut(classes)
    cells = bucket_cells(classes)
    buckets = cells.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1").withColumn("chunks", F.ceil(F.col("members") / CHUNK_MEMBERS))
    # An id whose rows have different texts stands for several classes: each of them is compared.
    signed = classes.select("id", "size", "signature")
    placed = _in_chunks(cells.withColumnRenamed("bucket", "group"), buckets.withColumnRenamed("bucket", "group"))
    close = components(_connect(cut(placed.distinct()), signed, None, n, percent))
    clusters = close.select(F.col("component").alias("group"), F.col("node").alias("id"))
    size = clusters.join(classes.groupBy("id").agg(F.sum("size").alias("size")), "id")
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK_MEMBERS), F.ceil(F.sum("size") / CHUNK_SHINGLES))
    placed = cut(_in_chunks(clusters, size.groupBy("group").agg(chunks.alias("chunks"), F.count("*").alias("members"))))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return _named(sketch, classes, components(_connect(placed, signed, texts, n, percent)))


def _named(sketch: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    own = classes.select("set_key", "id").join(found, F.col("id") == F.col("node"), "left").select("set_key", F.coalesce("component", "id").alias("component_id"))
    # A document whose rows have different texts stands in several classes: these were joined by its id.
    named = sketch.select("doc_id", "n_shingles", "set_key").join(own, "set_key", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are kept: of each component its smallest id, of repeated rows one."""
    found = cut(near_duplicates(docs, n, percent))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__wg_id")).distinct()
    left = docs.join(gone, docs.doc_id.cast("long") == F.col("__wg_id"), "left_anti")
    again = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__wg_id"))
    if again.isEmpty():
        return left
    once = Window.partitionBy("doc_id").orderBy("text")
    twice = left.join(again, left.doc_id.cast("long") == F.col("__wg_id"), "left_semi").withColumn("__wg_n", F.row_number().over(once)).where("__wg_n = 1").drop("__wg_n")
    return left.join(again, left.doc_id.cast("long") == F.col("__wg_id"), "left_anti").unionByName(twice)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85)


#: All pairs that share a shingle, and what links reach; for the small tables of the check.
ORACLE = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE
        WHEN len(words) = 0 THEN []
        WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])
    END) AS shingles
    FROM words
), sizes AS (SELECT doc_id, len(shingles) AS n FROM sets),
each AS (SELECT doc_id, unnest(shingles) AS shingle FROM sets),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)
), either AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
    SELECT doc_id, doc_id AS other FROM sizes
    UNION SELECT r.doc_id, e.b FROM reached r JOIN either e ON r.other = e.a
)
SELECT r.doc_id, CAST(any_value(n) AS BIGINT) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept
FROM reached r JOIN sizes USING (doc_id) GROUP BY r.doc_id
"""
