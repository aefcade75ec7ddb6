"""Secret scan over a blob ledger, in DataFrame functions only.

Every version of a document is content-addressed by the SHA-256 of its text. A ledger holds
which (blob, rule version) pairs have been scanned and what was found; a run scans only the
pairs that the ledger lacks and joins findings back to every path that carries the blob.

Copies of a blob are merged before their text is shuffled, and findings are joined back by blob and
a salt, so that a blob with very many paths is not one task.

Defined cases: a null text is the empty text; a null ``doc_id`` is a path like any other;
repeated rows give repeated result rows with equal values; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_folder, table, text_or_empty


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Group whose length is tested and its least length; matches below are dropped, but use up their text.
    group: int = 0
    least: int = 0
    base: bool = False

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.pattern}|{self.group}|{self.least}".encode()).hexdigest()[:16]


#: In the order in which spans with an equal start are listed. The least length of ``access`` and
#: ``hex`` stands in the pattern: their runs are maximal, so that is the same as a later filter.
RULES = (
    Rule("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("vcs_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("chat_token", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
)


#: Parts that the paths of a blob are dealt into.
SALTS = 16


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _scan(blobs: DataFrame, rules: tuple[Rule, ...], pairs: bool) -> DataFrame:
    """Findings (blob, kind, version, start, end) of ``blobs`` (blob, text[, versions]).

    Spark has no function for match offsets: the gaps between matches (``split``) and the
    matches (``regexp_extract_all``) interleave, so offsets are running sums of their lengths.
    """

    def one(r: Rule) -> Column:
        pat = F.lit(r.pattern)
        due = F.col("text").rlike(r.pattern)
        if pairs:
            due = due & F.array_contains("versions", r.version)
        hits = F.regexp_extract_all("text", pat, F.lit(0))
        sized = hits if r.group == 0 else F.regexp_extract_all("text", pat, F.lit(r.group))
        steps = F.arrays_zip(
            F.transform(F.slice(F.split("text", r.pattern, -1), F.lit(1), F.size(hits)), F.length).alias("gap"),
            F.transform(hits, F.length).alias("hit"),
            F.transform(sized, F.length).alias("sized"),
        )
        return F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), F.when(due, steps).alias("steps"))

    rows = (
        blobs.select("blob", F.explode(F.array(*[one(r) for r in rules])).alias("r"))
        .where(F.col("r.steps").isNotNull())
        .select("blob", "r.kind", "r.version", "r.least", F.posexplode("r.steps").alias("pos", "s"))
        .select("blob", "kind", "version", "least", "pos", "s.gap", "s.hit", "s.sized")
        .repartition("blob", "kind")
    )
    upto = Window.partitionBy("blob", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("end", F.sum((F.col("gap") + F.col("hit")).cast("long")).over(upto))
        .where("sized >= least")
        .select("blob", "kind", "version", (F.col("end") - F.col("hit")).alias("start"), "end")
    )


def scan_unseen(docs: DataFrame, scanned: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of the (blob, rule version) pairs of ``docs`` that ``scanned`` (blob, version) lacks."""
    paths = docs.select(text_or_empty().alias("text")).withColumn("blob", blob_id(F.col("text")))
    blobs = paths.groupBy("blob").agg(F.first("text").alias("text"))
    if scanned is None:
        return _scan(blobs, rules, False)
    every = F.array(*[F.lit(r.version) for r in rules])
    seen = scanned.where(F.col("version").isin([r.version for r in rules])).groupBy("blob").agg(F.collect_set("version").alias("seen")).hint("merge")
    due = F.when(F.col("seen").isNull(), every).otherwise(F.array_except(every, "seen"))
    return _scan(blobs.join(seen, "blob", "left").withColumn("versions", due).where(F.size("versions") > 0), rules, True)


def findings_by_path(docs: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs`` (doc_id): ``found``, its spans (start, ord, kind, end) in order."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    of_blob = (
        findings.where(F.col("version").isin([r.version for r in rules]))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_list(F.struct("start", order[F.col("kind")].alias("ord"), "kind", "end"))).alias("found"))
    )
    of_blob = of_blob.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    paths = docs.select("doc_id", blob_id(text_or_empty()).alias("blob"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    none = F.expr("cast(array() as array<struct<start:bigint,ord:int,kind:string,end:bigint>>)")
    return paths.join(of_blob.hint("merge"), ["blob", "salt"], "left").select("doc_id", F.coalesce("found", none).alias("found"))


class BlobLedger:
    """A ledger in a shared folder: Parquet tables ``scanned`` and ``findings`` under ``root``."""

    SCANNED = "blob binary, version string"
    FINDINGS = "blob binary, kind string, version string, start bigint, end bigint"

    def __init__(self, spark: SparkSession, root: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.root, self.rules = spark, root.rstrip("/"), rules

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if there else self.spark.createDataFrame([], schema)

    def record(self, docs: DataFrame) -> None:
        """Scans what is new in ``docs`` and records it.

        Findings are written before the pairs are marked as scanned: a run that dies between
        the two scans those pairs again, and readers drop the repeated findings.
        """
        scanned = self._read("scanned", self.SCANNED)
        scan_unseen(docs, scanned, self.rules).write.mode("append").parquet(f"{self.root}/findings")
        every = F.array(*[F.lit(r.version) for r in self.rules])
        pairs = docs.select(blob_id(text_or_empty()).alias("blob")).distinct().select("blob", F.explode(every).alias("version"))
        # Read in full before anything is appended to the same folder.
        cut(pairs.join(scanned.hint("merge"), ["blob", "version"], "left_anti")).write.mode("append").parquet(f"{self.root}/scanned")

    def findings(self) -> DataFrame:
        return self._read("findings", self.FINDINGS).dropDuplicates()

    def update(self, docs: DataFrame) -> DataFrame:
        """Records what is new in ``docs`` and returns findings for all its paths."""
        self.record(docs)
        return findings_by_path(docs, self.findings(), self.rules)


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def digest(by_path: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    base = [r.kind for r in rules if r.base]
    n = lambda k: F.size(F.filter("found", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    return by_path.select("doc_id", *[n(k) for k in base], F.sha2(_joined(F.filter("found", lambda x: x.kind.isin(base))), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every found span replaced by ``mask``; all rows and columns stay.

    Overlapping spans are masked together. ``n_chars``, where there is one, is set anew for the
    rows that change. Blobs without findings are passed on as they are.
    """
    found = scan_unseen(docs, rules=rules)
    spans = found.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__wg_spans"))
    salted = spans.select(F.col("blob").alias("__wg_b"), "__wg_spans", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])).alias("__wg_part"))
    # Kept text between spans, and where a piece begins after a masked run.
    parts = F.expr(
        f"""aggregate(__wg_spans, named_struct('at', 0L, 'out', cast('' as string)),
            (a, s) -> if(s.end <= a.at, a, if(s.start < a.at, named_struct('at', s.end, 'out', a.out),
              named_struct('at', s.end, 'out', a.out || substring(__wg_text, cast(a.at + 1 as int), cast(s.start - a.at as int)) || '{mask}'))),
            a -> a.out || substring(__wg_text, cast(a.at + 1 as int)))"""
    )
    cols = docs.columns
    joined = (
        docs.withColumn("__wg_text", text_or_empty())
        .withColumn("__wg_blob", blob_id(F.col("__wg_text")))
        .withColumn("__wg_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        .join(salted, (F.col("__wg_blob") == F.col("__wg_b")) & (F.col("__wg_salt") == F.col("__wg_part")), "left")
        .withColumn("__wg_new", F.when(F.col("__wg_spans").isNotNull(), parts).otherwise(F.col("text")))
    )
    new = {"text": F.col("__wg_new")}
    if "n_chars" in cols:
        new["n_chars"] = F.when(F.col("__wg_spans").isNotNull(), F.length("__wg_new")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in cols])


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a new ledger, in two steps: an earlier state that has half of the documents, then all of them."""
    docs = table(spark, sf_dir, "documents")
    ledger = BlobLedger(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
    ledger.record(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0))
    return digest(ledger.update(docs))


def _oracle() -> str:
    def spans(r: Rule) -> str:
        pat = r.pattern.replace("'", "''")
        return f"""SELECT doc_id, '{r.kind}' AS kind, {RULES.index(r)} AS ord, {str(r.base).lower()} AS base, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, sized, {r.least} AS least
        FROM (SELECT doc_id, string_split_regex(t, '{pat}') AS gaps, regexp_extract_all(t, '{pat}', 0) AS hits, regexp_extract_all(t, '{pat}', {r.group}) AS sized FROM d)"""

    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({" UNION ALL ".join(spans(r) for r in RULES)}),
    s AS (SELECT doc_id, kind, ord, base, length(array_to_string(gaps[1:i], '')) + length(array_to_string(hits[1:i - 1], '')) AS st, length(hits[i]) AS n
          FROM m WHERE length(sized[i]) >= least),
    g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
          coalesce(string_agg(kind || ':' || st || ':' || (st + n), ',' ORDER BY st, ord) FILTER (base), '') AS b, string_agg(kind || ':' || st || ':' || (st + n), ',' ORDER BY st, ord) AS a
          FROM s GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
    FROM d LEFT JOIN g USING (doc_id)"""


ORACLE = _oracle()
