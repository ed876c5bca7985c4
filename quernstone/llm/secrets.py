"""Secret scans over an incremental blob ledger, in DataFrame functions only.

A blob is a distinct text, named by its SHA-256; a path is a document that holds
it. The ledger remembers which blob has been scanned under which version of the
rules and what was found. A scan content-addresses the documents, drops the pairs
of blob and rule version that the ledger has, scans one copy of each of the rest,
adds them to the ledger, and joins the findings back to all paths. A version of a
document that comes later is another blob; a copy is none. The ledger is a folder
that a later session opens again.

Positions are code points. Where a text's matches begin follows from the lengths
of the matches and of the text between them: split and regexp_extract_all cut a
text at the same places, and a running sum over their lengths gives offsets.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import BROADCAST_ROWS, shared_folder, stored


@dataclass(frozen=True)
class Rule:
    """pattern: a Java expression that never matches nothing; secret: the group
    that must have least characters, or 0 for the match."""

    kind: str
    pattern: str
    secret: int = 0
    least: int = 1


#: Fixed: the kinds of base findings, in the order of their listing. Runs that
#: would be dropped for their length cannot match in the last two.
RULES = (
    Rule("assign", "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
)


#: Names of blobs that are broadcast at most; a name is 64 digits.
FEW_BLOBS = 250_000


def version_of(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _matches(rule: Rule, order: int) -> Column:
    """What findings_of has cut by rule, as structs in the order of the text."""

    def match(x: Column, number: Column) -> Column:
        return F.struct(
            F.lit(rule.kind).alias("kind"),
            F.lit(order).alias("kind_order"),
            number.alias("number"),
            F.length(x["before"]).cast("long").alias("before"),
            F.length(x["found"]).cast("long").alias("length"),
            (F.length(F.regexp_extract(x["found"], rule.pattern, rule.secret)) >= rule.least).alias("kept"),
        )

    before = F.slice(F.col(f"{rule.kind}.between"), F.lit(1), F.size(f"{rule.kind}.found"))
    return F.transform(F.arrays_zip(before.alias("before"), F.col(f"{rule.kind}.found").alias("found")), match)


def findings_of(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, kind_order, start, end) of each match that a rule keeps."""
    cut = blobs
    for r in rules:
        cut = cut.withColumn(r.kind, F.when(F.col("text").rlike(r.pattern), F.struct(F.split("text", r.pattern, -1).alias("between"), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("found"))))
    one = [_matches(r, k) for k, r in enumerate(rules)]
    every = F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<struct<kind:string,kind_order:int,number:int,before:bigint,length:bigint,kept:boolean>>")) for x in one]))
    rows = cut.where(reduce(lambda a, b: a | b, [F.col(r.kind).isNotNull() for r in rules])).select("blob", F.explode(every).alias("x")).select("blob", "x.*")
    so_far = Window.partitionBy("blob", "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("before") + F.col("length")).over(so_far)).withColumn("start", F.col("end") - F.col("length"))
    return rows.where("kept").select("blob", "kind", "kind_order", "start", "end")


class BlobLedger:
    """What has been scanned, and what was found: two tables in a folder, parted by
    the version of the rules, to which each scan adds. Findings are written before
    their blobs count as scanned, so what a scan that was cut short has left is only
    found again. Nothing of it is on the driver."""

    SCANNED = "blob string, rule_version string"
    FINDINGS = "blob string, kind string, kind_order int, start bigint, end bigint, rule_version string"

    def __init__(self, spark: SparkSession, rules: tuple[Rule, ...] = RULES, folder: str | None = None):
        """folder: of a ledger that is there or is to begin; by default a new one below
        spark.checkpoint.dir."""
        self.spark, self.rules, self.version = spark, rules, version_of(rules)
        self.folder = folder.rstrip("/") if folder else shared_folder(spark, "blob-ledger")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], schema)
        return rows.where(F.col("rule_version") == self.version).drop("rule_version")

    def _add(self, name: str, rows: DataFrame) -> None:
        rows.withColumn("rule_version", F.lit(self.version)).write.partitionBy("rule_version").mode("append").parquet(f"{self.folder}/{name}")

    def scanned(self) -> DataFrame:
        """(blob) of what has been scanned under this version of the rules."""
        return self._read("scanned", self.SCANNED)

    def found(self) -> DataFrame:
        """Their findings: (blob, kind, kind_order, start, end)."""
        return self._read("findings", self.FINDINGS).distinct()

    def unseen(self, blobs: DataFrame) -> DataFrame:
        """blobs without those scanned under this version of the rules."""
        return blobs.join(self.scanned(), "blob", "left_anti")

    def scan(self, docs: DataFrame) -> DataFrame:
        """Scans the unseen blobs of (doc_id, text); returns (doc_id, blob) of all.
        Texts are named first, and only those of unseen blobs are shuffled."""
        named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
        paths = stored(named.select("doc_id", "blob"), "blob-paths")
        new = stored(self.unseen(paths.select("blob").distinct()), "blobs-unseen")
        few = new.count() <= FEW_BLOBS
        copies = named.select("blob", "text").join(F.broadcast(new) if few else new, "blob", "left_semi")
        self._add("findings", findings_of(copies.groupBy("blob").agg(F.first("text").alias("text")), self.rules))
        self._add("scanned", new)
        return paths


def find_secrets(docs: DataFrame, ledger: BlobLedger | None = None, batches: int = 2) -> DataFrame:
    """(doc_id, spans) for each row of docs: all findings of its text, as an array
    of (kind, start, end), by start, then by the order of the rules.

    With a ledger, blobs that it knows are not scanned again. The documents are
    scanned in batches, by a hash of the id, as versions that come one after
    another; copies in a later batch are not scanned again. A null text is empty;
    texts are read whole, however long; repeated rows, and rows without an id, are
    paths like others; a table without rows gives none.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    paths = reduce(DataFrame.unionByName, [ledger.scan(docs.where(turn == i)) for i in range(batches)])
    found = stored(ledger.found().join(paths.select("blob").distinct(), "blob", "left_semi"), "blob-findings")
    few = found.count() <= BROADCAST_ROWS  # else a join by blob, in which a hot one can be split
    spans = found.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "kind_order", "end", "kind"))).alias("spans"))
    out = paths.join(F.broadcast(spans) if few else spans, "blob", "left")
    return out.select("doc_id", F.coalesce(F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))), F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")).alias("spans"))
