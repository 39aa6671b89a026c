"""Secret scans over an incremental ledger of blobs.

A version is a row: a path, a version of it if there is a history, and a text that is
addressed by its SHA-256. The ledger is a folder of Parquet tables in shared storage,
which any later process may open again: blobs, with a row for each blob and rule version
that has been scanned and its findings, and versions, with a row for each path and
version that was ever seen and its blob. A scan looks only at pairs of blob and rules
that the ledger lacks, each once however many versions hold the blob, appends what it
finds, and joins findings back to all paths. Spark's commit of an appended folder makes
a scan whole or absent: blobs are committed last, so a scan that fails is done again.

Whether a blob can hold a finding at all is tested first by functions that run
inside the scan of the table, so that only suspects' texts are shuffled (to keep
one copy of each) and meet the regular expressions. All blobs enter the ledger.

Nulls: a null text is the empty blob; null paths and versions are kept. Repeated rows
each get a row and one entry. An empty table gives an empty result. A text is searched
whole in one row; its findings take about 100 bytes each. Columns of the versions other
than blob and findings are carried along, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

RULES_VERSION = "1"
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
FINDINGS = "array<struct<kind:string,start:int,end:int>>"
BLOBS, VERSIONS = f"blob string, rules string, findings {FINDINGS}", "path string, version string, blob string"


def find(text: str) -> list[tuple[str, int, int]]:
    """Findings as (kind, start, end) in code points, by start and then in the order of KINDS."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


def suspicious(text: Column) -> Column:
    """True for every text in which find() finds something, and for some others."""
    low = F.lower(text)
    test = text.contains("AKIA") | text.rlike("[0-9a-f]{32}")
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        test = test | low.contains(word)
    return test


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("blob"), pa.array(found, kind)], ["blob", "findings"])


class Ledger:
    """The tables of one ledger folder; opening an existing one goes on with it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _rows(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def blobs(self) -> DataFrame:
        return self._rows("blobs", BLOBS)

    def versions(self) -> DataFrame:
        return self._rows("versions", VERSIONS)

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    def history(self, rules: str = RULES_VERSION) -> DataFrame:
        """(path, version, blob, findings) of every version ever seen that has findings under these rules, also of paths whose present text has none."""
        hits = self.blobs().where((F.col("rules") == rules) & (F.size("findings") > 0)).select("blob", "findings").dropDuplicates(["blob"])
        return self.versions().join(hits, "blob")


def scan(versions: DataFrame, ledger: Ledger, text: str = "text", rules: str = RULES_VERSION, path: str | None = None, version: str | None = None) -> DataFrame:
    """The rows of versions with blob and findings (columns of these names are replaced); the ledger grows by the unseen pairs. With path (and version), it also learns which versions hold a blob."""
    base = versions.drop("blob", "findings")
    base = base.withColumn("blob", _blob(F.col(text)))
    found = _scanned(base, ledger, text, rules, path, version)
    return base.join(found, "blob", "left").withColumn("findings", F.coalesce("findings", F.array().cast(FINDINGS)))


def _blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _scanned(base: DataFrame, ledger: Ledger, text: str, rules: str, path: str | None = None, version: str | None = None) -> DataFrame:
    """(blob, findings) of the blobs that have findings, once the ledger knows all blobs of base."""
    known = ledger.blobs().where(F.col("rules") == rules).select("blob")
    one = base.select("blob", F.col(text).alias("text")).where(suspicious(F.col("text"))).dropDuplicates(["blob"]).join(known, "blob", "left_anti")
    hits = one.mapInArrow(_scan, f"blob string, findings {FINDINGS}").where(F.size("findings") > 0)
    step = Scratch(ledger.spark, "secrets-step")
    hits = step.save(hits, "hits")  # Spark knows its size: blobs with findings are few, those without need no partner
    new = base.select("blob").distinct().join(known, "blob", "left_anti").join(hits, "blob", "left")
    if path:
        cells = [F.col(c).cast("string").alias(k) if c else F.lit(None).cast("string").alias(k) for k, c in (("path", path), ("version", version))]
        seen = base.select(*cells, "blob").distinct()
        old = ledger.versions().select(*[F.col(c).alias(f"old_{c}") for c in ("path", "version", "blob")])
        seen = seen.join(old, [F.col("blob") == F.col("old_blob"), *[F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in ("path", "version")]], "left_anti")
        ledger.append("versions", seen)
    ledger.append("blobs", new.select("blob", F.lit(rules).alias("rules"), F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings")))
    step.drop()
    # A blob may stand twice where two scans ran at once.
    return ledger.blobs().where((F.col("rules") == rules) & (F.size("findings") > 0)).select("blob", "findings").dropDuplicates(["blob"])


def spans(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: str, findings: list, mark: str = "[secret]") -> str:
    """The text with every found span, overlapping ones together, replaced by the mark."""
    out, at = [], 0
    for start, end in merged([(f["start"], f["end"]) for f in findings]):
        out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def redacted(versions: DataFrame, ledger: Ledger, text: str = "text", rules: str = RULES_VERSION) -> DataFrame:
    """The versions' own columns, secrets in the text replaced. Only rows that may hold one are joined and moved."""
    own = F.struct(*[versions[c] for c in versions.columns]).alias("row")
    base = versions.select(own, versions[text].alias("text"))
    found = _scanned(base.select("text", _blob(F.col("text")).alias("blob")), ledger, "text", rules)
    maybe = F.coalesce(suspicious(F.col("text")), F.lit(False))
    dirty = base.where(maybe).withColumn("blob", _blob(F.col("text"))).join(found, "blob", "left").select("row", "text", "findings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [redact(t, f) if f else t for t, f in zip(b.column("text").to_pylist(), b.column("findings").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(new, pa.string())], ["row", "text"])

    kind = T.StructType([T.StructField("row", base.schema["row"].dataType), T.StructField("text", T.StringType())])
    out = base.where(~maybe).select("row", "text").unionByName(dirty.mapInArrow(run, kind))
    return out.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in versions.columns])
