"""Incremental secret scans over a blob ledger.

Every historical version of every path is addressed by the SHA-256 of its
content. The ledger records which (blob, rule, rule version) pairs have been
scanned and what was found; an increment scans only unseen pairs, so an
unchanged or copied file costs nothing, and a changed rule rescans with that
rule alone. Findings belong to blobs and are joined back to all paths.

Rules run on UTF-8 bytes (every class in them is ASCII) and report code points.
A null text is the empty blob. Overlapping spans of different rules all stay.
Repeated rows, ties in path and version, and null paths keep one row each in
``located``; other columns of ``versions`` are not read, whatever their names.
An empty table scans nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, span_digests, table, utf8

SCANNED = "blob string, rule string, rule_version int"
FINDINGS = "blob string, rule string, start long, end long"


@dataclass(frozen=True)
class SecretRule:
    """One kind of secret: matches of ``pattern`` whose group ``part`` has at least ``least`` bytes.

    ``lower`` patterns see the text with A-Z lower-cased.
    """

    kind: str
    version: int
    pattern: bytes
    least: int = 0
    part: int = 0
    lower: bool = False


# The kinds in reporting order; assign, access and hex are the base.
RULES = (
    SecretRule(
        "assign", 1,
        rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2, True,
    ),
    SecretRule("access", 1, rb"AKIA[A-Z0-9]+", 16),
    SecretRule("hex", 1, rb"[0-9a-f]{32,}"),  # a run of 32 or more is found whole
    SecretRule("pem", 2, rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("github", 2, rb"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", 2, rb"xox[abprs]-[A-Za-z0-9-]{20,}"),
    # From the start of a run, so that a long run is read once.
    SecretRule("jwt", 2, rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
BASE = ("assign", "access", "hex")
_compiled = {r: re.compile(r.pattern) for r in RULES}


def secret_spans(content: bytes, rules: tuple[SecretRule, ...]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then in the order of ``rules``."""
    found, lowered = [], None
    for order, rule in enumerate(rules):
        if rule.lower and lowered is None:
            lowered = content.lower()
        for m in (_compiled.get(rule) or re.compile(rule.pattern)).finditer(lowered if rule.lower else content):
            if m.end(rule.part) - m.start(rule.part) >= rule.least:
                found.append((m.start(), order, m.end(), rule.kind))
    if not found:
        return []
    found.sort()
    spans, at, points = [], 0, 0
    for start, _, end, kind in found:
        points += len(content[at:start].decode("utf-8", "replace")) if start > at else 0
        at = start
        spans.append((kind, points, points + end - start))  # matches are ASCII
    return spans


@dataclass(frozen=True)
class SecretLedger:
    scanned: DataFrame
    findings: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> SecretLedger:
        return cls(spark.createDataFrame([], SCANNED), spark.createDataFrame([], FINDINGS))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> SecretLedger:
        return cls(spark.read.parquet(f"{path}/scanned"), spark.read.parquet(f"{path}/findings"))

    def write(self, path: str) -> None:
        """Into a new folder: the one this ledger was read from stays as it is."""
        self.scanned.write.parquet(f"{path}/scanned")
        self.findings.write.parquet(f"{path}/findings")

    def advance(self, versions: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> SecretLedger:
        """The ledger after scanning what it has not seen of ``versions`` (path, version, text).

        The scan runs here, once, and its results lie below ``spark.checkpoint.dir``.
        """
        results = saved(scan_pending(pending(versions, self.scanned, rules), rules), "secret-scan")
        scanned = results.select("blob", F.explode("todo").alias("rule")).select(
            "blob", F.substring_index("rule", "@", 1).alias("rule"),
            F.substring_index("rule", "@", -1).cast("int").alias("rule_version"),
        )
        renewed = scanned.select("blob", "rule")
        found = results.select("blob", F.explode("spans").alias("s")).select(
            "blob", F.col("s.kind").alias("rule"), "s.start", "s.end"
        )
        kept = self.findings.join(renewed, ["blob", "rule"], "left_anti")  # an older version's findings go
        return SecretLedger(self.scanned.unionByName(scanned), kept.unionByName(found))


def addressed(versions: DataFrame) -> DataFrame:
    """``versions`` with the blob each one holds."""
    return versions.withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256))


def pending(versions: DataFrame, scanned: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(blob, text, todo): each distinct blob with the rule versions it has not met."""
    wanted = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    blobs = addressed(versions.select("text")).groupBy("blob").agg(F.first("text").alias("text"))
    seen = scanned.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "rule_version")).alias("seen"))
    todo = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    joined = blobs.join(seen, "blob", "left").select("blob", "text", todo.alias("todo"))
    return joined.where(F.size("todo") > 0)


def scan_pending(blobs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(blob, todo, spans): every blob scanned with its unseen rules."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch["text"])
            spans = []
            for i, names in enumerate(batch["todo"].to_pylist()):
                chosen = tuple(r for r in rules if f"{r.kind}@{r.version}" in names)
                found = secret_spans(data[at[i] : at[i + 1]].tobytes(), chosen)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            yield pa.RecordBatch.from_pydict(
                {"blob": batch["blob"], "todo": batch["todo"], "spans": pa.array(spans, span)}
            )

    schema = "blob string, todo array<string>, spans array<struct<kind:string,start:long,end:long>>"
    return blobs.mapInArrow(scan, schema)


def located(versions: DataFrame, findings: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(path, version, blob, spans): every row of ``versions`` with the findings of its blob.

    Spans are structs (kind, start, end) by start, then in the order of ``rules``; null where there are none.
    A blob's findings come together before they meet its paths, so copies cost one narrow row each.
    """
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    ranked = F.struct("start", F.array_position(kinds, F.col("rule")).alias("place"), "end", F.col("rule").alias("kind"))
    bare = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    spans = F.transform(F.array_sort(F.collect_list(ranked)), bare)
    held = findings.groupBy("blob").agg(spans.alias("spans"))
    return addressed(versions).select("path", "version", "blob").join(held, "blob", "left").select(
        "path", "version", "blob", "spans"
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for all documents, in two increments of one ledger.

    A hash of the id deals documents to increments: texts that the first one has met are not scanned again.
    """
    documents = table(spark, sf_dir, "documents")
    versions = documents.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text")
    late = F.pmod(F.xxhash64("path"), F.lit(2)) == 1
    ledger = SecretLedger.empty(spark).advance(versions.where(~late)).advance(versions.where(late))
    return located(versions, ledger.findings).select(F.col("path").alias("doc_id"), *span_digests(BASE))
