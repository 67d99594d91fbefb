"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line stripped of ASCII white space and lower-cased A-Z, held
as 128 bits of hash. The ledger keeps, per key, the number of lines that refer
to it and the smallest and largest document holding it, plus the postings that
a deletion needs to find the next owner. Filters, one per shard of keys, tell
which keys of a batch are certainly new; only the others meet the exact tables.
Every decision is read from the exact tables, so a false positive costs a
lookup and nothing else.

Keys are grouped before they meet a shard, so shards hold distinct keys and a
line found in a third of all documents weighs no more than any other.

Null or empty texts are one empty line. Lines with keys shorter than ``least``
code points always stay. Rows that repeat a doc_id are one document; a null
doc_id orders after all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, table, unused
from .cuckoo import CuckooFilter

LEAST = 10
LAST = (1 << 63) - 1  # stands for a null id
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"

REFS = "hi long, lo long, refs long, owner long, last long"
FILTERS = "shard int, slots binary, stash binary"
POSTINGS = "doc long, hi long, lo long, n long"


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWERED)


def line_rows(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc, version, pos, hi, lo) for every line whose key is long enough.

    ``version`` is a hash of the text: rows that share an id may differ in text.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("version"),
        F.posexplode(F.transform(F.split(text, "\n"), key_of)).alias("pos", "key"),
    )
    rows = rows.where(F.char_length("key") >= least)
    return rows.select("doc", "version", "pos", F.xxhash64("key").alias("hi"), F.xxhash64(F.lit(1), "key").alias("lo"))


@dataclass(frozen=True)
class LineLedger:
    """refs and filters of ``shards`` shards, and the postings behind them."""

    refs: DataFrame
    filters: DataFrame
    postings: DataFrame
    shards: int
    least: int = LEAST

    @classmethod
    def empty(cls, spark: SparkSession, shards: int, least: int = LEAST) -> LineLedger:
        return cls(*(spark.createDataFrame([], s) for s in (REFS, FILTERS, POSTINGS)), shards, least)

    def insert(self, documents: DataFrame) -> LineLedger:
        """The ledger with more documents: new keys by the filters' word, the others after an exact lookup."""
        lines = line_rows(documents, self.least)
        batch = lines.groupBy("hi", "lo").agg(
            F.count("*").alias("refs"), F.min("doc").alias("owner"), F.max("doc").alias("last")
        )
        probed = saved(self._cogrouped(batch, _probed, f"{REFS}, maybe boolean"), "line-batch")
        fresh = probed.where(~F.col("maybe")).drop("maybe")
        met = probed.where("maybe").alias("k").join(self.refs.alias("r"), ["hi", "lo"], "left").select(
            "hi", "lo", (F.col("k.refs") + F.coalesce("r.refs", F.lit(0))).alias("refs"),
            F.least("k.owner", "r.owner").alias("owner"), F.greatest("k.last", "r.last").alias("last"),
            F.col("r.refs").isNotNull().alias("known"),
        )
        untouched = self.refs.join(probed.where("maybe"), ["hi", "lo"], "left_anti")
        # A key that only looked known gets its own mark as well, or deleting another key would hide it.
        new = fresh.unionByName(met.where(~F.col("known")).drop("known"))
        return LineLedger(
            untouched.unionByName(met.drop("known")).unionByName(fresh), self._cogrouped(new, _inserted, FILTERS),
            self.postings.unionByName(lines.groupBy("doc", "hi", "lo").agg(F.count("*").alias("n"))),
            self.shards, self.least,
        )

    def delete(self, doc_ids: DataFrame) -> LineLedger:
        """The ledger without the documents in ``doc_ids`` (one column, doc_id)."""
        gone = doc_ids.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc")).distinct()
        postings = self.postings.join(gone, "doc", "left_anti")
        touched = self.postings.join(gone, "doc", "left_semi").select("hi", "lo").distinct()
        left = postings.join(touched, ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(
            F.sum("n").alias("refs"), F.min("doc").alias("owner"), F.max("doc").alias("last")
        )
        vanished = self.refs.join(touched, ["hi", "lo"], "left_semi").join(left, ["hi", "lo"], "left_anti")
        refs = self.refs.join(touched, ["hi", "lo"], "left_anti").unionByName(left)
        return LineLedger(refs, self._cogrouped(vanished, _deleted, FILTERS), postings, self.shards, self.least)

    def resharded(self, shards: int) -> LineLedger:
        """The same ledger with filters built anew for another number of shards."""
        bare = replace(self, shards=shards, filters=self.filters.limit(0))
        return replace(bare, filters=bare._cogrouped(self.refs, _inserted, FILTERS))

    def _cogrouped(self, keys: DataFrame, work, schema: str) -> DataFrame:
        shard = F.pmod("hi", F.lit(self.shards)).cast("int")
        left = keys.withColumn("shard", shard).groupBy("shard")
        return left.cogroup(self.filters.groupBy("shard")).applyInArrow(work, schema)


def _held(keys: pa.Table, held: pa.Table) -> CuckooFilter:
    if held.num_rows:
        return CuckooFilter.loaded(held["slots"][0].as_py(), held["stash"][0].as_py())
    return CuckooFilter.sized(2 * keys.num_rows)


def _probed(keys: pa.Table, held: pa.Table) -> pa.Table:
    maybe = _held(keys, held).contains(keys["lo"].to_numpy())
    return keys.select(["hi", "lo", "refs", "owner", "last"]).append_column("maybe", pa.array(maybe, pa.bool_()))


def _stored(known: CuckooFilter, keys: pa.Table, held: pa.Table) -> pa.Table:
    shard = (keys if keys.num_rows else held)["shard"][0].as_py()
    slots, stash = known.stored()
    schema = pa.schema([("shard", pa.int32()), ("slots", pa.binary()), ("stash", pa.binary())])
    return pa.Table.from_pylist([{"shard": shard, "slots": slots, "stash": stash}], schema)


def _inserted(keys: pa.Table, held: pa.Table) -> pa.Table:
    known = _held(keys, held)
    known.insert(keys["lo"].to_numpy())
    return _stored(known, keys, held)


def _deleted(keys: pa.Table, held: pa.Table) -> pa.Table:
    known = _held(keys, held)
    known.delete(keys["lo"].to_numpy())
    return _stored(known, keys, held)


def ingested(documents: DataFrame, batches: int = 2, shards: int | None = None, least: int = LEAST) -> LineLedger:
    """A ledger filled with ``documents`` in increments split by a hash of their ids.

    ``shards`` follows the number of rows unless given, so that a shard's filter
    stays at tens of thousands of keys.
    """
    shards = shards or max(8, documents.count() // 2_000)
    ledger = LineLedger.empty(documents.sparkSession, shards, least)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    for k in range(batches):
        ledger = ledger.insert(documents.where(part == k))
    return ledger


def dropped_lines(documents: DataFrame, ledger: LineLedger) -> DataFrame:
    """(doc, version, pos) of lines whose key another, smaller document owns."""
    shared = ledger.refs.where(F.col("owner") < F.col("last")).select("hi", "lo", "owner")
    hits = line_rows(documents, ledger.least).join(shared, ["hi", "lo"])
    return hits.where(F.col("doc") > F.col("owner")).select("doc", "version", "pos")


def deduped(documents: DataFrame, ledger: LineLedger) -> DataFrame:
    """The rows of ``documents`` plus kept_text, n_lines and n_dropped, which replace columns of these names."""
    pos, doc, version = (unused(n, documents) for n in ("drop_pos", "drop_doc", "drop_version"))
    drops = dropped_lines(documents, ledger).groupBy("doc", "version").agg(F.collect_set("pos").alias(pos))
    drops = drops.withColumnsRenamed({"doc": doc, "version": version})
    own = (F.coalesce("doc_id", F.lit(LAST)) == F.col(doc)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(version))
    rows = documents.join(drops, own, "left").drop(doc, version)
    new = {"kept_text": T.StringType(), "n_lines": T.LongType(), "n_dropped": T.LongType()}
    held = [f for f in documents.schema if f.name not in new]
    schema = T.StructType([*held, *(T.StructField(n, t) for n, t in new.items())])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone = [], [], []
            for text, drops in zip(batch["text"], batch[pos], strict=True):
                lines = (text.as_py() or "").split("\n")
                out = set(drops.as_py() or ())
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in out) if out else text.as_py())
                counts.append(len(lines))
                gone.append(len(out))
            columns = {f.name: batch[f.name] for f in held} | {
                "kept_text": pa.array(texts, pa.string()), "n_lines": pa.array(counts, pa.int64()),
                "n_dropped": pa.array(gone, pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(drop, schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for all documents."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = deduped(documents, ingested(documents))
    digest = F.sha2(F.coalesce("kept_text", F.lit("")), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) <> max(doc_id)
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > s.owner, false) AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
