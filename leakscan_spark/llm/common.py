"""Shared pieces of the training-data operators: byte-level text views, hashes, saved steps, bounded samples.

Texts arrive in tasks as Arrow batches. ``utf8`` views a text column as one byte
array with offsets, so words, shingles and windows are found with numpy over a
few megabytes at a time instead of row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

# The characters that separate words, and the pattern of a word.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

SEPARATOR = np.zeros(256, bool)
SEPARATOR[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Bytes that a task looks at together; a longer text is a block of its own. Working arrays take some 80 bytes for
# each, which every worker of an executor keeps for later: 160 MB at 2 MB, 32 MB at 512 KB, in the same CPU time.
BLOCK = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, df: DataFrame) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """Write a step below ``spark.checkpoint.dir`` and read it back.

    Cuts lineage in a folder that every executor sees, so a lost executor costs
    only the tasks it was running.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets in them; null counts as empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds.astype(np.int64)


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; every row is whole and in one range."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def text_blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for each block of rows."""
    data, offsets = utf8(column)
    for lo, hi in blocks(offsets, limit):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


class Words:
    """Words of a block: byte starts and ends, each row's range of words, and 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        n = len(data)
        solid = ~SEPARATOR[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.ones(n, bool)
        before[1:] = ~solid[:-1]
        after = np.ones(n, bool)
        after[:-1] = ~solid[1:]
        self.starts = np.flatnonzero(solid & (before | edge[:n]))
        self.ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.rows = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hashes = spans(LOWER[data] if lower else data, self.starts, self.ends)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each run of ``n`` words inside one row."""
        count = len(self.hashes)
        if count < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.rows[: count - n + 1] == self.rows[n - 1 :])
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = h * _BASE + self.hashes[at + k]
        return mixed(h), at


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def word_count(text: Column) -> Column:
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``folds``. A null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, most: int, *keep: Column) -> DataFrame:
    """(text, y) of at most ``most`` labelled documents outside fold 0, picked by a hash of their ids.

    ``most`` bounds what a fit reads, so the ids can be broadcast; repeated
    label rows count once, with their largest label.
    """
    picked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id").agg(F.max(label).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *keep)
    return rows.join(F.broadcast(picked), "doc_id").drop("doc_id")


def span_digests(base: tuple[str, ...], base_spans: str = "spans") -> list[Column]:
    """A count per base kind, the hash of the base spans, and all of ``spans`` as text.

    Spans are structs (kind, start, end) already in order; base spans are those of a base kind in ``base_spans``.
    """
    kind = "array<struct<kind:string,start:long,end:long>>"
    held = lambda name: F.coalesce(F.col(name), F.array().cast(kind))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, text), ",")
    of_kind = lambda k: F.filter(held(base_spans), lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in base]
    in_base = F.filter(held(base_spans), lambda s: s["kind"].isin(*base))
    return [*counts, F.sha2(joined(in_base), 256).alias("base_sha256"), joined(held("spans")).alias("spans")]
