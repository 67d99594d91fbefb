"""Benchmark decontamination: word pairs as a filter that loses nothing, Smith-Waterman alignment as the judge.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased, so
changed punctuation or case is no edit. A seed is two words of an item with at
most one word between them. Let an item of ``m`` words align with ``M`` matches
and ``E`` edits at ``least``, so 2M - E >= 2 least m. At most E / 2 of the M - 1
steps from a match to the next have two edits or more, so least m - 1 steps have
one at most, and those are seeds in the document, wherever the edits are. It
spans at most (3 - 2 least) m words. A document is aligned to an item where so
many seeds are that near, hence every document at ``least`` is found, whatever
the corpus. To meet fewer seeds by chance, up to all but ``HITS`` of the needed
number may be left out of an item, commonest first and only common ones; the
needed number falls by as many.

The benchmark is taken in blocks of bounded size (``BLOCK_CHARS``), one pass
over the corpus each, so what a task holds does not grow with it. Items of fewer
than ``SHORTEST`` words are in no document. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SEPARATOR, Words, mixed, table, text_blocks

SHORTEST = 3
REACH = 2  # words from the first of a seed to its second, at most
RARE = 1_000  # a seed met at most once in so many documents is rare,
FEW = 20  # and so is one met at most so often
HITS = 3
MOST = 1 << 21  # seeds met that are looked at together; those of one text are never parted
MATCH, MISMATCH, GAP = 2, -1, -1
CONTAMINATED = 0.5
BLOCK_CHARS = 4_000_000

_ODD = np.uint64(0x9E3779B97F4A7C55)
_APART = SEPARATOR.copy()
_APART[[c for c in range(128) if not chr(c).isalnum()]] = True
_SPACED = np.where(_APART, 32, LOWER).astype(np.uint8)


def plain_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(_SPACED[data], offsets, lower=False)


def pairs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every two words of a row at most ``REACH`` apart."""
    hashes, at = [], []
    for far in range(1, REACH + 1):
        first = np.flatnonzero(words.rows[:-far] == words.rows[far:])
        hashes.append(mixed(words.hashes[first] * _ODD + words.hashes[first + far]))
        at.append(first)
    return np.concatenate(hashes), np.concatenate(at)


class Items:
    """A block of benchmark items: word hashes, and which item and place each seed comes from."""

    def __init__(self, ids: list, texts: list[str | None], least: float):
        self.ids = ids
        encoded = [(t or "").encode() for t in texts]
        data = np.frombuffer(b"".join(encoded), np.uint8)
        words = plain_words(data, np.r_[0, np.cumsum([len(e) for e in encoded])].astype(np.int64))
        self.words = [words.hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        size = np.diff(words.first)
        self.matched = np.ceil(least * size - 1e-9).astype(np.int64)  # words that match in any alignment at ``least``
        self.needed = np.maximum(self.matched - 1, 1)
        self.span = np.ceil((3 - 2 * least) * size).astype(np.int64)
        hashes, at = pairs(words)
        hashes, at = (x[size[words.rows[at]] >= SHORTEST] for x in (hashes, at))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item = hashes[order], words.rows[at][order]
        self.place = (at - words.first[words.rows[at]])[order]
        self.grams = np.unique(self.hashes)

    def seeds(self, frequency: np.ndarray, documents: int) -> Items:
        """The same items without common seeds where enough others stay. frequency: how often each of ``self.grams`` is met."""
        often = frequency[np.searchsorted(self.grams, self.hashes)]
        step, of = np.unique(np.c_[self.item, self.place], axis=0, return_inverse=True)
        met = np.bincount(of.ravel(), often, len(step))
        common = np.flatnonzero(met > max(FEW, documents // RARE))
        common = common[np.lexsort((-met[common], step[common, 0]))]
        owner = step[common, 0]
        nth = np.arange(len(common)) - np.searchsorted(owner, owner)  # of its item, commonest first
        spare = np.maximum(self.needed - HITS, 0)
        left_out = np.zeros(len(step), bool)
        left_out[common[nth < spare[owner]]] = True
        keep = ~left_out[of.ravel()]
        chosen = Items.__new__(Items)
        chosen.ids, chosen.words, chosen.matched, chosen.span = self.ids, self.words, self.matched, self.span
        chosen.needed = self.needed - np.bincount(step[left_out, 0], minlength=len(self.needed))
        chosen.hashes, chosen.item, chosen.place = self.hashes[keep], self.item[keep], self.place[keep]
        chosen.grams = np.unique(chosen.hashes)
        return chosen

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], float]:
        """(row, item number) to the best score, for rows with as many seeds of the item as it needs."""
        words = plain_words(data, offsets)
        best: dict[tuple[int, int], float] = {}
        if not len(self.grams):
            return best
        hashes, at = pairs(words)
        lo = np.searchsorted(self.hashes, hashes)
        hit = np.flatnonzero(self.hashes[np.minimum(lo, len(self.hashes) - 1)] == hashes)
        if not len(hit):
            return best
        hit = hit[np.argsort(at[hit], kind="stable")]
        lo, at = lo[hit], at[hit]
        n = np.searchsorted(self.hashes, hashes[hit], "right") - lo
        upto = np.r_[0, np.cumsum(np.bincount(words.rows[at], n, len(offsets) - 1))]  # seeds met up to each row
        part = (upto[words.rows[at]] // MOST).astype(np.int64)
        ends = np.flatnonzero(np.r_[part[1:] != part[:-1], True]) + 1
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            for r, i, left, right in self.windows(words, lo[a:b], n[a:b], at[a:b]):
                window = words.hashes[left:right]
                if np.isin(self.words[i], window).sum() >= self.matched[i]:
                    score = alignment(self.words[i], window) / (MATCH * len(self.words[i]))
                    best[r, i] = max(best.get((r, i), 0.0), score)
        return best

    def windows(self, words: Words, lo: np.ndarray, n: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item number, first word, end) where an item may align. ``n`` seeds from ``lo`` on are met at each of ``at``."""
        item = self.item[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        place = np.repeat(at, n)
        order = np.lexsort((place, item, words.rows[place]))
        item, place = item[order], place[order]
        once = np.r_[True, (place[1:] != place[:-1]) | (item[1:] != item[:-1])]
        item, place = item[once], place[once]
        row = words.rows[place]
        start = np.arange(len(place))
        end = start + self.needed[item] - 1
        start, end = start[end < len(place)], end[end < len(place)]
        near = (row[end] == row[start]) & (item[end] == item[start]) & (place[end] - place[start] < self.span[item[start]])
        start, end = start[near], end[near]
        row, item = row[start], item[start]
        left = np.maximum(place[start] - self.span[item], words.first[row])
        right = np.minimum(place[end] + self.span[item] + 1, words.first[row + 1])
        apart = np.flatnonzero((row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (left[1:] > right[:-1])) + 1
        firsts, lasts = np.r_[0, apart], np.r_[apart, len(start)] - 1
        if len(start):
            yield from zip(row[firsts].tolist(), item[firsts].tolist(), left[firsts].tolist(), right[lasts].tolist(), strict=True)


def alignment(item: np.ndarray, window: np.ndarray) -> int:
    """The Smith-Waterman score of two word sequences; a row at a time, gaps along it by a running maximum."""
    steps = np.arange(len(window)) * GAP
    above = np.zeros(len(window) + 1, np.int64)
    best = 0
    for word in item:
        met = np.maximum(above[:-1] + np.where(window == word, MATCH, MISMATCH), above[1:] + GAP)
        row = np.maximum(np.maximum.accumulate(np.maximum(met, 0) - steps) + steps, 0)
        best = max(best, int(row.max(initial=0)))
        above[1:] = row
    return best


def item_blocks(benchmark: DataFrame, least: float, most: int = BLOCK_CHARS) -> Iterator[Items]:
    """The benchmark in blocks of about ``most`` characters; each block is read when it is its turn."""
    rows = benchmark.select("item_id", "text")
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    count = int(total // most) + 1
    for k in range(count):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).orderBy("item_id", "text").collect()
        yield Items([r["item_id"] for r in block], [r["text"] for r in block], least)


def seeded(documents: DataFrame, items: Items) -> Broadcast:
    """The block with its common seeds left out, for all tasks."""
    context = documents.sparkSession.sparkContext
    grams = context.broadcast(items.grams)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = grams.value
        found, rows = np.zeros(len(known), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, data, offsets in text_blocks(batch["text"]):
                words = plain_words(data, offsets)
                hashes, _ = pairs(words)
                if len(hashes) and len(known):
                    where = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    found += np.bincount(where[known[where] == hashes], minlength=len(known))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(np.r_[-1, some]), "n": pa.array(np.r_[rows, found[some]])})

    counts = documents.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    frequency, total = np.zeros(len(items.grams), np.int64), 0
    for gram, n in counts.collect():  # at most one row per seed of the block
        if gram < 0:
            total = n
        else:
            frequency[gram] = n
    return context.broadcast(items.seeds(frequency, total))


def matches(documents: DataFrame, benchmark: DataFrame, least: float = CONTAMINATED) -> DataFrame:
    """(doc_id, item_id, score) of every document and item aligned at ``least`` or better."""
    kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = documents.sparkSession.createDataFrame([], f"doc_id long, item_id {kind}, score double")
    for items in item_blocks(benchmark, least):
        block = seeded(documents, items)

        def align(batches: Iterator[pa.RecordBatch], block: Broadcast = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, found = batch["doc_id"], []
                for lo, _, data, offsets in text_blocks(batch["text"]):
                    found += [(ids[lo + r].as_py(), block.value.ids[i], s) for (r, i), s in block.value.scores(data, offsets).items() if s >= least]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("doc_id", "item_id", "score"), p, strict=True)) for p in found], schema
                )

        schema = pa.schema([("doc_id", pa.int64()), ("item_id", item_type(kind)), ("score", pa.float64())])
        found = found.unionByName(rows.mapInArrow(align, f"doc_id long, item_id {kind}, score double"))
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def item_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def clean(documents: DataFrame, benchmark: DataFrame, least: float = CONTAMINATED) -> DataFrame:
    """The rows of ``documents`` in which no item aligns at ``least`` or better; nothing is joined or moved."""
    left = documents
    for items in item_blocks(benchmark, least):
        block = seeded(documents, items)

        def select(batches: Iterator[pa.RecordBatch], block: Broadcast = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = np.ones(batch.num_rows, bool)
                for lo, _, data, offsets in text_blocks(batch["text"]):
                    for (r, _), score in block.value.scores(data, offsets).items():
                        ok[lo + r] &= score < least
                yield batch.filter(pa.array(ok))

        left = left.mapInArrow(select, documents.schema)
    return left


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score of all contaminated documents."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
