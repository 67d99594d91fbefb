"""Language identification by rank-order profiles.

A language's profile is the ranking of its most frequent letter n-grams (one to
three letters, words padded by boundaries) over all training documents. A text
is ranked the same way, and its language is the one whose profile is nearest by
out-of-place distance: the sum over the text's n-grams of how far each one's
rank is from its rank in the profile, ``SIZE`` where the profile lacks it.

Counting covers every character of every training text; tasks send one row per
(language, n-gram) they met. Profiles are a top-k report, ``SIZE`` rows per
language. Ties in counts go by code point, ties in distance by language name.

A null text and a text without a letter are ``und`` with score 0, as is every
text when nothing was learned. Rows with a null language are never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold, table

SIZE = 300
UNKNOWN = "und"
_END = (1 << 21) - 1  # fills the unused places of shorter n-grams; no code point
_DENSE = 100  # alphabets up to this size are counted in flat arrays
_tables: dict[str, np.ndarray] = {}


def _is_letter() -> np.ndarray:
    if "letter" not in _tables:
        _tables["letter"] = np.array([chr(c).isalpha() for c in range(0x110000)], bool)
    return _tables["letter"]


class Letters:
    """A batch of texts, lower-cased, as ranks in the batch's own alphabet; 0 is a boundary."""

    def __init__(self, texts: list[str | None]):
        lowered = [(t or "").lower() for t in texts]
        joined = "\n" + "\n".join(lowered) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        present = np.zeros(0x110000, bool)
        present[codes] = True
        self.alphabet = np.r_[0, np.flatnonzero(present & _is_letter())]
        ranks = np.zeros(0x110000, np.int32)
        ranks[self.alphabet[1:]] = np.arange(1, len(self.alphabet))
        self.codes = ranks[codes]
        self.starts = np.r_[0, np.cumsum([len(t) + 1 for t in lowered])]
        self.base = len(self.alphabet)

    def grams(self, row: int) -> np.ndarray:
        """All n-grams of a row as numbers in base ``self.base``; the order gives an offset of its own."""
        x = self.codes[self.starts[row] : self.starts[row + 1] + 1].astype(np.int64)
        b = self.base
        one = x[x > 0]
        two = x[:-1] * b + x[1:]
        two = two[two > 0]
        three = (x[:-2] * b + x[1:-1]) * b + x[2:]
        three = three[x[1:-1] > 0]
        return np.concatenate([one, two + b, three + b + b * b])

    def counted(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        grams = self.grams(row)
        if self.base <= _DENSE:
            counts = np.bincount(grams)
            some = np.flatnonzero(counts)
            return some, counts[some]
        return np.unique(grams, return_counts=True)

    def packed(self, grams: np.ndarray) -> np.ndarray:
        """Batch numbers as three code points of 21 bits, alike in every batch."""
        b, end = self.base, np.int64(_END)
        g = grams.astype(np.int64)
        point = lambda r: self.alphabet[r].astype(np.int64)
        out = np.empty(len(g), np.int64)
        one, three = g < b, g >= b + b * b
        two = ~one & ~three
        out[one] = point(g[one]) << 42 | end << 21 | end
        h = g[two] - b
        out[two] = point(h // b) << 42 | point(h % b) << 21 | end
        h = g[three] - b - b * b
        out[three] = point(h // (b * b)) << 42 | point(h // b % b) << 21 | point(h % b)
        return out


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of everything the task read."""
    held: dict[str, list] = {}

    def merged(parts: list) -> list:
        grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return [(grams, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64))]

    for batch in batches:
        langs, texts = batch["lang"].to_pylist(), batch["text"].to_pylist()
        for lo in range(0, len(texts), 256):
            part = Letters(texts[lo : lo + 256])
            for row in range(len(part.starts) - 1):
                grams, n = part.counted(row)
                if len(grams):
                    held.setdefault(langs[lo + row], []).append((part.packed(grams), n))
            for lang, parts in held.items():
                if len(parts) > 64:
                    held[lang] = merged(parts)
    for lang, parts in held.items():
        [(grams, n)] = merged(parts)
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array([lang] * len(grams), pa.string()), "gram": pa.array(grams), "n": pa.array(n)}
        )


def profiles(training: DataFrame, size: int = SIZE) -> DataFrame:
    """(lang, gram, place): the ``size`` most frequent n-grams of each language, from place 0."""
    known = training.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = known.mapInArrow(gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    return counts.withColumn("place", place - 1).where(F.col("place") < size).select("lang", "gram", "place")


class RankProfiles:
    """Profiles as arrays: the n-grams of all of them in order, and each language's rank of each."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = SIZE):
        self.size = size
        self.langs = sorted({lang for lang, _, _ in rows})
        self.grams = np.unique(np.array([g for _, g, _ in rows], np.int64))
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, np.int32)  # the last column: not in any
        at = {lang: i for i, lang in enumerate(self.langs)}
        for lang, gram, place in rows:
            self.ranks[at[lang], np.searchsorted(self.grams, gram)] = place

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found, scores = [], []
        letters = Letters(texts)
        for row in range(len(texts)):
            grams, n = letters.counted(row)
            if not len(grams) or not self.langs:
                found.append(UNKNOWN)
                scores.append(0.0)
                continue
            top = grams[np.argsort(-n, kind="stable")[: self.size]]
            packed = letters.packed(top)
            at = np.minimum(np.searchsorted(self.grams, packed), len(self.grams) - 1)
            ranks = self.ranks[:, np.where(self.grams[at] == packed, at, len(self.grams))]
            apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top))))
            total = apart.sum(1)
            best = int(total.argmin())
            found.append(self.langs[best])
            scores.append(1 - float(total[best]) / (self.size * len(top)))
        return found, scores


def learned(training: DataFrame, size: int = SIZE) -> RankProfiles:
    """Profiles of every language in ``training``; the driver gets ``size`` rows per language."""
    return RankProfiles([tuple(r) for r in profiles(training, size).collect()], size)


def identified(documents: DataFrame, known: RankProfiles) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; only the text is looked at."""

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for lo in range(0, len(texts), 256):
                langs, scores = known.predict(texts[lo : lo + 256])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch["doc_id"][lo : lo + 256], "lang_pred": pa.array(langs, pa.string()),
                    "score": pa.array(scores, pa.float64()),
                })

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(identify, "doc_id long, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for all documents, learned from those outside fold 0."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = learned(documents.where(fold(F.col("doc_id")) != 0))
    rows = identified(documents, known)
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
