"""Quality rules: counting rules, then a calibrated n-gram logistic regression against a fixed threshold.

Words, word pairs and runs of four characters are hashed into one histogram per
document, each family normalised to shares, so a document of any length is
scored whole with one table look-up per n-gram. The regression is fitted on the
driver from a bounded sample of labelled rows (``SAMPLE``), held as sparse rows;
a logistic calibration on a held part of that sample maps scores to probabilities.

Null and empty texts have no words: all counts are 0, the base rule fails and
the probability is that of an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATOR, Words, labelled_sample, mixed, spans, table, text_blocks

BITS = 16  # buckets per family, as a power of two
FAMILIES = 3
CHARACTERS = 4  # length of a character n-gram
SAMPLE = 4_000  # labelled rows a fit may read
BATCH = 250  # sampled rows per step of the fit
KEEP_FROM = 0.35  # fixed threshold on the calibrated probability of quality 1
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of words in repeated windows

# Fixed value: characters that count as symbols.
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def base_counts(data: np.ndarray, offsets: np.ndarray, words: Words | None = None) -> dict[str, np.ndarray]:
    """Per row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    rows, n = len(offsets) - 1, len(data)
    words = words or Words(data, offsets, lower=False)
    sums = lambda flags: np.diff(np.r_[0, np.cumsum(flags)][offsets])
    first_bytes = (data & 0xC0) != 0x80
    grams, at = words.grams(3)
    rows_of = words.rows[at]
    key = mixed(grams ^ mixed(rows_of.astype(np.uint64)))
    _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
    repeated = at[counts[which] > 1] if len(at) else at
    covered = np.zeros(len(words.starts) + 3, bool)
    for k in range(3):
        covered[repeated + k] = True
    # Lines end at \n and at the end of a row.
    newline = np.flatnonzero(data == 10)
    begins = np.union1d(offsets[:-1], newline + 1)
    begins = begins[begins < n]
    line_rows = np.searchsorted(offsets, begins, "right") - 1
    ends = np.minimum(np.r_[newline, n][np.searchsorted(newline, begins)], offsets[line_rows + 1])
    inked = np.r_[0, np.cumsum(~SEPARATOR[data])]
    solid = inked[ends] > inked[begins]
    begins, ends, line_rows = begins[solid], ends[solid], line_rows[solid]
    lines = mixed(spans(data, begins, ends) ^ mixed(line_rows.astype(np.uint64)))
    later = np.ones(len(lines), bool)
    later[np.unique(lines, return_index=True)[1]] = False
    return {
        "n_words": np.diff(words.first),
        "word_chars": sums(first_bytes & ~SEPARATOR[data]),
        "n_symbols": sums(SYMBOL[data]),
        "n_dup_lines": np.bincount(line_rows[later], minlength=rows),
        "n_repeat_words": np.bincount(words.rows[covered[: len(words.rows)]], minlength=rows),
    }


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One number per code point, which is its bytes, and each row's first code point."""
    leads = (data & 0xC0) != 0x80
    leads[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(leads)
    size = np.diff(at, append=len(data))
    codes = data[at].astype(np.uint64)
    for k in range(1, 4):
        longer = size > k
        codes[longer] |= data[at[longer] + k].astype(np.uint64) << np.uint64(8 * k)
    return codes, np.searchsorted(at, offsets)


def features(data: np.ndarray, offsets: np.ndarray, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family: buckets of all n-grams, and each row's first n-gram."""
    shift = np.uint64(64 - BITS)
    yield (words.hashes >> shift).astype(np.int32), words.first
    pairs, at = words.grams(2)
    yield (pairs >> shift).astype(np.int32), np.searchsorted(at, words.first)
    codes, first = characters(data, offsets)
    many = max(len(codes) - CHARACTERS + 1, 0)
    h = np.zeros(many, np.uint64)
    for k in range(CHARACTERS):
        h = mixed(h ^ codes[k : k + many])
    inside = np.ones(many, bool)
    for k in range(1, CHARACTERS):
        crossing = first[1:-1] - k  # n-grams that reach into the next row
        inside[crossing[(crossing >= 0) & (crossing < many)]] = False
    count = np.r_[0, np.cumsum(inside)]
    yield (h[inside] >> shift).astype(np.int32), count[np.minimum(first, many)]


SPARSE = "y int, id binary, sizes binary, at binary, n binary"
MOST = (1 << 16) - 1  # a larger count is several entries of its bucket


def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each sampled row its label, a digest, the entries per family, their buckets, and their counts, in 16 bits each."""
    for batch in batches:
        for lo, hi, data, offsets in text_blocks(batch["text"]):
            families = list(features(data, offsets, Words(data, offsets, lower=False)))
            out: dict[str, list[bytes]] = {"id": [], "sizes": [], "at": [], "n": []}
            for row in range(hi - lo):
                own = [np.unique(b[first[row] : first[row + 1]], return_counts=True) for b, first in families]
                own = [(np.r_[b, np.repeat(b, n // MOST)], np.r_[n % MOST, np.full((n // MOST).sum(), MOST)]) for b, n in own]
                out["sizes"].append(np.array([len(b) for b, _ in own], "<i4").tobytes())
                out["at"].append(np.concatenate([b for b, _ in own]).astype("<u2").tobytes())
                out["n"].append(np.concatenate([n for _, n in own]).astype("<u2").tobytes())
                out["id"].append(blake2b(out["sizes"][-1] + out["at"][-1] + out["n"][-1], digest_size=16).digest())
            y = {"y": batch["y"][lo:hi].cast(pa.int32())}
            yield pa.RecordBatch.from_pydict(y | {k: pa.array(v, pa.binary()) for k, v in out.items()})


@dataclass(frozen=True)
class QualityModel:
    """Weights by family and bucket, and the calibration a * score + b."""

    weights: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0

    def probability(self, data: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
        score = np.full(len(offsets) - 1, self.bias)
        for k, (buckets, first) in enumerate(features(data, offsets, words)):
            sums = np.r_[0.0, np.cumsum(self.weights[k][buckets], dtype=float)]
            score += (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)
        return 1 / (1 + np.exp(-np.clip(self.a * score + self.b, -30, 30)))


class Sparse:
    """Rows of (bucket, share) pairs, as the columns ``sizes``, ``at`` and ``n`` of ``histograms`` hold them."""

    def __init__(self, rows: pa.Table, order: np.ndarray):
        flat = lambda name, kind: np.concatenate(
            [np.frombuffer(v.as_buffer(), kind) for v in rows[name]] or [np.zeros(0, kind)]
        )
        self.sizes = flat("sizes", "<i4").reshape(-1, FAMILIES)
        self.at, self.n = flat("at", "<u2"), flat("n", "<u2")
        self.first = np.r_[0, np.cumsum(self.sizes.sum(1))]
        self.order = order

    def __len__(self) -> int:
        return len(self.order)

    def part(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets over all families, shares and row numbers from 0 of the rows ``lo`` to ``hi`` in order."""
        own = self.order[lo:hi]
        joined = lambda values: np.concatenate([values[self.first[r] : self.first[r + 1]] for r in own])
        group = np.repeat(np.arange(FAMILIES * len(own)), self.sizes[own].ravel())
        n = joined(self.n)
        total = np.bincount(group, n, FAMILIES * len(own))
        return joined(self.at) + ((group % FAMILIES) << BITS), n / total[group], group // FAMILIES

    def scores(self, w: np.ndarray) -> np.ndarray:
        out = []
        for lo in range(0, len(self), BATCH):
            hi = min(lo + BATCH, len(self))
            at, x, row = self.part(lo, hi)
            out.append(np.bincount(row, x * w[at], hi - lo))
        return np.concatenate(out)


def sigmoid(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def fit_logistic(rows: Sparse, y: np.ndarray, used: np.ndarray, ridge: float, passes: int) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over blocks of ``BATCH`` rows, of which the ``used`` ones count; the bias is not shrunk."""
    w, b = np.zeros(FAMILIES << BITS, np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    t = 0
    for turn in range(passes):
        rate = 0.5 * (1 - turn / passes)
        for lo in range(0, len(y), BATCH):
            hi = min(lo + BATCH, len(y))
            own = used[lo:hi]
            if not own.any():
                continue
            at, x, row = rows.part(lo, hi)
            e = (sigmoid(np.bincount(row, x * w[at], hi - lo) + b) - y[lo:hi]) * own / own.sum()
            g = np.r_[np.bincount(at, x * e[row], len(w)) + ridge * w, e.sum()]
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            w, b = (w - step[:-1]).astype(np.float32), b - step[-1]
    return w, float(b)


def calibration(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a and b of the logistic line a * score + b that fits ``y`` best, by Newton's steps; a is positive."""
    scale = max(float(np.abs(score).max()), 1e-6)
    x = np.c_[score / scale, np.ones(len(score))]
    line = np.zeros(2)
    for _ in range(50):
        p = sigmoid(x @ line)
        slope = x.T @ (p - y) / len(y) + 1e-3 * line
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(y) + 1e-3 * np.eye(2)
        line -= np.linalg.solve(bend, slope)
    return max(float(line[0]) / scale, 1e-3), float(line[1])


def fit(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> QualityModel:
    """Fit and calibrate on at most ``most`` labelled rows; without two classes every text scores alike."""
    sample = labelled_sample(documents, labels, "quality", most)
    found = sample.mapInArrow(histograms, SPARSE).toArrow()
    y = np.array(found["y"].to_pylist(), float) > 0
    ids = found["id"].to_pylist()
    order = np.array(sorted(range(len(y)), key=lambda i: (ids[i], y[i])), int)  # the same fit however the rows arrive
    y = y[order].astype(float)
    weights = np.zeros((FAMILIES, 1 << BITS), np.float32)
    if len(set(y)) < 2:
        return QualityModel(weights, 3.0 if not len(y) or y[0] else -3.0)
    rows = Sparse(found, order)
    del found
    held = np.arange(len(y)) % 4 == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    w, bias = fit_logistic(rows, y, ~held, 1e-6, 20)
    a, b = calibration(rows.scores(w)[held] + bias, y[held]) if held.any() else (1.0, 0.0)
    return QualityModel(w.reshape(FAMILIES, -1), bias, a, b)


def judged(documents: DataFrame, model: QualityModel, keep_from: float = KEEP_FROM) -> DataFrame:
    """(doc_id, counts, base_failed, probability, kept) for every row."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch["text"]):
                words = Words(data, offsets, lower=False)
                counts = base_counts(data, offsets, words)
                p = model.probability(data, offsets, words)
                n, repeated = counts["n_words"], counts["n_repeat_words"]
                failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch["doc_id"][lo:hi]}
                    | {k: pa.array(v.astype(np.int64)) for k, v in counts.items()}
                    | {"base_failed": pa.array(failed), "probability": pa.array(p), "kept": pa.array(~failed & (p >= keep_from))}
                )

    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, probability double, kept boolean"
    )
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, schema)


def passing(documents: DataFrame, model: QualityModel, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``documents`` that pass, all columns kept."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch["text"]):
                words = Words(data, offsets, lower=False)
                counts = base_counts(data, offsets, words)
                ok = (counts["n_words"] >= LEAST_WORDS) & (
                    100 * counts["n_repeat_words"] <= MOST_REPEATED * counts["n_words"]
                )
                ok &= model.probability(data, offsets, words) >= keep_from
                yield batch.slice(lo, hi - lo).filter(pa.array(ok))

    return documents.mapInArrow(select, documents.schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept and probability for all documents."""
    documents = table(spark, sf_dir, "documents")
    return judged(documents, fit(documents, table(spark, sf_dir, "labels")))
