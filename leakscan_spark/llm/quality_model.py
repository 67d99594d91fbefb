"""Quality classifier: random-indexing word vectors, pooled per document, under a small network.

Words fall into 2**BITS buckets by hash. Each bucket has a sparse random index
vector; a bucket's word vector adds up the index vectors of the words around
all its occurrences in the whole corpus. Tasks add up their own share and send
one matrix, summed by row ranges, so what is gathered follows the input's
tasks and is never larger than the matrix times their number.

A document is the mean and the spread of its words' vectors and the mean
product of neighbouring ones. A network with one
hidden layer, written in numpy, is fitted to a bounded sample of labelled rows
(``SAMPLE``); a temperature chosen on a held part of it calibrates the scores.

Null and empty texts are the zero vector and get that vector's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, fold, labelled_sample, table, text_blocks

BITS = 13
DIM = 48
POOLED = 3 * DIM
NONZERO = 4
WINDOW = 2
HIDDEN = 24
SAMPLE = 6_000  # labelled rows a fit may read
THRESHOLD = 0.3
RANGES = 32
SMALL = 1 << 18  # bytes looked at together: one vector per word is held


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's nonzero entries."""
    rng = np.random.default_rng(20)
    places = np.argsort(rng.random((1 << BITS, DIM)), axis=1)[:, :NONZERO]
    return places, rng.choice([-1.0, 1.0], (1 << BITS, NONZERO))


def buckets(words: Words) -> np.ndarray:
    return (words.hashes >> np.uint64(64 - BITS)).astype(np.int64)


def context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, sums): the task's sum of index vectors around each bucket, in row ranges."""
    places, signs = index_vectors()
    total = np.zeros((1 << BITS) * DIM)
    for batch in batches:
        for _, _, data, offsets in text_blocks(batch["text"]):
            words = Words(data, offsets, lower=False)
            w = buckets(words)
            for step in range(1, WINDOW + 1):
                if len(w) <= step:
                    continue
                near = words.rows[step:] == words.rows[:-step]
                left, right = w[:-step][near], w[step:][near]
                for a, b in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        total += np.bincount(a * DIM + places[b, k], signs[b, k], minlength=len(total))
    for part, rows in enumerate(np.split(total.astype(np.float32), RANGES)):
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "sums": pa.array([rows.tobytes()], pa.binary())})


def added(sums: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(s.as_py(), np.float32).astype(float) for s in sums["sums"])
    return pa.table({"part": sums["part"][:1], "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def word_vectors(documents: DataFrame) -> np.ndarray:
    """One unit vector per bucket, from every text; fixed in size, whatever the corpus."""
    sums = documents.select("text").mapInArrow(context_sums, "part int, sums binary")
    rows = sums.groupBy("part").applyInArrow(added, "part int, sums binary").orderBy("part").collect()
    if not rows:
        return np.zeros((1 << BITS, DIM), np.float32)
    vectors = np.concatenate([np.frombuffer(r["sums"], np.float32) for r in rows]).reshape(-1, DIM)
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    places, signs = index_vectors()
    own = np.zeros_like(vectors)
    np.put_along_axis(own, places, signs.astype(np.float32), 1)
    return (vectors + own / np.sqrt(NONZERO)).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Per row: the mean of its words' vectors, the root of the mean of their squares, and the mean
    product of each word's vector with the next one's, which tells running text from repeated words."""
    words = Words(data, offsets, lower=False)
    n = np.diff(words.first)
    out = np.zeros((len(n), POOLED), np.float32)
    some = n > 0
    if some.any():
        each = vectors[buckets(words)]
        first = words.first[:-1][some]
        out[some, :DIM] = np.add.reduceat(each, first, axis=0) / n[some, None]
        out[some, DIM : 2 * DIM] = np.sqrt(np.add.reduceat(each * each, first, axis=0) / n[some, None])
        next_one = np.zeros_like(each)
        within = np.flatnonzero(words.rows[1:] == words.rows[:-1])
        next_one[within] = each[within] * each[within + 1]
        out[some, 2 * DIM :] = np.add.reduceat(next_one, first, axis=0) / n[some, None]
    return out


@dataclass(frozen=True)
class Network:
    """tanh hidden layer, one output; inputs are standardised, the score is divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def constant(value: float) -> Network:
    zero = np.zeros(POOLED)
    return Network(zero, zero + 1, np.zeros((POOLED, 1)), np.zeros(1), np.zeros(1), value)


def trained(x: np.ndarray, y: np.ndarray, steps: int = 300, ridge: float = 1e-4, seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / scale
    params = [
        rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(()),
    ]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        w1, b1, w2, b2 = params
        hidden = np.tanh(z @ w1 + b1)
        p = 1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -30, 30)))
        e = (p - y) / len(y)
        back = np.outer(e, w2) * (1 - hidden * hidden)
        grads = [z.T @ back + ridge * w1, back.sum(0), hidden.T @ e + ridge * w2, e.sum()]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            params[i] = params[i] - 0.02 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    return Network(mean, scale, params[0], params[1], params[2], float(params[3]))


def cooled(network: Network, x: np.ndarray, y: np.ndarray) -> Network:
    """The temperature with the least log loss on held rows."""
    logit = network.logit(x)
    loss = lambda t: np.mean(np.logaddexp(0, np.where(y > 0, -logit, logit) / t))
    best = min(np.geomspace(0.25, 8, 60), key=loss)
    return Network(*(getattr(network, f) for f in ("mean", "scale", "w1", "b1", "w2", "b2")), float(best))


def fit(documents: DataFrame, labels: DataFrame, vectors: np.ndarray, most: int = SAMPLE) -> Network:
    """Fit on at most ``most`` labelled rows outside fold 0; with one class or none, a constant."""
    shared = documents.sparkSession.sparkContext.broadcast(vectors)  # a fixed number of bytes

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch["text"], SMALL):
                x = pooled(data, offsets, shared.value)
                yield pa.RecordBatch.from_pydict(
                    {"y": batch["y"][lo:hi].cast(pa.int32()), "x": pa.array([r.tobytes() for r in x], pa.binary())}
                )

    rows = labelled_sample(documents, labels, "quality", most).mapInArrow(pool, "y int, x binary").toPandas()
    rows = rows.sort_values(["x", "y"], ignore_index=True)  # the same fit however the rows arrive
    y = (rows["y"].to_numpy() > 0).astype(float)
    if len(set(y)) < 2:
        return constant(3.0 if not len(y) or y[0] else -3.0)
    x = np.array([np.frombuffer(b, np.float32) for b in rows["x"]], float)
    held = np.arange(len(y)) % 4 == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        return trained(x, y)
    return cooled(trained(x[~held], y[~held]), x[held], y[held])


def scored(documents: DataFrame, network: Network, vectors: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row; only the text is looked at."""
    shared = documents.sparkSession.sparkContext.broadcast(vectors)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch["text"], SMALL):
                s = network.score(pooled(data, offsets, shared.value))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch["doc_id"][lo:hi], "score": pa.array(s),
                    "predicted": pa.array((s >= threshold).astype(np.int32)),
                })

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(score, "doc_id long, score double, predicted int")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for all documents."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors = word_vectors(documents)
    network = fit(documents, table(spark, sf_dir, "labels"), vectors)
    rows = scored(documents, network, vectors)
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
