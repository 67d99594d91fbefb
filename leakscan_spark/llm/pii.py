"""Personal data by pattern, and by a semi-Markov conditional random field over whole segments.

Runs of tokens that hold a digit or an ``@`` are islands. An island is cut into
atoms; a segment is up to ``LONGEST`` atoms, and features look at the segment
as a whole: digit count, Luhn sum, dotted parts, separators, what stands beside
it. Viterbi over segments chooses boundaries and types together; the bounded
segment length makes it linear in the island. The weights maximise the
conditional likelihood of pattern matches in a bounded sample of islands
(``SAMPLE``), computed over all segmentations by forward sums.

Patterns run on UTF-8 bytes and report code points; all their spans are
returned, and the field adds entities that overlap none of them.
Null texts are empty. Without a sample the field finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import span_digests, table, utf8

# The kinds in reporting order and their patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = np.zeros(256, bool)
_LOCAL[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")] = True
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a digit run is met at its start only
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")

_ISLAND = re.compile(rb"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*(?:[\x20\x09][^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*)*")
_ATOM = re.compile(rb"[A-Za-z]+|[0-9]+|[\x20\x09]+|[^A-Za-z0-9\x20\x09]")
_DIGITS = re.compile(rb"[^0-9]")
LONGEST = 16  # atoms of an entity
TYPES = len(KINDS)
SAMPLE = 400  # islands a fit may read
SAMPLE_DOCUMENTS = 4_000  # documents they may come from


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def small_parts(dotted: bytes) -> bool:
    return all(len(p.lstrip(b"0")) <= 3 and int(p[-3:]) <= 255 for p in dotted.split(b"."))


def pattern_spans(content: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, by start and then kind."""
    found = []
    at, done = content.find(b"@"), 0
    while at >= 0:
        start = at
        while start > done and _LOCAL[content[start - 1]]:
            start -= 1
        domain = _DOMAIN.match(content, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append((start, 0, done))
        at = content.find(b"@", max(at + 1, done))
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(content) if small_parts(m[0])]
    for m in _CARD.finditer(content):
        digits = _DIGITS.sub(b"", m[0]) if len(m[0]) >= 14 else b""
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(content):
        if 10 <= len(_DIGITS.sub(b"", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# -- segments -----------------------------------------------------------------

FEATURES = 34


def segment_features(island: bytes, start: int, end: int, atoms: int) -> list[int]:
    """The numbers of the features that hold for one whole segment."""
    span = island[start:end]
    digits = _DIGITS.sub(b"", span)
    n = len(digits)
    letters = any(65 <= c <= 90 or 97 <= c <= 122 for c in span)
    before = island[start - 1 : start]
    after = island[end : end + 1]
    holds = [0, 1 + min(n, 20) // 2]  # bias; digit count by twos: 1 to 11
    tests = (
        span[:1] == b"+", 10 <= n <= 15, 14 <= n <= 19, 14 <= n <= 19 and luhn(digits), letters, b"@" in span,
        span.count(b"@") == 1 and b"." in span.partition(b"@")[2], span.count(b".") == 3,
        span.count(b".") == 3 and not letters and b"@" not in span and all(p.isdigit() for p in span.split(b".")) and small_parts(span),
        b" " in span, b"-" in span, b"(" in span, span[-1:].isalnum(), span[:1].isalnum() or span[:1] == b"+",
        before.isalnum() or before in (b"+", b"@", b"."), after.isalnum() or after == b"@", atoms == 1, atoms > 4,
        span.isdigit(), span.isalpha(), not span.strip(), span[:1] == b"(",
    )
    return holds + [12 + i for i, t in enumerate(tests) if t]


class Island:
    """Atoms of an island and the candidate segments that end at each of them."""

    def __init__(self, island: bytes):
        self.bounds = [0, *(m.end() for m in _ATOM.finditer(island))]
        n = len(self.bounds) - 1
        self.ends: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]  # (first atom, segment number)
        rows = []
        for i in range(n):
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                start, end = self.bounds[i], self.bounds[j]
                span = island[start:end]
                entity = span[:1] > b" " and span[-1:] > b" " and (any(48 <= c <= 57 for c in span) or b"@" in span)
                if entity or j == i + 1:
                    self.ends[j].append((i, len(rows)))
                    rows.append(segment_features(island, start, end, j - i))
        self.x = np.zeros((len(rows), FEATURES))
        for r, holds in enumerate(rows):
            self.x[r, holds] = 1

    def best(self, weights: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, kind, end) in bytes of the entities on the best path. Row TYPES of the weights is outside."""
        scores = self.x @ weights.T
        top = scores[:, :TYPES].argmax(1)
        high = scores[np.arange(len(top)), top]
        total, back = [0.0], [(0, -1, -1)]
        for j in range(1, len(self.bounds)):
            options = [(total[i] + high[s], i, s, int(top[s])) for i, s in self.ends[j]]
            options += [(total[i] + scores[s, TYPES], i, s, TYPES) for i, s in self.ends[j] if i == j - 1]
            value, i, s, kind = max(options)
            total.append(value)
            back.append((i, s, kind))
        found, j = [], len(self.bounds) - 1
        while j > 0:
            i, _, kind = back[j]
            if kind < TYPES:
                found.append((self.bounds[i], kind, self.bounds[j]))
            j = i
        return found[::-1]

    def gradient(self, weights: np.ndarray, gold: dict[tuple[int, int], int]) -> tuple[float, np.ndarray]:
        """Log likelihood of a segmentation and its gradient. gold: (start, end) in bytes to kind."""
        scores = self.x @ weights.T
        n = len(self.bounds) - 1
        entity = np.logaddexp.reduce(scores[:, :TYPES], axis=1)
        both = np.logaddexp(entity, scores[:, TYPES])
        mass = lambda i, j, s: both[s] if i == j - 1 else entity[s]
        forward = [0.0] + [0.0] * n
        for j in range(1, n + 1):
            forward[j] = np.logaddexp.reduce([forward[i] + mass(i, j, s) for i, s in self.ends[j]])
        backward = [-np.inf] * n + [0.0]
        for j in range(n, 0, -1):
            for i, s in self.ends[j]:
                backward[i] = np.logaddexp(backward[i], backward[j] + mass(i, j, s))
        expected = np.zeros_like(scores)
        observed = np.zeros_like(scores)
        inside = {}
        for start, end in gold:
            for b in self.bounds:
                if start <= b < end:
                    inside[b] = (start, end)
        value = -forward[n]
        for j in range(1, n + 1):
            for i, s in self.ends[j]:
                base = forward[i] + backward[j] - forward[n]
                expected[s, :TYPES] = np.exp(base + scores[s, :TYPES])
                if i == j - 1:
                    expected[s, TYPES] = np.exp(base + scores[s, TYPES])
                edge = (self.bounds[i], self.bounds[j])
                kind = gold.get(edge)
                if kind is None and i == j - 1 and self.bounds[i] not in inside:
                    kind = TYPES
                if kind is not None:
                    observed[s, kind] = 1
                    value += scores[s, kind]
        return value, (observed - expected).T @ self.x


def islands(content: bytes) -> Iterator[tuple[int, bytes]]:
    for m in _ISLAND.finditer(content):
        yield m.start(), m[0]


def gold_of(island: bytes) -> dict[tuple[int, int], int] | None:
    """Pattern spans that atoms can express, none overlapping; None if one cannot be expressed."""
    bounds = {0, *(m.end() for m in _ATOM.finditer(island))}
    gold, at = {}, 0
    for start, kind, end in pattern_spans(island):
        if start < at:
            continue
        if start not in bounds or end not in bounds:
            return None
        gold[start, end], at = kind, end
    return gold


def sample_islands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch["text"])
        found = {i for k in range(batch.num_rows) for _, i in islands(data[at[k] : at[k + 1]].tobytes()) if len(i) <= 120}
        yield pa.RecordBatch.from_pydict({"island": pa.array(sorted(found), pa.binary())})


def fit(documents: DataFrame, most: int = SAMPLE, steps: int = 30) -> np.ndarray:
    """Weights (types and outside, features) from at most ``most`` distinct islands."""
    held = documents.where(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("text").alias("h"))
    bound = held.select("h").orderBy("h").limit(SAMPLE_DOCUMENTS).agg(F.max("h")).first()[0]  # hashes move, not texts
    picked = held.where(F.col("h") <= F.lit(bound).cast("long"))
    rows = picked.select("text").mapInArrow(sample_islands, "island binary").distinct()
    rows = [bytes(r[0]) for r in rows.orderBy(F.xxhash64("island"), "island").limit(most).collect()]
    known = [(Island(i), g) for i in rows if (g := gold_of(i)) is not None]
    weights = np.zeros((TYPES + 1, FEATURES))
    weights[:TYPES, 0] = -3.0  # nothing is found before anything is learned
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, steps + 1 if known else 1):
        g = sum(i.gradient(weights, gold)[1] for i, gold in known) / len(known) - 1e-3 * weights
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weights = weights + 0.4 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return weights


def added_spans(
    content: bytes, found: list[tuple[int, int, int]], weights: np.ndarray, seen: dict[bytes, list]
) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the field's entities that overlap none of ``found``. seen: islands met before."""
    starts, ends = np.array([s for s, _, _ in found]), np.array([e for _, _, e in found])
    added = []
    for offset, island in islands(content):
        best = seen.get(island)
        if best is None:
            best = Island(island).best(weights)
            if len(island) <= 120 and len(seen) < 20_000:
                seen[island] = best
        for start, kind, end in best:
            start, end = start + offset, end + offset
            if not len(starts) or not ((ends > start) & (starts < end)).any():
                added.append((start, kind, end))
    return added


def in_points(content: bytes, found: list[tuple[int, int, int]]) -> list[dict]:
    """Spans by start and then kind, in code points."""
    spans, at, points = [], 0, 0
    for start, kind, end in sorted(found):
        points += len(content[at:start].decode("utf-8", "replace"))
        at = start
        spans.append({"kind": KINDS[kind], "start": points, "end": points + len(content[start:end].decode("utf-8", "replace"))})
    return spans


def with_spans(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, base, spans): the patterns' spans and all spans of every row."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}
        for batch in batches:
            data, at = utf8(batch["text"])
            columns: dict[str, list] = {"base": [], "spans": []}
            for k in range(batch.num_rows):
                content = data[at[k] : at[k + 1]].tobytes()
                found = pattern_spans(content)
                columns["base"].append(in_points(content, found))
                columns["spans"].append(in_points(content, found + added_spans(content, found, weights, seen)))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch["doc_id"]} | {n: pa.array(c, span) for n, c in columns.items()}
            )

    kind = "array<struct<kind:string,start:long,end:long>>"
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(find, f"doc_id long, base {kind}, spans {kind}")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for all documents."""
    documents = table(spark, sf_dir, "documents")
    return with_spans(documents, fit(documents)).select("doc_id", *span_digests(KINDS, "base"))
