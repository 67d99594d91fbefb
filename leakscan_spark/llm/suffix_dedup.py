"""Removal of repeated byte strings by suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id. Equal strings must meet in one task, so they are
routed by content: every window of ``LENGTH`` bytes has an anchor, the
``GRAM``-byte string with the smallest hash inside it, and equal windows have
equal anchors.

1. Tasks send the anchors of their documents, packed by shard. A shard finds
   which anchors occur in different texts and tells each document its own.
2. Documents send the stretches whose windows have such anchors, to the shard
   of the anchor. Equal stretches of a batch are sent once, for the smallest
   document: those of larger documents are marked at once, and repeats inside
   the smallest send only where they start. Anchors in more than ``HOT`` texts
   are spread: each of their windows goes to a shard of its own hash.
3. A shard sorts the windows it received. Only suffixes that are not larger
   than their successor by the first byte are sorted directly; the others are
   induced from their successors in one scan over the buckets of first bytes.
   The common prefixes of neighbours follow; where one reaches ``LENGTH`` bytes
   the windows are equal, and those not in the smallest document are marked.
4. Marks come back to their documents, and covered bytes are cut.

Of documents with one and the same text only the smallest is sorted; the others
are removed whole. Nothing depends on the number of shards.

Null texts are empty. Texts below ``LENGTH`` bytes lose nothing. Rows that share
an id are one document; a null id orders after all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, saved, table, text_blocks

LENGTH = 50
GRAM = 16
HOT = 24_000  # texts with an anchor that one shard sorts together
SHARD_BYTES = 20 << 20  # bytes of text for each shard of anchors
FINER = 4  # shards of windows for each shard of anchors
BLOCK = 1 << 20  # bytes that a task looks at together
LAST = (1 << 63) - 1  # stands for a null id
CHUNK = 24_000  # stretches sorted together, whole anchors at a time

_MULTIPLIER = 0x9E3779B97F4A7C55
_POSITION = np.uint64((1 << 28) - 1)


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all ``n``-byte strings, n a power of two."""
    h = data.astype(np.uint64) + np.uint64(1)
    width = 1
    while width < n:
        h = h[:-width] * np.uint64(pow(_MULTIPLIER, width, 1 << 64)) + h[width:]
        width *= 2
    return mixed(h)


class Anchors:
    """The anchors of a block: their keys, rows, and the windows each one serves (first and last start)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
        self.keys = np.zeros(0, np.uint64)
        self.rows = self.first = self.last = np.zeros(0, np.int64)
        if len(data) < length:
            return
        hashes = gram_hashes(data, GRAM)
        least = (hashes & ~_POSITION) | (np.arange(len(hashes), dtype=np.uint64) & _POSITION)
        reach, want = 1, length - GRAM + 1
        while reach < want:
            step = min(reach, want - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        starts = np.arange(len(data) - length + 1)
        row = np.searchsorted(offsets, starts, "right") - 1
        inside = starts + length <= offsets[row + 1]
        starts, row = starts[inside], row[inside]
        if not len(starts):
            return
        # The low bits name a place at or a little after the start, whatever the length of the text.
        at = starts + (((least[starts] & _POSITION).astype(np.int64) - starts) & int(_POSITION))
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
        self.first, self.last = starts[new], starts[np.r_[new[1:], len(starts)] - 1]
        self.rows = row[new]
        self.keys = hashes[at[new]] >> np.uint64(16)  # 48 bits: a chance equality only costs a comparison


def packed(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(keys: bytes) -> np.ndarray:
    wide = np.zeros((len(keys) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(keys, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel().astype(np.uint64)


def anchor_rows(documents: DataFrame, shards: int) -> DataFrame:
    """(shard, keys, docs, versions, counts): the distinct anchors of a batch, by shard and document."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                batch = whole.slice(at, 8192)
                docs, versions = batch["doc"].to_numpy(), batch["version"].to_numpy()
                found = [np.zeros(0, np.uint64)]
                for lo, _, data, offsets in text_blocks(batch["text"], BLOCK):
                    anchors = Anchors(data, offsets)
                    found.append(np.unique((anchors.rows + lo).astype(np.uint64) << np.uint64(48) | anchors.keys))
                pairs = np.concatenate(found)
                keys, rows = pairs & np.uint64((1 << 48) - 1), (pairs >> np.uint64(48)).astype(np.int64)
                shard = (keys % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                keys, rows, shard = keys[order], rows[order], shard[order]
                edges = np.searchsorted(shard, np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(edges)):
                    own, n = np.unique(rows[edges[s] : edges[s + 1]], return_counts=True)
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array([s], pa.int32()), "keys": pa.array([packed(keys[edges[s] : edges[s + 1]])], pa.binary()),
                        "docs": pa.array([docs[own].tobytes()], pa.binary()),
                        "versions": pa.array([versions[own].tobytes()], pa.binary()),
                        "counts": pa.array([n.astype(np.uint32).tobytes()], pa.binary()),
                    })

    return documents.mapInArrow(pack, "shard int, keys binary, docs binary, versions binary, counts binary")


def whole(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(b.as_py(), kind) for b in column])


SHARED = "doc long, version long, keys binary"


def shared_anchors(rows: DataFrame, hot: int) -> DataFrame:
    """(doc, version, keys): the anchors of a document that another text has too; the lowest bit tells hot ones."""

    def find(shard: pa.Table) -> pa.Table:
        keys = np.concatenate([unpacked(k.as_py()) for k in shard["keys"]])
        counts = whole(shard["counts"], np.uint32)
        owner = np.repeat(np.arange(len(counts)), counts)
        docs, versions = whole(shard["docs"], np.int64), whole(shard["versions"], np.int64)
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        more = np.r_[False, keys[1:] == keys[:-1]] if len(keys) else np.zeros(0, bool)
        more[:-1] |= more[1:]
        keys, owner = keys[more], owner[more]
        # One entry for each anchor and text: the smallest document.
        order = np.lexsort((docs[owner], versions[owner], keys))
        keys, owner = keys[order], owner[order]
        same = keys[1:] == keys[:-1]
        first = np.r_[True, ~same | (versions[owner[1:]] != versions[owner[:-1]])] if len(keys) else np.zeros(0, bool)
        keys, owner = keys[first], owner[first]
        _, group, n = np.unique(keys, return_inverse=True, return_counts=True)
        keep = n[group] > 1
        keys = keys[keep] << np.uint64(1) | (n[group][keep] > hot)
        owner = owner[keep]
        order = np.lexsort((keys, versions[owner], docs[owner]))
        keys, owner = keys[order], owner[order]
        new = np.flatnonzero(np.r_[True, (docs[owner[1:]] != docs[owner[:-1]]) | (versions[owner[1:]] != versions[owner[:-1]])]) if len(keys) else np.zeros(0, int)
        parts = np.split(keys, new[1:]) if len(keys) else []
        return pa.table({
            "doc": pa.array(docs[owner[new]]), "version": pa.array(versions[owner[new]]),
            "keys": pa.array([p.tobytes() for p in parts], pa.binary()),
        })

    return rows.groupBy("shard").applyInArrow(find, SHARED)


STRETCHES = (
    "shard int, keys binary, docs binary, versions binary, starts binary, sizes binary, bytes binary, "
    "heads binary, again_versions binary, again_starts binary"
)


def stretches(documents: DataFrame, shards: int) -> DataFrame:
    """Windows with shared anchors, packed by shard: anchor key, document, first start, number of windows, bytes.

    A row without bytes carries windows that a batch has already found repeated.
    heads, again_versions and again_starts name further places of a row's
    stretches in the same document.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 2048):
                batch = whole_batch.slice(at, 2048)
                docs, versions = batch["doc"].to_numpy(), batch["version"].to_numpy()
                columns: list[list] = [[] for _ in range(5)]  # key, row, start, windows, offset in source
                sources, base = [], 0
                for lo, hi, data, offsets in text_blocks(batch["text"], BLOCK):
                    anchors = Anchors(data, offsets)
                    hot = np.zeros(len(anchors.keys), bool)
                    keep = np.zeros(len(anchors.keys), bool)
                    edges = np.searchsorted(anchors.rows, np.arange(hi - lo + 1))
                    for r in range(hi - lo):
                        known = np.sort(np.concatenate([np.frombuffer(k, np.uint64) for k in batch["shared"][lo + r].as_py()]))
                        own = anchors.keys[edges[r] : edges[r + 1]] << np.uint64(1)
                        place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                        hot[edges[r] : edges[r + 1]] = known[place] == own + np.uint64(1)
                        keep[edges[r] : edges[r + 1]] = (known[place] == own) | hot[edges[r] : edges[r + 1]]
                    cold, warm = np.flatnonzero(keep & ~hot), np.flatnonzero(hot)
                    n = anchors.last[warm] - anchors.first[warm] + 1
                    single = np.repeat(anchors.first[warm], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    start = np.r_[anchors.first[cold], single]
                    row = np.r_[anchors.rows[cold], np.repeat(anchors.rows[warm], n)]
                    key = np.r_[anchors.keys[cold], np.zeros(len(single), np.uint64)]
                    if len(single):
                        key[len(cold) :] = window_keys(data, single)
                    windows = np.r_[anchors.last[cold] - anchors.first[cold] + 1, np.ones(len(single), np.int64)]
                    for c, v in zip(columns, (key, row + lo, start - offsets[row], windows, base + start), strict=True):
                        c.append(v)
                    sources.append(data)
                    base += len(data)
                if not sources:
                    continue
                key, row, start, windows, source = (np.concatenate(c) for c in columns)
                text = np.concatenate(sources)
                yield from packed_stretches(key, docs[row], versions[row], start, windows, source, text, shards)

    return documents.mapInArrow(cut, STRETCHES)


def window_keys(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """48-bit keys of single windows; they route and pre-group, bytes decide."""
    h = np.zeros(len(starts), np.uint64)
    for k in range(LENGTH):
        h = h * np.uint64(_MULTIPLIER) + data[starts + k] + np.uint64(1)
    return mixed(h) >> np.uint64(16)


def equal_stretches(key, doc, version, start, windows, source, text) -> np.ndarray:
    """For each stretch the first of those with the same bytes, by document, version and start."""
    edges = window_keys(text, source), window_keys(text, source + windows - 1)  # together they cover a stretch
    order = np.lexsort((start, version, doc, *edges, windows, key))
    alike = np.ones(max(len(order) - 1, 0), bool)
    for values in (key, windows, *edges):
        alike &= values[order[1:]] == values[order[:-1]]
    pair = np.flatnonzero(alike)
    one, two = source[order[pair]], source[order[pair + 1]]
    length = windows[order[pair]] + LENGTH - 1
    same = np.ones(len(pair), bool)
    for k in range(int(length.max(initial=0))):
        inside = np.minimum(k, length - 1)
        same &= text[one + inside] == text[two + inside]
    alike[pair] = same
    head = np.maximum.accumulate(np.where(np.r_[False, alike][: len(order)], 0, np.arange(len(order))))
    first = np.empty(len(order), np.int64)
    first[order] = order[head]
    return first


def packed_stretches(key, doc, version, start, windows, source, text, shards) -> Iterator[pa.RecordBatch]:
    first = equal_stretches(key, doc, version, start, windows, source, text)
    marked = doc > doc[first]
    again = np.flatnonzero(~marked & (first != np.arange(len(first))))
    shard = (key % np.uint64(shards)).astype(np.int64)
    shard[marked] = doc[marked] % shards
    sent = np.ones(len(key), bool)
    sent[again] = False
    kept = np.flatnonzero(sent)
    order = kept[np.lexsort((marked[kept], shard[kept]))]  # documents stay together, so their ids compress
    edges = np.searchsorted(shard[order] * 2 + marked[order], np.arange(2 * shards + 1))
    place = np.empty(len(key), np.int64)
    place[order] = np.arange(len(order)) - edges[shard[order] * 2 + marked[order]]
    again = again[np.argsort(shard[again], kind="stable")]
    cuts = np.searchsorted(shard[again], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edges)):
        own = order[edges[s] : edges[s + 1]]
        sizes = windows[own] + LENGTH - 1
        take = np.repeat(source[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        content = b"" if s % 2 else text[take].tobytes()
        more = again[:0] if s % 2 else again[cuts[s // 2] : cuts[s // 2 + 1]]
        cells = (packed(key[own]), doc[own].tobytes(), version[own].tobytes(), start[own].astype(np.int32).tobytes(),
                 windows[own].astype(np.uint8).tobytes(), content, place[first[more]].astype(np.int32).tobytes(),
                 version[more].tobytes(), start[more].astype(np.int32).tobytes())
        names = ("keys", "docs", "versions", "starts", "sizes", "bytes", "heads", "again_versions", "again_starts")
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([s // 2], pa.int32())} | {n: pa.array([c], pa.binary()) for n, c in zip(names, cells, strict=True)}
        )


# -- suffix sorting ------------------------------------------------------------


def window_order(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """``starts`` in the order of their windows, equal windows side by side.

    Two-stage: a suffix is direct if its first byte is not above its second.
    Direct suffixes are sorted by their first ``length`` bytes. The others follow
    from their successors: scanning the buckets of first bytes upwards, each
    suffix met puts its predecessor, if that is indirect, at the end of what the
    predecessor's own bucket has so far. Indirect suffixes precede direct ones in
    a bucket and come from lower buckets, so each bucket is complete when its
    turn comes. Successors beyond the last window join until one is direct.
    """
    direct = np.append(text[:-1] <= text[1:], True)  # nothing follows the last byte
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    edge = starts[~direct[starts]] + 1
    while len(edge):
        edge = edge[~wanted[edge]]
        wanted[edge] = True
        edge = edge[~direct[edge]] + 1
    places = np.flatnonzero(wanted)
    direct_places = places[direct[places]]
    padded = np.r_[text, np.zeros(length, np.uint8)]
    views = np.lib.stride_tricks.sliding_window_view(padded, length)[direct_places]
    ranked = direct_places[np.argsort(np.ascontiguousarray(views).view(f"S{length}").ravel())]
    edges = np.searchsorted(text[ranked], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for byte in range(256):
        bucket = np.concatenate([*induced[byte], ranked[edges[byte] : edges[byte + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[wanted[before] & ~direct[before]]
        heads = text[before]
        by_head = np.argsort(heads, kind="stable")
        cuts = np.searchsorted(heads[by_head], np.arange(257))
        for head in np.unique(heads):
            induced[head].append(before[by_head[cuts[head] : cuts[head + 1]]])
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    is_start = np.zeros(len(text), bool)
    is_start[starts] = True
    return order[is_start[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bytes, up to ``length``, that each suffix shares with the one before it in ``order``."""
    common, equal = np.zeros(max(len(order) - 1, 0), np.int16), np.arange(max(len(order) - 1, 0))
    for k in range(length):
        equal = equal[text[order[equal] + k] == text[order[equal + 1] + k]]
        common[equal] += 1
    return common


def repeated_windows(text: np.ndarray, starts: np.ndarray, docs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows also start in a smaller document. docs: of each of ``starts``, which ascend."""
    if not len(starts):
        return np.zeros(0, bool)
    order = window_order(text, starts, length)
    doc = docs[np.searchsorted(starts, order)]
    group = np.flatnonzero(np.r_[True, common_prefixes(text, order, length) < length])
    least = np.repeat(np.minimum.reduceat(doc, group), np.diff(np.r_[group, len(doc)]))
    repeated = np.zeros(len(starts), bool)
    repeated[np.searchsorted(starts, order)] = doc > least
    return repeated


MARKS = "doc long, version long, runs binary"


def marks(rows: DataFrame) -> DataFrame:
    """(doc, version, runs): windows that a smaller document has, as int32 pairs of first start and last start."""

    def sort(shard: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        content = [b.as_py() for b in shard["bytes"]]
        filled = np.array([len(c) > 0 for c in content])
        fields = [[b.as_py() for b in shard[n]] for n in ("docs", "versions", "starts", "sizes")]
        kinds = (np.int64, np.int64, np.int32, np.uint8)
        for done, parts in ((False, np.flatnonzero(filled)), (True, np.flatnonzero(~filled))):
            if not len(parts):
                continue
            doc, version, start, windows = (
                np.concatenate([np.frombuffer(f[i], k) for i in parts]) for f, k in zip(fields, kinds, strict=True)
            )
            if done:
                n = windows.astype(np.int64)
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found.append((np.repeat(doc, n), np.repeat(version, n), np.repeat(start, n) + inner))
                continue
            counts = np.array([len(fields[0][i]) // 8 for i in parts])
            head = np.concatenate([np.frombuffer(shard["heads"][int(i)].as_py(), np.int32) + before
                                   for i, before in zip(parts, np.cumsum(counts) - counts)]).astype(np.int64)
            again_version, again_start = (
                np.concatenate([np.frombuffer(shard[name][int(i)].as_py(), k) for i in parts])
                for name, k in (("again_versions", np.int64), ("again_starts", np.int32))
            )
            by_head = np.argsort(head, kind="stable")
            cuts = np.searchsorted(head[by_head], np.arange(len(doc) + 1))
            key = np.concatenate([unpacked(shard["keys"][int(i)].as_py()) for i in parts])
            text = np.frombuffer(b"".join(content[i] for i in parts), np.uint8)
            windows = windows.astype(np.int64)
            ends = np.cumsum(windows + LENGTH - 1)
            order = np.argsort(key, kind="stable")
            groups = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
            at = 0
            while at < len(order):
                stop = int(np.searchsorted(groups, at + CHUNK))
                stop = int(groups[stop]) if stop < len(groups) else len(order)
                own = order[at:stop]
                at = stop
                sizes = windows[own] + LENGTH - 1
                begin = (np.cumsum(sizes) - sizes)
                take = np.repeat(ends[own] - sizes - begin, sizes) + np.arange(sizes.sum())
                inner = np.arange(windows[own].sum()) - np.repeat(np.cumsum(windows[own]) - windows[own], windows[own])
                starts = np.repeat(begin, windows[own]) + inner
                owner = np.repeat(own, windows[own])
                hit = np.flatnonzero(repeated_windows(text[take], starts, doc[owner]))
                whose, inner = owner[hit], inner[hit]
                found.append((doc[whose], version[whose], start[whose] + inner))
                n = cuts[whose + 1] - cuts[whose]  # the same windows further on in the document
                whose, inner = np.repeat(whose, n), np.repeat(inner, n)
                more = by_head[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + cuts[whose]]
                found.append((doc[whose], again_version[more], again_start[more] + inner))
        doc, version, start = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((start, version, doc))
        doc, version, start = doc[order], version[order], start[order].astype(np.int32)
        other = np.r_[True, (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])][: len(doc)]
        head = np.flatnonzero(other | np.r_[True, start[1:] != start[:-1] + 1][: len(doc)])
        runs = np.stack([start[head], start[np.r_[head[1:], len(doc)] - 1]], axis=1) if len(doc) else np.zeros((0, 2), np.int32)
        new = np.flatnonzero(other[head])
        parts = np.split(runs, new[1:]) if len(doc) else []
        return pa.table({
            "doc": pa.array(doc[head[new]]), "version": pa.array(version[head[new]]),
            "runs": pa.array([p.tobytes() for p in parts], pa.binary()),
        })

    return rows.groupBy("shard").applyInArrow(sort, MARKS)


def deduped(documents: DataFrame, shards: int | None = None, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; ``kept`` holds the remaining bytes."""
    c = F.col
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        F.coalesce(c("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("version"), text.alias("text")
    )
    if shards is None:
        size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        shards = max(24, int(size // SHARD_BYTES))
    shared = shared_anchors(anchor_rows(rows, shards), hot).groupBy("doc", "version").agg(F.collect_list("keys").alias("shared"))
    dealt = rows.repartition("doc")
    found = marks(stretches(dealt.join(shared, ["doc", "version"]), shards * FINER))
    found = found.groupBy("doc", "version").agg(F.collect_list("runs").alias("runs"))
    copies = rows.select("doc", "version").groupBy("version").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    copies = saved(copies.where(c("least") < c("most")), "copied-texts")  # a plain table: Spark can split the join
    copies = rows.select("doc", "version").join(copies, "version").where(c("doc") > c("least"))
    copies = copies.select("doc", "version", F.lit(True).alias("copy")).distinct()
    joined = dealt.join(found, ["doc", "version"], "left").join(copies, ["doc", "version"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            for content, runs, copy in zip(batch["text"], batch["runs"], batch["copy"], strict=True):
                data = content.as_py().encode()
                removed, spans, kept = 0, 0, data
                if copy.as_py():
                    removed, spans, kept = (len(data), 1, b"") if len(data) >= LENGTH else (0, 0, data)
                elif runs.is_valid:
                    kept, spans = without(data, np.concatenate([np.frombuffer(r, np.int32) for r in runs.as_py()]))
                    removed = len(data) - len(kept)
                for name, value in zip(out, (len(data), removed, spans, kept), strict=True):
                    out[name].append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch["doc"]} | {n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds, strict=True)}
            )

    kept = joined.select("doc", "text", "runs", "copy").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
    return kept.withColumn("doc_id", F.when(c("doc_id") != LAST, c("doc_id")))


def without(data: bytes, runs: np.ndarray) -> tuple[bytes, int]:
    """What is left of ``data`` without the windows of ``runs``, and the number of maximal runs removed."""
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, runs[::2], 1)
    np.add.at(change, runs[1::2] + LENGTH, -1)
    gone = np.cumsum(change[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), spans


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for all documents."""
    rows = deduped(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
