"""Token counts of byte-level BPE vocabularies by rank-synchronous array merging.

A batch of texts is one byte array. Characters get a class (letter, number,
space, other), and the boundaries of pre-tokens follow from the classes of
neighbours, so they are found for the whole batch at once. Distinct pre-tokens
are held as one ragged array of symbols. In each round every sequence finds the
lowest rank among its neighbouring pairs and all places of that pair merge,
left to right; sequences without a mergeable pair drop out, and the symbols they
have left are counted. A pre-token longer than ``LONG`` bytes does the same with
its pairs queued by rank, so a round touches only the places that merge.

The vocabulary is read on the driver (a fixed size, about 1 MB as arrays) and
travels with the function. Classes of characters are asked of the tokenizer
library when a task first meets a character, so both use one Unicode version.

Null and empty texts have no bytes and no tokens. Special strings in a text are
one token each, as by the library's default. A text longer than a block is cut
where a space follows a visible ASCII character, which is always a boundary, so
memory follows the block and the longest stretch without such a place. Distinct
pre-tokens are told apart by a 64-bit hash within a task. Repeated rows
and ids are counted separately; extra columns are not read.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK, SEPARATOR, spans, table, utf8

LIMIT = 1024
LONG = 64  # bytes of a pre-token from which its pairs are queued by rank
KNOWN = 400_000  # pre-tokens whose counts a task remembers before it starts anew

NONE = np.int32(2**31 - 1)
OTHER, LETTER, NUMBER, SPACE, UNSEEN = range(5)


@dataclass(frozen=True)
class Vocabulary:
    """Symbols of bytes, and merges in order of rank as (left, right) keys with the symbol they make."""

    byte_symbol: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    left: np.ndarray
    right: np.ndarray
    specials: tuple[bytes, ...]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, ``NONE`` where they do not merge."""
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def printable_bytes() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if visible, else one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


def read_vocabulary(path: str) -> Vocabulary:
    """A tokenizer file of the byte-level BPE kind; anything else in it is refused, not guessed."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    model, before, added = held["model"], held["pre_tokenizer"] or {}, held["added_tokens"]
    plain = (
        model["type"] == "BPE" and held["normalizer"] is None and before.get("type") == "ByteLevel"
        and before.get("use_regex", True) and not before.get("add_prefix_space")
        and not model.get("dropout") and not model.get("ignore_merges") and not model.get("byte_fallback")
        and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    )
    if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError(f"not a plain byte-level BPE tokenizer: {path}")
    vocab = model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    left = np.array([vocab[a] for a, _ in pairs], np.int32)
    right = np.array([vocab[b] for _, b in pairs], np.int32)
    keys = (left.astype(np.int64) << 32) | right
    order = np.argsort(keys, kind="stable")
    return Vocabulary(
        np.array([vocab[c] for c in printable_bytes()], np.int32), keys[order], order.astype(np.int32),
        np.array([vocab[a + b] for a, b in pairs], np.int32), left, right,
        tuple(t["content"].encode() for t in added),
    )


class Characters:
    """Classes of code points as the library's byte-level splitter has them, asked once per code point."""

    def __init__(self):
        from tokenizers.pre_tokenizers import ByteLevel

        self.split = ByteLevel(add_prefix_space=False).pre_tokenize_str
        self.known = np.full(0x110000, UNSEEN, np.uint8)

    def of(self, codes: np.ndarray) -> np.ndarray:
        found = self.known[codes]
        if (found == UNSEEN).any():
            for code in np.unique(codes[found == UNSEEN]).tolist():
                joins = lambda c, code=code: len(self.split(c + chr(code))) == 1
                self.known[code] = LETTER if joins("a") else NUMBER if joins("1") else OTHER if joins("!") else SPACE
            found = self.known[codes]
        return found


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position and code point of each character of UTF-8 bytes."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[at].astype(np.int32)
    wide = np.flatnonzero(code >= 0xC0)
    if len(wide):
        size = 2 + (code[wide] >= 0xE0) + (code[wide] >= 0xF0)
        value = code[wide] & (0x7F >> size)
        for k in (1, 2, 3):
            more = size > k
            value[more] = (value[more] << 6) | (data[at[wide[more]] + k] & 0x3F)
        code[wide] = value
    return at, code


def pre_token_starts(data: np.ndarray, edges: np.ndarray, characters: Characters) -> np.ndarray:
    """Byte positions at which pre-tokens start; none crosses a position of ``edges``."""
    at, code = code_points(data)
    if len(at) == 0:
        return at
    kind = characters.of(code)
    edge = np.zeros(len(data) + 1, bool)
    edge[edges] = True
    fresh = edge[at]  # nothing before it counts
    fresh[0] = True
    before = np.concatenate(([SPACE], kind[:-1]))
    follows = np.concatenate((~fresh[1:], [False]))  # the next character counts
    after = np.concatenate((kind[1:], [SPACE]))
    blank_before = np.concatenate(([False], code[:-1] == 32)) & ~fresh
    space = kind == SPACE
    # A run of spaces starts a pre-token; its last one belongs to what comes next.
    start = fresh | np.where(space, (before != SPACE) | (follows & (after != SPACE)), (before != kind) & ~blank_before)
    # An apostrophe that starts a pre-token takes one of these endings with it.
    quote = np.flatnonzero((code == 39) & start & follows)
    if len(quote):
        padded = np.concatenate((code, [0, 0, 0]))
        inside = np.concatenate((~fresh, [False] * 3))
        first, second = padded[quote + 1], padded[quote + 2]
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = inside[quote + 2] & (
            ((second == ord("e")) & np.isin(first, [ord("r"), ord("v")])) | ((first == ord("l")) & (second == ord("l")))
        )
        taken = np.where(one, 1, np.where(two, 2, 0))
        has = taken > 0
        start[quote[has] + 1] = False
        rest = quote[has] + 1 + taken[has]
        start[rest[rest < len(start)]] = True
    return at[start]


def merged_sizes(symbols: np.ndarray, rows: np.ndarray, n: int, vocabulary: Vocabulary) -> np.ndarray:
    """Symbols left of each of ``n`` sequences: rounds of the lowest-rank pair of every sequence at once."""
    size = np.zeros(n, np.int64)
    rank = np.full(len(symbols), NONE)
    inner = np.flatnonzero(rows[:-1] == rows[1:])
    rank[inner] = vocabulary.rank(symbols[inner], symbols[inner + 1])
    while len(symbols):
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        length = np.diff(np.append(first, len(rows)))
        lowest = np.minimum.reduceat(rank, first)
        done = lowest == NONE
        size[rows[first[done]]] = length[done]
        keep = np.repeat(~done, length)
        lowest = np.repeat(lowest, length)[keep]
        symbols, rows, rank = symbols[keep], rows[keep], rank[keep]
        hit = np.flatnonzero(rank == lowest)
        if len(hit) == 0:
            break
        # In a chain of overlapping places every other one merges, from the left.
        chain = np.flatnonzero(np.concatenate(([True], np.diff(hit) != 1)))
        place = np.arange(len(hit)) - np.repeat(chain, np.diff(np.append(chain, len(hit))))
        hit = hit[place % 2 == 0]
        symbols[hit] = vocabulary.made[rank[hit]]
        stay = np.ones(len(symbols), bool)
        stay[hit + 1] = False
        moved = np.cumsum(stay) - 1
        symbols, rows, rank = symbols[stay], rows[stay], rank[stay]
        at = moved[hit]
        changed = np.unique(np.concatenate((at, at[at > 0] - 1)))
        rank[changed] = NONE
        changed = changed[changed + 1 < len(rows)]
        changed = changed[rows[changed] == rows[changed + 1]]
        rank[changed] = vocabulary.rank(symbols[changed], symbols[changed + 1])
    return size


def long_sizes(symbols: np.ndarray, rows: np.ndarray, n: int, vocabulary: Vocabulary) -> np.ndarray:
    """``merged_sizes`` for long sequences: places wait under their rank, so a round costs what it merges."""
    count = len(symbols)
    symbols = symbols.copy()
    after = np.arange(1, count + 1)
    after[np.flatnonzero(np.append(rows[1:] != rows[:-1], True))] = -1
    before = np.arange(-1, count - 1)
    before[np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))] = -1
    alive = np.ones(count, bool)
    waiting: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def wait(places: np.ndarray) -> None:
        places = places[after[places] >= 0]
        rank = vocabulary.rank(symbols[places], symbols[after[places]])
        places, rank = places[rank != NONE], rank[rank != NONE]
        order = np.argsort(rank, kind="stable")
        places, rank = places[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for part in np.split(np.arange(len(rank)), cuts) if len(rank) else ():
            r = int(rank[part[0]])
            if r not in waiting:
                waiting[r] = []
                heapq.heappush(ranks, r)
            waiting[r].append(places[part])

    wait(np.arange(count))
    while ranks:
        r = heapq.heappop(ranks)
        p = np.unique(np.concatenate(waiting.pop(r)))
        p = p[alive[p] & (after[p] >= 0)]
        p = p[(symbols[p] == vocabulary.left[r]) & (symbols[after[p]] == vocabulary.right[r])]
        if len(p) == 0:
            continue
        chain = np.flatnonzero(np.concatenate(([True], after[p[:-1]] != p[1:])))
        place = np.arange(len(p)) - np.repeat(chain, np.diff(np.append(chain, len(p))))
        p = p[place % 2 == 0]
        gone = after[p]
        symbols[p] = vocabulary.made[r]
        alive[gone] = False
        after[p] = after[gone]
        has = after[p] >= 0
        before[after[p][has]] = p[has]
        ahead = before[p]
        wait(np.unique(np.concatenate((p, ahead[ahead >= 0]))))
    return np.bincount(rows[alive], minlength=n)


class Counter:
    """Counts tokens of texts inside one task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.characters = Characters()
        self.known: dict[int, int] = {}
        specials = sorted(vocabulary.specials, key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, specials))) if specials else None

    def count(self, column: pa.Array) -> np.ndarray:
        data, offsets = utf8(column)
        total = np.zeros(len(column), np.int64)
        for edges, owner, special in self.pieces(data, offsets):
            base = int(edges[0])
            self.add(data[base : edges[-1]], edges - base, owner, special, total)
        return total

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Edges of stretches, the row of each and whether it is a special string, about a block at a time."""
        edges, owner, special, since = [int(offsets[0])], [], [], 0
        for row in range(len(offsets) - 1):
            for end, is_special in self.stretches(data, int(offsets[row]), int(offsets[row + 1])):
                since += end - edges[-1]
                edges.append(end)
                owner.append(row)
                special.append(is_special)
                if since >= BLOCK:
                    yield np.array(edges), np.array(owner), np.array(special)
                    edges, owner, special, since = [end], [], [], 0
        if owner:
            yield np.array(edges), np.array(owner), np.array(special)

    def stretches(self, data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, bool]]:
        """Ends of the stretches of a row: special strings, and text between them cut into blocks."""
        seen = lo
        for match in self.special.finditer(data[lo:hi]) if self.special is not None else ():
            start, end = lo + match.start(), lo + match.end()
            yield from ((cut, False) for cut in self.cuts(data, seen, start))
            yield end, True
            seen = end
        yield from ((cut, False) for cut in self.cuts(data, seen, hi))

    @staticmethod
    def cuts(data: np.ndarray, lo: int, hi: int) -> Iterator[int]:
        """``hi``, after cuts about a block apart at places that are boundaries whatever is around them."""
        while hi - lo > 2 * BLOCK:
            cut, at = None, lo + BLOCK
            while cut is None and at < hi:
                window = data[at - 1 : min(at + (1 << 16), hi)]
                found = np.flatnonzero(SEPARATOR[window[1:]] & ~SEPARATOR[window[:-1]] & (window[:-1] > 32) & (window[:-1] < 127))
                cut = at + int(found[0]) if len(found) else None
                at += 1 << 16
            if cut is None:
                break
            yield cut
            lo = cut
        if hi > lo:
            yield hi

    def add(self, data, edges, owner, special, total) -> None:
        """Add the tokens of one piece to the totals of its rows."""
        np.add.at(total, owner[special], 1)
        starts = pre_token_starts(data, edges[:-1], self.characters)
        if len(starts) == 0:
            return
        ends = np.append(starts[1:], len(data))
        stretch = np.searchsorted(edges, starts, "right") - 1
        text = ~special[stretch]
        starts, ends, rows = starts[text], ends[text], owner[stretch[text]]
        if len(starts):
            hashes, first, which = np.unique(spans(data, starts, ends), return_index=True, return_inverse=True)
            sizes = self.sizes(data, hashes, starts[first], ends[first])
            total += np.bincount(rows, weights=sizes[which], minlength=len(total)).astype(np.int64)

    def sizes(self, data, hashes, starts, ends) -> np.ndarray:
        """Tokens of each distinct pre-token, remembered by hash."""
        if len(self.known) > KNOWN:
            self.known.clear()
        keys = hashes.tolist()
        found = np.fromiter((self.known.get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(found < 0)
        length = (ends - starts)[new]
        for part, merge in ((new[length <= LONG], merged_sizes), (new[length > LONG], long_sizes)):
            if len(part) == 0:
                continue
            size = (ends - starts)[part]
            rows = np.repeat(np.arange(len(part)), size)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + starts[part][rows]
            found[part] = merge(self.vocabulary.byte_symbol[data[at]], rows, len(part), self.vocabulary)
        self.known.update(zip((keys[i] for i in new.tolist()), found[new].tolist()))
        return found


def token_counts(documents: DataFrame, vocabulary: Vocabulary, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``documents``."""
    rows = documents.select("doc_id", "text")
    schema = T.StructType(
        [rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            text = batch.column(1)
            n_bytes = np.diff(utf8(text)[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes), pa.array(counter.count(text))], ["doc_id", "n_bytes", "n_tokens"]
            )

    counts = rows.mapInArrow(counted, schema)
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for all documents by the tokenizer file at ``path``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(table(spark, sf_dir, "documents"), read_vocabulary(path))
