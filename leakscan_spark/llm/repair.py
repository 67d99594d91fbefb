"""Conversation structure repair by a run-length dynamic program over min-plus matrices.

A repaired conversation has the role initials ``(s?(ua)+)?``. Its automaton has
four states, so a row is a 4 x 4 matrix of least costs (insertions before it,
then keep, rerole or delete), and rows compose by min-plus products. Equal
neighbouring symbols of role and fault form a run, and a run advances by cached
binary powers of its matrix.

Rows get positions in the order of conversation and turn from a range
partitioning, so a conversation of any length spans many tasks. ``WINDOW``
positions of one conversation form a block. Blocks give their matrices; per
conversation these give the cost to go at each block's end and, through the
exit states of each block, its entry state (one short list of blocks per
conversation: an audit is one string, so there are fewer than 2^31 rows and
half a million blocks). Then every block unrolls its choices on its own. Since
each choice emits one character and fixes the next state, taking the least
character that keeps the cost gives the ASCII-least of the cheapest audits.

The digest of a repaired conversation is inherently sequential: rows and edits
of a conversation stream through one task in order, and only the running hash is held.

Null roles, texts, and parts of the damage key count as one space. Rows without a turn come first.
Rows of one conversation and turn go by role, then by MD5 of the text. A null
conv_id is a conversation of its own. Roles whose first character is none of
s, u, a (or is missing) are never kept. Differences of turns are longs. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, saved, table

WINDOW = 12  # a block spans 2^12 positions at most

# Costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

# States: nothing yet, after s, after u, after a. Symbols: role * 3 + fault, with roles s, u, a, other.
START, SYSTEM, USER, ASSISTANT = range(4)
FINE, CUT, LOST = range(3)
SYMBOLS = 12
FAR = np.int64(1) << 40  # more than any cost
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
NEXT = np.array([USER, USER, ASSISTANT, USER])  # the state after an inserted or reroled row
TAIL = np.array([0, 2, 1, 0])  # rows to insert at the end of a conversation
GOAL = INSERT * TAIL.astype(np.int64)
CHARACTERS = "DIKR"  # in ASCII order

ROW = "struct<pos:long,turn:{turn},role:string,digest:binary>"


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus products of matrices (..., 4, 4)."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(-2), FAR)


def applied(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Min-plus products of matrices (..., 4, 4) and vectors (..., 4)."""
    return np.minimum((a + v[..., None, :]).min(-1), FAR)


@cache
def powers() -> np.ndarray:
    """(symbol, k): the matrix of 2^k rows with that symbol, for runs inside a block."""
    once = np.full((SYMBOLS, 4, 4), FAR)
    for symbol in range(SYMBOLS):
        role, fault = divmod(symbol, 3)
        extra = TRUNCATED if fault == CUT else 0
        for state in range(4):
            once[symbol, state, state] = DELETE
            if fault != LOST:
                once[symbol, state, NEXT[state]] = min(once[symbol, state, NEXT[state]], REROLE + extra)
                if (state, role) in KEPT:
                    once[symbol, state, KEPT[state, role]] = KEEP + extra
    inserted = np.where(np.eye(4, dtype=bool), 0, FAR)
    inserted[range(4), NEXT] = INSERT
    once = product(product(inserted, inserted), once)
    found = [once]
    for _ in range(WINDOW):
        found.append(product(found[-1], found[-1]))
    return np.stack(found, 1)


class Runs:
    """Maximal runs of equal symbols in each of several blocks."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray):
        n = len(codes)
        self.symbols = np.where(codes % 3 == LOST, LOST, codes)  # a row that must go has no role
        edge = np.ones(n, bool)
        edge[1:] = self.symbols[1:] != self.symbols[:-1]
        edge[offsets[:-1][np.diff(offsets) > 0]] = True
        self.start = np.flatnonzero(edge)
        self.length = np.diff(np.append(self.start, n))
        self.symbol = self.symbols[self.start]
        self.first = np.searchsorted(self.start, offsets)  # each block's range of runs

    def rounds(self, backward: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(blocks, runs): the next run of every block that has one."""
        count = np.diff(self.first)
        for j in range(count.max(initial=0)):
            blocks = np.flatnonzero(count > j)
            yield blocks, self.first[blocks + 1] - 1 - j if backward else self.first[blocks] + j

    def advance(self, held: np.ndarray, runs: np.ndarray, step) -> np.ndarray:
        """``held`` after ``runs``, by the binary powers of their matrices."""
        length, symbol = self.length[runs], self.symbol[runs]
        for k in range(int(length.max(initial=0)).bit_length()):
            odd = (length >> k) & 1 == 1
            held[odd] = step(powers()[symbol[odd], k], held[odd])
        return held

    def matrices(self) -> np.ndarray:
        """The matrix of every block."""
        found = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (len(self.first) - 1, 4, 4)).copy()
        for blocks, runs in self.rounds(backward=False):
            found[blocks] = self.advance(found[blocks], runs, lambda power, held: product(held, power))
        return found

    def costs(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost to go before and after every row, given that at each block's end."""
        held, at_end = ends.copy(), np.zeros((len(self.start), 4), np.int64)
        for blocks, runs in self.rounds(backward=True):
            at_end[runs] = held[blocks]
            held[blocks] = self.advance(held[blocks], runs, applied)
        before, after = (np.zeros((len(self.symbols), 4), np.int64) for _ in range(2))
        for t in range(self.length.max(initial=0)):
            runs = np.flatnonzero(self.length > t)
            rows = self.start[runs] + self.length[runs] - 1 - t
            after[rows] = at_end[runs]
            at_end[runs] = applied(powers()[self.symbol[runs], 0], at_end[runs])
            before[rows] = at_end[runs]
        return before, after


def unrolled(
    codes: np.ndarray, offsets: np.ndarray, before: np.ndarray, after: np.ndarray, entry: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exit state per block, insertions before each row, edit of each row as its place in ``CHARACTERS``)."""
    state = entry.copy()
    inserts, edits = np.zeros(len(codes), np.int8), np.zeros(len(codes), np.int8)
    kept = np.full((4, 4), -1)
    for (s, role), following in KEPT.items():
        kept[s, role] = following
    for t in range(np.diff(offsets).max(initial=0)):
        blocks = np.flatnonzero(np.diff(offsets) > t)
        rows = offsets[blocks] + t
        q, role, fault = state[blocks], codes[rows] // 3, codes[rows] % 3
        deleted = np.zeros(len(rows), bool)
        for _ in range(2):  # more than two insertions in a row never pay
            deleted = np.minimum(after[rows, q] + DELETE, FAR) == before[rows, q]
            more = ~deleted & (before[rows, NEXT[q]] + INSERT == before[rows, q])
            inserts[rows[more]] += 1
            q = np.where(more, NEXT[q], q)
        deleted = np.minimum(after[rows, q] + DELETE, FAR) == before[rows, q]
        stays = kept[q, role]
        extra = np.where(fault == CUT, TRUNCATED, 0)
        same = ~deleted & (fault != LOST) & (stays >= 0) & (after[rows, np.maximum(stays, 0)] + KEEP + extra == before[rows, q])
        edits[rows] = np.where(deleted, 0, np.where(same, 2, 3))
        state[blocks] = np.where(deleted, q, np.where(same, stays, NEXT[q]))
    return state, inserts, edits


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without nulls."""
    offsets = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
    return column.flatten().to_numpy().astype(np.int64), offsets


def table_of(column: pa.Array, *shape: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), *shape)


def lists(values: np.ndarray) -> pa.Array:
    flat = values.reshape(len(values), -1)
    offsets = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel().astype(np.int64)))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the planned damage; a dropped row has no copies."""
    c = F.col
    held = lambda x: F.coalesce(x.cast("string"), F.lit(" "))
    code = F.crc32(F.concat(held(c("conv_id")), F.lit(":"), held(c("turn")))) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(held(c("text")), "[.!?]", "")).otherwise(held(c("text")))
    return conversations.select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(held(c("role"))).alias("role"), text.alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"),
    )


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def placed(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, blank, cut, pos) per remaining row; ``pos`` follows conversation and turn.

    Texts stay behind. Equal rows are told apart by a number, so a conversation of them still spreads.
    """
    c = F.col
    last = F.regexp_extract(c("text"), r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    light = rows.where("copies > 0").select(
        "conv_id", "turn", "role", digest(c("text")).alias("digest"),
        (~F.regexp_like("text", F.lit(WORD))).alias("blank"), (~last.isin(".", "!", "?")).alias("cut"),
        F.monotonically_increasing_id().alias("nth"), F.explode(F.sequence(F.lit(1), c("copies"))).alias("copy"),
    )
    order = [c("conv_id").asc_nulls_first(), c("turn").asc_nulls_first(), c("role"), c("digest"), c("nth"), c("copy")]
    ordered = light.repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(ordered.withColumn("pos", F.monotonically_increasing_id()).drop("nth", "copy"), "repair-placed")


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` of ``placed`` with ``fault``, the first that holds (blank, duplicate, truncated or null), and ``code``."""
    c = F.col
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    fault = (
        F.when(c("blank"), "blank").when(c("is_first").isNull(), "duplicate").when(c("cut"), "truncated")
    )
    kind = F.when(c("fault").isin("blank", "duplicate"), LOST).when(c("fault") == "truncated", CUT).otherwise(FINE)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return rows.join(firsts, "pos", "left").withColumn("fault", fault).withColumn("code", (role * 3 + kind).cast("int"))


def blocks_of(rows: DataFrame) -> DataFrame:
    """(conv_id, at, codes, rows): at most 2^WINDOW neighbouring rows of a conversation in order."""
    kept = F.struct("pos", "turn", "role", "digest")
    listed = rows.groupBy("conv_id", F.shiftright("pos", WINDOW).alias("window")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "code", kept.alias("row")))).alias("held")
    )
    part = lambda name: F.transform("held", lambda h: h[name])
    return listed.select(
        "conv_id", F.col("held")[0]["pos"].alias("at"), part("code").alias("codes"), part("row").alias("rows")
    )


LINKS = np.zeros((4, 4), bool)  # neighbouring roles that may follow each other: su, ua, au
LINKS[[0, 1, 2], [1, 2, 1]] = True


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        codes, offsets = ragged(batch.column("codes"))
        role = codes // 3
        wrong = np.zeros(len(codes) + 1, np.int64)
        wrong[1:-1] = ~LINKS[role[:-1], role[1:]]
        wrong[offsets] = 0  # the first row of a block has no neighbour in it
        illegal = np.add.reduceat(wrong[:-1], offsets[:-1])
        ends = np.stack([role[offsets[:-1]], role[offsets[1:] - 1]], 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("at"), pa.array(illegal), lists(ends), lists(Runs(codes, offsets).matrices())],
            ["conv_id", "at", "illegal", "edges", "matrix"],
        )


def conversation_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the ordered blocks of a conversation: its cost, its illegal neighbours, and the cost to go at each block's end."""
    for batch in batches:
        costs, wrongs, ends = [], [], []
        for blocks in batch.column("blocks"):
            matrices = np.array([b["matrix"].as_py() for b in blocks], np.int64).reshape(-1, 4, 4)
            edges = [b["edges"].as_py() for b in blocks]
            wrong = sum(b["illegal"].as_py() for b in blocks)
            wrongs.append(wrong + sum(not LINKS[a[1], b[0]] for a, b in zip(edges, edges[1:])))
            held, found = GOAL, []
            for m in matrices[::-1]:
                found.append(held.tolist())
                held = applied(m, held)
            costs.append(int(held[START]))
            ends.append(found[::-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(costs, pa.int64()), pa.array(wrongs, pa.int64()),
             batch.column("at"), pa.array(ends, pa.list_(pa.list_(pa.int64())))],
            ["conv_id", "cost", "illegal", "at", "ends"],
        )


def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each block ends, for each state in which it may start."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        codes, offsets = ragged(batch.column("codes"))
        before, after = Runs(codes, offsets).costs(table_of(batch.column("end"), 4))
        found = [unrolled(codes, offsets, before, after, np.full(batch.num_rows, q))[0] for q in range(4)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("at"), lists(np.stack(found, 1))], ["conv_id", "at", "exits"]
        )


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The part of the audit that belongs to each row of a block, given its entry state and the cost at its end."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        codes, offsets = ragged(batch.column("codes"))
        before, after = Runs(codes, offsets).costs(table_of(batch.column("end"), 4))
        entry = batch.column("entry").to_numpy().astype(np.int64)
        state, inserts, edits = unrolled(codes, offsets, before, after, entry)
        parts = np.array([["I" * n + c for c in CHARACTERS] for n in range(3)], object)[inserts, edits]
        last = batch.column("is_last").to_numpy(zero_copy_only=False)
        final = offsets[1:][last] - 1
        parts[final] = parts[final] + np.array(["", "I", "II"], object)[TAIL[state[last]]]
        listed = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(parts, pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("rows"), listed], ["conv_id", "rows", "parts"])


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each block of a conversation starts."""
    for batch in batches:
        found = []
        for blocks in batch.column("blocks"):
            state, states = START, []
            for b in blocks:
                states.append(state)
                state = b["exits"].as_py()[state]
            found.append(states)
        yield pa.RecordBatch.from_arrays(
            [batch.column("at"), pa.array(found, pa.list_(pa.int32()))], ["at", "entries"]
        )


def audits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, cost, illegal) per conversation and (conv_id, pos, turn, role, digest, part) per row of ``with_faults``."""
    c = F.col
    conv, turn = rows.schema["conv_id"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()
    row = ROW.format(turn=turn)
    blocks = saved(blocks_of(rows), "repair-blocks")
    several = "array<long>"
    light = blocks.select("conv_id", "at", "codes")
    described = light.mapInArrow(summaries, f"conv_id {conv}, at long, illegal long, edges {several}, matrix {several}")
    in_order = lambda *names: F.array_sort(F.collect_list(F.struct("at", *names))).alias("blocks")
    ats = F.transform("blocks", lambda b: b["at"]).alias("at")
    whole = described.groupBy("conv_id").agg(in_order("illegal", "edges", "matrix")).select("conv_id", "blocks", ats)
    whole = saved(
        whole.mapInArrow(conversation_costs, f"conv_id {conv}, cost long, illegal long, at {several}, ends array<{several}>"),
        "repair-conversations",
    )
    ends = whole.select(
        F.size("at").alias("blocks"), F.posexplode(F.arrays_zip("at", "ends")).alias("i", "held")
    ).select("blocks", c("held.at").alias("at"), c("held.ends").alias("end"), (c("i") == 0).alias("is_first"), (c("i") == c("blocks") - 1).alias("is_last"))
    # Only conversations of several blocks need their entry states worked out.
    parted = light.join(ends.where("blocks > 1").select("at", "end"), "at").select("conv_id", "at", "codes", "end")
    leaving = parted.mapInArrow(exits, f"conv_id {conv}, at long, exits {several}")
    chains = leaving.groupBy("conv_id").agg(in_order("exits")).select("blocks", ats)
    entered = chains.mapInArrow(entries, f"at {several}, entries array<int>").select(
        F.explode(F.arrays_zip("at", "entries")).alias("held")
    ).select(c("held.at").alias("at"), c("held.entries").alias("entry"))
    ready = blocks.join(ends.drop("blocks"), "at").join(entered, "at", "left").select(
        "conv_id", "codes", "rows", "end", "is_last", F.coalesce("entry", F.lit(START)).alias("entry")
    )
    parts = ready.mapInArrow(edited, f"conv_id {conv}, rows array<{row}>, parts array<string>")
    each = parts.select("conv_id", F.explode(F.arrays_zip("rows", "parts")).alias("held"))
    each = each.select("conv_id", "held.rows.*", c("held.parts").alias("part"))
    return whole.select("conv_id", "cost", "illegal"), each


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of each conversation from its rows in order: a text, then the edits of the rows that have it."""
    held, audit, state, text, hashed = (), [], START, "", hashlib.sha256()
    kept = {(s, "sua"[role]): following for (s, role), following in KEPT.items()}
    schema: list[pa.DataType] = []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([held[0]], schema[0]), pa.array(["".join(audit)]), pa.array([hashed.hexdigest()])],
            ["conv_id", "audit", "repaired_sha256"],
        )

    for batch in batches:
        schema[:] = [batch.column("conv_id").type]
        done = []
        columns = [batch.column(name).to_pylist() for name in ("conv_id", "role", "text", "part")]
        for conv_id, role, own, part in zip(*columns):
            if not held or held[0] != conv_id:
                if held and audit:
                    done.append(row())
                held, audit, state, hashed, fresh = (conv_id,), [], START, hashlib.sha256(), True
            if part is None:
                text = own
                continue
            audit.append(part)
            for edit in part:
                if edit == "D":
                    continue
                following = kept[state, role[:1]] if edit == "K" else int(NEXT[state])
                name = role if edit == "K" else "user" if following == USER else "assistant"
                line = f"{'' if fresh else chr(10)}{name}:{'' if edit == 'I' else text}"
                hashed.update(line.encode())
                state, fresh = following, False
        yield from done
    if held and audit:
        yield row()


def repaired(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: gaps, faults, illegal neighbours, least cost, audit and digest of the repaired rows."""
    c = F.col
    rows = damaged(conversations)
    faulty = with_faults(placed(rows))
    costs, edits = audits(faulty)
    turns = faulty.groupBy("conv_id", "turn").agg(
        *[F.count_if(c("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    )
    missing = (F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long")
    counts = turns.groupBy("conv_id").agg(
        F.coalesce(missing, F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(f).cast("long").alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    texts = rows.where("copies > 0").select(
        "conv_id", "turn", "role", digest(c("text")).alias("digest"), F.lit(-1).cast("long").alias("pos"), "text",
        F.lit(None).cast("string").alias("part"),
    )
    both = texts.unionByName(edits.select("*", F.lit(None).cast("string").alias("text")))
    order = [c("conv_id"), c("turn").asc_nulls_first(), c("role"), c("digest"), c("pos")]
    streamed = both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text", "part")
    conv = rows.schema["conv_id"].dataType.simpleString()
    hashes = streamed.mapInArrow(digests, f"conv_id {conv}, audit string, repaired_sha256 string")
    found = rows.select("conv_id").distinct().alias("all")
    for name, part in (("counts", counts), ("costs", costs), ("hashes", hashes)):
        found = found.join(part.alias(name), c("all.conv_id").eqNullSafe(c(f"{name}.conv_id")), "left")
    zero = lambda name: F.coalesce(c(name), F.lit(0)).cast("long").alias(name)
    return found.select(
        c("all.conv_id").alias("conv_id"), *[zero(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of all conversations."""
    return repaired(table(spark, sf_dir, "conversations"))


# The plain program in DuckDB: one step per row, the best (cost, audit) per conversation and state.
SQL = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations
), coded AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(key, '')]),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
      lambda x, n: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS code
  FROM raw
), rows_ AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE code <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending
  FROM rows_
), faulty AS MATERIALIZED (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
    WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier
  FROM numbered
), follows(q, q2, line) AS (VALUES (0, 2, 'user:'), (1, 2, 'user:'), (2, 3, 'assistant:'), (3, 2, 'user:')),
kept(q, initial, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserted AS (
  SELECT DISTINCT q, q AS q2, 0 AS cost, '' AS audit, '' AS lines FROM follows
  UNION ALL SELECT q, q2, 5, 'I', line || chr(10) FROM follows
  UNION ALL SELECT a.q, b.q2, 10, 'II', a.line || chr(10) || b.line || chr(10) FROM follows a JOIN follows b ON a.q2 = b.q
), edits AS MATERIALIZED (
  SELECT DISTINCT q, q AS q2, 'D' AS op, '' AS initial, 2 AS cost, '' AS said FROM follows
  UNION ALL SELECT q, q2, 'K', initial, 0, '' FROM kept
  UNION ALL SELECT q, q2, 'R', '', 1, line FROM follows
), steps AS MATERIALIZED (
  SELECT n.q, e.q2, e.op, e.initial, n.cost + e.cost AS cost, n.audit || e.op AS audit, n.lines, e.said
  FROM inserted n JOIN edits e ON n.q2 = e.q
), walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS body FROM faulty
  UNION ALL
  SELECT conv_id, i, q, best.cost, best.audit, best.body FROM (
    SELECT conv_id, i, q, min({'cost': CAST(cost AS BIGINT), 'audit': audit, 'body': body}) AS best FROM (
    SELECT f.conv_id, f.i, s.q2 AS q, w.audit || s.audit AS audit,
      w.cost + s.cost + CASE WHEN s.op <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END AS cost,
      w.body || s.lines || CASE s.op WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || chr(10) ELSE s.said || f.text || chr(10) END AS body
    FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
    JOIN steps s ON s.q = w.q AND (s.op = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (s.op = 'R' OR s.initial = f.initial)))
    ) GROUP BY conv_id, i, q
  )
), totals AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), ended AS (
  SELECT w.conv_id, min({'cost': w.cost + n.cost, 'audit': w.audit || n.audit, 'body': w.body || n.lines}) AS best
  FROM walk w JOIN totals t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.i
  JOIN inserted n ON n.q = w.q AND n.q2 IN (0, 3) GROUP BY w.conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit,
  sha256(CASE WHEN coalesce(best.body, '') = '' THEN '' ELSE substr(best.body, 1, len(best.body) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN totals t ON o.conv_id IS NOT DISTINCT FROM t.conv_id
LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""
