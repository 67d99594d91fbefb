"""Conversation repair beside a plain program over whole strings."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from leakscan_spark.llm import repair

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
KEPT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def damage(rows):
    out = {}
    text_of = lambda x: " " if x is None else str(x)
    for conv_id, turn, role, text in rows:
        kept = out.setdefault(conv_id, [])
        code = zlib.crc32(f"{text_of(conv_id)}:{text_of(turn)}".encode()) % 20
        role, text = "user" if code == 4 else text_of(role), text_of(text)
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(code, text)
        kept.extend([(turn, role, text)] * {0: 0, 3: 2}.get(code, 1))
    digest = lambda x: hashlib.md5(x.encode()).digest()
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[2])))
    return out


def repair_plainly(rows):
    """Every state keeps its best (cost, audit, lines), row by row."""
    faults, seen = [], set()
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append(
            "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        )
        seen.add((role, text))

    def put(best, state, found):
        if state not in best or found[:2] < best[state][:2]:
            best[state] = found

    def with_inserts(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                put(best, NEXT[state], (cost + 5, audit + "I", [*lines, NAMES[NEXT[state]] + ":"]))
        return best

    best = with_inserts({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, lines) in best.items():
            put(after, state, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = cost + 5 * (fault == "truncated")
            if (state, role[:1]) in KEPT:
                put(after, KEPT[state, role[:1]], (more, audit + "K", [*lines, f"{role}:{text}"]))
            put(after, NEXT[state], (more + 1, audit + "R", [*lines, f"{NAMES[NEXT[state]]}:{text}"]))
        best = with_inserts(after)
    cost, audit, lines = min((v for state, v in best.items() if state in ("", "a")), key=lambda v: v[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    count = collections.Counter(faults)
    hashed = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashed


@pytest.fixture(scope="module")
def same(spark):
    def check(rows):
        df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, fault string")
        got = repair.repaired(df.repartition(4)).collect()
        found = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got}
        assert len(found) == len(got)
        assert found == {k: repair_plainly(v) for k, v in damage(rows).items()}

    return check


def mixture(seed, lengths):
    pick = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    texts = ["Hi.", "ok", "", None, "yes!", "no? ", " \t", "é.", "two\nlines."]
    rows = []
    for c, n in enumerate(lengths):
        for t in range(n):
            own = None if pick.random() < 0.02 else c
            turn = None if pick.random() < 0.05 else pick.choice([t, t + 3])
            rows.append((own, turn, pick.choice(roles), pick.choice([*texts, f"w{t}.", f"w{t}"])))
    return rows


def test_equal_to_the_plain_program(same):
    pick = random.Random(1)
    same(mixture(2, [pick.choice([1, 2, 3, 5, 9, 40]) for _ in range(300)]))


def test_one_long_conversation_over_many_blocks(same, monkeypatch):
    monkeypatch.setattr(repair, "WINDOW", 4)
    same(mixture(3, [4000, 3, 70, 1, 33]))


def test_long_runs_and_copies(same, monkeypatch):
    monkeypatch.setattr(repair, "WINDOW", 6)
    same(
        [(1, t, "user", f"t{t}.") for t in range(300)] + [(2, t, "assistant", f"t{t}") for t in range(200)]
        + [(3, 5, "user", "again.")] * 400 + [(4, None, "system", "s.")] * 3 + [(None, None, None, None)]
        + [(5, t, "user" if t % 2 == 0 else "assistant", f"t{t}.") for t in range(500)]
    )


def test_rows_that_all_go(same):
    dropped = [(c, t) for c in range(40) for t in range(40) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:2]
    same([(c, t, "user", "x.") for c, t in dropped] + [(99, 0, "system", "only a system row.")])


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert repair.repaired(empty).collect() == []


def test_powers_are_repeated_products():
    once, k = repair.powers()[:, 0], 4
    held = once
    for _ in range(2**k - 1):
        held = repair.product(held, once)
    assert np.array_equal(held, repair.powers()[:, k])


def test_names_of_other_types(spark):
    rows = [("a", 0, "user", "One."), ("a", 1, "assistant", "Two."), ("b", 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.repaired(df).collect()}
    assert got == {k: repair_plainly(v) for k, v in damage(rows).items()}
