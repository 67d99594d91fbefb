import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from plain import LOWER, WORD

from leakscan_spark.llm import decontaminate, line_dedup, mixing
from leakscan_spark.llm.cuckoo import CuckooFilter



SPACE = " \t\n\x0b\x0c\r"


def plain_lines(rows):
    last = 1 << 63
    owner = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(SPACE).translate(LOWER)
            if len(key) >= 10:
                owner[key] = min(owner.get(key, last), last if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if owner.get(x.strip(SPACE).translate(LOWER), last) >= (last if d is None else d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def line_results(df):
    got = line_dedup.deduped(*df).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    return sorted([(r[0], r[1], r[2], hashlib.sha256((r[3] or "").encode()).hexdigest()) for r in got], key=str)


def line_docs():
    rng = random.Random(2)
    pool = [f"a shared line number {i}" for i in range(25)] + ["short", "", "   ", "ÄÖÜ éé lines with accents"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 9)))) for i in range(60)]
    return rows + [(70, "  A SHARED line NUMBER 3\t"), (71, "\n\n"), (71, "a shared line number 4"), (72, "x" * 9), (73, "x" * 9)]


def test_line_dedup_matches_plain(documents, odd_rows):
    rows = line_docs() + odd_rows
    df = documents(rows)
    assert line_results((df, line_dedup.ingested(df, shards=3))) == plain_lines(rows)
    clashing = df.withColumnRenamed("lang", "drop_pos").withColumnRenamed("source", "kept_text")
    assert line_dedup.deduped(clashing, line_dedup.ingested(df, shards=3)).count() == len(rows)
    empty = documents([])
    assert line_dedup.deduped(empty, line_dedup.ingested(empty)).collect() == []


def test_line_ledger_is_reversible(spark, documents):
    rows = line_docs()
    gone = [r for r in rows if r[0] % 3 == 0]
    left = [r for r in rows if r[0] % 3]
    ledger = line_dedup.LineLedger.empty(spark, 4).insert(documents(left)).insert(documents(gone))
    back = ledger.delete(documents(gone).select("doc_id"))
    plain = line_dedup.LineLedger.empty(spark, 4).insert(documents(left))
    table = lambda x: sorted(map(tuple, x.refs.select("hi", "lo", "refs", "owner", "last").collect()))
    assert table(back) == table(plain)
    assert line_results((documents(left), back)) == plain_lines(left)
    held = lambda x: sum(len(CuckooFilter.loaded(r["slots"], r["stash"])) for r in x.filters.collect())
    assert held(back) == held(plain) == back.refs.count()
    assert held(back.resharded(7)) == back.refs.count()
    again = back.insert(documents(gone))
    assert table(again) == table(ledger)


def test_cuckoo_filter_keeps_what_it_got():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 62, 5000))
    for room in (5000, 300):  # the second overflows into the stash
        known = CuckooFilter.sized(room)
        known.insert(keys[:2000])
        known.insert(keys[2000:])
        assert known.contains(keys).all() and len(known) == len(keys)
        known.delete(keys[::2])
        assert known.contains(keys[1::2]).all() and len(known) == len(keys[1::2])
        assert known.contains(keys[::2]).mean() < (0.02 if room == 5000 else 1)
        again = CuckooFilter.loaded(*known.stored())
        assert (again.contains(keys) == known.contains(keys)).all()
        known.delete(keys[1::2])
        assert len(known) == 0 and not known.contains(keys).any()


# -- mixing ----------------------------------------------------------------------


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    targets, rest, free = {}, float(sum(sizes.values())), set(order)
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if rest * weight[s] / total > 3 * sizes[s]]
        if not full:
            targets |= {s: rest * weight[s] / total for s in free}
            break
        for s in full:
            targets[s] = 3.0 * sizes[s]
            rest -= targets[s]
            free.discard(s)
    return targets


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing_meets_targets(documents, prose, seed):
    rng = random.Random(seed)
    rows = [(i, prose(i % 40, rng.randrange(0, 60)), None, rng.choice(["a", "b", "b", "b", "B", "ä", None, "z"])) for i in range(500)]
    rows += [(7, "", None, "empty source"), (8, None, None, "empty source"), (9, "x " * 4000, None, "b"), (9, "x " * 4000, None, "b"), (None, "no id", None, "a")]
    df = documents(rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    targets = plain_targets(dict(sizes))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert 0 <= r["copies"] <= 3 and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], targets[r["source"]], abs_tol=1e-6)
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - targets[s]) <= 2 * largest[s] + 1 for s in sizes)
    key = lambda rs: sorted(map(str, rs))
    assert key(got) == key(mixing.mix(df.repartition(7)).collect())


def test_mixed_documents_repeat_rows(documents):
    rows = [(i, "w " * (i % 9 + 1), None, "ab"[i % 2]) for i in range(80)] + [(3, "same", None, "a")] * 3 + [(None, None, None, None)]
    df = documents(rows)
    plan = mixing.mix(df).collect()
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == [*df.columns, "copy"]
    assert mixed.count() == sum(r["copies"] for r in plan)
    assert mixing.mixed_documents(mixed).columns == mixed.columns
    assert mixing.mixed_documents(documents([])).collect() == []


# -- benchmark -----------------------------------------------------------------


def plain_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_matches_plain():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(0, 15))
        assert decontaminate.alignment(a, b) == plain_alignment(a, b)


def test_contaminated_documents_are_found(spark, documents, prose, monkeypatch):
    items = [(i, prose(900 + i, 15 + i)) for i in range(12)] + [(90, None), (91, ""), (92, "two words")]
    edit = lambda t, every: " ".join("changed" if k % every == every - 1 else w for k, w in enumerate(t.split(" ")))
    rows = [(i, prose(i, 80)) for i in range(60)]
    rows += [(100 + i, f"{prose(i, 20)} {t} {prose(60 + i, 30)}") for i, t in items[:12]]
    rows += [(200 + i, f"{prose(i, 20)} {edit(t, 6).upper().replace(' ', ', ')} {prose(70 + i, 30)}") for i, t in items[:12]]
    rows += [(300 + i, f"x {items[3][1]} y{i}") for i in range(150)]  # one item in most documents
    rows += [(500, None), (501, ""), (502, "two words"), (503, items[0][1] + " " + items[1][1]), (None, items[5][1])]
    df = documents(rows)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {(100 + i, i) for i in range(12)} | {(200 + i, i) for i in range(12)} | {(300 + i, 3) for i in range(150)}
    want |= {(503, 0), (503, 1), (None, 5)}
    found = lambda: {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(df, benchmark).collect()}
    assert found() == want
    left = decontaminate.clean(df, benchmark)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(d for d, _ in rows if d is not None and d not in {w[0] for w in want})
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (400,))  # several blocks
    assert found() == want


EDITS = {
    "third": lambda w: ["changed" if k % 3 == 2 else x for k, x in enumerate(w)],
    "fourth": lambda w: ["changed" if k % 4 == 3 else x for k, x in enumerate(w)],
    "fifth": lambda w: ["changed" if k % 5 == 4 else x for k, x in enumerate(w)],
    "dropped": lambda w: [x for k, x in enumerate(w) if k % 4 < 3],
    "added": lambda w: [y for k, x in enumerate(w) for y in ((x, "more") if k % 3 else (x,))],
    "half": lambda w: w[: len(w) // 2],
}


@pytest.mark.parametrize("name", EDITS)
def test_edited_copies_of_an_item_that_leaked_widely_are_found(spark, documents, prose, name):
    item = prose(901, 40)
    edited = " ".join(EDITS[name](item.split(" ")))
    rows = [(i, f"{prose(i, 9)} {item} {prose(500 + i, 9)}") for i in range(200)]
    rows += [(1000 + i, f"{prose(i, 30)} {edited} {prose(500 + i, 30)}") for i in range(100)]
    rows += [(2000 + i, prose(3000 + i, 100)) for i in range(50)]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"] for r in decontaminate.matches(documents(rows), benchmark).collect()}
    assert got == {d for d, _ in rows if d < 2000}


@pytest.mark.parametrize("least", [0.5, 0.7])
def test_matches_are_all_alignments(spark, documents, least):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    draw = lambda n: rng.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=n)
    items = [(i, " ".join(draw(rng.randrange(3, 30)))) for i in range(20)]
    rows = []
    for d in range(150):
        words = draw(rng.randrange(0, 80))
        for x in rng.choice(items)[1].split(" ") if d % 3 else ():
            words += [] if rng.random() < 0.1 else [rng.choice(vocabulary) if rng.random() < 0.2 else x] + draw(rng.random() < 0.15)
        rows.append((d, " ".join(words + draw(rng.randrange(0, 20)))))
    hashed = lambda t: np.array([hash(w) for w in t.split(" ") if w], np.int64)
    want = {(d, i): plain_alignment(hashed(x), hashed(t)) / (2 * len(x.split(" "))) for d, t in rows for i, x in items}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.matches(documents(rows), benchmark, least).collect()}
    assert got == {k: s for k, s in want.items() if s >= least} and len(got) > 25


def test_empty_benchmark_and_documents(spark, documents):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    df = documents([(1, "some text here")])
    assert decontaminate.matches(df, benchmark).collect() == []
    assert decontaminate.clean(df, benchmark).count() == 1
    full = spark.createDataFrame([(1, "a few words of an item")], "item_id long, text string")
    assert decontaminate.matches(documents([]), full).collect() == []


def test_blocks_that_meet_no_seed(spark, documents):
    benchmark = spark.createDataFrame([(1, "a few words of an item")], "item_id long, text string")
    rows = [(1, "nothing that it holds"), (2, None), (3, ""), (4, "one")]
    for some in (rows, rows[:1], rows[1:]):
        df = documents(some, 1)
        assert decontaminate.matches(df, benchmark).collect() == []
        assert sorted(r["doc_id"] for r in decontaminate.clean(df, benchmark).collect()) == [d for d, _ in some]
    df = documents([(5, "x a few words of an item y"), (6, "other " * 200_000)], 1)  # the long one is a block of its own
    assert [r["doc_id"] for r in decontaminate.matches(df, benchmark).collect()] == [5]
    assert [r["doc_id"] for r in decontaminate.clean(df, benchmark).collect()] == [6]
