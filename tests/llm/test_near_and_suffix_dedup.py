import hashlib
import random

import numpy as np
import pytest
from plain import LOWER, WORD

from leakscan_spark.llm import components, near_dedup, suffix_dedup


def shingle_set(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def expected_components(rows, n, percent):
    """Every pair of sets compared."""
    rows = [(d, shingle_set(t, n)) for d, t in rows if d is not None]
    label = {d: d for d, _ in rows}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return {d: root(d) for d, _ in rows}


def edited(text, edits, rng):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("short", [24, 3])
@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_components_match_all_pairs(spark, documents, odd_rows, prose, monkeypatch, short, n, percent):
    monkeypatch.setattr(near_dedup, "SHORT", short)
    rng = random.Random(3)
    base = prose(1, 120)
    chain = [base]
    for _ in range(8):  # links that only follow one from another
        chain.append(edited(chain[-1], 2, rng))
    rows = [(100 + i, t) for i, t in enumerate(chain)]
    rows += [(200 + i, edited(base, rng.randrange(0, 8), rng)) for i in range(60)]
    rows += [(300 + i, prose(50 + i, 80)) for i in range(20)] + [(400, base), (401, base.upper())]
    rows += odd_rows
    got = {r["doc_id"]: r for r in near_dedup.clusters(documents(rows), n, percent).collect()}
    want = expected_components(rows, n, percent)
    assert {d: r["component_id"] for d, r in got.items() if d is not None} == want
    assert all(r["kept"] == (r["component_id"] == d) for d, r in got.items() if d is not None)
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert all(got[d]["n_shingles"] == len(shingle_set(t, n)) for d, t in rows)


@pytest.mark.parametrize("percent", [85, 80])
def test_strays_show_few_differences_and_lose_no_link(spark, percent):
    rng, q = random.Random(percent), 100 - percent
    hub = set(range(100))
    loners = [(hub - set(rng.sample(sorted(hub), 40))) | {rng.randrange(10**9) for _ in range(40)} for _ in range(60)]
    members = [(m - set(rng.sample(sorted(m), k % 7))) | {rng.randrange(10**9) for _ in range(k % 5)} for m in loners[:12] for k in range(6)]
    members += [(hub - set(rng.sample(range(30), k % 22))) | set(range(100, 100 + k % 19)) for k in range(80)]
    sets = loners[12:] + members
    rows = [(0, 1 + i, True, len(hub & m), len(hub), len(m), sorted(hub - m) + sorted(m - hub)) for i, m in enumerate(sets)]
    stars = spark.createDataFrame(rows, near_dedup.CONFIRMED)
    linked = lambda x, y: 100 * len(x & y) >= percent * len(x | y)
    stray = [not linked(hub, m) for m in sets]
    want = {(1 + i, 1 + j) for j in range(len(sets)) for i in range(j) if (stray[i] or stray[j]) and linked(sets[i], sets[j])}
    got = {(r["a"], r["b"]) for r in near_dedup.apart_pairs(stars, percent).collect()}
    assert len(want) > 100 and want <= got
    # A stray with many shingles of its own shows those alone.
    limit = sum(len(m - hub) if 100 * len(m - hub) > q * len(m) else len(m ^ hub) for m in sets)
    shown = near_dedup.differences(stars, percent)[1]
    assert shown.count() <= limit < 0.7 * sum(len(m ^ hub) for m in sets)


def test_sets_that_share_a_passage_show_no_differences(spark, documents, monkeypatch):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(90)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(10**9)}" for _ in range(40)])) for i in range(150)]
    rows += [(500 + k, edited(rows[7 * k][1], 2, rng)) for k in range(12)]
    shown, differences = [], near_dedup.differences
    monkeypatch.setattr(near_dedup, "differences", lambda *a: shown.append(differences(*a)) or shown[-1])
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.clusters(documents(rows), 5, 80).collect()}
    assert got == expected_components(rows, 5, 80)
    assert sum(got[500 + k] == 7 * k for k in range(12)) == 12
    assert sum(element.count() for _, element in shown) < 12 * 100


def test_representatives_keep_columns_and_rows_without_id(documents, odd_rows):
    df = documents(odd_rows).withColumnRenamed("lang", "component_id")
    kept = near_dedup.representatives(df)
    assert kept.columns == df.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == sorted({d for d, _ in odd_rows if d is not None} - {9})  # 9 nearly repeats 8
    assert kept.where("doc_id is null").count() == 1


def test_empty_table(documents):
    assert near_dedup.clusters(documents([])).collect() == []
    assert suffix_dedup.deduped(documents([])).collect() == []


def test_least_agreement_misses_few():
    assert near_dedup.least_agreement(85) == 16
    assert 1 <= near_dedup.least_agreement(10) < near_dedup.least_agreement(80) < near_dedup.least_agreement(95)


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def expected_removal(rows):
    """Every window of every document, in the order of ids."""
    last = 1 << 63
    texts = [(last if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in sorted(texts, key=lambda x: x[0]):
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], d)
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < d:
                gone[s : s + 50] = b"\x01" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((None if d == last else d, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [50_000, 1])
def test_suffix_dedup_matches_every_window(documents, odd_rows, prose, hot):
    rng = random.Random(4)
    passage = prose(9, 30)
    rows = [(20 + i, prose(100 + i, rng.randrange(5, 60)) + passage[rng.randrange(40) :] + prose(200 + i, 9)) for i in range(40)]
    rows += [(70, "ab" * 200), (71, "ab" * 90), (72, "x" * 49), (73, "x" * 49), (74, "x" * 50), (75, "x" * 51)]
    rows += [(76, passage), (77, passage), (78, passage.encode().decode() + "é" * 60), (79, "é" * 60), (80, "\x00" * 120), (81, "\x00" * 60)]
    falling = "".join(map(chr, range(126, 76, -1)))  # every byte above the next, to the very end
    rows += [(90, "first " + falling), (91, "second " + falling), (92, falling + falling), (93, falling[:-1])]
    chant = "one two three, " * 30
    rows += [(100 + i, prose(300 + i, 3) + chant[i % 4 :] + prose(400 + i, 4) + chant) for i in range(12)]
    rows += [(94, chant), (94, chant + "!"), (95, chant + chant)]
    rows += [(d, t if d not in (8, 9) else t[:3000] + str(d)) for d, t in [(d, t or "") for d, t in odd_rows]]
    got = [
        (r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())
        for r in suffix_dedup.deduped(documents(rows), shards=5, hot=hot).collect()
    ]
    assert sorted(got, key=str) == expected_removal(rows)


def test_positions_beyond_the_bits_that_hold_them(monkeypatch):
    data = np.frombuffer(("".join(random.Random(5).choices("abc ", k=3000))).encode(), np.uint8)
    whole = suffix_dedup.Anchors(data, np.array([0, 1700, 3000]))
    monkeypatch.setattr(suffix_dedup, "_POSITION", np.uint64((1 << 7) - 1))
    short = suffix_dedup.Anchors(data, np.array([0, 1700, 3000]))
    windows = lambda a: [(k, s) for k, f, l in zip(a.keys.tolist(), a.first, a.last) for s in range(f, l + 1)]
    # Fewer position bits leave more of the hash, which may break ties otherwise; windows stay covered once each.
    assert [s for _, s in windows(whole)] == [s for _, s in windows(short)]
    grams = suffix_dedup.gram_hashes(data, suffix_dedup.GRAM) >> np.uint64(16)
    assert all(k in grams[s : s + 35].tolist() for k, s in windows(short))


def test_common_prefixes():
    text = np.frombuffer(b"abcabdab" + b"abc", np.uint8)
    assert suffix_dedup.common_prefixes(text, np.array([0, 3, 8]), 3).tolist() == [2, 2]
    assert suffix_dedup.common_prefixes(text, np.array([0]), 3).tolist() == []


def test_window_order_puts_equal_windows_together():
    rng = np.random.default_rng(2)
    for _ in range(60):
        text = rng.integers(97, 97 + rng.integers(1, 4), rng.integers(12, 200)).astype(np.uint8)
        starts = np.arange(len(text) - 9)
        order = suffix_dedup.window_order(text, starts, 10)
        assert sorted(order.tolist()) == starts.tolist()
        windows = [text[i : i + 10].tobytes() for i in order]
        assert windows == sorted(windows)


def test_one_id_with_several_texts(documents, prose):
    a, b, c, d = (prose(9000 + i, 60) for i in range(4))
    rows = [(3, a), (7, a + " more"), (7, b), (7, c), (7, c), (9, c + " more"), (5, d), (5, d + " more"), (8, "two words"), (8, "other words")]
    df = documents(rows)
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.clusters(df).where("n_shingles > 0").collect()}
    assert got == {(3, 3, True), (7, 3, False), (7, 7, True), (9, 7, False), (5, 5, True), (5, 5, False), (8, 8, True)}
    kept = [(r["doc_id"], r["text"]) for r in near_dedup.representatives(df, 3, 85).collect()]
    assert len(kept) == 6 and {(3, a), (7, b), (7, c), (8, "two words"), (8, "other words")} < set(kept)
