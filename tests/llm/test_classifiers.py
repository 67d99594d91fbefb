import random
import zlib
from collections import Counter

import numpy as np
import pytest
from plain import WORD

from leakscan_spark.llm import common, language, quality_model, quality_rules


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, dup, len(covered)


@pytest.fixture(scope="module")
def labelled(spark, documents, prose, odd_rows):
    """Prose is good, shouting with marks is bad."""
    rng = random.Random(3)
    rows = []
    for i in range(240):
        text = prose(i, rng.randrange(60, 200))
        rows.append((1000 + i, text if i % 3 else " ".join(w.upper() + "!!" for w in text.split(" "))))
    df = documents(rows + odd_rows)
    labels = [(1000 + i, int(i % 3 > 0), 0) for i in range(240)] + [(1001, None, 0), (1001, 1, 0), (None, 1, 0), (99999, 0, 1)]
    return df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_base_counts_match_plain(documents, labelled, odd_rows):
    rows = odd_rows + [(50, "a b c a b c"), (51, "x\ny\nx\n \n \n"), (52, "word " * 60), (53, "# * $ %\n# * $ %\n\n\n"), (54, "\n" * 5)]
    model = quality_rules.fit(*labelled)
    got = quality_rules.judged(documents(rows), model).collect()
    want = [(d, *plain_counts(t)) for d, t in rows]
    assert sorted([tuple(r)[:6] for r in got], key=str) == sorted(want, key=str)
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and r["probability"] >= quality_rules.KEEP_FROM)


def test_quality_rules_tell_classes_apart(labelled):
    df, labels = labelled
    model = quality_rules.fit(df, labels)
    got = {r["doc_id"]: r for r in quality_rules.judged(df, model).collect()}
    held = [i for i in range(240) if zlib.crc32(str(1000 + i).encode()) % 5 == 0]
    assert np.mean([got[1000 + i]["kept"] == (i % 3 > 0) for i in held]) > 0.95
    kept = quality_rules.passing(df, model)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(d for d, r in got.items() if d is not None and r["kept"])


def test_score_of_a_block_is_the_score_of_each_row(labelled, prose):
    import pyarrow as pa

    model = quality_rules.fit(*labelled)
    texts = [prose(i, 5 * i) for i in range(12)] + ["", "a", "ab", "abc", "abcd", None]

    def scores(block):
        out = []
        for _, _, data, offsets in common.text_blocks(pa.array(texts, pa.string()), block):
            out += model.probability(data, offsets, common.Words(data, offsets, lower=False)).tolist()
        return out

    assert np.allclose(scores(1), scores(1 << 20))


def test_probability_matches_plain(labelled, prose):
    """The histogram of each text, counted with dictionaries, times the weights of its n-grams."""
    import pyarrow as pa

    model = quality_rules.fit(*labelled)
    texts = [prose(7, 90), "ÄÖ ü€ 😀😀 漢字漢字", "", None, "abc", "abcd", " a  b\n", "x" * 300, "e\u0301e\u0301 e\u0301"]
    shift = np.uint64(64 - quality_rules.BITS)

    def buckets(text):
        data, offsets = common.utf8(pa.array([text], pa.string()))
        words = common.Words(data, offsets, lower=False)
        pairs = words.grams(2)[0]
        codes = [np.uint64(int.from_bytes(c.encode(), "little")) for c in text]
        runs = []
        for i in range(len(codes) - 3):
            h = np.zeros(1, np.uint64)
            for c in codes[i : i + 4]:
                h = common.mixed(h ^ c)
            runs.append(h[0])
        assert len(words.hashes) == len(WORD.findall(text))
        return [[int(h >> shift) for h in hashes] for hashes in (words.hashes, pairs, runs)]

    want = []
    for text in texts:
        score = model.bias
        for k, own in enumerate(buckets(text or "")):
            for bucket, n in Counter(own).items():
                score += float(model.weights[k][bucket]) * n / len(own)
        want.append(1 / (1 + np.exp(-np.clip(model.a * score + model.b, -30, 30))))
    data, offsets = common.utf8(pa.array(texts, pa.string()))
    got = model.probability(data, offsets, common.Words(data, offsets, lower=False))
    assert np.allclose(got, want)


def test_sparse_fit_matches_dense_gradient():
    """One step over one block is Adam's first step: the sign of the plain gradient."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    words = [" ".join(f"w{i}" for i in rng.integers(0, 30, 12)) for _ in range(19)] + ["same " * 70_000]
    batch = pa.RecordBatch.from_pydict({"text": words, "y": [i % 2 for i in range(20)]})
    table = pa.Table.from_batches(list(quality_rules.histograms(iter([batch]))))
    order = np.arange(20)[::-1]
    rows, y = quality_rules.Sparse(table, order), (order % 2).astype(float)
    dense = np.zeros((20, quality_rules.FAMILIES << quality_rules.BITS))
    for i, r in enumerate(order):
        data, offsets = common.utf8(pa.array([words[r]]))
        for k, (buckets, _) in enumerate(quality_rules.features(data, offsets, common.Words(data, offsets, lower=False))):
            for bucket, n in Counter(buckets.tolist()).items():
                dense[i, (k << quality_rules.BITS) + bucket] = n / len(buckets)
    at, x, row = rows.part(0, 20)
    held = np.zeros_like(dense)
    np.add.at(held, (row, at), x)
    assert np.allclose(held, dense)
    w, _ = quality_rules.fit_logistic(rows, y, np.ones(20, bool), 0.0, 1)
    gradient = dense.T @ (0.5 - y)
    clear = np.abs(gradient) > 1e-4
    assert np.allclose(w[clear], -0.5 * np.sign(gradient[clear]), atol=1e-3) and clear.any()
    assert np.allclose(rows.scores(w), dense @ w, atol=1e-5)


@pytest.mark.parametrize("values", [[], [1], [0]])
def test_fits_without_two_classes(spark, documents, values):
    df = documents([(i, f"some words {i}") for i in range(8)])
    labels = spark.createDataFrame([(i, v, 0) for v in values for i in range(8)], "doc_id long, quality int, toxic int")
    assert quality_rules.judged(df, quality_rules.fit(df, labels)).count() == 8
    vectors = quality_model.word_vectors(df)
    rows = quality_model.scored(df, quality_model.fit(df, labels, vectors), vectors).collect()
    assert len(rows) == 8 and all(0 <= r["score"] <= 1 for r in rows)


def test_quality_model_learns(labelled):
    df, labels = labelled
    vectors = quality_model.word_vectors(df)
    network = quality_model.fit(df, labels, vectors)
    got = {r["doc_id"]: r for r in quality_model.scored(df, network, vectors).collect()}
    held = [i for i in range(240) if zlib.crc32(str(1000 + i).encode()) % 5 == 0]
    assert np.mean([got[1000 + i]["predicted"] == int(i % 3 > 0) for i in held]) > 0.9
    assert len(got) == df.select("doc_id").distinct().count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    again = quality_model.fit(df.repartition(5), labels, quality_model.word_vectors(df.repartition(5)))
    assert np.allclose(again.w1, network.w1, atol=1e-3)


def test_word_vectors_match_plain(documents):
    import pyarrow as pa

    texts = ["a b c a", "b a", None, "c"]
    places, signs = quality_model.index_vectors()
    data, offsets = common.utf8(pa.array(texts, pa.string()))
    words = common.Words(data, offsets, lower=False)
    ids = quality_model.buckets(words)
    plain = np.zeros((1 << quality_model.BITS, quality_model.DIM))
    for r in range(len(texts)):
        own = ids[words.rows == r]
        for i, w in enumerate(own):
            for j in range(max(0, i - 2), min(len(own), i + 3)):
                if j != i:
                    plain[w, places[own[j]]] += signs[own[j]]
    plain /= np.maximum(np.linalg.norm(plain, axis=1, keepdims=True), 1e-9)
    own = np.zeros_like(plain)
    np.put_along_axis(own, places, signs, 1)
    assert np.allclose(quality_model.word_vectors(documents(list(enumerate(texts)))), plain + own / 2, atol=1e-5)


def plain_grams(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    counts = Counter()
    for word in letters.split():
        padded = f" {word} "
        counts.update((c,) for c in word)
        for n in (2, 3):
            counts.update(tuple(padded[i : i + n]) for i in range(len(padded) - n + 1))
    return counts


def unpack(gram):
    parts = [(gram >> s) & ((1 << 21) - 1) for s in (42, 21, 0)]
    return tuple(" " if p == 0 else chr(p) for p in parts if p != language._END)


@pytest.mark.parametrize("dense", [100, 0])
def test_gram_counts_match_plain(documents, monkeypatch, dense):
    monkeypatch.setattr(language, "_DENSE", dense)
    texts = ["Ein Haus, a-b c1d", "été à la plage", "漢字 かな 漢字", "x", "İstanbul ſ"]
    part = language.Letters(texts)
    for i, text in enumerate(texts):
        grams, n = part.counted(i)
        assert dict(zip(map(unpack, part.packed(grams)), n.tolist())) == dict(plain_grams(text))


def test_language_identification(spark, documents, odd_rows):
    samples = {"en": "the house and the tree are with the other children of that town", "de": "das haus und der baum sind mit den anderen kindern der stadt"}
    rng = random.Random(1)
    rows = []
    for i in range(200):
        lang = ("en", "de")[i % 2]
        words = samples[lang].split()
        rows.append((i, " ".join(rng.choices(words, k=12)), lang))
    rows += [(900, "the tree", None), (901, None, "en"), (902, "123 !?", "de"), (903, "", None)]
    df = documents(rows)
    known = language.learned(df.where(common.fold(df["doc_id"]) != 0))
    assert known.langs == ["de", "en"]
    got = {r["doc_id"]: r for r in language.identified(df, known).collect()}
    assert all(got[i]["lang_pred"] == ("en", "de")[i % 2] for i in range(200))
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["en", "und", "und", "und"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # The profile itself: the most frequent n-grams of all training texts, ties by code point.
    counts = sum((plain_grams(t) for d, t, *lang in rows if lang == ["en"] and t and zlib.crc32(str(d).encode()) % 5), Counter())
    top = [r["gram"] for r in language.profiles(df.where(common.fold(df["doc_id"]) != 0)).where("lang = 'en'").orderBy("place").collect()]
    assert [counts[unpack(g)] for g in top] == sorted(counts.values(), reverse=True)[: language.SIZE]
    nothing = language.learned(documents(odd_rows))
    assert {r["lang_pred"] for r in language.identified(df, nothing).collect()} == {"und"}
    assert language.identified(documents([]), known).collect() == []
