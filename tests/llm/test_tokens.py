"""Token counts beside the tokenizer library itself."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leakscan_spark.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(tokens.read_vocabulary(PATH))


def test_short_mixtures_of_every_class(library, counter):
    pick = random.Random(1)
    letters = "  \n\t\r'''stremvdlaBé漢字١²½ß  　\u0085\x1c.,!-<|>😀"
    texts = ["".join(pick.choices(letters, k=pick.randrange(40))) for _ in range(8000)]
    assert counter.count(pa.array(texts)).tolist() == library(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
def test_any_text(library, counter, texts):
    assert counter.count(pa.array(texts)).tolist() == library(texts)


def test_long_pre_tokens(library, counter):
    pick = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["a" * 1001, "ab" * 3000, "aab" * 999, " " * 3000, "\n" * 777 + "x", "é" * 500]
    texts += ["".join(pick.choices(letters, k=k)) for k in (64, 65, 66, 200, 20_000)]
    texts.append(" ".join(texts))
    assert counter.count(pa.array(texts)).tolist() == library(texts)


def test_special_strings(library, counter):
    s = "<|endoftext|>"
    texts = [s, s + s, f"a{s}b", f" {s} 's{s}'s", f"x  {s}  y", s[:-1], s[3:], f"<{s}>"]
    assert counter.count(pa.array(texts)).tolist() == library(texts)


def test_texts_over_a_block_are_cut_at_boundaries(library, counter, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 500)
    pick = random.Random(3)
    words = ["it's", "don't", "naïve", "12,5", "  two", "\n\n", "漢字", "<|endoftext|>", "x" * 90, "　", "tail "]
    texts = [" ".join(pick.choices(words, k=k)) for k in (3000, 10, 2000)] + ["y" * 5000, "　a" * 900]
    assert counter.count(pa.array(texts)).tolist() == library(texts)


def test_memory_of_counts_starts_anew(library, monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN", 5)
    fresh = tokens.Counter(tokens.read_vocabulary(PATH))
    for texts in (["one two three four five six seven"], ["eight one two nine"], ["one"]):
        assert fresh.count(pa.array(texts)).tolist() == library(texts)


def test_rows_of_a_table(documents, odd_rows, library):
    df = documents(odd_rows)
    rows = tokens.token_counts(df.withColumnRenamed("lang", "n_tokens"), tokens.read_vocabulary(PATH), limit=5).collect()
    expected = sorted(((i, len((t or "").encode()), n) for (i, t), n in zip(odd_rows, library([t for _, t in odd_rows]))), key=str)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows), key=str) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 5) for r in rows)
    assert tokens.token_counts(documents(odd_rows[:1]).limit(0), tokens.read_vocabulary(PATH)).count() == 0


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tokens.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
