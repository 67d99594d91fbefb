"""Long rule lists: the automaton's candidates, and agreement with the unrolled scan."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leakscan_spark.functions.needles import Needles, folded, needles_of, required_literals
from leakscan_spark.functions.rules import BUILTIN_RULES, Rule
from leakscan_spark.operators.rule_index import scan_files_indexed
from leakscan_spark.operators.scan import scan_files

COLUMNS = ["file", "line", "column", "rule", "severity", "match", "redacted", "rule_ord"]


@pytest.mark.parametrize("regex,needles,fold", [
    ("abc[0-9]+", ("abc",), False), ("[0-9]+xyz_[a-z]", ("xyz_",), False), ("(?:left|right)[0-9]", ("left", "right"), False),
    ("(?i)Secret[0-9]", ("secret",), True), ("a[0-9]b", (), False), ("(?:abc)?de[0-9]", ("de",), False), ("(?:abc)+[0-9]de", ("abc",), False),
    ("[a-z]+", (), False), ("(?:long|[0-9])x", (), False), ("(?i:abc)def", ("def",), False), ("(?=look)behind", ("behind",), False), ("(?!no)yes", ("yes",), False),
    ("x(?:(?:ab|cd)(?:efgh|ijkl))", ("efgh", "ijkl"), False), ("ab{0}cd", ("cd",), False), ("(?i)ßx[0-9]", ("ssx",), True), (r"\.json$", (".json",), False),
])
def test_required_literals(regex, needles, fold):
    found, folds = required_literals(regex)
    assert (tuple(sorted(found)), folds) == (tuple(sorted(needles)), fold)


@settings(max_examples=200, deadline=None)
@given(st.sampled_from([r.regex for r in BUILTIN_RULES] + ["(?:ab|cd)e+f", "(?i)k[eé]y_[0-9]", "a(?:bc|de(?:f|g))h", "x?yz"]), st.randoms())
def test_no_match_without_a_needle(regex, pick):
    """Texts made from the pattern's own characters: whatever matches holds a needle."""
    letters = [c for c in re.sub(r"[\\()\[\]?*+{}|^$]", "", regex)] + ["K", "ſ", "İ"]
    needles, fold = required_literals(regex)
    for _ in range(30):
        text = "".join(pick.choices(letters, k=30))
        if needles and re.search(regex, text):
            assert any(n in (folded(text) if fold else text) for n in needles)


def test_lines_of_candidates():
    needles = Needles([(0, ("ab",), False), (1, ("AB", "zz"), False), (2, ("ab",), True), (3, ("b\nc",), False), (7, ("ſt",), True)])
    assert needles.lines("ab\nx\nAB zz\n\nSTst") == [(1, "ab", [0, 2]), (3, "AB zz", [1, 2])]
    assert needles.lines("") == [] and Needles([]).lines("ab") == []
    assert [x[0] for x in Needles([(0, ("s",), True)]).lines("ß\nſ\nx\nS")] == [1, 2, 4]


def test_same_rows_as_the_unrolled_scan(spark):
    pick = random.Random(4)
    rules = [
        *BUILTIN_RULES, Rule("No literal", "[0-9]{6}"), Rule("Python only", r"(?P<a>q)(?P=a)-\d"), Rule("Empty", "z*"), Rule("Broken", "("),
        Rule("Folded", "(?i)straße-k[0-9]"), Rule("Edges", r"^key:\s*\w+$"), *[Rule(f"T{i}", f"tok{i:03d}[a-z]{{2}}", "low", f"d{i}") for i in range(200)],
    ]
    words = ["tok%03d%s" % (pick.randrange(300), pick.choice(["ab", "abc", "A"])) for _ in range(60)]
    words += ["AKIA" + "Q" * 16, 'api_key = "abcd1234abcd1234"', 'api_key = "MY_KEY_NAME_NOW"', "STRASSE-K1", "straße-k2", "qq-3", "123456789", "key: v", "zz", "　", "é"]
    rows = [(f"f{i}", pick.choice(["\n", " ", "\r\n", ""]).join(pick.choices(words, k=pick.randrange(30)))) for i in range(120)] + [("null", None), ("empty", "")]
    df = spark.createDataFrame(rows, "file string, text string").repartition(3)
    want = sorted(map(tuple, scan_files(df, rules).select(*COLUMNS).collect()), key=str)
    got = sorted(map(tuple, scan_files_indexed(df, rules).select(*COLUMNS).collect()), key=str)
    assert got == want and len(got) > 500


def test_only_rules_of_one_kind(spark):
    df = spark.createDataFrame([("a", "tok001ab 123456")], "file string, text string")
    for rules in ([Rule("N", "[0-9]{6}")], [Rule("T", "tok001ab")], []):
        assert sorted(scan_files_indexed(df, rules).select(*COLUMNS).collect()) == sorted(scan_files(df, rules).select(*COLUMNS).collect())


def test_own_needles_come_first():
    assert needles_of(Rule("x", "(?i)abc[0-9]", needles=("Bc",), fold=True)) == (("bc",), True)
    assert needles_of(Rule("x", "abc[0-9]", needles=("b",))) == (("b",), False)
