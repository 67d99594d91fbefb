"""Path patterns, suppressions, baselines and the engine union."""

import fnmatch

import pytest
from pyspark.sql import functions as F

from leakscan_spark.functions.paths import is_excluded, matches_glob, relative_to
from leakscan_spark.operators import triage
from leakscan_spark.sources import findings
from leakscan_spark.sources.findings import (
    add_to_baseline, baseline_entries, clear_baseline, create_baseline, read_baseline,
)
from leakscan_spark.sources.suppressions import Suppression, parse_suppression_lines

FINDING = "file string, line int, column int, rule string, severity string, description string, match string, redacted string, rule_ord int"


def finding(spark, *rows):
    return spark.createDataFrame(
        [(f, l, c, r, "high", "", m, m, o) for f, l, c, r, m, o in rows], FINDING
    )


GLOBS = [
    ("*.env", {"config/.env", ".env", "a.env"}, {"env", "a.env/b"}),
    ("tests/fixtures/**", {"tests/fixtures/a", "x/tests/fixtures/a/b"}, {"tests/fixtures", "xtests/fixtures"}),
    ("src/*.js", {"src/a.js", "/abs/src/a.js"}, {"src/b/a.js"}),
    ("/abs/*.js", {"/abs/a.js"}, {"x/abs/a.js"}),
    ("**/foo.txt", {"foo.txt", "a/foo.txt", "xfoo.txt"}, {"foo.txtx"}),
    ("docs/?.md", {"docs/a.md"}, {"docs/ab.md"}),
    ("a[bc].t", {"x/ab.t"}, {"ad.t"}),
    ("dir\\sub\\*", {"dir/sub/x", "q\\dir\\sub\\x"}, {"dir/sub/x/y"}),
    ("we+ird(1)/$x", {"we+ird(1)/$x"}, {"weird1/x"}),
]


@pytest.mark.parametrize("glob,inside,outside", GLOBS)
def test_globs(column, glob, inside, outside):
    paths = sorted(inside | outside)
    assert column(paths, matches_glob(F.col("x"), glob)) == [p in inside for p in paths]


@pytest.mark.parametrize("pattern", ["*.py", "a?c", "[!x]*", "x[]y", "a.b+c", "*[0-9].txt"])
def test_bare_wildcards_match_like_fnmatch(column, pattern):
    names = ["a.py", "abc", "xyz", "x]y", "x[]y", "a.b+c", "n7.txt", "n.txt", "x"]
    assert column(names, matches_glob(F.col("x"), pattern)) == [fnmatch.fnmatch(n, pattern) for n in names]


def test_exclude_entries(column):
    cases = [
        ("docs", ["docs", "docs/a", "x/docs/y"], ["docsx/a"]),
        ("docs/", ["docs/a"], ["mydocs"]),
        ("src/vendor", ["src/vendor", "src/vendor/x"], ["a/src/vendor/x", "src/vendors"]),
        ("*.md", ["a.md", "x/y.md"], ["a.mdx"]),
        ("gen/*/out", ["gen/a/out", "gen/a/b/out", "x/gen/a/out"], ["gen/out"]),
        ("", [], ["a"]),
    ]
    for entry, inside, outside in cases:
        assert column(inside + outside, is_excluded(F.col("x"), [entry])) == [True] * len(inside) + [False] * len(outside)
    assert column(["/r", "/r/a/b", "/q/a"], relative_to(F.col("x"), "/r/")) == ["", "a/b", "/q/a"]


SUPPRESSIONS = [
    Suppression("tests/**", "AWS key", "first", "policy"), Suppression("tests/**", None, "second", "policy"),
    Suppression("*.env", "Bearer", None), Suppression("a/b/c.txt", None, "third"), Suppression("**x/y*", None, "fourth"),
]
FILES = ["tests/a.py", "q/tests/a.py", "p/.env", "a/b/c.txt", "z/a/b/c.txt", "kx/yy", "plain.txt"]


def test_first_suppression_wins(spark):
    rows = finding(spark, *[(f, 1, 1, r, "m", 0) for f in FILES for r in ("aws KEY", "BEARER", "Other")])
    marked = triage.mark_suppressed(rows, SUPPRESSIONS)
    got = {(r.file, r.rule): r.suppressed_by and r.suppressed_by.reason for r in marked.collect()}
    assert got["tests/a.py", "aws KEY"] == "first" and got["q/tests/a.py", "Other"] == "second"
    assert got["z/a/b/c.txt", "Other"] == "third" and got["kx/yy", "Other"] == "fourth" and got["plain.txt", "Other"] is None
    kept, hidden = triage.split_suppressed(marked)
    assert hidden.where("file = 'p/.env'").select("rule", "reason", "source").collect() == [("BEARER", None, "ignore-file")]
    assert kept.count() + hidden.count() == rows.count()


def test_tables_give_the_same_answer_as_lists(spark):
    rows = finding(spark, *[(f, 1, 1, r, "m", 0) for f in FILES for r in ("aws KEY", "BEARER", "Other")])
    listed = [*SUPPRESSIONS, *[Suppression(f"none{i}/**") for i in range(30)]]
    table = spark.createDataFrame(
        [(i, s.path_glob, s.rule, s.reason, s.source) for i, s in enumerate(listed)],
        "ord int, path_glob string, rule string, reason string, source string",
    )
    short = triage.mark_suppressed(rows, listed)
    long = triage.mark_suppressed(rows, table)
    view = lambda df: sorted((r.file, r.rule, r.suppressed_by and (r.suppressed_by.reason, r.suppressed_by.source)) for r in df.collect())
    assert str(view(short)) == str(view(long))


def test_frequent_words_stay_unless_a_glob_waits_under_them(spark):
    paths = spark.createDataFrame([(f"src/{i}.py", f"src/{i}.py", ["R"], ["src", str(i), "py", "any:"]) for i in range(40)], "file string, path string, rules array<string>, keys array<string>")
    often = paths.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    order = spark.createDataFrame([("7",), ("py",), ("gone",)], "key string")
    met = triage._meeting(paths, order, often).groupBy("key").count().collect()
    assert {(r.key, r["count"]) for r in met} == {("7", 1), ("py", 40)}


def test_suppression_lines(spark):
    lines = ["# note", "", " src/** ", "a/*.txt: Rule: x ", "b:"]
    df = spark.createDataFrame(list(enumerate(lines)), "ord int, value string")
    assert [(r.path_glob, r.rule) for r in parse_suppression_lines(df).orderBy("ord").collect()] == [
        ("src/**", None), ("a/*.txt", "Rule: x"), ("b", None),
    ]


def test_union(spark):
    external = finding(spark, ("a", 1, 2, "ext-rule", "s3cret", None), ("a", None, None, "ext-rule", "n", None), ("b", 1, 1, "e", "t", None))
    own = finding(
        spark, ("a", 1, 2, "R1", "s3cret", 1), ("a", 1, 2, "R0", "s3cret", 0), ("a", 1, 9, "R1", "s3cret", 1),
        ("a", 2, 2, "R1", "s3cret", 1), ("a", None, None, "R2", "n", 2), ("c", 1, 1, "R5", "q", 5), ("c", 1, 1, "R4", "q", 4),
    )
    got = {(r.file, r.line, r.column): (r.rule, r.engines) for r in triage.union_engines(external, own).collect()}
    assert got["a", 1, 2] == ("ext-rule", ["external", "patterns"]) == got["a", None, None]
    assert got["a", 1, 9] == ("R1", ["patterns"]) and got["a", 2, 2] == ("R1", ["patterns"])
    assert got["b", 1, 1] == ("e", ["external"]) and got["c", 1, 1] == ("R4", ["patterns"]) and len(got) == 6
    assert triage.union_engines(None, own).count() == 5


def test_baseline(spark, tmp_path):
    rows = finding(spark, ("a", 1, 1, "R", "m", 0), ("a", 2, 1, "R", "m", 0), ("b", 5, 1, "R", "m", 0), ("b", 5, 1, "Q", "m", 0), ("c", None, None, "R", "m", 0))
    entries = spark.createDataFrame([("a", 1, "R"), ("b", None, "R"), ("a", 1, "R"), ("c", 3, "R")], "file string, line int, pattern string")
    left = triage.apply_baseline(rows, entries)
    assert {(r.file, r.line, r.rule) for r in left.collect()} == {("a", 2, "R"), ("b", 5, "Q"), ("c", None, "R")}
    path, day = str(tmp_path / "base"), lambda d: F.lit(f"2024-01-0{d}").cast("timestamp")
    create_baseline(rows, path, day(1))
    add_to_baseline(baseline_entries(rows.limit(1), day(2)), path)
    assert read_baseline(spark, path).count() == 6 and triage.apply_baseline(rows, read_baseline(spark, path)).count() == 0
    create_baseline(rows.where("file = 'a'"), path, day(3))
    stored = findings._stored(spark, path)
    assert stored.count() == 2 and str(stored.agg(F.max("created")).first()[0]).startswith("2024-01-01")
    clear_baseline(spark, path)
    assert read_baseline(spark, path).count() == 0
