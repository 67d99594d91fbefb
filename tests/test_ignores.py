"""Ignore files: hand-made cases, and random trees beside git itself."""

import random
import shutil
import subprocess

import pytest

from leakscan_spark.functions.ignore_patterns import ignore_pattern
from leakscan_spark.operators.ignores import drop_ignored_by, ignore_lines, ignored_paths

# (ignore files by folder, paths that go, paths that stay)
CASES = [
    ({"": ["*.log"]}, ["a.log", "x/y/b.log"], ["a.log.txt", "log"]),
    ({"": ["/top"]}, ["top", "top/x"], ["x/top"]),
    ({"": ["a/b"]}, ["a/b", "a/b/c"], ["x/a/b"]),
    ({"": ["dir/"]}, ["dir/f", "x/dir/f"], ["x/dir"]),
    ({"": ["**/deep"]}, ["deep", "a/b/deep/f"], ["deeper"]),
    ({"": ["a/**/z"]}, ["a/z", "a/b/z", "a/b/c/z"], ["a/bz", "b/a/z"]),
    ({"": ["a/**"]}, ["a/b", "a/b/c"], ["a", "b/a/c"]),
    ({"": ["*.txt", "!keep.txt"]}, ["a.txt", "k/b.txt"], ["keep.txt", "k/keep.txt"]),
    ({"": ["!keep.txt", "*.txt"]}, ["keep.txt"], []),
    ({"": ["out/", "!out/keep"]}, ["out/keep"], []),  # nothing comes back below an ignored folder
    ({"": ["out/*", "!out/keep"]}, ["out/x"], ["out/keep"]),
    ({"": ["*.c"], "sub": ["!*.c"]}, ["a.c", "x/a.c"], ["sub/a.c", "sub/d/b.c"]),
    ({"": ["!x.c"], "sub": ["*.c"]}, ["sub/x.c"], ["x.c"]),
    ({"sub": ["/x"]}, ["sub/x"], ["x", "sub/y/x"]),
    ({"": ["sub"], "sub": ["!*"]}, ["sub/x"], []),
    ({"": ["", "# c", "\\#d", "\\!e", "f\\ ", "g  "]}, ["#d", "!e", "f ", "g"], ["# c", "f", "g  "]),
    ({"": ["[a-c]?", "[!x]z"]}, ["b1", "yz", "q/c1"], ["xz", "d1"]),
    ({"": ["[[:digit:]]x", "[]a]b", "[a-]c"]}, ["1x", "]b", "-c"], ["ax", "bb", "bc"]),
    ({"": ["a?b", "c*d"]}, ["axb", "cd", "cxxd"], ["a/b", "c/d"]),
    ({"": ["[z", "e\\", "/", "!"]}, [], ["[z", "z", "e", "e\\"]),
    ({"": ["a.b"]}, ["a.b"], ["axb"]),
]


def rows(spark, files, lines):
    return (
        spark.createDataFrame(files, "tree int, file string"),
        spark.createDataFrame(lines, "tree int, folder string, line_no int, pattern string"),
    )


def test_cases(spark):
    files = [(i, p) for i, (_, gone, kept) in enumerate(CASES) for p in (*gone, *kept)]
    lines = [(i, f, n, p) for i, (held, _, _) in enumerate(CASES) for f, ps in held.items() for n, p in enumerate(ps)]
    got = {tuple(r) for r in ignored_paths(*rows(spark, files, lines), ["tree"]).collect()}
    assert got == {(i, p) for i, (_, gone, _) in enumerate(CASES) for p in gone}


def test_one_tree_and_odd_rows(spark):
    files = spark.createDataFrame([("a.log", 1), ("a.log", 2), (None, 3), ("b", 4), ("", 5)], "file string, n int")
    lines = spark.createDataFrame([("", 1, "*.log"), (None, 1, "*"), ("", 2, None)], "folder string, line_no int, pattern string")
    assert sorted(r.n for r in drop_ignored_by(files, lines).collect()) == [3, 4, 5]
    assert drop_ignored_by(files, lines.limit(0)).count() == 5 and drop_ignored_by(files.limit(0), lines).count() == 0


def test_lines_of_ignore_files(spark):
    files = spark.createDataFrame([("r", ".gitignore", "a\r\nb"), ("r", "x/y/.gitignore", "c"), ("r", "x/gitignore", "d")], "repo string, file string, text string")
    got = sorted(tuple(r) for r in ignore_lines(files, ["repo"]).collect())
    assert got == [("r", "", 0, "a"), ("r", "", 1, "b"), ("r", "x/y", 0, "c")]


def test_patterns():
    assert ignore_pattern("!a/b/") == (r"(?s)^(?:a/b)\z", True, True, False)
    assert ignore_pattern("# x") is None and ignore_pattern("   ") is None and ignore_pattern("[[:word:]]") is None


@pytest.mark.skipif(shutil.which("git") is None, reason="needs git")
def test_random_trees_beside_git(spark, tmp_path):
    pick = random.Random(11)
    names = ["a", "b", "ab", "a.txt", "b.txt", "#x", "!y", "c d", "x ", "[z]", "a-b", "1"]
    patterns = [
        "a", "b/", "/a", "a/b", "**/b", "a/**", "a/**/b", "*.txt", "!a.txt", "!b/", "?", "[ab]", "[!a]", "[^a]*", "a*", "/*", "!/a/", "\\#x", "\\!y", "x\\ ",
        "c d  ", "[[:alpha:]]", "[a-b]*", "*/b", "**", "a**b", "[z", "a\\", "!**/a.txt", "[]a]", "[a-]b", "!a", "a/*", "***/b", "ab/**", "**/", "/", "!",
    ]
    paths, folders = set(), {""}

    def grow(prefix, depth):
        for name in pick.sample(names, 6):
            if depth < 3 and pick.random() < 0.5:
                folders.add(prefix + name)
                grow(prefix + name + "/", depth + 1)
            else:
                paths.add(prefix + name)

    grow("", 0)
    files, lines, want = [], [], set()
    for tree in range(12):
        root = tmp_path / str(tree)
        for p in paths:
            (root / p).parent.mkdir(parents=True, exist_ok=True)
            (root / p).touch()
        subprocess.run(["git", "init", "-q", str(root)], check=True)
        for folder in {"", *pick.sample(sorted(folders), 4)}:
            held = pick.choices(patterns, k=pick.randrange(1, 6))
            (root / folder / ".gitignore").write_text("\n".join(held) + "\n")
            lines += [(tree, folder, i, p) for i, p in enumerate(held)]
        files += [(tree, p) for p in paths]
        asked = "\0".join(sorted(paths)).encode() + b"\0"
        said = subprocess.run(["git", "-C", str(root), "check-ignore", "--stdin", "--no-index", "-z"], input=asked, capture_output=True)
        want |= {(tree, p.decode()) for p in said.stdout.split(b"\0") if p}
    assert {tuple(r) for r in ignored_paths(*rows(spark, files, lines), ["tree"]).collect()} == want
