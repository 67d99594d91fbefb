"""Listing and watching directory trees inside tasks."""

import os

import pytest

from leakscan_spark.sources import corpus, tree
from leakscan_spark.streaming import streams

KEY = "AKIA" + "T" * 16


def fill(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def listing(spark, root, **options):
    rows = tree.list_tree(spark, str(root), **options).collect()
    found = sorted(os.path.relpath(r.path, root) for r in rows)
    assert len(set(found)) == len(found)
    return found


def test_every_file_once_whatever_the_share(spark, tmp_path):
    files = {f"a{i % 7}/b{i % 5}/" + "deep/" * (i % 4) + f"f{i}.txt": "x" * i for i in range(120)}
    fill(tmp_path, files | {".hidden/_x/.y": "h", "_top": "t", "node_modules/m.js": "n", "a1/node_modules/q.js": "n"})
    (tmp_path / "hollow").mkdir()
    want = sorted([*files, ".hidden/_x/.y", "_top"])
    for share in (1, 3, 40, 10_000):
        assert listing(spark, tmp_path, skip=("node_modules",), share=share) == want
    lengths = {os.path.basename(r.path): r.length for r in tree.list_tree(spark, str(tmp_path), share=5).collect()}
    assert lengths["f100.txt"] == 100 and lengths["f0.txt"] == 0
    for depth in (0, 1, 2, 3):
        assert listing(spark, tmp_path, skip=("node_modules",), max_depth=depth, share=2) == [p for p in want if p.count("/") < depth]


def test_links_pipes_and_odd_names(spark, tmp_path):
    outside = tmp_path / "outside"
    root = tmp_path / "root"
    fill(tmp_path, {"outside/secret.txt": KEY, "root/a b%20+é.txt": KEY, "root/in/plain.txt": "none"})
    (root / "link").symlink_to(outside)
    (root / "in/loop").symlink_to(root)
    (root / "file_link.txt").symlink_to(outside / "secret.txt")
    (root / "dangling").symlink_to(root / "nowhere")
    os.mkfifo(root / "pipe")
    with open(os.fsencode(root) + b"/latin\xe9.txt", "wb") as f:
        f.write(KEY.encode())
    assert listing(spark, root) == ["a b%20+é.txt", "in/plain.txt", "latin�.txt"]
    texts = {r.file: r.text for r in corpus.read_corpus(spark, str(root)).collect()}
    assert texts == {"a b%20+é.txt": KEY, "in/plain.txt": "none", "latin�.txt": KEY}
    assert {r.file for r in corpus.read_corpus(spark, "file:" + str(root), max_bytes=4).collect()} == {"in/plain.txt"}
    # A single file is no folder and goes through Spark's own reader.
    assert corpus.read_corpus(spark, str(root / "in/plain.txt")).count() == 1


def test_unreadable_and_vanished(spark, tmp_path, monkeypatch):
    fill(tmp_path, {"a/x.txt": "x", "b/y.txt": "y"})
    held = tree.list_tree(spark, str(tmp_path))
    os.remove(tmp_path / "b/y.txt")
    assert [r.content for r in tree.read_files(held).collect()] == [b"x"]
    assert list(tree.entries(os.fsencode(tmp_path / "none"))) == []

    def refuse(folder):
        raise PermissionError(folder)

    with monkeypatch.context() as m:
        m.setattr(tree.os, "scandir", refuse)
        assert list(tree.entries(os.fsencode(tmp_path / "a"))) == []
    with pytest.raises(NotADirectoryError):
        tree.list_tree(spark, str(tmp_path / "none"))


def test_watch_sees_edits_and_deletions(spark, tmp_path):
    root, state, out = tmp_path / "root", str(tmp_path / "state"), str(tmp_path / "out")
    fill(root, {"a.txt": KEY, "quiet.txt": "none", ".git/x": KEY, "sub/b.txt": KEY})
    seen = []

    def handle(files, n):
        seen.append((n, {os.path.relpath(r.file, root): r.text for r in files.collect()}))
        streams.scan_into(out)(files, n)

    def beat():
        seen.clear()
        streams.watch_tree(spark, str(root), handle, state)  # each call restarts from the checkpoint
        return seen[0][1] if seen else {}

    assert beat() == {"a.txt": KEY, "quiet.txt": "none", "sub/b.txt": KEY}
    assert beat() == {}
    fill(root, {"quiet.txt": "now " + KEY})
    assert beat() == {"quiet.txt": "now " + KEY}
    # The same length again, told apart by its time.
    fill(root, {"quiet.txt": "not " + KEY})
    os.remove(root / "a.txt")
    assert beat() == {"quiet.txt": "not " + KEY}
    assert beat() == {}
    changes = spark.read.parquet(f"{state}/changes").where("batch = 3").collect()
    assert {(os.path.basename(r.path), r.change) for r in changes} == {("quiet.txt", "edited"), ("a.txt", "deleted")}
    found = spark.read.parquet(f"{out}/findings").groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in found} == {0: 2, 2: 1, 3: 1}
    assert sorted(os.listdir(f"{state}/listings")) == ["3", "4"]


def test_a_failed_beat_runs_again(spark, tmp_path):
    root, state = tmp_path / "root", str(tmp_path / "state")
    fill(root, {"a.txt": "one"})
    got = []

    def fails(files, n):
        raise ValueError("lost")

    def keeps(files, n):
        got.append((n, sorted(r.text for r in files.collect())))

    with pytest.raises(Exception, match="lost"):
        streams.watch_tree(spark, str(root), fails, state)
    fill(root, {"b.txt": "two"})
    streams.watch_tree(spark, str(root), keeps, state)
    assert sorted(t for _, texts in got for t in texts) == ["one", "two"]
    assert got[0][0] == 0
