"""Hash chains, log sources, retention, excerpts; diff parsing."""

import hashlib
import json

from pyspark.sql import functions as F

from leakscan_spark.operators import audit
from leakscan_spark.sources.audit import parse_entries, read_log_lines
from leakscan_spark.sources.diffs import added_lines


def chain(n, start=0):
    lines, tip = [], None
    for i in range(start, start + n):
        line = json.dumps({"timestamp": f"2024-01-{i + 1:02d}T00:00:00+00:00", "prevHash": tip, "eventType": "e", "action": {"command": f"c{i}", "riskLevel": "high"}})
        tip = hashlib.sha256((line + "\n").encode()).hexdigest()
        lines.append(line)
    return lines


def breaks(lines):
    """Line-by-line check, the way a reader of one file would do it."""
    out, last = [], None
    for i, raw in enumerate(lines, 1):
        if not raw.strip():
            continue
        try:
            actual = json.loads(raw).get("prevHash")
        except ValueError:
            out.append((i, "malformed JSON"))
            last = raw
            continue
        want = hashlib.sha256((last + "\n").encode()).hexdigest() if last is not None else None
        if actual != want:
            out.append((i, f"first entry has prevHash {actual} but expected null" if want is None else f"prevHash {actual!r} does not match expected {want}"))
        last = raw
    return out


def logs(spark, **named):
    rows = [(k, i, raw) for k, lines in named.items() for i, raw in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "log_id string, line_no long, raw string")


def damaged():
    good = chain(20)
    edited = [*good[:5], good[5].replace("c5", "cX"), *good[6:]]
    deleted = [*good[:7], *good[8:]]
    broken = ["", *good[:3], good[3][:-1], "  ", *good[4:], ""]
    headless = good[1:]
    return {"good": good, "edited": edited, "deleted": deleted, "broken": broken, "headless": headless}


def test_verify_agrees_with_reading_line_by_line(spark):
    named = damaged()
    for block in (1, 3, 7, 100_000):
        got = sorted((r.log_id, r.line_no, r.reason) for r in audit.verify_chain(logs(spark, **named), block).collect())
        assert got == sorted((k, *b) for k, v in named.items() for b in breaks(v))


def test_verification_resumes_behind_its_marks(spark, tmp_path):
    whole = chain(30)
    path = str(tmp_path / "state")

    def run(**named):
        return sorted((r.log_id, r.line_no, r.reason) for r in audit.resume_verification(logs(spark, **named), path).collect())

    assert run(a=whole[:10], b=whole[:5]) == []
    assert run(a=whole[:20], b=whole[:5], c=whole[:3]) == []  # one grows, one is new
    # An entry behind the marks is edited: the break is on the line after it.
    edited = [*whole[:22], whole[22].replace("c22", "zz"), *whole[23:]]
    assert [(k, n) for k, n, _ in run(a=edited, b=whole[:5], c=whole[:3])] == [("a", 24)]
    assert run(a=edited, b=whole[:5], c=whole[:3]) == []  # reported once
    # Cut below the mark, rewritten at the mark, and gone: reported until mended.
    other = [*whole[:2], whole[2].replace("c2", "zz")]
    for _ in range(2):
        got = {k: (n, reason.split(":")[0]) for k, n, reason in run(a=edited[:7], c=other)}
        assert got == {"a": (30, "truncated"), "b": (5, "truncated"), "c": (3, "rewritten")}
    # Entries appended to a rewritten tip do not follow from the mark.
    grown = run(a=edited, b=whole[:5], c=[*other, whole[3].replace(json.loads(whole[3])["prevHash"], hashlib.sha256((other[2] + "\n").encode()).hexdigest())])
    assert [(k, n) for k, n, _ in grown] == [("c", 3), ("c", 4)]


def test_marks_and_full_verification_agree(spark):
    named = damaged()
    for cut in (1, 7, 13):
        lines = logs(spark, **named)
        earlier = lines.where(F.col("line_no") <= cut)
        both = audit.verify_chain(earlier).unionByName(audit.verify_since(lines, audit.log_marks(earlier), 4))
        got = sorted((r.log_id, r.line_no, r.reason) for r in both.collect())
        assert got == sorted((k, *b) for k, v in named.items() for b in breaks(v))


def test_prune_and_reseal(spark):
    named = damaged()
    cutoff = F.lit("2024-01-10").cast("timestamp")
    sealed = audit.prune_and_reseal(logs(spark, **named), cutoff)
    assert audit.verify_chain(sealed).count() == 0
    rows = {(r.log_id, r.line_no): r.raw for r in sealed.collect()}
    assert sum(k == "good" for k, _ in rows) == 11
    first = json.loads(rows["good", 10])
    assert first["prevHash"] is None and first["action"] == {"command": "c9", "riskLevel": "high"}
    manifest = {r.log_id: r for r in audit.retention_manifest(logs(spark, **named), cutoff, 30).collect()}
    assert (manifest["good"].pruned, manifest["good"].retained) == (9, 11)
    assert (manifest["broken"].pruned, manifest["broken"].retained) == (9, 11)
    assert manifest["good"].pre_tip_hash == hashlib.sha256((chain(20)[-1] + "\n").encode()).hexdigest()


def test_line_numbers_survive_splits(spark, tmp_path):
    for name, n in (("a", 4000), ("b", 37)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f"{name}{i}\n" for i in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        rows = read_log_lines(spark, str(tmp_path))
        assert rows.where("raw <> concat(left(raw, 1), line_no)").count() == 0 and rows.count() == 4037
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_queries_alerts_and_excerpts(spark):
    entries = parse_entries(logs(spark, log=[*chain(12), "", "{x", '{"a": 1}']))
    assert entries.count() == 13 and parse_entries(logs(spark, log=['{"a": 1}']), require_timestamp=True).count() == 0
    last = audit.query_log(entries, event_type="e", since="2024-01-03", limit=3).collect()
    assert [r.line_no for r in last] == [10, 11, 12]
    assert audit.alerts(entries).count() == 12 and audit.alerts(entries, "critical").count() == 0 and audit.alerts(entries, "low").count() == 13
    line = entries.where("line_no = 1").select(audit.share_line(F.col("entry"))).first()[0]
    assert line == "  2024-01-01T00:00:00.000Z  e                     HIGH     c0 [unknown]"
    hashed = spark.range(1).select(audit.policy_hash(F.array(F.lit("b"), F.lit('a"\\s')))).first()[0]
    assert hashed == hashlib.sha256(json.dumps(['a"\\s', "b"]).encode()).hexdigest()[:16]


def test_tip_of_each_log(spark):
    got = {r.log_id: r.tip_hash for r in audit.tip_hash(logs(spark, a=["x", "y", " "], b=["z"])).collect()}
    assert got == {k: hashlib.sha256(v).hexdigest() for k, v in (("a", b"y\n"), ("b", b"z\n"))}


PATCH = """diff --git a/one.py b/one.py
index 1..2 100644
--- a/one.py
+++ b/one.py
@@ -1,2 +1,3 @@ def f():
 keep
+first
-gone
+++ looks like a header
--- also not a header
\\ No newline at end of file
@@ -10 +20,2 @@
 x
+second
diff --git a/img.png b/img.png
Binary files a/img.png and b/img.png differ
diff --git a/old b/old
--- a/old
+++ /dev/null
@@ -1 +0,0 @@
-bye
diff --git a/new dir/n.txt b/new dir/n.txt
--- /dev/null
+++ b/new dir/n.txt
@@ -0,0 +1 @@
+form\x0cfeed same line
"""


def test_diffs(spark):
    patches = spark.createDataFrame([(1, PATCH), (2, PATCH.replace("\n", "\r\n")), (3, "--- a/p\n+++ b/p\n@@ -1 +1,2 @@\n+solo"), (4, ""), (5, "+++ b/q\n+no hunk")], "patch_id int, patch string")
    rows = added_lines(patches).collect()
    want = [("one.py", 2, "first"), ("one.py", 3, "++ looks like a header"), ("one.py", 21, "second"), ("new dir/n.txt", 1, "form\x0cfeed same line")]
    for i in (1, 2):
        assert sorted((r.file, r.line, r.text) for r in rows if r.patch_id == i) == sorted(want)
    assert [(r.file, r.line, r.text) for r in rows if r.patch_id > 2] == [("p", 1, "solo")]


def test_reasons_read_findings_that_were_scanned_once(spark):
    from leakscan_spark.plans import catalog

    plan = catalog.deny_reasons(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan and "regexp_extract_all" not in plan


def test_tasks_follow_the_size_of_the_table(spark, tmp_path, monkeypatch):
    from leakscan_spark.plans import inputs

    spark.range(20000).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    dealt = lambda: inputs.dealt(spark, str(tmp_path), "orders", "o_orderkey")
    assert dealt().rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    size = inputs.table_bytes(spark.read.parquet(f"{tmp_path}/orders.parquet"))
    monkeypatch.setattr(inputs, "DEALT_BYTES", size // 20)
    sizes = dealt().rdd.glom().map(len).collect()
    assert len(sizes) == 24 and sum(sizes) == 20000 and max(sizes) < 1.2 * 20000 / 24
