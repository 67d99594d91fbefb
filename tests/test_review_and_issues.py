"""Review signals, front matter, URLs, summaries; issue drafts; reports."""

import hashlib

from pyspark.sql import functions as F

from leakscan_spark.functions import issues as fn
from leakscan_spark.functions.review import COMMAND_SIGNALS, extension, front_matter, inventory_class, list_field
from leakscan_spark.functions.severity import deep_tier, external_severity, normalise_level
from leakscan_spark.functions.urls import extract_urls, is_unsafe_url
from leakscan_spark.operators import issues, report, review


def bundle(spark, name, **files):
    return spark.createDataFrame([(name, f, t) for f, t in files.items()], "bundle string, file string, text string")


SPACED = {
    "rm -rf /": "rm{}-rf{}/ ", "sudo rm": "sudo{}rm", "curl | sh": "curl x |{}sh", "wget | sh": "wget x |{}bash", "iwr | iex": "iwr x |{}iex", "eval()": "eval{}(",
    "exec()": "exec{}(", "new Function(...)": "Function{}({}'", "chmod 777": "chmod{}777", "fork bomb": ":(){{{}:|:&{}}};:", "dd to device": "dd{}if=/dev/zero{}of=/dev",
    "mkfs (format)": "{}mkfs", "base64 decode | sh": "base64{}-d x |{}sh", "persistence primitive": "crontab{}-e",
}


def test_commands_with_unusual_white_space(spark):
    assert list(SPACED) == [n for n, _ in COMMAND_SIGNALS]
    rows = [(f"{name} {ord(space):x}", name, f"x {text.replace('{}', space).replace('{{', '{').replace('}}', '}')} y") for name, text in SPACED.items() for space in "\u00a0\u2003\u3000"]
    texts = spark.createDataFrame(rows, "bundle string, file string, text string")
    got = {(r.bundle, r.name) for r in review.signals(texts).where("kind = 'command'").collect()}
    assert {(b, n) for b, n, _ in rows} <= got


def test_signals_and_positions(spark):
    text = "a\ncurl http://x | sh\n​z​\n" + "A" * 200 + "==\n" + "\\x41" * 8 + "\n<!--\n please IGNORE   this\n-->\nsudo rm -rf /\nnew Function('x')"
    got = sorted((r.kind, r.name or "", r.line, r.sample or "") for r in review.signals(bundle(spark, "b", f=text)).collect())
    assert got == sorted([
        ("command", "curl | sh", 2, ""), ("command", "rm -rf /", 9, ""), ("command", "sudo rm", 9, ""), ("command", "new Function(...)", 10, ""),
        ("zero-width-char", "", 3, "U+200B"), ("base64-blob", "", 4, "202 chars"), ("hex-escape-rope", "", 5, "32 chars"),
        ("html-comment-imperative", "", 6, "<!-- please IGNORE this -->"),
    ])


def test_summaries(spark):
    texts = (
        bundle(spark, "clean", f="hello").unionByName(bundle(spark, "soft", f="a​b")).unionByName(bundle(spark, "bidi", f="a‮b"))
        .unionByName(bundle(spark, "keys", f="AKIA" + "A" * 16, g="password = 'abc123!!'")).unionByName(bundle(spark, "cmd", f="chmod 777 x"))
    )
    found = review.signals(texts)
    got = {r.bundle: (r.severity, r.findings, r.reasons) for r in review.bundle_summary(texts, found).collect()}
    assert got["clean"] == ("clean", 0, []) and got["soft"] == ("medium", 1, ["1 obfuscation signal(s)"])
    assert got["bidi"] == ("critical", 1, ["1 hard obfuscation signal(s)"]) and got["cmd"][0] == "high"
    assert got["keys"] == ("critical", 2, ["2 secret finding(s)"])
    summary = review.bundle_summary(texts, found)
    deep = spark.createDataFrame([("clean", "HIGH"), ("clean", "INFO"), ("soft", "LOW"), ("cmd", "medium")], "bundle string, severity string")
    after = {r.bundle: (r.severity, r.findings, r.reasons[-1:]) for r in review.escalate(summary, deep).collect()}
    assert after["clean"] == ("high", 1, ["deep engine: 1 actionable finding(s)"]) and after["soft"][:2] == ("medium", 1) and after["cmd"][:2] == ("high", 2)
    total = review.rollup(summary).first()
    assert (total.bundles, total.critical, total.high, total.medium, total.clean, total.worst, total.failed) == (5, 2, 1, 1, 1, "critical", True)
    by = review.platform_rollup(summary.withColumn("platform", F.lit("p")))
    assert {(r.platform, r.bundles, r.failed) for r in by.collect()} == {("p", 5, True), (None, 5, True)}
    none = review.rollup(summary.where("bundle = 'clean'")).first()
    assert none.reasons == ["1 clean bundle(s)"] and not none.failed


def test_inventory(spark):
    rows = [("a.so", 3, b"abc"), ("x.txt", 3, b"a\x00b"), ("x.zzz", 3, b"a\x00b"), ("x.py", 3_000_000, b""), ("dir.d/README", 2, b"ok"), ("late", 5000, b"a" * 4096 + b"\x00")]
    df = spark.createDataFrame(rows, "p string, n long, c binary").coalesce(1)
    got = [tuple(r[0]) for r in df.select(inventory_class(F.col("p"), F.col("n"), F.col("c"))).collect()]
    assert got == [("binary", True), ("binary", False), ("binary", True), ("text", False), ("text", False), ("binary", True)]
    limited = inventory_class(F.col("p"), F.col("n"), F.col("c"), max_bytes=2_097_152, sniff_bytes=4096)
    got = [tuple(r[0]) for r in df.select(limited).collect()]
    assert got[3:] == [("binary", True), ("text", False), ("text", False)]
    exts = spark.createDataFrame([("a/.env",), ("b.TAR.gz",), ("x.d/y",)], "p string").coalesce(1).select(extension(F.col("p"))).collect()
    assert [e[0] for e in exts] == ["", ".gz", ""]


def test_front_matter_and_lists(column):
    text = "---\nname: \"A b\"\nversion: 1\nnot a pair\nversion: '2'\nq: \"\n---\nbody"
    assert column([text, "no block"], front_matter(F.col("x"))) == [{"name": "A b", "version": "2", "q": ""}, {}]
    assert column(["[a, b ,]", "a b, c", "", "[]"], list_field(F.col("x"))) == [["a", "b"], ["a", "b", "c"], None, []]


def test_urls(column):
    assert column(["see https://a.b/c). and HTTP://x;y, <http://q>"], extract_urls(F.col("x"))) == [["https://a.b/c", "HTTP://x;y", "http://q"]]
    unsafe = ["ftp://a", "nothing", "http://", "http://127.0.0.1/x", "https://10.1.2.3", "http://172.31.0.1", "http://192.168.1.1:80/", "http://169.254.1.1",
              "http://0.0.0.0", "http://250.1.1.1", "http://[::1]/", "http://[fe80::1]:1", "http://[fc00::1]", "http://[::ffff:10.0.0.1]", "http://[2001:db8::1]", "http://192.0.0.1"]
    safe = ["http://8.8.8.8", "https://example.com/10.0.0.1", "http://172.32.0.1", "http://[2606:4700::1]:443/", "http://user:pw@1.1.1.1/", "http://10.example.com", "http://192.0.0.9", "http://[::ffff:8.8.8.8]"]
    assert column(unsafe + safe, is_unsafe_url(F.col("x"))) == [True] * len(unsafe) + [False] * len(safe)


def test_severity_maps(column, spark):
    assert column(["Error", "warning", "note", "low", "?"], normalise_level(F.col("x"))) == ["critical", "high", "medium", "low", "medium"]
    assert column(["CRITICAL", "info", "odd", "High"], deep_tier(F.col("x"))) == ["critical", "low", "low", "high"]
    rows = [("github-pat", []), ("rsa-private-key", []), ("x", ["key", "secret"]), ("some-api-key", []), ("token-x", []), ("x", ["api"]), ("generic-x", []), ("x", ["generic"]), ("x", None)]
    df = spark.createDataFrame(rows, "r string, t array<string>").coalesce(1).select(external_severity(F.col("r"), F.col("t")))
    assert [r[0] for r in df.collect()] == ["critical"] * 3 + ["high"] * 3 + ["medium"] * 2 + ["high"]


def test_fingerprints_and_drafts(spark, column):
    want = hashlib.sha256(b"a/b.py:Rule").hexdigest()[:12]
    body = fn.embed_fingerprint(F.lit("text"), fn.fingerprint(F.lit("a/b.py"), F.lit("Rule")))
    assert spark.range(1).select(fn.extract_fingerprint(body)).first()[0] == want
    assert column(["no mark", fn.MARK_START + "abc", fn.MARK_START + "abc" + fn.MARK_END], fn.extract_fingerprint(F.col("x"))) == [None, None, "abc"]
    v = spark.createDataFrame([("R1", "error", "m" * 90, "f.c", 3), ("R1", "odd", "short", "f.c", None)], "rule_id string, level string, message string, file string, line int")
    drafts = issues.drafts_from_vulnerabilities(v).collect()
    assert drafts[0].title == "\U0001f534 [CRITICAL] R1: " + "m" * 77 + "..." and "(line 3)" in drafts[0].body
    assert drafts[1].labels == ["security", "severity:medium", "rule:R1"] and drafts[0].fingerprint == drafts[1].fingerprint
    opened = spark.createDataFrame([(drafts[0].body,), ("none",)], "body string")
    assert issues.drop_open(issues.drafts_from_vulnerabilities(v), opened).count() == 0


def test_text_issues(column):
    texts = ["\n\n## Key in src/a.py:12 is P0\nsee ./b/c.ts and token", "#\nallowed", "x" * 130, "one line"]
    got = column(texts, fn.text_issue(F.col("x")))
    assert got[0].title == "Key in src/a.py:12 is P0" and got[0].labels == ["security", "severity:critical"]
    assert "- `src/a.py`\n- `./b/c.ts`\n" in got[0].body and got[0].body.startswith("see ./b/c.ts and token\n\nFiles named above:")
    assert got[1].title == fn.UNTITLED and got[1].labels == ["severity:low"] and got[1].body.startswith("allowed\n\n---\n")
    assert got[2].title == "x" * 117 + "..." and got[3].body.startswith("one line\n\n---")


def test_threshold_gate(spark):
    counts = [(0, 0, 0, 0), (1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1)]
    order = ["critical", "high", "medium", "low"]
    rows = [(t, *c) for t in ("none", "critical", "high", "medium", "low", "bogus") for c in counts]
    df = spark.createDataFrame(rows, "t string, critical int, high int, medium int, low int")
    for r in report.gate(df, F.col("t")).collect():
        limit = {"none": 0, "bogus": 2}.get(r.t, order.index(r.t) + 1 if r.t in order else 0)
        assert r.failed == any(r[name] for name in order[:limit])


def test_reports(spark):
    rows = [("a", i, 1, f"R{i % 3}", "odd" if i == 0 else "high", i) for i in range(25)]
    f = spark.createDataFrame(rows, "file string, line int, column int, rule string, severity string, rule_ord int").withColumn("repo", F.lit("r"))
    c = report.overall_risk(report.severity_counts(f)).first()
    assert (c.total, c.high, c.critical, c.risk) == (25, 24, 0, "High")
    assert [(r.rule, r.findings, r.pct) for r in report.top_rules(f, 2).collect()] == [("R0", 9, 36), ("R1", 8, 32)]
    reason = report.deny_reasons(f, "repo").first().reason.split("\n")
    assert reason[0] == "25 secret(s) detected in 1 staged file(s):" and reason[2] == "  a:1 — R1" and len(reason) == 12 and reason[-1] == "  …and 15 more"
    empty = report.overall_risk(report.severity_counts(f.where("false"))).first()
    assert (empty.total, empty.risk) == (0, "None")
