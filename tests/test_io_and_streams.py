"""Corpora, rule files, findings files, and streaming jobs."""

import json

import pytest
from pyspark.sql import functions as F

from leakscan_spark.functions.rules import BUILTIN_RULES, Rule
from leakscan_spark.operators import audit
from leakscan_spark.operators.scan import scan_files
from leakscan_spark.sources import corpus, external, findings as io, rules as rule_source, suppressions as supp
from leakscan_spark.streaming import streams

KEY = "AKIA" + "K" * 16


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "tree"
    files = {
        "a.py": f"x\r\nkey = {KEY}\rend", "node_modules/m.js": KEY, "deep/" * 3 + "f.txt": KEY, "pic.PNG": KEY, "lib/vendor/v.py": KEY,
        ".env": "none", "dist": KEY,
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    (root / "bad.bin2").write_bytes(b"\xff" + KEY.encode() + b"\xc3\xa9\xfe")
    return root


def test_corpus(spark, tree):
    rows = {r.file: r.text for r in corpus.read_corpus(spark, str(tree)).collect()}
    assert set(rows) == {"a.py", "deep/deep/deep/f.txt", "lib/vendor/v.py", ".env", "bad.bin2"}
    assert rows["a.py"] == f"x\nkey = {KEY}\nend" and rows["bad.bin2"] == KEY + "é"
    few = corpus.read_corpus(spark, str(tree), ["lib/vendor/", "bad*"], max_depth=3)
    assert {r.file for r in few.collect()} == {"a.py", ".env"}
    found = {(r.file, r.line, r.column) for r in scan_files(corpus.read_corpus(spark, str(tree))).collect()}
    assert ("a.py", 2, 7) in found and len(found) == 4


def test_rule_files(spark, tmp_path):
    (tmp_path / "mine.txt").write_text("# c\n\n tok_[0-9]+ \n([bad\n")
    (tmp_path / "more.json").write_text(json.dumps([
        {"name": "J", "pattern": "j{3}", "severity": "low", "description": "d"}, {"pattern": "k"}, {"name": "S", "pattern": "s", "severity": "urgent"}, {"name": "N", "pattern": ""},
    ]))
    both = rule_source.read_rule_lines(spark, str(tmp_path)).unionByName(rule_source.read_rule_json(spark, str(tmp_path)))
    checked = rule_source.check_rules(both)
    assert {(r.regex, r.rejected) for r in checked.where("rejected is not null").collect()} == {("([bad", "invalid regex"), ("s", "invalid severity"), ("", "missing regex")}
    got = rule_source.collect_rules(checked)
    assert set(got) == {Rule("Custom (mine)", "tok_[0-9]+", "high"), Rule("J", "j{3}", "low", "d"), Rule("Custom (more)", "k", "high")}


def test_policy_ignore_rules(spark):
    df = spark.createDataFrame([(0, ["a", "b"], ["r", "s"], "why"), (1, ["c"], [], None), (2, ["d"], None, None)], "ord int, paths array<string>, rules array<string>, reason string")
    got = [(s.path_glob, s.rule, s.reason) for s in supp.collect_suppressions(supp.policy_suppressions(df))]
    assert got == [("a", "r", "why"), ("a", "s", "why"), ("b", "r", "why"), ("b", "s", "why"), ("c", None, None), ("d", None, None)]


def test_external_report(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([
        {"RuleID": "github-pat", "Description": "d", "File": "f", "StartLine": 3, "StartColumn": 4, "Secret": "0123456789", "Tags": ["x"]},
        {"Description": "only text", "Match": "short"},
    ]))
    got = {r.rule: (r.file, r.line, r.column, r.severity, r.redacted) for r in external.read_external_report(spark, str(tmp_path)).collect()}
    assert got == {"github-pat": ("f", 3, 4, "critical", "0123**6789"), "only text": ("unknown", None, None, "high", "*****")}


def test_findings_round_trip(spark, texts, tmp_path):
    found = scan_files(texts({"a": f"{KEY}\n" * 3, "b": "clean", "c": KEY}))
    hidden = spark.createDataFrame([("z", 1, 1, "R", "high", None, "policy")], "file string, line int, column int, rule string, severity string, reason string, source string")
    io.write_json(found, str(tmp_path / "out"), hidden)
    raw = "".join(p.read_text() for p in (tmp_path / "out/results").glob("*.json"))
    assert KEY not in raw and '"scan_mode":"local"' in raw
    back = io.unpack_results(spark.read.schema(f"results array<struct<file: string, matches: {io.RESULT_SCHEMA.split('matches ')[1]}>>, {io.RESULT_SCHEMA}").json(str(tmp_path / "out/results")))
    assert sorted((r.file, r.line, r.column, r.rule, r.redacted) for r in back.collect()) == sorted((r.file, r.line, r.column, r.rule, r.redacted) for r in found.collect())
    wrapped = {"results": [{"file": "w", "matches": [{"pattern": {"name": "P"}, "line": 1}]}]}
    bare = [{"file": "v", "matches": [{"pattern": {"name": "Q", "severity": "low"}}]}]
    for name, value in (("wrapped", wrapped), ("bare", bare)):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    got = {(r.file, r.rule, r.severity) for n in ("wrapped", "bare") for r in io.read_json(spark, str(tmp_path / f"{n}.json")).collect()}
    assert got == {("w", "P", "medium"), ("v", "Q", "low")}
    parts = io.json_results(found, lines_per_row=2).orderBy("file", "part").collect()
    assert [(r.file, r.part, len(r.matches)) for r in parts] == [("a", 0, 1), ("a", 1, 2), ("c", 0, 1)]
    io.write_sarif(found, str(tmp_path / "sarif"))
    assert spark.read.json(str(tmp_path / "sarif/results")).where("locations[0].physicalLocation.region.startColumn = 1").count() == 4


def test_parts_by_count(spark, tmp_path):
    """A file of one line, a file of many, equal findings, absent places, and an empty table."""
    schema = "file string, line int, column int, rule string, rule_ord int, severity string, description string, redacted string"
    rows = [("one", 1, i, f"R {i % 3}", i % 3, "high", "d", "x") for i in range(1, 108)]
    rows += [("many", i, 1, "R 0", 0, "low", "", "x") for i in range(1, 32)]
    rows += [("same", 5, 5, "R 1", 1, "high", None, "y")] * 7 + [("a\\b", None, None, "R 2", None, "medium", "e", None), (None, 0, 0, "R 2", 2, "low", "e", "z")]
    found = spark.createDataFrame(rows, schema).repartition(5)
    parts = io.json_parts(found, 10).collect()
    assert max(len(r.matches) for r in parts) == 10
    got = {}
    for r in sorted(parts, key=lambda r: r.part):
        got.setdefault(r.file, []).extend((m.line, m.column, m.pattern.name) for m in r.matches)
    want = {}
    for r in sorted(rows, key=lambda r: (r[1] or 0, r[2] or 0)):
        want.setdefault(r[0], []).append((r[1], r[2], r[3]))
    assert got == want
    places = sorted(r.n for r in io.numbered(found).collect())
    assert places == list(range(len(rows)))
    io.write_sarif_documents(found, str(tmp_path / "sarif"), 50)
    files = sorted((tmp_path / "sarif").glob("part=*/*.txt"))
    documents = [json.loads(p.read_text()) for p in files]
    assert [len(d["runs"][0]["results"]) for d in documents] == [50, 50, 47]
    for d in documents:
        assert d["version"] == "2.1.0" and d["$schema"].endswith("sarif-schema-2.1.0.json") and len(d["runs"]) == 1
        rules = d["runs"][0]["tool"]["driver"]["rules"]
        results = d["runs"][0]["results"]
        assert [rules[r["ruleIndex"]]["id"] for r in results] == [r["ruleId"] for r in results]
        assert [r["id"] for r in rules] == list(dict.fromkeys(r["ruleId"] for r in results))
        assert all(r["shortDescription"]["text"] for r in rules)
    uris = [r["locations"][0]["physicalLocation"] for d in documents for r in d["runs"][0]["results"]]
    assert sum("region" not in u for u in uris) == 2 and any(u["artifactLocation"].get("uri") == "a/b" for u in uris)
    (empty,) = io.sarif_documents(found.limit(0)).collect()
    assert json.loads(empty.document)["runs"] == [{"tool": {"driver": {"name": "leakscan-spark", "rules": []}}, "results": []}]


def test_watch_and_scan(spark, tmp_path):
    inbox, out = tmp_path / "in", tmp_path / "out"
    (inbox / ".git").mkdir(parents=True)
    (inbox / "one.txt").write_text(KEY)
    (inbox / ".git/x").write_text(KEY)

    def run():
        streams.scan_stream(streams.watch_files(spark, str(inbox)), str(out), str(tmp_path / "cp"), BUILTIN_RULES, [supp.Suppression("quiet*")])

    run()
    (inbox / "two.txt").write_text(KEY + "\n" + KEY)
    (inbox / "quiet.txt").write_text(KEY)
    run()
    kept = spark.read.parquet(str(out / "findings"))
    assert sorted(r.file.rsplit("/", 1)[1] for r in kept.collect()) == ["one.txt", "two.txt", "two.txt"] and "match" not in kept.columns
    events = spark.read.parquet(str(out / "audit"))
    assert events.count() == 4 and events.where("action.riskLevel = 'critical'").count() == 4


def test_chained_stream_continues(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "log", "cp"))
    for start in (0, 40):
        batch = spark.range(start, start + 40).select((F.col("id") % 3).cast("string").alias("log_id"), F.col("id").alias("ord"), F.to_json(F.struct("id")).alias("event"))
        batch.write.mode("append").parquet(src)
        streams.append_chain(spark.readStream.schema("log_id string, ord long, event string").parquet(src), out, cp)
    lines = spark.read.parquet(out).select("log_id", F.col("seq").alias("line_no"), "raw")
    assert lines.count() == 80 and audit.verify_chain(lines, 5).count() == 0
    assert lines.where("log_id = '0'").agg(F.max("line_no")).first()[0] == 27


def test_registered_queries_cover_their_checks(spark):
    import __spark_entry__ as driver
    from leakscan_spark.plans.catalog import registry

    own = {n for n in driver.queries() if n in registry()}
    assert own == set(registry()) == set(driver.oracle_sql()) & own
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).columns == ["file", "line", "column", "rule", "severity", "redacted"]


def test_table_stream_reads_folders_and_single_files(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("event_id"), F.concat(F.lit("x"), "id").alias("text"))
    rows.repartition(4).write.parquet(str(tmp_path / "many" / "events.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one-folder"))
    (tmp_path / "one").mkdir()
    [part] = (tmp_path / "one-folder").glob("*.parquet")
    part.rename(tmp_path / "one" / "events.parquet")
    for place in ("many", "one"):
        out, cp = streams.fresh_paths(spark, "table")
        stream = streams.watch_table(spark, str(tmp_path / place), "events", rows.schema)
        streams.transform_stream(stream, lambda df: df, out, cp)
        assert spark.read.parquet(f"{out}/*").count() == 40


def test_excluded_files_are_not_opened(spark, tmp_path):
    for name in ("a/ok.txt", "a/with space+plus.txt", "a/big.zip", "node_modules/x.js", "docs/d.md", ".env", ".git/config"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("text of " + name)
    files = corpus.read_corpus(spark, str(tmp_path), ["docs"])
    assert sorted(r.file for r in files.collect()) == [".env", "a/ok.txt", "a/with space+plus.txt"]
    plan = files._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    read = sum(leaves.apply(i).metrics().get("numFiles").get().value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numFiles"))
    assert read == 0 or read == 2  # metadata alone decides which files a task opens
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    wanted = corpus.wanted(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), str(tmp_path), ["docs"])
    df = listed.where(wanted).select("content")
    df.collect()
    assert df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numFiles").get().value() == 2


def test_rule_files_keep_their_order(spark, tmp_path):
    (tmp_path / "b.txt").write_text("zz[0-9]\n# note\naa[0-9]\r\nmm[0-9]")
    (tmp_path / "a.txt").write_text("last[0-9]\nfirst[0-9]\n")
    (tmp_path / "c.json").write_text('[{"name": "Z", "pattern": "z{2}"}, {"name": "A", "pattern": "a{2}", "severity": "low"}]')
    both = rule_source.read_rule_lines(spark, str(tmp_path)).unionByName(rule_source.read_rule_json(spark, str(tmp_path)))
    got = rule_source.collect_rules(rule_source.check_rules(both.repartition(7)))
    assert [r.regex for r in got] == ["last[0-9]", "first[0-9]", "zz[0-9]", "aa[0-9]", "mm[0-9]", "z{2}", "a{2}"]


def test_policy_and_ignore_file_make_one_list(spark):
    policy = spark.createDataFrame([(0, ["x/**", "*.env"], [], "why")], "ord int, paths array<string>, rules array<string>, reason string")
    lines = spark.createDataFrame([(0, "*.env"), (1, "b/*:R")], "ord int, value string")
    table = supp.ordered_suppressions(supp.policy_suppressions(policy), supp.parse_suppression_lines(lines))
    assert [(s.path_glob, s.rule, s.source) for s in supp.collect_suppressions(table)] == [
        ("x/**", None, "policy"), ("*.env", None, "policy"), ("*.env", None, "ignore-file"), ("b/*", "R", "ignore-file"),
    ]
