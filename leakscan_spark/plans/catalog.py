"""The registered queries: every operator over inputs derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import issues as issue_fns
from ..functions import paths, payloads, redaction, review as review_fns, severity, urls
from ..functions.columns import computed_once
from ..functions.matching import has_matches
from ..functions.risk import CommandPolicy
from ..functions.rules import BUILTIN_RULES, Rule
from ..operators import audit, commands, ignores, issues, report, review, triage
from ..operators.rule_index import scan_files_indexed
from ..operators.scan import scan_files, scan_lines, scan_texts, split_lines
from ..operators.table_function import register_scan_function
from ..session import prepare, shared_dir
from ..sources import corpus as corpus_source
from ..sources import diffs, external, findings as findings_io, rules as rule_source, suppressions as supp
from ..sources.audit import parse_entries
from ..streaming import streams
from . import inputs
from .policy import APPROVAL, BLOCKED, RETENTION_CUTOFF, RETENTION_DAYS

SERVICE_RULE = Rule("Service Token", r"token\s*=\s*\"[0-9a-f]{40}\"", "high", "Service token")
# Runs on the Arrow matcher: the JVM has no such group name.
NAMED_RULE = Rule("Named Token", r"token\s*=\s*\"(?P<the_value>[0-9a-f]{40})\"", "high", "Service token")
# As many rules as a large organisation keeps: one for each beginning of a token.
MANY_RULES = [
    Rule(f"Token {i:03x}", f'token = "{i:03x}[0-9a-f]{{37}}"', "high", "Service token", ('token = "',)) for i in range(512)
]
# Thousands of rules, each with a needle of its own.
INDEXED_RULES = [
    Rule(f"{kind} key {i:03x}", f"{kind}_{i:03x}[0-9A-Za-z]{{33}}", "high", "Service key") for kind in ("ghp", "npm") for i in range(4096)
]
EXCLUDE = ("docs", "src/vendor", "repo_1/config/", "*/tests/*", "*.md")
SUPPRESSIONS = (
    supp.Suppression("tests/fixtures/**", None, "test data", supp.POLICY_SOURCE),
    supp.Suppression("*.env", "github personal access token", "rotated", supp.POLICY_SOURCE),
    supp.Suppression("src/*.js", None, "bundled", supp.POLICY_SOURCE),
    supp.Suppression("*.env", None, None, supp.FILE_SOURCE),
    supp.Suppression("repo_?/docs/**", "AWS Access Key ID", None, supp.FILE_SOURCE),
    supp.Suppression("/abs/only/**", None, None, supp.FILE_SOURCE),
)
POLICY = CommandPolicy(mode="approve-dangerous", blocked=BLOCKED, approval=APPROVAL)
FINDING = ("file", "line", "column", "rule", "severity", "redacted")


# -- shared steps ------------------------------------------------------------


def planted_findings(spark: SparkSession, sf: str) -> DataFrame:
    return scan_files(inputs.planted(spark, sf).select("file", "text"))


def stored_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The findings as a step of their own: scanned once, read as often as a query needs."""
    path = f"{shared_dir(spark, 'findings')}/found"
    planted_findings(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


def stored_diff_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The findings on added lines as a step of their own."""
    path = f"{shared_dir(spark, 'diff-findings')}/found"
    _diff_findings(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


def _external(findings: DataFrame) -> DataFrame:
    """Another engine's report on the cloud and code-host keys of the same files."""
    f = F.col
    report_rows = findings.where(f("rule_ord") < 6).select(
        F.lower(F.regexp_replace("rule", " ", "-")).alias("RuleID"), F.concat(F.lit("ext "), "rule").alias("Description"),
        f("file").alias("File"), f("line").alias("StartLine"),
        # Every other one reports a different column and is not the same finding.
        (f("column") + f("line") % 2).cast("int").alias("StartColumn"),
        f("match").alias("Secret"), F.lit(None).cast("string").alias("Match"),
        F.when(f("rule_ord") == 0, F.array(F.lit("key"), F.lit("secret"))).when(f("rule_ord") == 1, F.array(F.lit("api")))
        .otherwise(F.array().cast("array<string>")).alias("Tags"),
    )
    return external.external_findings(report_rows)


def _baseline(findings: DataFrame) -> DataFrame:
    """A baseline of every second-line finding, and of whole files for one rule."""
    f = F.col
    placed = findings.where(f("line") == 2).select("file", "line", "rule")
    whole = findings.where(f("rule") == "Bearer Token").select("file", F.lit(None).cast("int").alias("line"), "rule")
    return findings_io.baseline_entries(placed.unionByName(whole), F.lit("2024-01-01").cast("timestamp"))


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    return triage.mark_suppressed(planted_findings(spark, sf), SUPPRESSIONS)


def _diff_findings(spark: SparkSession, sf: str) -> DataFrame:
    added = diffs.added_lines(inputs.patches(spark, sf), ("patch_id", "repo"))
    return scan_lines(added, keep=("patch_id", "repo", "file"))


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    return review.signals(inputs.page_texts(spark, sf))


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    texts = inputs.page_texts(spark, sf)
    inventory = review.inventory_signals(review.with_inventory(inputs.page_files(spark, sf)))
    return review.bundle_summary(texts, review.signals(texts).unionByName(inventory))


def _deep(spark: SparkSession, sf: str) -> DataFrame:
    """A deep analyser's findings: one per page, its tier from the page number."""
    tiers = inputs.case("page_id", ["'INFO'", "'LOW'", "'MEDIUM'", "'HIGH'", "'weird'", "'LOW'"])
    return inputs.pages(spark, sf).selectExpr("bundle", f"{tiers} AS severity")


# -- scans -------------------------------------------------------------------


def custom_rule_findings(spark, sf):
    return scan_files(inputs.documents(spark, sf), [SERVICE_RULE]).select(*FINDING)


def many_rule_findings(spark, sf):
    """512 rules over all documents, on the JVM's regex functions."""
    return scan_files(inputs.documents(spark, sf), MANY_RULES).select(*FINDING)


def indexed_rule_findings(spark, sf):
    """8,192 rules over all documents and planted files, through one automaton."""
    return scan_files_indexed(inputs.corpus(spark, sf), INDEXED_RULES).select(*FINDING)


def arrow_rule_findings(spark, sf):
    return scan_files(inputs.documents(spark, sf), [NAMED_RULE]).select(*FINDING)


def builtin_rule_findings(spark, sf):
    return scan_files(inputs.corpus(spark, sf)).select(*FINDING)


def unplaced_findings(spark, sf):
    return scan_texts(inputs.corpus(spark, sf)).select("file", "rule", "severity", "redacted")


def scan_table_function(spark, sf):
    """The whole corpus through the table function, from SQL."""
    register_scan_function(spark)
    inputs.corpus(spark, sf).createOrReplaceTempView("scanned_corpus")
    found = spark.sql("SELECT c.file, f.rule, f.severity, f.match FROM scanned_corpus c, LATERAL scan_text(c.text) f")
    return found.select("file", "rule", "severity", redaction.redact_token(F.col("match")).alias("redacted"))


def has_secrets(spark, sf):
    numbered = list(enumerate(BUILTIN_RULES))
    return inputs.corpus(spark, sf).select("file", has_matches("text", numbered).alias("has_secrets"))


def line_table(spark, sf):
    lines = split_lines(inputs.documents(spark, sf))
    return lines.groupBy("file").agg(
        F.count("*").alias("lines"), F.sum(F.length("text")).alias("characters"),
        F.max("line").alias("last_line"), F.count_if(F.col("text") == "").alias("empty_lines"),
    )


def excluded_paths_scan(spark, sf):
    files = corpus_source.drop_excluded(inputs.planted(spark, sf).select("file", "text"), EXCLUDE)
    return scan_files(files).select(*FINDING)


def corpus_path_rules(spark, sf):
    """Which planted files a directory walk would read at all."""
    files = inputs.planted(spark, sf).select("file")
    return files.select("file", corpus_source.is_scannable(F.col("file"), ("deploy/",), 4).alias("scannable"))


def ignored_files(spark, sf):
    files = inputs.planted(spark, sf)
    ignored = files.where(F.col("file").endswith(".env")).select("file")
    return corpus_source.drop_ignored(files, ignored).select("file", "repo")


def ignore_rules(spark, sf):
    """Planted files that the ignore files of their repositories leave in."""
    files = inputs.planted(spark, sf).select("repo", F.expr("substr(file, length(repo) + 2)").alias("file"))
    return ignores.drop_ignored_by(files, inputs.ignore_lines(spark, sf), ["repo"]).select("repo", "file")


def engine_union(spark, sf):
    found = stored_findings(spark, sf)
    merged = triage.union_engines(_external(found), found)
    return merged.select(*FINDING, F.array_join("engines", ",").alias("engines"))


def external_report(spark, sf):
    return _external(planted_findings(spark, sf)).select(*FINDING, "description")


def baseline_filter(spark, sf):
    found = stored_findings(spark, sf)
    return triage.apply_baseline(found, _baseline(found)).select(*FINDING)


def baseline_show(spark, sf):
    return findings_io.show_baseline(_baseline(planted_findings(spark, sf)))


def suppression_split(spark, sf):
    m = _marked(spark, sf)
    by = F.col("suppressed_by")
    return m.select(
        *FINDING, by.isNotNull().alias("suppressed"), by["reason"].alias("reason"), by["source"].alias("source")
    )


def scan_verdict(spark, sf):
    unit = F.concat_ws(
        " ", F.regexp_extract("file", "^(.*)/", 1), F.right(F.regexp_extract("file", "([^/.]*)[.]", 1), F.lit(2)),
        F.regexp_extract("file", "[.]([a-z]+)$", 1),
    ).alias("unit")
    units = inputs.planted(spark, sf).select(unit)
    return report.verdict(_marked(spark, sf).select(unit, "suppressed_by"), units, "unit")


def suppression_table(spark, sf):
    """Suppressions as one ordered table, thousands of globs derived from parts: policy first, then the ignore file."""
    parts = inputs.load(spark, sf, "part", "p_partkey")
    policy = parts.selectExpr(
        "p_partkey AS ord", "array(concat('src/order_', p_partkey * 7, '.*'), concat('*_', p_partkey, '.env')) AS paths",
        "CASE WHEN p_partkey % 2 = 0 THEN array() ELSE array('GitHub App Token') END AS rules", "concat('part ', p_partkey) AS reason",
    )
    lines = parts.selectExpr("p_partkey AS ord", "concat('docs/order_', p_partkey * 3, '.*') AS value")
    table = supp.ordered_suppressions(supp.policy_suppressions(policy), supp.parse_suppression_lines(lines))
    m = triage.mark_suppressed(stored_findings(spark, sf), table)
    by = F.col("suppressed_by")
    return m.select(*FINDING, by["reason"].alias("reason"), by["source"].alias("source"))


def policy_ignore_rules(spark, sf):
    """Ignore rules of many owners (one per customer) flattened to suppressions."""
    owners = inputs.load(spark, sf, "customer", "c_custkey", "c_mktsegment")
    entries = owners.selectExpr(
        "c_custkey AS ord", "array(concat('src/', lower(c_mktsegment), '/**'), '*.log') AS paths",
        "CASE WHEN c_custkey % 3 = 0 THEN array() ELSE array('Bearer Token', c_mktsegment) END AS rules",
        "concat('owner ', c_custkey) AS reason",
    )
    s = supp.policy_suppressions(entries)
    return s.select(F.col("ord.ord").alias("owner"), "path_glob", "rule", "reason", "source")


def suppression_lines(spark, sf):
    """Ignore-file lines (one per part) parsed into suppressions."""
    lines = inputs.load(spark, sf, "part", "p_partkey", "p_name", "p_brand").selectExpr(
        "p_partkey AS ord",
        "CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN concat('  # ', p_name) WHEN 1 THEN concat(p_brand, '/** : ', p_name, ' : x ') "
        "WHEN 2 THEN concat(' *.', p_brand, ':') ELSE concat(p_brand, '/', p_name) END AS value",
    )
    return supp.parse_suppression_lines(lines).select("ord", "path_glob", "rule", "source")


def suppression_upsert(spark, sf):
    owners = inputs.load(spark, sf, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    current = owners.selectExpr(
        "c_nationkey AS owner", "c_custkey AS ord", "array(c_mktsegment, 'docs/**') AS paths",
        "array('Bearer Token') AS rules", "concat('since ', c_custkey) AS reason",
    )
    incoming = owners.where("c_custkey % 2 = 0").selectExpr(
        "c_nationkey AS owner", "c_custkey AS ord",
        "CASE WHEN c_custkey % 4 = 0 THEN array('docs/**', c_mktsegment, 'docs/**') ELSE array('new/**', CAST(c_custkey AS STRING)) END AS paths",
        "CASE WHEN c_custkey % 4 = 0 THEN array('Bearer Token', 'Bearer Token') ELSE array() END AS rules",
        "CASE WHEN c_custkey % 8 = 0 THEN ' ' ELSE concat('now ', c_custkey) END AS reason",
    )
    merged = triage.upsert_suppressions(current, incoming)
    return merged.select("owner", "ord", F.array_join("paths", ",").alias("paths"), "reason", "action")


# -- reports -----------------------------------------------------------------


def findings_per_file(spark, sf):
    return report.findings_per_file(planted_findings(spark, sf))


def severity_histogram(spark, sf):
    return report.severity_counts(planted_findings(spark, sf))


def overall_risk(spark, sf):
    found = planted_findings(spark, sf).withColumn("repo", F.substring_index("file", "/", 1))
    return report.overall_risk(report.severity_counts(found, "repo"))


def top_rules(spark, sf):
    return report.top_rules(planted_findings(spark, sf))


def findings_by_severity(spark, sf):
    return report.by_severity(stored_findings(spark, sf)).select(*FINDING)


def threshold_gate(spark, sf):
    found = planted_findings(spark, sf).withColumn("repo", F.substring_index("file", "/", 1))
    counts = report.severity_counts(found, "repo")
    names = F.array(*[F.lit(t) for t in ("none", "critical", "high", "medium", "low", "odd")])
    return report.gate(counts.select("*", F.explode(names).alias("threshold")), F.col("threshold")).select(
        "repo", "threshold", "failed"
    )


def level_counts(spark, sf):
    return report.level_counts(inputs.vulnerabilities(spark, sf), "file")


def notify_summary(spark, sf):
    v = inputs.vulnerabilities(spark, sf)
    found = v.select(
        F.col("file").alias("scan_id"),
        F.struct(F.coalesce("line", F.lit(0)), "rule_id", "level", "message").alias("ord"),
        severity.normalise_level(F.col("level")).alias("severity"), F.col("rule_id").alias("title"), F.col("file").alias("location"),
    )
    statuses = inputs.case("p_partkey", ["'completed'", "'completed'", "'failed'", "'queued'"])
    scans = inputs.load(spark, sf, "part", "p_partkey").selectExpr(
        "concat('part/', CAST(p_partkey AS STRING), '.c') AS scan_id", f"{statuses} AS status"
    )
    return report.notification(scans, found)


def rules_per_file(spark, sf):
    return report.rules_per_file(planted_findings(spark, sf))


def json_results(spark, sf):
    rows = findings_io.json_results(planted_findings(spark, sf))
    return rows.select("file", "part", F.to_json("matches").alias("matches"))


def json_reread(spark, sf):
    rows = findings_io.json_results(planted_findings(spark, sf)).select("file", "matches")
    nested = rows.select(
        F.when(F.length("file") % 2 == 0, F.array(F.struct("file", "matches"))).alias("results"),
        F.when(F.length("file") % 2 == 1, F.col("file")).alias("file"),
        F.when(F.length("file") % 2 == 1, F.col("matches")).alias("matches"),
    )
    return findings_io.unpack_results(nested).select(*FINDING)


def sarif_results(spark, sf):
    return findings_io.sarif_results(planted_findings(spark, sf))


def sarif_rules(spark, sf):
    return findings_io.sarif_rules(planted_findings(spark, sf))


def json_parts(spark, sf):
    rows = findings_io.json_parts(planted_findings(spark, sf), 2)
    return rows.select("file", "part", F.to_json("matches").alias("matches"))


DOCUMENT = (
    "runs array<struct<tool: struct<driver: struct<rules: array<struct<id: string, name: string, shortDescription: struct<text: string>>>>>, "
    "results: array<struct<ruleId: string, ruleIndex: int, level: string, message: struct<text: string>, "
    "locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int, startColumn: int>>>>>>>>"
)


def sarif_documents(spark, sf):
    """Every result of the documents, read back, with the rule that its index names."""
    documents = findings_io.sarif_documents(planted_findings(spark, sf), 40)
    run = documents.select("part", F.explode(F.from_json("document", DOCUMENT)["runs"]).alias("run"))
    rows = run.select("part", F.col("run.tool.driver.rules").alias("rules"), F.posexplode("run.results").alias("at", "r"))
    named = F.get("rules", F.col("r.ruleIndex"))
    where = F.col("r.locations")[0]["physicalLocation"]
    return rows.select(
        "part", "at", F.col("r.ruleId").alias("rule_id"), F.col("r.ruleIndex").alias("rule_index"), F.col("r.level").alias("level"),
        F.col("r.message.text").alias("message"), named["id"].alias("named"), named["name"].alias("name"),
        named["shortDescription"]["text"].alias("short_description"), F.size("rules").alias("rules"),
        where["artifactLocation"]["uri"].alias("uri"), where["region"]["startLine"].alias("start_line"),
        where["region"]["startColumn"].alias("start_column"),
    )


def vulnerability_files(spark, sf):
    v = findings_io.vulnerabilities_at(inputs.vulnerabilities(spark, sf), "error")
    return findings_io.vulnerable_files(v)


# -- redaction ---------------------------------------------------------------


def redact_token(spark, sf):
    return inputs.load(spark, sf, "part", "p_partkey", "p_name").select(
        "p_partkey", redaction.redact_token(F.col("p_name")).alias("redacted")
    )


def redact_env(spark, sf):
    lines = split_lines(inputs.planted(spark, sf))
    return lines.select("file", "line", redaction.redact_env(F.col("text")).alias("redacted"))


def redact_text(spark, sf):
    numbered = list(enumerate(BUILTIN_RULES))
    clean = inputs.corpus(spark, sf).select("file", redaction.redact_text("text", numbered).alias("clean"))
    return clean.select("file", F.sha2("clean", 256).alias("redacted_sha"))


def mask_config_fields(spark, sf):
    rows = inputs.load(spark, sf, "customer", "c_custkey", "c_name", "c_mktsegment").select(
        "c_custkey",
        F.create_map(
            F.lit("name"), "c_name", F.lit("api_key"), F.concat(F.lit("k"), F.col("c_custkey").cast("string")),
            F.lit("webhookToken"), "c_name", F.lit("segment"), "c_mktsegment",
        ).alias("m"),
        F.struct(F.col("c_name").alias("owner"), F.struct(F.col("c_name").alias("password"), F.col("c_custkey").alias("token_age")).alias("db")).alias("s"),
    )
    masked_map = redaction.mask_map(F.col("m"))
    masked = redaction.mask_fields(F.col("s"), rows.schema["s"].dataType)
    return rows.select(
        "c_custkey", masked_map["name"].alias("name"), masked_map["api_key"].alias("api_key"),
        masked_map["webhookToken"].alias("webhook_token"), masked_map["segment"].alias("segment"),
        masked["owner"].alias("owner"), masked["db"]["password"].alias("db_password"), masked["db"]["token_age"].alias("token_age"),
    )


def rule_validation(spark, sf):
    candidates = inputs.load(spark, sf, "part", "p_partkey", "p_name", "p_size").selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS name",
        "CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN concat('(', p_name) WHEN 1 THEN '' ELSE concat(p_name, '[0-9]+') END AS regex",
        "CASE CAST(p_size % 5 AS INT) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'critical' ELSE 'urgent' END AS severity",
    )
    return rule_source.check_rules(candidates).select("p_partkey", "name", "regex", "severity", "rejected")


def policy_overlay(spark, sf):
    """Each customer's settings over those of its nation."""
    owners = inputs.load(spark, sf, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    base = owners.selectExpr(
        "c_custkey AS owner",
        "explode(array(struct('mode' AS key, concat('mode-', c_nationkey) AS scalar, CAST(NULL AS array<string>) AS items), "
        "struct('exclude' AS key, CAST(NULL AS string) AS scalar, array('vendor', concat('n', c_nationkey)) AS items), "
        "struct('needs_approval' AS key, CASE WHEN c_nationkey % 2 = 0 THEN 'true' ELSE 'false' END AS scalar, CAST(NULL AS array<string>) AS items))) AS s",
    ).select("owner", "s.*")
    project = owners.selectExpr(
        "c_custkey AS owner",
        "explode(array(struct('mode' AS key, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS scalar, CAST(NULL AS array<string>) AS items), "
        "struct(CASE WHEN c_custkey % 2 = 0 THEN 'exclude' ELSE 'ignore' END AS key, CAST(NULL AS string) AS scalar, array(c_mktsegment) AS items), "
        "struct('needs_approval' AS key, CASE WHEN c_custkey % 5 = 0 THEN 'true' ELSE 'false' END AS scalar, CAST(NULL AS array<string>) AS items))) AS s",
    ).select("owner", "s.*")
    merged = commands.overlay_policy(base, project, ("owner", "key"), ("needs_approval",))
    return merged.select("owner", "key", "scalar", F.array_join("items", ",").alias("items"))


# -- issues ------------------------------------------------------------------


def issue_drafts(spark, sf):
    d = issues.drafts_from_findings(planted_findings(spark, sf))
    return d.select("title", "body", F.array_join("labels", ",").alias("labels"), "fingerprint")


def vulnerability_drafts(spark, sf):
    d = issues.drafts_from_vulnerabilities(inputs.vulnerabilities(spark, sf))
    return d.select("title", "body", F.array_join("labels", ",").alias("labels"), "fingerprint")


def issue_dedup(spark, sf):
    found = stored_findings(spark, sf)
    opened = issues.drafts_from_findings(found.where(F.col("line") == 2)).select("body")
    return issues.drop_open(issues.drafts_from_findings(found), opened).select("title", "fingerprint")


def text_to_issue(spark, sf):
    d = inputs.documents(spark, sf).select("file", issue_fns.text_issue(F.col("text")).alias("i"))
    return d.select("file", "i.title", F.sha2("i.body", 256).alias("body_sha"), F.array_join("i.labels", ",").alias("labels"))


# -- commands and gates ------------------------------------------------------


def command_risk(spark, sf):
    return commands.assess(inputs.commands(spark, sf)).select("command_id", "sanitised", "risk")


def command_policy(spark, sf):
    return commands.evaluate(inputs.commands(spark, sf), POLICY).drop("command")


def command_default_policy(spark, sf):
    return commands.evaluate(inputs.commands(spark, sf)).select("command_id", "risk", "allowed", "requires_approval", "matched")


def _staged(spark, sf):
    return report.deny_reasons(stored_diff_findings(spark, sf), "repo").select("repo", "reason")


def tool_event_decisions(spark, sf):
    return commands.gate(inputs.tool_events(spark, sf), POLICY, BUILTIN_RULES, ("docs",), SUPPRESSIONS[:1], _staged(spark, sf))


def tool_requests(spark, sf):
    r = commands.requests(inputs.tool_events(spark, sf))
    return r.select("event_id", "tool", "input.command", "input.file_path", "input.content", "input.new_string")


def tool_replies(spark, sf):
    e = inputs.tool_events(spark, sf)
    d = commands.gate(e, POLICY, BUILTIN_RULES, ("docs",), SUPPRESSIONS[:1])
    fmt = F.expr(inputs.TOOL_FORMAT)
    formats = inputs.load(spark, sf, "events", "event_id", "user_id").select("event_id", fmt.alias("format"))
    return d.join(formats, "event_id").select(
        "event_id", commands.pretool_reply(F.col("format"), F.col("decision"), F.col("reason")).alias("reply")
    )


def tool_output_redaction(spark, sf):
    return commands.redact_outputs(inputs.tool_results(spark, sf))


def deny_reasons(spark, sf):
    return report.deny_reasons(stored_diff_findings(spark, sf), "repo")


# -- audit -------------------------------------------------------------------


def audit_verify(spark, sf):
    return audit.verify_chain(inputs.audit_logs(spark, sf))


def audit_verify_resumed(spark, sf):
    """The first half of every log verified and marked, then the rest from the marks."""
    lines = inputs.audit_logs(spark, sf)
    half = lines.groupBy("log_id").agg(F.floor(F.max("line_no") / 2).alias("half"))
    earlier = lines.join(half, "log_id").where(F.col("line_no") <= F.col("half")).drop("half")
    return audit.verify_chain(earlier).unionByName(audit.verify_since(lines, audit.log_marks(earlier)))


def audit_tip_hash(spark, sf):
    return audit.tip_hash(inputs.audit_logs(spark, sf))


def _entries(spark, sf):
    return parse_entries(inputs.audit_logs(spark, sf))


def audit_entries(spark, sf):
    e = _entries(spark, sf)
    return e.select(
        "log_id", "line_no", "entry.timestamp", "entry.sessionId", "entry.eventType", "entry.agentType", "entry.cwd",
        "entry.prevHash", F.col("entry.action.command").alias("command"), F.col("entry.action.riskLevel").alias("risk"),
        F.col("entry.securityCheck.reason").alias("reason"), F.col("entry.resolution.actionTaken").alias("action_taken"),
    )


def audit_query_last_n(spark, sf):
    last = audit.query_log(
        _entries(spark, sf), event_type="command_intercepted", agent_type="beta",
        since="2024-01-03 00:00:00", cwd="u4", limit=25, order=("log_id", "line_no"),
    )
    return last.select("log_id", "line_no", "entry.timestamp", F.col("entry.action.command").alias("command"))


def audit_alerts(spark, sf):
    return audit.alerts(_entries(spark, sf))


def audit_prune_reseal(spark, sf):
    return audit.prune_and_reseal(inputs.audit_logs(spark, sf), F.lit(RETENTION_CUTOFF).cast("timestamp"))


def audit_retention_manifest(spark, sf):
    return audit.retention_manifest(inputs.audit_logs(spark, sf), F.lit(RETENTION_CUTOFF).cast("timestamp"), RETENTION_DAYS)


def audit_resealed_breaks(spark, sf):
    """A resealed log verifies: no rows."""
    return audit.verify_chain(audit_prune_reseal(spark, sf))


def audit_share(spark, sf):
    return _entries(spark, sf).select("log_id", "line_no", audit.share_line(F.col("entry")).alias("share"))


def audit_command_events(spark, sf):
    judged = commands.evaluate(inputs.commands(spark, sf), POLICY)
    event = audit.command_event(
        "command", F.col("risk"), F.col("allowed"),
        F.when(F.col("allowed"), "allowed").otherwise("blocked"), F.col("reason"), F.lit(None).cast("string"),
    )
    return judged.select("command_id", event.alias("e")).select(
        "command_id", "e.eventType", F.col("e.action.command").alias("command"), F.col("e.action.riskLevel").alias("risk"),
        "e.securityCheck.passed", "e.securityCheck.reason", F.col("e.resolution.actionTaken").alias("action_taken"),
    )


def policy_hash(spark, sf):
    owners = inputs.load(spark, sf, "customer", "c_custkey", "c_name", "c_mktsegment")
    patterns = F.array(F.col("c_name"), F.col("c_mktsegment"), F.lit("rm -rf"))
    return owners.select("c_custkey", audit.policy_hash(patterns).alias("policy_hash"))


# -- review ------------------------------------------------------------------


def url_extract(spark, sf):
    return review.bundle_urls(inputs.pages(spark, sf).select("bundle", F.concat_ws(" ", "url", "text").alias("text")))


def unsafe_urls(spark, sf):
    kind = inputs.case("page_id", [
        "url", "concat('http://10.0.', CAST(page_id % 256 AS STRING), '.7/x')", "concat('https://172.', CAST(page_id % 64 AS STRING), '.1.1:8443')",
        "concat('ftp://', bundle, '/a')", "concat('http://192.', CAST(page_id % 200 AS STRING), '.2.1/')", "'http:///nohost'",
        "concat('http://[fe80::', CAST(page_id AS STRING), ']/')", "concat('https://[2606:4700::', CAST(page_id % 9 AS STRING), ']:443/')",
        "concat('http://user@127.0.0.', CAST(page_id % 250 AS STRING), '/')", "concat('http://8.8.', CAST(page_id % 256 AS STRING), '.8')",
    ])
    rows = inputs.pages(spark, sf).selectExpr("page_id", f"{kind} AS target")
    return rows.select("page_id", "target", urls.is_unsafe_url(F.col("target")).alias("unsafe"))


def review_signals(spark, sf):
    return _signals(spark, sf).select(
        "bundle", "file", "kind", "name", "severity", F.col("line").cast("string").alias("line"), "sample"
    )


def bundle_summary(spark, sf):
    return _summaries(spark, sf).select("bundle", "severity", "findings", F.array_join("reasons", ", ").alias("reasons"))


def bundle_rollup(spark, sf):
    r = review.rollup(_summaries(spark, sf))
    return r.withColumn("reasons", F.array_join("reasons", ", "))


def platform_rollup(spark, sf):
    platforms = inputs.pages(spark, sf).select("bundle", "platform").distinct()
    return review.platform_rollup(_summaries(spark, sf).join(platforms, "bundle"))


def external_escalation(spark, sf):
    e = review.escalate(_summaries(spark, sf), _deep(spark, sf))
    return e.withColumn("reasons", F.array_join("reasons", ", "))


def inventory_counts(spark, sf):
    return review.inventory_counts(review.with_inventory(inputs.page_files(spark, sf)))


def suspicious_files(spark, sf):
    return review.suspicious_files(review.with_inventory(inputs.page_files(spark, sf)))


def front_matter(spark, sf):
    inv = review.with_inventory(inputs.page_files(spark, sf)).where("kind = 'text'")
    fm = review.bundle_front_matter(inv)
    return fm.select("bundle", "file", "name", "version", "description", F.array_join("allowed_tools", ",").alias("allowed_tools"))


def bundle_dirs(spark, sf):
    return review.bundle_dirs(inputs.page_files(spark, sf))


def quick_counts(spark, sf):
    return review.quick_counts(inputs.page_texts(spark, sf))


# -- diffs -------------------------------------------------------------------


def diff_added_lines(spark, sf):
    return diffs.added_lines(inputs.patches(spark, sf))


def diff_findings(spark, sf):
    return _diff_findings(spark, sf).select("patch_id", "repo", *FINDING)


# -- streams -----------------------------------------------------------------


def _table_stream(spark, sf, table):
    schema = spark.read.parquet(f"{sf.rstrip('/')}/{table}.parquet").schema
    return streams.watch_table(spark, sf, table, schema)


def stream_scan(spark, sf):
    out, checkpoint = streams.fresh_paths(spark, "scan")
    files = _table_stream(spark, sf, "documents").selectExpr(f"{inputs.DOC_FILE} AS file", "text")
    doc_supp = [supp.Suppression("src1/**", None, "trusted", supp.POLICY_SOURCE)]
    streams.scan_stream(files, out, checkpoint, [SERVICE_RULE], doc_supp)
    return spark.read.parquet(f"{out}/findings").select(*FINDING)


def stream_redact(spark, sf):
    out, checkpoint = streams.fresh_paths(spark, "redact")
    source = _table_stream(spark, sf, "events").selectExpr(
        "event_id", f"{inputs.TOOL_FORMAT} AS format", f"{inputs.RESPONSE} AS payload"
    ).transform(computed_once, "payload")
    streams.transform_stream(source, commands.redact_outputs, out, checkpoint)
    return spark.read.parquet(out).drop("batch")


def stream_gate(spark, sf):
    out, checkpoint = streams.fresh_paths(spark, "gate")
    source = _table_stream(spark, sf, "events").selectExpr(
        "event_id", "concat('repo_', CAST(user_id % 60 AS STRING)) AS repo", f"{inputs.TOOL_FORMAT} AS format",
        f"{inputs.PAYLOAD} AS payload",
    ).transform(computed_once, "payload")
    gate = lambda batch: commands.gate(batch, POLICY, BUILTIN_RULES, ("docs",), SUPPRESSIONS[:1])
    streams.transform_stream(source, gate, out, checkpoint)
    return spark.read.parquet(out).drop("batch")


def stream_chain_append(spark, sf):
    out, checkpoint = streams.fresh_paths(spark, "chain")
    source = _table_stream(spark, sf, "events").selectExpr(
        "concat('user_', CAST(user_id AS STRING)) AS log_id", "event_id AS ord",
        f"concat({inputs.EVENT_HEAD}, 'null', {inputs.EVENT_TAIL}) AS event",
    )
    streams.append_chain(source, out, checkpoint)
    return spark.read.parquet(out).select("log_id", F.col("seq").alias("line_no"), "raw")


def stream_chain_breaks(spark, sf):
    """A log written by the stream verifies: no rows."""
    return audit.verify_chain(stream_chain_append(spark, sf))


def stream_alerts(spark, sf):
    out, checkpoint = streams.fresh_paths(spark, "alerts")
    source = _table_stream(spark, sf, "events").selectExpr(
        "event_id AS line_no", f"concat({inputs.EVENT_HEAD}, 'null', {inputs.EVENT_TAIL}) AS raw"
    )
    streams.transform_stream(source, lambda batch: audit.alerts(parse_entries(batch)), out, checkpoint)
    return spark.read.parquet(out).drop("batch")


QUERIES: tuple[Callable, ...] = (
    custom_rule_findings, many_rule_findings, indexed_rule_findings, arrow_rule_findings, builtin_rule_findings, unplaced_findings, scan_table_function, has_secrets, line_table,
    excluded_paths_scan, corpus_path_rules, ignored_files, ignore_rules, engine_union, external_report, baseline_filter,
    baseline_show, suppression_split, suppression_table, scan_verdict, policy_ignore_rules, suppression_lines, suppression_upsert,
    findings_per_file, severity_histogram, overall_risk, top_rules, findings_by_severity, threshold_gate,
    level_counts, notify_summary, rules_per_file, json_results, json_parts, json_reread, sarif_results, sarif_rules, sarif_documents,
    vulnerability_files, redact_token, redact_env, redact_text, mask_config_fields, rule_validation,
    policy_overlay, issue_drafts, vulnerability_drafts, issue_dedup, text_to_issue, command_risk, command_policy,
    command_default_policy, tool_event_decisions, tool_requests, tool_replies, tool_output_redaction, deny_reasons,
    audit_verify, audit_verify_resumed, audit_tip_hash, audit_entries, audit_query_last_n, audit_alerts, audit_prune_reseal,
    audit_retention_manifest, audit_resealed_breaks, audit_share, audit_command_events, policy_hash, url_extract,
    unsafe_urls, review_signals, bundle_summary, bundle_rollup, platform_rollup, external_escalation,
    inventory_counts, suspicious_files, front_matter, bundle_dirs, quick_counts, diff_added_lines, diff_findings,
    stream_scan, stream_redact, stream_gate, stream_chain_append, stream_chain_breaks, stream_alerts,
)


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(fn: Callable) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(prepare(spark), sf_dir)

    return {fn.__name__: bound(fn) for fn in QUERIES}
