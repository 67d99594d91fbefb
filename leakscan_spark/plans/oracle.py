"""SQL checks of the registered queries, stated independently of the Spark plans."""

from __future__ import annotations

from ..functions import issues, review, risk
from ..functions.rules import BUILTIN_RULES
from ..sources.corpus import BINARY_EXTENSIONS, EXCLUDED_NAMES
from . import inputs
from .policy import APPROVAL, BLOCKED, RETENTION_CUTOFF, RETENTION_DAYS


def q(text: str) -> str:
    """A SQL string literal of the checking engine (no escapes but doubled quotes)."""
    return "'" + text.replace("'", "''") + "'"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# -- findings ----------------------------------------------------------------

QUOTED = "regexp_extract(m, '[''\"]([^''\"]+)[''\"]', 1)"
# The two rules with look-around, restated without it: the separator in front is
# matched and left out of the group, the look-ahead becomes a filter.
_RESTATED = {
    "Generic API Key": (
        r"(?i)(?:^|[^a-zA-Z0-9_])(api[_-]?key\s*[:=]\s*['\"][0-9a-zA-Z\-_]{16,256}['\"])", "[0-9]",
    ),
    "Generic Secret": (
        r"(?i)(?:^|[^a-zA-Z0-9_])((?:secret|password|passwd|pwd)\s*[:=]\s*['\"][0-9a-zA-Z\-_!@#$%^&*()]{8,256}['\"])",
        "[0-9!@#$%^&*()]",
    ),
}


def _rule_matches(text: str, rule) -> str:
    if rule.name not in _RESTATED:
        return f"regexp_extract_all({text}, {q(rule.regex)})"
    pattern, needed = _RESTATED[rule.name]
    return (
        f"list_filter(regexp_extract_all({text}, {q(pattern)}, 1), lambda m: regexp_matches({QUOTED}, {q(needed)}) "
        f"AND NOT regexp_matches({QUOTED}, '^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$') "
        f"AND NOT regexp_matches({QUOTED}, '^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$'))"
    )


def lines(name: str, source: str, keys: str = "file", text: str = "text") -> str:
    return (
        f"{name} AS (SELECT {keys}, unnest(string_split({text}, chr(10))) AS txt, "
        f"generate_subscripts(string_split({text}, chr(10)), 1) AS line FROM {source})"
    )


RULES = "rules(ord, rule, severity, description) AS (VALUES " + ", ".join(
    f"({i}, {q(r.name)}, {q(r.severity)}, {q(r.description)})" for i, r in enumerate(BUILTIN_RULES)
) + ")"


def redacted(m: str) -> str:
    return (
        f"CASE WHEN length({m}) <= 8 THEN repeat('*', length({m})) "
        f"ELSE concat(left({m}, 4), repeat('*', length({m}) - 8), right({m}, 4)) END"
    )


def hits(name: str, source: str, keys: str) -> str:
    """All rules over a table of (keys, txt); each token occurs once per line."""
    each = " UNION ALL ".join(
        f"SELECT {keys}, txt, {i} AS ord, unnest({_rule_matches('txt', r)}) AS m FROM {source}"
        for i, r in enumerate(BUILTIN_RULES)
    )
    return (
        f"{name} AS (SELECT {keys}, txt, h.ord, m AS match, strpos(txt, m) AS \"column\", r.rule, r.severity, "
        f"r.description, {redacted('m')} AS redacted FROM ({each}) h JOIN rules r ON r.ord = h.ord)"
    )


FOUND = [inputs.PLANTED_SQL, RULES, lines("pl", "planted"), hits("found", "pl", "file, line")]
FINDING = 'file, line, "column", rule, severity, redacted'
REPO = "string_split(file, '/')[1]"


def found(select: str) -> str:
    return _with(*FOUND) + select


SERVICE = r'token\s*=\s*"[0-9a-f]{40}"'
SERVICE_SQL = _with(
    inputs.DOCS_SQL, lines("dl", "docs"),
    f"cut AS (SELECT file, line, regexp_extract_all(txt, {q(SERVICE)}) AS ms, string_split_regex(txt, {q(SERVICE)}) AS gaps FROM dl WHERE regexp_matches(txt, {q(SERVICE)}))",
    "one AS (SELECT file, line, ms, gaps, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM cut)",
) + f"""SELECT file, line, 1 + list_sum(list_transform(gaps[1:i], lambda x: length(x)))
  + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS "column",
  '{{name}}' AS rule, 'high' AS severity, {redacted('m')} AS redacted FROM one"""

CORPUS = "corpus AS (SELECT file, text FROM docs UNION ALL SELECT file, text FROM planted)"
HIST = (
    "count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, "
    "count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low"
)

# -- suppression and exclusion, by plain string tests ------------------------

PATH = "substr(file, strpos(file, '/') + 1)"
BASE = "regexp_extract(file, '[^/]*$')"
SUPPRESSED_BY = f"""CASE
  WHEN regexp_matches(file, '(^|/)tests/fixtures/') THEN 'policy:test data'
  WHEN {BASE} LIKE '%.env' AND rule = 'GitHub Personal Access Token' THEN 'policy:rotated'
  WHEN regexp_matches(file, '(^|/)src/[^/]*\\.js$') THEN 'policy:bundled'
  WHEN {BASE} LIKE '%.env' THEN 'ignore-file:'
  WHEN rule = 'AWS Access Key ID' AND regexp_matches(file, '^repo_[^/]/docs/') THEN 'ignore-file:' END"""
EXCLUDED = (
    "(list_contains(string_split(file, '/'), 'docs') OR file LIKE '%.md' OR starts_with(file, 'repo_1/config/') "
    "OR regexp_matches(file, '^[^/]*/tests/'))"
)

EXT_SEVERITY = """CASE WHEN regexp_matches(rid, 'private-key|password|database|access-token|secret-key') OR rid LIKE '%-pat' OR tags = 'key,secret' THEN 'critical'
  WHEN regexp_matches(rid, 'api-key|-token') OR rid LIKE 'token-%' OR tags = 'api' THEN 'high'
  WHEN rid LIKE '%generic%' THEN 'medium' ELSE 'high' END"""
EXTERNAL = f"""ext AS (SELECT file, line, col AS "column", rid AS rule, {EXT_SEVERITY} AS severity, redacted, description, match FROM (
  SELECT file, line, "column" + line % 2 AS col, lower(replace(rule, ' ', '-')) AS rid, concat('ext ', rule) AS description, redacted, match,
    CASE ord WHEN 0 THEN 'key,secret' WHEN 1 THEN 'api' ELSE '' END AS tags FROM found WHERE ord < 6))"""

# -- commands ----------------------------------------------------------------


def _hit(view: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({view}, {q('(?i)' + p)})" for p in patterns) + ")"


VIEW = "trim(view)"
RISK = (
    f"CASE WHEN {_hit(VIEW, risk.CRITICAL_PATTERNS)} THEN 'critical' WHEN {_hit(VIEW, risk.HIGH_PATTERNS)} THEN 'high' "
    f"WHEN {_hit(VIEW, risk.MEDIUM_PATTERNS)} THEN 'medium' ELSE 'low' END"
)


def _first(view: str, patterns) -> str:
    whens = " ".join(
        f"WHEN contains(lower({view}), {q(p)}) THEN {q(p)}" if p == "make (" else f"WHEN {_hit(view, [p])} THEN {q(p)}"
        for p in patterns
    )
    return f"CASE {whens} END"


def judged(blocked, approval) -> str:
    return f"""judged AS (SELECT *, {RISK} AS risk, {_first(VIEW, risk.CRITICAL_PATTERNS)} AS crit,
    {_first('view', blocked)} AS blk, {_first('view', approval)} AS apr FROM commands),
  decided AS (SELECT *,
    CASE WHEN risk = 'critical' OR blk IS NOT NULL THEN 'deny' WHEN apr IS NOT NULL OR risk = 'high' THEN 'ask' ELSE 'allow' END AS verdict,
    CASE WHEN risk = 'critical' THEN {q(risk.CRITICAL_REASON)} WHEN blk IS NOT NULL THEN concat('Matches blocked pattern: ', blk)
      WHEN apr IS NOT NULL THEN concat('Matches approval pattern: ', apr) WHEN risk = 'high' THEN {q(risk.HIGH_RISK_REASON)} END AS reason,
    CASE WHEN risk = 'critical' THEN crit ELSE coalesce(blk, apr) END AS matched FROM judged)"""


COMMANDS = inputs.COMMANDS_SQL

# -- tool events -------------------------------------------------------------

TOOLS = f"""tools AS (SELECT e.event_id, concat('repo_', CAST(user_id % 60 AS VARCHAR)) AS repo, {inputs.TOOL_FORMAT} AS format, (e.event_id + user_id) % 4 AS kind,
    {inputs.COMMAND} AS command, {inputs.COMMAND_VIEW} AS view, {inputs._CONTENT} AS content, {inputs._WRITE_PATH} AS path FROM events e)"""
TOOL_NAME = (
    "CASE kind WHEN 0 THEN 'Bash' WHEN 1 THEN CASE WHEN format IN ('cursor', 'windsurf') THEN 'Write' ELSE 'Edit' END "
    "WHEN 2 THEN CASE WHEN format = 'windsurf' THEN 'unknown' ELSE 'Read' END END"
)
DECISIONS = f"""tjudged AS (SELECT *, {RISK} AS risk, {_first('view', BLOCKED)} AS blk, {_first('view', APPROVAL)} AS apr,
    concat_ws(', ', CASE WHEN regexp_matches(content, 'AKIA[0-9A-Z]{{16}}') THEN 'AWS Access Key ID' END,
      CASE WHEN regexp_matches(content, 'ghp_[a-zA-Z0-9]{{36}}') THEN 'GitHub Personal Access Token' END,
      CASE WHEN regexp_matches(content, 'npm_[A-Za-z0-9]{{36}}') THEN 'npm Access Token' END) AS names,
    CASE WHEN format IN ('cursor', 'windsurf') THEN path ELSE 'file content' END AS target FROM tools),
  decided AS (SELECT t.*, {TOOL_NAME} AS tool,
    CASE WHEN kind = 0 THEN
        CASE WHEN risk = 'critical' THEN {q(risk.CRITICAL_REASON)} WHEN blk IS NOT NULL THEN concat('Matches blocked pattern: ', blk)
          WHEN apr IS NOT NULL THEN concat('Matches approval pattern: ', apr) WHEN risk = 'high' THEN {q(risk.HIGH_RISK_REASON)}
          WHEN command LIKE 'git commit%' OR command LIKE 'git push%' THEN {{staged}} END
      WHEN kind = 1 AND names <> '' AND NOT starts_with(target, 'docs/') AND NOT starts_with(target, 'tests/fixtures/')
        THEN concat('Secret detected in ', target, ': ', names) END AS reason
    FROM tjudged t {{join}})"""

# -- diffs, by windows over numbered lines -----------------------------------

DIFF = [
    inputs.PATCHES_SQL,
    "raw_lines AS (SELECT patch_id, repo, unnest(string_split(patch, chr(10))) AS r0, generate_subscripts(string_split(patch, chr(10)), 1) AS i FROM patches)",
    "dl AS (SELECT patch_id, repo, i, CASE WHEN r0 LIKE concat('%', chr(13)) THEN left(r0, length(r0) - 1) ELSE r0 END AS r FROM raw_lines)",
    "reg AS (SELECT *, sum(CASE WHEN r LIKE 'diff --git %' OR r LIKE 'Binary files % differ' THEN 1 ELSE 0 END) OVER (PARTITION BY patch_id ORDER BY i) AS region FROM dl)",
    "hun AS (SELECT *, sum(CASE WHEN regexp_matches(r, '^@@ -[0-9,]+ [+][0-9,]+ @@') THEN 1 ELSE 0 END) OVER (PARTITION BY patch_id, region ORDER BY i) AS hunk FROM reg)",
    "num AS (SELECT *, max(CASE WHEN hunk = 0 AND r LIKE '+++ %' THEN substr(r, 5) END) OVER (PARTITION BY patch_id, region) AS target, "
    "max(CASE WHEN r LIKE '@@ %' THEN CAST(regexp_extract(r, '[+]([0-9]+)', 1) AS INT) END) OVER (PARTITION BY patch_id, region, hunk) AS start, "
    "sum(CASE WHEN r LIKE '+%' OR r LIKE ' %' THEN 1 ELSE 0 END) OVER (PARTITION BY patch_id, region, hunk ORDER BY i) AS n FROM hun)",
    "added AS (SELECT patch_id, repo, regexp_replace(target, '^[ab]/', '') AS file, start + n - 1 AS line, substr(r, 2) AS txt FROM num "
    "WHERE hunk > 0 AND r LIKE '+%' AND start > 0 AND target IS NOT NULL AND target <> '/dev/null')",
]
DIFF_FOUND = [*DIFF, RULES, hits("dfound", "added", "patch_id, repo, file, line")]
DENY = """tot AS (SELECT repo, count(*) AS total, count(DISTINCT file) AS files FROM dfound GROUP BY repo),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file, line, "column", ord) AS n FROM dfound),
  shown AS (SELECT repo, string_agg(concat('  ', file, ':', line, ' — ', rule), chr(10) ORDER BY n) AS s FROM ranked WHERE n <= 10 GROUP BY repo),
  deny AS (SELECT tot.repo, total, files, concat(total, ' secret(s) detected in ', files, ' staged file(s):', chr(10), s,
    CASE WHEN total > 10 THEN concat(chr(10), '  …and ', total - 10, ' more') ELSE '' END) AS reason FROM tot JOIN shown ON tot.repo = shown.repo)"""

# -- audit -------------------------------------------------------------------

ENTRY = (
    "entries AS (SELECT log_id, line_no, raw, raw::JSON AS j FROM log_rows WHERE trim(raw) <> '' AND json_valid(raw)), "
    "e AS (SELECT log_id, line_no, j->>'$.timestamp' AS ts, j->>'$.sessionId' AS sid, j->>'$.eventType' AS ev, j->>'$.agentType' AS ag, "
    "j->>'$.cwd' AS cwd, j->>'$.prevHash' AS ph, j->>'$.action.command' AS cmd, j->>'$.action.riskLevel' AS risk, "
    "j->>'$.securityCheck.reason' AS reason, j->>'$.resolution.actionTaken' AS act FROM entries)"
)
CHAIN = """seq AS (SELECT log_id, line_no, raw, lag(raw) OVER (PARTITION BY log_id ORDER BY line_no) AS prev FROM log_rows WHERE trim(raw) <> ''),
  chk AS (SELECT log_id, line_no, json_valid(raw) AS ok, CASE WHEN json_valid(raw) THEN raw::JSON->>'$.prevHash' END AS actual,
    CASE WHEN prev IS NOT NULL THEN sha256(concat(prev, chr(10))) END AS expected FROM seq)"""
CUTOFF = f"TIMESTAMP '{RETENTION_CUTOFF}'"
STAMP = "CASE WHEN json_valid(raw) THEN CAST(replace(substr(raw::JSON->>'$.timestamp', 1, 19), 'T', ' ') AS TIMESTAMP) END"

QUOTED_HASH = "'\"', sha256(concat(b.raw, chr(10))), '\"'"

# -- review ------------------------------------------------------------------

HIDDEN = {
    "zero-width-char": "[\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}]",
    "bidi-override": "[\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]",
}
BLOBS = {"base64-blob": review.BASE64_BLOB, "hex-escape-rope": review.HEX_ROPE}
IMPERATIVE = r"(?i)<!--[\s\S]{0,400}?\b(?:ignore|disregard|pretend|you are|system:|assistant:)\b[\s\S]{0,400}?-->"


def _command_regex(name: str, pattern: str) -> str:
    # No look-ahead: what follows the slash is matched instead. White space of any alphabet.
    pattern = r"(?i)rm\s+-rf\s+/(?:\W|$)" if name == "rm -rf /" else pattern
    return pattern.replace(r"\s", r"[\s\x{0B}\x{85}\p{Z}]")


def _line_of(match: str) -> str:
    before = f"substr(text, 1, strpos(text, {match}) - 1)"
    return f"CAST(length({before}) - length(replace({before}, chr(10), '')) + 1 AS VARCHAR)"


def _signal_rows() -> str:
    rows = []
    for name, pattern in review.COMMAND_SIGNALS:
        m = f"unnest(regexp_extract_all(text, {q(_command_regex(name, pattern))}))"
        rows.append(f"SELECT bundle, file, text, 'command' AS kind, {q(name)} AS name, NULL AS severity, {m} AS m, 'none' AS shape FROM pg")
    for kind, cls in HIDDEN.items():
        rows.append(f"SELECT bundle, file, text, '{kind}', NULL, NULL, regexp_extract(text, {q(cls)}), 'code' FROM pg WHERE regexp_matches(text, {q(cls)})")
    for kind, pattern in BLOBS.items():
        rows.append(f"SELECT bundle, file, text, '{kind}', NULL, NULL, unnest(regexp_extract_all(text, {q(pattern)})), 'size' FROM pg")
    rows.append(f"SELECT bundle, file, text, 'html-comment-imperative', NULL, NULL, unnest(regexp_extract_all(text, {q(IMPERATIVE)})), 'text' FROM pg")
    for i, r in enumerate(BUILTIN_RULES):
        rows.append(f"SELECT bundle, file, text, 'secret', {q(r.name)}, {q(r.severity)}, unnest({_rule_matches('text', r)}), 'secret' FROM pg")
    return " UNION ALL ".join(rows)


SIGNALS = [
    inputs.PAGES_SQL,
    f"sig AS ({_signal_rows()})",
    f"""signals AS (SELECT bundle, file, kind, name, severity, CASE WHEN kind <> 'secret' THEN {_line_of('m')} END AS line,
      CASE shape WHEN 'code' THEN format('U+{{:04X}}', unicode(m)) WHEN 'size' THEN concat(length(m), ' chars')
        WHEN 'text' THEN left(regexp_replace(m, '\\s+', ' ', 'g'), 80) WHEN 'secret' THEN {redacted('m')} END AS sample FROM sig)""",
]
RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
TIER = "['clean', 'low', 'medium', 'high', 'critical']"
EXTENSION = "lower(regexp_extract(path, '[^/]([.][^./]+)$', 1))"
SUSPECT = f"{EXTENSION} IN ({', '.join(q(e) for e in review.SUSPICIOUS_EXTENSIONS)})"
INVENTORY = (
    f"inv AS (SELECT bundle, path, octet_length(encode(text)) AS bytes, "
    f"CASE WHEN {SUSPECT} OR contains(text, chr(0)) THEN 'binary' ELSE 'text' END AS kind, "
    f"({SUSPECT} OR (contains(text, chr(0)) AND {EXTENSION} NOT IN ({', '.join(q(e) for e in review.TEXT_EXTENSIONS)}))) AS suspicious, text FROM pf)"
)
SUMMARY = [
    *SIGNALS, inputs.PAGE_FILES_SQL, INVENTORY,
    "cnt AS (SELECT bundle, kind, severity FROM signals UNION ALL SELECT bundle, 'suspicious-file', NULL FROM inv WHERE suspicious)",
    f"""agg AS (SELECT p.bundle, count(*) FILTER (kind = 'secret') AS sec, coalesce(max(CASE WHEN kind = 'secret' THEN {RANK} END), 0) AS sr,
      count(*) FILTER (kind = 'command') AS com, count(*) FILTER (kind IN ('bidi-override', 'html-comment-imperative')) AS hard,
      count(*) FILTER (kind IN ('zero-width-char', 'base64-blob', 'hex-escape-rope')) AS soft, count(*) FILTER (kind = 'suspicious-file') AS sus
      FROM (SELECT DISTINCT bundle FROM pg) p LEFT JOIN cnt ON cnt.bundle = p.bundle GROUP BY p.bundle)""",
    f"""summary AS (SELECT bundle, {TIER}[1 + CASE WHEN hard > 0 THEN 4 ELSE greatest(sr, CASE WHEN com > 0 THEN 3 ELSE 0 END, CASE WHEN soft + sus > 0 THEN 2 ELSE 0 END) END] AS severity,
      sec + com + hard + soft + sus AS findings,
      concat_ws(', ', CASE WHEN sec > 0 THEN concat(sec, ' secret finding(s)') END, CASE WHEN com > 0 THEN concat(com, ' high-risk command(s)') END,
        CASE WHEN hard > 0 THEN concat(hard, ' hard obfuscation signal(s)') END, CASE WHEN soft > 0 THEN concat(soft, ' obfuscation signal(s)') END,
        CASE WHEN sus > 0 THEN concat(sus, ' suspicious file(s)') END) AS reasons FROM agg)""",
]
TIER_COUNTS = ", ".join(f"count(*) FILTER (severity = '{t}') AS {t}" for t in ("clean", "low", "medium", "high", "critical"))

DEEP = inputs.case("page_id", ["'INFO'", "'LOW'", "'MEDIUM'", "'HIGH'", "'weird'", "'LOW'"])
TARGET_URL = inputs.case("page_id", [
    "url", "concat('http://10.0.', CAST(page_id % 256 AS STRING), '.7/x')", "concat('https://172.', CAST(page_id % 64 AS STRING), '.1.1:8443')",
    "concat('ftp://', bundle, '/a')", "concat('http://192.', CAST(page_id % 200 AS STRING), '.2.1/')", "'http:///nohost'",
    "concat('http://[fe80::', CAST(page_id AS STRING), ']/')", "concat('https://[2606:4700::', CAST(page_id % 9 AS STRING), ']:443/')",
    "concat('http://user@127.0.0.', CAST(page_id % 250 AS STRING), '/')", "concat('http://8.8.', CAST(page_id % 256 AS STRING), '.8')",
])
UNSAFE = inputs.case("page_id", [
    "false", "true", "page_id % 64 BETWEEN 16 AND 31", "true", "page_id % 200 = 168", "true", "true", "false", "true", "false",
])

# -- issues ------------------------------------------------------------------

# A scanned unit: files of one folder whose names end alike.
VERDICT_UNIT = "concat(regexp_extract(file, '^(.*)/', 1), ' ', right(regexp_extract(file, '([^/.]*)[.]', 1), 2), ' ', regexp_extract(file, '[.]([a-z]+)$', 1))"
PRINT = "left(sha256(concat(file, ':', rule)), 12)"
ICON = {"critical": "\U0001f534", "high": "\U0001f7e0", "medium": "\U0001f7e1", "low": "\U0001f7e2"}


def _icon(sev: str) -> str:
    return f"CASE {sev} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ICON.items()) + " END"


N = "chr(10)"
FOOT = f"concat({N}, '---', {N}, '*Created by leakscan-spark*', {N})"
MARK = f"concat({N}, {N}, {q(issues.MARK_START)}, fp, {q(issues.MARK_END)})"
DRAFT = f"""SELECT concat({_icon('severity')}, ' [', upper(severity), '] Secret detected: ', rule, ' in ', {BASE}) AS title,
  concat('`', file, '` (line ', line, ') holds what looks like a live credential: **', rule, '** (', severity, ').', {N},
    {N}, 'Seen as `', redacted, '`.', {N}, {N}, 'Kind: ', description, {N},
    {N}, 'To do: have the owner revoke it, move the new one to a vault, and purge the old one from history.', {N}, {FOOT}, {MARK}) AS body,
  concat('security,secret-detected,severity:', severity) AS labels, fp AS fingerprint FROM (SELECT *, {PRINT} AS fp FROM found)"""
VULN_DRAFT = f"""SELECT concat({_icon('sev')}, ' [', upper(sev), '] ', rule_id, ': ', CASE WHEN length(message) <= 80 THEN message ELSE concat(left(message, 77), '...') END) AS title,
  concat('A scan reported `', rule_id, '` (', sev, ') in `', file, '`', CASE WHEN line IS NOT NULL THEN concat(' (line ', line, ')') ELSE '' END,
    '.', {N}, {N}, '> ', message, {N}, {N}, 'Please check that place and close this once it is settled.', {N}, {FOOT}, {MARK}) AS body,
  concat('security,severity:', sev, ',rule:', rule_id) AS labels, fp AS fingerprint
  FROM (SELECT *, CASE level WHEN 'error' THEN 'critical' WHEN 'warning' THEN 'high' ELSE 'medium' END AS sev, left(sha256(concat(file, ':', rule_id)), 12) AS fp FROM vulns)"""
KEYWORDS = "|".join(issues.SECURITY_WORDS)
TEXT_ISSUE = f"""SELECT file, CASE WHEN length(head) <= 120 THEN head ELSE concat(left(head, 117), '...') END AS title,
  sha256(concat(CASE WHEN rest = '' THEN whole ELSE rest END,
    CASE WHEN len(refs) > 0 THEN concat({N}, {N}, 'Files named above:', {N}, {N}, array_to_string(list_transform(refs[1:10], lambda r: concat('- `', r, '`', {N})), '')) ELSE '' END,
    {N}, {FOOT})) AS body_sha, concat_ws(',', sec, sev) AS labels
 FROM (SELECT file, whole, regexp_replace(trim(string_split(whole, {N})[1]), '^#+\\s*', '') AS head,
   regexp_replace(substr(whole, length(string_split(whole, {N})[1]) + 2), '^\\s+|\\s+$', '', 'g') AS rest,
   regexp_extract_all(text, '(?:^|\\s)([a-zA-Z0-9_./-]+[.][a-zA-Z]{{1,10}})(?::(?:\\d+))?', 1) AS refs,
   CASE WHEN regexp_matches(lower(text), '{KEYWORDS}') THEN 'security' END AS sec,
   CASE WHEN regexp_matches(lower(text), 'critical|p0') THEN 'severity:critical' WHEN regexp_matches(lower(text), 'high severity|high risk|p1') THEN 'severity:high'
     WHEN regexp_matches(lower(text), 'medium|p2') THEN 'severity:medium' WHEN regexp_matches(lower(text), 'low|p3') THEN 'severity:low' END AS sev
   FROM (SELECT file, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS whole FROM docs))"""

# -- environment values ------------------------------------------------------

ENV = r"(?i)(^|\s)((?:[a-z_][a-z0-9_]*_)?(?:KEY|TOKEN|SECRETS?|PASSWORD|PASSWD|PWD|API_?KEY|ACCESS_?KEY|CREDENTIALS?|AUTH)=)(\S+)"


def statements() -> dict[str, str]:
    scan_name = SERVICE_SQL
    staged = DECISIONS.replace("{staged}", "s.reason").replace("{join}", "LEFT JOIN deny s ON s.repo = t.repo")
    alone = DECISIONS.replace("{staged}", "NULL").replace("{join}", "")
    s: dict[str, str] = {}
    s["custom_rule_findings"] = scan_name.replace("{name}", "Service Token")
    s["arrow_rule_findings"] = scan_name.replace("{name}", "Named Token")
    s["many_rule_findings"] = (
        scan_name.replace("'{name}' AS rule", "concat('Token ', substr(m, 10, 3)) AS rule")
        + """ WHERE regexp_matches(m, '^token = "[01]')"""
    )
    # The prefixes of the indexed rules as two patterns; their tokens do not overlap and occur once a line.
    s["indexed_rule_findings"] = _with(
        inputs.DOCS_SQL, inputs.PLANTED_SQL, CORPUS, lines("cl", "corpus"),
        "toks AS (SELECT file, line, txt, unnest(regexp_extract_all(txt, '(?:ghp|npm)_[0-9a-f]{3}[0-9A-Za-z]{33}')) AS m FROM cl)",
    ) + f"""SELECT file, line, strpos(txt, m) AS "column", concat(left(m, 3), ' key ', substr(m, 5, 3)) AS rule, 'high' AS severity, {redacted('m')} AS redacted FROM toks"""
    s["stream_scan"] = f"SELECT * FROM ({s['custom_rule_findings']}) WHERE NOT starts_with(file, 'src1/')"
    both = [inputs.DOCS_SQL, inputs.PLANTED_SQL, CORPUS, RULES, lines("pl", "corpus"), hits("found", "pl", "file, line")]
    s["builtin_rule_findings"] = _with(*both) + f"SELECT {FINDING} FROM found"
    s["unplaced_findings"] = _with(*both) + "SELECT file, rule, severity, redacted FROM found"
    s["scan_table_function"] = s["unplaced_findings"]
    s["has_secrets"] = _with(*both) + "SELECT c.file, c.file IN (SELECT file FROM found) AS has_secrets FROM corpus c"
    s["line_table"] = _with(inputs.DOCS_SQL, lines("dl", "docs")) + (
        "SELECT file, count(*) AS lines, sum(length(txt)) AS characters, max(line) AS last_line, count(*) FILTER (txt = '') AS empty_lines FROM dl GROUP BY file"
    )
    s["excluded_paths_scan"] = found(f"SELECT {FINDING} FROM found WHERE NOT {EXCLUDED}")
    names = [*EXCLUDED_NAMES, "deploy"]
    s["corpus_path_rules"] = _with(inputs.PLANTED_SQL) + (
        f"SELECT file, len(string_split(file, '/')) <= 4 AND NOT list_has_any(string_split(file, '/'), [{', '.join(q(n) for n in names)}]) "
        f"AND lower(regexp_extract(file, '[.][^./]+$')) NOT IN ({', '.join(q(e) for e in BINARY_EXTENSIONS)}) AS scannable FROM planted"
    )
    s["ignored_files"] = _with(inputs.PLANTED_SQL) + "SELECT file, repo FROM planted WHERE file NOT LIKE '%.env'"
    # Worked out by hand, folder by folder.
    s["ignore_rules"] = f"""WITH f AS (SELECT {inputs.PLANTED_REPO} AS repo, {inputs.PLANTED_PATH} AS file, {inputs.PLANTED_DIR} AS dir,
        {inputs.PLANTED_EXT} AS ext, o_custkey % 40 % 2 = 0 AS even, o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS name FROM orders)
      SELECT repo, file FROM f WHERE NOT CASE dir
        WHEN 'node_modules/pkg' THEN true
        WHEN 'deploy' THEN NOT (ext = 'txt' AND k % 10 = 5)
        WHEN 'config' THEN even OR (ext = 'js' AND k % 2 = 1)
        WHEN 'docs' THEN ext IN ('md', 'env') OR (ext = 'js' AND k % 2 = 1)
        WHEN 'src' THEN ext = 'env' OR (ext = 'js' AND k % 2 = 1 AND k % 10 <> 3)
        WHEN 'src/vendor/lib' THEN ext IN ('py', 'env') OR (ext = 'js' AND k % 2 = 1 AND k % 10 <> 3)
        ELSE ext = 'env' OR (ext = 'js' AND k % 2 = 1) OR (ext = 'txt' AND substr(name, 3, 1) <> '7') END"""
    s["external_report"] = _with(*FOUND, EXTERNAL) + f"SELECT {FINDING}, description FROM ext"
    s["engine_union"] = _with(
        *FOUND, EXTERNAL,
        "tagged AS (SELECT file, line, \"column\", match, rule, severity, redacted, 0 AS eng, -1 AS ord FROM ext "
        "UNION ALL SELECT file, line, \"column\", match, rule, severity, redacted, 1, ord FROM found)",
        'picked AS (SELECT *, row_number() OVER (PARTITION BY file, line, "column", match ORDER BY eng, ord) AS n, '
        'min(eng) OVER (PARTITION BY file, line, "column", match) AS lo, max(eng) OVER (PARTITION BY file, line, "column", match) AS hi FROM tagged)',
    ) + f"SELECT {FINDING}, CASE WHEN lo = hi THEN CASE lo WHEN 0 THEN 'external' ELSE 'patterns' END ELSE 'external,patterns' END AS engines FROM picked WHERE n = 1"
    s["baseline_filter"] = found(f"SELECT {FINDING} FROM found WHERE line <> 2 AND rule <> 'Bearer Token'")
    s["baseline_show"] = found(
        "SELECT file, count(*) AS entries FROM (SELECT file FROM found WHERE line = 2 UNION ALL SELECT file FROM found WHERE rule = 'Bearer Token') GROUP BY file"
    )
    s["suppression_split"] = found(
        f"SELECT {FINDING}, s IS NOT NULL AS suppressed, nullif(split_part(s, ':', 2), '') AS reason, split_part(s, ':', 1) AS source FROM (SELECT *, {SUPPRESSED_BY} AS s FROM found)"
    )
    s["suppression_table"] = found(
        f"""SELECT {FINDING}, CASE WHEN by_src THEN concat('part ', k // 7) WHEN by_env THEN concat('part ', k) END AS reason,
          CASE WHEN by_src OR by_env THEN 'policy' WHEN by_docs THEN 'ignore-file' END AS source
        FROM (SELECT *, regexp_matches(file, 'src/order_[0-9]+[.][a-z]+$') AND k % 7 = 0 AND k // 7 <= n AND ((k // 7) % 2 = 0 OR rule = 'GitHub App Token') AS by_src,
            regexp_matches(file, '[.]env$') AND k <= n AND (k % 2 = 0 OR rule = 'GitHub App Token') AS by_env,
            regexp_matches(file, 'docs/order_[0-9]+[.][a-z]+$') AND k % 3 = 0 AND k // 3 <= n AS by_docs
          FROM (SELECT *, CAST(regexp_extract(file, 'order_([0-9]+)', 1) AS BIGINT) AS k FROM found), (SELECT max(p_partkey) AS n FROM part))"""
    )
    s["scan_verdict"] = found(
        f"""SELECT p.unit, coalesce(f.verdict, 0) AS verdict FROM (SELECT DISTINCT {VERDICT_UNIT} AS unit FROM planted) p LEFT JOIN
        (SELECT {VERDICT_UNIT} AS unit, max(CASE WHEN ({SUPPRESSED_BY}) IS NULL THEN 1 ELSE 0 END) AS verdict FROM found GROUP BY 1) f ON p.unit = f.unit"""
    )
    s["policy_ignore_rules"] = """SELECT owner, path_glob, unnest(CASE WHEN owner % 3 = 0 THEN [NULL] ELSE ['Bearer Token', seg] END) AS rule, reason, 'policy' AS source
      FROM (SELECT c_custkey AS owner, c_mktsegment AS seg, concat('owner ', c_custkey) AS reason,
        unnest([concat('src/', lower(c_mktsegment), '/**'), '*.log']) AS path_glob FROM customer)"""
    s["suppression_lines"] = """SELECT p_partkey AS ord, CASE p_partkey % 4 WHEN 1 THEN concat(p_brand, '/**') WHEN 2 THEN concat('*.', p_brand) ELSE concat(p_brand, '/', p_name) END AS path_glob,
      CASE WHEN p_partkey % 4 = 1 THEN concat(p_name, ' : x') END AS rule, 'ignore-file' AS source FROM part WHERE p_partkey % 4 <> 0"""
    s["suppression_upsert"] = """WITH cur AS (SELECT c_nationkey AS owner, c_custkey AS ord, concat(c_mktsegment, ',docs/**') AS paths, c_mktsegment AS seg, concat('since ', c_custkey) AS reason FROM customer),
      upd AS (SELECT c_nationkey AS owner, c_mktsegment AS seg, max(c_custkey) AS k, min(c_custkey) AS k0 FROM customer WHERE c_custkey % 4 = 0 GROUP BY 1, 2),
      firsts AS (SELECT owner, seg, min(ord) AS f FROM cur GROUP BY 1, 2)
      SELECT cur.owner, cur.ord, cur.paths, CASE WHEN cur.ord = f AND k IS NOT NULL THEN CASE WHEN k % 8 = 0 THEN NULL ELSE concat('now ', k) END ELSE cur.reason END AS reason,
        CASE WHEN cur.ord = f AND k IS NOT NULL THEN 'updated' ELSE 'kept' END AS action
      FROM cur JOIN firsts ON cur.owner = firsts.owner AND cur.seg = firsts.seg LEFT JOIN upd ON cur.owner = upd.owner AND cur.seg = upd.seg
      UNION ALL SELECT c_nationkey, c_custkey, concat('new/**,', c_custkey), concat('now ', c_custkey), 'appended' FROM customer WHERE c_custkey % 4 = 2"""
    s["findings_per_file"] = found("SELECT file, count(*) AS findings FROM found GROUP BY file")
    s["severity_histogram"] = found(f"SELECT {HIST} FROM found")
    s["overall_risk"] = found(
        f"SELECT *, CASE WHEN critical > 0 THEN 'Critical' WHEN high > 0 THEN 'High' WHEN medium > 0 THEN 'Medium' WHEN total > 0 THEN 'Low' ELSE 'None' END AS risk FROM (SELECT {REPO} AS repo, {HIST} FROM found GROUP BY 1)"
    )
    s["top_rules"] = found(
        "SELECT rule, findings, CAST(round_even(100.0 * findings / (SELECT count(*) FROM found), 0) AS INT) AS pct FROM (SELECT rule, count(*) AS findings FROM found GROUP BY rule) ORDER BY findings DESC, rule LIMIT 10"
    )
    s["findings_by_severity"] = found(f"SELECT {FINDING} FROM found")
    s["threshold_gate"] = found(
        f"""SELECT repo, threshold, CASE threshold WHEN 'none' THEN false WHEN 'critical' THEN critical > 0 WHEN 'medium' THEN critical + high + medium > 0
        WHEN 'low' THEN critical + high + medium + low > 0 ELSE critical + high > 0 END AS failed
        FROM (SELECT *, unnest(['none', 'critical', 'high', 'medium', 'low', 'odd']) AS threshold FROM (SELECT {REPO} AS repo, {HIST} FROM found GROUP BY 1))"""
    )
    s["level_counts"] = _with(inputs.VULNS_SQL) + (
        "SELECT file, count(*) AS total, 0 AS critical, count(*) FILTER (level = 'error') AS high, count(*) FILTER (level = 'warning') AS medium, count(*) FILTER (level = 'note') AS low FROM vulns GROUP BY file"
    )
    s["notify_summary"] = _with(
        inputs.VULNS_SQL,
        "v AS (SELECT *, CASE level WHEN 'error' THEN 'critical' WHEN 'warning' THEN 'high' ELSE 'medium' END AS sev FROM vulns)",
        "c AS (SELECT file, count(*) AS total, count(*) FILTER (sev = 'critical') AS critical, count(*) FILTER (sev = 'high') AS high, count(*) FILTER (sev = 'medium') AS medium FROM v GROUP BY file)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY coalesce(line, 0), rule_id, level, message) AS n FROM v)",
        "t AS (SELECT file, string_agg(concat('• `[', upper(sev), ']` ', rule_id, ' — ', file), chr(10) ORDER BY n) AS s FROM r WHERE n <= 5 GROUP BY file)",
        f"p AS (SELECT concat('part/', p_partkey, '.c') AS scan_id, {inputs.case('p_partkey', [q(x) for x in ('completed', 'completed', 'failed', 'queued')])} AS status FROM part)",
        "j AS (SELECT p.scan_id, p.status, coalesce(total, 0) AS total, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, 0 AS low, s FROM p LEFT JOIN c ON c.file = scan_id LEFT JOIN t ON t.file = scan_id)",
    ) + """SELECT scan_id, status, total, critical, high, medium, low,
      CASE WHEN status = 'completed' THEN CASE WHEN total = 0 THEN 'white_check_mark' WHEN critical + high > 0 THEN 'rotating_light' ELSE 'warning' END WHEN status = 'failed' THEN 'x' ELSE 'hourglass_flowing_sand' END AS icon,
      CASE WHEN status = 'completed' AND total = 0 THEN 'Clean — no issues found' WHEN status = 'completed' THEN concat(total, ' issue', CASE WHEN total = 1 THEN '' ELSE 's' END, ' found') WHEN status = 'failed' THEN 'Scan failed' ELSE 'Scan queued' END AS status_text,
      concat_ws(chr(10), CASE WHEN critical > 0 THEN concat(':red_circle: Critical: *', critical, '*') END, CASE WHEN high > 0 THEN concat(':orange_circle: High: *', high, '*') END,
        CASE WHEN medium > 0 THEN concat(':large_yellow_circle: Medium: *', medium, '*') END) AS breakdown,
      concat(coalesce(s, ''), CASE WHEN total > 5 THEN concat(chr(10), '_... and ', total - 5, ' more_') ELSE '' END) AS summary FROM j"""
    s["rules_per_file"] = found("SELECT file, string_agg(DISTINCT rule, ', ' ORDER BY rule) AS rules FROM found GROUP BY file")
    s["json_results"] = found(
        """SELECT file, 0 AS part, concat('[', string_agg(concat('{"pattern":{"name":"', rule, '","severity":"', severity, '","description":"', description, '"},"line":', line, ',"column":', "column",
        ',"redacted":"', replace(redacted, '"', '\\"'), '"}'), ',' ORDER BY line, "column", ord), ']') AS matches FROM found GROUP BY file"""
    )
    s["json_reread"] = found(f"SELECT {FINDING} FROM found")
    s["sarif_results"] = found(
        "SELECT lower(replace(rule, ' ', '-')) AS rule_id, CASE WHEN severity IN ('critical', 'high') THEN 'error' ELSE 'warning' END AS level, concat(rule, ' detected') AS message, file AS uri, line AS start_line, \"column\" AS start_column FROM found"
    )
    s["sarif_rules"] = found("SELECT DISTINCT lower(replace(rule, ' ', '-')) AS rule_id, rule AS name, description AS short_description FROM found")
    match = """concat('{"pattern":{"name":"', rule, '","severity":"', severity, '","description":"', description, '"},"line":', line, ',"column":', "column",
        ',"redacted":"', replace(redacted, '"', '\\"'), '"}')"""
    s["json_parts"] = found(
        f"""SELECT file, CAST((k - 1) // 2 AS INT) AS part, concat('[', string_agg(match, ',' ORDER BY k), ']') AS matches FROM (
        SELECT file, {match} AS match, row_number() OVER (PARTITION BY file ORDER BY line, "column", ord) AS k FROM found) GROUP BY ALL"""
    )
    s["sarif_documents"] = found(
        """SELECT part, CAST(k % 40 AS INT) AS at, rule_id, CAST(dense_rank() OVER (PARTITION BY part ORDER BY first) - 1 AS INT) AS rule_index,
        CASE WHEN severity IN ('critical', 'high') THEN 'error' ELSE 'warning' END AS level, concat(rule, ' detected') AS message, rule_id AS named, rule AS name,
        description AS short_description, CAST(count(DISTINCT rule_id) OVER (PARTITION BY part) AS INT) AS rules, file AS uri, line AS start_line, "column" AS start_column
        FROM (SELECT *, min(k) OVER (PARTITION BY part, rule_id) AS first FROM (SELECT *, CAST(k // 40 AS INT) AS part FROM (
        SELECT *, lower(replace(rule, ' ', '-')) AS rule_id, row_number() OVER (ORDER BY file, line, "column", ord) - 1 AS k FROM found)))"""
    )
    s["vulnerability_files"] = _with(inputs.VULNS_SQL) + "SELECT DISTINCT file FROM vulns WHERE level = 'error'"
    s["redact_token"] = f"SELECT p_partkey, {redacted('p_name')} AS redacted FROM part"
    s["redact_env"] = _with(inputs.PLANTED_SQL, lines("pl", "planted")) + (
        f"SELECT file, line, CASE WHEN v = '' THEN txt ELSE replace(txt, concat(k, v), concat(k, {redacted('v')})) END AS redacted "
        f"FROM (SELECT file, line, txt, regexp_extract(txt, {q(ENV)}, 2) AS k, regexp_extract(txt, {q(ENV)}, 3) AS v FROM pl)"
    )
    s["mask_config_fields"] = """SELECT c_custkey, c_name AS name, CASE WHEN c_custkey < 1000 THEN '****' ELSE concat('k', left(CAST(c_custkey AS VARCHAR), 3), '****') END AS api_key,
      'Cust****' AS webhook_token, c_mktsegment AS segment, c_name AS owner, 'Cust****' AS db_password, c_custkey AS token_age FROM customer"""
    s["rule_validation"] = """SELECT *, CASE WHEN name = '' THEN 'missing name' WHEN regex = '' THEN 'missing regex' WHEN severity = 'urgent' THEN 'invalid severity' WHEN starts_with(regex, '(') THEN 'invalid regex' END AS rejected FROM (
      SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS name, CASE p_partkey % 5 WHEN 0 THEN concat('(', p_name) WHEN 1 THEN '' ELSE concat(p_name, '[0-9]+') END AS regex,
        CASE p_size % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'critical' ELSE 'urgent' END AS severity FROM part)"""
    s["policy_overlay"] = """SELECT c_custkey AS owner, 'mode' AS key, CASE WHEN c_custkey % 3 = 0 THEN concat('mode-', c_nationkey) ELSE c_mktsegment END AS scalar, NULL AS items FROM customer
      UNION ALL SELECT c_custkey, 'exclude', NULL, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE concat('vendor,n', c_nationkey) END FROM customer
      UNION ALL SELECT c_custkey, 'ignore', NULL, c_mktsegment FROM customer WHERE c_custkey % 2 <> 0
      UNION ALL SELECT c_custkey, 'needs_approval', CASE WHEN c_nationkey % 2 = 0 OR c_custkey % 5 = 0 THEN 'true' ELSE 'false' END, NULL FROM customer"""
    s["issue_drafts"] = found(DRAFT)
    s["vulnerability_drafts"] = _with(inputs.VULNS_SQL) + VULN_DRAFT
    s["issue_dedup"] = found(
        f"""SELECT concat({_icon('severity')}, ' [', upper(severity), '] Secret detected: ', rule, ' in ', {BASE}) AS title, fp AS fingerprint
        FROM (SELECT file, rule, severity, {PRINT} AS fp, bool_or(line = 2) OVER (PARTITION BY file, rule) AS opened FROM found) WHERE NOT opened"""
    )
    s["text_to_issue"] = _with(inputs.DOCS_SQL) + TEXT_ISSUE
    s["command_risk"] = _with(COMMANDS) + f"SELECT command_id, view AS sanitised, {RISK} AS risk FROM commands"
    decided = "SELECT command_id, risk, verdict = 'allow' AS allowed, verdict = 'ask' AS requires_approval, {more}matched FROM decided"
    s["command_policy"] = _with(COMMANDS, judged(BLOCKED, APPROVAL)) + decided.format(more="reason, ")
    s["command_default_policy"] = _with(COMMANDS, judged(risk.CRITICAL_PATTERNS, risk.DEFAULT_APPROVAL_PATTERNS)) + decided.format(more="")
    s["tool_event_decisions"] = _with(*DIFF_FOUND, DENY, TOOLS, staged) + (
        "SELECT event_id, tool, CASE WHEN reason IS NULL THEN 'allow' ELSE 'deny' END AS decision, reason FROM decided"
    )
    s["stream_gate"] = _with(TOOLS, alone) + (
        "SELECT event_id, tool, CASE WHEN reason IS NULL THEN 'allow' ELSE 'deny' END AS decision, reason FROM decided"
    )
    s["tool_replies"] = _with(TOOLS, alone, "r AS (SELECT event_id, format, reason IS NOT NULL AS deny, reason, replace(reason, '\\', '\\\\') AS why FROM decided)") + """
      SELECT event_id, CASE format WHEN 'cursor' THEN CASE WHEN deny THEN concat('{"permission":"deny","agentMessage":"', why, '","userMessage":"', why, '"}') ELSE '{"permission":"allow"}' END
        WHEN 'windsurf' THEN reason
        ELSE concat('{"hookSpecificOutput":{"hookEventName":"PreToolUse","permissionDecision":"', CASE WHEN deny THEN 'deny' ELSE 'allow' END, '","permissionDecisionReason":"', coalesce(why, ''), '"}}') END AS reply FROM r"""
    s["tool_requests"] = _with(TOOLS) + f"""SELECT event_id, {TOOL_NAME} AS tool, CASE WHEN kind = 0 THEN command END AS command,
      CASE WHEN kind = 1 AND format IN ('cursor', 'windsurf') THEN path WHEN kind = 2 AND format <> 'windsurf' THEN concat('f', event_id) END AS file_path,
      CASE WHEN kind = 1 AND format IN ('cursor', 'windsurf') THEN content END AS content,
      CASE WHEN kind = 1 AND format NOT IN ('cursor', 'windsurf') THEN content END AS new_string FROM tools"""
    output = f"""SELECT event_id, CASE WHEN format IN ('cursor', 'windsurf') THEN 'Bash' ELSE 'Fetch' END AS tool,
      CASE WHEN event_id % 4 IN (0, 2) THEN 'modify' ELSE 'continue' END AS action,
      CASE event_id % 4 WHEN 0 THEN concat('key = ', {redacted('k')}) WHEN 2 THEN concat({redacted('g')}, ' and ', {redacted('n')}) ELSE content END AS output,
      CASE WHEN format NOT IN ('cursor', 'windsurf') THEN concat('id ', event_id) END AS content,
      CASE event_id % 4 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS matched
      FROM (SELECT *, concat('AKIA', upper(substr(md5(CAST(event_id AS VARCHAR)), 1, 16))) AS k, concat('ghp_', md5(CAST(event_id AS VARCHAR)), 'wxyz') AS g, concat('npm_', md5(CAST(event_id AS VARCHAR)), 'wxyz') AS n FROM tools)"""
    s["tool_output_redaction"] = _with(TOOLS) + output
    s["stream_redact"] = s["tool_output_redaction"]
    s["deny_reasons"] = _with(*DIFF_FOUND, DENY) + "SELECT * FROM deny"
    everything = "list_concat(" + ", ".join(_rule_matches("t1", r) for r in BUILTIN_RULES) + ")"
    s["redact_text"] = _with(
        inputs.DOCS_SQL, inputs.PLANTED_SQL, CORPUS,
        # Every planted token is a string of its own, so replacing the string hides the match.
        f"env AS (SELECT file, list_reduce(list_prepend(text, regexp_extract_all(text, {q(ENV)})), lambda a, m: replace(a, m, "
        f"concat(regexp_extract(m, {q(ENV)}, 1), regexp_extract(m, {q(ENV)}, 2), {redacted(f'regexp_extract(m, {q(ENV)}, 3)')}))) AS t1 FROM corpus)",
    ) + f"SELECT file, sha256(list_reduce(list_prepend(t1, {everything}), lambda a, m: replace(a, m, {redacted('m')}))) AS redacted_sha FROM env"
    logs = inputs.AUDIT_SQL
    s["audit_verify"] = _with(logs, CHAIN) + """SELECT log_id, line_no, CASE WHEN NOT ok THEN 'malformed JSON' WHEN expected IS NULL THEN concat('first entry has prevHash ', actual, ' but expected null')
      ELSE concat('prevHash ', coalesce(concat('''', actual, ''''), 'None'), ' does not match expected ', expected) END AS reason FROM chk WHERE NOT ok OR actual IS DISTINCT FROM expected"""
    s["audit_verify_resumed"] = s["audit_verify"]
    s["audit_tip_hash"] = _with(logs) + "SELECT log_id, sha256(concat(max_by(raw, line_no), chr(10))) AS tip_hash FROM log_rows WHERE trim(raw) <> '' GROUP BY log_id"
    s["audit_entries"] = _with(logs, ENTRY) + (
        'SELECT log_id, line_no, ts AS timestamp, sid AS "sessionId", ev AS "eventType", ag AS "agentType", cwd, ph AS "prevHash", cmd AS command, risk, reason, act AS action_taken FROM e'
    )
    s["audit_query_last_n"] = _with(logs, ENTRY) + (
        "SELECT log_id, line_no, ts AS timestamp, cmd AS command FROM e WHERE ev = 'command_intercepted' AND ag = 'beta' AND ts >= '2024-01-03T00:00:00+00:00' AND contains(cwd, 'u4') ORDER BY log_id DESC, line_no DESC LIMIT 25"
    )
    alerts = (
        "ev AS event, risk, cmd AS command, ts AS timestamp, ag AS agent, concat('[leakscan] ', risk, '-risk event: ', ev, ' — ', cmd) AS text FROM e WHERE risk IN ('high', 'critical')"
    )
    s["audit_alerts"] = _with(logs, ENTRY) + f"SELECT log_id, line_no, {alerts}"
    s["stream_alerts"] = _with(
        f"log_rows AS (SELECT '' AS log_id, event_id AS line_no, concat({inputs.EVENT_HEAD}, 'null', {inputs.EVENT_TAIL}) AS raw FROM events)", ENTRY
    ) + f"SELECT line_no, {alerts}"
    s["audit_retention_manifest"] = _with(logs) + f"""SELECT log_id, pruned, retained, {RETENTION_DAYS} AS retention_days, sha256(concat(tip, chr(10))) AS pre_tip_hash FROM (
      SELECT log_id, count(*) FILTER (NOT keep) AS pruned, count(*) FILTER (keep) AS retained, max_by(raw, line_no) AS tip FROM (
        SELECT *, coalesce({STAMP} >= {CUTOFF}, false) AS keep FROM log_rows WHERE trim(raw) <> '') GROUP BY log_id) WHERE pruned > 0"""
    link = "regexp_replace(n.raw, '\"prevHash\": (null|\"[0-9a-f]*\")', concat('\"prevHash\": ', {hash}))"

    def resealed(rows: str) -> str:
        """Chain the rows (log_id, line_no, raw) of a table front to back."""
        return (
            f"num AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY line_no) AS k FROM {rows}), "
            f"sealed AS (SELECT log_id, line_no, k, {link.format(hash=q('null'))} AS raw FROM num n WHERE k = 1 UNION ALL "
            f"SELECT n.log_id, n.line_no, n.k, {link.format(hash=QUOTED_HASH)} FROM num n JOIN sealed b ON n.log_id = b.log_id AND n.k = b.k + 1)"
        )

    s["audit_prune_reseal"] = _with(
        logs, f"kept AS (SELECT * FROM log_rows WHERE coalesce({STAMP} >= {CUTOFF}, false))", resealed("kept")
    ).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT log_id, line_no, raw FROM sealed"
    s["stream_chain_append"] = _with(
        f"ev AS (SELECT concat('user_', CAST(user_id AS VARCHAR)) AS log_id, event_id AS line_no, concat({inputs.EVENT_HEAD}, 'null', {inputs.EVENT_TAIL}) AS raw FROM events)",
        resealed("ev"),
    ).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT log_id, k AS line_no, raw FROM sealed"
    s["audit_resealed_breaks"] = "SELECT '' AS log_id, 0 AS line_no, '' AS reason WHERE false"
    s["stream_chain_breaks"] = s["audit_resealed_breaks"]
    s["audit_share"] = _with(logs, ENTRY) + """SELECT log_id, line_no, concat('  ', left(ts, 19), '.000Z', '  ', CASE WHEN length(ev) >= 20 THEN ev ELSE rpad(ev, 20, ' ') END, '  ', rpad(upper(risk), 8, ' '), ' ',
      CASE WHEN ev = 'secret_detected' THEN reason ELSE cmd END, ' [', act, ']') AS share FROM e"""
    key = "regexp_extract(command, 'API_KEY=([^ ]+)', 1)"
    s["audit_command_events"] = _with(COMMANDS, judged(BLOCKED, APPROVAL)) + f"""SELECT command_id, 'command_intercepted' AS "eventType",
      CASE WHEN contains(command, 'API_KEY=') THEN replace(command, {key}, {redacted(key)}) ELSE command END AS command,
      risk, verdict = 'allow' AS passed, reason, CASE WHEN verdict = 'allow' THEN 'allowed' ELSE 'blocked' END AS action_taken FROM decided"""
    s["policy_hash"] = """SELECT c_custkey, left(sha256(concat('["', array_to_string(list_sort([c_name, c_mktsegment, 'rm -rf']), '", "'), '"]')), 16) AS policy_hash FROM customer"""
    s["url_extract"] = _with(inputs.PAGES_SQL) + (
        "SELECT DISTINCT bundle, regexp_replace(unnest(regexp_extract_all(concat(url, ' ', text), '(?i)https?://[^\\s<>\"''`)]+')), '[).,;:]+$', '') AS url FROM pg"
    )
    s["unsafe_urls"] = _with(inputs.PAGES_SQL) + f"SELECT page_id, {TARGET_URL} AS target, {UNSAFE} AS unsafe FROM pg"
    s["review_signals"] = _with(*SIGNALS) + "SELECT * FROM signals"
    s["bundle_summary"] = _with(*SUMMARY) + "SELECT * FROM summary"
    s["bundle_rollup"] = _with(*SUMMARY) + f"""SELECT *, high + critical > 0 AS failed, coalesce(nullif(concat_ws(', ', CASE WHEN critical > 0 THEN concat(critical, ' critical bundle(s)') END,
      CASE WHEN high > 0 THEN concat(high, ' high-severity bundle(s)') END, CASE WHEN medium > 0 THEN concat(medium, ' medium-severity bundle(s)') END,
      CASE WHEN low > 0 THEN concat(low, ' low-severity bundle(s)') END), ''), concat(clean, ' clean bundle(s)')) AS reasons FROM (
      SELECT count(*) AS bundles, {TIER_COUNTS}, CAST(sum(findings) AS BIGINT) AS findings, {TIER}[1 + max({RANK})] AS worst FROM summary)"""
    s["platform_rollup"] = _with(*SUMMARY, "pp AS (SELECT DISTINCT bundle, platform FROM pg)") + f"""SELECT platform, count(*) AS bundles, CAST(sum(findings) AS BIGINT) AS findings,
      {TIER}[1 + max({RANK})] AS worst, {TIER_COUNTS}, count(*) FILTER (severity IN ('high', 'critical')) > 0 AS failed FROM summary JOIN pp ON pp.bundle = summary.bundle GROUP BY ROLLUP (platform)"""
    s["external_escalation"] = _with(
        *SUMMARY, f"dp AS (SELECT bundle, CASE {DEEP} WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS r FROM pg)",
        "da AS (SELECT bundle, count(*) AS n, max(r) AS r FROM dp WHERE r >= 2 GROUP BY bundle)",
    ) + f"""SELECT summary.bundle, {TIER}[1 + greatest({RANK}, coalesce(r, 0))] AS severity, findings + coalesce(n, 0) AS findings,
      concat_ws(', ', nullif(reasons, ''), CASE WHEN n > 0 THEN concat('deep engine: ', n, ' actionable finding(s)') END) AS reasons FROM summary LEFT JOIN da ON da.bundle = summary.bundle"""
    s["inventory_counts"] = _with(inputs.PAGE_FILES_SQL, INVENTORY) + (
        "SELECT bundle, count(*) FILTER (kind = 'text') AS text_files, count(*) FILTER (kind = 'binary') AS binary_files, count(*) FILTER (suspicious) AS suspicious_files FROM inv GROUP BY bundle"
    )
    s["suspicious_files"] = _with(inputs.PAGE_FILES_SQL, INVENTORY) + "SELECT bundle, path AS file, bytes FROM inv WHERE suspicious"
    s["front_matter"] = _with(inputs.PAGES_SQL) + (
        "SELECT bundle, concat(page_id, '/', path) AS file, concat('page ', page_id) AS name, '2' AS version, NULL AS description, 'Bash,Read' AS allowed_tools FROM pg WHERE page_id % 5 = 0"
    )
    s["bundle_dirs"] = _with(inputs.PAGES_SQL) + "SELECT DISTINCT concat(page_id, '/skills/', page_id % 50) AS rel_dir FROM pg WHERE page_id % 5 = 0"
    quick = " + ".join(
        f"len(regexp_extract_all(text, {q(_command_regex(n, p))}))" for n, p in review.QUICK_COMMAND_SIGNALS
    )
    secrets = " + ".join(f"len({_rule_matches('text', r)})" for r in BUILTIN_RULES)
    s["quick_counts"] = _with(inputs.PAGES_SQL) + (
        f"SELECT bundle, file, {secrets} AS secrets, len(list_distinct(regexp_extract_all(text, '(?i)https?://[^\\s<>\"]+'))) AS urls, {quick} AS commands FROM pg"
    )
    s["diff_added_lines"] = _with(*DIFF) + "SELECT patch_id, file, line, txt AS text FROM added"
    s["diff_findings"] = _with(*DIFF_FOUND) + f"SELECT patch_id, repo, {FINDING} FROM dfound"
    return s
