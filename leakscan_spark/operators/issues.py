"""Issue drafts from findings, and dropping those that are already open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.issues import extract_fingerprint, finding_draft, vulnerability_draft


def drafts_from_findings(findings: DataFrame) -> DataFrame:
    """One draft per finding."""
    draft = finding_draft(*[F.col(c) for c in ("file", "rule", "severity", "description", "line", "redacted")])
    return findings.select(draft.alias("d")).select("d.*")


def drafts_from_vulnerabilities(vulnerabilities: DataFrame) -> DataFrame:
    """One draft per (rule_id, level, message, file, line) row."""
    draft = vulnerability_draft(*[F.col(c) for c in ("rule_id", "level", "message", "file", "line")])
    return vulnerabilities.select(draft.alias("d")).select("d.*")


def drop_open(drafts: DataFrame, open_issues: DataFrame) -> DataFrame:
    """Drafts whose fingerprint no open issue's body carries; drafts are not merged."""
    known = open_issues.select(extract_fingerprint(F.col("body")).alias("fingerprint")).where(
        F.col("fingerprint").isNotNull()
    ).distinct()
    return drafts.join(known, "fingerprint", "left_anti").select(*drafts.columns)
