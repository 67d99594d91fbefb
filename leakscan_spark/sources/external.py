"""Reports of a second scanning engine, brought to the findings shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.redaction import redact_token
from ..functions.severity import external_severity

REPORT_SCHEMA = (
    "RuleID string, Description string, File string, StartLine int, StartColumn int, "
    "Secret string, Match string, Tags array<string>"
)


def read_external_report(spark: SparkSession, path: str) -> DataFrame:
    """Findings of JSON array reports."""
    return external_findings(spark.read.schema(REPORT_SCHEMA).option("multiLine", True).json(path))


def external_findings(report: DataFrame) -> DataFrame:
    """Report rows as findings: rule from id or description, tier from id and tags."""
    rule = F.coalesce("RuleID", "Description", F.lit("unknown"))
    secret = F.coalesce("Secret", "Match", F.lit(""))
    return report.select(
        F.coalesce("File", F.lit("unknown")).alias("file"),
        F.col("StartLine").cast("int").alias("line"),
        F.col("StartColumn").cast("int").alias("column"),
        rule.alias("rule"),
        external_severity(rule, F.col("Tags")).alias("severity"),
        F.coalesce("Description", F.lit("")).alias("description"),
        secret.alias("match"),
        redact_token(secret).alias("redacted"),
        F.lit(None).cast("int").alias("rule_ord"),
    )
