"""Audit logs: raw lines with exact line numbers, and parsed entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY_SCHEMA = (
    "timestamp string, sessionId string, eventType string, agentType string, cwd string, "
    "gitRepo string, prevHash string, "
    "action struct<command: string, tool: string, riskLevel: string>, "
    "securityCheck struct<passed: boolean, reason: string, details: string>, "
    "resolution struct<actionTaken: string, overrideReason: string>"
)


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, line_no, raw) of text logs; log_id is the file, line_no from 1.

    A log may be read in many splits. Row ids grow within a split, so the line
    number is the rank inside the split plus the row counts of the splits before
    it; only that small per-split table goes through a window.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("log_id"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row_id"),
        F.col("value").alias("raw"),
    )
    order = Window.partitionBy("log_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        rows.groupBy("log_id", "split")
        .agg(F.min("row_id").alias("first_id"), F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    )
    return rows.join(splits, ["log_id", "split"]).select(
        "log_id", (F.col("before") + F.col("row_id") - F.col("first_id") + 1).alias("line_no"), "raw"
    )


def is_blank(raw: Column) -> Column:
    return ~raw.rlike(r"(?U)[^\s\x1c-\x1f]")


def parse_entries(lines: DataFrame, require_timestamp: bool = False) -> DataFrame:
    """Lines with an ``entry`` struct; blank and malformed lines are skipped."""
    valid = lines.where(~is_blank(F.col("raw")) & F.try_parse_json(F.col("raw")).isNotNull())
    parsed = valid.withColumn("entry", F.from_json("raw", ENTRY_SCHEMA))
    return parsed.where(F.col("entry.timestamp").isNotNull()) if require_timestamp else parsed
