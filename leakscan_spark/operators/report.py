"""Roll-ups of findings: counts, risk, top rules, gates, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import report_rank

TOP_RULES = 10
SUMMARY_FINDINGS = 5
REASON_FINDINGS = 10

# Notification icons by status.
ICON_CLEAN, ICON_ALERT, ICON_WARNING = "white_check_mark", "rotating_light", "warning"
ICON_FAILED, ICON_PENDING = "x", "hourglass_flowing_sand"


def _tier_count(name: str) -> Column:
    return F.count_if(F.lower("severity") == name).alias(name)


def severity_counts(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts of the four tiers, zeros included; unknown tiers count in total only."""
    return findings.groupBy(*keys).agg(
        F.count("*").alias("total"), *[_tier_count(t) for t in ("critical", "high", "medium", "low")]
    )


def overall_risk(counts: DataFrame) -> DataFrame:
    """Counts with the risk word of the report header."""
    return counts.withColumn(
        "risk",
        F.when(F.col("critical") > 0, "Critical").when(F.col("high") > 0, "High")
        .when(F.col("medium") > 0, "Medium").when(F.col("total") > 0, "Low").otherwise("None"),
    )


def top_rules(findings: DataFrame, k: int = TOP_RULES) -> DataFrame:
    """The k most frequent rules and their share in whole percent, half to even."""
    counts = findings.groupBy("rule").agg(F.count("*").alias("findings"))
    # The total comes from the per-rule counts: one small row per rule.
    total = Window.partitionBy()
    return (
        counts.withColumn("total", F.sum("findings").over(total))
        .orderBy(F.desc("findings"), "rule").limit(k)
        .select("rule", "findings", F.bround(100.0 * F.col("findings") / F.col("total")).cast("int").alias("pct"))
    )


def findings_per_file(findings: DataFrame) -> DataFrame:
    return findings.groupBy("file").agg(F.count("*").alias("findings"))


def by_severity(findings: DataFrame) -> DataFrame:
    """Report order: most severe first, then position."""
    return findings.orderBy(report_rank(F.col("severity")), "file", "line", "column", "rule")


def in_snapshot_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy("file", "line", "column", "rule")


def gate(counts: DataFrame, threshold: Column) -> DataFrame:
    """Whether counts at or above a threshold tier fail the run; unknown means high."""
    t = F.lower(threshold)
    critical = F.col("critical") > 0
    high = critical | (F.col("high") > 0)
    medium = high | (F.col("medium") > 0)
    low = medium | (F.col("low") > 0)
    return counts.withColumn(
        "failed",
        F.when(t == "none", F.lit(False)).when(t == "critical", critical).when(t == "medium", medium)
        .when(t == "low", low).otherwise(high),
    )


def level_counts(vulnerabilities: DataFrame, *keys: str, level: str = "level") -> DataFrame:
    """Counts per tier of error/warning/note style levels (error counts as high)."""
    v = F.col(level)
    return vulnerabilities.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(v == "critical").alias("critical"),
        F.count_if(v.isin("error", "high")).alias("high"),
        F.count_if(v.isin("warning", "medium")).alias("medium"),
        F.count_if(v.isin("note", "low")).alias("low"),
    )


def verdict(marked: DataFrame, units: DataFrame, *keys: str) -> DataFrame:
    """1 when any finding of a scanned unit is left after suppression, else 0.

    ``units`` lists every scanned unit by ``keys``, so those without a finding
    and those whose findings are all suppressed get their 0.
    """
    left = marked.groupBy(*keys).agg(F.max(F.col("suppressed_by").isNull().cast("int")).alias("left"))
    return units.select(*keys).distinct().join(left, [*keys], "left").select(*keys, F.coalesce("left", F.lit(0)).alias("verdict"))


def status_line(status: Column, total: Column, critical: Column, high: Column) -> Column:
    """Struct (icon, text) for a notification."""
    found = F.concat(
        total.cast("string"), F.lit(" issue"), F.when(total == 1, "").otherwise("s"), F.lit(" found")
    )

    def line(icon: str, text) -> Column:
        return F.struct(F.lit(icon).alias("icon"), text.alias("text"))

    return (
        F.when((status == "completed") & (total == 0), line(ICON_CLEAN, F.lit("Clean — no issues found")))
        .when((status == "completed") & ((critical > 0) | (high > 0)), line(ICON_ALERT, found))
        .when(status == "completed", line(ICON_WARNING, found))
        .when(status == "failed", line(ICON_FAILED, F.lit("Scan failed")))
        .otherwise(line(ICON_PENDING, F.concat(F.lit("Scan "), status)))
    )


def first_rows(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group; partial limits run before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)


def notification(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Per scan: status, counts and the first five findings with "... and N more".

    ``scans`` is (scan_id, status); ``findings`` is (scan_id, ord, severity, title, location).
    """
    counts = severity_counts(findings, "scan_id")
    text = F.concat(
        F.lit("• `["), F.upper("severity"), F.lit("]` "), "title",
        F.when(F.coalesce("location", F.lit("")) != "", F.concat(F.lit(" — "), "location")).otherwise(""),
    )
    shown = (
        first_rows(findings, ["scan_id"], ["ord"], SUMMARY_FINDINGS)
        .groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))).alias("s"))
    )
    joined = scans.join(counts, "scan_id", "left").join(shown, "scan_id", "left").fillna(
        0, ["total", "critical", "high", "medium", "low"]
    )
    tiers = F.col("critical") + F.col("high") + F.col("medium") + F.col("low")
    status = status_line(F.col("status"), tiers, F.col("critical"), F.col("high"))
    lines = F.transform("s", lambda x: x["t"])
    more = F.when(
        F.col("total") > SUMMARY_FINDINGS,
        F.array(F.concat(F.lit("_... and "), (F.col("total") - SUMMARY_FINDINGS).cast("string"), F.lit(" more_"))),
    ).otherwise(F.array().cast("array<string>"))
    breakdown = F.array_compact(
        F.array(
            *[
                F.when(F.col(t) > 0, F.concat(F.lit(f":{icon}: {t.title()}: *"), F.col(t).cast("string"), F.lit("*")))
                for t, icon in (
                    ("critical", "red_circle"), ("high", "orange_circle"),
                    ("medium", "large_yellow_circle"), ("low", "white_circle"),
                )
            ]
        )
    )
    return joined.select(
        "scan_id", "status", "total", "critical", "high", "medium", "low",
        status["icon"].alias("icon"), status["text"].alias("status_text"),
        F.array_join(breakdown, "\n").alias("breakdown"),
        F.coalesce(F.array_join(F.concat(lines, more), "\n"), F.lit("")).alias("summary"),
    )


def rules_per_file(findings: DataFrame) -> DataFrame:
    """Distinct rule names of each file, joined by ", "."""
    return findings.groupBy("file").agg(
        F.array_join(F.array_sort(F.collect_set("rule")), ", ").alias("rules")
    )


def deny_reasons(findings: DataFrame, key: str) -> DataFrame:
    """Per key: a header with counts, the first ten findings, and how many more."""
    # Two levels: files first, so that no distinct set grows with the findings.
    per_file = findings.groupBy(key, "file").agg(F.count("*").alias("n"))
    totals = per_file.groupBy(key).agg(F.sum("n").alias("total"), F.count("*").alias("files"))
    text = F.concat(
        F.lit("  "), "file",
        F.when(F.coalesce("line", F.lit(0)) != 0, F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(""),
        F.lit(" — "), "rule",
    )
    shown = (
        first_rows(findings, [key], ["file", "line", "column", "rule_ord"], REASON_FINDINGS)
        .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))).alias("s"))
    )
    header = F.concat(
        F.col("total").cast("string"), F.lit(" secret(s) detected in "), F.col("files").cast("string"),
        F.lit(" staged file(s):"),
    )
    more = F.when(
        F.col("total") > REASON_FINDINGS,
        F.array(F.concat(F.lit("  …and "), (F.col("total") - REASON_FINDINGS).cast("string"), F.lit(" more"))),
    ).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(header), F.transform("s", lambda x: x["t"]), more)
    return totals.join(shown, key).select(key, "total", "files", F.array_join(lines, "\n").alias("reason"))
