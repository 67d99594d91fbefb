"""Rule files and rule tables: reading, validation, and the reasons for rejection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import SEVERITIES, Rule, compiles


@F.pandas_udf(T.BooleanType())
def regex_compiles(patterns: pd.Series) -> pd.Series:
    """Whether each pattern is a valid regular expression."""
    return patterns.map(lambda p: p is not None and compiles(p))


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def _whole_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(value, origin) of each matching file; a rule file is read whole so that its order is known."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select("value", F.col("_metadata.file_path").alias("origin"))


def read_rule_lines(spark: SparkSession, path: str) -> DataFrame:
    """One regex per line of ``*.txt`` files; ``#`` starts a comment. ``(origin, ord)`` is the rule order."""
    lines = _whole_files(spark, path, "*.txt").select("origin", F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line"))
    return (
        lines.select("origin", "ord", F.trim(F.col("line"), F.lit(" \t\r")).alias("regex"))
        .where((F.col("regex") != "") & ~F.col("regex").startswith("#"))
        .select(
            F.concat(F.lit("Custom ("), _stem(F.col("origin")), F.lit(")")).alias("name"),
            "regex", F.lit("high").alias("severity"), F.lit("").alias("description"), "origin", "ord",
        )
    )


def read_rule_json(spark: SparkSession, path: str) -> DataFrame:
    """Arrays of ``{name, pattern, severity?, description?}`` in ``*.json`` files, in array order."""
    shape = "array<struct<name:string,pattern:string,severity:string,description:string>>"
    rows = _whole_files(spark, path, "*.json").select(
        "origin", F.posexplode(F.from_json("value", shape)).alias("ord", "r")
    ).select("origin", "ord", "r.*")
    return rows.select(
        F.coalesce("name", F.concat(F.lit("Custom ("), _stem(F.col("origin")), F.lit(")"))).alias("name"),
        F.col("pattern").alias("regex"),
        F.coalesce("severity", F.lit("high")).alias("severity"),
        F.coalesce("description", F.lit("")).alias("description"),
        "origin", "ord",
    )


def check_rules(candidates: DataFrame) -> DataFrame:
    """Candidates with ``rejected``: NULL for a valid rule, else the first reason."""
    return candidates.withColumn(
        "rejected",
        F.when(F.col("name").isNull() | (F.col("name") == ""), "missing name")
        .when(F.col("regex").isNull() | (F.col("regex") == ""), "missing regex")
        .when(F.col("severity").isNull() | ~F.col("severity").isin(*SEVERITIES), "invalid severity")
        .when(~regex_compiles(F.col("regex")), "invalid regex"),
    )


def collect_rules(checked: DataFrame) -> list[Rule]:
    """Valid rules of a checked rule table, in order, as configuration for a scan."""
    order = [c for c in ("origin", "ord") if c in checked.columns]
    valid = checked.where(F.col("rejected").isNull())
    rows = (valid.orderBy(*order) if order else valid).collect()
    return [Rule(r["name"], r["regex"], r["severity"], r["description"] or "") for r in rows]
