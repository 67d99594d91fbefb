"""Suppression lists: ignore files and policy ignore rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POLICY_SOURCE = "policy"
FILE_SOURCE = "ignore-file"


@dataclass(frozen=True)
class Suppression:
    path_glob: str
    rule: str | None = None
    reason: str | None = None
    source: str = FILE_SOURCE


def parse_suppression_lines(lines: DataFrame) -> DataFrame:
    """(ord, value) lines of an ignore file as suppressions: ``glob`` or ``glob:rule``."""
    text = F.trim(F.col("value"), F.lit(" \t\r"))
    parts = F.split(F.col("entry"), ":", 2)
    return (
        lines.select("ord", text.alias("entry"))
        .where((F.col("entry") != "") & ~F.col("entry").startswith("#"))
        .select(
            "ord",
            F.trim(parts[0]).alias("path_glob"),
            F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit("")).alias("rule"),
            F.lit(None).cast("string").alias("reason"),
            F.lit(FILE_SOURCE).alias("source"),
        )
    )


def read_suppressions(spark: SparkSession, path: str) -> DataFrame:
    """Suppressions of one ignore file, numbered in file order."""
    lines = spark.read.text(path, wholetext=True)
    return parse_suppression_lines(
        lines.select(F.posexplode(F.split("value", "\n")).alias("ord", "value"))
    )


def policy_suppressions(ignore_rules: DataFrame) -> DataFrame:
    """Cross product of paths and rules of each (ord, paths, rules, reason) entry."""
    rules = F.when(F.size("rules") > 0, F.col("rules")).otherwise(F.array(F.lit(None).cast("string")))
    return (
        ignore_rules.select("ord", "reason", rules.alias("rules"), F.posexplode("paths").alias("p", "path_glob"))
        .select("ord", "p", "reason", "path_glob", F.posexplode("rules").alias("r", "rule"))
        .select(
            F.struct("ord", "p", "r").alias("ord"), "path_glob", "rule", "reason",
            F.lit(POLICY_SOURCE).alias("source"),
        )
    )


def ordered_suppressions(policy: DataFrame, lines: DataFrame) -> DataFrame:
    """Policy suppressions before those of the ignore file, in one order.

    ``policy`` comes from :func:`policy_suppressions`, ``lines`` from
    :func:`parse_suppression_lines`; ``ord`` becomes (block, entry, path, rule).
    """

    def numbered(df: DataFrame, *order) -> DataFrame:
        names = ("block", "a", "b", "c")
        ord_ = F.struct(*[o.cast("long").alias(n) for n, o in zip(names, order, strict=True)])
        return df.select(ord_.alias("ord"), "path_glob", "rule", "reason", "source")

    none = F.lit(0)
    return numbered(policy, none, F.col("ord.ord"), F.col("ord.p"), F.col("ord.r")).unionByName(
        numbered(lines, F.lit(1), F.col("ord"), none, none)
    )


def collect_suppressions(table: DataFrame) -> list[Suppression]:
    """The list in order, for callers that hold it as configuration."""
    return [Suppression(r["path_glob"], r["rule"], r["reason"], r["source"]) for r in table.orderBy("ord").collect()]
