"""Scanning: files, lines or whole texts in, one row per finding out.

Plan shape: a needle test on the whole text, then lines, then the same test per
line, then the rules that fire on the line, then their matches. All of it is
narrow: nothing shuffles, and the costly steps only see lines with a hit.

The text should be a stored column. Pass a derived one through
:func:`~leakscan_spark.functions.columns.computed_once` first, as the sources do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import (
    finds_first_copy,
    firing_rules,
    is_false_positive,
    line_may_match,
    located,
    rule_pattern,
    rule_value,
    text_may_match,
)
from ..functions.redaction import redact_token
from ..functions.rules import BUILTIN_RULES, Rule, partition_rules
from .arrow_scan import arrow_located, arrow_unplaced

FINDING_COLUMNS = (
    "file", "line", "column", "rule", "severity", "description", "match", "redacted", "rule_ord",
)


def _fired(texts: DataFrame, rules: Sequence[tuple[int, Rule]], keep: Sequence[str]) -> DataFrame:
    """One row per text and rule that occurs in it."""
    return texts.select(
        *keep, "text", F.explode(firing_rules("text", rules)).alias("rule_ord")
    ).withColumn("pattern", rule_pattern("rule_ord", rules))


def _as_findings(hits: DataFrame, rules: Sequence[Rule], keep: Sequence[str], line: Column) -> DataFrame:
    """(keep..., rule_ord, column, match) rows with the rule's attributes added."""
    numbered = list(enumerate(rules))
    ordinal = "rule_ord"
    return hits.where(~is_false_positive(ordinal, "match", numbered)).select(
        *keep,
        line.cast("int").alias("line"),
        "column",
        rule_value(ordinal, numbered, "name").alias("rule"),
        rule_value(ordinal, numbered, "severity").alias("severity"),
        rule_value(ordinal, numbered, "description").alias("description"),
        "match",
        redact_token(F.col("match")).alias("redacted"),
        "rule_ord",
    )


def split_lines(files: DataFrame, keep: Sequence[str] = ("file",), text: str = "text") -> DataFrame:
    """One row per line, numbered from 1; a trailing empty line is kept."""
    return files.select(
        *keep, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "text")
    ).select(*keep, (F.col("pos") + 1).alias("line"), "text")


def scan_lines(
    lines: DataFrame,
    rules: Sequence[Rule] = BUILTIN_RULES,
    keep: Sequence[str] = ("file",),
) -> DataFrame:
    """Findings of a (keep..., line, text) table whose rows are single lines."""
    native, arrow = partition_rules(rules)
    parts = []
    if native:
        fired = _fired(lines.where(line_may_match("text", native)), native, [*keep, "line"])
        hits = fired.select(
            *keep, "line", "rule_ord", F.inline(located(F.col("text"), F.col("pattern"), finds_first_copy("rule_ord", native)))
        )
        parts.append(_as_findings(hits, rules, keep, F.col("line")))
    if arrow:
        hits = arrow_located(lines.select(*keep, "line", "text"), arrow)
        parts.append(_as_findings(hits, rules, keep, F.col("line")))
    return _union(lines, parts, rules, keep)


def scan_files(
    files: DataFrame,
    rules: Sequence[Rule] = BUILTIN_RULES,
    keep: Sequence[str] = ("file",),
) -> DataFrame:
    """Findings with line and column of a (keep..., text) table of whole texts."""
    native, arrow = partition_rules(rules)
    parts = []
    if native:
        hit_files = files.where(text_may_match("text", native))
        parts.append(scan_lines(split_lines(hit_files, keep), _only(rules, native), keep))
    if arrow:
        parts.append(scan_lines(split_lines(files, keep), _only(rules, arrow), keep))
    return _union(files, parts, rules, keep)


def scan_texts(
    files: DataFrame,
    rules: Sequence[Rule] = BUILTIN_RULES,
    keep: Sequence[str] = ("file",),
) -> DataFrame:
    """Findings over whole texts without positions; matches may span lines."""
    native, arrow = partition_rules(rules)
    none = F.lit(None)
    parts = []
    if native:
        candidates = files
        if all(r.needles for _, r in native):
            candidates = files.where(line_may_match("text", native))
        hits = _fired(candidates, native, keep).select(
            *keep, "rule_ord", none.cast("int").alias("column"),
            F.explode(F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).alias("match"),
        )
        parts.append(_as_findings(hits, rules, keep, none))
    if arrow:
        hits = arrow_unplaced(files.select(*keep, "text"), arrow)
        parts.append(_as_findings(hits, rules, keep, none))
    return _union(files, parts, rules, keep)


def _only(rules: Sequence[Rule], chosen: Sequence[tuple[int, Rule]]) -> list[Rule]:
    """The rule list with all others made unmatchable, so that numbers stay put."""
    kept = {i for i, _ in chosen}
    return [r if i in kept else Rule(r.name, "(", r.severity, r.description) for i, r in enumerate(rules)]


def _union(source: DataFrame, parts: list[DataFrame], rules: Sequence[Rule], keep: Sequence[str]) -> DataFrame:
    if not parts:
        empty = source.where(F.lit(False)).select(
            *keep,
            *[F.lit(None).cast("int").alias(c) for c in ("line", "rule_ord", "column")],
            F.lit(None).cast("string").alias("match"),
        )
        return _as_findings(empty, [Rule("", "x")], keep, F.col("line"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
