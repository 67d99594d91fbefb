"""Scanning with thousands of rules: one automaton names the candidates of a text in one pass.

An unrolled rule list grows the plan and searches each needle on its own. Here
an automaton over the needles of all rules, built once per task, reads a text
once and yields its lines with a needle and the rules to try there, so the cost
of a text hardly depends on the number of rules. Candidates then meet the rule
table, and the JVM's regex functions find matches and columns as in
:mod:`.scan`. The rows are the same. Rules that cannot run in the JVM, and rules without a
certain literal, take the ordinary way.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import is_variable_name, located
from ..functions.needles import Needles, needles_of
from ..functions.redaction import redact_token
from ..functions.rules import GENERIC_RULES, Rule, java_regex, partition_rules
from .scan import FINDING_COLUMNS, _only, scan_files

BROADCAST_LIMIT = 16 << 20  # characters of rules up to which the rule table is copied to every executor


def candidate_lines(text: Column, rules: Sequence[tuple[int, tuple[str, ...], bool]]) -> Column:
    """Array of (line, text, rules) for the lines of a text that hold a needle, from (number, needles, folded) rules."""

    @F.pandas_udf("array<struct<line:int,text:string,rules:array<int>>>")
    def lines(texts: pd.Series) -> pd.Series:
        needles = _built(rules)
        return texts.map(lambda t: needles.lines(t) if t is not None else [])

    return lines(text)


_last: list = []


def _built(rules) -> Needles:
    """The automaton of a rule list, kept for the batches of a task."""
    if not _last or _last[0] is not rules:
        _last[:] = [rules, Needles(rules)]
    return _last[1]


def rule_table(files: DataFrame, rules: Sequence[tuple[int, Rule]]) -> DataFrame:
    """(rule_ord, pattern, rule, severity, description, generic), broadcast while its size allows."""
    rows = [(i, java_regex(r.regex), r.name, r.severity, r.description or "", r.name in GENERIC_RULES) for i, r in rules]
    df = files.sparkSession.createDataFrame(
        rows, "rule_ord int, pattern string, rule string, severity string, description string, generic boolean"
    )
    size = sum(len(x) for row in rows for x in row if isinstance(x, str))
    return F.broadcast(df) if size <= BROADCAST_LIMIT else df


def scan_files_indexed(files: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ("file",)) -> DataFrame:
    """The findings of ``scan_files``, for rule lists of any length."""
    native, _ = partition_rules(rules)
    needled = [(i, *needles_of(r)) for i, r in native]
    needled = [(i, needles, fold) for i, needles, fold in needled if needles]
    indexed = {i for i, _, _ in needled}
    parts = []
    if indexed:
        held = files.select(*keep, F.explode(candidate_lines(F.col("text"), needled)).alias("held"))
        pairs = held.select(*keep, "held.line", "held.text", F.explode("held.rules").alias("rule_ord"))
        tried = pairs.join(rule_table(files, [(i, r) for i, r in native if i in indexed]), "rule_ord")
        hits = tried.where(F.regexp_like("text", F.col("pattern"))).select(
            *keep, "line", "rule_ord", "rule", "severity", "description", "generic",
            F.inline(located(F.col("text"), F.col("pattern"))),
        )
        hits = hits.where(~(F.col("generic") & is_variable_name(F.col("match"))))
        parts.append(hits.withColumn("redacted", redact_token(F.col("match"))).select(*keep, *FINDING_COLUMNS[1:]))
    others = [(i, r) for i, r in enumerate(rules) if i not in indexed]
    if others or not parts:
        rest = scan_files(files, _only(rules, others), keep)
        parts.append(rest.select(*keep, *FINDING_COLUMNS[1:]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
