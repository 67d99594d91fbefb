"""Triage of findings: engine union, baselines, suppressions, ignored paths."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import glob_regex, matches_glob, slashes
from ..sources.suppressions import Suppression

EXTERNAL, PATTERNS = "external", "patterns"


def union_engines(external: DataFrame | None, patterns: DataFrame) -> DataFrame:
    """Merge two engines' findings; equal (file, line, column, match) is one finding.

    The external engine's row wins, else the lower rule number; ``engines``
    lists every engine that saw it. Grouping treats NULL positions as equal,
    and map-side combining keeps a much-repeated finding from piling up.
    """
    tagged = patterns.withColumn("engine_ord", F.lit(1))
    if external is not None:
        tagged = external.withColumn("engine_ord", F.lit(0)).unionByName(tagged, allowMissingColumns=True)
    first = F.min_by(
        F.struct("rule", "severity", "description", "redacted", "rule_ord"),
        F.struct("engine_ord", F.coalesce("rule_ord", F.lit(-1)).alias("o"), "rule", "severity", "description"),
    )
    merged = tagged.groupBy("file", "line", "column", "match").agg(
        first.alias("w"),
        F.min("engine_ord").alias("lo"),
        F.max("engine_ord").alias("hi"),
    )
    names = F.array(F.lit(EXTERNAL), F.lit(PATTERNS))
    return merged.select(
        "file", "line", "column", "w.rule", "w.severity", "w.description", "match", "w.redacted",
        "w.rule_ord", F.slice(names, F.col("lo") + 1, F.col("hi") - F.col("lo") + 1).alias("engines"),
    )


def apply_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Drop findings the baseline lists; an entry without a line covers the whole file.

    Two plain equi anti-joins: Spark sizes and skew-splits them by itself.
    """
    entries = baseline.select("file", "line", F.col("pattern").alias("rule"))
    placed = entries.where(F.col("line").isNotNull()).distinct()
    anywhere = entries.where(F.col("line").isNull()).select("file", "rule").distinct()
    return findings.join(placed, ["file", "rule", "line"], "left_anti").join(
        anywhere, ["file", "rule"], "left_anti"
    ).select(*findings.columns)


def first_suppression(file: Column, rule: Column, suppressions: Sequence[Suppression]) -> Column:
    """(ord, reason, source) of the first suppression that applies, else NULL."""
    path_test = {}
    tests = []
    for n, s in enumerate(suppressions):
        hit = path_test.setdefault(s.path_glob, matches_glob(file, s.path_glob))
        if s.rule is not None:
            hit = (F.lower(rule) == s.rule.lower()) & hit
        tests.append(
            F.when(
                hit,
                F.struct(
                    F.lit(n).alias("ord"), F.lit(s.reason).cast("string").alias("reason"),
                    F.lit(s.source).alias("source"),
                ),
            )
        )
    none = F.lit(None).cast("struct<ord:int,reason:string,source:string>")
    return F.coalesce(*tests, none)


def mark_suppressed(findings: DataFrame, suppressions: Sequence[Suppression] | DataFrame) -> DataFrame:
    """Findings with ``suppressed_by``: NULL, or the first suppression that applies.

    A list is configuration: it costs one projection and no shuffle. A table is
    joined, whatever its length.
    """
    if isinstance(suppressions, DataFrame):
        return _mark_by_keys(findings, suppressions)
    return findings.withColumn("suppressed_by", first_suppression(F.col("file"), F.col("rule"), suppressions))


def _glob_tokens(glob: str) -> list[str]:
    """Runs of ASCII letters and digits that are whole runs in every path under the glob."""
    g = re.sub(r"\[[^\]]*\]|[*?]", "\0", glob.replace("\\", "/"))
    on_name = "/" not in g
    return [
        m[0] for m in re.finditer("[A-Za-z0-9]+", g)
        if (g[m.start() - 1] != "\0" if m.start() else on_name) and g[m.end() : m.end() + 1] != "\0"
    ]


# So many of the most frequent keys are looked at for dropping; any other is held by few of the paths.
COMMON = 2000


def _meeting(paths: DataFrame, order: DataFrame, often: DataFrame) -> DataFrame:
    """``paths`` by each of their keys, without frequent keys under which nothing waits.

    The list of those is short whatever the tables, so it may be broadcast: words
    that nearly every path holds never travel.
    """
    frequent = often.orderBy(F.desc("n"), "key").limit(COMMON).select("key")
    idle = frequent.join(order.select("key").distinct(), "key", "left_anti")
    keyed = paths.select("file", "path", "rules", F.explode_outer("keys").alias("key"))
    return keyed.join(F.broadcast(idle), "key", "left_anti")


def _mark_by_keys(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """First-match suppression for tables.

    A glob waits under the rarest of its fixed tokens among all paths; without
    one, under its rule. Distinct files come by with their tokens and rules, and
    the pattern is checked on what meets. Only a glob with neither, such as
    ``**``, meets every file, which is what it says.
    """

    @F.pandas_udf("struct<regex:string,on_name:boolean,tokens:array<string>>")
    def compiled(globs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(*glob_regex(g), _glob_tokens(g)) for g in globs], columns=["regex", "on_name", "tokens"])

    path = slashes(F.col("file"))
    # Tokens hold no colon, so the three kinds of keys stay apart.
    by_rule = lambda rule: F.concat(F.lit("rule:"), F.lower(rule))
    tokens = F.regexp_extract_all(path, F.lit("([A-Za-z0-9]+)"))
    keys = F.array_distinct(F.concat(tokens, F.transform("rules", by_rule), F.array(F.lit("any:"))))
    held = findings.groupBy("file").agg(F.collect_set("rule").alias("rules"))
    paths = held.select("file", "rules", path.alias("path"), keys.alias("keys"))
    often = (
        paths.select(F.explode_outer("keys").alias("key")).where(F.col("key").isNotNull())
        .groupBy("key").agg(F.count("*").alias("n"))
    )
    parsed = suppressions.select("ord", F.lower("rule").alias("s_rule"), "reason", "source", compiled("path_glob").alias("g"))
    each = parsed.select("*", F.explode_outer(F.array_distinct("g.tokens")).alias("key")).join(often, "key", "left")
    order = each.groupBy("ord").agg(
        F.min_by(F.struct("key", "s_rule", "reason", "source", "g"), F.struct(F.coalesce("n", F.lit(0)), "key")).alias("s")
    )
    order = order.select(
        "ord", "s.s_rule", "s.reason", "s.source", "s.g.regex", "s.g.on_name",
        F.coalesce("s.key", by_rule(F.col("s.s_rule")), F.lit("any:")).alias("key"),
    )
    target = F.when(F.col("on_name"), F.substring_index("path", "/", -1)).otherwise(F.col("path"))
    meant = F.filter("rules", lambda r: F.col("s_rule").isNull() | (F.lower(r) == F.col("s_rule")))
    hits = (
        _meeting(paths, order, often).join(order, "key")
        .where(F.rlike(target, F.col("regex")))
        .select("file", F.explode(meant).alias("rule"), "ord", "reason", "source")
        .groupBy("file", "rule")
        .agg(F.min_by(F.struct("reason", "source"), "ord").alias("suppressed_by"))
    )
    return findings.join(hits, ["file", "rule"], "left").select(*findings.columns, "suppressed_by")


def split_suppressed(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed) of a marked table."""
    kept = marked.where(F.col("suppressed_by").isNull()).drop("suppressed_by")
    hidden = marked.where(F.col("suppressed_by").isNotNull()).select(
        "file", "line", "column", "rule", "severity", "suppressed_by.reason", "suppressed_by.source"
    )
    return kept, hidden


def upsert_suppressions(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge ignore rules (owner, ord, paths, rules, reason); same scope updates the reason.

    Scope is the set of paths and the set of rules. Only the first entry of a
    scope is updated; new scopes follow the current ones.
    """

    def scope(df: DataFrame) -> DataFrame:
        items = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
        return df.withColumn("scope", F.to_json(F.struct(items(F.col("paths")).alias("p"), items(F.col("rules")).alias("r"))))

    new = (
        scope(incoming).groupBy("owner", "scope")
        .agg(
            F.max_by(F.struct(F.nullif(F.trim("reason"), F.lit("")).alias("reason")), "ord").alias("n"),
            F.min_by(F.struct("paths", "rules"), "ord").alias("f"), F.min("ord").alias("ord"),
        )
    )
    old = scope(current)
    firsts = old.groupBy("owner", "scope").agg(F.min("ord").alias("first_ord"))
    both = firsts.join(new, ["owner", "scope"], "full_outer")
    kept = old.join(both.where(F.col("first_ord").isNotNull()), ["owner", "scope"]).select(
        "owner", F.lit(0).alias("block"), old["ord"], old["paths"], old["rules"],
        F.when((old["ord"] == F.col("first_ord")) & F.col("n").isNotNull(), F.col("n.reason")).otherwise(old["reason"]).alias("reason"),
        F.when((old["ord"] == F.col("first_ord")) & F.col("n").isNotNull(), "updated").otherwise("kept").alias("action"),
    )
    added = both.where(F.col("first_ord").isNull()).select(
        "owner", F.lit(1).alias("block"), "ord", "f.paths", "f.rules", "n.reason", F.lit("appended").alias("action")
    )
    return kept.unionByName(added)
