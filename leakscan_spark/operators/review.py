"""Review of text bundles: signals per file, summaries per bundle, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow_rules import hit_names
from ..functions.columns import computed_once, rank, tier
from ..functions.review import (
    HARD_KINDS,
    QUICK_COMMAND_SIGNALS,
    SIGNAL_PRETEST,
    SOFT_KINDS,
    command_signals,
    front_matter,
    inventory_class,
    list_field,
    obfuscation_signals,
)
from ..functions.matching import match_count
from ..functions.rules import BUILTIN_RULES, Rule, partition_rules
from ..functions.severity import deep_tier
from ..functions.urls import QUICK_URL, extract_urls
from ..sources.corpus import decode
from .scan import scan_texts

KEYS = ("bundle", "file")


def with_inventory(files: DataFrame) -> DataFrame:
    """(bundle, path, bytes, content) with kind, suspicious, and text where it is read."""
    c = inventory_class(F.col("path"), F.col("bytes"), F.col("content"))
    return computed_once(files.withColumn("c", c), "c").select(
        "bundle", F.col("path").alias("file"), "bytes", "c.kind", "c.suspicious",
        F.when(F.col("c.kind") == "text", decode(F.col("content"))).alias("text"),
    )


def signals(texts: DataFrame, rules: Sequence[Rule] = BUILTIN_RULES) -> DataFrame:
    """Long table of secret, command and hidden-text signals of (bundle, file, text)."""
    found_in = F.concat(command_signals(F.col("text")), obfuscation_signals(F.col("text")))
    hits = texts.where(F.col("text").rlike(SIGNAL_PRETEST)).select(*KEYS, F.explode(found_in).alias("s"))
    found = hits.select(
        *KEYS, "s.kind", "s.name", F.lit(None).cast("string").alias("severity"), "s.line", "s.sample"
    )
    secrets = scan_texts(texts, rules, KEYS).select(
        *KEYS, F.lit("secret").alias("kind"), F.col("rule").alias("name"), "severity", "line",
        F.col("redacted").alias("sample"),
    )
    return found.unionByName(secrets)


def inventory_signals(inventory: DataFrame) -> DataFrame:
    """Suspicious files in the shape of :func:`signals`."""
    return inventory.where("suspicious").select(
        *KEYS, F.lit("suspicious-file").alias("kind"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("severity"), F.lit(None).cast("int").alias("line"),
        F.concat(F.col("bytes").cast("string"), F.lit(" bytes")).alias("sample"),
    )


def inventory_counts(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("bundle").agg(
        F.count_if(F.col("kind") == "text").alias("text_files"),
        F.count_if(F.col("kind") == "binary").alias("binary_files"),
        F.count_if("suspicious").alias("suspicious_files"),
    )


def suspicious_files(inventory: DataFrame) -> DataFrame:
    return inventory.where("suspicious").select("bundle", "file", "bytes").orderBy("bundle", "file")


def _reason(count: Column, text: str) -> Column:
    return F.when(count > 0, F.concat(count.cast("string"), F.lit(text)))


def bundle_summary(bundles: DataFrame, all_signals: DataFrame) -> DataFrame:
    """(bundle, severity, findings, reasons) for every bundle, clean ones included."""
    kind = F.col("kind")
    counts = all_signals.groupBy("bundle").agg(
        F.count_if(kind == "secret").alias("secrets"),
        F.coalesce(F.max(F.when(kind == "secret", rank(F.col("severity")))), F.lit(0)).alias("secret_rank"),
        F.count_if(kind == "command").alias("commands"),
        F.count_if(kind.isin(*HARD_KINDS)).alias("hard"),
        F.count_if(kind.isin(*SOFT_KINDS)).alias("soft"),
        F.count_if(kind == "suspicious-file").alias("suspicious"),
    )
    names = ["secrets", "secret_rank", "commands", "hard", "soft", "suspicious"]
    joined = bundles.select("bundle").distinct().join(counts, "bundle", "left").fillna(0, names)
    worst = F.greatest(
        F.col("secret_rank"),
        F.when(F.col("commands") > 0, 3).otherwise(0),
        F.when(F.col("hard") > 0, 4).otherwise(0),
        F.when(F.col("soft") > 0, 2).otherwise(0),
        F.when(F.col("suspicious") > 0, 2).otherwise(0),
    )
    reasons = F.array_compact(
        F.array(
            _reason(F.col("secrets"), " secret finding(s)"),
            _reason(F.col("commands"), " high-risk command(s)"),
            _reason(F.col("hard"), " hard obfuscation signal(s)"),
            _reason(F.col("soft"), " obfuscation signal(s)"),
            _reason(F.col("suspicious"), " suspicious file(s)"),
        )
    )
    return joined.select(
        "bundle", tier(worst).alias("severity"),
        (F.col("secrets") + F.col("commands") + F.col("hard") + F.col("soft") + F.col("suspicious")).alias("findings"),
        reasons.alias("reasons"),
    )


def escalate(summary: DataFrame, deep_findings: DataFrame) -> DataFrame:
    """Fold a deep analyser's (bundle, severity) findings in; only medium and up count."""
    deep = (
        deep_findings.select("bundle", rank(deep_tier(F.col("severity"))).alias("r"))
        .where(F.col("r") >= 2).groupBy("bundle").agg(F.count("*").alias("actionable"), F.max("r").alias("r"))
    )
    joined = summary.join(deep, "bundle", "left").fillna(0, ["actionable", "r"])
    extra = F.when(
        F.col("actionable") > 0,
        F.array(F.concat(F.lit("deep engine: "), F.col("actionable").cast("string"), F.lit(" actionable finding(s)"))),
    ).otherwise(F.array().cast("array<string>"))
    return joined.select(
        "bundle", tier(F.greatest(rank(F.col("severity")), F.col("r"))).alias("severity"),
        (F.col("findings") + F.col("actionable")).alias("findings"),
        F.concat("reasons", extra).alias("reasons"),
    )


def rollup(summaries: DataFrame, *keys: str) -> DataFrame:
    """Tier counts, worst tier, findings and reasons over many bundles."""
    s = F.col("severity")
    names = ("clean", "low", "medium", "high", "critical")
    counted = summaries.groupBy(*keys).agg(
        F.count("*").alias("bundles"), F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"),
        F.coalesce(F.max(rank(s)), F.lit(0)).alias("worst_rank"),
        *[F.count_if(s == n).alias(n) for n in names],
    )
    reasons = F.array_compact(
        F.array(
            _reason(F.col("critical"), " critical bundle(s)"),
            _reason(F.col("high"), " high-severity bundle(s)"),
            _reason(F.col("medium"), " medium-severity bundle(s)"),
            _reason(F.col("low"), " low-severity bundle(s)"),
        )
    )
    only_clean = F.array(F.concat(F.col("clean").cast("string"), F.lit(" clean bundle(s)")))
    return counted.select(
        *keys, "bundles", *names, "findings", tier(F.col("worst_rank")).alias("worst"),
        ((F.col("high") + F.col("critical")) > 0).alias("failed"),
        F.when(F.size(reasons) > 0, reasons).otherwise(only_clean).alias("reasons"),
    )


def platform_rollup(summaries: DataFrame) -> DataFrame:
    """One row per platform plus one for all (platform NULL); fails on high or critical."""
    s = F.col("severity")
    names = ("clean", "low", "medium", "high", "critical")
    return summaries.rollup("platform").agg(
        F.count("*").alias("bundles"), F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"),
        tier(F.coalesce(F.max(rank(s)), F.lit(0))).alias("worst"),
        *[F.count_if(s == n).alias(n) for n in names],
        (F.count_if(s.isin("high", "critical")) > 0).alias("failed"),
    )


def bundle_urls(texts: DataFrame) -> DataFrame:
    """Distinct (bundle, url) rows; long form, as a bundle may hold very many."""
    return texts.select("bundle", F.explode(extract_urls(F.col("text"))).alias("url")).distinct()


def bundle_front_matter(texts: DataFrame) -> DataFrame:
    """Front matter of every SKILL.md: name, version, description, allowed tools."""
    docs = texts.where(F.lower(F.substring_index("file", "/", -1)) == "skill.md")
    m = F.col("m")
    return docs.select(*KEYS, front_matter(F.col("text")).alias("m")).select(
        *KEYS, m["name"].alias("name"), m["version"].alias("version"),
        m["description"].alias("description"), list_field(m["allowed-tools"]).alias("allowed_tools"),
    )


def bundle_dirs(files: DataFrame) -> DataFrame:
    """Relative directory of every bundle manifest, in order."""
    return (
        files.where(F.lower(F.substring_index("path", "/", -1)) == "skill.md")
        .select(F.regexp_replace("path", r"/?[^/]*$", "").alias("rel_dir")).distinct().orderBy("rel_dir")
    )


def quick_counts(texts: DataFrame, rules: Sequence[Rule] = BUILTIN_RULES) -> DataFrame:
    """Per file: number of secrets, distinct URLs and high-risk commands."""
    urls = F.array_distinct(F.regexp_extract_all("text", F.lit(QUICK_URL), F.lit(0)))
    native, arrow = partition_rules(rules)
    secrets = match_count("text", native)
    if arrow:
        secrets = secrets + F.size(hit_names(F.col("text"), arrow))
    return texts.select(
        *KEYS, secrets.alias("secrets"), F.size(urls).alias("urls"),
        F.size(command_signals(F.col("text"), QUICK_COMMAND_SIGNALS)).alias("commands"),
    )
