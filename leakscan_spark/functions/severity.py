"""Severity mappings for other tools' findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rule-id fragments and tags that decide an external finding's tier.
CRITICAL_PARTS = ("private-key", "password", "database", "access-token", "secret-key")
HIGH_PARTS = ("api-key", "-token")


def external_severity(rule_id: Column, tags: Column) -> Column:
    """Tier of another engine's finding from its rule id and tags."""
    rid = F.lower(rule_id)
    tags = F.coalesce(tags, F.array().cast("array<string>"))

    def has(*parts: str) -> Column:
        return rid.rlike("|".join(parts))

    return (
        F.when(
            has(*CRITICAL_PARTS)
            | rid.endswith("-pat")
            | (F.array_contains(tags, "key") & F.array_contains(tags, "secret")),
            "critical",
        )
        .when(has(*HIGH_PARTS) | rid.startswith("token-") | F.array_contains(tags, "api"), "high")
        .when(rid.contains("generic") | F.array_contains(tags, "generic"), "medium")
        .otherwise("high")
    )


def normalise_level(level: Column) -> Column:
    """error/warning/note style levels as tiers; unknown is medium."""
    v = F.lower(level)
    return (
        F.when(v.isin("error", "critical"), "critical")
        .when(v.isin("warning", "high"), "high")
        .when(v.isin("note", "medium"), "medium")
        .when(v == "low", "low")
        .otherwise("medium")
    )


def deep_tier(severity: Column) -> Column:
    """Tier of a deep-analysis finding; informational and unknown are low."""
    v = F.upper(severity)
    return (
        F.when(v == "CRITICAL", "critical").when(v == "HIGH", "high").when(v == "MEDIUM", "medium")
        .otherwise("low")
    )
