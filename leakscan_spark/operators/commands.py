"""Command and write gates, tool-output redaction, and the policy overlay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow_rules import hit_names
from ..functions.columns import WHITE_SPACE, computed_once
from ..functions.command_view import without_prose
from ..functions.matching import has_matches, match_count, matched_names
from ..functions.paths import is_excluded, relative_to
from ..functions.payloads import is_object, tool_request, tool_response
from ..functions.redaction import redact_text
from ..functions.risk import CommandPolicy, decide, risk_tier
from ..functions.rules import BUILTIN_RULES, Rule, partition_rules
from ..sources.suppressions import Suppression
from .triage import first_suppression

ALLOW = "allow"
DENY = "deny"
DEFAULT_PATH = "file content"


def assess(commands: DataFrame) -> DataFrame:
    """(command) rows with the text the patterns see and the risk tier."""
    viewed = computed_once(commands.withColumn("sanitised", without_prose(F.col("command"))), "sanitised")
    return viewed.withColumn("risk", risk_tier(F.col("sanitised")))


def evaluate(commands: DataFrame, policy: CommandPolicy = CommandPolicy()) -> DataFrame:
    """Commands with risk, allowed, requires_approval, reason and matched."""
    judged = assess(commands).withColumn("d", decide(F.col("sanitised"), F.col("risk"), policy))
    return judged.select(
        *commands.columns, "risk", "d.allowed", "d.requires_approval", "d.reason", "d.matched"
    )


def requests(events: DataFrame) -> DataFrame:
    """(event_id, format, payload) with (tool, input); malformed payloads have no tool."""
    request = F.when(is_object(F.col("payload")), tool_request(F.col("format"), F.col("payload")))
    return computed_once(events.withColumn("r", request), "r").select(
        *[c for c in events.columns if c != "payload"], "r.tool", "r.input"
    )


def write_rules(
    content: str,
    path: Column,
    rules: Sequence[Rule] = BUILTIN_RULES,
    exclude_paths: Sequence[str] = (),
    suppressions: Sequence[Suppression] = (),
    root: str | None = None,
) -> Column:
    """Sorted distinct names of rules a written text breaks; empty when it may pass.

    Everything happens inside the row, so no event is joined back to its findings.
    """
    native, arrow = partition_rules(rules)
    names = F.coalesce(matched_names(content, native), F.array().cast("array<string>"))
    if arrow:
        names = F.array_distinct(F.concat(names, hit_names(F.col(content), arrow)))
    if suppressions:
        names = F.filter(names, lambda n: first_suppression(path, n, suppressions).isNull())
    if exclude_paths:
        rel = relative_to(path, root) if root else path
        names = F.when(~is_excluded(rel, exclude_paths), names)
    return F.coalesce(F.array_sort(names), F.array().cast("array<string>"))


def gate(
    events: DataFrame,
    policy: CommandPolicy = CommandPolicy(),
    rules: Sequence[Rule] = BUILTIN_RULES,
    exclude_paths: Sequence[str] = (),
    suppressions: Sequence[Suppression] = (),
    staged: DataFrame | None = None,
) -> DataFrame:
    """(event_id, tool, decision, reason) for tool events; anything unreadable passes.

    ``staged`` is (repo, reason): repositories whose staged lines hold secrets.
    Only commands that start a commit or a push are looked up there.
    """
    r = requests(events)
    command = F.when(F.col("tool") == "Bash", F.coalesce("input.command", F.lit("")))
    text = F.when(
        F.col("tool").isin("Write", "Edit"),
        F.when(F.coalesce("input.content", F.lit("")) != "", F.col("input.content")).otherwise(F.col("input.new_string")),
    )
    r = r.withColumn("command", command).withColumn("content", text)
    if staged is None:
        return _decided(r.withColumn("staged_reason", F.lit(None).cast("string")), policy, rules, exclude_paths, suppressions)
    starts = F.ltrim("command", F.lit(WHITE_SPACE))
    shares = F.coalesce(starts.startswith("git commit") | starts.startswith("git push"), F.lit(False))
    # One pass over the events: all but commits and pushes get a key of their own, so they spread and meet nothing.
    key = F.struct(shares.alias("shares"), F.when(shares, F.col("repo")).otherwise(F.col("event_id").cast("string")).alias("of"))
    known = staged.select(F.struct(F.lit(True).alias("shares"), F.col("repo").alias("of")).alias("staged_key"), F.col("reason").alias("staged_reason"))
    joined = r.withColumn("staged_key", key).join(known, "staged_key", "left").drop("staged_key")
    return _decided(joined, policy, rules, exclude_paths, suppressions)


def _decided(
    r: DataFrame, policy: CommandPolicy, rules: Sequence[Rule], exclude_paths: Sequence[str], suppressions: Sequence[Suppression]
) -> DataFrame:
    """Decisions on (event_id, tool, input, command, content, staged_reason)."""
    r = computed_once(r.withColumn("sanitised", without_prose(F.col("command"))), "sanitised")
    r = r.withColumn("risk", risk_tier(F.col("sanitised")))
    r = computed_once(r.withColumn("d", decide(F.col("sanitised"), F.col("risk"), policy)), "d")
    path = F.coalesce("input.file_path", F.lit(DEFAULT_PATH))
    r = computed_once(r.withColumn("names", write_rules("content", path, rules, exclude_paths, suppressions)), "names")
    staged_reason = F.col("staged_reason")
    write_reason = F.when(
        F.size("names") > 0,
        F.concat(F.lit("Secret detected in "), path, F.lit(": "), F.array_join("names", ", ")),
    )
    reason = (
        F.when(F.col("tool") == "Bash", F.when(~F.col("d.allowed"), F.col("d.reason")).otherwise(staged_reason))
        .when(F.col("tool").isin("Write", "Edit"), write_reason)
    )
    return r.select(
        "event_id", "tool", F.when(reason.isNull(), ALLOW).otherwise(DENY).alias("decision"), reason.alias("reason")
    )


def redact_outputs(events: DataFrame, rules: Sequence[Rule] = BUILTIN_RULES) -> DataFrame:
    """(event_id, tool, action, output, content, matched) of tool results.

    A field changes only when it holds a secret; ``matched`` counts the secrets of
    both fields of a changed event.
    """
    native, arrow = partition_rules(rules)
    response = F.when(is_object(F.col("payload")), tool_response(F.col("format"), F.col("payload")))
    r = events.withColumn("r", response).select("event_id", "r.tool", "r.output", "r.content")

    def hit(c: str) -> Column:
        hits = has_matches(c, native)
        if arrow:
            hits = hits | (F.size(hit_names(F.col(c), arrow)) > 0)
        return F.coalesce(hits, F.lit(False))

    def count(c: str) -> Column:
        total = match_count(c, native)
        if arrow:
            total = total + F.size(hit_names(F.col(c), arrow))
        return F.when(F.col(c + "_hit"), total).otherwise(0)

    r = r.withColumn("output_hit", hit("output")).withColumn("content_hit", hit("content"))
    changed = F.col("output_hit") | F.col("content_hit")
    return r.select(
        "event_id", "tool", F.when(changed, "modify").otherwise("continue").alias("action"),
        *[F.when(F.col(c + "_hit"), redact_text(c, list(enumerate(rules)))).otherwise(F.col(c)).alias(c) for c in ("output", "content")],
        (count("output") + count("content")).alias("matched"),
    )


def pretool_reply(fmt: Column, decision: Column, reason: Column) -> Column:
    """The decision in the JSON form each host expects; NULL where silence means yes."""
    deny = decision == DENY
    word = F.when(deny, DENY).otherwise(ALLOW)
    why = F.when(deny, reason)
    cursor = F.to_json(F.struct(word.alias("permission"), why.alias("agentMessage"), why.alias("userMessage")))
    gemini = F.when(deny, F.to_json(F.struct(F.lit(DENY).alias("decision"), reason.alias("reason")))).otherwise("{}")
    common = F.to_json(
        F.struct(
            F.struct(
                F.lit("PreToolUse").alias("hookEventName"), word.alias("permissionDecision"),
                F.coalesce(why, F.lit("")).alias("permissionDecisionReason"),
            ).alias("hookSpecificOutput")
        )
    )
    return (
        F.when(fmt == "cursor", cursor).when(fmt == "gemini", gemini)
        .when(fmt == "windsurf", why).otherwise(common)
    )


def overlay_policy(
    base: DataFrame, project: DataFrame, keys: Sequence[str] = ("key",), or_flags: Sequence[str] = ()
) -> DataFrame:
    """Settings (keys..., scalar, items) of a project laid over a base.

    A project value replaces the base value; arrays replace as a whole. Flags in
    ``or_flags`` can be turned on by either side and off by neither.
    """
    b = base.select(*keys, F.col("scalar").alias("b_scalar"), F.col("items").alias("b_items"))
    p = project.select(*keys, F.col("scalar").alias("p_scalar"), F.col("items").alias("p_items"))
    either = F.greatest(
        F.coalesce(F.col("b_scalar") == "true", F.lit(False)), F.coalesce(F.col("p_scalar") == "true", F.lit(False))
    )
    chosen = F.coalesce(F.nullif("p_scalar", F.lit("")), F.col("b_scalar"))
    flagged = F.col("key").isin(*or_flags) if or_flags else F.lit(False)
    return b.join(p, list(keys), "full_outer").select(
        *keys,
        F.when(flagged, either.cast("string")).otherwise(chosen).alias("scalar"),
        F.coalesce("p_items", "b_items").alias("items"),
    )
