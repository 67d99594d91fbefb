"""Command risk tiers and policy decisions as CASE expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import any_of, stripped
from .rules import compiles

# The risk patterns of each tier, in order.
_CRITICAL_DIRS = "home|etc|usr|boot|root|sys|proc|lib|lib64|bin|sbin|opt"
CRITICAL_PATTERNS = (
    r"rm\s+(-[a-z]*r[a-z]*\s+)*-[a-z]*f[a-z]*\s+/(\s|$)",
    r"rm\s+(-[a-z]*f[a-z]*\s+)*-[a-z]*r[a-z]*\s+/(\s|$)",
    rf"rm\s+(-[a-z]*r[a-z]*\s+)*-[a-z]*f[a-z]*\s+/({_CRITICAL_DIRS})(/|\s|$)",
    rf"rm\s+(-[a-z]*f[a-z]*\s+)*-[a-z]*r[a-z]*\s+/({_CRITICAL_DIRS})(/|\s|$)",
    r":\(\)\{\s*:\|:&\s*\};:",
    r"dd\s+if=.*of=/dev/sd",
    r">\s*/dev/sd",
    r"mkfs",
    r"fdisk",
    r"parted",
)
HIGH_PATTERNS = (
    r"rm\s+(-[a-z]*r[a-z]*\s+)*-[a-z]*f[a-z]*",
    r"rm\s+(-[a-z]*f[a-z]*\s+)*-[a-z]*r[a-z]*",
    r"sudo\s+rm",
    r"chmod\s+777",
    r"curl.*\|\s*(bash|sh|zsh|dash)\b",
    r"wget.*\|\s*(bash|sh|zsh|dash)\b",
    r"git\s+push\b.*\s--force\b",
    r"git\s+push\b.*\s-[a-zA-Z]*f\b",
    r"git\s+push\b.*\s--force-(with-lease|if-includes)\b",
    r"git\s+push\s+\S*\s+\+",
    r"docker\s+system\s+prune",
    r"npm\s+publish",
    r"pypi.*upload",
)
MEDIUM_PATTERNS = (
    r"sudo", r"chmod", r"chown", r"systemctl", r"service", r"kill\s+-9", r"pkill", r"killall",
)
DEFAULT_APPROVAL_PATTERNS = (
    r"rm -rf",
    r"sudo rm",
    r"curl.*\|\s*(bash|sh|zsh|dash)\b",
    r"wget.*\|\s*(bash|sh|zsh|dash)\b",
    r"chmod 777",
    r"git push --force",
    r"git push -f",
    r"git push --force-with-lease",
    r"git push --force-if-includes",
    r"git push .* \+",
)
# Texts of the decisions.
CRITICAL_REASON = "Matches built-in blocked pattern (critical destructive command)"
HIGH_RISK_REASON = "High risk command requires approval"


@dataclass(frozen=True)
class CommandPolicy:
    mode: str = "approve-dangerous"
    blocked: Sequence[str] = field(default=CRITICAL_PATTERNS)
    approval: Sequence[str] = field(default=DEFAULT_APPROVAL_PATTERNS)


def _hit(command: Column, pattern: str) -> Column:
    return command.rlike("(?idU)" + pattern)


def risk_tier(sanitised: Column) -> Column:
    """critical, high, medium or low; the first tier with a hit decides."""
    c = stripped(sanitised)
    return (
        F.when(any_of(_hit(c, p) for p in CRITICAL_PATTERNS), "critical")
        .when(any_of(_hit(c, p) for p in HIGH_PATTERNS), "high")
        .when(any_of(_hit(c, p) for p in MEDIUM_PATTERNS), "medium")
        .otherwise("low")
    )


def first_critical_rule(sanitised: Column) -> Column:
    """The first critical pattern that matches, else NULL."""
    c = stripped(sanitised)
    return F.coalesce(*[F.when(_hit(c, p), F.lit(p)) for p in CRITICAL_PATTERNS])


def _first_pattern(sanitised: Column, patterns: Sequence[str]) -> Column:
    """First policy pattern that matches; one that is no regex is a substring."""
    tests = [
        F.when(
            _hit(sanitised, p) if compiles(p) else F.lower(sanitised).contains(p.lower()), F.lit(p)
        )
        for p in patterns
    ]
    return F.coalesce(*tests, F.lit(None).cast("string"))


def decide(sanitised: Column, risk: Column, policy: CommandPolicy = CommandPolicy()) -> Column:
    """Struct (risk, allowed, requires_approval, reason, matched) for a command."""
    blocked = _first_pattern(sanitised, policy.blocked)
    approval = _first_pattern(sanitised, policy.approval)

    def verdict(allowed: bool, approve: bool, reason: Column, matched: Column) -> Column:
        return F.struct(
            risk.alias("risk"),
            F.lit(allowed).alias("allowed"),
            F.lit(approve).alias("requires_approval"),
            reason.cast("string").alias("reason"),
            matched.cast("string").alias("matched"),
        )

    none = F.lit(None)
    result = F.when(
        risk == "critical",
        verdict(
            False, False, F.lit(CRITICAL_REASON),
            F.coalesce(first_critical_rule(sanitised), F.lit("builtin:critical-destructive")),
        ),
    ).when(
        blocked.isNotNull(),
        verdict(False, False, F.concat(F.lit("Matches blocked pattern: "), blocked), blocked),
    ).when(
        approval.isNotNull(),
        verdict(False, True, F.concat(F.lit("Matches approval pattern: "), approval), approval),
    )
    if policy.mode == "approve-dangerous":
        result = result.when(risk == "high", verdict(False, True, F.lit(HIGH_RISK_REASON), none))
    return result.otherwise(verdict(True, False, none, none))
