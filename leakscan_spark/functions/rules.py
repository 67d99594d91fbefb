"""Detection rules: the built-in table, user rules, and which engine runs each.

A rule list is configuration. It is unrolled into literal-pattern expressions,
so Spark compiles each pattern once per task and no rule join is planned.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

SEVERITIES = ("low", "medium", "high", "critical")


@dataclass(frozen=True)
class Rule:
    name: str
    regex: str
    severity: str = "high"
    description: str = ""
    # Literals of which every match contains at least one; empty = unknown.
    needles: tuple[str, ...] = field(default=(), compare=False)
    # Whether the needles are compared without regard to case.
    fold: bool = field(default=False, compare=False)
    # Literals of which every match contains one, tried before folded needles.
    gate: tuple[str, ...] = field(default=(), compare=False)


QUOTES = ('"', "'")

# Names, patterns and severities of the built-in rules, in order.
BUILTIN_RULES: tuple[Rule, ...] = (
    Rule("AWS Access Key ID", r"AKIA[0-9A-Z]{16}", "critical", "AWS access key id", ("AKIA",)),
    Rule("AWS Secret Access Key", r"(?i)aws.{0,20}?['\"][0-9a-zA-Z/+]{40}['\"]", "critical",
         "AWS secret access key", ("aws",), True, QUOTES),
    Rule("GitHub Personal Access Token", r"ghp_[a-zA-Z0-9]{36}", "critical",
         "GitHub personal access token", ("ghp_",)),
    Rule("GitHub OAuth Token", r"gho_[a-zA-Z0-9]{36}", "critical", "GitHub OAuth token", ("gho_",)),
    Rule("GitHub App Token", r"(?:ghu|ghs)_[a-zA-Z0-9]{36}", "critical", "GitHub app token",
         ("ghu_", "ghs_")),
    Rule("GitHub Refresh Token", r"ghr_[a-zA-Z0-9]{76}", "critical", "GitHub refresh token", ("ghr_",)),
    Rule("Google API Key", r"AIza[0-9A-Za-z\-_]{35}", "critical", "Google API key", ("AIza",)),
    Rule("Google OAuth", r"[0-9]+-[0-9A-Za-z_]{32}\.apps\.googleusercontent\.com", "critical",
         "Google OAuth client id", (".apps.googleusercontent.com",)),
    Rule("Slack Token", r"xox[baprs]-[0-9a-zA-Z]{10,48}", "critical", "Slack token", ("xox",)),
    Rule("Slack Webhook",
         r"https://hooks\.slack\.com/services/T[a-zA-Z0-9_]{8}/B[a-zA-Z0-9_]{8}/[a-zA-Z0-9_]{24}",
         "high", "Slack incoming webhook", ("https://hooks.slack.com/services/T",)),
    Rule("Stripe API Key", r"sk_live_[0-9a-zA-Z]{24}", "critical", "Stripe live key", ("sk_live_",)),
    Rule("Stripe Restricted API Key", r"rk_live_[0-9a-zA-Z]{24}", "critical",
         "Stripe restricted live key", ("rk_live_",)),
    Rule("Twilio API Key", r"SK[0-9a-fA-F]{32}", "critical", "Twilio API key", ("SK",)),
    Rule("Generic API Key",
         r"(?i)(?<![a-zA-Z0-9_])api[_-]?key[\s]*[:=][\s]*['\"](?=[0-9a-zA-Z\-_]*[0-9])[0-9a-zA-Z\-_]{16,256}['\"]",
         "high", "Generic API key", ("api",), True, QUOTES),
    Rule("Generic Secret",
         r"(?i)(?<![a-zA-Z0-9_])(secret|password|passwd|pwd)[\s]*[:=][\s]*['\"](?=[^\s'\"]*[0-9!@#$%^&*()])[0-9a-zA-Z\-_!@#$%^&*()]{8,256}['\"]",
         "high", "Generic secret", ("secret", "passw", "pwd"), True, QUOTES),
    Rule("Private Key", r"-----BEGIN (?:RSA |DSA |EC |OPENSSH )?PRIVATE KEY-----", "critical",
         "Private key block", ("-----BEGIN ",)),
    Rule("Bearer Token", r"Bearer [a-zA-Z0-9\-._~+/]+=*", "high", "Bearer token", ("Bearer ",)),
    Rule("Database Connection String",
         r"(?:postgres|mysql|mongodb)://[^\s:@]{1,256}:[^\s@]{1,256}@[^\s]{1,512}", "critical",
         "Database connection string with credentials", ("postgres://", "mysql://", "mongodb://")),
    Rule("JSON Web Token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "high",
         "JSON web token", ("eyJ",)),
    Rule("npm Access Token", r"npm_[A-Za-z0-9]{36}", "critical", "npm access token", ("npm_",)),
    Rule("PyPI Token", r"pypi-AgEIcHlwaS5vcmc[A-Za-z0-9\-_]{50,1000}", "critical", "PyPI upload token",
         ("pypi-AgEIcHlwaS5vcmc",)),
    Rule("HashiCorp Vault Token", r"hvs\.[A-Za-z0-9_-]{90,300}", "critical", "HashiCorp Vault token",
         ("hvs.",)),
    Rule("DigitalOcean Personal Access Token", r"dop_v1_[a-f0-9]{64}", "critical",
         "DigitalOcean personal access token", ("dop_v1_",)),
    Rule("Mailchimp API Key", r"[0-9a-f]{32}-us[0-9]{1,2}", "critical", "Mailchimp API key", ("-us",)),
    Rule("SendGrid API Key", r"SG\.[a-zA-Z0-9_-]{22}\.[a-zA-Z0-9_-]{43}", "critical",
         "SendGrid API key", ("SG.",)),
)

# Rules whose quoted value may turn out to be a variable name.
GENERIC_RULES = ("Generic API Key", "Generic Secret")


def all_rules(custom: Iterable[Rule] = (), policy: Iterable[Rule] = ()) -> list[Rule]:
    """Built-in rules first, then directory rules, then policy rules."""
    return [*BUILTIN_RULES, *custom, *policy]


def compiles(regex: str) -> bool:
    try:
        re.compile(regex)
    except (re.error, OverflowError, RecursionError):
        return False
    return True


def can_match_empty(regex: str) -> bool:
    """True unless every match is known to be at least one character long."""
    return re._parser.parse(regex).getwidth()[0] == 0


# Constructs that the JVM's regex dialect lacks or reads differently. A nested
# "[" or "&&" inside a character class is set algebra there.
_PYTHON_ONLY = re.compile(r"\(\?P(?![<=][A-Za-z][A-Za-z0-9]*[>)])|\(\?\(|\(\?#|\\[ZNU0]|\(\?[a-z]*[aLux]|&&|(?<!\\)\{(?!\d+(?:,\d*)?\})")
_CLASS_WITH_BRACKET = re.compile(r"\[\^?\]?[^\]\\]*(?:\\.[^\]\\]*)*\[")


def runs_natively(rule: Rule) -> bool:
    """Whether Spark's own regex functions give the rule's exact matches."""
    return (
        compiles(rule.regex)
        and not _PYTHON_ONLY.search(rule.regex)
        and not _CLASS_WITH_BRACKET.search(rule.regex)
        and not can_match_empty(rule.regex)
    )


_NAMED_REFERENCE = re.compile(r"\(\?P=([A-Za-z][A-Za-z0-9]*)\)")
_CLASS_ESCAPE = re.compile(r"\\[sSdDwWbB]|\(\?[a-z]*i")


def java_regex(regex: str) -> str:
    """The pattern with flags that make the JVM read it the Python way.

    Named groups are respelled. ``d`` leaves "\\n" as the only line end; ``U`` gives \\s, \\d, \\w, \\b and
    case folding their Unicode meaning, and is added only where it matters.
    """
    respelled = _NAMED_REFERENCE.sub(r"\\k<\1>", regex.replace("(?P<", "(?<"))
    return ("(?dU)" if _CLASS_ESCAPE.search(regex) else "(?d)") + respelled


_CONTEXT = re.compile(r"\(\?[=!<>]|\\[AZzGB]|(?<!\\)[$]|(?<![\\\[])\^|[+*?}]\+")


def is_context_free(regex: str) -> bool:
    """No anchors, look-around or possessive parts: a match inside one line is
    then also a match inside the text that holds the line."""
    return not _CONTEXT.search(regex)


def is_position_free(regex: str) -> bool:
    """Whether the text of a match would match wherever it stands: context-free, and without
    anchors and word borders in any spelling."""
    return is_context_free(regex) and not re.search(r"[$^]|\\[bB]", regex.replace("[^", "["))


def partition_rules(rules: Sequence[Rule]) -> tuple[list[tuple[int, Rule]], list[tuple[int, Rule]]]:
    """Split numbered rules into (native, Arrow); rules that do not compile drop out."""
    valid = [(i, r) for i, r in enumerate(rules) if compiles(r.regex)]
    native = [(i, r) for i, r in valid if runs_natively(r)]
    chosen = {i for i, _ in native}
    return native, [(i, r) for i, r in valid if i not in chosen]
