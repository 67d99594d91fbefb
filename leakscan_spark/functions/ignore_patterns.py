"""Lines of ignore files as patterns: what they match, whether they negate, and whether only folders count."""

from __future__ import annotations

import re
from typing import NamedTuple

# Named character classes and their spelling in the JVM.
NAMED_CLASSES = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}",
    "graph": r"\p{Graph}", "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\p{Space}",
    "upper": r"\p{Upper}", "xdigit": r"\p{XDigit}",
}


class IgnorePattern(NamedTuple):
    regex: str
    negated: bool
    folders_only: bool
    on_name: bool  # matched against the last part of a path, else the path below the ignore file's folder


# Pieces of a pattern. Stars between slashes, or at an end beside one, cross folders.
_PIECE = re.compile(
    r"(?P<lead>(?:^|(?<=/))\*\*+/)|(?P<rest>(?<=/)\*\*+\Z)|(?P<star>\*+)|(?P<one>\?)|\\(?P<escaped>.)|(?P<open>\[)|(?P<text>.)",
    re.S,
)
_MEMBER = re.compile(r"\[:(?P<named>\w+):\]|\\(?P<escaped>.)|(?P<text>.)", re.S)
_TRAILING_SPACES = re.compile(r"((?:^|[^\\])(?:\\\\)*) +$")


def _set(pattern: str, at: int) -> tuple[str, int] | None:
    """The character set that opens before ``at``, and where it ends; None if it never closes."""
    negated = pattern[at : at + 1] in ("!", "^")
    at += negated
    members: list[str] = []
    first = True
    while at < len(pattern):
        m = _MEMBER.match(pattern, at)
        if m["text"] == "]" and not first:
            return f"[{'^/' if negated else ''}{''.join(members)}&&[^/]]", m.end()
        if m["named"] is not None:
            if m["named"] not in NAMED_CLASSES:
                return None
            members.append(NAMED_CLASSES[m["named"]])
        elif m["text"] == "-" and not first and pattern[m.end() : m.end() + 1] not in ("]", ""):
            members.append("-")
        else:
            members.append(re.sub(r"([^\w])", r"\\\1", m["escaped"] or m["text"], flags=re.A))
        at, first = m.end(), False
    return None


def ignore_pattern(line: str) -> IgnorePattern | None:
    """The pattern of one line; None for blank lines, comments and patterns that never match."""
    if line.startswith("#"):
        return None
    text = _TRAILING_SPACES.sub(r"\1", line)
    text = "" if not text.strip(" ") else text
    negated = text.startswith("!")
    text = text[negated:]
    folders_only = text.endswith("/")
    text = text.removesuffix("/")
    if not text:
        return None
    on_name = "/" not in text
    text = text.removeprefix("/")
    out, at = "", 0
    while at < len(text):
        m = _PIECE.match(text, at)
        kind, at = m.lastgroup, m.end()
        if kind == "open":
            found = _set(text, at)
            if found is None:
                return None
            out += found[0]
            at = found[1]
        elif kind == "text" and m["text"] == "\\":
            return None  # a lone backslash at the end
        elif kind in ("text", "escaped"):
            out += re.escape(m[kind])
        else:
            out += {"lead": "(?:.*/)?", "rest": ".+", "star": "[^/]*", "one": "[^/]"}[kind]
    return IgnorePattern(f"(?s)^(?:{out})\\z", negated, folders_only, on_name)
