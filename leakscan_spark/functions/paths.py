"""Path patterns: suppression globs and exclude entries as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import any_of


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


# A shell-style wildcard class, e.g. [abc] or [!a-z]; "]" may come first.
_WILDCARD_CLASS = re.compile(r"\[(!?+)(\][^\]]*|[^\]]+)\]")


def wildcard_regex(pattern: str) -> str:
    """Shell wildcards for a whole string: ``*`` and ``?`` also cross ``/``."""
    out, rest = "", pattern
    while rest:
        cls = _WILDCARD_CLASS.match(rest)
        if cls:
            body = re.sub(r"([\\\[&^\]])", r"\\\1", cls[2])
            out += f"[{'^' if cls[1] else ''}{body}]"
            rest = rest[cls.end():]
            continue
        out += {"*": ".*", "?": "."}.get(rest[0], re.escape(rest[0]))
        rest = rest[1:]
    return f"(?s)^(?:{out})\\z"


# Pieces of a path glob, longest first.
_GLOB_PIECE = re.compile(r"(?P<deep>\*\*/?)|(?P<star>\*)|(?P<one>\?)|(?P<cls>\[[^\]/]+\])|(?P<text>.)", re.S)


def _path_glob(glob: str) -> str:
    def piece(m: re.Match) -> str:
        kind = m.lastgroup
        if kind == "text":
            return re.escape(m[0])
        return {"deep": ".*", "star": "[^/]*", "one": "[^/]", "cls": m[0]}[kind]

    return _GLOB_PIECE.sub(piece, glob)


def glob_regex(glob: str) -> tuple[str, bool]:
    """Compile a suppression glob to (regex, applies_to_basename).

    Without ``/`` the glob is a wildcard on the file name. With ``/`` it covers
    the whole path, and also any deeper position unless it is anchored.
    """
    g = glob.replace("\\", "/")
    if "/" not in g:
        return wildcard_regex(g), True
    body = _path_glob(g)
    if not g.startswith(("/", "**")):
        body = f"(?:.*)?{body}"
    return f"^(?:{body})\\z", False


def matches_glob(path: Column, glob: str) -> Column:
    """Whether a path falls under a suppression glob."""
    regex, on_name = glob_regex(glob)
    p = slashes(path)
    return (basename(p) if on_name else p).rlike(regex)


def is_excluded(rel_path: Column, entries: Iterable[str]) -> Column:
    """Whether a scan-root-relative path falls under any exclude entry."""
    rel = slashes(rel_path)
    tests = []
    for entry in entries:
        p = entry.replace("\\", "/").rstrip("/")
        if not p:
            continue
        # Exact, below the entry, or one of the path's segments.
        tests += [rel == p, rel.startswith(p + "/")]
        if "/" not in p:
            tests.append(F.array_contains(F.split(rel, "/"), p))
        if any(c in p for c in "*?["):
            tests.append(rel.rlike(wildcard_regex(p)))
            if not p.startswith(("/", "**")):
                # "*" crosses "/" here, so this also covers the "**/" form.
                tests.append(rel.rlike(wildcard_regex("*/" + p)))
    return any_of(tests)


def relative_to(path: Column, root: str) -> Column:
    """Path below the scan root; the root itself is empty, others stay absolute."""
    p, base = slashes(path), root.replace("\\", "/").rstrip("/")
    return (
        F.when(p == base, F.lit(""))
        .when(p.startswith(base + "/"), F.substr(p, F.lit(len(base) + 2)))
        .otherwise(p)
    )
