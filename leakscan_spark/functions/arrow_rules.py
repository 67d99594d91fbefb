"""Arrow forms of the rule expressions, for rules the JVM's dialect cannot run.

Small helpers per text; Spark hands them Arrow batches of its own partitions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .matching import LOWER_NAME, QUOTED_VALUE, UPPER_NAME
from .rules import GENERIC_RULES, Rule, compiles


def is_name_only(match: str) -> bool:
    """Whether the first quoted value is an identifier."""
    quoted = re.search(QUOTED_VALUE, match)
    return bool(quoted and (re.match(UPPER_NAME, quoted[1]) or re.match(LOWER_NAME, quoted[1])))


def hit_names(text: Column, rules: Sequence[tuple[int, Rule]]) -> Column:
    """Array with the rule name of every match over a whole text."""
    specs = [(r.name, r.regex, r.name in GENERIC_RULES) for _, r in rules]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def names(texts: pd.Series) -> pd.Series:
        compiled = [(n, re.compile(p), g) for n, p, g in specs]

        def one(t):
            return [n for n, p, g in compiled for m in p.finditer(t or "") if not (g and is_name_only(m[0]))]

        return texts.map(one)

    return names(text)


def redacted_in_order(text: Column, rules: Sequence[tuple[int, Rule]]) -> Column:
    """Every rule's matches hidden, each rule over the result of the one before."""
    specs = [(r.regex, r.name in GENERIC_RULES) for _, r in rules if compiles(r.regex)]

    def hide(m: str) -> str:
        return "*" * len(m) if len(m) <= 8 else m[:4] + "*" * (len(m) - 8) + m[-4:]

    @F.pandas_udf(T.StringType())
    def redact(texts: pd.Series) -> pd.Series:
        for pattern, generic in ((re.compile(p), g) for p, g in specs):
            swap = lambda m, g=generic: m[0] if g and is_name_only(m[0]) else hide(m[0])
            texts = texts.map(lambda t, p=pattern, s=swap: t if t is None else p.sub(s, t))
        return texts

    return redact(text)
