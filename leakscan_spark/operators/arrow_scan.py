"""Arrow matcher for rules Spark's regex functions cannot run exactly.

Used for patterns in Python-only dialect and for patterns that can match the
empty string. Spark partitions the rows; each task compiles the patterns once
and works through Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.arrow_rules import is_name_only
from ..functions.rules import GENERIC_RULES, Rule

_HIT = T.StructType(
    [
        T.StructField("rule_ord", T.IntegerType()),
        T.StructField("column", T.IntegerType()),
        T.StructField("match", T.StringType()),
    ]
)


def _hits(text: str, compiled, placed: bool) -> list[tuple]:
    out = []
    for ordinal, pattern, generic in compiled:
        for m in pattern.finditer(text):
            if generic and is_name_only(m[0]):
                continue
            out.append((ordinal, m.start() + 1 if placed else None, m[0]))
    return out


def _run(df: DataFrame, rules: Sequence[tuple[int, Rule]], placed: bool) -> DataFrame:
    specs = [(i, r.regex, r.name in GENERIC_RULES) for i, r in rules]
    kept = [f for f in df.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, *_HIT.fields])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(i, re.compile(p), g) for i, p, g in specs]
        for batch in batches:
            batch = batch[batch["text"].notna()].copy()
            batch["hit"] = [_hits(t, compiled, placed) for t in batch["text"]]
            batch = batch.drop(columns="text").explode("hit", ignore_index=True)
            batch = batch[batch["hit"].notna()].reset_index(drop=True)
            hits = pd.DataFrame(batch.pop("hit").tolist(), columns=_HIT.fieldNames())
            yield pd.concat([batch, hits], axis=1)

    return df.mapInPandas(task, schema)


def arrow_located(lines: DataFrame, rules: Sequence[tuple[int, Rule]]) -> DataFrame:
    """(..., rule_ord, column, match) rows for a (..., text) table of single lines."""
    return _run(lines, rules, placed=True)


def arrow_unplaced(texts: DataFrame, rules: Sequence[tuple[int, Rule]]) -> DataFrame:
    """The same with column NULL for a (..., text) table of whole texts."""
    return _run(texts, rules, placed=False)
