"""The scanner as a table function for SQL: ``SELECT ... FROM files, LATERAL scan_text(text)``.

The function yields one row per match of a whole text, as ``scan_texts`` does.
It runs in Python over Spark's own partitions; an automaton over the needles of
all rules names the rules to try, so a text that holds none costs one pass. Rules
are compiled when a task meets its first text. Rows go pickled in batches: with
Arrow, a table function returns a record batch of its own for every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..functions.arrow_rules import is_name_only
from ..functions.needles import Needles, folded, needles_of
from ..functions.rules import BUILTIN_RULES, GENERIC_RULES, Rule, compiles

COLUMNS = "rule_ord int, rule string, severity string, description string, match string"


def register_scan_function(spark: SparkSession, rules: Sequence[Rule] = BUILTIN_RULES, name: str = "scan_text") -> None:
    """Make the rules available in SQL under ``name``; invalid patterns drop out, as in every scan."""
    held = [(i, r.name, r.regex, r.severity, r.description or "", *needles_of(r)) for i, r in enumerate(rules) if compiles(r.regex)]

    class ScanText:
        def __init__(self):
            self.always = [i for i, *_, needles, _ in held if not needles]
            self.needles = Needles([(i, needles, fold) for i, *_, needles, fold in held if needles])
            self.rules = {i: (n, re.compile(p), s, d) for i, n, p, s, d, *_ in held}

        def eval(self, text: str) -> Iterator[tuple]:
            if text is None:
                return
            found = set(self.always)
            for fold, machine in self.needles.machines:
                for _, numbers in machine.iter(folded(text) if fold else text):
                    found.update(numbers)
            for i in sorted(found):
                rule, pattern, severity, description = self.rules[i]
                for m in pattern.finditer(text):
                    if not (rule in GENERIC_RULES and is_name_only(m[0])):
                        yield i, rule, severity, description, m[0]

    spark.udtf.register(name, udtf(ScanText, returnType=COLUMNS, useArrow=False))
