"""Match expressions: find, locate and filter rule matches inside a text column.

Expressions over a whole rule list are written as SQL text and take the name of
the text column: one parsed expression instead of thousands of column calls.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let, sums_before
from .rules import GENERIC_RULES, Rule, is_context_free, is_position_free, java_regex

NumberedRules = Sequence[tuple[int, Rule]]

# Shapes of a quoted value that is a variable name, not a secret.
UPPER_NAME = r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$"
LOWER_NAME = r"^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$"
QUOTED_VALUE = r"['\"]([^'\"]+)['\"]"


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any(tests: Iterable[str]) -> str:
    return "(" + (" OR ".join(tests) or "false") + ")"


def is_variable_name(match: Column) -> Column:
    """Whether the first quoted value of a match is only an identifier."""
    value = F.regexp_extract(match, QUOTED_VALUE, 1)
    return value.rlike(UPPER_NAME) | value.rlike(LOWER_NAME)


_IS_VARIABLE_NAME = (
    f"(regexp_extract(m, {literal(QUOTED_VALUE)}, 1) RLIKE {literal(UPPER_NAME)} OR "
    f"regexp_extract(m, {literal(QUOTED_VALUE)}, 1) RLIKE {literal(LOWER_NAME)})"
)

# Characters rare in prose: one search for them stands in front of every needle
# that contains them.
_RARE = ("_", "://")


def _contains(text: str, needles: Iterable[str]) -> str:
    return _any(f"contains({text}, {literal(n)})" for n in needles)


def _needle_tests(text: str, rules: Sequence[Rule]) -> list[str]:
    plain = list(dict.fromkeys(n for r in rules if not r.fold for n in r.needles))
    tests = []
    for mark in _RARE:
        group = [n for n in plain if mark in n]
        if len(group) > 1:
            tests.append(f"({_contains(text, [mark])} AND {_contains(text, group)})")
            plain = [n for n in plain if n not in group]
    tests += [_contains(text, [n]) for n in plain]
    gates: dict[tuple[str, ...], list[str]] = {}
    for r in rules:
        if r.fold and r.needles:
            gates.setdefault(r.gate, []).extend(r.needles)
    for gate, needles in gates.items():
        # Unicode case folding, as the rule itself folds.
        folded = f"{text} RLIKE {literal('(?iU)' + '|'.join(dict.fromkeys(needles)))}"
        tests.append(f"({_contains(text, gate)} AND {folded})" if gate else folded)
    return tests


def _rlike(text: str, rule: Rule) -> str:
    return f"{text} RLIKE {literal(java_regex(rule.regex))}"


def _line_test(text: str, rules: NumberedRules) -> str:
    tests = _needle_tests(text, [r for _, r in rules])
    return _any(tests + [_rlike(text, r) for _, r in rules if not r.needles])


def line_may_match(text: str, rules: NumberedRules) -> Column:
    """Pre-test for one line: true whenever some rule matches the line."""
    return F.expr(_line_test(text, rules))


def text_may_match(text: str, rules: NumberedRules) -> Column:
    """Pre-test for a whole text: true whenever some rule matches one of its lines.

    Rules with needles need only the needle. A rule without needles is tried on
    the whole text when that is safe; when it is not, no text can be skipped.
    """
    if any(not r.needles and not is_context_free(r.regex) for _, r in rules):
        return F.lit(True)
    return line_may_match(text, rules)


def _fires(text: str, rule: Rule) -> str:
    """Whether the rule's pattern occurs at all (variable names still included)."""
    needles = _any(_needle_tests(text, [rule])) + " AND " if rule.needles else ""
    return f"({needles}{_rlike(text, rule)})"


def _matches(text: str, rule: Rule) -> str:
    """All matches, variable names dropped where the rule is generic."""
    found = f"regexp_extract_all({text}, {literal(java_regex(rule.regex))}, 0)"
    return f"filter({found}, m -> NOT {_IS_VARIABLE_NAME})" if rule.name in GENERIC_RULES else found


def _holds(text: str, rule: Rule) -> str:
    if rule.name in GENERIC_RULES:
        return f"({_fires(text, rule)} AND size({_matches(text, rule)}) > 0)"
    return _fires(text, rule)


# Rules per array of the plan; long lists become more arrays, not another engine.
GROUP = 25


def firing_rules(text: str, rules: NumberedRules) -> Column:
    """Array of the numbers of all rules that occur in the text.

    Every pattern is a literal here, so each is compiled once per task. What
    needs more than a yes or no then works on (text, rule) rows, of which there
    are few, with the pattern looked up by :func:`rule_pattern`.
    """
    cases = [f"CASE WHEN {_fires(text, r)} THEN {i} END" for i, r in rules]
    groups = [", ".join(cases[k : k + GROUP]) for k in range(0, len(cases), GROUP)]
    return F.expr(f"concat({', '.join(f'array_compact(array({g}))' for g in groups)})")


def has_matches(text: str, rules: NumberedRules) -> Column:
    """Whether any rule matches the text once variable names are set aside."""
    return F.expr(f"{_line_test(text, rules)} AND {_any(_holds(text, r) for _, r in rules)}")


def matched_names(text: str, rules: NumberedRules) -> Column:
    """Array of the names of all rules that match the text, in rule order; NULL for none."""
    if not rules:
        return F.lit(None).cast("array<string>")
    cases = ", ".join(f"CASE WHEN {_holds(text, r)} THEN {literal(r.name)} END" for _, r in rules)
    return F.expr(f"CASE WHEN {_line_test(text, rules)} THEN array_distinct(array_compact(array({cases}))) END")


def match_count(text: str, rules: NumberedRules) -> Column:
    """Number of matches of all rules over the whole text."""
    counts = [f"CASE WHEN {_fires(text, r)} THEN size({_matches(text, r)}) ELSE 0 END" for _, r in rules]
    return F.expr(" + ".join(counts) or "0")


def _lookup(ordinal: str, values: Iterable[tuple[int, str]]) -> Column:
    pairs = ", ".join(f"{i}, {literal(v)}" for i, v in values)
    return F.expr(f"element_at(map({pairs}), {ordinal})")


def rule_pattern(ordinal: str, rules: NumberedRules) -> Column:
    return _lookup(ordinal, [(i, java_regex(r.regex)) for i, r in rules])


def rule_value(ordinal: str, rules: NumberedRules, attribute: str) -> Column:
    """An attribute of the rule with the given number."""
    return _lookup(ordinal, [(i, getattr(r, attribute) or "") for i, r in rules])


def is_false_positive(ordinal: str, match: str, rules: NumberedRules) -> Column:
    """Whether a match of a generic rule is only a variable name."""
    generic = [i for i, r in rules if r.name in GENERIC_RULES]
    return F.col(ordinal).isin(*generic) & is_variable_name(F.col(match)) if generic else F.lit(False)


def finds_first_copy(ordinal: str, rules: NumberedRules) -> Column:
    """Whether the rule's first match is the first copy of its own text: the pattern looks at nothing else."""
    free = [i for i, r in rules if is_position_free(r.regex)]
    return F.col(ordinal).isin(*free) if free else F.lit(False)


def located(text: Column, pattern: Column, first_copy: Column | None = None) -> Column:
    """Array of (column, match) of one pattern in one line, from the gaps between matches.

    Where ``first_copy`` holds (:func:`finds_first_copy`), a match that is alone on
    its line is looked up as a text, which compiles no pattern.
    """
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    if first_copy is None:
        return _from_gaps(text, pattern, found)

    def places(m: Column) -> Column:
        alone = F.array(F.struct(F.instr(text, F.get(m, F.lit(0))).cast("int").alias("column"), F.get(m, F.lit(0)).alias("match")))
        return F.when(first_copy & (F.size(m) == 1), alone).otherwise(_from_gaps(text, pattern, m))

    return let(found, places)


def _from_gaps(text: Column, pattern: Column, found: Column) -> Column:
    parts = F.struct(found.alias("m"), F.transform(F.split(text, pattern, -1), F.length).alias("gap"))

    def positions(p: Column) -> Column:
        # step[i] = characters from the start of gap i to the end of match i
        step = F.zip_with(p["gap"], p["m"], lambda g, m: g + F.coalesce(F.length(m), F.lit(0)))

        def hit(before: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                return F.struct((F.get(before, i) + F.get(p["gap"], i) + 1).cast("int").alias("column"), m.alias("match"))

            return F.transform(p["m"], one)

        return let(step, lambda s: let(sums_before(s), hit))

    return let(parts, positions)


def pattern_table(rules: NumberedRules) -> Column:
    """Array of (pattern, needles, generic) structs; folded rules show their gate as needles."""
    rows = []
    for _, r in rules:
        needles = ", ".join(literal(n) for n in (r.gate if r.fold else r.needles))
        rows.append(
            f"named_struct('pattern', {literal(java_regex(r.regex))}, 'needles', "
            f"CAST(array({needles}) AS array<string>), 'generic', {str(r.name in GENERIC_RULES).lower()})"
        )
    return F.expr(f"array({', '.join(rows)})")
