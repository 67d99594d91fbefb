"""Literals that a pattern cannot match without, and one automaton over all of them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from .rules import Rule

SHORTEST = 2  # a single character would name candidates nearly everywhere

_DOTLESS = str.maketrans({"İ": "i", "ı": "i"})


def folded(text: str) -> str:
    """The text with all letters alike that the JVM's case-blind patterns take for the same."""
    return text.translate(_DOTLESS).casefold()


def _found(nodes: Iterable, fold: bool) -> list[tuple[str, ...]]:
    """Alternatives of literals for each place of a parsed sequence that every match passes."""
    options, run = [], ""
    for op, value in nodes:
        name = str(op)
        if name == "LITERAL":
            run += chr(value)
            continue
        options.append((run,))
        run = ""
        inner = None
        if name == "SUBPATTERN" and not (value[1] | value[2]) & re.I.value:
            inner = _found(value[3], fold)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            inner = _found(value[2], fold)
        elif name == "ATOMIC_GROUP":
            inner = _found(value, fold)
        elif name == "BRANCH":
            each = [_best(_found(branch, fold)) for branch in value[1]]
            inner = [tuple(dict.fromkeys(n for e in each for n in e))] if all(each) else None
        options += inner or []
    return [*options, (run,)]


def _best(options: list[tuple[str, ...]]) -> tuple[str, ...]:
    """The alternatives whose shortest literal is longest; none below ``SHORTEST``."""
    best = max(options, key=lambda o: (min(map(len, o)), -len(o)), default=("",))
    return best if min(map(len, best)) >= SHORTEST else ()


def required_literals(regex: str) -> tuple[tuple[str, ...], bool]:
    """(literals of which every match holds one, whether case is ignored); no literals if none is certain."""
    parsed = re._parser.parse(regex)
    fold = bool(parsed.state.flags & re.I)
    needles = _best(_found(parsed, fold))
    return (tuple(folded(n) for n in needles) if fold else needles), fold


def needles_of(rule: Rule) -> tuple[tuple[str, ...], bool]:
    """The rule's own needles, else those found in its pattern."""
    if rule.needles:
        return (tuple(folded(n) for n in rule.needles) if rule.fold else rule.needles), rule.fold
    return required_literals(rule.regex)


class Needles:
    """Aho-Corasick automata over the needles of numbered rules: one as written, one for folded texts."""

    def __init__(self, rules: Sequence[tuple[int, tuple[str, ...], bool]]):
        import ahocorasick

        self.machines = []
        for fold in (False, True):
            named: dict[str, list[int]] = {}
            for number, needles, folds in rules:
                for needle in needles if folds == fold else ():
                    named.setdefault(needle, []).append(number)
            if named:
                machine = ahocorasick.Automaton()
                for needle, numbers in named.items():
                    machine.add_word(needle, numbers)
                machine.make_automaton()
                self.machines.append((fold, machine))

    def lines(self, text: str) -> list[tuple[int, str, list[int]]]:
        """(line, its text, candidate rules) of every line that holds a needle: one pass over the text."""
        found: dict[int, set[int]] = {}
        for fold, machine in self.machines:
            read = folded(text) if fold else text
            line, seen = 0, 0
            for end, numbers in machine.iter(read):
                line += read.count("\n", seen, end)
                seen = end
                found.setdefault(line, set()).update(numbers)
        if not found:
            return []
        split = text.split("\n")
        return [(i + 1, split[i], sorted(found[i])) for i in sorted(found)]
