"""Boolean trigram queries derived from regular expressions.

A query is a list of clauses; a text can match the expression only if it holds every trigram of at least one clause.
``None`` stands for an expression that allows no such statement, whose rule must read every text. Trigrams are in
lower case, so a query holds for either case of its letters.
"""

from __future__ import annotations

from re import _constants as op
from re import _parser as parser

#: more strings than this in one run are no longer told apart
MAX_STRINGS = 64
#: a character class of more letters than this is not spelled out
MAX_LETTERS = 8

Clauses = list[frozenset[str]]


def _class_letters(items: list) -> set[str] | None:
    """The letters of a character class, if they are few."""
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < MAX_LETTERS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= MAX_LETTERS else None


def _strings(nodes) -> set[str] | None:
    """All strings a sequence of nodes can match, or None if they are not few."""
    found = {""}
    for kind, value in nodes:
        if kind is op.LITERAL:
            step: set[str] | None = {chr(value).lower()}
        elif kind is op.IN:
            step = _class_letters(value)
        elif kind is op.BRANCH:
            parts = [_strings(branch) for branch in value[1]]
            step = None if None in parts else set().union(*parts)
        elif kind is op.SUBPATTERN:
            step = _strings(value[-1])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] <= 4:
            one, step = _strings(value[2]), None
            if one is not None:
                step, power = ({""} if value[0] == 0 else set()), {""}
                for n in range(1, value[1] + 1):
                    power = {a + b for a in power for b in one}
                    step |= power if n >= value[0] else set()
        elif kind is op.AT:
            step = {""}
        else:
            step = None
        if step is None or len(found) * len(step) > MAX_STRINGS:
            return None
        found = {a + b for a in found for b in step}
    return found


def _both(a: Clauses | None, b: Clauses | None) -> Clauses | None:
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > MAX_STRINGS:
        return a
    return _least([x | y for x in a for y in b])


def _least(clauses: Clauses) -> Clauses:
    """Without the clauses that another one implies."""
    unique = set(clauses)
    return sorted((c for c in unique if not any(d < c for d in unique)), key=sorted)


def _of_strings(strings: set[str]) -> Clauses | None:
    clauses = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
    return None if not all(clauses) else _least(clauses)


def _of_nodes(nodes) -> Clauses | None:
    query: Clauses | None = None
    run: list = []

    def flush() -> None:
        nonlocal query, run
        while run:  # the longest head of the run whose strings are few
            n = next((n for n in range(len(run), 0, -1) if _strings(run[:n]) is not None), 1)
            known = _strings(run[:n])
            query, run = _both(query, _of_strings(known) if known else None), run[n:]

    for node in nodes:
        kind, value = node
        if _strings([node]) is not None:
            run.append(node)
            continue
        flush()
        if kind is op.SUBPATTERN:
            query = _both(query, _of_nodes(value[-1]))
        elif kind is op.BRANCH:
            parts = [_of_nodes(branch) for branch in value[1]]
            if None not in parts:
                query = _both(query, _least([c for part in parts for c in part]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            query = _both(query, _of_nodes(value[2]))
    flush()
    return query


def trigram_query(pattern: str) -> Clauses | None:
    """The Boolean trigram query of a regular expression, as an OR of ANDs."""
    return _of_nodes(parser.parse(pattern))
