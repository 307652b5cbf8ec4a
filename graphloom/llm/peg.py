"""Packrat parsing expressions over token codes.

A rule maps a position to (end, captures) or None.  Rules made by ``rule`` or ``Memo`` remember
that per position, so that each is tried once there whatever the choices around it; patterns
over a few codes and brackets, whose ends come from one table per text, need no memory.
Captures are (label, start, end) in tokens, from which the caller gets source offsets.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Result = tuple[int, tuple] | None
Rule = Callable[["Run", int], Result]


class Run:
    """One text being parsed: its codes and what the rules found so far."""

    def __init__(self, codes: str):
        self.s = codes
        self.memo: dict[tuple[int, int], Result] = {}
        self.closing: dict[int, int] | None = None

    def close(self, i: int) -> int:
        """The place behind the bracket that closes the one at i, 0 if there is none."""
        if self.closing is None:
            self.closing = {}
            open_: list[int] = []
            for m in _BRACKETS.finditer(self.s):
                if m[0] in _PAIRS:
                    open_.append(m.start())
                elif open_ and _PAIRS[self.s[open_[-1]]] == m[0]:
                    self.closing[open_.pop()] = m.end()
                else:
                    open_.clear()
        return self.closing.get(i, 0)


# Indentation (codes of the lexers) nests like brackets.
_BRACKETS = re.compile(r"[()\[\]{}\2\3]")
_PAIRS = {"(": ")", "[": "]", "{": "}", "\2": "\3"}


def balanced(opening: str) -> Rule:
    """A bracket of the given kinds with all that it holds."""

    def run(p: Run, i: int) -> Result:
        return (end, ()) if p.s[i] in opening and (end := p.close(i)) else None

    return run


def term(pattern: str) -> Rule:
    """A run of tokens given by a pattern over their codes."""
    match = re.compile(pattern).match

    def run(p: Run, i: int) -> Result:
        m = match(p.s, i)
        return (m.end(), ()) if m else None

    return run


def seq(*parts: Rule) -> Rule:
    def run(p: Run, i: int) -> Result:
        found: tuple = ()
        for part in parts:
            r = part(p, i)
            if r is None:
                return None
            i = r[0]
            if r[1]:
                found += r[1]
        return i, found

    return run


def alt(*choices: Rule) -> Rule:
    def run(p: Run, i: int) -> Result:
        for choice in choices:
            r = choice(p, i)
            if r is not None:
                return r
        return None

    return run


def many(part: Rule, least: int = 0) -> Rule:
    def run(p: Run, i: int) -> Result:
        found: tuple = ()
        n = 0
        while (r := part(p, i)) is not None and r[0] > i:
            i, n = r[0], n + 1
            if r[1]:
                found += r[1]
        return (i, found) if n >= least else None

    return run


def opt(part: Rule) -> Rule:
    def run(p: Run, i: int) -> Result:
        return part(p, i) or (i, ())

    return run


def no(part: Rule) -> Rule:
    def run(p: Run, i: int) -> Result:
        return None if part(p, i) else (i, ())

    return run


def cap(label: str, part: Rule) -> Rule:
    def run(p: Run, i: int) -> Result:
        r = part(p, i)
        return r and (r[0], ((label, i, r[0]), *r[1]))

    return run


class Memo:
    """A rule that may refer to itself: filled with ``is_`` after it is named."""

    def __init__(self):
        self.rule: Rule | None = None

    def is_(self, rule: Rule) -> Memo:
        self.rule = rule
        return self

    def __call__(self, p: Run, i: int) -> Result:
        key = (id(self), i)
        found = p.memo.get(key, self)
        if found is self:
            found = p.memo[key] = self.rule(p, i)
        return found


def rule(*parts: Rule) -> Memo:
    """A sequence that is remembered."""
    return Memo().is_(seq(*parts) if len(parts) > 1 else parts[0])


def scan(declaration: Rule, starts: str) -> Callable[[Run], list[tuple]]:
    """The file as (declaration / any token)*: the captures of the declarations, in order.

    A declaration begins with one of the codes ``starts``; all other places are passed over at
    once.  Declarations may lie in one another.
    """
    first = re.compile(f"[{re.escape(starts)}]")

    def run(p: Run) -> list[tuple]:
        found = (declaration(p, m.start()) for m in first.finditer(p.s))
        return [r[1] for r in found if r is not None]

    return run
