"""What the grammars share: expressions by precedence climbing, lists, blocks, recovery."""

from __future__ import annotations

import re

from graphloom.llm.syntax.lexer import END, Lexer


class Bad(Exception):
    def __init__(self, at: int, wanted: str):
        self.at, self.wanted = at, wanted


def flat_pattern(names: str, operators: str, member: str, prefix: str = "", depth: int = 2) -> re.Pattern:
    """A pattern for whole plain expressions: names, literals, members, calls and operators.

    It only shortens the way: an expression that it accepts and that a closing token follows is
    what the climbing parser would accept as well.
    """
    atom = rf'[{names}0"]'
    post = rf"(?:{member}[{names}])"
    for _ in range(depth):
        expr = rf"{prefix}{atom}{post}*+(?:[{operators}]{prefix}{atom}{post}*+)*+"
        items = rf"{expr}(?:,{expr})*+"
        atom = rf'(?:[{names}0"]|\[(?:{items})?\]|\({expr}\))'
        post = rf"(?:{member}[{names}]|\((?:{items})?\)|\[{expr}\])"
    return re.compile(rf"{prefix}{atom}{post}*+(?:[{operators}]{prefix}{atom}{post}*+)*+")


class Grammar:
    """A position goes in, the position behind what was recognised comes out; Bad says what was wanted."""

    lexer: Lexer
    #: Operator codes to binding power.
    POWER: dict[str, int] = {}
    PREFIX = "!-+~u"
    CLOSERS = frozenset(";),]}:" + END)
    ASSIGN = "=a"
    flat: re.Pattern | None = None

    def __init__(self, text: str, codes: str | None = None):
        """codes: those of the text, where they are known already."""
        self.text = text
        self.s = self.lexer.codes(text) if codes is None else codes
        self.errors: list[tuple[int, str]] = []
        #: Where functions begin and end, in grammars that say so.
        self.spans: dict[int, int] = {}

    @classmethod
    def k(cls, *words: str) -> str:
        return "".join(cls.lexer.keywords[w] for w in words)

    # -- helpers
    def want(self, i: int, c: str, what: str | None = None) -> int:
        if self.s[i] != c:
            raise Bad(i, what or c)
        return i + 1

    def listed(self, i: int, item, close: str, trailing: bool = True) -> int:
        """item (, item)* and the closing token."""
        s = self.s
        while s[i] != close:
            i = item(i)
            if s[i] == ",":
                i += 1
                if s[i] == close and not trailing:
                    raise Bad(i, "an item")
            elif s[i] != close:
                raise Bad(i, f"',' or '{close}'")
        return i + 1

    def match(self, i: int) -> int:
        """The place behind the bracket that closes the one at i; the end if there is none."""
        s, depth = self.s, 0
        while s[i] != END:
            if s[i] in "([{":
                depth += 1
            elif s[i] in ")]}":
                depth -= 1
                if not depth:
                    return i + 1
            i += 1
        return i

    # -- expressions
    def expr(self, i: int) -> int:
        m = self.flat.match(self.s, i)
        if m and self.s[m.end()] in self.CLOSERS:
            return m.end()
        return self.assignment(i)

    def assignment(self, i: int) -> int:
        i = self.ternary(i)
        if self.s[i] in self.ASSIGN and self.s[i] != END:
            return self.assignment(i + 1)
        return i

    def ternary(self, i: int) -> int:
        i = self.climb(i, 0)
        if self.s[i] == "?":
            i = self.want(self.assignment(i + 1), ":")
            return self.assignment(i)
        return i

    def climb(self, i: int, least: int) -> int:
        """Precedence climbing: operands and operators of at least the given power."""
        s, power = self.s, self.POWER
        i = self.unary(i)
        while (p := power.get(s[i], -1)) >= least:
            c = s[i]
            i += 1
            if c in "<>" and s[i] == c:  # shifts are lexed as single brackets
                i += 1
                if s[i] == c:
                    i += 1
            i = self.climb(i, p + 1)
        return i

    def unary(self, i: int) -> int:
        s = self.s
        while s[i] in self.PREFIX:
            i += 1
        return self.postfix(self.primary(i))

    def primary(self, i: int) -> int:
        raise NotImplementedError

    def postfix(self, i: int) -> int:
        raise NotImplementedError

    # -- statements with recovery
    def statement(self, i: int) -> int:
        raise NotImplementedError

    def recover(self, i: int) -> int:
        """Panic mode: on to the next place where a statement may begin."""
        s, depth = self.s, 0
        while s[i] != END:
            c = s[i]
            if c in "{":
                depth += 1
            elif c == "}":
                if not depth:
                    return i
                depth -= 1
                if not depth:
                    return i + 1
            elif c == ";" and not depth:
                return i + 1
            i += 1
        return i

    def statements(self, i: int, close: str, one=None) -> int:
        """Statements up to the closing token; each bad one is noted and skipped."""
        s, one = self.s, one or self.statement
        while s[i] != close:
            if s[i] == END:
                raise Bad(i, f"'{close}'")
            before = i
            try:
                i = one(i)
            except Bad as e:
                self.errors.append((e.at, e.wanted))
                if s[e.at] == END:
                    return e.at
                i = self.recover(max(e.at, before))
                if i == before or s[i] != close and i <= before:
                    i = before + 1
        return i

    def block(self, i: int) -> int:
        """{ statements }"""
        i = self.statements(self.want(i, "{"), "}")
        return i + 1 if self.s[i] == "}" else i

    def parse(self) -> list[tuple[int, str]]:
        """All errors as (token, what was wanted); none for an accepted text."""
        i = 0
        while self.s[i] != END:
            try:
                i = self.statements(i, END)
            except Bad as e:
                self.errors.append((e.at, e.wanted))
                i = e.at
                break
            if self.s[i] == "}":
                self.errors.append((i, "a statement"))
                i += 1
        return self.errors

    def placed(self) -> list[tuple[int, int, str]]:
        """Errors as (line, column, message), in order."""
        offsets = self.lexer.offsets(self.text)
        out = []
        for at, wanted in sorted(set(self.errors)):
            o = offsets[min(at, len(offsets) - 1)]
            line = self.text.count("\n", 0, o) + 1
            col = o - (self.text.rfind("\n", 0, o) + 1)
            found = self.text[o : o + 12].split("\n")[0] or "end"
            out.append((line, col, f"{wanted if not any(ord(c) < 32 or ord(c) > 0x2000 for c in wanted) else 'another token'} expected, found {found}"))
        return out
