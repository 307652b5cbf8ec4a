"""PHP."""

from __future__ import annotations

import re

from graphloom.llm.syntax.base import Bad, Grammar, flat_pattern
from graphloom.llm.syntax.lexer import END, PHP

K = PHP.keywords


def _k(words: str) -> str:
    return "".join(K[w] for w in words.split())


NAMES = "i" + _k("enddeclare readonly match")
TYPES = NAMES + _k("array callable static")
MODIFIERS = _k("public private protected static abstract final readonly var")
LANGUAGE = _k("print include include_once require require_once clone throw")
_OPEN = re.compile(r"<\?(?:php\b|=)")


class Php(Grammar):
    lexer = PHP
    POWER = {K["or"]: 0, K["xor"]: 0, K["and"]: 0, "b": 3, "|": 3, "&": 3, "^": 3, "<": 4, ">": 4, K["instanceof"]: 6, "+": 5, "-": 5, ".": 5, "*": 6, "/": 6, "%": 6}
    PREFIX = "!-+~u@&" + LANGUAGE
    flat = flat_pattern("iv", r"b+\-*/%<>.", r"r")

    def __init__(self, text: str, codes: str | None = None):
        m = _OPEN.search(text)
        self.skipped = m.end() if m else len(text)
        self.whole = text
        super().__init__(text[self.skipped :], codes)  # what is before the tag is plain output

    def placed(self) -> list[tuple[int, int, str]]:
        lines = self.whole.count("\n", 0, self.skipped)
        return [(line + lines, col, message) for line, col, message in super().placed()]

    # -- expressions
    def ternary(self, i: int) -> int:
        s = self.s
        i = self.climb(i, 0)
        while s[i] == "?":
            if s[i + 1] == ":":
                i = self.climb(i + 2, 0)
            else:
                i = self.assignment(self.want(self.assignment(i + 1), ":"))
        return i

    def assignment(self, i: int) -> int:
        s = self.s
        i = self.ternary(i)
        if s[i] in "=a":
            return self.assignment(i + 2 if s[i + 1] == "&" else i + 1)
        if s[i] == ">" and s[i + 1] in ">a":
            return self.assignment(i + 2)
        return i

    def climb(self, i: int, least: int) -> int:
        s, power = self.s, self.POWER
        i = self.unary(i)
        while True:
            if s[i] in "=a" and s[i] != END and self.assigned(i):
                i = self.climb(i + 2 if s[i + 1] == "&" else i + 1, 0)
            p = power.get(s[i], -1)
            if p < least:
                return i
            c = s[i]
            i += 1
            while c in "<>" and s[i] == c:
                i += 1
            i = self.climb(i, p + 1)

    def assigned(self, i: int) -> bool:
        return self.s[i - 1] in "v]}i)"

    def unary(self, i: int) -> int:
        s = self.s
        while s[i] in self.PREFIX:
            i += 1
        if s[i] == "(" and s[i + 1] in NAMES + K["array"] and s[i + 2] == ")" and s[i + 3] in 'v0"(i![' + K["new"]:
            return self.unary(i + 3)  # a cast
        return self.postfix(self.primary(i))

    def primary(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in 'v0"':
            return i + 1
        if c == K["match"] and s[i + 1] == "(":
            return self.match_(i + 1)
        if c in NAMES:
            return i + 1
        if c == "(":
            return self.want(self.expr(i + 1), ")")
        if c == "[":
            return self.listed(i + 1, self.item, "]")
        if c in (K["array"], K["list"], K["isset"], K["empty"], K["unset"], K["exit"] if "exit" in K else "\2"):
            if s[i + 1] != "(":
                raise Bad(i + 1, "'('")
            return self.listed(i + 2, self.item, ")")
        if c == K["new"]:
            return self.new(i + 1)
        if c in (K["function"], K["fn"]) or c == K["static"] and s[i + 1] in (K["function"], K["fn"]):
            return self.closure(i + 1 if c == K["static"] else i)
        if c == K["static"] and s[i + 1] == "c":
            return i + 1
        if c == K["yield"]:
            i += 1
            if s[i] in ";),]":
                return i
            if s[i] in NAMES and s[i + 1] in "v[i(":
                i += 1
            i = self.ternary(i)
            return self.ternary(i + 1) if s[i] == "f" else i
        if c == "#" and s[i + 1] == "[":
            return self.primary(self.attributes(i))
        raise Bad(i, "an expression")

    def item(self, i: int) -> int:
        s = self.s
        if s[i] == ",":
            return i
        if s[i] == "e" or s[i] == "&":
            return self.expr(i + 1)
        i = self.expr(i)
        return self.expr(i + 2 if s[i + 1] == "&" else i + 1) if s[i] == "f" else i

    def argument(self, i: int) -> int:
        s = self.s
        if s[i] == "e":
            return i + 1 if s[i + 1] == ")" else self.expr(i + 1)
        if (s[i] in NAMES or s[i] >= "一") and s[i + 1] == ":":
            i += 2
        return self.expr(i)

    def new(self, i: int) -> int:
        s = self.s
        if s[i] == K["class"]:
            i += 1
            if s[i] == "(":
                i = self.listed(i + 1, self.argument, ")")
            return self.class_tail(i)
        if s[i] in NAMES + "v" + K["static"]:
            i += 1
            while s[i] in "rc" and s[i + 1] in "vi":
                i += 2
        elif s[i] == "(":
            i = self.want(self.expr(i + 1), ")")
        else:
            raise Bad(i, "a class")
        return self.listed(i + 1, self.argument, ")") if s[i] == "(" else i

    def postfix(self, i: int) -> int:
        s = self.s
        while True:
            c = s[i]
            if c in "rq":
                i += 1
                if s[i] in NAMES + "v" or s[i] >= "一":
                    i += 1
                elif s[i] == "{":
                    i = self.want(self.expr(i + 1), "}")
                else:
                    raise Bad(i, "a name")
            elif c == "c":
                i += 1
                if s[i] in NAMES + "v" or s[i] >= "一":
                    i += 1
                else:
                    raise Bad(i, "a name")
            elif c == "(":
                i = self.listed(i + 1, self.argument, ")")
            elif c == "[":
                i = i + 2 if s[i + 1] == "]" else self.want(self.expr(i + 1), "]")
            elif c == "u":
                i += 1
            else:
                return i

    def match_(self, i: int) -> int:
        s = self.s
        i = self.want(self.condition(i), "{")
        while s[i] != "}":
            if s[i] == K["default"]:
                i += 1
            else:
                i = self.expr(i)
                while s[i] == "," and s[i + 1] != "f":
                    i = self.expr(i + 1)
            i = self.expr(self.want(i, "f"))
            if s[i] == ",":
                i += 1
            elif s[i] != "}":
                raise Bad(i, "'}'")
        return i + 1

    def closure(self, i: int) -> int:
        s = self.s
        arrow = s[i] == K["fn"]
        i += 1
        if s[i] == "&":
            i += 1
        i = self.parameters(i)
        if s[i] == K["use"]:
            i = self.listed(self.want(i + 1, "("), self.used, ")")
        if s[i] == ":":
            i = self.type(i + 1)
        return self.expr(self.want(i, "f")) if arrow else self.block(i)

    def used(self, i: int) -> int:
        return self.want(i + 1 if self.s[i] == "&" else i, "v", "a variable")

    # -- declarations
    def type(self, i: int) -> int:
        s = self.s
        if s[i] == "?":
            i += 1
        while True:
            if s[i] == "(":
                i = self.want(self.type(i + 1), ")")
            elif s[i] in TYPES:
                i += 1
            else:
                raise Bad(i, "a type")
            if s[i] == "|" or s[i] == "&" and s[i + 1] in TYPES + "(":
                i += 1
            else:
                return i

    def attributes(self, i: int) -> int:
        while self.s[i] == "#" and self.s[i + 1] == "[":
            i = self.match(i + 1)
        return i

    def parameters(self, i: int) -> int:
        return self.listed(self.want(i, "("), self.parameter, ")")

    def parameter(self, i: int) -> int:
        s = self.s
        i = self.attributes(i)
        while s[i] in MODIFIERS:
            i += 1
        if s[i] not in "ve&":
            i = self.type(i)
        if s[i] == "&":
            i += 1
        if s[i] == "e":
            i += 1
        i = self.want(i, "v", "a variable")
        return self.expr(i + 1) if s[i] == "=" else i

    def function(self, i: int, bodyless: bool = False) -> int:
        s = self.s
        i += 1
        if s[i] == "&":
            i += 1
        if s[i] not in NAMES and not (bodyless and s[i] >= "一"):
            raise Bad(i, "a name")
        i = self.parameters(i + 1)
        if s[i] == ":":
            i = self.type(i + 1)
        if bodyless and s[i] == ";":
            return i + 1
        return self.block(i)

    def class_(self, i: int) -> int:
        """From class, interface, trait or enum on."""
        s = self.s
        i += 1
        if s[i] not in NAMES:
            raise Bad(i, "a name")
        i += 1
        if s[i] == ":":
            i = self.type(i + 1)
        return self.class_tail(i)

    def class_tail(self, i: int) -> int:
        s = self.s
        while s[i] in (K["extends"], K["implements"]):
            i += 1
            while True:
                if s[i] not in NAMES:
                    raise Bad(i, "a name")
                i += 1
                if s[i] != ",":
                    break
                i += 1
        i = self.statements(self.want(i, "{"), "}", self.member)
        return i + 1 if s[i] == "}" else i

    def member(self, i: int) -> int:
        s = self.s
        i = self.attributes(i)
        if s[i] == K["use"]:
            i += 1
            while s[i] in NAMES + ",":
                i += 1
            return self.match(i) if s[i] == "{" else self.want(i, ";")
        if s[i] == K["case"]:
            i = self.want(i + 1, "i", "a name")
            return self.want(self.expr(i + 1) if s[i] == "=" else i, ";")
        start = i
        while s[i] in MODIFIERS:
            i += 1
        if s[i] == K["function"]:
            return self.function(i, bodyless=True)
        if s[i] == K["const"]:
            i += 1
            if s[i + 1] in NAMES or s[i + 1] >= "一":
                i = self.type(i)
            while True:
                i = self.expr(self.want(i + 1, "="))
                if s[i] != ",":
                    return self.want(i, ";")
                i += 1
        if i == start:
            raise Bad(i, "a member")
        if s[i] != "v":
            i = self.type(i)
        while True:
            i = self.want(i, "v", "a variable")
            if s[i] == "=":
                i = self.expr(i + 1)
            if s[i] != ",":
                return self.want(i, ";")
            i += 1

    # -- statements
    def condition(self, i: int) -> int:
        return self.want(self.expr(self.want(i, "(")), ")")

    def body(self, i: int, *ends: str) -> int:
        """A statement, or after a colon statements up to one of the closing words."""
        s = self.s
        if s[i] != ":":
            return self.statement(i)
        i += 1
        closing = _k(" ".join(ends))
        while s[i] not in closing:
            if s[i] == END:
                raise Bad(i, ends[-1])
            i = self.statement(i)
        if s[i] in _k("else elseif"):
            return i
        return self.want(i + 1, ";")

    def statement(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == "v":
            return self.want(self.expr(i), ";")
        if c == "{":
            return self.block(i)
        if c == K["return"]:
            return i + 2 if s[i + 1] == ";" else self.want(self.expr(i + 1), ";")
        if c == K["if"] or c == K["elseif"]:
            i = self.body(self.condition(i + 1), "elseif", "else", "endif")
            if s[i] == K["elseif"]:
                return self.statement(i)
            return self.body(i + 1, "endif") if s[i] == K["else"] else i
        if c == K["foreach"]:
            i = self.want(self.expr(self.want(i + 1, "(")), K["as"], "as")
            i = self.unary(i)
            if s[i] == "f":
                i = self.unary(i + 1)
            return self.body(self.want(i, ")"), "endforeach")
        if c == K["for"]:
            i = self.want(i + 1, "(")
            for close in ";;)":
                while s[i] != close:
                    i = self.expr(i)
                    if s[i] == ",":
                        i += 1
                    elif s[i] != close:
                        raise Bad(i, f"'{close}'")
                i += 1
            return self.body(i, "endfor")
        if c == K["while"]:
            return self.body(self.condition(i + 1), "endwhile")
        if c == K["do"]:
            i = self.want(self.statement(i + 1), K["while"], "while")
            return self.want(self.condition(i), ";")
        if c == K["switch"]:
            return self.switch(i + 1)
        if c == K["try"]:
            return self.try_(i + 1)
        if c == ";":
            return i + 1
        if c == K["function"] and (s[i + 1] in NAMES or s[i + 1] == "&" and s[i + 2] in NAMES):
            return self.function(i)
        if c == "#":
            return self.statement(self.attributes(i))
        if c in _k("class abstract final interface trait") or c == K["readonly"] and s[i + 1] in _k("class final") or c in NAMES and s[i + 1] in NAMES and s[i + 2] in "{:" + K["implements"]:
            while s[i] in _k("abstract final readonly"):
                i += 1
            if s[i] not in _k("class interface trait") + NAMES:
                raise Bad(i, "class")
            return self.class_(i)
        if c == K["namespace"]:
            i += 1
            if s[i] in NAMES:
                i += 1
            return self.block(i) if s[i] == "{" else self.want(i, ";")
        if c == K["use"]:
            return self.want(self.use(i + 1), ";")
        if c == K["const"]:
            i += 1
            while True:
                i = self.expr(self.want(self.want(i, "i", "a name"), "="))
                if s[i] != ",":
                    return self.want(i, ";")
                i += 1
        if c in (K["echo"], K["global"]) or c == K["static"] and s[i + 1] == "v":
            i = self.expr(i + 1)
            while s[i] == ",":
                i = self.expr(i + 1)
            return self.want(i, ";")
        if c in (K["break"], K["continue"]):
            return self.want(i + 2 if s[i + 1] == "0" else i + 1, ";")
        if c == K["goto"]:
            return self.want(i + 2, ";")
        if c == K["declare"]:
            i = self.listed(self.want(i + 1, "("), self.expr, ")")
            return i + 1 if s[i] == ";" else self.block(i)
        if c in NAMES and s[i + 1] == ":":
            return i + 2
        return self.want(self.expr(i), ";")

    def use(self, i: int) -> int:
        s = self.s
        if s[i] in _k("function const"):
            i += 1
        while True:
            if s[i] not in NAMES and s[i] != "\\":
                raise Bad(i, "a name")
            i += 1
            if s[i] == "\\":
                i += 1
            if s[i] == "{":
                i = self.listed(i + 1, self.use, "}")
            if s[i] == K["as"]:
                i = self.want(i + 1, "i", "a name")
            if s[i] != "," or s[i + 1] == "}":
                return i
            i += 1

    def try_(self, i: int) -> int:
        s = self.s
        i = self.block(i)
        ok = False
        while s[i] == K["catch"]:
            i = self.type(self.want(i + 1, "("))
            if s[i] == "v":
                i += 1
            i = self.block(self.want(i, ")"))
            ok = True
        if s[i] == K["finally"]:
            return self.block(i + 1)
        if not ok:
            raise Bad(i, "catch")
        return i

    def switch(self, i: int) -> int:
        s = self.s
        i = self.want(self.condition(i), "{")
        while s[i] != "}":
            if s[i] == K["default"]:
                i += 1
            else:
                i = self.expr(self.want(i, K["case"], "case"))
            if s[i] not in ":;":
                raise Bad(i, "':'")
            i += 1
            while s[i] not in (K["case"], K["default"], "}"):
                if s[i] == END:
                    raise Bad(i, "'}'")
                i = self.statement(i)
        return i + 1
