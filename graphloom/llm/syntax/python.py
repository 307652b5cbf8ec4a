"""Python."""

from __future__ import annotations

from graphloom.llm.syntax.base import Bad, Grammar, flat_pattern
from graphloom.llm.syntax.lexer import BAD, DEDENT, END, INDENT, PYTHON

K = PYTHON.keywords
NAMES = "i" + PYTHON.soft


def _k(words: str) -> str:
    return "".join(K[w] for w in words.split())


CONSTANTS = _k("True False None")
COMPARE = {"<", ">", K["in"], K["is"], K["not"]}


class Python(Grammar):
    lexer = PYTHON
    POWER = {K["or"]: 1, K["and"]: 2, "b": 4, "<": 4, ">": 4, K["in"]: 4, K["is"]: 4, "|": 5, "^": 6, "&": 7, "+": 8, "-": 8, "*": 9, "/": 9, "%": 9, "@": 9}
    PREFIX = "-+~" + _k("not await")
    CLOSERS = frozenset("N),]}:=a;")
    flat = flat_pattern(NAMES, r"b+\-*/%<>", r"\.")

    def expr(self, i: int) -> int:
        m = self.flat.match(self.s, i)
        if m and self.s[m.end()] in self.CLOSERS:
            return m.end()
        return self.ternary(i)

    def ternary(self, i: int) -> int:
        s = self.s
        if s[i] == K["lambda"]:
            i += 1
            while s[i] != ":":
                i = self.parameter(i, annotated=False)
                if s[i] == ",":
                    i += 1
                elif s[i] != ":":
                    raise Bad(i, "':'")
            return self.ternary(i + 1)
        i = self.climb(i, 0)
        if s[i] == K["if"]:
            i = self.want(self.climb(i + 1, 0), K["else"], "else")
            return self.ternary(i)
        return i

    def climb(self, i: int, least: int) -> int:
        s, power = self.s, self.POWER
        i = self.unary(i)
        while True:
            c = s[i]
            if c == K["not"] and s[i + 1] == K["in"]:
                c = K["in"]
                i += 1
            p = power.get(c, -1)
            if p < least:
                return i
            i += 1
            if c == K["is"] and s[i] == K["not"] or c == ">" and s[i] == ">":
                i += 1
            i = self.climb(i, p + 1)

    def primary(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in NAMES or c == "0" or c in CONSTANTS:
            return i + 1
        if c == '"':
            while s[i] == '"':
                i += 1
            return i
        if c == "(":
            if s[i + 1] == ")":
                return i + 2
            if s[i + 1] == K["yield"]:
                return self.want(self.yield_(i + 1), ")")
            return self.items(i + 1, ")")
        if c == "[":
            return self.items(i + 1, "]") if s[i + 1] != "]" else i + 2
        if c == "{":
            return self.braces(i + 1)
        if c == "e" and self.lexer_text(i) == "...":
            return i + 1
        raise Bad(i, "an expression")

    def lexer_text(self, i: int) -> str:
        o = self.lexer.offsets(self.text)[i]
        return self.text[o : o + 3]

    def element(self, i: int) -> int:
        s = self.s
        if s[i] == "*":
            return self.climb(i + 1, 5)
        i = self.expr(i)
        if s[i] == "w":
            i = self.expr(i + 1)
        return i

    def comprehension(self, i: int) -> int:
        s = self.s
        while s[i] in (K["for"], K["async"]):
            if s[i] == K["async"]:
                i += 1
            i = self.want(self.targets(i + 1), K["in"], "in")
            i = self.climb(i, 0)
            while s[i] == K["if"]:
                i = self.climb(i + 1, 0)
                if s[i] == "w":
                    i = self.climb(i + 1, 0)
        return i

    def items(self, i: int, close: str) -> int:
        s = self.s
        i = self.element(i)
        if s[i] in (K["for"], K["async"]):
            return self.want(self.comprehension(i), close)
        while s[i] == ",":
            i += 1
            if s[i] == close:
                break
            i = self.element(i)
        return self.want(i, close)

    def braces(self, i: int) -> int:
        s = self.s
        first = True
        while s[i] != "}":
            if s[i] == "b" and self.lexer_text(i)[:2] == "**":
                i = self.climb(i + 1, 5)
            else:
                i = self.element(i)
                if s[i] == ":":
                    i = self.expr(i + 1)
            if first and s[i] in (K["for"], K["async"]):
                return self.want(self.comprehension(i), "}")
            first = False
            if s[i] == ",":
                i += 1
            elif s[i] != "}":
                raise Bad(i, "'}'")
        return i + 1

    def postfix(self, i: int) -> int:
        s = self.s
        while True:
            c = s[i]
            if c == ".":
                if s[i + 1] not in NAMES:
                    raise Bad(i + 1, "a name")
                i += 2
            elif c == "(":
                i += 1
                while s[i] != ")":
                    i = self.argument(i)
                    if s[i] == ",":
                        i += 1
                    elif s[i] != ")":
                        raise Bad(i, "')'")
                i += 1
            elif c == "[":
                i += 1
                while True:
                    i = self.subscript(i)
                    if s[i] == "]":
                        break
                    i = self.want(i, ",", "']'")
                    if s[i] == "]":
                        break
                i += 1
            elif c == "b" and self.is_power(i):
                i = self.unary(i + 1)
            else:
                return i

    def is_power(self, i: int) -> bool:
        return False  # ** is among the binary operators of the table; acceptance is the same

    def argument(self, i: int) -> int:
        s = self.s
        if s[i] == "b":
            return self.expr(i + 1)
        if s[i] in NAMES and s[i + 1] == "=":
            return self.expr(i + 2)
        i = self.element(i)
        return self.comprehension(i)

    def subscript(self, i: int) -> int:
        s = self.s
        if s[i] != ":":
            i = self.element(i)
        for _ in range(2):
            if s[i] == ":":
                i += 1
                if s[i] not in ":],":
                    i = self.expr(i)
        return i

    def yield_(self, i: int) -> int:
        s = self.s
        i += 1
        if s[i] == K["from"]:
            return self.expr(i + 1)
        return i if s[i] in "N);=" else self.tuple_(i)

    def tuple_(self, i: int) -> int:
        s = self.s
        i = self.element(i)
        while s[i] == ",":
            i += 1
            if s[i] in "N=:;)]}a":
                break
            i = self.element(i)
        return i

    def targets(self, i: int) -> int:
        s = self.s
        while True:
            if s[i] == "*":
                i += 1
            i = self.postfix(self.primary(i))
            if s[i] != ",":
                return i
            i += 1
            if s[i] in (K["in"], "="):
                return i

    # -- statements
    def recover(self, i: int) -> int:
        s = self.s
        while s[i] not in "N" + END + DEDENT:
            i += 1
        while s[i] in "N" + INDENT + DEDENT:
            i += 1
        return i

    def parse(self) -> list[tuple[int, str]]:
        s, i = self.s, 0
        while s[i] != END:
            try:
                i = self.statement(i)
            except Bad as e:
                self.errors.append((e.at, e.wanted))
                i = max(self.recover(e.at), i + 1) if s[e.at] != END else e.at
        return self.errors

    def suite(self, i: int) -> int:
        s = self.s
        i = self.want(i, ":")
        if s[i] != "N":
            return self.simple_line(i)
        i = self.want(i + 1, INDENT, "an indented block")
        while s[i] != DEDENT:
            if s[i] == END:
                raise Bad(i, "an indented block")
            i = self.statement(i)
        return i + 1

    def simple_line(self, i: int) -> int:
        s = self.s
        while True:
            i = self.simple(i)
            if s[i] == ";":
                i += 1
                if s[i] != "N":
                    continue
            return self.want(i, "N", "the end of the line")

    def simple(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == K["return"]:
            return i + 1 if s[i + 1] in "N;" else self.tuple_(i + 1)
        if c in (K["pass"], K["break"], K["continue"]):
            return i + 1
        if c == K["import"]:
            return self.aliases(i + 1, dotted=True)
        if c == K["from"]:
            i += 1
            dots = i
            while s[i] in ".e":
                i += 1
            if s[i] in NAMES:
                i = self.dotted(i)
            elif i == dots:
                raise Bad(i, "a module")
            i = self.want(i, K["import"], "import")
            if s[i] == "*":
                return i + 1
            if s[i] == "(":
                return self.listed(i + 1, lambda j: self.alias(j, False), ")")
            return self.aliases(i, dotted=False)
        if c == K["raise"]:
            if s[i + 1] in "N;":
                return i + 1
            i = self.expr(i + 1)
            return self.expr(i + 1) if s[i] == K["from"] else i
        if c == K["global"] or c == K["nonlocal"]:
            i += 1
            while True:
                i = self.name(i)
                if s[i] != ",":
                    return i
                i += 1
        if c == K["del"]:
            return self.targets(i + 1)
        if c == K["assert"]:
            i = self.expr(i + 1)
            return self.expr(i + 1) if s[i] == "," else i
        if c == K["yield"]:
            return self.yield_(i)
        if c == K["type"] and s[i + 1] in NAMES:
            i = self.type_parameters(i + 2)
            return self.expr(self.want(i, "="))
        start = i
        i = self.tuple_(i)
        if s[i] == ":":
            self.assignable(start, i)
            i = self.expr(i + 1)
            if s[i] == "=":
                i = self.yield_(i + 1) if s[i + 1] == K["yield"] else self.tuple_(i + 1)
            return i
        if s[i] == "a" or s[i] == ">" and s[i + 1] == "a":
            self.assignable(start, i)
            i += 1 if s[i] == "a" else 2
            return self.yield_(i) if s[i] == K["yield"] else self.tuple_(i)
        while s[i] == "=":
            self.assignable(start, i)
            start = i + 1
            i = self.yield_(i + 1) if s[i + 1] == K["yield"] else self.tuple_(i + 1)
        return i

    def assignable(self, start: int, end: int) -> None:
        """Targets end in a name, an item, or the bracket of a list; literals, calls and sums are none."""
        part = self.s[start:end]
        if part[-1] in '0")' + CONSTANTS and not part.startswith("(") or any(c in part for c in "b+-/%" + K["if"] + K["or"] + K["and"]) and "[" not in part and "(" not in part:
            raise Bad(start, "a target")

    def name(self, i: int) -> int:
        if self.s[i] not in NAMES:
            raise Bad(i, "a name")
        return i + 1

    def dotted(self, i: int) -> int:
        i = self.name(i)
        while self.s[i] == ".":
            i = self.name(i + 1)
        return i

    def alias(self, i: int, dotted: bool) -> int:
        i = self.dotted(i) if dotted else self.name(i)
        return self.name(i + 1) if self.s[i] == K["as"] else i

    def aliases(self, i: int, dotted: bool) -> int:
        i = self.alias(i, dotted)
        while self.s[i] == ",":
            i = self.alias(i + 1, dotted)
        return i

    def parameter(self, i: int, annotated: bool = True) -> int:
        s = self.s
        if s[i] == "/":
            return i + 1
        if s[i] == "*":
            i += 1
            if s[i] == ",":
                return i
        elif s[i] == "b":
            i += 1
        i = self.name(i)
        if annotated and s[i] == ":":
            i = self.expr(i + 2 if s[i + 1] == "*" else i + 1)
        return self.expr(i + 1) if s[i] == "=" else i

    def type_parameters(self, i: int) -> int:
        return self.items(i + 1, "]") if self.s[i] == "[" else i

    def statement(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in "i":
            return self.simple_line(i)
        if c == "@":
            i = self.want(self.expr(i + 1), "N", "the end of the line")
            if s[i] not in (K["def"], K["class"], K["async"], "@"):
                raise Bad(i, "def or class")
            return self.statement(i)
        if c == K["async"]:
            if s[i + 1] not in (K["def"], K["for"], K["with"]):
                raise Bad(i + 1, "def")
            return self.statement(i + 1)
        if c == K["def"]:
            i = self.type_parameters(self.name(i + 1))
            i = self.listed(self.want(i, "("), self.parameter, ")")
            if s[i] == "r":
                i = self.expr(i + 1)
            return self.suite(i)
        if c == K["class"]:
            i = self.type_parameters(self.name(i + 1))
            if s[i] == "(":
                i = self.listed(i + 1, self.argument, ")")
            return self.suite(i)
        if c == K["if"] or c == K["while"]:
            i = self.suite(self.element(i + 1))
            while c == K["if"] and s[i] == K["elif"]:
                i = self.suite(self.element(i + 1))
            return self.suite(i + 1) if s[i] == K["else"] else i
        if c == K["for"]:
            i = self.want(self.targets(i + 1), K["in"], "in")
            i = self.suite(self.tuple_(i))
            return self.suite(i + 1) if s[i] == K["else"] else i
        if c == K["try"]:
            i = self.suite(i + 1)
            ok = False
            while s[i] == K["except"]:
                i += 1
                if s[i] == "*":
                    i += 1
                if s[i] != ":":
                    i = self.tuple_(i)
                    if s[i] == K["as"]:
                        i = self.name(i + 1)
                i = self.suite(i)
                ok = True
            if ok and s[i] == K["else"]:
                i = self.suite(i + 1)
            if s[i] == K["finally"]:
                return self.suite(i + 1)
            if not ok:
                raise Bad(i, "except")
            return i
        if c == K["with"]:
            i += 1
            if s[i] == "(" and s[self.match(i)] == ":":
                return self.suite(self.listed(i + 1, self.with_item, ")"))
            i = self.with_item(i)
            while s[i] == ",":
                i = self.with_item(i + 1)
            return self.suite(i)
        if c == K["match"] and s[i + 1] not in "=.,:)N(a":
            return self.match_(i)
        if c == BAD or c == INDENT or c == DEDENT:
            raise Bad(i, "a statement")
        return self.simple_line(i)

    def with_item(self, i: int) -> int:
        i = self.expr(i)
        return self.targets(i + 1) if self.s[i] == K["as"] else i

    def match_(self, i: int) -> int:
        s = self.s
        i = self.want(self.want(self.want(self.tuple_(i + 1), ":"), "N"), INDENT)
        while s[i] == K["case"]:
            i += 1
            while s[i] != ":" or s[i + 1] != "N":
                if s[i] in "N" + END:
                    raise Bad(i, "':'")
                i += 1
            i = self.suite(i)
        return self.want(i, DEDENT, "case")
