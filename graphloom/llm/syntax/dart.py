"""Dart."""

from __future__ import annotations

from graphloom.llm.syntax.base import Bad, Grammar, flat_pattern
from graphloom.llm.syntax.lexer import DART, END

K = DART.keywords
NAMES = "i" + DART.soft


def _k(words: str) -> str:
    return "".join(K[w] for w in words.split())


LITERALS = _k("this super null true false")
MODIFIERS = _k("static final const late abstract external covariant var factory required sealed base interface")


class Dart(Grammar):
    lexer = DART
    POWER = {"b": 3, "|": 4, "&": 4, "^": 4, "<": 4, ">": 4, K["is"]: 4, K["as"]: 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}
    PREFIX = "!-~u" + K["await"] + K["throw"]
    flat = flat_pattern("i", r"b+\-*/%<>", r"\.")

    # -- types
    def try_type(self, i: int) -> int:
        s = self.s
        if s[i] == K["void"]:
            i += 1
        elif s[i] == K["Function"]:
            i += 1
            if s[i] == "(":
                i = self.match(i)
            return i + 1 if s[i] == "?" else i
        elif s[i] == "(" and s[i + 1] != ")":  # record
            j = self.match(i)
            i += 1
            while i < j - 1:
                i = self.try_type(i)
                if not i:
                    return 0
                if s[i] in NAMES:
                    i += 1
                if s[i] == ",":
                    i += 1
                elif i != j - 1:
                    return 0
            i = j
        elif s[i] in NAMES:
            i += 1
            if s[i] == "." and s[i + 1] in NAMES:
                i += 2
            if s[i] == "<":
                i = self.type_arguments(i)
                if not i:
                    return 0
        else:
            return 0
        if s[i] == "?":
            i += 1
        while s[i] == K["Function"] and s[i + 1] in "(<":
            i = self.type_arguments(i + 1) if s[i + 1] == "<" else i + 1
            i = self.match(i)
            if s[i] == "?":
                i += 1
        return i

    def type_arguments(self, i: int) -> int:
        s = self.s
        i += 1
        while s[i] != ">":
            i = self.try_type(i)
            if not i:
                return 0
            if s[i] == K["extends"]:
                i = self.try_type(i + 1)
                if not i:
                    return 0
            if s[i] == ",":
                i += 1
            elif s[i] != ">":
                return 0
        return i + 1

    def type(self, i: int) -> int:
        j = self.try_type(i)
        if not j:
            raise Bad(i, "a type")
        return j

    def generic(self, i: int) -> int:
        if self.s[i] != "<":
            return i
        j = self.type_arguments(i)
        if not j:
            raise Bad(i, "types")
        return j

    # -- expressions
    def assignment(self, i: int) -> int:
        s = self.s
        i = self.ternary(i)
        if s[i] in "=a":
            return self.assignment(i + 1)
        if s[i] == ">" and s[i + 1] == ">":
            return self.assignment(i + 2)
        while s[i] == "e":  # cascade
            i += 1
            if s[i] == "[":
                i = self.want(self.expr(i + 1), "]")
            elif s[i] in NAMES:
                i += 1
            else:
                raise Bad(i, "a name")
            i = self.postfix(i)
            if s[i] in "=a":
                i = self.ternary(i + 1)
        return i

    def climb(self, i: int, least: int) -> int:
        s, power = self.s, self.POWER
        i = self.unary(i)
        while (p := power.get(s[i], -1)) >= least:
            c = s[i]
            i += 1
            if c in (K["is"], K["as"]):
                i = self.type(i + 1 if s[i] == "!" else i)
                continue
            while c in "<>" and s[i] == c:
                i += 1
            i = self.climb(i, p + 1)
        return i

    def primary(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == "(":
            j = self.match(i)
            if s[j] in "f{" or s[j] in (K["async"], K["sync"]) and s[j + 1] in "f{*":
                return self.function_body(self.parameters(i), expression=True)
            i = self.expr(i + 1)
            while s[i] == ",":
                i = i + 1 if s[i + 1] == ")" else self.argument(i + 1)
            return self.want(i, ")")
        if c == '"':
            while s[i] == '"':
                i += 1
            return i
        if c == K["const"] or c == K["new"]:
            i += 1
            if s[i] in "[{<":
                return self.primary(i)
            i = self.type(i)
            while s[i] == ".":
                i = self.name(i + 1)
            return i if s[i] == "(" else self.want(i, "(")
        if c in NAMES:
            if s[i + 1] == "<":
                j = self.type_arguments(i + 1)
                if j and s[j] in "(.)":
                    return j
            return i + 1
        if c == "0" or c in LITERALS:
            return i + 1
        if c == "<":
            i = self.generic(i)
            if s[i] not in "[{":
                raise Bad(i, "a literal")
            c = s[i]
        if c == "[":
            return self.listed(i + 1, self.element, "]")
        if c == "{":
            return self.listed(i + 1, self.element, "}")
        if c == K["switch"]:
            return self.switch_expression(i)
        raise Bad(i, "an expression")

    def name(self, i: int) -> int:
        if self.s[i] not in NAMES + K["new"]:
            raise Bad(i, "a name")
        return i + 1

    def element(self, i: int) -> int:
        s = self.s
        if s[i] == "e":
            i += 1
            return self.expr(i + 1 if s[i] == "?" else i)
        if s[i] == K["if"]:
            i = self.element(self.condition(i + 1))
            return self.element(i + 1) if s[i] == K["else"] else i
        if s[i] == K["for"]:
            return self.element(self.for_head(i + 1))
        i = self.expr(i)
        return self.expr(i + 1) if s[i] == ":" else i

    def argument(self, i: int) -> int:
        s = self.s
        if s[i] in NAMES and s[i + 1] == ":":
            i += 2
        return self.expr(i)

    def postfix(self, i: int) -> int:
        s = self.s
        while True:
            c = s[i]
            if c == "." or c == "q":
                i = self.name(i + 1) if s[i + 1] != "[" else i + 1
            elif c == "(":
                i = self.listed(i + 1, self.argument, ")")
            elif c == "[":
                i = self.want(self.expr(i + 1), "]")
            elif c in "u!":
                i += 1
            elif c == "<":
                j = self.type_arguments(i)
                if not j or s[j] != "(":
                    return i
                i = j
            else:
                return i

    def switch_expression(self, i: int) -> int:
        s = self.s
        i = self.want(self.condition(i + 1), "{")
        while s[i] != "}":
            i = self.ternary(i)
            if s[i] == K["when"]:
                i = self.expr(i + 1)
            i = self.expr(self.want(i, "f"))
            if s[i] == ",":
                i += 1
        return i + 1

    # -- functions
    def parameters(self, i: int) -> int:
        s = self.s
        i = self.want(i, "(")
        while s[i] != ")":
            if s[i] in "[{":
                i = self.listed(i + 1, self.parameter, "]" if s[i] == "[" else "}")
            else:
                i = self.parameter(i)
            if s[i] == ",":
                i += 1
            elif s[i] != ")":
                raise Bad(i, "')'")
        return i + 1

    def parameter(self, i: int) -> int:
        s = self.s
        while s[i] == "@":
            i = self.annotation(i)
        while s[i] in MODIFIERS and s[i + 1] in NAMES + K["void"] + K["this"] + K["super"] + MODIFIERS:
            i += 1
        if s[i] in LITERALS:
            i = self.name(self.want(i + 1, "."))
        else:
            t = self.try_type(i)
            if t and (s[t] in NAMES or s[t] in LITERALS):
                i = t
                if s[i] in LITERALS:
                    i = self.want(i + 1, ".")
            i = self.name(i)
        if s[i] == "(":
            i = self.parameters(i)
        return self.expr(i + 1) if s[i] in "=:" else i

    def function_body(self, i: int, expression: bool = False) -> int:
        s = self.s
        if s[i] in (K["async"], K["sync"]):
            i += 1
            if s[i] == "*":
                i += 1
        if s[i] == "f":
            i = self.expr(i + 1)
            return i if expression else self.want(i, ";")
        return self.block(i)

    def annotation(self, i: int) -> int:
        s = self.s
        i = self.name(i + 1)
        while s[i] == ".":
            i = self.name(i + 1)
        i = self.generic(i)
        return self.listed(i + 1, self.argument, ")") if s[i] == "(" else i

    # -- declarations
    def modifiers(self, i: int) -> int:
        s = self.s
        while True:
            if s[i] == "@":
                i = self.annotation(i)
            elif s[i] in MODIFIERS and (s[i + 1] in NAMES + MODIFIERS + K["void"] + K["class"] or s[i] not in NAMES and s[i + 1] in "("):
                i += 1
            else:
                return i

    def declaration(self, i: int, member: bool = False) -> int:
        """Functions, methods, constructors, fields and variables with their modifiers."""
        s = self.s
        start = i
        i = self.modifiers(i)
        plain = i > start and any(c in s[start:i] for c in _k("final const var late"))
        if s[i] == K["operator"] and s[i + 1] not in "(=;":
            return self.operator(i)
        if s[i] in (K["get"], K["set"]) and s[i + 1] in NAMES:
            return self.callable(i + 1)
        t = self.try_type(i)
        if t and (s[t] in NAMES) and not (s[t] == K["async"] and s[t + 1] == "{"):
            i = t
            if s[i] == K["operator"] and s[i + 1] not in "(=;":
                return self.operator(i)
            if s[i] in (K["get"], K["set"]) and s[i + 1] in NAMES:
                return self.callable(i + 1)
            if s[i + 1] in "(<" or member and s[i + 1] == ".":
                return self.callable(i)
            return self.want(self.variables(i), ";")
        if s[i] in NAMES and (s[i + 1] in "(<" or member and s[i + 1] == "."):
            return self.callable(i)
        if plain:
            return self.want(self.variables(i), ";")
        raise Bad(i, "a declaration")

    def operator(self, i: int) -> int:
        i += 1
        while self.s[i] not in "(" + END:
            i += 1
        return self.callable(i - 1)

    def callable(self, i: int) -> int:
        """From the name on."""
        s = self.s
        i += 1
        while s[i] == ".":
            i = self.name(i + 1)
        i = self.generic(i)
        if s[i] == "(":
            i = self.parameters(i)
        if s[i] == ":":  # initialisers
            i = self.initialiser(i + 1)
            while s[i] == ",":
                i = self.initialiser(i + 1)
        if s[i] == "=":  # redirecting factory
            return self.want(self.expr(i + 1), ";")
        return i + 1 if s[i] == ";" else self.function_body(i)

    def initialiser(self, i: int) -> int:
        s = self.s
        if s[i] == K["assert"]:
            return self.listed(self.want(i + 1, "("), self.expr, ")")
        i = self.postfix(self.primary(i))
        return self.ternary(i + 1) if s[i] == "=" else i

    def variables(self, i: int) -> int:
        s = self.s
        while True:
            i = self.name(i)
            if s[i] == "=":
                i = self.expr(i + 1)
            if s[i] != ",":
                return i
            i += 1

    def class_(self, i: int) -> int:
        """From class, mixin, extension or enum on."""
        s = self.s
        kind = s[i]
        i += 1
        if s[i] == K["type"]:
            i += 1
        if s[i] == K["class"]:
            i += 1
        if s[i] in NAMES and s[i] != K["on"]:
            i += 1
        elif kind != K["extension"]:
            raise Bad(i, "a name")
        i = self.generic(i)
        if s[i] == "=":
            return self.want(self.type(i + 1), ";")
        if kind == K["extension"] and s[i] == "(":
            i = self.parameters(i)
        while s[i] in _k("extends with implements on"):
            i = self.type(i + 1)
            while s[i] == ",":
                i = self.type(i + 1)
        i = self.want(i, "{")
        if kind == K["enum"]:
            while s[i] in NAMES:
                i = self.generic(i + 1)
                if s[i] == ".":
                    i = self.name(i + 1)
                if s[i] == "(":
                    i = self.listed(i + 1, self.argument, ")")
                if s[i] != ",":
                    break
                i += 1
            if s[i] == ";":
                i += 1
        i = self.statements(i, "}", self.member)
        return i + 1 if s[i] == "}" else i

    def member(self, i: int) -> int:
        return self.declaration(i, member=True)

    def parse(self) -> list[tuple[int, str]]:
        self.statement, self.inner = self.top, self.statement
        return super().parse()

    def top(self, i: int) -> int:
        s = self.s
        j = i
        while s[j] == "@":
            j = self.annotation(j)
        if s[j] in _k("import export part library") and s[j + 1] in '"i' + K["of"] + ";":
            j += 1
            while s[j] in '"i,.' + NAMES + K["if"] + "()b":
                j += 1
            return self.want(j, ";")
        while s[j] in _k("abstract sealed base interface final") and (s[j + 1] in _k("class mixin abstract sealed base interface final")):
            j += 1
        if s[j] in (K["class"], K["enum"]) or s[j] == K["mixin"] and s[j + 1] in "i" + K["class"] or s[j] == K["extension"] and s[j + 1] in NAMES:
            return self.class_(j)
        if s[j] == K["typedef"]:
            j += 1
            t = self.try_type(j)
            if t and s[t] in NAMES:
                j = t
            j = self.generic(self.name(j))
            if s[j] == "=":
                return self.want(self.type(j + 1), ";")
            return self.want(self.parameters(j), ";")
        return self.declaration(i)

    # -- statements
    def block(self, i: int) -> int:
        i = self.statements(self.want(i, "{"), "}", self.inner)
        return i + 1 if self.s[i] == "}" else i

    def condition(self, i: int) -> int:
        i = self.expr(self.want(i, "("))
        if self.s[i] == K["case"]:
            i = self.expr(i + 1)
        return self.want(i, ")")

    def for_head(self, i: int) -> int:
        s = self.s
        if s[i] == K["await"]:
            i += 1
        i = self.want(i, "(")
        j = i
        while s[j] in _k("final var const late"):
            j += 1
        t = self.try_type(j)
        if t and s[t] in NAMES and s[t + 1] in (K["in"], "=", ";", ","):
            j = t
        if s[j] in NAMES and s[j + 1] == K["in"]:
            return self.want(self.expr(j + 2), ")")
        if j > i:
            i = self.variables(j)
        elif s[i] != ";":
            i = self.several(i)
        i = self.want(i, ";")
        i = self.want(i if s[i] == ";" else self.expr(i), ";")
        return self.want(i if s[i] == ")" else self.several(i), ")")

    def several(self, i: int) -> int:
        i = self.expr(i)
        while self.s[i] == ",":
            i = self.expr(i + 1)
        return i

    def statement(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == "{":
            return self.block(i)
        if c == K["var"] or c in _k("final const late") and s[i + 1] in NAMES:
            return self.declaration(i)
        if c == K["return"]:
            return i + 2 if s[i + 1] == ";" else self.want(self.expr(i + 1), ";")
        if c == K["if"]:
            i = self.inner(self.condition(i + 1))
            return self.inner(i + 1) if s[i] == K["else"] else i
        if c == K["for"] or c == K["await"] and s[i + 1] == K["for"]:
            return self.inner(self.for_head(i + 1 if c == K["for"] else i + 2))
        if c == K["while"]:
            return self.inner(self.condition(i + 1))
        if c == K["do"]:
            i = self.want(self.inner(i + 1), K["while"], "while")
            return self.want(self.condition(i), ";")
        if c in (K["break"], K["continue"]):
            i += 1
            return self.want(i + 1 if s[i] in NAMES else i, ";")
        if c == K["rethrow"]:
            return self.want(i + 1, ";")
        if c == K["assert"]:
            return self.want(self.listed(self.want(i + 1, "("), self.expr, ")"), ";")
        if c == K["yield"]:
            return self.want(self.expr(i + 2 if s[i + 1] == "*" else i + 1), ";")
        if c == K["try"]:
            return self.try_(i)
        if c == K["switch"]:
            return self.switch(i)
        if c == ";":
            return i + 1
        if c in NAMES and s[i + 1] == ":":
            return self.inner(i + 2)
        if c in NAMES + K["void"] + "@":
            t = self.try_type(i) if c != "@" else i
            if c == "@" or t and s[t] in NAMES and s[t + 1] in "=;,(<":
                return self.declaration(i)
            if s[i + 1] == "(" and s[self.match(i + 1)] in "{f" + K["async"]:
                return self.callable(i)
        return self.want(self.expr(i), ";")

    def try_(self, i: int) -> int:
        s = self.s
        i = self.block(i + 1)
        ok = False
        while s[i] in (K["catch"], K["on"]):
            if s[i] == K["on"]:
                i = self.type(i + 1)
            if s[i] == K["catch"]:
                i = self.listed(self.want(i + 1, "("), self.name, ")")
            i = self.block(i)
            ok = True
        if s[i] == K["finally"]:
            return self.block(i + 1)
        if not ok:
            raise Bad(i, "catch")
        return i

    def switch(self, i: int) -> int:
        s = self.s
        i = self.want(self.condition(i + 1), "{")
        while s[i] != "}":
            if s[i] == K["default"]:
                i += 1
            else:
                i = self.ternary(self.want(i, K["case"], "case"))
                if s[i] == K["when"]:
                    i = self.expr(i + 1)
            i = self.want(i, ":")
            while s[i] not in (K["case"], K["default"], "}"):
                if s[i] == END:
                    raise Bad(i, "'}'")
                i = self.inner(i)
        return i + 1
