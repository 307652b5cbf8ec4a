"""Java, and what Dart shares with it."""

from __future__ import annotations

from graphloom.llm.syntax.base import Bad, Grammar, flat_pattern
from graphloom.llm.syntax.lexer import END, JAVA

K = JAVA.keywords


def _k(words: str) -> str:
    return "".join(K[w] for w in words.split())


NAMES = "i" + JAVA.soft
PRIMITIVES = _k("int long short byte char boolean float double")
MODIFIERS = _k("public private protected static final abstract native synchronized transient volatile strictfp default sealed non")
TYPES = _k("class interface enum")
LITERALS = _k("this super null true false")


class Java(Grammar):
    lexer = JAVA
    POWER = {"b": 3, "|": 3, "&": 3, "^": 3, "<": 4, ">": 4, K["instanceof"]: 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}
    flat = flat_pattern(NAMES, r"b+\-*/%<>", r"\.")

    # -- types
    def type(self, i: int) -> int:
        j = self.try_type(i)
        if not j:
            raise Bad(i, "a type")
        return j

    def try_type(self, i: int) -> int:
        """The end of a type that begins at i, 0 if none does."""
        s = self.s
        while s[i] == "@":
            i = self.annotation(i)
        if s[i] in PRIMITIVES:
            i += 1
        elif s[i] in NAMES:
            i += 1
            while True:
                if s[i] == "<":
                    i = self.type_arguments(i)
                    if not i:
                        return 0
                if s[i] == "." and s[i + 1] in NAMES:
                    i += 2
                else:
                    break
        else:
            return 0
        while s[i] == "[" and s[i + 1] == "]":
            i += 2
        return i

    def type_arguments(self, i: int) -> int:
        s = self.s
        i += 1
        while s[i] != ">":
            if s[i] == "?":
                i += 1
                if s[i] in LITERALS or s[i] == K["extends"]:
                    i = self.try_type(i + 1)
            else:
                i = self.try_type(i)
            if not i:
                return 0
            while s[i] == "&":
                i = self.try_type(i + 1)
                if not i:
                    return 0
            if s[i] == ",":
                i += 1
            elif s[i] != ">":
                return 0
        return i + 1

    def type_parameters(self, i: int) -> int:
        return self.listed(i + 1, self.type_parameter, ">", False) if self.s[i] == "<" else i

    def type_parameter(self, i: int) -> int:
        i = self.type(i)
        if self.s[i] == K["extends"]:
            i = self.type(i + 1)
            while self.s[i] == "&":
                i = self.type(i + 1)
        return i

    def annotation(self, i: int) -> int:
        s = self.s
        i += 1
        if s[i] not in NAMES:
            raise Bad(i, "a name")
        i += 1
        while s[i] == "." and s[i + 1] in NAMES:
            i += 2
        if s[i] == "(":
            i = self.listed(i + 1, self.annotation_value, ")")
        return i

    def annotation_value(self, i: int) -> int:
        s = self.s
        if s[i] in NAMES and s[i + 1] == "=":
            i += 2
        if s[i] == "{":
            return self.listed(i + 1, self.annotation_value, "}")
        return self.annotation(i) if s[i] == "@" else self.expr(i)

    # -- expressions
    def assignment(self, i: int) -> int:
        s = self.s
        if s[i] in NAMES and s[i + 1] == "r":
            return self.lambda_body(i + 2)
        if s[i] == "(" and s[self.match(i)] == "r":
            i = self.listed(i + 1, self.lambda_parameter, ")")
            return self.lambda_body(i + 1)
        i = self.ternary(i)
        if s[i] in "=a":
            return self.assignment(i + 1)
        if s[i] == ">" and s[i + 1] in ">b" + "a":
            return self.assignment(i + 2)
        return i

    def lambda_parameter(self, i: int) -> int:
        if self.s[i] in NAMES and self.s[i + 1] in ",)":
            return i + 1
        return self.parameter(i)

    def lambda_body(self, i: int) -> int:
        return self.block(i) if self.s[i] == "{" else self.assignment(i)

    def climb(self, i: int, least: int) -> int:
        s, power = self.s, self.POWER
        i = self.unary(i)
        while (p := power.get(s[i], -1)) >= least:
            c = s[i]
            i += 1
            if c == K["instanceof"]:
                if s[i] == K["final"]:
                    i += 1
                i = self.type(i)
                if s[i] in NAMES:
                    i += 1
                continue
            while c in "<>" and s[i] == c:
                i += 1
            i = self.climb(i, p + 1)
        return i

    def unary(self, i: int) -> int:
        s = self.s
        while s[i] in self.PREFIX:
            i += 1
        if s[i] == "(":  # a cast?
            j = self.try_type(i + 1)
            while j and s[j] == "&":
                j = self.try_type(j + 1)
            if j and s[j] == ")" and (s[i + 1] in PRIMITIVES and s[j + 1] not in ")" or s[j + 1] in '0"(!~' + NAMES + LITERALS + K["new"]):
                return self.assignment(j + 1) if s[j + 1] in NAMES and s[j + 2] == "r" else self.unary(j + 1)
        return self.postfix(self.primary(i))

    def primary(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in NAMES or c in '0"' or c in LITERALS:
            return i + 1
        if c == "(":
            return self.want(self.expr(i + 1), ")")
        if c == K["new"]:
            return self.new(i + 1)
        if c == K["switch"]:
            return self.switch(i)
        if c in PRIMITIVES or c == K["void"]:
            i = self.try_type(i) or i + 1
            if s[i] == "." and s[i + 1] == K["class"]:
                return i + 2
            if s[i] == "c":
                return i
        raise Bad(i, "an expression")

    def new(self, i: int) -> int:
        s = self.s
        while s[i] == "@":
            i = self.annotation(i)
        if s[i] in PRIMITIVES:
            i += 1
        elif s[i] in NAMES:
            i += 1
            while s[i] in ".<":
                if s[i] == "<":
                    i = i + 2 if s[i + 1] == ">" else self.type_arguments(i)
                    if not i:
                        raise Bad(i, "a type")
                else:
                    i = self.want(i + 1, "i", "a name")
        else:
            raise Bad(i, "a type")
        if s[i] == "[":
            while s[i] == "[":
                i = i + 2 if s[i + 1] == "]" else self.want(self.expr(i + 1), "]")
            return self.array(i) if s[i] == "{" else i
        i = self.arguments(self.want(i, "(") - 1)
        return self.class_body(i) if s[i] == "{" else i

    def array(self, i: int) -> int:
        return self.listed(i + 1, lambda j: self.array(j) if self.s[j] == "{" else self.expr(j), "}")

    def arguments(self, i: int) -> int:
        return self.listed(i + 1, self.expr, ")", False)

    def postfix(self, i: int) -> int:
        s = self.s
        while True:
            c = s[i]
            if c == ".":
                i += 1
                if s[i] == "<":
                    i = self.type_arguments(i) or i
                if s[i] in NAMES or s[i] in LITERALS or s[i] == K["class"]:
                    i += 1
                elif s[i] == K["new"]:
                    i = self.new(i + 1)
                else:
                    raise Bad(i, "a name")
            elif c == "(" and s[i - 1] in NAMES + LITERALS:
                i = self.arguments(i)
            elif c == "[":
                if s[i + 1] == "]":
                    while s[i] == "[":
                        i = self.want(i + 1, "]")
                    if s[i] == "c" or s[i] == "." and s[i + 1] == K["class"]:
                        continue
                    raise Bad(i, "'::'")
                i = self.want(self.expr(i + 1), "]")
            elif c == "u":
                i += 1
            elif c == "c":
                i += 1
                if s[i] not in NAMES + K["new"]:
                    raise Bad(i, "a name")
                i += 1
            elif c == "<" and s[i - 1] in NAMES:
                j = self.type_arguments(i)
                if not j or s[j] != "c":
                    return i
                i = j
            else:
                return i

    # -- declarations
    def modifiers(self, i: int) -> int:
        s = self.s
        while True:
            if s[i] == "@" and s[i + 1] != K["interface"]:
                i = self.annotation(i)
            elif s[i] in MODIFIERS and not (s[i] in NAMES and s[i + 1] in "=.(;,["):
                i += 1
                if s[i] == "-" and s[i + 1] in K["sealed"]:
                    i += 2
            else:
                return i

    def parameter(self, i: int) -> int:
        s = self.s
        i = self.type(self.modifiers(i))
        if s[i] == "e":
            i += 1
        if s[i] in NAMES or s[i] == K["this"]:
            i += 1
        else:
            raise Bad(i, "a name")
        while s[i] == "[":
            i = self.want(i + 1, "]")
        return i

    def type_declaration(self, i: int) -> int:
        """From class, interface, enum, record or @interface on."""
        s = self.s
        c = s[i]
        if c == "@":
            i += 1
            c = s[i]
        i += 1
        if s[i] not in NAMES:
            raise Bad(i, "a name")
        i = self.type_parameters(i + 1)
        if c == K["record"]:
            i = self.listed(self.want(i, "("), self.parameter, ")")
        while s[i] in (K["extends"], K["implements"], K["permits"]):
            i = self.type(i + 1)
            while s[i] == ",":
                i = self.type(i + 1)
        if c == K["enum"]:
            return self.enum_body(i)
        return self.class_body(i)

    def enum_body(self, i: int) -> int:
        s = self.s
        i = self.want(i, "{")
        while s[i] in NAMES or s[i] == "@":
            i = self.modifiers(i)
            i += 1
            if s[i] == "(":
                i = self.arguments(i)
            if s[i] == "{":
                i = self.class_body(i)
            if s[i] != ",":
                break
            i += 1
        if s[i] == ";":
            i = self.statements(i + 1, "}", self.member)
        return self.want(i, "}")

    def class_body(self, i: int) -> int:
        i = self.statements(self.want(i, "{"), "}", self.member)
        return i + 1 if self.s[i] == "}" else i

    def is_type_start(self, i: int) -> bool:
        s = self.s
        return s[i] in TYPES or s[i] == "@" and s[i + 1] == K["interface"] or s[i] == K["record"] and s[i + 1] in NAMES and s[i + 2] in "(<"

    def member(self, i: int) -> int:
        s = self.s
        if s[i] == ";":
            return i + 1
        if s[i] == "{" or s[i] == K["static"] and s[i + 1] == "{":
            return self.block(i if s[i] == "{" else i + 1)
        i = self.modifiers(i)
        if self.is_type_start(i):
            return self.type_declaration(i)
        i = self.type_parameters(i)
        if s[i] in NAMES and s[i + 1] == "(":
            return self.method(i + 1)
        if s[i] in NAMES and s[i + 1] == "{":  # compact record constructor
            return self.block(i + 1)
        i = i + 1 if s[i] == K["void"] else self.type(i)
        if s[i] not in NAMES:
            raise Bad(i, "a name")
        if s[i + 1] == "(":
            return self.method(i + 1)
        return self.want(self.variables(i), ";")

    def method(self, i: int) -> int:
        s = self.s
        i = self.listed(i + 1, self.parameter, ")", False)
        while s[i] == "[":
            i = self.want(i + 1, "]")
        if s[i] == K["throws"]:
            i = self.type(i + 1)
            while s[i] == ",":
                i = self.type(i + 1)
        if s[i] == K["default"]:
            i = self.annotation_value(i + 1)
        return i + 1 if s[i] == ";" else self.block(i)

    def variables(self, i: int) -> int:
        s = self.s
        while True:
            if s[i] not in NAMES:
                raise Bad(i, "a name")
            i += 1
            while s[i] == "[":
                i = self.want(i + 1, "]")
            if s[i] == "=":
                i = self.array(i + 1) if s[i + 1] == "{" else self.expr(i + 1)
            if s[i] != ",":
                return i
            i += 1

    def parse(self) -> list[tuple[int, str]]:
        self.statement, self.inner = self.top, self.statement
        return super().parse()

    def top(self, i: int) -> int:
        s = self.s
        if s[i] == ";":
            return i + 1
        i = self.modifiers(i)
        if s[i] == K["package"] or s[i] == K["import"]:
            i += 1
            if s[i] == K["static"]:
                i += 1
            i = self.want(i, "i", "a name")
            while s[i] == ".":
                i += 1
                if s[i] not in NAMES + "*":
                    raise Bad(i, "a name")
                i += 1
            return self.want(i, ";")
        if self.is_type_start(i):
            return self.type_declaration(i)
        raise Bad(i, "class, interface or enum")

    # -- statements
    def block(self, i: int) -> int:
        i = self.statements(self.want(i, "{"), "}", self.inner)
        return i + 1 if self.s[i] == "}" else i

    def condition(self, i: int) -> int:
        return self.want(self.expr(self.want(i, "(")), ")")

    def statement(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == "{":
            return self.block(i)
        if c == K["return"]:
            return i + 2 if s[i + 1] == ";" else self.want(self.expr(i + 1), ";")
        if c == K["if"]:
            i = self.inner(self.condition(i + 1))
            return self.inner(i + 1) if s[i] == K["else"] else i
        if c == K["for"]:
            return self.for_(i + 1)
        if c == K["while"]:
            return self.inner(self.condition(i + 1))
        if c == K["do"]:
            i = self.want(self.inner(i + 1), K["while"], "while")
            return self.want(self.condition(i), ";")
        if c == K["throw"]:
            return self.want(self.expr(i + 1), ";")
        if c == K["break"] or c == K["continue"]:
            i += 1
            return self.want(i + 1 if s[i] in NAMES else i, ";")
        if c == K["try"]:
            return self.try_(i + 1)
        if c == K["switch"]:
            return self.switch(i)
        if c == K["synchronized"]:
            return self.block(self.condition(i + 1))
        if c == K["assert"]:
            i = self.expr(i + 1)
            return self.want(self.expr(i + 1) if s[i] == ":" else i, ";")
        if c == ";":
            return i + 1
        if c == K["yield"] and s[i + 1] not in "=.(":
            return self.want(self.expr(i + 1), ";")
        if c in NAMES and s[i + 1] == ":":
            return self.inner(i + 2)
        j = self.modifiers(i) if c in "@" + MODIFIERS else i
        if self.is_type_start(j):
            return self.type_declaration(j)
        t = self.try_type(j)
        if t and s[t] in NAMES and s[t + 1] in "=;,[:":
            return self.want(self.variables(t), ";")
        if j > i:
            raise Bad(j, "a declaration")
        k = self.expr(i)
        if s[k - 1] not in ")u" and not self.assigns(i, k) or s[k - 1] == ")" and s[i] == "(" and self.match(i) == k:
            raise Bad(i, "a statement")
        return self.want(k, ";")

    def assigns(self, i: int, k: int) -> bool:
        return any(c in "=au" for c in self.s[i:k]) or K["new"] in self.s[i:k] or self.s[k - 1] == "}"

    def for_(self, i: int) -> int:
        s = self.s
        i = self.want(i, "(")
        j = self.modifiers(i)
        t = self.try_type(j)
        if t and s[t] in NAMES:
            if s[t + 1] == ":":
                return self.inner(self.want(self.expr(t + 2), ")"))
            i = self.variables(t)
        elif s[i] != ";":
            i = self.several(i)
        i = self.want(i, ";")
        i = self.want(i if s[i] == ";" else self.expr(i), ";")
        return self.inner(self.want(i if s[i] == ")" else self.several(i), ")"))

    def several(self, i: int) -> int:
        i = self.expr(i)
        while self.s[i] == ",":
            i = self.expr(i + 1)
        return i

    def try_(self, i: int) -> int:
        s = self.s
        ok = s[i] == "("
        if ok:
            i += 1
            while s[i] != ")":
                j = self.modifiers(i)
                t = self.try_type(j)
                i = self.variables(t) if t and s[t] in NAMES else self.expr(i)
                if s[i] == ";":
                    i += 1
                elif s[i] != ")":
                    raise Bad(i, "')'")
            i += 1
        i = self.block(i)
        while s[i] == K["catch"]:
            i = self.type(self.modifiers(self.want(i + 1, "(")))
            while s[i] == "|":
                i = self.type(i + 1)
            i = self.block(self.want(self.want(i, "i", "a name"), ")"))
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
                if s[i] in NAMES:
                    i += 1
                while s[i] == ",":
                    i = self.ternary(i + 1)
            if s[i] == "r":
                i = self.inner(i + 1)
                continue
            i = self.want(i, ":")
            while s[i] not in (K["case"], K["default"], "}"):
                if s[i] == END:
                    raise Bad(i, "'}'")
                i = self.inner(i)
        return i + 1
