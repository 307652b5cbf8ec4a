"""Go."""

from __future__ import annotations

from graphloom.llm.syntax.base import Bad, Grammar, flat_pattern
from graphloom.llm.syntax.lexer import END, GO

K = GO.keywords


def _k(words: str) -> str:
    return "".join(K[w] for w in words.split())


TYPE_STARTS = "i*[(h" + _k("map chan func struct interface")


class Go(Grammar):
    lexer = GO
    POWER = {"b": 3, "|": 4, "&": 5, "^": 4, "<": 3, ">": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5}
    PREFIX = "!-+^*&h"
    CLOSERS = frozenset("N),];:=aw}" + END)
    flat = flat_pattern("i", r"b+\-*/%<>", r"\.")
    #: Composite literals are not allowed in the head of a statement.
    head = False

    def expr(self, i: int) -> int:
        m = self.flat.match(self.s, i)
        if m:
            c = self.s[m.end()]
            if c in self.CLOSERS or c == "{" and self.head:
                return m.end()
        return self.climb(i, 0)

    def ends(self, i: int) -> int:
        c = self.s[i]
        if c == "N" or c == ";":
            return i + 1
        if c in "})" or c == END:
            return i
        raise Bad(i, "the end of the line")

    def lines(self, i: int) -> int:
        while self.s[i] in "N;":
            i += 1
        return i

    # -- types
    def type(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == "i":
            i += 1
            if s[i] == ".":
                i = self.want(i + 1, "i", "a name")
            if s[i] == "[" and s[i + 1] != "]":
                i = self.listed(i + 1, self.type, "]")
            return i
        if c == "*":
            return self.type(i + 1)
        if c == "[":
            i += 1
            if s[i] == "e":
                i += 1
            elif s[i] != "]":
                i = self.expr(i)
            return self.type(self.want(i, "]"))
        if c == K["map"]:
            i = self.type(self.want(i + 1, "["))
            return self.type(self.want(i, "]"))
        if c == K["chan"] or c == "h":
            i += 1
            if s[i] == "h" or c == "h":
                i += 1
            return self.type(i)
        if c == K["func"]:
            return self.signature(i + 1)
        if c == K["struct"]:
            return self.members(i + 1, self.field)
        if c == K["interface"]:
            return self.members(i + 1, self.interface_item)
        if c == "(":
            return self.want(self.type(i + 1), ")")
        raise Bad(i, "a type")

    def members(self, i: int, item) -> int:
        s = self.s
        i = self.lines(self.want(i, "{"))
        while s[i] != "}":
            if s[i] == END:
                raise Bad(i, "'}'")
            i = self.lines(self.ends(item(i)))
        return i + 1

    def field(self, i: int) -> int:
        s = self.s
        if s[i] == "*":
            i = self.type(i)
        elif s[i] == "i" and s[i + 1] in 'N};."':
            i = self.type(i)
        else:
            i = self.type(self.names(i))
        return i + 1 if s[i] == '"' else i

    def interface_item(self, i: int) -> int:
        s = self.s
        if s[i] == "i" and s[i + 1] == "(":
            return self.signature(i + 1)
        while True:
            if s[i] == "~":
                i += 1
            i = self.type(i)
            if s[i] != "|":
                return i
            i += 1

    def names(self, i: int) -> int:
        i = self.want(i, "i", "a name")
        while self.s[i] == ",":
            i = self.want(i + 1, "i", "a name")
        return i

    def signature(self, i: int) -> int:
        s = self.s
        i = self.parameters(i)
        if s[i] == "(":
            return self.parameters(i)
        return self.type(i) if s[i] in TYPE_STARTS else i

    def parameters(self, i: int) -> int:
        s = self.s
        i = self.want(i, "(")
        while s[i] != ")":
            if s[i] == "e":
                i = self.type(i + 1)
            else:
                i = self.type(i)
                if s[i] == "e":
                    i += 1
                if s[i] in TYPE_STARTS:
                    i = self.type(i)
            if s[i] == ",":
                i = self.lines(i + 1)
            elif s[i] != ")":
                raise Bad(i, "')'")
        return i + 1

    # -- expressions
    def primary(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in 'i0"':
            return i + 1
        if c == "(":
            kept, self.head = self.head, False
            i = self.expr(i + 1) if s[i + 1] != "*" else self.expr(i + 1)
            self.head = kept
            return self.want(i, ")")
        if c == K["func"]:
            i = self.signature(i + 1)
            if s[i] != "{":
                return i
            kept, self.head = self.head, False
            i = self.block(i)
            self.head = kept
            return i
        if c == "[" or c in _k("map struct chan interface"):
            i = self.type(i)
            return self.literal(i) if s[i] == "{" else i
        raise Bad(i, "an expression")

    def literal(self, i: int) -> int:
        s = self.s
        kept, self.head = self.head, False
        i = self.lines(i + 1)
        while s[i] != "}":
            i = self.value(i)
            if s[i] == ":":
                i = self.value(i + 1)
            if s[i] == ",":
                i = self.lines(i + 1)
            elif s[i] != "}":
                raise Bad(i, "'}'")
        self.head = kept
        return i + 1

    def value(self, i: int) -> int:
        return self.literal(i) if self.s[i] == "{" else self.expr(i)

    def postfix(self, i: int) -> int:
        s = self.s
        while True:
            c = s[i]
            if c == ".":
                if s[i + 1] == "(":
                    i = self.want(i + 3 if s[i + 2] == K["type"] else self.type(i + 2), ")")
                else:
                    i = self.want(i + 1, "i", "a name")
            elif c == "(":
                kept, self.head = self.head, False
                i += 1
                while s[i] != ")":
                    i = self.type(i) if s[i] in "[" + _k("map chan struct interface") and not self.is_literal(i) else self.expr(i)
                    if s[i] == "e":
                        i += 1
                    if s[i] == ",":
                        i = self.lines(i + 1)
                    elif s[i] != ")":
                        raise Bad(i, "')'")
                self.head = kept
                i += 1
            elif c == "[":
                kept, self.head = self.head, False
                i += 1
                if s[i] != ":":
                    i = self.type(i) if s[i] in "*[" + _k("map") else self.expr(i)
                    while s[i] == ",":
                        i = self.type(i + 1)
                while s[i] == ":":
                    i += 1
                    if s[i] not in ":]":
                        i = self.expr(i)
                self.head = kept
                i = self.want(i, "]")
            elif c == "{" and not self.head and s[i - 1] in "i]":
                i = self.literal(i)
            else:
                return i

    def is_literal(self, i: int) -> bool:
        try:
            return self.s[self.type(i)] in "{("
        except Bad:
            return True

    def exprs(self, i: int) -> int:
        i = self.expr(i)
        while self.s[i] == ",":
            i = self.expr(i + 1)
        return i

    # -- statements
    def recover(self, i: int) -> int:
        s, depth = self.s, 0
        while s[i] != END:
            c = s[i]
            if c == "{":
                depth += 1
            elif c == "}":
                if not depth:
                    return i
                depth -= 1
            elif c in "N;" and not depth:
                return i + 1
            i += 1
        return i

    def parse(self) -> list[tuple[int, str]]:
        self.statement, self.inner = self.top, self.statement
        s = self.s
        i = self.lines(0)
        if s[i] != END and s[i] != K["package"]:
            self.errors.append((i, "package"))
        return super().parse()

    def top(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in "N;":
            return i + 1
        if c == K["package"]:
            return self.ends(self.want(i + 1, "i", "a name"))
        if c == K["import"]:
            return self.ends(self.group(i + 1, self.import_))
        if c == K["func"]:
            i += 1
            if s[i] == "(":
                i = self.parameters(i)
            i = self.want(i, "i", "a name")
            if s[i] == "[":
                i = self.type_parameters(i)
            i = self.signature(i)
            return self.ends(self.block(i) if s[i] == "{" else i)
        if c in _k("type var const"):
            return self.declaration(i)
        raise Bad(i, "a declaration")

    def type_parameters(self, i: int) -> int:
        s = self.s
        i += 1
        while s[i] != "]":
            i = self.interface_item(self.names(i))
            if s[i] == ",":
                i += 1
            elif s[i] != "]":
                raise Bad(i, "']'")
        return i + 1

    def group(self, i: int, item) -> int:
        s = self.s
        if s[i] != "(":
            return item(i)
        i = self.lines(i + 1)
        while s[i] != ")":
            i = self.lines(self.ends(item(i)))
            if s[i] == END:
                raise Bad(i, "')'")
        return i + 1

    def import_(self, i: int) -> int:
        if self.s[i] in "i.":
            i += 1
        return self.want(i, '"', "a path")

    def declaration(self, i: int) -> int:
        c = self.s[i]
        return self.ends(self.group(i + 1, self.type_spec if c == K["type"] else self.value_spec))

    def type_spec(self, i: int) -> int:
        s = self.s
        i = self.want(i, "i", "a name")
        if s[i] == "[" and s[i + 1] == "i" and s[i + 2] not in "]":
            i = self.type_parameters(i)
        return self.type(i + 1 if s[i] == "=" else i)

    def value_spec(self, i: int) -> int:
        s = self.s
        i = self.names(i)
        if s[i] in TYPE_STARTS:
            i = self.type(i)
        return self.exprs(i + 1) if s[i] == "=" else i

    def block(self, i: int) -> int:
        i = self.statements(self.want(i, "{"), "}", self.inner)
        return i + 1 if self.s[i] == "}" else i

    def statement(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == "i" and s[i + 1] == ":" and s[i + 2] in "N" + _k("for switch select"):
            return i + 2
        if c in 'i(*h"0[&-!' + _k("func map struct"):
            return self.ends(self.simple(i))
        if c in "N;":
            return i + 1
        if c == K["if"]:
            return self.ends(self.if_(i))
        if c == K["return"]:
            return self.ends(i + 1 if s[i + 1] in "N;}" else self.exprs(i + 1))
        if c == K["for"]:
            return self.ends(self.for_(i + 1))
        if c in _k("type var const"):
            return self.declaration(i)
        if c == "{":
            return self.ends(self.block(i))
        if c in _k("break continue goto fallthrough"):
            return self.ends(i + 2 if s[i + 1] == "i" else i + 1)
        if c in _k("go defer"):
            return self.ends(self.expr(i + 1))
        if c == K["switch"] or c == K["select"]:
            return self.ends(self.switch(i + 1))
        raise Bad(i, "a statement")

    def simple(self, i: int) -> int:
        s = self.s
        i = self.exprs(i)
        if s[i] in "=aw":
            i += 1
            return self.exprs(i + 1 if s[i] == K["range"] else i)
        if s[i] == ">" and s[i + 1] in ">a":
            return self.exprs(i + 2)
        if s[i] == "u":
            return i + 1
        return self.expr(i + 1) if s[i] == "h" else i

    def if_(self, i: int) -> int:
        s = self.s
        kept, self.head = self.head, True
        i += 1
        if s[i] != ";":
            i = self.simple(i)
        if s[i] == ";":
            i = self.simple(i + 1)
        self.head = kept
        i = self.block(i)
        if s[i] == K["else"]:
            return self.if_(i + 1) if s[i + 1] == K["if"] else self.block(i + 1)
        return i

    def for_(self, i: int) -> int:
        s = self.s
        kept, self.head = self.head, True
        if s[i] == K["range"]:
            i = self.expr(i + 1)
        elif s[i] != "{":
            if s[i] != ";":
                i = self.simple(i)
            if s[i] == ";":
                i += 1
                if s[i] != ";":
                    i = self.expr(i)
                i = self.want(i, ";")
                if s[i] != "{":
                    i = self.simple(i)
        self.head = kept
        return self.block(i)

    def switch(self, i: int) -> int:
        s = self.s
        kept, self.head = self.head, True
        if s[i] != "{":
            if s[i] != ";":
                i = self.simple(i)
            if s[i] == ";":
                i += 1
                if s[i] != "{":
                    i = self.simple(i)
        self.head = kept
        i = self.lines(self.want(i, "{"))
        while s[i] != "}":
            if s[i] == K["default"]:
                i += 1
            else:
                i = self.want(i, K["case"], "case")
                while True:
                    i = self.type(i) if s[i] in "*[" + _k("map chan func struct interface") else self.simple(i)
                    if s[i] != ",":
                        break
                    i = self.lines(i + 1)
            i = self.want(i, ":")
            i = self.lines(i)
            while s[i] not in (K["case"], K["default"], "}"):
                if s[i] == END:
                    raise Bad(i, "'}'")
                i = self.lines(self.inner(i))
        return i + 1
