"""Rust."""

from __future__ import annotations

from graphloom.llm.syntax.base import Bad, Grammar, flat_pattern
from graphloom.llm.syntax.lexer import END, RUST

K = RUST.keywords


def _k(words: str) -> str:
    return "".join(K[w] for w in words.split())


NAMES = "i" + RUST.soft
PATHS = NAMES + _k("self Self super crate")
BLOCKS = _k("if match while loop for unsafe")
ITEMS = _k("fn struct enum impl trait use mod const static type extern pub unsafe")


class Rust(Grammar):
    lexer = RUST
    POWER = {"e": 0, "b": 3, "|": 4, "&": 5, "^": 4, "<": 3, ">": 3, "+": 6, "-": 6, "*": 7, "/": 7, "%": 7}
    PREFIX = "!-*"
    flat = flat_pattern("i", r"b+\-*/%", r"\.")
    #: Struct literals are not allowed before the block of if, while, match and for.
    head = False
    CLOSERS = frozenset(";),]}" + END)

    def expr(self, i: int) -> int:
        m = self.flat.match(self.s, i)
        if m:
            c = self.s[m.end()]
            if c in self.CLOSERS or c == "{" and self.head:
                return m.end()
        return self.assignment(i)

    # -- types and paths
    def generics(self, i: int) -> int:
        """<...> of a path: types, lifetimes, bindings."""
        s = self.s
        i += 1
        while s[i] != ">":
            if s[i] == "L":
                i += 1
            elif s[i] in '0"-' or s[i] in _k("true false"):
                i = self.unary(i)
            elif s[i] == "{":
                i = self.block(i)
            else:
                i = self.type(i)
                if s[i] == "=":
                    i = self.type(i + 1)
                elif s[i] == ":":
                    i = self.bounds(i + 1)
            if s[i] == ",":
                i += 1
            elif s[i] != ">":
                raise Bad(i, "'>'")
        return i + 1

    def path(self, i: int, types: bool) -> int:
        s = self.s
        if s[i] == "c":
            i += 1
        while True:
            if s[i] not in PATHS:
                raise Bad(i, "a name")
            i += 1
            if types and s[i] == "<":
                i = self.generics(i)
            elif types and s[i] == "(":
                i = self.listed(i + 1, self.type, ")")
                if s[i] == "r":
                    i = self.type(i + 1)
            if s[i] != "c":
                return i
            i += 1
            if s[i] == "<":
                i = self.generics(i)
                if s[i] != "c":
                    return i
                i += 1

    def type(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in PATHS or c == "c":
            i = self.path(i, True)
            return self.bounds(i + 1) if s[i] == "+" else i
        if c == "&" or c == "b":
            i += 1
            if s[i] == "L":
                i += 1
            if s[i] == K["mut"]:
                i += 1
            return self.type(i)
        if c == "*":
            if s[i + 1] not in _k("const mut"):
                raise Bad(i + 1, "const")
            return self.type(i + 2)
        if c == "(":
            return self.listed(i + 1, self.type, ")")
        if c == "[":
            i = self.type(i + 1)
            if s[i] == ";":
                i = self.expr(i + 1)
            return self.want(i, "]")
        if c == K["dyn"] or c == K["impl"]:
            return self.bounds(i + 1)
        if c in "!":
            return i + 1
        if c in _k("fn unsafe extern for"):
            if c == K["for"]:
                i = self.generics(i + 1)
            while s[i] in _k("unsafe extern") + '"':
                i += 1
            i = self.listed(self.want(self.want(i, K["fn"]), "("), self.fn_type_parameter, ")")
            return self.type(i + 1) if s[i] == "r" else i
        if c == "<":
            i = self.type(i + 1)
            if s[i] == K["as"]:
                i = self.type(i + 1)
            return self.path(self.want(self.want(i, ">"), "c"), True)
        raise Bad(i, "a type")

    def fn_type_parameter(self, i: int) -> int:
        if self.s[i] in NAMES and self.s[i + 1] == ":":
            i += 2
        return self.type(i)

    def bounds(self, i: int) -> int:
        s = self.s
        while True:
            if s[i] == "L":
                i += 1
            elif s[i] in "?(" or s[i] in PATHS or s[i] in _k("for") or s[i] == "c":
                if s[i] == "?":
                    i += 1
                if s[i] == K["for"]:
                    i = self.generics(i + 1)
                i = self.want(self.bounds(i + 1), ")") if s[i] == "(" else self.path(i, True)
            if s[i] != "+":
                return i
            i += 1

    def type_parameters(self, i: int) -> int:
        return self.listed(i + 1, self.type_parameter, ">") if self.s[i] == "<" else i

    def type_parameter(self, i: int) -> int:
        s = self.s
        i = self.attributes(i)
        if s[i] == K["const"]:
            i = self.type(self.want(i + 2, ":"))
            return self.unary(i + 1) if s[i] == "=" else i
        if s[i] not in NAMES + "L":
            raise Bad(i, "a name")
        i += 1
        if s[i] == ":":
            i = self.bounds(i + 1)
        return self.type(i + 1) if s[i] == "=" else i

    def where(self, i: int) -> int:
        s = self.s
        if s[i] != K["where"]:
            return i
        i += 1
        while s[i] not in "{;=":
            i = i + 1 if s[i] == "L" else self.type(i)
            i = self.bounds(self.want(i, ":"))
            if s[i] == ",":
                i += 1
            elif s[i] not in "{;=":
                raise Bad(i, "'{'")
        return i

    # -- patterns
    def pattern(self, i: int) -> int:
        s = self.s
        if s[i] == "|":
            i += 1
        i = self.pattern_item(i)
        while s[i] == "|":
            i = self.pattern_item(i + 1)
        return i

    def pattern_item(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == "&" or c == "b":
            return self.pattern_item(i + 1)
        if c in _k("ref mut"):
            return self.pattern_item(i + 1)
        if c == "(":
            return self.listed(i + 1, self.pattern, ")")
        if c == "[":
            return self.listed(i + 1, self.pattern, "]")
        if c == "e":
            return i + 2 if s[i + 1] in '0"' else i + 1
        if c == "-" and s[i + 1] == "0" or c in '0"' or c in _k("true false"):
            i += 2 if c == "-" else 1
        elif c in PATHS or c == "c":
            i = self.path(i, False)
            if s[i] == "@":
                return self.pattern_item(i + 1)
            if s[i] == "!":
                return self.match(i + 1)
            if s[i] == "(":
                return self.listed(i + 1, self.pattern, ")")
            if s[i] == "{":
                return self.listed(i + 1, self.field_pattern, "}")
        else:
            raise Bad(i, "a pattern")
        if s[i] == "e":
            i += 1
            if s[i] in '0"-' or s[i] in PATHS:
                i = self.pattern_item(i)
        return i

    def field_pattern(self, i: int) -> int:
        s = self.s
        if s[i] == "e":
            return i + 1
        if s[i] in NAMES + "0" and s[i + 1] == ":":
            i += 2
        return self.pattern(i)

    # -- expressions
    def assignment(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == K["return"] or c == K["break"]:
            i += 1
            if s[i] == "L":
                i += 1
            return i if s[i] in ";),]}" + END or self.head and s[i] == "{" else self.assignment(i)
        if c == K["continue"]:
            return i + 2 if s[i + 1] == "L" else i + 1
        if c == "e":
            return i + 1 if s[i + 1] in ";),]}{" else self.climb(i + 1, 1)
        i = self.climb(i, 0)
        if s[i] in "=a":
            return self.assignment(i + 1)
        if s[i] == ">" and s[i + 1] in "a":
            return self.assignment(i + 2)
        return i

    def climb(self, i: int, least: int) -> int:
        s, power = self.s, self.POWER
        i = self.unary(i)
        while (p := power.get(s[i], -1)) >= least:
            c = s[i]
            i += 1
            if c in "<>" and s[i] == c:
                i += 1
            if c == "e" and (s[i] in ";),]}" or s[i] == "{" and self.head or s[i] == "f"):
                return i
            i = self.climb(i, p + 1)
        return i

    def unary(self, i: int) -> int:
        s = self.s
        while s[i] in "!-*&" or s[i] == "b":
            if s[i] == "b" and self.text_at(i) != "&&":
                raise Bad(i, "an expression")
            i += 1
            if s[i] == K["mut"]:
                i += 1
        i = self.postfix(self.primary(i))
        while s[i] == K["as"]:
            i = self.type(i + 1)
        return i

    def text_at(self, i: int) -> str:
        o = self.lexer.offsets(self.text)[i]
        return self.text[o : o + 2]

    def free(self, f, i: int) -> int:
        kept, self.head = self.head, False
        i = f(i)
        self.head = kept
        return i

    def primary(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in PATHS or c == "c":
            i = self.path(i, False)
            if s[i] == "!" and s[i + 1] in "([{":
                return self.match(i + 1)
            if s[i] == "{" and not self.head:
                return self.free(lambda j: self.listed(j + 1, self.field, "}"), i)
            return i
        if c in '0"' or c in _k("true false"):
            return i + 1
        if c == "(":
            return self.free(lambda j: self.listed(j + 1, self.expr, ")"), i)
        if c == "[":
            return self.free(self.array, i)
        if c == "{":
            return self.free(self.block, i)
        if c in BLOCKS or c == K["async"] and s[i + 1] in "{" + K["move"] and s[i + 2] not in "|":
            return self.block_like(i)
        if c == "L" and s[i + 1] == ":":
            return self.block_like(i + 2)
        if c in "|b" + _k("move async"):
            return self.closure(i)
        if c == "<":
            return self.type(i)
        raise Bad(i, "an expression")

    def field(self, i: int) -> int:
        s = self.s
        i = self.attributes(i)
        if s[i] == "e":
            return self.expr(i + 1) if s[i + 1] != "}" else i + 1
        if s[i] not in NAMES + "0":
            raise Bad(i, "a name")
        return self.expr(i + 2) if s[i + 1] == ":" else i + 1

    def array(self, i: int) -> int:
        s = self.s
        i += 1
        if s[i] == "]":
            return i + 1
        i = self.expr(i)
        if s[i] == ";":
            return self.want(self.expr(i + 1), "]")
        if s[i] == ",":
            return self.listed(i + 1, self.expr, "]")
        return self.want(i, "]")

    def closure(self, i: int) -> int:
        s = self.s
        while s[i] in _k("move async"):
            i += 1
        if s[i] == "b":
            i += 1
        else:
            i = self.listed(self.want(i, "|"), self.closure_parameter, "|")
        if s[i] == "r":
            return self.free(self.block, self.type(i + 1))
        return self.assignment(i)

    def closure_parameter(self, i: int) -> int:
        i = self.pattern_item(i)
        return self.type(i + 1) if self.s[i] == ":" else i

    def condition(self, i: int) -> int:
        s = self.s
        kept, self.head = self.head, True
        while True:
            if s[i] == K["let"]:
                i = self.want(self.pattern(i + 1), "=")
                i = self.climb(i, 4)
            else:
                i = self.expr(i)
            if s[i] != "b":
                break
            i += 1
        self.head = kept
        return i

    def block_like(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == K["if"]:
            i = self.free(self.block, self.condition(i + 1))
            if s[i] == K["else"]:
                return self.block_like(i + 1) if s[i + 1] == K["if"] else self.free(self.block, i + 1)
            return i
        if c == K["while"]:
            return self.free(self.block, self.condition(i + 1))
        if c == K["for"]:
            i = self.want(self.pattern(i + 1), K["in"], "in")
            return self.free(self.block, self.condition(i))
        if c == K["match"]:
            return self.free(self.arms, self.condition(i + 1))
        if c in _k("loop unsafe async"):
            i += 1
            if s[i] == K["move"]:
                i += 1
        return self.free(self.block, i)

    def arms(self, i: int) -> int:
        s = self.s
        i = self.want(i, "{")
        while s[i] != "}":
            i = self.pattern(self.attributes(i))
            if s[i] == K["if"]:
                i = self.expr(i + 1)
            i = self.want(i, "f")
            blocky = s[i] == "{" or s[i] in BLOCKS
            i = self.expr(i)
            if s[i] == ",":
                i += 1
            elif s[i] != "}" and not blocky:
                raise Bad(i, "','")
        return i + 1

    def postfix(self, i: int) -> int:
        s = self.s
        while True:
            c = s[i]
            if c == ".":
                i += 1
                if s[i] in NAMES + "0" or s[i] == K["await"]:
                    i += 1
                else:
                    raise Bad(i, "a name")
                if s[i] == "c":
                    i = self.generics(self.want(i + 1, "<") - 1)
            elif c == "(":
                i = self.free(lambda j: self.listed(j + 1, self.expr, ")"), i)
            elif c == "[":
                i = self.free(lambda j: self.want(self.expr(j + 1), "]"), i)
            elif c == "?":
                i += 1
            else:
                return i

    # -- items
    def attributes(self, i: int) -> int:
        s = self.s
        while s[i] == "#" and (s[i + 1] == "[" or s[i + 1] == "!" and s[i + 2] == "["):
            j = self.match(i + 1 if s[i + 1] == "[" else i + 2)
            if s[j - 1] != "]":
                raise Bad(j, "']'")
            i = j
        return i

    def parse(self) -> list[tuple[int, str]]:
        self.statement, self.inner = self.item, self.statement
        return super().parse()

    def item(self, i: int) -> int:
        s = self.s
        i = self.attributes(i)
        if s[i] == ";":
            return i + 1
        i = self.visibility(i)
        c = s[i]
        while c in _k("const async unsafe extern") and s[i + 1] in _k("fn unsafe extern async impl trait") + '"':
            i += 2 if s[i + 1] == '"' else 1
            c = s[i]
        if c == K["fn"]:
            return self.function(i)
        if c == K["use"]:
            return self.want(self.use(i + 1), ";")
        if c == K["struct"] or c == K["union"] and s[i + 1] in NAMES:
            return self.struct(i + 1)
        if c == K["enum"]:
            i = self.where(self.type_parameters(self.name(i + 1)))
            return self.listed(self.want(i, "{"), self.variant, "}")
        if c == K["impl"]:
            return self.impl(i + 1)
        if c == K["trait"]:
            i = self.type_parameters(self.name(i + 1))
            if s[i] == ":":
                i = self.bounds(i + 1)
            return self.body(self.where(i))
        if c == K["mod"]:
            i = self.name(i + 1)
            return i + 1 if s[i] == ";" else self.body(i)
        if c in _k("const static"):
            i += 1
            if s[i] == K["mut"]:
                i += 1
            i = self.type(self.want(self.name(i), ":"))
            return self.want(self.expr(i + 1) if s[i] == "=" else i, ";")
        if c == K["type"]:
            i = self.type_parameters(self.name(i + 1))
            if s[i] == ":":
                i = self.bounds(i + 1)
            i = self.where(i)
            return self.want(self.type(i + 1) if s[i] == "=" else i, ";")
        if c == K["extern"]:
            if s[i + 1] == K["crate"]:
                i = self.name(i + 2)
                return self.want(i + 2 if s[i] == K["as"] else i, ";")
            return self.body(i + 2 if s[i + 1] == '"' else i + 1)
        if c in PATHS:
            j = self.path(i, False)
            if s[j] == "!":
                j += 1
                if s[j] in NAMES:
                    j += 1
                brace = s[j] == "{"
                if s[j] not in "([{":
                    raise Bad(j, "'('")
                k = self.match(j)
                return k if brace else self.want(k, ";")
        raise Bad(i, "an item")

    def visibility(self, i: int) -> int:
        s = self.s
        if s[i] == K["pub"]:
            i += 1
            if s[i] == "(" and s[i + 1] in _k("crate super self in"):
                i = self.match(i)
        return i

    def name(self, i: int) -> int:
        if self.s[i] not in NAMES:
            raise Bad(i, "a name")
        return i + 1

    def use(self, i: int) -> int:
        s = self.s
        if s[i] == "c":
            i += 1
        while True:
            if s[i] == "{":
                return self.listed(i + 1, self.use, "}")
            if s[i] == "*":
                return i + 1
            if s[i] not in PATHS:
                raise Bad(i, "a name")
            i += 1
            if s[i] == K["as"]:
                return i + 2
            if s[i] != "c":
                return i
            i += 1

    def function(self, i: int) -> int:
        s = self.s
        i = self.type_parameters(self.name(i + 1))
        i = self.listed(self.want(i, "("), self.parameter, ")")
        if s[i] == "r":
            i = self.type(i + 1)
        i = self.where(i)
        return i + 1 if s[i] == ";" else self.block(i)

    def parameter(self, i: int) -> int:
        s = self.s
        i = self.attributes(i)
        j = i
        if s[j] == "&":
            j += 1
            if s[j] == "L":
                j += 1
        if s[j] == K["mut"]:
            j += 1
        if s[j] == K["self"]:
            return self.type(j + 2) if s[j + 1] == ":" else j + 1
        return self.type(self.want(self.pattern_item(i), ":"))

    def struct(self, i: int) -> int:
        s = self.s
        i = self.where(self.type_parameters(self.name(i)))
        if s[i] == ";":
            return i + 1
        if s[i] == "(":
            i = self.listed(i + 1, self.tuple_field, ")")
            return self.want(self.where(i), ";")
        return self.listed(self.want(i, "{"), self.struct_field, "}")

    def struct_field(self, i: int) -> int:
        return self.type(self.want(self.name(self.visibility(self.attributes(i))), ":"))

    def tuple_field(self, i: int) -> int:
        return self.type(self.visibility(self.attributes(i)))

    def variant(self, i: int) -> int:
        s = self.s
        i = self.name(self.attributes(i))
        if s[i] == "(":
            i = self.listed(i + 1, self.tuple_field, ")")
        elif s[i] == "{":
            i = self.listed(i + 1, self.struct_field, "}")
        return self.expr(i + 1) if s[i] == "=" else i

    def impl(self, i: int) -> int:
        s = self.s
        i = self.type_parameters(i)
        i = self.type(i + 1 if s[i] == "!" else i)
        if s[i] == K["for"]:
            i = self.type(i + 1)
        return self.body(self.where(i))

    def body(self, i: int) -> int:
        i = self.statements(self.want(i, "{"), "}", self.item)
        return i + 1 if self.s[i] == "}" else i

    # -- statements
    def block(self, i: int) -> int:
        i = self.statements(self.want(i, "{"), "}", self.inner)
        return i + 1 if self.s[i] == "}" else i

    def statement(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == K["let"]:
            i = self.pattern(i + 1)
            if s[i] == ":":
                i = self.type(i + 1)
            if s[i] == "=":
                i = self.expr(i + 1)
                if s[i] == K["else"]:
                    i = self.block(i + 1)
            return self.want(i, ";")
        if c == ";":
            return i + 1
        if c == "#":
            return self.inner(self.attributes(i))
        if c in BLOCKS and not (c == K["unsafe"] and s[i + 1] != "{") or c == "{" or c == "L":
            i = self.block_like(i + 2 if c == "L" else i)
            if s[i] in ".?":
                i = self.postfix(i)
                return i if s[i] == "}" else self.want(i, ";")
            return i + 1 if s[i] == ";" else i
        if c in ITEMS:
            return self.item(i)
        if c in NAMES and s[i + 1] == "!" and s[i + 2] == "{":
            return self.match(i + 2)
        i = self.expr(i)
        return i if s[i] == "}" else self.want(i, ";")
