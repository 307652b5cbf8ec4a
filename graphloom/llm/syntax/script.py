"""JavaScript and TypeScript."""

from __future__ import annotations

from graphloom.llm.syntax.base import Bad, Grammar, flat_pattern
from graphloom.llm.syntax.lexer import END, JS

K = JS.keywords


def _k(words: str) -> str:
    return "".join(K[w] for w in words.split())


SOFT = JS.soft
NAMES = "i" + SOFT
MODIFIERS = _k("async static get set public private protected readonly abstract override declare")
DECLARING = _k("var let const")


class JavaScript(Grammar):
    lexer = JS
    typed = False
    POWER = {"b": 3, "|": 2, "&": 2, "^": 2, "<": 4, ">": 4, K["in"]: 4, K["instanceof"]: 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}
    PREFIX = "!-+~u" + _k("typeof void delete await")
    flat = flat_pattern(NAMES, r"b+\-*/%<>", r"\.")

    def __init__(self, text: str, codes: str | None = None):
        super().__init__(text, codes)
        self.at: list[int] | None = None

    def newline_before(self, i: int) -> bool:
        if self.at is None:
            self.at = self.lexer.offsets(self.text)
        return "\n" in self.text[self.at[i - 1] : self.at[i]] if i else True

    def semi(self, i: int) -> int:
        c = self.s[i]
        if c == ";":
            return i + 1
        if c == "}" or c == END or self.newline_before(i):
            return i
        raise Bad(i, "';'")

    # -- expressions
    def assignment(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == K["async"] and s[i + 1] in NAMES + "(" and (s[i + 1] == "(" and s[self.match(i + 1)] in "f:" or s[i + 2] == "f"):
            i += 1
            c = s[i]
        elif c == K["async"] and s[i + 1] == "<" and self.typed and self.arrow(i + 1):
            return self.arrow(i + 1)
        if c == K["yield"]:
            i += 1
            if s[i] == "*":
                i += 1
            return i if s[i] in ";),]}" + END else self.assignment(i)
        if c in NAMES and s[i + 1] == "f":
            return self.arrow_body(i + 2)
        if c == "(" or c == "<" and self.typed:
            after = self.arrow(i)
            if after:
                return after
        i = self.ternary(i)
        if s[i] in "=a":
            return self.assignment(i + 1)
        if s[i] == ">" and s[i + 1] in "=a>":  # >>=
            return self.assignment(i + 2)
        return i

    def arrow(self, i: int) -> int:
        """The end of an arrow function that begins at i, 0 if none does."""
        s = self.s
        if s[i] == "<":
            try:
                i = self.type_parameters(i)
            except Bad:
                return 0
            if s[i] != "(":
                return 0
        j = self.match(i)
        if s[j] == "f":
            j = self.parameters(i)
            return self.arrow_body(self.want(j, "f"))
        if s[j] == ":" and self.typed:
            try:
                j = self.type(self.parameters(i) + 1)
                if s[j] == "f":
                    return self.arrow_body(j + 1)
            except Bad:
                pass
        return 0

    def arrow_body(self, i: int) -> int:
        return self.block(i) if self.s[i] == "{" else self.assignment(i)

    def primary(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in NAMES or c in '0"':
            if c == K["async"] and s[i + 1] == K["function"]:
                return self.function(i + 1)
            return i + 1
        if c in THIS:
            return i + 1
        if c == "(":
            i = self.expr(i + 1)
            while s[i] == ",":
                i = self.expr(i + 1)
            return self.want(i, ")")
        if c == "[":
            return self.listed(i + 1, self.element, "]")
        if c == "{":
            return self.listed(i + 1, self.property, "}")
        if c == K["function"]:
            return self.function(i)
        if c == K["class"]:
            return self.class_(i)
        if c == K["new"]:
            if s[i + 1] == "." and s[i + 2] in NAMES:
                return i + 3
            return self.primary(i + 1)
        if c == K["import"] and s[i + 1] in "(.":
            return i + 1
        if c == "<" and self.typed:
            return self.unary(self.want(self.type(i + 1), ">"))
        raise Bad(i, "an expression")

    def postfix(self, i: int) -> int:
        s = self.s
        while True:
            c = s[i]
            if c == "." or c == "q":
                i += 1
                d = s[i]
                if c == "q" and d in "([":
                    continue
                if d == "i" or d == "P" or d >= "一":
                    i += 1
                else:
                    raise Bad(i, "a name")
            elif c == "(":
                i = self.listed(i + 1, self.element, ")")
            elif c == "[":
                i = self.want(self.expr(i + 1), "]")
            elif c == "u":
                if self.newline_before(i):
                    return i
                i += 1
            elif c == '"' and s[i - 1] not in '0"' and self.text[self._offset(i)] == "`":
                i += 1
            elif self.typed and c == "!" and not self.newline_before(i):
                i += 1
            elif self.typed and c in AS:
                i = self.type(i + 1)
            elif self.typed and c == "<":
                try:
                    j = self.want(self.listed(i + 1, self.type, ">", False), "(")
                except Bad:
                    return i
                i = j - 1
            else:
                return i

    def _offset(self, i: int) -> int:
        if self.at is None:
            self.at = self.lexer.offsets(self.text)
        return self.at[i]

    def element(self, i: int) -> int:
        if self.s[i] == ",":
            return i
        return self.expr(i + 1 if self.s[i] == "e" else i)

    def property(self, i: int) -> int:
        s = self.s
        if s[i] == "e":
            return self.expr(i + 1)
        while (s[i] in MODIFIERS or s[i] == "*") and s[i + 1] not in ",:}(=":
            i += 1
        plain = s[i] in NAMES
        i = self.property_name(i)
        if s[i] == "(":
            return self.function_rest(i)
        if s[i] == ":":
            return self.expr(i + 1)
        if plain:
            return self.expr(i + 1) if s[i] == "=" else i
        raise Bad(i, "':'")

    def property_name(self, i: int) -> int:
        c = self.s[i]
        if c == "[":
            return self.want(self.expr(i + 1), "]")
        if c in 'i0"P' or c >= "一":
            return i + 1
        raise Bad(i, "a name")

    # -- functions and classes
    def function(self, i: int) -> int:
        s = self.s
        i += 1
        if s[i] == "*":
            i += 1
        if s[i] in NAMES:
            i += 1
        return self.function_rest(i)

    def function_rest(self, i: int, bodyless: bool = False) -> int:
        if self.typed:
            i = self.type_parameters(i)
        i = self.parameters(i)
        if self.typed and self.s[i] == ":":
            i = self.type(i + 1)
        if bodyless and self.s[i] != "{":
            return self.semi(i)
        return self.block(i)

    def parameters(self, i: int) -> int:
        return self.listed(self.want(i, "("), self.parameter, ")")

    def parameter(self, i: int) -> int:
        s = self.s
        while s[i] == "@":
            i = self.decorator(i)
        if self.typed:
            while s[i] in MODIFIERS and s[i + 1] in NAMES:
                i += 1
        if s[i] == "e":
            i += 1
        i = i + 1 if self.typed and s[i] == K["this"] else self.pattern(i)
        if self.typed:
            if s[i] == "?":
                i += 1
            if s[i] == ":":
                i = self.type(i + 1)
        return self.expr(i + 1) if s[i] == "=" else i

    def pattern(self, i: int) -> int:
        s = self.s
        if s[i] in NAMES:
            return i + 1
        if s[i] == "{":
            return self.listed(i + 1, self.pattern_property, "}")
        if s[i] == "[":
            return self.listed(i + 1, self.pattern_element, "]")
        raise Bad(i, "a name")

    def pattern_property(self, i: int) -> int:
        s = self.s
        if s[i] == "e":
            return self.pattern(i + 1)
        plain = s[i] in NAMES
        i = self.property_name(i)
        if s[i] == ":":
            i = self.pattern(i + 1)
        elif not plain:
            raise Bad(i, "':'")
        return self.expr(i + 1) if s[i] == "=" else i

    def pattern_element(self, i: int) -> int:
        s = self.s
        if s[i] == ",":
            return i
        i = self.pattern(i + 1 if s[i] == "e" else i)
        return self.expr(i + 1) if s[i] == "=" else i

    def decorator(self, i: int) -> int:
        i = self.want(i, "@")
        return self.postfix(self.primary(i))

    def class_(self, i: int) -> int:
        s = self.s
        i += 1
        if s[i] in NAMES and s[i] != K["implements"]:
            i += 1
        if self.typed:
            i = self.type_parameters(i)
        if s[i] == K["extends"]:
            i = self.postfix(self.primary(i + 1))
            if self.typed and s[i] == "<":
                i = self.listed(i + 1, self.type, ">", False)
        if self.typed and s[i] == K["implements"]:
            i = self.type(i + 1)
            while s[i] == ",":
                i = self.type(i + 1)
        i = self.statements(self.want(i, "{"), "}", self.member)
        return i + 1 if s[i] == "}" else i

    def member(self, i: int) -> int:
        s = self.s
        if s[i] == ";":
            return i + 1
        while s[i] == "@":
            i = self.decorator(i)
        allowed = MODIFIERS if self.typed else PLAIN_MODIFIERS
        while (s[i] in allowed and s[i + 1] not in "(=;:}?" or s[i] == "*") and s[i] != END:
            if s[i] == K["static"] and s[i + 1] == "{":
                return self.block(i + 1)
            i += 1
        if self.typed and s[i] == "[" and s[i + 1] in NAMES and s[i + 2] == ":":
            return self.semi(self.type_member(i))
        i = self.property_name(i)
        if self.typed and s[i] in "?!":
            i += 1
        if s[i] == "(" or s[i] == "<" and self.typed:
            return self.function_rest(i, bodyless=self.typed)
        if s[i] == ":" and self.typed:
            i = self.type(i + 1)
        if s[i] == "=":
            i = self.expr(i + 1)
        return self.semi(i)

    # -- types
    def type_parameters(self, i: int) -> int:
        return self.listed(i + 1, self.type_parameter, ">", False) if self.s[i] == "<" else i

    def type_parameter(self, i: int) -> int:
        s = self.s
        if s[i] not in NAMES + K["const"]:
            raise Bad(i, "a name")
        i += 1
        if s[i] == K["extends"]:
            i = self.type(i + 1)
        return self.type(i + 1) if s[i] == "=" else i

    def type(self, i: int) -> int:
        s = self.s
        if s[i] in "|&":
            i += 1
        i = self.type_operand(i)
        while s[i] in "|&":
            i = self.type_operand(i + 1)
        if s[i] == K["is"]:
            return self.type(i + 1)
        if s[i] == K["extends"] and not self.newline_before(i):
            i = self.want(self.type(i + 1), "?")
            i = self.want(self.type(i), ":")
            return self.type(i)
        return i

    def type_operand(self, i: int) -> int:
        s = self.s
        while s[i] in TYPE_PREFIX and s[i + 1] in "i([{\"" + SOFT:
            i += 1
        c = s[i]
        if c == "(":
            j = self.match(i)
            if s[j] == "f":
                return self.type(self.want(self.parameters(i), "f"))
            i = self.want(self.type(i + 1), ")")
        elif c == "<":
            i = self.parameters(self.type_parameters(i))
            return self.type(self.want(i, "f"))
        elif c == K["new"]:
            i = self.parameters(self.type_parameters(i + 1))
            return self.type(self.want(i, "f"))
        elif c == "{":
            i += 1
            while s[i] != "}":
                i = self.type_member(i)
                if s[i] in ",;":
                    i += 1
                elif s[i] != "}" and not self.newline_before(i):
                    raise Bad(i, "';'")
            i += 1
        elif c == "[":
            i = self.listed(i + 1, self.tuple_item, "]")
        elif c in NAMES or c in VOID:
            i += 1
            while s[i] == ".":
                i = self.want(i + 1, "i")
            if s[i] == "<":
                i = self.listed(i + 1, self.type, ">", False)
        elif c in '0"' or c in THIS:
            i += 1
        elif c == "-" and s[i + 1] == "0":
            i += 2
        else:
            raise Bad(i, "a type")
        while s[i] == "[" and not self.newline_before(i):
            i = i + 2 if s[i + 1] == "]" else self.want(self.type(i + 1), "]")
        return i

    def tuple_item(self, i: int) -> int:
        s = self.s
        if s[i] == "e":
            i += 1
        if s[i] in NAMES and s[i + 1] == ":":
            i += 2
        i = self.type(i)
        return i + 1 if s[i] == "?" else i

    def type_member(self, i: int) -> int:
        s = self.s
        while s[i] in MODIFIERS and s[i + 1] not in "(?:;,}":
            i += 1
        if s[i] == "[" and s[i + 1] in NAMES and s[i + 2] in ":" + K["in"]:
            i = self.want(self.type(i + 3), "]")
        elif s[i] == "(" or s[i] == "<":
            pass
        elif s[i] == K["new"] and s[i + 1] == "(":
            i += 1
        else:
            i = self.property_name(i)
        if s[i] == "?":
            i += 1
        if s[i] in "(<":
            i = self.parameters(self.type_parameters(i))
        return self.type(i + 1) if s[i] == ":" else i

    # -- statements
    def declarators(self, i: int, loop: bool = False) -> int:
        s = self.s
        while True:
            simple = s[i] in NAMES
            i = self.pattern(i)
            if self.typed:
                if s[i] == "!":
                    i += 1
                if s[i] == ":":
                    i = self.type(i + 1)
            if s[i] == "=":
                i = self.expr(i + 1)
            elif not simple and not loop:
                raise Bad(i, "'='")
            if s[i] != ",":
                return i
            i += 1

    def condition(self, i: int) -> int:
        return self.want(self.comma(self.want(i, "(")), ")")

    def comma(self, i: int) -> int:
        i = self.expr(i)
        while self.s[i] == ",":
            i = self.expr(i + 1)
        return i

    def statement(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in DECLARING:
            if c == K["const"] and self.typed and s[i + 1] == K["enum"]:
                return self.enum(i + 1)
            return self.semi(self.declarators(i + 1))
        if c == K["return"]:
            i += 1
            if s[i] in ";}" + END or s[i] not in STARTERS and self.newline_before(i):
                return self.semi(i)
            return self.semi(self.comma(i))
        if c == K["if"]:
            i = self.statement(self.condition(i + 1))
            return self.statement(i + 1) if s[i] == K["else"] else i
        if c == "{":
            return self.block(i)
        if c == K["for"]:
            return self.for_(i + 1)
        if c == "i" and s[i + 1] not in ":":
            return self.semi(self.comma(i))
        if c == K["while"] or c == K["with"]:
            return self.statement(self.condition(i + 1))
        if c == K["function"]:
            return self.function(i)
        if c == K["async"] and s[i + 1] == K["function"]:
            return self.function(i + 1)
        if c == K["class"] or c == "@":
            while s[i] == "@":
                i = self.decorator(i)
            if s[i] == K["export"]:
                return self.export(i)
            if s[i] == K["abstract"]:
                i += 1
            self.want(i, K["class"], "class")
            return self.class_(i)
        if c == K["do"]:
            i = self.want(self.statement(i + 1), K["while"], "while")
            i = self.condition(i)
            return i + 1 if s[i] == ";" else i
        if c == K["break"] or c == K["continue"]:
            i += 1
            if s[i] in NAMES and not self.newline_before(i):
                i += 1
            return self.semi(i)
        if c == K["throw"]:
            return self.semi(self.comma(i + 1))
        if c == K["try"]:
            return self.try_(i)
        if c == K["switch"]:
            return self.switch(i)
        if c == K["import"] and s[i + 1] not in "(.":
            return self.import_(i + 1)
        if c == K["export"]:
            return self.export(i)
        if c == K["debugger"]:
            return self.semi(i + 1)
        if c == ";":
            return i + 1
        if c in NAMES and s[i + 1] == ":":
            return self.statement(i + 2)
        if self.typed:
            j = self.type_declaration(i)
            if j:
                return j
        return self.semi(self.comma(i))

    def type_declaration(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == K["declare"] and (s[i + 1] in NAMES or s[i + 1] >= "一"):
            return self.declared(i + 1)
        if c == K["abstract"] and s[i + 1] == K["class"]:
            return self.class_(i + 1)
        if c == K["type"] and s[i + 1] in NAMES:
            i = self.want(self.type_parameters(i + 2), "=")
            return self.semi(self.type(i))
        if c == K["interface"] and s[i + 1] in NAMES:
            i = self.type_parameters(i + 2)
            if s[i] == K["extends"]:
                i = self.type(i + 1)
                while s[i] == ",":
                    i = self.type(i + 1)
            if s[i] != "{":
                raise Bad(i, "'{'")
            return self.type_operand(i)
        if c == K["enum"]:
            return self.enum(i)
        if c in (K["namespace"], K["module"]) and s[i + 1] in NAMES + '"':
            i += 2
            while s[i] == ".":
                i += 2
            return self.block(i)
        return 0

    def declared(self, i: int) -> int:
        s = self.s
        if s[i] == K["function"]:
            i += 1
            if s[i] in NAMES:
                i += 1
            return self.function_rest(i, bodyless=True)
        return self.statement(i)

    def enum(self, i: int) -> int:
        i += 1
        if self.s[i] not in NAMES:
            raise Bad(i, "a name")
        return self.listed(self.want(i + 1, "{"), self.enum_item, "}")

    def enum_item(self, i: int) -> int:
        i = self.property_name(i)
        return self.expr(i + 1) if self.s[i] == "=" else i

    def for_(self, i: int) -> int:
        s = self.s
        if s[i] == K["await"]:
            i += 1
        i = self.want(i, "(")
        if s[i] in DECLARING:
            j = self.pattern(i + 1)
            if s[j] in (K["of"], K["in"]):
                return self.statement(self.want(self.comma(j + 1), ")"))
            i = self.declarators(i + 1, loop=True)
        elif s[i] != ";":
            j = self.postfix(self.primary(i)) if s[i] not in "-+!~u" else i
            if s[j] in (K["of"], K["in"]):
                return self.statement(self.want(self.comma(j + 1), ")"))
            i = self.comma(i)
        i = self.want(i, ";")
        if s[i] != ";":
            i = self.comma(i)
        i = self.want(i, ";")
        if s[i] != ")":
            i = self.comma(i)
        return self.statement(self.want(i, ")"))

    def try_(self, i: int) -> int:
        s = self.s
        i = self.block(i + 1)
        caught = False
        if s[i] == K["catch"]:
            i += 1
            if s[i] == "(":
                i = self.pattern(i + 1)
                if self.typed and s[i] == ":":
                    i = self.type(i + 1)
                i = self.want(i, ")")
            i = self.block(i)
            caught = True
        if s[i] == K["finally"]:
            return self.block(i + 1)
        if not caught:
            raise Bad(i, "catch")
        return i

    def switch(self, i: int) -> int:
        s = self.s
        i = self.want(self.condition(i + 1), "{")
        while s[i] != "}":
            if s[i] == K["default"]:
                i += 1
            else:
                i = self.comma(self.want(i, K["case"], "case"))
            i = self.want(i, ":")
            while s[i] not in (K["case"], K["default"], "}"):
                if s[i] == END:
                    raise Bad(i, "'}'")
                i = self.statement(i)
        return i + 1

    def import_(self, i: int) -> int:
        s = self.s
        if s[i] == '"':
            return self.semi(i + 1)
        if self.typed and s[i] == K["type"] and s[i + 1] in "{*i":
            i += 1
        if s[i] in NAMES:
            i += 1
            if self.typed and s[i] == "=":
                return self.semi(self.expr(i + 1))
            if s[i] == ",":
                i += 1
        if s[i] == "*":
            i = self.want(i + 1, K["as"], "as") + 1
        elif s[i] == "{":
            i = self.listed(i + 1, self.specifier, "}")
        return self.semi(self.want(self.want(i, K["from"], "from"), '"', "a module"))

    def specifier(self, i: int) -> int:
        s = self.s
        if self.typed and s[i] == K["type"] and s[i + 1] not in ",}" + K["as"]:
            i += 1
        i = self.property_name(i)
        return self.property_name(i + 1) if s[i] == K["as"] else i

    def export(self, i: int) -> int:
        s = self.s
        i += 1
        if self.typed and s[i] == K["type"] and s[i + 1] == "{":
            i += 1
        if s[i] == "{":
            i = self.listed(i + 1, self.specifier, "}")
            return self.semi(i + 2 if s[i] == K["from"] and s[i + 1] == '"' else i)
        if s[i] == "*":
            i += 1
            if s[i] == K["as"]:
                i += 2
            return self.semi(self.want(self.want(i, K["from"], "from"), '"', "a module"))
        if s[i] == K["default"]:
            if s[i + 1] in (K["function"], K["class"]) or s[i + 1] == K["async"] and s[i + 2] == K["function"]:
                return self.statement(i + 1)
            if self.typed and s[i + 1] in (K["abstract"], K["interface"]):
                return self.statement(i + 1)
            return self.semi(self.expr(i + 1))
        if s[i] in DECLARING or s[i] in (K["function"], K["class"], "@") or s[i] == K["async"] and s[i + 1] == K["function"]:
            return self.statement(i)
        if self.typed:
            if s[i] == "=":
                return self.semi(self.expr(i + 1))
            j = self.type_declaration(i)
            if j:
                return j
        raise Bad(i, "a declaration")


THIS = _k("this super null true false")
# What begins an expression: after a line end it makes a statement of its own as well.
STARTERS = 'i0"[({' + THIS
VOID = _k("void null this true false")
AS = _k("as satisfies")
TYPE_PREFIX = _k("keyof readonly unique infer asserts typeof")
PLAIN_MODIFIERS = _k("async static get set")


class TypeScript(JavaScript):
    typed = True
