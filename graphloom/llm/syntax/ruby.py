"""Ruby."""

from __future__ import annotations

from graphloom.llm.syntax.base import Bad, Grammar, flat_pattern
from graphloom.llm.syntax.lexer import END, RUBY

K = RUBY.keywords


def _k(*words: str) -> str:
    return "".join(K[w] for w in words)


VALUES = _k("nil", "true", "false", "self", "redo", "retry")
MODIFIERS = _k("if", "unless", "while", "until", "rescue")
STARTS = 'i0"[{(-!~c&*' + VALUES + _k("not", "defined?", "super", "yield", "if", "unless", "case", "begin", "def") + "r"
ENDING = frozenset("N;)]}" + END) | set(MODIFIERS) | {K["do"], K["then"], K["end"], K["and"], K["or"]}


class Ruby(Grammar):
    lexer = RUBY
    POWER = {"e": 1, "b": 3, "|": 4, "^": 4, "&": 5, "<": 3, ">": 3, "+": 6, "-": 6, "*": 7, "/": 7, "%": 7}
    PREFIX = "!-+~*&" + K["defined?"]
    CLOSERS = frozenset("N),]};" + END)
    flat = flat_pattern("i", r"b+\-*/%<>", r"\.")

    def lines(self, i: int) -> int:
        s = self.s
        while s[i] in "N;":
            i += 1
        return i

    def assignment(self, i: int) -> int:
        s = self.s
        if s[i] == K["not"]:
            return self.assignment(i + 1)
        i = self.ternary(i)
        if s[i] in "=a":
            i = self.assignment(self.lines(i + 1))
            if s[i] == K["rescue"]:
                i = self.assignment(i + 1)
            while s[i] == ",":  # a, b = 1, 2
                i = self.assignment(self.lines(i + 1))
        return i

    def ternary(self, i: int) -> int:
        i = self.climb(i, 0)
        if self.s[i] == "?":
            i = self.lines(self.assignment(self.lines(i + 1)))
            if self.s[i] == '"':  # a symbol took the colon
                return i + 1
            i = self.want(i, ":")
            return self.assignment(self.lines(i))
        return i

    def climb(self, i: int, least: int) -> int:
        s, power = self.s, self.POWER
        i = self.unary(i)
        while (p := power.get(s[i], -1)) >= least:
            c = s[i]
            i += 1
            if c == ">" and s[i] == ">":
                i += 1
            if c == "e" and s[i] in ")]N":
                return i
            i = self.climb(self.lines(i), p + 1)
        return i

    def primary(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == "i":
            return self.command(i + 1)
        if c == '"':
            while s[i] == '"':
                i += 1
            return i
        if c in "0" or c in VALUES:
            return i + 1
        if c == "(":
            i = self.lines(i + 1)
            while s[i] != ")":
                i = self.lines(self.statement(i))
                if s[i] == END:
                    raise Bad(i, "')'")
            return i + 1
        if c == "[":
            return self.wrapped(i + 1, self.argument, "]")
        if c == "{":
            return self.wrapped(i + 1, self.pair, "}")
        if c == "c":
            return self.want(i + 1, "i", "a name")
        if c == "r":  # -> (x) { }
            i += 1
            if s[i] == "(":
                i = self.listed(i + 1, self.parameter, ")")
            return self.brace_block(i) if s[i] == "{" else self.do_block(i)
        if c == K["super"] or c == K["yield"]:
            return self.command(i + 1)
        if c in (K["return"], K["break"], K["next"]):
            return self.jump(i + 1)
        if c in STATEMENTS:
            return STATEMENTS[c](self, i)
        raise Bad(i, "an expression")

    def jump(self, i: int) -> int:
        s = self.s
        if s[i] in ENDING:
            return i
        i = self.expr(i)
        while s[i] == ",":
            i = self.expr(self.lines(i + 1))
        return i

    def command(self, i: int) -> int:
        """Arguments without parentheses: puts a, b"""
        s = self.s
        c = s[i]
        if c in STARTS and c not in "([{-*&c" + MODIFIERS or c in "-*&[c" and self.spaced(i):
            if c in MODIFIERS or c == K["do"]:
                return i
            i = self.argument(i)
            while s[i] == ",":
                i = self.argument(self.lines(i + 1))
        return i

    def spaced(self, i: int) -> bool:
        """Is there a space before the token and none after it? Then it begins an argument."""
        if not hasattr(self, "at"):
            self.at = self.lexer.offsets(self.text)
        o = self.at[i]
        return self.text[o - 1 : o] in " \t" and self.text[o + 1 : o + 2] not in " \t\n="

    def wrapped(self, i: int, item, close: str) -> int:
        s = self.s
        i = self.lines(i)
        while s[i] != close:
            i = self.lines(item(i))
            if s[i] == ",":
                i = self.lines(i + 1)
            elif s[i] != close:
                raise Bad(i, f"'{close}'")
        return i + 1

    def argument(self, i: int) -> int:
        s = self.s
        if s[i] == "b":  # **options
            return self.expr(i + 1)
        if s[i] in 'i"' and s[i + 1] == ":" or s[i] >= "一" and s[i + 1] == ":":
            i = self.lines(i + 2)
            return i if s[i] in ",)" else self.expr(i)
        i = self.expr(i)
        return self.expr(self.lines(i + 1)) if s[i] == "f" else i

    def pair(self, i: int) -> int:
        return self.argument(i)

    def postfix(self, i: int) -> int:
        s = self.s
        while True:
            c = s[i]
            if c == "N" and (s[i + 1] == "." or s[i + 1] == "q"):
                i += 1
                c = s[i]
            if c in ".qc":
                i += 1
                if s[i] == "(":
                    continue
                if s[i] == "i" or s[i] >= "一":
                    i += 1
                elif s[i] in "+-*/%<>b!":
                    i += 1
                else:
                    raise Bad(i, "a name")
                if s[i] != "(":
                    i = self.command(i)
            elif c == "(" and s[i - 1] in 'i)]}.' + _k("super", "yield", "self", "class"):
                i = self.wrapped(i + 1, self.argument, ")")
            elif c == "[" and not self.spaced(i):
                i = self.wrapped(i + 1, self.argument, "]")
            elif c == "{" and s[i - 1] in "i)" + _k("super", "yield"):
                i = self.brace_block(i)
            elif c == K["do"] and not self.no_do:
                i = self.do_block(i)
            else:
                return i

    no_do = False

    def condition(self, i: int) -> int:
        """An expression whose ``do`` belongs to the loop around it."""
        kept, self.no_do = self.no_do, True
        i = self.logic(i)
        self.no_do = kept
        return i

    def logic(self, i: int) -> int:
        s = self.s
        i = self.expr(i)
        while s[i] == K["and"] or s[i] == K["or"]:
            i = self.expr(self.lines(i + 1))
        return i

    def block_parameters(self, i: int) -> int:
        return self.listed(i + 1, self.parameter, "|") if self.s[i] == "|" else i

    def brace_block(self, i: int) -> int:
        kept, self.no_do = self.no_do, False
        i = self.body(self.block_parameters(i + 1), "}")
        self.no_do = kept
        return self.want(i, "}")

    def do_block(self, i: int) -> int:
        kept, self.no_do = self.no_do, False
        i = self.rescued(self.block_parameters(self.want(i, K["do"], "do")))
        self.no_do = kept
        return i

    def body(self, i: int, ends: str) -> int:
        s = self.s
        i = self.lines(i)
        while s[i] not in ends:
            if s[i] == END:
                raise Bad(i, "end")
            before = i
            try:
                i = self.statement(i)
                if s[i] not in "N;" and s[i] not in ends:
                    raise Bad(i, "the end of the line")
            except Bad as e:
                self.errors.append((e.at, e.wanted))
                i = e.at
                while s[i] not in "N" + END:
                    i += 1
                if s[i] == END:
                    return i
                i = max(i, before + 1)
            i = self.lines(i)
        return i

    def finish(self, i: int) -> int:
        return self.want(i, K["end"], "end")

    def rescued(self, i: int) -> int:
        s = self.s
        parts = _k("rescue", "else", "ensure", "end")
        i = self.body(i, parts)
        while s[i] in _k("rescue", "else", "ensure"):
            if s[i] == K["rescue"]:
                i += 1
                while s[i] not in "N;" + K["then"] + END:
                    i += 1
            else:
                i += 1
            i = self.body(i, parts)
        return self.finish(i)

    def parameter(self, i: int) -> int:
        s = self.s
        if s[i] == "(":
            return self.listed(i + 1, self.parameter, ")")
        if s[i] in "*&b":
            i += 1
            if s[i] in ",)|N":
                return i
        i = self.want(i, "i", "a name")
        if s[i] == "=":
            return self.ternary(i + 1) if s[i + 1] != "|" else i
        if s[i] == ":":
            i += 1
            return i if s[i] in ",)N|" else self.ternary(i)
        return i

    def def_(self, i: int) -> int:
        end = self.spans[i] = self.method(i)
        return end

    def method(self, i: int) -> int:
        s = self.s
        i += 1
        if s[i + 1] == "." and (s[i] == "i" or s[i] == K["self"]):
            i += 2
        if s[i] == "i" or s[i] >= "一":
            i += 1
            if s[i] == "=" and s[i + 1] == "(":
                i += 1
        elif s[i] in "+-*/%<>b!~u":
            i += 1
        elif s[i] == "[" and s[i + 1] == "]":
            i += 2
            if s[i] == "=":
                i += 1
        else:
            raise Bad(i, "a name")
        if s[i] == "(":
            i = self.wrapped(i + 1, self.parameter, ")")
        elif s[i] not in "N;=":
            i = self.parameter(i)
            while s[i] == ",":
                i = self.parameter(i + 1)
        if s[i] == "=":
            return self.statement(self.lines(i + 1))
        if s[i] not in "N;":
            raise Bad(i, "the end of the line")
        kept, self.no_do = self.no_do, False
        i = self.rescued(i)
        self.no_do = kept
        return i

    def class_(self, i: int) -> int:
        s = self.s
        i += 1
        if s[i] == "b":  # class << self
            i = self.expr(i + 1)
        else:
            i = self.constant(i)
            if s[i] == "<":
                i = self.expr(i + 1)
        if s[i] not in "N;":
            raise Bad(i, "the end of the line")
        return self.rescued(i)

    def constant(self, i: int) -> int:
        s = self.s
        if s[i] == "c":
            i += 1
        i = self.want(i, "i", "a name")
        while s[i] == "c":
            i = self.want(i + 1, "i", "a name")
        return i

    def module(self, i: int) -> int:
        return self.finish(self.body(self.constant(i + 1), K["end"]))

    def if_(self, i: int) -> int:
        s = self.s
        i = self.condition(i + 1)
        if s[i] not in "N;" + K["then"]:
            raise Bad(i, "the end of the line")
        if s[i] == K["then"]:
            i += 1
        parts = _k("elsif", "else", "end")
        i = self.lines(i)
        if s[i] == K["then"]:
            i += 1
        i = self.body(i, parts)
        while s[i] == K["elsif"]:
            i = self.lines(self.condition(i + 1))
            if s[i] == K["then"]:
                i += 1
            i = self.body(i, parts)
        if s[i] == K["else"]:
            i = self.body(i + 1, K["end"])
        return self.finish(i)

    def while_(self, i: int) -> int:
        i = self.condition(i + 1)
        if self.s[i] == K["do"]:
            i += 1
        return self.finish(self.body(i, K["end"]))

    def for_(self, i: int) -> int:
        s = self.s
        i = self.want(i + 1, "i", "a name")
        while s[i] == ",":
            i = self.want(i + 1, "i", "a name")
        return self.while_(self.want(i, K["in"], "in") - 1)

    def case(self, i: int) -> int:
        s = self.s
        i += 1
        if s[i] != "N":
            i = self.logic(i)
        i = self.lines(i)
        parts = _k("when", "in", "else", "end")
        if s[i] not in parts[:2]:
            raise Bad(i, "when")
        while s[i] in parts[:2]:
            i += 1
            while s[i] not in "N" + K["then"]:
                if s[i] == END:
                    raise Bad(i, "then")
                i = self.argument(self.lines(i))
                if s[i] == ",":
                    i = self.lines(i + 1)
            if s[i] == K["then"]:
                i += 1
            i = self.body(i, parts)
        if s[i] == K["else"]:
            i = self.body(i + 1, K["end"])
        return self.finish(i)

    def begin(self, i: int) -> int:
        return self.rescued(i + 1)

    def alias(self, i: int) -> int:
        return i + 3

    def statement(self, i: int) -> int:
        s = self.s
        if s[i] in "b" or s[i] in "=<>":
            raise Bad(i, "a statement")
        i = self.logic(i)
        if s[i] == "," and s[i - 1] == "i":  # a, b = b, a
            while s[i] == ",":
                i = self.logic(self.lines(i + 1))
        while s[i] in MODIFIERS:
            i = self.logic(i + 1)
        return i

    def parse(self) -> list[tuple[int, str]]:
        s, i = self.s, 0
        while s[i] != END:
            try:
                i = self.body(i, END)
                break
            except Bad as e:
                self.errors.append((e.at, e.wanted))
                i = e.at
                while s[i] not in "N" + END:
                    i += 1
        return self.errors


STATEMENTS = {
    K["if"]: Ruby.if_, K["unless"]: Ruby.if_, K["while"]: Ruby.while_, K["until"]: Ruby.while_, K["case"]: Ruby.case, K["begin"]: Ruby.begin,
    K["def"]: Ruby.def_, K["class"]: Ruby.class_, K["module"]: Ruby.module, K["for"]: Ruby.for_, K["alias"]: Ruby.alias,
}
