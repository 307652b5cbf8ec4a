"""Lexers: a text becomes a string with one code character per token.

Codes: ``i`` name, ``0`` number, ``"`` literal, ``v`` PHP variable, ``L`` Rust lifetime, ``N`` end of
line, ``>>``-like operators are single brackets so that generics close; keywords have their own
characters; END and BAD stand for the end and for what is no token.  Offsets are only worked out
when an error has to be placed.
"""

from __future__ import annotations

import re

END, BAD = "\0", "\1"
INDENT, DEDENT = "\2", "\3"
NAME = r"[^\W\d]\w*"

# Operators of more than one character and their code, longest first where one begins another.
_OPERATORS = {
    "b": ["===", "!==", "==", "!=", ">=", "<=", "&&", "||", "??", "**", "<=>", "<<", "//", "=~", "!~", "~/"],
    "a": ["+=", "-=", "*=", "/=", "%=", "**=", "&=", "|=", "^=", "<<=", ">>=", "&&=", "||=", "??=", ".=", "//=", "~/=", "@=", ">>>="],
    "u": ["++", "--"],
    "f": ["=>"],
    "r": ["->"],
    "c": ["::"],
    "e": ["...", "..", "..="],
    "q": ["?.", "?->", "&."],
    "w": [":="],
    "h": ["<-"],
}
_SINGLE = "()[]{},;:.?!~@#<>+-*/%&|^=\\"


class Lexer:
    """pattern: skipped text, then one group with the token (JavaScript: a second with a regular expression after it)."""

    def __init__(self, operators: str, strings: str, keywords: str, skip: str, name: str = NAME, number: str = r"\d[\w.]*", extra: str = "", first: dict[str, str] | None = None, after: str = "", soft: str = ""):
        ops = sorted(operators.split(), key=len, reverse=True)
        table = {op: code for code, texts in _OPERATORS.items() for op in texts if op in ops}
        table |= {c: c for c in _SINGLE}
        table |= {'"': BAD, "'": BAD, "`": BAD, "/*": BAD, "\\": BAD}
        self.keywords = {k: chr(0x4E00 + n) for n, k in enumerate((keywords + " " + soft).split())}
        self.soft = "".join(self.keywords[k] for k in soft.split())
        self.table = table | self.keywords
        self.first = {d: "0" for d in "0123456789"} | {'"': '"', "'": '"', "`": '"', "$": "i"} | (first or {})
        tokens = "|".join(x for x in (extra, strings, name, number, "|".join(map(re.escape, ops)), r"/\*" if r"/\*" in skip else "", r"[\s\S]", r"\Z") if x)
        self.pattern = re.compile(rf"(?>{skip})*+({tokens}){after}")
        self.double, self.skip = bool(after), skip

    def code(self, token: str) -> str:
        c = self.table.get(token)
        if c is None:
            quoted = len(token) > 1 and ('"' in token or "'" in token or "`" in token)
            if quoted and token[0] not in "<%?":
                c = '"' if token[-1] in "\"'`#" or token[0] not in "'" else "L"
            else:
                c = self.first.get(token[0]) or ("i" if token[0].isidentifier() else BAD)
            if len(token) < 40 and len(self.table) < 50_000:
                self.table[token] = c
        return c

    def codes(self, text: str) -> str:
        code, table = self.code, self.table.get
        if self.double:
            return "".join([(table(t) or code(t)) + ('"' if r else "") for t, r in self.pattern.findall(text) if t]) + END
        found = self.pattern.findall(text) if self.pattern.groups == 1 else [m[1] for m in self.pattern.finditer(text)]
        return "".join([table(t) or code(t) for t in found if t]) + END

    def offsets(self, text: str) -> list[int]:
        out = []
        for m in self.pattern.finditer(text):
            if m[1]:
                out.append(m.start(1))
                if self.double and m[m.re.groups]:
                    out.append(m.start(m.re.groups))
        return [*out, len(text)]


class LineLexer(Lexer):
    """For languages where the end of a line can end a statement: code ``N``."""

    #: After these codes a newline ends the statement; None: always.
    ends_after: str | None = None

    def codes(self, text: str) -> str:
        return self._run(text)[0]

    def offsets(self, text: str) -> list[int]:
        return self._run(text)[1]

    def _run(self, text: str) -> tuple[str, list[int]]:
        out, at, last = [], [], "N"
        ends = self.ends_after
        for m in self.pattern.finditer(text):
            t = m[1]
            if not t:
                continue
            if t[0] == "\n":
                if last == "N" or ends is not None and last not in ends:
                    continue
                c = "N"
            else:
                c = self.table.get(t) or self.code(t)
            out.append(c)
            at.append(m.start(1))
            if self.double and m[m.re.groups]:
                out.append('"')
                at.append(m.start(m.re.groups))
                c = '"'
            last = c
        if last != "N":
            out.append("N")
            at.append(len(text))
        return "".join(out) + END, [*at, len(text)]


class IndentLexer(Lexer):
    """Python: logical lines, INDENT and DEDENT; inside brackets lines do not end."""

    #: The last text and what came of it, as a text is often asked for more than once in a row.
    last: tuple[str, tuple[str, list[int]]] = ("", ("\0", [0]))

    def codes(self, text: str) -> str:
        return self._run(text)[0]

    def offsets(self, text: str) -> list[int]:
        return [max(0, x - 1) for x in self._run(text)[1]]

    def _run(self, text: str) -> tuple[str, list[int]]:
        if text != self.last[0]:
            self.last = (text, self._scan(text))
        return self.last[1]

    def _scan(self, text: str) -> tuple[str, list[int]]:
        out, at, levels, depth, fresh = [], [], [0], 0, True
        table, code = self.table.get, self.code
        for m in self.pattern.finditer("\n" + text):
            t = m[1]
            if not t:
                continue
            if t[0] == "\n":
                if depth:
                    continue
                if not fresh:
                    out.append("N")
                    at.append(m.start(1))
                    fresh = True
                width = len(t[t.rindex("\n") + 1 :].expandtabs(8))
                if m.end() == len(text) + 1:
                    width = 0
                if width > levels[-1]:
                    levels.append(width)
                    out.append(INDENT)
                    at.append(m.end())
                else:
                    while width < levels[-1]:
                        levels.pop()
                        out.append(DEDENT)
                        at.append(m.end())
                    if width != levels[-1]:
                        out.append(BAD)
                        at.append(m.end())
                continue
            c = table(t) or code(t)
            if c in "([{":
                depth += 1
            elif c in ")]}" and depth:
                depth -= 1
            out.append(c)
            at.append(m.start(1))
            fresh = False
        if not fresh:
            out.append("N")
            at.append(len(text))
        out += [DEDENT] * (len(levels) - 1)
        at += [len(text)] * (len(levels) - 1)
        return "".join(out) + END, [*at, len(text)]


_SLASHES = r"[ \t\r\n\f\v\u00a0\ufeff]++|//[^\n]*|/\*[\s\S]*?\*/"
_DOUBLE, _SINGLE_Q = r'"(?:[^"\\\n]|\\[\s\S])*+"', r"'(?:[^'\\\n]|\\[\s\S])*+'"
_TEMPLATE = r"""`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`'"]|'(?:[^'\\\n]|\\.)*+'|"(?:[^"\\\n]|\\.)*+"|\{[^{}`]*+\}|`(?:[^`\\]|\\.)*+`)*+\})*+`"""
_REGEX = r"(?:(?:(?<=[=(,:;!&|?{\[+\-*%<>~^])|(?<=\breturn)|(?<=\bcase)|(?<=\btypeof))\s*+(/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/\w*))?"
_JS_OPS = "=== !== == != >= <= && || ?? ** << += -= *= /= %= **= &= |= ^= <<= >>= >>>= &&= ||= ??= ++ -- => ... ?."
_JS_WORDS = "var let const function class if else for while do return break continue throw try catch finally switch case default new delete typeof void in instanceof this super null true false import export extends yield await debugger with enum"
_JS_SOFT = "async static get set of from as type interface namespace module declare abstract public private protected readonly implements keyof is infer override asserts unique satisfies"

JS = Lexer(_JS_OPS, "|".join((_DOUBLE, _SINGLE_Q, _TEMPLATE)), _JS_WORDS, _SLASHES, name=r"[^\W\d][\w$]*|\$[\w$]*|\#[^\W\d][\w$]*", number=r"\d[\w]*(?:\.\d[\w]*)?|\.\d\w*", first={"#": "P", ".": "0"}, after=_REGEX, soft=_JS_SOFT)

JAVA = Lexer(
    "== != >= <= && || << += -= *= /= %= &= |= ^= <<= ++ -- -> :: ...", '"""(?:[^"\\\\]|\\\\[\\s\\S]|"(?!""))*+"""|' + _DOUBLE + r"|'(?:[^'\\\n]|\\[^\n][\w]*)'",
    "package import class interface enum public private protected static final abstract native synchronized transient volatile strictfp default void int long short byte char boolean float double if else for while do return break continue throw throws try catch finally switch case new instanceof this super null true false extends implements assert const goto",
    _SLASHES, name=r"[^\W\d][\w$]*|\$[\w$]*", number=r"\d\w*(?:\.\d\w*)?(?:[eE][+-]?\d+\w*)?|\.\d\w*", first={".": "0"}, soft="var record sealed permits non yield",
)

PHP = Lexer(
    "=== !== == != >= <= <=> && || ?? ** << += -= *= /= %= **= .= &= |= ^= ??= ++ -- => -> :: ... ?->",
    r'"(?:[^"\\]|\\[\s\S])*+"|' + r"'(?:[^'\\]|\\[\s\S])*+'",
    "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return static switch throw trait try unset use var while xor yield",
    r"[ \t\r\n\f]++|//(?:(?!\?>)[^\n])*|\#(?!\[)(?:(?!\?>)[^\n])*|/\*[\s\S]*?\*/", name=r"\\?[^\W\d]\w*(?:\\[^\W\d]\w*)*", number=r"\d\w*(?:\.\d\w*)?", extra=r"\$[^\W\d]\w*|\$\$[^\W\d]\w*|<<<[ \t]*(?P<q>['\"]?)(?P<tag>\w+)(?P=q)\n(?:[^\n]*\n)*?[ \t]*(?P=tag)\b|\?>(?:[\s\S]*?(?:<\?php\b|<\?=)|[\s\S]*)", first={"$": "v", "<": '"', "\\": "i", "?": ";"},
)

RUST = Lexer(
    "== != >= <= && || << += -= *= /= %= &= |= ^= <<= => -> :: .. ... ..=",
    r'b?r(?P<h>\#*)"[\s\S]*?"(?P=h)|b?"(?:[^"\\]|\\[\s\S])*+"' + r"|b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|[^\n]))'",
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while",
    r"[ \t\r\n\f]++|//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*+\*/", extra=r"'[^\W\d]\w*(?!')", number=r"\d[\w]*(?:\.\d[\w]*)?", soft="union auto",
)
RUST.first |= {"'": '"'}

DART = Lexer(
    "== != >= <= && || ?? << += -= *= /= %= ~/= &= |= ^= ??= ++ -- => ... .. ?. ~/",
    r"""r?'''[\s\S]*?'''|r?\"\"\"[\s\S]*?\"\"\"|r'[^'\n]*+'|r"[^"\n]*+"|'(?:[^'\\\n$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}]|\{[^{}]*+\})*+\})*+'|"(?:[^"\\\n$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}]|\{[^{}]*+\})*+\})*+\"""",
    "assert break case catch class const continue default do else enum extends false final finally for if in is new null rethrow return super switch this throw true try var void while with",
    _SLASHES, name=r"[^\W\d][\w$]*|\$[\w$]*", number=r"\d\w*(?:\.\d\w*)?", soft="abstract as async await base covariant deferred dynamic export extension external factory Function get hide implements import interface late library mixin of on operator part required sealed set show static sync type typedef when yield",
)

_LINE_SKIP = r"[ \t\r\f\ufeff]++|\\\n"


class GoLexer(LineLexer):
    pass


GO = GoLexer(
    "== != >= <= && || << += -= *= /= %= &= |= ^= <<= ++ -- := <- ...", _DOUBLE + r"|`[^`]*`|'(?:[^'\\\n]|\\[^\n]\w*)'",
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    r"[ \t\r\f\ufeff]++|//[^\n]*|/\*[\s\S]*?\*/", extra=r"\n", number=r"\d\w*(?:\.\d\w*)?|\.\d\w*", first={".": "0"},
)
GO.ends_after = 'i0"u)]}' + "".join(GO.keywords[k] for k in ("break", "continue", "fallthrough", "return"))

RUBY = LineLexer(
    "=== == != >= <= <=> && || ** << += -= *= /= %= **= ||= &&= <<= |= &= => -> :: ... .. &. =~ !~",
    r'"(?:[^"\\]|\\[\s\S])*+"|' + r"'(?:[^'\\]|\\[\s\S])*+'|`(?:[^`\\]|\\[\s\S])*+`",
    "alias and begin BEGIN break case class def defined? do else elsif end END ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield",
    _LINE_SKIP + r"|\#[^\n]*|(?<=\n)=begin\b[\s\S]*?\n=end\b[^\n]*",
    name=r"@{0,2}[^\W\d]\w*[?!]?(?!=(?![=~>]))|@{0,2}[^\W\d]\w*|\$\w+|\$[!@&~0-9*$?:\"<>,./\;]", number=r"\d\w*(?:\.\d\w*)?",
    extra=r"\n|%[wWiI](?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|<[^>]*>|(?P<pq>[|!/])[^|!/]*(?P=pq))|%[qQ]?(?:\[[^\]]*\]|\{[^}]*\}|\([^)]*\))|<<[~-]?(?P<hq>['\"]?)(?P<htag>[A-Z_]\w*)(?P=hq)[^\n]*\n(?:[^\n]*\n)*?[ \t]*(?P=htag)\b|:[^\W\d]\w*[?!=]?(?!:)|:\"(?:[^\"\\]|\\.)*+\"|\?\w(?!\w)",
    first={"@": "i", "$": "i", "%": '"', "<": '"', ":": '"', "?": '"'},
    after=r"(?:(?:(?<=[=(,!&|?{\[~])|(?<=\bif)|(?<=\bunless)|(?<=\bwhen)|(?<=\breturn))[ \t]*+(/(?:[^\\/\n]|\\.)++/\w*))?",
)

_PY_STRING = r"""(?:[rRbBuUfF]{1,2})?(?:\"\"\"(?:[^\\"]|\\[\s\S]|"(?!""))*+\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*+'''|"(?:[^"\\\n]|\\[\s\S])*+"(?!")|'(?:[^'\\\n]|\\[\s\S])*+'(?!'))"""
PYTHON = IndentLexer(
    "== != >= <= ** << // += -= *= /= %= **= //= &= |= ^= <<= >>= @= -> := ...", "",
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    _LINE_SKIP + r"|\#[^\n]*", extra=r"\n(?:[ \t\f]*(?:\#[^\n]*)?(?:\n|\Z))*[ \t\f]*|" + _PY_STRING, number=r"\d\w*(?:\.\w*)?(?:(?<=[eE])[+-]\d+)?|\.\d\w*", first={".": "0"}, soft="match case type",
)


def normalised(text: str) -> str:
    """Line ends as line feeds, without byte order mark."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text[1:] if text.startswith("\ufeff") else text
