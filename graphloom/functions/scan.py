"""Declarations of one source text: a small scanner that knows comments and literals, and what each language declares how.

The text is masked (comments and literals become blanks of the same length), declaring patterns
run over the mask, and brackets, indentation or ``end`` give the extent of each declaration.
"""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple

_NAME = r"[A-Za-z_$][\w$]*"
_MODS = r"(?:(?:export|default|declare|public|private|protected|internal|fileprivate|static|final|abstract|async|override|virtual|inline|open|sealed|data|suspend|unsafe|const|constexpr|case|extern|external|partial|readonly|native|synchronized|factory|late|covariant|lateinit|operator|mutating|implicit|lazy|companion|inner|tailrec|local|explicit|friend|required|convenience|indirect|pub(?:\([\w: ]+\))?)[ \t]+)*"
# Where a declaration may begin: at a line, or behind what ends one.
_AT = rf"(?:^|(?<=[{{;}}]))[ \t]*+(?:@[\w.]+(?:\([^()\n]*\))?[ \t]+)*{_MODS}"
_TYPE = r"(?:[\w$.]+(?:<[^;{}()=]*?>)?(?:\[\])*[?*&]*)"

# Comments and literals by family; the group name tells a comment.
_SLASH = r"(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))"
_DQ, _SQ = r'"(?:[^"\\\n]|\\[\s\S])*"?', r"'(?:[^'\\\n]|\\[\s\S])*'?"
MASKS = {
    "script": rf"(?:(?<=[=(,:;!&|?{{\[+*%<>~^-])|(?<=\breturn)|(?<=\bcase)|(?<=\btypeof))[ \t]*/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*|{_SLASH}|{_DQ}|{_SQ}|`(?:[^`\\]|\\[\s\S])*`?",
    "c": rf'{_SLASH}|"""[\s\S]*?"""|{_DQ}|\'(?:[^\'\\\n]|\\[^\n]\w*)\'',
    "dart": rf'{_SLASH}|r?"""[\s\S]*?"""|r?\'\'\'[\s\S]*?\'\'\'|{_DQ}|{_SQ}',
    "php": rf"(?P<c>//[^\n]*|\#(?!\[)[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|<<<[ \t]*['\"]?(\w+)['\"]?\n[\s\S]*?\n[ \t]*\2\b|\"(?:[^\"\\]|\\[\s\S])*\"?|'(?:[^'\\]|\\[\s\S])*'?",
    "hash": rf'(?P<c>\#[^\n]*|^=begin\b[\s\S]*?^=end\b)|"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|{_DQ}|{_SQ}',
    "lua": rf"(?P<c>--\[\[[\s\S]*?\]\]|--[^\n]*)|\[\[[\s\S]*?\]\]|{_DQ}|{_SQ}",
    "haskell": rf"(?P<c>--[^\n]*|\{{-[\s\S]*?-\}})|{_DQ}",
    "sql": r"(?P<c>--[^\n]*|/\*[\s\S]*?\*/)|'(?:[^']|'')*'",
    "go": rf"{_SLASH}|{_DQ}|`[^`]*`?|'(?:[^'\\\n]|\\[^\n]\w*)'",
}

_SCRIPT = [("function", rf"{_AT}function\s*\*?\s*({_NAME})"), ("function", rf"{_AT}(?:const|let|var)\s+({_NAME})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\((?:[^;{{}}]|\{{[^;{{}}]*\}})*?\)\s*(?::[^=\n{{]+)?=>|{_NAME}\s*=>)"), ("class", rf"{_AT}class\s+({_NAME})"), ("method", rf"(?:^[ \t]++|(?<=[{{;}}])[ \t]*+)(?:@[\w.]+(?:\([^()\n]*\))?[ \t]+)*{_MODS}(?:(?:get|set)[ \t]+)?\*?[ \t]*(\#?{_NAME})[ \t]*(?=[<(])")]
_TYPED = [("class", rf"{_AT}(?:class|record|mixin)\s+({_NAME})"), ("interface", rf"{_AT}@?interface\s+({_NAME})"), ("enum", rf"{_AT}enum\s+({_NAME})"), ("struct", rf"{_AT}struct\s+({_NAME})"), ("method", rf"{_AT}(?:<[^>()]*>\s*)?(?:{_TYPE}\s+)?({_NAME})\s*(?=\()")]
_C = [("struct", rf"^[ \t]*(?:typedef\s+)?(?:struct|union)\s+({_NAME})\s*(?=[{{:])"), ("enum", rf"^[ \t]*(?:typedef\s+)?enum\s+(?:class\s+)?({_NAME})\s*(?=[{{:])"), ("type", rf"^[ \t]*typedef\s+[^;{{}}(]*?\b({_NAME})\s*;"), ("function", rf"^[ \t]*(?!(?:else|return|new|delete|throw)\b){_MODS}{_TYPE}[\w\s*&:<>,]*?[\s*&]((?:{_NAME}::)*~?{_NAME})\s*(?=\()")]
_CPP = [("module", rf"^[ \t]*namespace\s+([\w:]+)\s*(?=\{{)"), ("class", rf"^[ \t]*(?:template\s*<[^;{{]*>\s*)?class\s+({_NAME})\s*(?:final\s*)?(?=[{{:])")]

# Extensions to the family of the mask, how declarations end, and kinds with the patterns of their names.
LANGUAGES: dict[str, tuple[str, str, list[tuple[str, str]]]] = {
    ".js .jsx": ("script", "brace", _SCRIPT),
    ".ts .tsx": ("script", "brace", [*_SCRIPT, ("interface", rf"{_AT}interface\s+({_NAME})"), ("enum", rf"{_AT}enum\s+({_NAME})"), ("type", rf"{_AT}type\s+({_NAME})\s*(?:<[^=]*>)?="), ("module", rf"{_AT}namespace\s+([\w.]+)")]),
    ".java": ("c", "brace", _TYPED),
    ".cs": ("c", "brace", [*_TYPED, ("module", r"^[ \t]*namespace\s+([\w.]+)")]),
    ".groovy": ("dart", "brace", [*_TYPED, ("trait", rf"{_AT}trait\s+({_NAME})"), ("function", rf"{_AT}def\s+({_NAME})\s*(?=\()")]),
    ".dart": ("dart", "brace", [*_TYPED, ("class", rf"{_AT}extension\s+({_NAME})"), ("type", rf"^[ \t]*typedef\s+({_NAME})")]),
    ".kt .kts": ("c", "brace", [("class", rf"{_AT}(?:class|object)\s+({_NAME})"), ("enum", rf"{_AT}enum\s+class\s+({_NAME})"), ("interface", rf"{_AT}(?:fun\s+)?interface\s+({_NAME})"), ("function", rf"{_AT}fun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?({_NAME})\s*(?=\()")]),
    ".scala": ("c", "brace", [("class", rf"{_AT}(?:class|object)\s+({_NAME})"), ("trait", rf"{_AT}trait\s+({_NAME})"), ("function", rf"{_AT}def\s+({_NAME})")]),
    ".swift": ("c", "brace", [("class", rf"{_AT}(?:class|extension|actor)\s+(?!func\b)({_NAME})"), ("struct", rf"{_AT}struct\s+({_NAME})"), ("interface", rf"{_AT}protocol\s+({_NAME})"), ("enum", rf"{_AT}enum\s+({_NAME})"), ("function", rf"{_AT}(?:class\s+)?func\s+({_NAME})")]),
    ".php": ("php", "brace", [("class", rf"{_AT}class\s+({_NAME})"), ("interface", rf"{_AT}interface\s+({_NAME})"), ("trait", rf"{_AT}trait\s+({_NAME})"), ("enum", rf"{_AT}enum\s+({_NAME})"), ("function", rf"{_AT}function\s+&?({_NAME})\s*(?=\()")]),
    ".go": ("go", "brace", [("function", r"^func\s+(\w+)"), ("method", r"^func\s+\([^)]*\)\s*(\w+)"), ("struct", r"^[ \t]*(?:type\s+)?(\w+)\s+struct\b"), ("interface", r"^[ \t]*(?:type\s+)?(\w+)\s+interface\b"), ("type", r"^type\s+(\w+)\s+(?!struct\b|interface\b)[\w\[*(]")]),
    ".rs": ("c", "brace", [("function", rf"{_AT}(?:extern\s+\s+)?fn\s+(\w+)"), ("struct", rf"{_AT}struct\s+(\w+)"), ("enum", rf"{_AT}enum\s+(\w+)"), ("trait", rf"{_AT}trait\s+(\w+)"), ("module", rf"{_AT}mod\s+(\w+)"), ("type", rf"{_AT}type\s+(\w+)"), ("impl", r"^[ \t]*(?:unsafe\s+)?impl\b(?:<[^{]*?>)?\s+(?:[^{;]*?\bfor\s+)?&?(\w+)")]),
    ".c .h": ("c", "brace", _C),
    ".cpp .hpp .cc .hh .cxx": ("c", "brace", [*_CPP, *_C]),
    ".m .mm": ("c", "objc", [("class", rf"^[ \t]*@(?:interface|implementation)\s+({_NAME})"), ("interface", rf"^[ \t]*@protocol\s+({_NAME})(?!\s*;)"), ("method", rf"^[ \t]*[-+]\s*\([^)]*\)\s*({_NAME})"), *_C]),
    ".zig": ("c", "brace", [("function", r"^[ \t]*(?:pub\s+)?(?:export\s+)?fn\s+(\w+)"), ("struct", r"^[ \t]*(?:pub\s+)?const\s+(\w+)\s*=\s*(?:packed\s+|extern\s+)?struct\b"), ("enum", r"^[ \t]*(?:pub\s+)?const\s+(\w+)\s*=\s*enum\b"), ("type", r"^[ \t]*(?:pub\s+)?const\s+(\w+)\s*=\s*union\b"), ("test", r"^[ \t]*test\s+(?=\s*\{)()")]),
    ".rb": ("hash", "end", [("class", r"^[ \t]*class\s+(?!<<)([\w:]+)"), ("module", r"^[ \t]*module\s+([\w:]+)"), ("function", r"^[ \t]*(?:private\s+|public\s+|protected\s+)?def\s+(?:self\.|\w+\.)?([\w]+[?!=]?|\[\]=?|[-+*/%<>=!~]+)")]),
    ".lua": ("lua", "end", [("function", r"^[ \t]*(?:local\s+)?function\s+([\w.:]+)"), ("function", r"^[ \t]*(?:local\s+)?([\w.]+)\s*=\s*function\b")]),
    ".ex .exs": ("hash", "end", [("module", r"^[ \t]*defmodule\s+([\w.]+)"), ("interface", r"^[ \t]*defprotocol\s+([\w.]+)"), ("function", r"^[ \t]*def(?:p|macro|macrop)?\s+([\w]+[?!]?)"), ("struct", r"^[ \t]*(defstruct)\b")]),
    ".jl": ("hash", "end", [("module", r"^[ \t]*module\s+(\w+)"), ("function", r"^[ \t]*(?:function|macro)\s+([\w.]+!?)"), ("struct", r"^[ \t]*(?:mutable\s+)?struct\s+(\w+)"), ("type", r"^[ \t]*abstract\s+type\s+(\w+)"), ("function", r"^([\w]+!?)\((?=[^=\n]*\)\s*(?:::\w+\s*)?=(?!=))")]),
    ".hs": ("haskell", "indent", [("module", r"^module\s+([\w.]+)"), ("type", r"^(?:data|newtype|type)\s+(\w+)"), ("interface", r"^class\s+(?:.*=>\s*)?(\w+)"), ("function", r"^([a-z_][\w']*)\s*::")]),
    ".sql": ("sql", "statement", [("class", r"(?i)^[ \t]*create\s+(?:or\s+replace\s+)?(?:global\s+|local\s+)?(?:temp(?:orary)?\s+)?(?:materialized\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)"), ("function", r"(?i)^[ \t]*create\s+(?:or\s+replace\s+)?(?:function|procedure|trigger)\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)"), ("variable", r"(?i)^[ \t]*create\s+(?:unique\s+)?index\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)")]),
    ".yaml .yml": ("hash", "indent", [("variable", r"^[ \t]*(?:-\s+)?([\w./-]+)\s*:(?=\s|$)")]),
    ".py": ("hash", "indent", [("class", r"^[ \t]*class\s+(\w+)"), ("function", r"^[ \t]*(?:async\s+)?def\s+(\w+)")]),
}

# Import statements by extension, the module as first group; Go also has lists of them.
IMPORTS = {
    ".py": r"^[ \t]*(?:from|import)\s+([\w.]+)", ".js .jsx .ts .tsx": r"""^[ \t]*(?:import|export)\b[^'"\n;]*?['"]([^'"\n]+)['"]|\brequire\(\s*['"]([^'"\n]+)['"]\s*\)""",
    ".java .kt .kts .scala .groovy": r"^[ \t]*import\s+(?:static\s+)?([\w.]+)", ".cs": r"^[ \t]*using\s+(?:static\s+)?([\w.]+)\s*;", ".php": r"^[ \t]*use\s+([\w\\]+)",
    ".go": r'^[ \t]*import\s+(?:[\w.]+\s+)?"([^"\n]+)"', ".rs": r"^[ \t]*(?:pub\s+)?use\s+([\w:]+)", ".rb": r"""^[ \t]*require(?:_relative)?\s*\(?['"]([^'"\n]+)['"]""",
    ".dart": r"""^[ \t]*(?:import|export)\s+['"]([^'"\n]+)['"]""", ".c .h .cpp .hpp .cc .hh .cxx .m .mm": r'^[ \t]*\#\s*(?:include|import)\s+[<"]([^>"\n]+)|^[ \t]*@import\s+([\w.]+)',
    ".swift": r"^[ \t]*import\s+(\w+)", ".lua": r"""\brequire\s*\(?\s*['"]([^'"\n]+)['"]""", ".hs": r"^import\s+(?:qualified\s+)?([\w.]+)", ".ex .exs": r"^[ \t]*(?:alias|import|use|require)\s+([\w.]+)",
    ".jl": r"^[ \t]*(?:using|import)\s+([\w.]+)", ".zig": r'@import\("([^"\n]+)"\)',
}

_CONTAINERS = ("class", "interface", "trait", "struct", "enum", "module", "impl")
_OWNERS = ("class", "interface", "trait", "struct", "enum", "impl")
_RESERVED = frozenset("if for while switch catch return function else new throw do try await typeof super this constructor_ when match assert sizeof elif unless until yield delete case not and or in is fn print".split()) - {"constructor_"}
#: Extensions whose parameters are written type first.
_TYPE_FIRST = frozenset(".java .cs .groovy .dart .c .h .cpp .hpp .cc .hh .cxx .php".split())

_SPEC = {e: spec for es, spec in LANGUAGES.items() for e in es.split()}
_IMPORT = {e: re.compile(p, re.M) for es, p in IMPORTS.items() for e in es.split()}
_MASK = {k: re.compile(p, re.M) for k, p in MASKS.items()}
_PATTERNS = {e: [(kind, re.compile(p, re.M)) for kind, p in patterns] for e, (_, _, patterns) in _SPEC.items()}
# What a documentation comment begins with, by extension; any comment elsewhere.
DOCUMENTATION = {".js .jsx .ts .tsx .java .php .kt .kts .scala .groovy": ("/**",), ".rs .dart .cs .swift .zig": ("///", "//!", "/**")}
_DOC = {e: marks for es, marks in DOCUMENTATION.items() for e in es.split()}
_OPEN = {"(": ")", "[": "]", "{": "}"}
_CALL = re.compile(r"(?<![\w$])([A-Za-z_$][\w$]*[?!]?)\s*\(")


class Declared(NamedTuple):
    kind: str
    name: str
    start: int
    name_at: int
    end: int
    docstring: str | None
    parameters: list[tuple[str, str | None]] | None
    return_type: str | None
    decorators: list[str]
    bases: list[tuple[str, str]]
    is_async: bool
    parent: int | None


def mask(text: str, family: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with comments and literals blanked, and the places of the comments."""
    comments: list[tuple[int, int]] = []

    def blank(m: re.Match) -> str:
        if m["c"] is not None:
            comments.append(m.span())
        return re.sub(r"[^\n]", " ", m[0]) if "\n" in m[0] else " " * len(m[0])

    return _MASK[family].sub(blank, text), comments


def closing(masked: str, at: int) -> int:
    """The place of the bracket that closes the one at ``at``, or the end."""
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(masked, at):
        depth += 1 if m[0] in _OPEN else -1
        if depth <= 0:
            return m.start()
    return len(masked)


def pieces(text: str) -> list[str]:
    """Parts between commas outside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and text[i - 1 : i] not in ("-", "="):
            depth = max(0, depth - 1)
        elif c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [p for p in (x.strip() for x in [*out, text[start:]]) if p]


def parameters_of(inner: str, extension: str) -> list[tuple[str, str | None]]:
    """(name, type) of each parameter in the text between the brackets."""
    found: list[tuple[str, str | None]] = []
    if extension == ".dart":  # named and optional ones
        inner = re.sub(r"[{}\[\]]", " ", inner)
    for p in pieces(inner):
        if extension in (".js", ".jsx", ".ts", ".tsx") and re.match(r"(?:\.\.\.)?\s*[\[{]", p):  # a pattern stands for its text
            end = closing(p, re.search(r"[\[{]", p).start()) + 1
            kind = p[end:].partition("=")[0].strip()
            found.append((" ".join(p[:end].split()), kind.removeprefix(":").strip() or None))
            continue
        p = re.sub(r"@\w+(?:\([^)]*\))?\s*|^\s*(?:final|var|val|mut|ref|out|in|this|readonly|public|private|protected|required|inout)\s+", "", p)
        p = re.split(r"(?<![=!<>])=(?![=>])|\\\\", p)[0].strip()
        if not p or p in ("self", "&self", "&mut self", "mut self", "this", "void", "*", "/"):
            continue
        if extension == ".go":
            name, _, kind = p.partition(" ")
            found.append((name, kind.strip() or None))
        elif extension in _TYPE_FIRST:
            m = re.match(r"(?s)(.*?)[\s*&]*([$.&]*[\w$]+)(?:\[\])*$", p)
            found.append((m[2].lstrip("&."), m[1].strip() or None) if m else (p, None))
        else:
            name, _, kind = p.partition("::" if extension == ".jl" else ":")
            name = name.strip().split()[-1] if name.strip() else p
            found.append((name.lstrip("*&.").rstrip("?"), kind.strip() or None))
    if extension == ".go":  # a, b int
        for i in range(len(found) - 2, -1, -1):
            if found[i][1] is None:
                found[i] = (found[i][0], found[i + 1][1])
    return found


def _bases(header: str, extension: str, kind: str) -> list[tuple[str, str]]:
    """(relation, name) of what a class header says it extends or implements."""
    header = re.sub(r"<[^<>]*(?:<[^<>]*>[^<>]*)*>", "", header)
    names = lambda part: [m[0] for p in pieces(re.sub(r"\([^()]*\)", "", part)) if (m := re.match(r"[\w$.:\\]+", re.sub(r"^(?:public|private|protected|virtual)\s+", "", p)))]
    if extension in (".rb",):
        return [("inherits", m[1])] if (m := re.match(r"\s*<\s*([\w:]+)", header)) else []
    if extension in (".cs", ".kt", ".kts", ".swift", ".cpp", ".hpp", ".cc", ".hh", ".cxx", ".m", ".mm", ".rs"):
        _, colon, rest = re.sub(r"^\s*\([^()]*(?:\([^()]*\)[^()]*)*\)", "", header).partition(":")
        rest = re.split(r"\bwhere\b", rest)[0]
        found = names(rest) if colon else []
        interface = (lambda n: bool(re.match(r"I[A-Z]", n))) if extension == ".cs" else lambda n: False
        return [("implements" if interface(n) else "inherits", n) for n in found]
    out = []
    for m in re.finditer(r"\b(extends|implements|with|on)\s+((?:(?!\b(?:extends|implements|with|on)\b)[^{])*)", header):
        relation = "inherits" if m[1] == "extends" or m[1] == "on" else "implements"
        out += [(relation, n) for n in names(m[2])]
    return out


def _documentation(text: str, masked: str, comments: list[tuple[int, int]], starts: list[int], at: int, extension: str) -> tuple[str | None, list[str]]:
    """The comment right above a declaration and the annotations between."""
    decorators: list[str] = []
    line = masked.rfind("\n", 0, at) + 1
    while True:
        above = masked.rfind("\n", 0, max(0, line - 1)) + 1
        row = masked[above : line - 1].strip() if line else ""
        if row and re.match(r"@\w|#\[|\[\w+", row):
            decorators.append(text[above : line - 1].strip().lstrip("@"))
            line = above
            continue
        break
    parts: list[str] = []
    i = bisect.bisect_left(starts, line) - 1
    while i >= 0 and not text[comments[i][1] : line].strip() and text.count("\n", comments[i][1], line) <= 1 and not masked[masked.rfind("\n", 0, comments[i][0]) + 1 : comments[i][0]].strip():
        if not text.startswith(_DOC.get(extension, ""), comments[i][0]):
            break
        parts.append(text[comments[i][0] : comments[i][1]])
        line = text.rfind("\n", 0, comments[i][0]) + 1
        if parts[-1].startswith("/*"):
            break
        i -= 1
    rows: list[str] = []
    for part in reversed(parts):
        body = re.sub(r"^/\*+|\*+/$|^\{-|-\}$|^--\[\[|\]\]$", "", part)
        rows += [re.sub(r"^\s*(?:///?!?|\#+|--|\*)? ?", "", x).rstrip() for x in body.split("\n")]
    return "\n".join(rows).strip() or None, decorators[::-1]


def _extent(masked: str, at: int, style: str, line_start: int, extension: str, kind: str) -> tuple[int, int]:
    """(end of the header, end of the declaration) for a name that ends at ``at``."""
    if style == "objc" and kind in ("class", "interface"):
        end = masked.find("@end", at)
        return masked.find("\n", at) if "\n" in masked[at:] else len(masked), len(masked) if end < 0 else end
    if style == "brace" or style == "objc":
        i = at
        while i < len(masked):
            c = masked[i]
            if c == "{":
                return i, min(len(masked), closing(masked, i) + 1)
            if c in "([":
                i = closing(masked, i)
            elif c in ";}":
                return i, i
            elif c == "=":
                arrow = masked[i + 1 : i + 2] == ">"
                if masked[i + 1 : i + 2] == "=":
                    i += 1
                elif (arrow or extension in (".kt", ".kts", ".scala")) and masked[i + 1 + arrow : i + 80].lstrip()[:1] != "{":
                    end = re.compile(r"[;\n]").search(masked, i + 2)
                    return i, end.start() if end else len(masked)
            i += 1
        return len(masked), len(masked)
    eol = masked.find("\n", at)
    eol = len(masked) if eol < 0 else eol
    if style == "statement":
        end = masked.find(";", at)
        return (end, end) if end >= 0 else (len(masked), len(masked))
    indent = re.compile(r"[ \t]*").match(masked, line_start)[0]
    if style == "end":
        head = re.sub(r"\([^()]*\)", "()", masked[line_start:eol])
        if re.search(r"(?:;|\bdo\b.*|\))\s*end\b|,\s*do:|\)\s*=(?!=)|\bdef\s+[\w.]+[?!]?\s+=\s", head) and not re.search(r"=\s*function\b(?!.*\bend\b)", head):
            return eol, eol
        m = re.compile(rf"^{indent}end\b", re.M).search(masked, eol)
        return eol, m.end() if m else len(masked)
    m = re.compile(rf"\n[ \t]{{0,{len(indent)}}}(?=[^\s)\]}}])").search(masked, eol)
    return eol, m.start() if m else len(masked)


def scan(text: str, extension: str) -> tuple[list[Declared], str]:
    """The declarations of a text in order of their names, and the mask; none for an unknown extension."""
    if extension not in _SPEC:
        return [], text
    family, style, _ = _SPEC[extension]
    masked, comments = mask(text, family)
    starts = [a for a, _ in comments]
    hits: dict[int, tuple[str, int, int]] = {}
    for kind, pattern in _PATTERNS[extension]:
        for m in pattern.finditer(masked):
            if m.start(1) not in hits and m[1].lstrip("#") not in _RESERVED:
                hits[m.start(1)] = (kind, m.start(), m.end(1))
    out: list[Declared] = []
    open_: list[int] = []
    for name_at in sorted(hits):
        kind, start, name_end = hits[name_at]
        start += len(re.compile(r"\s*").match(masked, start)[0])
        name = text[name_at:name_end].strip('"')
        line_start = masked.rfind("\n", 0, start) + 1
        head_end, end = _extent(masked, name_end, style, line_start, extension, kind)
        while open_ and out[open_[-1]].end <= start:
            open_.pop()
        parent = open_[-1] if open_ else None
        inside = parent is not None and out[parent].kind in _OWNERS
        called = re.compile(r"\s*(?:<[^;{}()]*>)?\s*\(").match(masked, name_end)
        parameters = return_type = None
        if kind == "test":
            kind, name = "function", text[start:head_end].strip()
        if kind in ("function", "method"):
            if extension in (".js", ".jsx", ".ts", ".tsx", ".java", ".cs", ".groovy") and hits[name_at][0] == "method":
                # A call looks like a method; a method has a body, or none at all in a type.
                if not called or not inside:
                    continue
                after = masked[closing(masked, called.end() - 1) + 1 :].lstrip()[:6]
                if not (after[:1] == "{" or after[:1] in ";:" and (out[parent].kind == "interface" or ":" in after[:1] or re.search(r"\b(?:abstract|native)\b", masked[start:name_at])) or after.startswith(("throws", "where", "=>"))):
                    continue
                if masked[start:name_at].strip().split(" ")[-1:] in (["new"], ["return"], ["throw"], ["else"], ["await"]):
                    continue
            if extension in (".dart", ".c", ".h", ".cpp", ".hpp", ".cc", ".hh", ".cxx", ".m", ".mm") and hits[name_at][0] != "function" or extension in (".c", ".h", ".cpp", ".hpp", ".cc", ".hh", ".cxx"):
                if masked[start:name_at].strip().split(" ")[-1:] in (["new"], ["return"], ["throw"], ["else"], ["await"]):
                    continue
                if extension != ".m" and extension != ".mm" and called:
                    after = masked[closing(masked, called.end() - 1) + 1 :].lstrip()[:8]
                    body = after[:1] == "{" or after.startswith(("=>", "async", "const", "override", "noexcept", "sync")) or after[:1] == ":" and inside or after[:1] == ";" and inside and bool(masked[start:name_at].strip())
                    if not body or parent is not None and out[parent].kind in ("function", "method"):
                        continue
            if called:
                close = closing(masked, called.end() - 1)
                parameters = parameters_of(text[called.end() : close], extension)
                tail = masked[close + 1 : head_end]
                m = re.match(r"\s*(?:->|:|=>(?=\s*\w+\s*\{))\s*([^{=;\n]+)", tail)
                return_type = text[close + 1 + m.start(1) : close + 1 + m.end(1)].strip() or None if m else None
                if extension == ".go":
                    return_type = text[close + 1 : head_end].strip() or None
                elif extension in _TYPE_FIRST and return_type is None:
                    before = re.sub(rf"^{_MODS}", "", masked[start:name_at].strip() + " ").strip()
                    return_type = re.sub(r"^(?:@[\w.]+(?:\([^)]*\))?\s*)+|<[^>]*>\s+(?=\w)", "", before).removeprefix("function").strip() or None
            elif kind == "function" and extension in (".js", ".jsx", ".ts", ".tsx"):
                m = re.compile(r"[^(\n]*?(?:\(|(?<=[=\s])([\w$]+)\s*=>)").match(masked, name_end)
                if m:
                    parameters = [(m[1], None)] if m[1] else parameters_of(text[m.end() : closing(masked, m.end() - 1)], extension)
            if kind == "function" and inside:
                kind = "method"
            elif kind == "method" and not inside and extension not in (".go", ".m", ".mm"):
                kind = "function"
        doc, decorators = _documentation(text, masked, comments, starts, start, extension)
        bases = _bases(masked[name_end:head_end], extension, kind) if kind in _CONTAINERS and kind not in ("module", "enum") or extension == ".swift" and kind == "enum" else []
        if kind == "impl":
            trait = re.match(r"(?:unsafe\s+)?impl\b(?:<[^{]*?>)?\s+([\w:]+)(?:<[^{]*?>)?\s+for\b", masked[start:head_end])
            bases = [("implements", trait[1])] if trait else []
        is_async = bool(re.search(r"\b(?:async|suspend)\b", masked[start:name_at]) or extension == ".dart" and re.match(r"\s*async\b", masked[head_end - 6 : head_end]))
        out.append(Declared(kind, name, start, name_at, end, doc, parameters, return_type, decorators, bases, is_async, parent))
        if kind in _CONTAINERS or kind in ("function", "method") or extension in (".yaml", ".yml"):
            open_.append(len(out) - 1)
    if extension in (".yaml", ".yml"):  # keys by their paths
        for i, d in enumerate(out):
            if d.parent is not None:
                out[i] = d._replace(name=f"{out[d.parent].name}.{d.name}")
    return out, masked


def modules(text: str, masked: str, extension: str) -> list[tuple[int, str]]:
    """(place, module) of the import statements outside comments."""
    pattern = _IMPORT.get(extension)
    if pattern is None:
        return []
    # The statement's keyword must stand in the mask, as literals are blank there.
    out = [(m.start(), next(x for x in m.groups() if x)) for m in pattern.finditer(text) if masked[m.start() : m.end()].strip()]
    if extension == ".go":
        for m in re.finditer(r"^import\s*\(", masked, re.M):
            stop = closing(masked, m.end() - 1)
            out += [(m.end() + q.start(), q[1]) for q in re.finditer(r'"([^"\n]+)"', text[m.end() : stop])]
    return sorted(out)


def calls(declared: list[Declared], masked: str) -> set[tuple[int, int]]:
    """(caller, callee) by bare name among the functions of a text; the last function of a name counts, recursion does not."""
    own = [(i, d) for i, d in enumerate(declared) if d.kind in ("function", "method")]
    by_name = {d.name: i for i, d in own}
    if not by_name:
        return set()
    names_at = {d.name_at for _, d in own}
    out: set[tuple[int, int]] = set()
    open_: list[int] = []
    ahead = iter(own)
    coming = next(ahead, None)
    for m in _CALL.finditer(masked):
        if m[1] not in by_name or m.start(1) in names_at:
            continue
        while coming and coming[1].start <= m.start():
            open_.append(coming[0])
            coming = next(ahead, None)
        while open_ and declared[open_[-1]].end <= m.start():
            open_.pop()
        if open_ and open_[-1] != by_name[m[1]]:
            out.add((open_[-1], by_name[m[1]]))
    return out
