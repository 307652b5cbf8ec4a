"""Functions paired with their documentation.

A packrat grammar per language reads a file as declarations and other tokens; a declaration is
a documentation comment with the function below it (in Python: a function with its docstring).
Semantic actions give the documentation, the name with its line, the parameters and the code by
their source offsets.  Pairs with trivial documentation are dropped, and those of files that do
not parse.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from graphloom.llm import peg
from graphloom.llm.broken import language_of, parse
from graphloom.llm.peg import alt, cap, many, opt, rule, seq, term
from graphloom.llm.syntax import lexer as lx
from graphloom.llm.syntax.ruby import Ruby
from graphloom.session import spread

DOC, BLOCK, LINE, DOCLINE = "\4", "\5", "\6", "\7"
_LINE_MARK = {"go": "//", "rb": "#", "rs": "///", "dart": "///"}


class _Comments:
    """The lexer of a language with comments as tokens."""

    def __init__(self, language: str, base: lx.Lexer):
        space, _, comments = base.skip.partition("|")
        if comments.startswith(r"\\\n"):  # a continued line
            space, comments = space + r"|\\\n", comments.partition("|")[2]
        body = base.pattern.pattern.split(")*+(", 1)[1]
        self.pattern = re.compile(rf"((?>{space})*+)({comments}|{body}")
        self.base, self.line_doc, self.hash = base, _LINE_MARK.get(language) == "///", language in ("rb", "php")
        self.table = {k: v for k, v in base.table.items() if not (self.hash and k == "#")}.get

    def special(self, t: str) -> str:
        """The code of a comment, or of a token that is not in the table yet."""
        if t[:2] == "//":
            return DOCLINE if self.line_doc and t[2:3] == "/" and t[3:4] != "/" else LINE
        if t[:2] == "/*" and len(t) > 3:
            return DOC if t[2] == "*" and len(t) > 4 else BLOCK
        if t[0] == "#" and self.hash and t[1:2] != "[" or t.startswith("=begin"):
            return LINE if t[0] == "#" else BLOCK
        return self.base.code(t)

    def run(self, text: str) -> tuple[str, list[int]]:
        """Codes with comments, and the offset of each token."""
        special, table = self.special, self.table
        found = self.pattern.findall(text) if self.pattern.groups == 2 else [(m[1], m[2]) for m in self.pattern.finditer(text)] if not self.base.double else self._doubled(text)
        ends = list(itertools.accumulate([len(gap) + len(t) for gap, t in found]))
        pairs = [(t, end - len(t)) for (_, t), end in zip(found, ends) if t]
        if not isinstance(self.base, lx.LineLexer):
            return "".join([table(t) or special(t) for t, _ in pairs]) + lx.END, [*[o for _, o in pairs], len(text)]
        out, at, last, after = [], [], "N", self.base.ends_after
        for t, o in pairs:
            c = table(t) or ("N" if t[0] == "\n" else special(t))
            if c == "N" and (last == "N" or after is not None and last not in after and last not in (LINE, BLOCK)):
                continue
            out.append(c)
            at.append(o)
            last = c
        return "".join(out) + lx.END, [*at, len(text)]

    def _doubled(self, text: str) -> list[tuple[str, str]]:
        """(skipped, token) where a token may carry a regular expression behind it, which gets the code of a number."""
        out = []
        last = self.pattern.groups
        for m in self.pattern.finditer(text):
            out.append((m[1], m[2]))
            if m[last]:
                out += [(text[m.end(2) : m.start(last)], "0"), (m[last][1:], "")]
        return out

    def without_comments(self, codes: str) -> str:
        """The codes as the lexer of the grammar gives them."""
        bare = _COMMENT_CODES.sub("", codes)
        if isinstance(self.base, lx.LineLexer):
            bare = re.sub("N+", "N", bare[:-1] + "N").removeprefix("N")
            if self.base.ends_after is not None:
                bare = re.sub(f"(?<![{re.escape(self.base.ends_after)}])N(?!$)", "", bare)
            bare += lx.END
        return bare


_COMMENT_CODES = re.compile(f"[{DOC}{BLOCK}{LINE}{DOCLINE}]")


# --- grammars ---------------------------------------------------------------------------

_balanced = peg.balanced("([{")
_block = peg.balanced("{")
_params = rule(cap("params", peg.balanced("(")))
_square = peg.balanced("[")
_balanced_type = peg.balanced("([")
_generic = peg.Memo()
_generic.is_(seq(term("<"), many(alt(term(r"[^<>(){}\[\];\x00]+"), _generic, _balanced)), term(">")))
_notes = rule(many(term(f"[{BLOCK}{LINE}]")))


def _kw(lexer: lx.Lexer, words: str) -> str:
    return "".join(lexer.keywords[w] for w in words.split())


def _script() -> peg.Rule:
    k = lambda words: _kw(lx.JS, words)
    names = "i" + lx.JS.soft
    name = cap("name", term(f'[{names}P]|[{k("delete get set default new in of")}](?=[(<])'))
    plain = cap("name", term(f"[{names}]"))
    decorator = rule(term(f"@[{names}](?:\\.[{names}])*"), opt(_balanced))
    returns = opt(rule(term(":"), many(alt(term(r"[^{}()\[\];=f<>\x00]+"), _generic, seq(_balanced_type, term("f(?=[^{])")), _balanced_type), least=1)))
    head = rule(opt(_generic), _params, returns)
    function = rule(term(f"[{k('export')}]?[{k('default')}]?[{k('declare')}]?[{k('async')}]?{k('function')}\\*?"), plain, head, alt(_block, term(";")))
    # Without a semicolon an expression ends before what only begins statements.
    expression = rule(many(alt(term(f"[^;{{}}()\\[\\]\\x00{DOC}{k('const let var import export return if for while do switch try throw break continue')}]+"), _balanced)))
    arrow = rule(term(f"[{k('async')}]?"), alt(head, cap("params", term(f"[{names}]"))), term("f"), alt(_block, expression))
    bound = rule(
        term(f"[{k('export')}]?[{k('declare')}]?{k('const')}"), plain, opt(seq(term(":"), many(alt(term(r"[^=;(){}\[\]\x00]+"), _balanced)))), term("="),
        alt(seq(term(f"[{k('async')}]?{k('function')}\\*?[{names}]?"), head, _block), arrow),
    )
    method = rule(term(f"(?:[{k('async static get set public private protected readonly abstract override')}](?=[^(<=]))*\\*?"), name, opt(term(r"\?")), head, alt(_block, term(";")))
    return seq(cap("doc", term(DOC)), _notes, many(decorator), _notes, cap("code", alt(function, bound, method)))


def _java() -> peg.Rule:
    k = lambda words: _kw(lx.JAVA, words)
    names = "i" + lx.JAVA.soft
    annotation = rule(term(f"@[{names}](?:\\.[{names}])*"), opt(_balanced))
    modifier = term(f"[{k('public private protected static final abstract native synchronized strictfp default')}]+")
    kind = rule(term(f"[{names}{k('int long short byte char boolean float double void')}]"), many(alt(term(f"\\.[{names}]"), _generic)), term(r"(?:\[\])*"))
    head = rule(many(alt(annotation, modifier, _notes_one)), opt(_generic), opt(seq(kind, peg_ahead(f"[{names}]\\("))), cap("name", term(f"[{names}](?=\\()")), _params)
    throws = opt(rule(term(k("throws")), term(r"[^{;\x00]+")))
    return seq(cap("doc", term(DOC)), _notes, many(annotation), cap("code", seq(head, term(r"(?:\[\])*"), throws, alt(_block, term(";")))))


def peg_ahead(pattern: str) -> peg.Rule:
    found = term(pattern)

    def run(p: peg.Run, i: int) -> peg.Result:
        return (i, ()) if found(p, i) else None

    return run


_notes_one = term(f"[{BLOCK}{LINE}]")


def _php() -> peg.Rule:
    k = lambda words: _kw(lx.PHP, words)
    attribute = rule(term("#(?=\\[)"), _square)
    modifiers = term(f"[{k('public private protected static abstract final readonly')}]*")
    returns = opt(seq(term(":"), term(r"[^{;\x00]+")))
    return seq(cap("doc", term(DOC)), _notes, many(attribute), cap("code", seq(modifiers, term(k("function") + "&?"), cap("name", term(r"[i一-鿿](?=\()")), _params, returns, alt(_block, term(";")))))


def _rust() -> peg.Rule:
    k = lambda words: _kw(lx.RUST, words)
    attribute = rule(term("#!?(?=\\[)"), _square)
    visible = opt(rule(term(k("pub")), opt(_balanced)))
    before = rule(many(alt(cap("doc", term(f"[{DOC}{DOCLINE}]")), attribute), least=1))
    tail = rule(many(alt(term(r"[^{};()\[\]<>\x00]+"), _balanced_type, _generic, term(">"))))
    return seq(before, cap("code", seq(visible, term(f'(?:[{k("const async unsafe extern")}]"?)*{k("fn")}'), cap("name", term("[i" + lx.RUST.soft + "]")), opt(_generic), _params, tail, alt(_block, term(";")))))


def _dart() -> peg.Rule:
    k = lambda words: _kw(lx.DART, words)
    names = "i" + lx.DART.soft
    annotation = rule(term(f"@[{names}](?:\\.[{names}])*"), opt(_balanced))
    before = rule(many(alt(cap("doc", term(DOCLINE)), annotation), least=1))
    modifier = term(f"[{k('static external const factory abstract covariant late final')}](?=[{names}{k('void')}])")
    kind = rule(term(f"[{names}{k('void')}](?:\\.[{names}])?"), opt(_generic), term(r"\??"), peg_ahead(f"[{names}]"))
    head = rule(many(modifier), opt(kind), term(f"(?:[{k('get set')}](?=[{names}]))?"), cap("name", term(f"[{names}](?:\\.[{names}])?(?=[(<f{{{k('async')}])")), opt(_generic), opt(_params))
    body = rule(term(f"(?:[{k('async sync')}]\\*?)?"), alt(_block, seq(term("f"), many(alt(term(r"[^;{}()\[\]\x00]+"), _balanced)), term(";")), term(";")))
    starters = opt(seq(term(":"), many(alt(term(r"[^;{}()\[\]\x00]+"), peg.balanced("("), _square))))
    return seq(before, cap("code", seq(head, starters, body)))


def _go() -> peg.Rule:
    k = lambda words: _kw(lx.GO, words)
    before = rule(many(seq(cap("doc", term(LINE)), term("N?")), least=1))
    tail = rule(many(alt(term(r"[^{}()\[\]N;\x00]+"), _balanced_type, seq(term(f"[{k('struct interface')}]"), _block))))
    return seq(before, cap("code", seq(term(k("func")), opt(_balanced), cap("name", term("i")), opt(_square), _params, tail, opt(_block))))


def _ruby() -> peg.Rule:
    k = lambda words: _kw(lx.RUBY, words)
    before = rule(many(seq(cap("doc", term(LINE)), term("N?")), least=1))
    name = cap("name", term(r"[i一-鿿]|\[\]=?|[-+*/%<>b!~]"))
    return seq(before, term("i?"), cap("code", seq(term(k("def")), term(f"(?:[i{k('self')}]\\.)?"), name, opt(_params))))


def _python() -> peg.Rule:
    k = lambda words: _kw(lx.PYTHON, words)
    returns = opt(rule(term("r"), many(alt(term(r"[^:N()\[\]{}\x00]+"), _balanced))))
    doc = cap("doc", term('"+(?=[N;])'))
    block = peg.balanced(lx.INDENT)

    def suite(p: peg.Run, i: int) -> peg.Result:
        """An indented block that opens with its documentation."""
        inner, whole = doc(p, i + 1), block(p, i)
        return (whole[0], inner[1]) if inner and whole else None

    body = rule(term(":"), alt(seq(term("N"), suite), seq(doc, term("[^N\\x00]*"))))
    return cap("code", rule(term(f"[{k('async')}]?{k('def')}"), cap("name", term("[i" + lx.PYTHON.soft + "]")), opt(_square), _params, returns, body))


#: language -> (lexer, grammar of a declaration, codes that it begins with)
GRAMMARS = {
    "js": (lx.JS, _script(), DOC), "ts": (lx.JS, _script(), DOC), "java": (lx.JAVA, _java(), DOC), "php": (lx.PHP, _php(), DOC),
    "rs": (lx.RUST, _rust(), DOC + DOCLINE), "dart": (lx.DART, _dart(), DOCLINE), "go": (lx.GO, _go(), LINE), "rb": (lx.RUBY, _ruby(), LINE),
    "py": (lx.PYTHON, _python(), _kw(lx.PYTHON, "def async")),
}
_FILES = {language: peg.scan(grammar, starts) for language, (_, grammar, starts) in GRAMMARS.items()}
_LEXERS = {language: _Comments(language, base) if language != "py" else None for language, (base, _, _) in GRAMMARS.items()}


def script_start(text: str, language: str) -> int:
    """Where the code begins: in PHP behind the opening tag, or the end of a text without one."""
    if language != "php":
        return 0
    m = re.search(r"<\?(?:php\b|=)", text)
    return m.end() if m else len(text)


def lexed(text: str, language: str) -> tuple[str, list[int]]:
    """Codes and offsets of a text, with comments except in Python."""
    if language == "py":
        codes, at = lx.PYTHON._run(text)
        return codes, [max(0, x - 1) for x in at[:-1]] + [at[-1]]
    return _LEXERS[language].run(text)


def declarations(text: str, language: str, tokens: tuple[str, list[int]] | None = None) -> Iterator[dict]:
    """Each function with a documentation comment: name, line, doc (raw), params and code as text."""
    whole = text
    shift = script_start(text, language)
    text = text[shift:]
    codes, at = tokens or lexed(text, language)
    seen = set()
    for captures in _FILES[language](peg.Run(codes)):
        spans = {label: (a, b) for label, a, b in captures}
        start = at[spans["name"][0]]
        if start in seen:
            continue
        seen.add(start)
        docs = [(at[x], at[y] if y < len(at) else len(text)) for label, x, y in captures if label == "doc"]
        first, last = spans["code"]
        code_start, code_stop = at[first], at[last]
        raw = [text[x:y] for x, y in docs]
        if language in ("go", "rb"):
            raw = _touching(text, docs, code_start)
            if not raw:
                continue
        if language == "py":
            code_stop = _python_end(text, codes, at, last)
        params = text[at[spans["params"][0]] : at[spans["params"][1]]] if "params" in spans else ""
        yield {
            "name": text[start : _token_end(text, start)], "line": whole.count("\n", 0, start + shift) + 1, "doc": raw, "params": params, "code": text[code_start:code_stop].rstrip(), "first": first,
        }


def _token_end(text: str, start: int) -> int:
    m = re.compile(r"[#@$]?[\w$]+(?:\.[\w$]+)?[?!]?|\[\]=?|[-+*/%<>=!~]+").match(text, start)
    return m.end() if m else start + 1


def _touching(text: str, docs: list[tuple[int, int]], start: int) -> list[str]:
    """The comment lines right above the line of ``start``, each alone on its line."""
    line = text.count("\n", 0, start)
    out = []
    for a, _ in reversed(docs):
        begin = text.rfind("\n", 0, a) + 1
        if text.count("\n", 0, a) != line - 1 or text[begin:a].strip():
            break
        end = text.find("\n", a)
        out.append(text[a : end if end >= 0 else len(text)])
        line -= 1
    return out[::-1]


def _python_end(text: str, codes: str, at: list[int], last: int) -> int:
    """The end of the last token before the place ``last``, line ends and dedents aside."""
    while codes[last - 1] in "N" + lx.DEDENT:
        last -= 1
    return lx.PYTHON.pattern.match(text, at[last - 1]).end(1)


_RUBY_DEF = _kw(lx.RUBY, "def")


def _ruby_code(text: str, tokens: tuple[str, list[int]], first: int, parsed: Ruby) -> str:
    """The method whose ``def`` is at the place ``first``: its end is where the grammar of the language found it.

    Both token sequences differ in comments and line ends only.
    """
    codes, at = tokens
    places = [m.start() for m in re.finditer(_RUBY_DEF, parsed.s)]
    end = parsed.spans[places[codes.count(_RUBY_DEF, 0, first)]]
    solid = len(parsed.s[:end].replace("N", ""))
    last = next(itertools.islice((j for j, c in enumerate(codes) if c != "N" and not _COMMENT_CODES.match(c)), solid - 1, None))
    return text[at[first] : at[last + 1]].rstrip()


# --- documentation ----------------------------------------------------------------------

_QUOTE = re.compile(r"""^[rRuUbBfF]*("{3}|'{3}|"|')""")


def doc_text(raw: list[str], language: str) -> str:
    """The words of a documentation comment without its markers."""
    if language == "py":
        m = _QUOTE.match(raw[0])
        body = raw[0][m.end() :].rstrip()
        return body.removesuffix(m[1]).strip()
    lines = []
    for piece in raw:
        if piece.lstrip().startswith("/**"):
            inner = piece.strip()[3:].rsplit("*/", 1)[0]
            lines += [re.sub(r"^\s*\*? ?", "", x) for x in inner.split("\n")]
        else:
            lines.append(re.sub(r"^\s*(?:///?|\#+)!? ?", "", piece).rstrip())
    return "\n".join(lines).strip()


# What opens a tag section, and what opens a placeholder sentence.
TAG = re.compile(r"^\s*(?:@\w+|\\(?:param|return)\b|:(?:param|type|returns?|rtype|raises?|arg|yields?)\b[^:]*:|(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields|Throws|Examples?)\s*:?\s*$|\#+\s*(?:Arguments|Parameters|Returns?|Errors|Panics|Safety|Examples?)\s*$)", re.I)
PLACEHOLDER = re.compile(
    r"^\W*(?:todo|fixme|tbd|tbc|xxx|hack|wip|placeholder|\{?@?inherit[- ]?doc\}?|(?:documentation|description|docs?|comment)\s+(?:goes here|here|missing|pending|to follow|to come)|(?:please\s+)?(?:add|write|insert|needs?|missing|no)\s+(?:a\s+|the\s+|some\s+|more\s+)?(?:documentation|docs?|description|comment|docstring)\b|document (?:me|this)|(?:auto[- ]?)?generated\b|(?:this (?:file|code|method|function) (?:is|was) )?(?:auto[- ]?(?:matically )?)?generated|see (?:the )?(?:parent|base|super)|inherited from|same as (?:the )?(?:parent|base|super)|do not edit|undocumented)",
    re.I,
)
_FILLER = {"the", "a", "an", "function"}


def described(text: str) -> str:
    """The description: the text without tag sections."""
    out = []
    for line in text.split("\n"):
        if TAG.match(line):
            break
        out.append(line)
    return "\n".join(out).strip()


def sentences(text: str) -> list[str]:
    """Rough sentences: after . ! ? and at lines that open with a to-do."""
    text = re.sub(r"\n(?=\s*(?:TODO|FIXME|TBD|XXX)\b)", "\n\n", text)
    parts = re.split(r"(?<=[.!?])\s+|\n\s*\n", text)
    return [" ".join(x.split()) for x in parts if x.strip()]


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:['’][^\W_]+)*", text)


def name_words(name: str) -> set[str]:
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|_|\W", " ", name)
    return {w.lower() for w in spaced.split()} | {name.lower(), name.replace("_", "").lower()}


def is_trivial(text: str, name: str) -> bool:
    """Fewer than four words, nothing beyond the name, or only a placeholder."""
    body = described(text)
    words = words_of(body)
    if len(words) < 4:
        return True
    if not {w.lower() for w in words} - name_words(name) - _FILLER:
        return True
    return not any(not PLACEHOLDER.match(s) for s in sentences(body))


def _pattern(parameter: str) -> str:
    """The destructuring pattern that a parameter begins with, which stands for its name."""
    depth = 0
    for i, c in enumerate(parameter):
        depth += (c in "[{") - (c in "]}")
        if c in "]}" and not depth:
            return " ".join(parameter[: i + 1].split())
    return parameter


def parameter_names(params: str, language: str) -> list[str]:
    """The names in a parameter list, in order; receivers such as self are left out."""
    body = params.strip()
    body = body[1:-1] if body[:1] == "(" else body
    out, depth, piece = [], 0, ""
    for c in body + ",":
        if c == "," and depth <= 0:
            if piece.strip():
                out.append(piece.strip())
            piece, depth = "", 0
            continue
        depth += (c in "([{<") - (c in ")]}>")
        piece += c
    names = []
    for p in out:
        if language in ("js", "ts") and re.match(r"(?:\.\.\.)?\s*[\[{]", p):
            names.append(_pattern(p))
            continue
        p = re.sub(r"/\*.*?\*/|@\w+(?:\([^)]*\))?", "", p).split("=")[0].strip()
        if language in ("java", "dart", "php"):
            found = re.findall(r"\$?[\w$]+", p)
            names += found[-1:]
        elif language == "go":
            names += re.findall(r"^\w+", p)
        else:
            found = re.findall(r"[\w$]+", p.split(":")[0])
            names += [x for x in found[-1:] if x not in ("self", "this", "mut")]
    return names


def pairs(text: str, path: str) -> list[tuple[str, int, str, list[str], str]]:
    """(name, line, docstring, parameters, code) of each documented function of a valid file."""
    language = language_of(path)
    if not text or language not in GRAMMARS:
        return []
    text = lx.normalised(text)
    tokens = lexed(text[script_start(text, language) :], language)
    out = []
    for d in declarations(text, language, tokens):
        doc = doc_text(d["doc"], language)
        if not is_trivial(doc, d["name"]):
            out.append((d["name"], d["line"], doc, parameter_names(d["params"], language), d["code"], d["first"]))
    if not out:
        return []
    codes = tokens[0] if language == "py" else _LEXERS[language].without_comments(tokens[0])
    if lx.BAD in codes:
        codes = None  # tokens that are none may be cut differently around comments
    parsed = parse(text, language, codes)
    if parsed.errors:
        return []
    return [(*row[:4], _ruby_code(text, tokens, row[5], parsed) if language == "rb" else row[4]) for row in out]


_PAIRS = "file_id long, name string, line int, docstring string, parameters array<string>, code string"


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(f, *p) for f, text, path in zip(pdf["file_id"], pdf["source_text"], pdf["file_path"]) for p in (pairs(text, path) if text and path else ())]
        yield pd.DataFrame(rows, columns=["file_id", "name", "line", "docstring", "parameters", "code"])


def documented_functions(files: DataFrame) -> DataFrame:
    """(file_id, name, line, docstring, parameters, code), one row per documented function.

    Null or empty texts, unknown extensions and files that do not parse give no rows; repeated
    files give repeated rows; whole texts are read.
    """
    return spread(files.select("file_id", "file_path", "source_text")).mapInPandas(_extract, _PAIRS)
