from __future__ import annotations

import ast

from graphloom.llm import documented as d

SCHEMA = "file_id long, file_path string, source_text string"
REAL = "Keeps one record for every open lease"

CASES = {
    "a.js": (f"/** {REAL}. */\n@dec\nexport async function one(a, {{ b }}, ...c) {{ return 1; }}\n\n/**\n * {REAL}.\n * @param x the\n */\nconst two = (x) => x;\n\n/** {REAL} */\nexport const three = function (q) {{ }};\nclass K {{\n  /** {REAL} */\n  static four() {{ }}\n  // {REAL}\n  five() {{ }}\n}}\n// /** {REAL} */\nfunction six() {{ }}\nconst s = `/** {REAL} */\nfunction seven() {{ }}`;\n", {("one", 3), ("two", 9), ("three", 12), ("four", 15)}),
    "a.ts": (f"class K {{\n  /** {REAL} */\n  private go(a: Map<string, number>, b?: () => void): Promise<string> {{ return a; }}\n}}\n/** {REAL} */\nexport const f = async <T>(x: T): Promise<T> => x;\n", {("go", 3), ("f", 6)}),
    "a.py": (f'def one(a):\n    r"""{REAL}.\n\n    :param a: x\n    """\n    return a\n\nclass K:\n    """{REAL}."""\n    async def two(self): \'{REAL}\'\n\n    # {REAL}\n    def three(self):\n        return """{REAL}"""\n\nT = """\ndef four():\n    \'\'\'{REAL}\'\'\'\n"""\n', {("one", 1), ("two", 10)}),
    "a.java": (f"class K {{\n    /** {REAL} */\n    @Override\n    public <T> List<T> one(final int a) throws X {{ return null; }}\n    /* {REAL} */\n    void two() {{ }}\n}}\n", {("one", 4)}),
    "a.php": (f"<?php\n/** {REAL} */\nfunction one(?string $a) {{ }}\nclass K {{\n    /** {REAL} */\n    private static function two(): ?int {{ return 1; }}\n}}\n", {("one", 3), ("two", 6)}),
    "a.go": (f"package p\n\n// {REAL}\n// and more.\nfunc one(a int) {{\n}}\n\n// {REAL}\n\nfunc two() {{\n}}\n\n// {REAL}\nfunc (t *T) Three() (int, error) {{\n\treturn 1, nil\n}}\n", {("one", 5), ("Three", 14)}),
    "a.rs": (f"/// {REAL}\n#[inline]\npub fn one(&self, a: i32) -> i32 {{ a }}\n/** {REAL} */\nfn two() {{}}\n// {REAL}\nfn three() {{}}\n", {("one", 3), ("two", 5)}),
    "a.rb": (f"# {REAL}\n# @param a [X]\ndef one(a)\nend\n\n# {REAL}\n\ndef two\nend\n\nclass K\n  # {REAL}\n  def self.three; end\nend\n", {("one", 3), ("three", 13)}),
    "a.dart": (f"/// {REAL}\n@override\nFuture<int> one(List<int> a) async {{ return 1; }}\n// {REAL}\nint two() => 1;\n", {("one", 3)}),
}


def test_each_language():
    for path, (text, want) in CASES.items():
        got = {(name, line) for name, line, *_ in d.pairs(text, path)}
        assert got == want, path
        crlf = {(name, line) for name, line, *_ in d.pairs(text.replace("\n", "\r\n"), path)}
        assert crlf == want, path


def test_parts_of_a_pair():
    ((name, line, doc, params, code),) = d.pairs('import x\n\ndef load(a, *b, c=1):\n    """Loads the thing from the first store.\n\n    Args:\n        a: x\n    """\n    return a\n\nx = 1\n', "a.py")
    assert (name, line, params) == ("load", 3, ["a", "b", "c"]) and doc.startswith("Loads the thing") and code.startswith("def load") and code.endswith("return a")


def code_of(text, path):
    return {name: code for name, _, _, _, code in d.pairs(text, path)}


def test_where_functions_end():
    ruby = code_of(f"class K\n  # {REAL}\n  def add(a, b) = a + b\n  # {REAL}\n  def val; @v; end\n  # {REAL}\n  def each\n    x.each do |y| # an end\n      y if y\n    end\n    \"end\"\n  end # done\n\n  # {REAL}\n  private def last\n    1\n  end\nend\n", "a.rb")
    assert ruby == {"add": "def add(a, b) = a + b", "val": "def val; @v; end", "each": 'def each\n    x.each do |y| # an end\n      y if y\n    end\n    "end"\n  end', "last": "def last\n    1\n  end"}
    python = f'class K:\n    def one(self):\n        """{REAL}"""\n        x = \'\'\'\nnot the end\n\'\'\'\n        def inner(): "{REAL}"\n        return x  # done\n\n    # about two\n    def two(self): "{REAL}"; return 1  # more\n\n\nx = 1\n'
    tree = {n.name: ast.get_source_segment(python, n) for n in ast.walk(ast.parse(python)) if isinstance(n, ast.FunctionDef)}
    assert code_of(python, "a.py") == tree
    script = code_of(f"/** {REAL} */\nconst f = (x) => x + 1\nconst y = f(2)\n/** {REAL} */\nexport const g = x => {{ return x }}\nlet z = 1\n", "a.js")
    assert script == {"f": "const f = (x) => x + 1", "g": "export const g = x => { return x }"}


def test_patterns_as_parameters():
    ((_, _, _, params, _),) = d.pairs(f"/** {REAL} */\nfunction f({{ a, b }}: Opts, [c, d] = [1, 2], ...rest: T[]) {{ }}\n", "a.ts")
    assert params == ["{ a, b }", "[c, d]", "rest"]


def test_trivial_documentation():
    for text in ("", "-", "Loads it.", "Load the order store", "The load order function store", "TODO: write the documentation for this one", "FIXME document me before the next release", "{@inheritDoc}", "Auto-generated method stub here now", "Autogenerated, do not edit. Autogenerated, do not edit.", "@param a the first of all values", "missing documentation, please add some", "TBD: describe what this does", ":param a: the first of all"):
        assert d.is_trivial(text, "loadOrderStore"), text
    for text in (REAL, "TODO: describe.\nKeeps one record for every lease.", "Loads orders by name and date", f"{REAL}.\nTODO: more.", f"{REAL}\n@param a x"):
        assert not d.is_trivial(text, "loadOrderStore"), text


def test_operator(frame):
    valid = CASES["a.py"][0]
    rows = [(1, "x.py", valid), (1, "x.py", valid), (2, "x.py", valid + "def ("), (3, "x.py", None), (4, None, valid), (5, "x.txt", valid), (6, "x.PY", ""), (7, "x.py", valid + "#" * 200_000)]
    got = d.documented_functions(frame(rows, SCHEMA)).select("file_id", "name", "line").collect()
    assert sorted(tuple(r) for r in got) == sorted([(1, "one", 1), (1, "two", 10)] * 2 + [(7, "one", 1), (7, "two", 10)])
    assert d.documented_functions(frame([], SCHEMA)).count() == 0
