from __future__ import annotations

import ast
import warnings

import pytest

from graphloom.llm import broken

SCHEMA = "file_id long, graph string, file_path string, source_text string"

VALID = {
    "js": [
        "", "// only a comment", "const a = `x ${1 + 2} { (`;\nconst r = /[({]x\\/\\)/g;\nif (a / 2 > r) { b() }", "const f = async (a, {b}, ...c) => { for (const x of c) { yieldIt(x) } };",
        "class A extends B { static async go(x = {}) { return x?.y ?? 1 } get v() { return 1 } #p = 1 }", "export default function () {}\nexport { a as b } from './c';", "let a = 1\nlet b = 2\na\n++b", "x = a ? b : c, d;\nlabel: for (;;) break label", "/* <<<<<<< HEAD */\nconst s = `\n=======\n`;",
        "switch (a) { case 1: b(); default: c() }\ntry { } catch { } finally { }", "const o = { a, 'b': 1, [c]: 2, d() {}, get e() { return 1 }, ...f };",
    ],
    "ts": ["const a: number = 1;", "function f(a: Map<string, number>, b?: () => void): Promise<string> { return a as any }", "type T = { [key: string]: number };\ninterface I<T> extends J { m(a: T): void; p?: string }", "enum E { A = 1, B }\nabstract class C<T> implements D { private x: T; constructor(private y: string) { super() } abstract z(): void }", "const plain = (a) => a;\nimport { A } from './a';"],
    "py": ["", "# c", "def f(a, *b, c: int = 1, **d) -> int:\n    '''\n<<<<<<< HEAD\n'''\n    return [x for x in a if x] or {**d}\n", "class A(B, metaclass=C):\n    x: int = 1\n    @property\n    async def y(self): return await z\n", "try:\n    pass\nexcept (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    with a as b, c:\n        pass\n", "x = lambda a, *b: a if b else not c\nprint(x[1:2, ::3], end='')\n", "match x:\n    case [1, *_]:\n        pass\n", "if x: y = 1; z = 2\nelif (\n  a\n): pass\n", "a = b = c, *d = e\nx @= y ** -z\nassert a, b\ndel a[0]\n"],
    "rb": ["", "require 'a'\nclass A < B\n  def self.go(a, b = nil, *c, d: 1)\n    return [a, 1] if a.nil?\n    a.each do |x|\n      puts x, \"y\"\n    end\n  end\nend\n", "x = %w[a ( {]\nre = /[({]x/\nmodule M\n  ok = true if n.to_i > 3\nend\n", "b = <<~TEXT\n<<<<<<< HEAD\n{ ( end\nTEXT\ncase x\nwhen 1 then y\nelse z\nend\n", "begin\n  a\nrescue E => e\n  b\nensure\n  c\nend\nwhile a do b end\nx = if y then 1 else 2 end\n"],
    "php": ["<?php\nnamespace A\\B;\nuse C\\D;\nclass E extends F implements G {\n    private ?int $x = null;\n    public static function go(?string $a, array $b = [], &...$c): ?int { foreach ($a as $k => $v) { echo $v->w(1)['x']; } return $a ?? 1; }\n}\n", "<?php\n$t = <<<'TXT'\n<<<<<<< HEAD\n} (\nTXT;\n$f = fn($x) => $x + 1;\nif ($a): b(); endif;\n", "<?php // only\n", ""],
    "java": ["package a.b;\nimport java.util.*;\n@A(x = 1)\npublic class C<T extends D> extends E {\n    private final Map<String, List<int[]>> m = new HashMap<>();\n    C(int a) { this(a, 1); }\n    <U> U go(final int a, String... b) throws X { for (var x : b) { call(x -> x + 1); } int[] z = {1, 2}; return (U) a; }\n}\n", 'class A { String s = """\n<<<<<<< ours\n{{\n"""; char c = \'"\'; int x = a < b ? 1 : 2; }', "/* c */", "enum E { A(1), B { void f() {} }; int x; }\nrecord R(int a) {}\ninterface I { default int f() { return 1; } }"],
    "go": ["package p\n\nimport (\n\t\"a\"\n\tb \"c\"\n)\n\ntype T struct {\n\tA, B int `json:\"a\"`\n\t*C\n}\n\nfunc (t *T) Do(a []int, m map[string]int) (int, error) {\n\tif x := a[0]; x > 1 {\n\t\treturn T{A: 1}.B, nil\n\t}\n\tfor i, v := range m {\n\t\tgo func() { c <- v }()\n\t\ti++\n\t}\n\ts := `=======\n}`\n\topen := '{'\n\treturn len(s), nil\n}\n", "// c\n", "package p\nvar x = []int{1, 2}\nconst (\n\tA = iota\n\tB\n)\n"],
    "rs": ["use crate::a::{B, c as d};\n#[derive(Debug)]\npub struct S<'a, T: X + 'a> { pub a: &'a T, b: Vec<Option<i32>> }\nimpl<'a, T> S<'a, T> where T: Y {\n    pub(crate) fn go(&mut self, x: &str) -> Result<(), E> {\n        let v = vec![1, 2];\n        if let Some(y) = self.z(x)? { return Ok(()); }\n        match v { [a, ..] if *a > 1 => {} _ => (), }\n        for i in 0..10 { v.iter().map(|q| q + 1).collect::<Vec<_>>(); }\n        Ok(())\n    }\n}\n", 'fn f() { let r = r#"{("#; let c = \'"\'; let s = "\n<<<<<<< HEAD\n"; }', "// c", "enum E { A(i32), B { x: u8 } }\ntrait T: U { fn f(&self); }\nmacro_rules! m { () => {} }\n"],
    "dart": ["import 'a.dart';\nabstract class A<T> extends B with C implements D {\n  final int x;\n  A(this.x, {required int y, int z = 0}) : super(y);\n  Future<List<int>> go(String a, [int? b]) async { await for (var q in a) { print('$q ${q + 1}'); } return [1, ...c]; }\n  int get v => x;\n}\nvoid main() {\n  var re = RegExp(r'[({]x');\n  var s = '''\n=======\n{ (\n''';\n  list..add(1)..sort();\n}\n", "// c", ""],
}

INVALID = {
    "js": ["const a: number = 1;", "function f( {", "a\n<<<<<<< HEAD\nb\n=======\nc\n>>>>>>> x\n", "const s = `abc", "/* open", "if (a) { b(", "def f():\n    pass", "package a;", "class A { x y }", "{\n \"name\": \"x\",\n \"n\": 1\n}"],
    "ts": ["const a: = 1;", "class A { f(: void) {} }", "package main\n\nfunc x() {}", "type A = ;", "<!DOCTYPE html>"],
    "py": ["def f():\n", "x = (1,\n", "'''open", "if x\n    pass\n", "  x = 1\n y = 2\n", "const a = 1;", "<<<<<<< HEAD\nx = 1\n", "class A:\nx = 1\n", "a + 1 = b\n", "return }"],
    "rb": ["def f\n  x\n", "class A\n  def b\n  end\n", "x = [1, 2\n", "<<<<<<< HEAD\n"],
    "php": ["<?php function f( {", "<?php $a = 1", "<?php\n<<<<<<< HEAD\n", "<?php class A { function }"],
    "java": ["class A { void f() { a + 1; } }", "class A {", "int x = 1;", "class A { void f() { return 1 } }", "def f(): pass", "class A {\n=======\n}"],
    "go": ["func f() {}", "package p\nfunc f() {\n", "package p\nfunc f() { if x { } else }", "package p\n<<<<<<< HEAD\n", "package p\nx := 1\n"],
    "rs": ["fn f() { let x = ; }", "fn f() {", "let x = 1;", "fn f() { a b }", "struct S { a }", "import a"],
    "dart": ["void f() {", "class A { int x }", "var x = ;", "void f() { a b c; }", "package p\n"],
}


def test_every_language_has_cases():
    assert set(VALID) == set(INVALID) == set(broken.GRAMMARS)


@pytest.mark.parametrize("language", sorted(VALID))
def test_accepts(language):
    for text in VALID[language]:
        assert broken.first_errors(text, f"a.{language.upper()}") == (), text


@pytest.mark.parametrize("language", sorted(INVALID))
def test_rejects(language):
    for text in INVALID[language]:
        assert broken.first_errors(text, f"a.{language}"), text


@pytest.mark.parametrize("language", sorted(VALID))
def test_line_ends_do_not_matter(language):
    for text in VALID[language]:
        for end in ("\r\n", "\r"):
            assert broken.first_errors(text.replace("\n", end), f"a.{language}") == (), text


def test_python_agrees_with_the_interpreter():
    text = max(VALID["py"], key=len)
    warnings.simplefilter("ignore")
    for whole in VALID["py"]:
        for cut in range(len(whole)):
            part = whole[:cut]
            try:
                ast.parse(part)
                ok = True
            except SyntaxError:
                ok = False
            if ok == bool(broken.first_errors(part, "a.py")):
                # What the interpreter rejects after parsing, such as assignments to calls, may be accepted.
                assert not ok, part
    assert text


def test_all_errors_are_kept_with_their_first_cause():
    errors = broken.first_errors("let a = ;\nlet b = 1;\nlet = = 2;\nf(;\n", "x.js")
    assert [e[0] for e in errors] == [1, 3, 4] and "expected" in errors[0][2]


def test_deep_and_long_texts():
    assert broken.first_errors("x = " + "(" * 3000 + "1" + ")" * 3000 + ";", "a.js") == ()
    assert broken.first_errors("x = " + "[" * 3000 + "1" + "]" * 2999 + ";", "a.js")
    assert broken.first_errors("x = 1\n" * 20_000, "a.py") == ()
    assert broken.first_errors("s = '" + "y" * 300_000 + "'\n", "a.py") == ()


def test_operator(spark, frame):
    rows = [(1, "g", "a.py", "x = 1"), (2, "g", "b.PY", "x = ("), (2, "g", "b.PY", "x = ("), (3, "g", "c.py", None), (4, None, None, "x = ("), (5, "g", "d.txt", "("), (6, "g", "e.js", "")]
    files = frame(rows, SCHEMA)
    assert sorted(r.file_id for r in broken.broken_files(files).collect()) == [2, 2]
    v = {r.file_id: r for r in broken.syntax_verdicts(files).collect()}
    assert v[2].first_line == 1 and v[2].errors and v[5].language is None and v[5].accepted and v[3].accepted
    frameworks = frame([("g", "py", "x")], "graph string, language string, display_name string")
    assert {(r.graph, r.language): (r.files, r.broken, r.graph_language) for r in broken.acceptance(files, frameworks).collect()}["g", "py"] == (4, 2, "py")
    assert broken.broken_files(frame([], SCHEMA)).count() == 0
