from __future__ import annotations

import pytest

from graphloom.operators import declarations as d

DOC = "Keeps one record."

# language -> text, entities (kind, name, line, enclosing, docstring, parameters, return type, bases), relationships
CASES = {
    "a.py": (
        f'import os, sys\nfrom . import x\n\n@cached(1)\nclass Store(Base, k.Mixin):\n    """{DOC}"""\n    async def load(self, n: int, *rest, k=1) -> Store:\n        return save(n)\n\n\nasync def save(store: Store):\n    def inner(): pass\n    "class No: pass"  # def no(): pass\n    return inner()\n',
        {("class", "Store", 5, None, DOC, None, None, ("Base", "k.Mixin")), ("method", "load", 7, "Store", None, (("n", "int"), ("rest", None), ("k", None)), "Store", ()), ("function", "save", 11, None, None, (("store", "Store"),), None, ()), ("function", "inner", 12, "save", None, (), None, ())},
        {("inherits", "Store", "external:base"), ("inherits", "Store", "external:k.mixin"), ("calls", "load", "save"), ("calls", "save", "inner"), ("uses_type", "load", "Store"), ("uses_type", "save", "Store"), ("imports", "a.py", "external:os"), ("imports", "a.py", "external:sys"), ("imports", "a.py", "external:.")},
    ),
    "broken.py": (
        f"class Store(Base):\n    # {DOC}\n    def load(self, n):\n        return 1\ndef (\n",
        {("class", "Store", 1, None, None, None, None, ()), ("method", "load", 3, "Store", DOC, (("n", None),), None, ())},
        set(),
    ),
    "b.ts": (
        f"import {{ a }} from './a';\nconst re = /[\"({{]/g;\n/** {DOC} */\n@Injectable()\nexport class Box<T> extends Base<T> implements One, Two {{\n  private open(a: string, {{ b }}: Opts): Promise<Item> {{ if (a) {{ return go(a); }} }}\n}}\n// class No {{}}\nexport interface Item {{ n: number }}\ntype Id = string;\nenum Color {{ Red }}\nexport const go = async (n: Id): Promise<void> => {{ return `class No {{`; }};\nfunction run(cb: () => void) {{ go(1) }}\n",
        {("class", "Box", 5, None, DOC, None, None, ("Base", "One", "Two")), ("method", "open", 6, "Box", None, (("a", "string"), ("{ b }", "Opts")), "Promise<Item>", ()), ("interface", "Item", 9, None, None, None, None, ()), ("type", "Id", 10, None, None, None, None, ()), ("enum", "Color", 11, None, None, None, None, ()), ("function", "go", 12, None, None, (("n", "Id"),), None, ()), ("function", "run", 13, None, None, (("cb", "() => void"),), None, ())},
        {("inherits", "Box", "external:base"), ("implements", "Box", "external:one"), ("implements", "Box", "external:two"), ("calls", "open", "go"), ("calls", "run", "go"), ("uses_type", "open", "Item"), ("uses_type", "go", "Id"), ("imports", "b.ts", "external:./a")},
    ),
    "c.java": (
        f"package p;\nimport java.util.List;\n/**\n * {DOC}\n */\npublic class Store extends Base implements Runnable, K<T> {{\n  @Override\n  public List<String> load(final int n, String[] names) throws X {{ return helper(n); }}\n  private static int helper(int n) {{ /* class No {{ */ return n; }}\n  Store(int a) {{ }}\n}}\ninterface Shape {{ void draw(); }}\n",
        {("class", "Store", 6, None, DOC, None, None, ("Base", "Runnable", "K")), ("method", "load", 8, "Store", None, (("n", "int"), ("names", "String[]")), "List<String>", ()), ("method", "helper", 9, "Store", None, (("n", "int"),), "int", ()), ("method", "Store", 10, "Store", None, (("a", "int"),), None, ()), ("interface", "Shape", 12, None, None, None, None, ()), ("method", "draw", 12, "Shape", None, (), "void", ())},
        {("inherits", "Store", "external:base"), ("implements", "Store", "external:runnable"), ("implements", "Store", "external:k"), ("calls", "load", "helper"), ("imports", "c.java", "external:java.util.list")},
    ),
    "d.go": (
        f"package p\n\nimport (\n\t\"fmt\"\n\tio \"x/io\"\n)\n\n// {DOC}\ntype Store struct {{ n int }}\n\ntype Shape interface {{\n\tDraw()\n}}\n\n// {DOC}\nfunc (s *Store) Load(a, b int, c string) (int, error) {{\n\treturn run(a), nil\n}}\n\nfunc run(a int) int {{ return a }}\n",
        {("struct", "Store", 9, None, DOC, None, None, ()), ("interface", "Shape", 11, None, None, None, None, ()), ("method", "Load", 16, None, DOC, (("a", "int"), ("b", "int"), ("c", "string")), "(int, error)", ()), ("function", "run", 20, None, None, (("a", "int"),), "int", ())},
        {("calls", "Load", "run"), ("imports", "d.go", "external:fmt"), ("imports", "d.go", "external:x/io")},
    ),
    "e.rs": (
        f"use std::io;\n/// {DOC}\n#[derive(Debug)]\npub struct Store {{ n: i32 }}\npub trait Shape {{ fn draw(&self); }}\nimpl Shape for Store {{\n    fn draw(&self) {{ run(1) }}\n}}\nfn run(n: i32) -> Store {{ todo!() }}\nenum Color {{ Red }}\n",
        {("struct", "Store", 4, None, DOC, None, None, ()), ("trait", "Shape", 5, None, None, None, None, ()), ("method", "draw", 5, "Shape", None, (), None, ()), ("method", "draw", 7, "Store", None, (), None, ()), ("function", "run", 9, None, None, (("n", "i32"),), "Store", ()), ("enum", "Color", 10, None, None, None, None, ())},
        {("implements", "Store", "Shape"), ("calls", "draw", "run"), ("uses_type", "run", "Store"), ("imports", "e.rs", "external:std::io")},
    ),
    "f.rb": (
        f"require 'set'\nmodule M\n  # {DOC}\n  class Store < Base\n    def load(a, b = 1)\n      save(a)\n    end\n    def self.save(x); x; end\n  end\nend\n",
        {("module", "M", 2, None, None, None, None, ()), ("class", "Store", 4, "M", DOC, None, None, ("Base",)), ("method", "load", 5, "Store", None, (("a", None), ("b", None)), None, ()), ("method", "save", 8, "Store", None, (("x", None),), None, ())},
        {("inherits", "Store", "external:base"), ("calls", "load", "save"), ("imports", "f.rb", "external:set")},
    ),
    "g.php": (
        f"<?php\nuse A\\B;\n/** {DOC} */\nabstract class P extends Q implements R {{\n    public function go(?string $x, int ...$y): ?int {{ return 1; }}\n}}\ntrait T {{ }}\n",
        {("class", "P", 4, None, DOC, None, None, ("Q", "R")), ("method", "go", 5, "P", None, (("$x", "?string"), ("$y", "int")), "?int", ()), ("trait", "T", 7, None, None, None, None, ())},
        {("inherits", "P", "external:q"), ("implements", "P", "external:r"), ("imports", "g.php", "external:a\\b")},
    ),
    "h.dart": (
        f"import 'p.dart';\n/// {DOC}\nclass D extends E with F {{\n  Future<int> go(int a, {{String b}}) async {{ return run(a); }}\n}}\nint run(int a) => a;\n",
        {("class", "D", 3, None, DOC, None, None, ("E", "F")), ("method", "go", 4, "D", None, (("a", "int"), ("b", "String")), "Future<int>", ()), ("function", "run", 6, None, None, (("a", "int"),), "int", ())},
        {("inherits", "D", "external:e"), ("implements", "D", "external:f"), ("calls", "go", "run"), ("imports", "h.dart", "external:p.dart")},
    ),
    "i.cs": (
        f"using System.Text;\nnamespace N.O {{\n  /// {DOC}\n  public class S : Base, IThing {{\n    [Test]\n    public int Go(string a) {{ return Run(); }}\n    int Run() => 1;\n  }}\n  struct P {{ }}\n}}\n",
        {("module", "N.O", 2, None, None, None, None, ()), ("class", "S", 4, "N.O", DOC, None, None, ("Base", "IThing")), ("method", "Go", 6, "S", None, (("a", "string"),), "int", ()), ("method", "Run", 7, "S", None, (), "int", ()), ("struct", "P", 9, "N.O", None, None, None, ())},
        {("inherits", "S", "external:base"), ("implements", "S", "external:ithing"), ("calls", "Go", "Run"), ("imports", "i.cs", "external:system.text")},
    ),
    "j.kt": (
        f"import a.b\n/** {DOC} */\nopen class S(val n: Int) : Base(n), Thing {{\n  fun go(a: Int): String {{ return run(a) }}\n}}\nfun run(a: Int): String = \"x\"\nobject O {{ }}\n",
        {("class", "S", 3, None, DOC, None, None, ("Base", "Thing")), ("method", "go", 4, "S", None, (("a", "Int"),), "String", ()), ("function", "run", 6, None, None, (("a", "Int"),), "String", ()), ("class", "O", 7, None, None, None, None, ())},
        {("inherits", "S", "external:base"), ("inherits", "S", "external:thing"), ("calls", "go", "run"), ("imports", "j.kt", "external:a.b")},
    ),
    "k.swift": (
        "import UIKit\nprotocol Shape { func draw() }\nclass S: Base, Shape {\n  func go(a: Int) -> String { return \"\" }\n}\n",
        {("interface", "Shape", 2, None, None, None, None, ()), ("method", "draw", 2, "Shape", None, (), None, ()), ("class", "S", 3, None, None, None, None, ("Base", "Shape")), ("method", "go", 4, "S", None, (("a", "Int"),), "String", ())},
        {("inherits", "S", "external:base"), ("inherits", "S", "Shape"), ("imports", "k.swift", "external:uikit")},
    ),
    "l.scala": (
        "import a.b.C\ntrait Shape { def draw(n: Int): Unit }\nclass S(n: Int) extends Base(n) with Shape {\n  def go(a: Int): String = run(a)\n  def run(a: Int): String = { \"\" }\n}\n",
        {("trait", "Shape", 2, None, None, None, None, ()), ("method", "draw", 2, "Shape", None, (("n", "Int"),), "Unit", ()), ("class", "S", 3, None, None, None, None, ("Base", "Shape")), ("method", "go", 4, "S", None, (("a", "Int"),), "String", ()), ("method", "run", 5, "S", None, (("a", "Int"),), "String", ())},
        {("inherits", "S", "external:base"), ("implements", "S", "Shape"), ("calls", "go", "run"), ("imports", "l.scala", "external:a.b.c")},
    ),
    "m.cpp": (
        "#include <vector>\nnamespace n {\nclass S : public Base {\n  int go(int a) { return run(a); }\n};\n}\nstatic int run(const char* a, int b) {\n  return 1;\n}\ntypedef int Id;\n",
        {("module", "n", 2, None, None, None, None, ()), ("class", "S", 3, "n", None, None, None, ("Base",)), ("method", "go", 4, "S", None, (("a", "int"),), "int", ()), ("function", "run", 7, None, None, (("a", "const char"), ("b", "int")), "int", ()), ("type", "Id", 10, None, None, None, None, ())},
        {("inherits", "S", "external:base"), ("calls", "go", "run"), ("imports", "m.cpp", "external:vector")},
    ),
    "n.lua": ("local x = require('a.b')\nfunction M.go(a, b)\n  return run(a)\nend\nlocal function run(a)\n  return a\nend\n", {("function", "M.go", 2, None, None, (("a", None), ("b", None)), None, ()), ("function", "run", 5, None, None, (("a", None),), None, ())}, {("calls", "M.go", "run"), ("imports", "n.lua", "external:a.b")}),
    "o.ex": ("defmodule A.B do\n  alias C.D\n  def go(a) do\n    run(a)\n  end\n  defp run(a), do: a\nend\n", {("module", "A.B", 1, None, None, None, None, ()), ("function", "go", 3, "A.B", None, (("a", None),), None, ()), ("function", "run", 6, "A.B", None, (("a", None),), None, ())}, {("calls", "go", "run"), ("imports", "o.ex", "external:c.d")}),
    "p.jl": ("using LinearAlgebra\nabstract type T end\nstruct S\n  n::Int\nend\nfunction go(a::Int, b)\n  run(a)\nend\nrun(a) = a\n", {("type", "T", 2, None, None, None, None, ()), ("struct", "S", 3, None, None, None, None, ()), ("function", "go", 6, None, None, (("a", "Int"), ("b", None)), None, ()), ("function", "run", 9, None, None, (("a", None),), None, ())}, {("calls", "go", "run"), ("imports", "p.jl", "external:linearalgebra")}),
    "q.hs": ("module M where\nimport Data.List\ndata T = A | B\nclass Shape a where\n  draw :: a -> Int\ngo :: Int -> Int\ngo x = x\n", {("module", "M", 1, None, None, None, None, ()), ("type", "T", 3, None, None, None, None, ()), ("interface", "Shape", 4, None, None, None, None, ()), ("function", "go", 6, None, None, None, None, ())}, {("imports", "q.hs", "external:data.list")}),
    "r.zig": ("const std = @import(\"std\");\npub const S = struct {\n  pub fn go(self: *S, a: i32) i32 { return run(a); }\n};\nfn run(a: i32) i32 { return a; }\n", {("struct", "S", 2, None, None, None, None, ()), ("method", "go", 3, "S", None, (("self", "*S"), ("a", "i32")), None, ()), ("function", "run", 5, None, None, (("a", "i32"),), None, ())}, {("calls", "go", "run"), ("uses_type", "go", "S"), ("imports", "r.zig", "external:std")}),
    "s.sql": ("-- create table no (a int);\nCREATE TABLE t (a int);\ncreate unique index i on t (a);\ncreate or replace function f() returns int;\n", {("class", "t", 2, None, "create table no (a int);", None, None, ()), ("variable", "i", 3, None, None, None, None, ()), ("function", "f", 4, None, None, (), None, ())}, set()),
    "t.yaml": ("top:\n  inner:\n    leaf: 1\n  other: 2\n# no: 1\n", {("variable", "top", 1, None, None, None, None, ()), ("variable", "top.inner", 2, "top", None, None, None, ()), ("variable", "top.inner.leaf", 3, "top.inner", None, None, None, ()), ("variable", "top.other", 4, "top", None, None, None, ())}, set()),
    "u.m": ("#import <X.h>\n@protocol Shape\n@end\n@interface S : Base\n- (void)go:(int)a;\n@end\n", {("interface", "Shape", 2, None, None, None, None, ()), ("class", "S", 4, None, None, None, None, ("Base",)), ("method", "go", 5, "S", None, None, None, ())}, {("inherits", "S", "external:base"), ("imports", "u.m", "external:x.h")}),
    "v.groovy": ("import a.B\nclass S extends T {\n  def go(int a) { return 1 }\n}\ntrait Q { }\n", {("class", "S", 2, None, None, None, None, ("T",)), ("method", "go", 3, "S", None, (("a", "int"),), "def", ()), ("trait", "Q", 5, None, None, None, None, ())}, {("inherits", "S", "external:t"), ("imports", "v.groovy", "external:a.b")}),
}


@pytest.mark.parametrize("path", sorted(CASES))
def test_what_each_language_declares(path):
    text, entities, links = CASES[path]
    for source in (text, text.replace("\n", "\r\n")):
        rows = [dict(zip(d._COLUMNS, r)) for r in d.file_facts(1, "g", path, source)]
        names = {r["id"]: r["name"] for r in rows if r["fact"] == "entity"}
        got = {
            (r["kind"], r["name"], r["line"], names.get(r["parent_id"]), r["docstring"], tuple(map(tuple, r["parameters"])) if r["parameters"] is not None else None, r["return_type"], tuple(r["bases"]))
            for r in rows if r["fact"] == "entity" and r["place"]
        }
        assert got == entities
        found = {(r["fact"], names.get(r["id"], r["id"]), names.get(r["target"], r["target"])) for r in rows if r["fact"] not in ("entity", "contains")}
        assert found == links
        assert sum(r["fact"] == "contains" for r in rows) == len([r for r in rows if r["fact"] == "entity"]) - 1
