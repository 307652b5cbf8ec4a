from __future__ import annotations

import datetime as dt
import sqlite3
import subprocess

from pyspark.sql import functions as F

from graphloom import cli
from graphloom.api import GraphTools
from graphloom.operators import declarations
from graphloom.sources import external_index, files, gitlog
from graphloom.streaming import watch

SOURCES = {
    "a.py": "import os\nfrom x.y import z\n\nclass Store(Base):\n    def load(self):\n        return self.find(1)\n\n    def find(self, n):\n        # def hidden():\n        return n\n\ndef top():\n    return top()\n",
    "b.js": "import x from './y';\nexport class Box {\n  open(a) {\n    return a;\n  }\n}\nexport const go = async (n) => {\n  return n;\n};\nfunction run() {}\n",
    "c.go": 'package p\n\nimport "fmt"\n\ntype T struct {\n}\n\nfunc (t *T) Do() {\n}\n\nfunc Run() {\n}\n',
    "d.rs": "use crate::a::b;\npub struct S {}\nimpl S {\n    pub fn go(&self) {}\n}\ntrait Q {}\n",
    "e.java": "package p;\nimport java.util.List;\npublic class K {\n    private int add(int a) {\n        return a;\n    }\n}\n",
    "f.rb": "require 'set'\nmodule M\n  class C < D\n    def self.go(x)\n    end\n  end\nend\n",
    "g.php": "<?php\nuse A\\B;\nclass P {\n    public function go($x) {}\n}\n",
    "h.dart": "import 'p.dart';\nclass D {\n  int go(int a) {\n    return a;\n  }\n}\n",
    "i.sql": "CREATE TABLE t (a int);\ncreate or replace function f() returns int\n",
    "j.yaml": "top:\n  inner: 1\n",
}


def write(folder):
    for name, source in SOURCES.items():
        (folder / name).write_text(source)
    (folder / "node_modules").mkdir()
    (folder / "node_modules" / "z.py").write_text("class No: pass\n")


def test_scan_parse_and_tools(spark, tmp_path):
    write(tmp_path)
    tools = GraphTools.parse_directory(spark, str(tmp_path), ["**/*.*"], ["*.yaml"])
    got = {(r.file_path, r.type, r.name) for r in tools.graph.entities.collect()}
    for want in [("a.py", "class", "Store"), ("a.py", "method", "load"), ("a.py", "function", "top"), ("b.js", "class", "Box"), ("b.js", "method", "open"), ("b.js", "function", "go"), ("b.js", "function", "run"), ("c.go", "struct", "T"), ("c.go", "method", "Do"), ("c.go", "function", "Run"), ("d.rs", "struct", "S"), ("d.rs", "method", "go"), ("d.rs", "trait", "Q"), ("e.java", "class", "K"), ("e.java", "method", "add"), ("f.rb", "module", "M"), ("f.rb", "class", "C"), ("f.rb", "method", "go"), ("g.php", "class", "P"), ("g.php", "method", "go"), ("h.dart", "class", "D"), ("h.dart", "method", "go"), ("i.sql", "class", "t"), ("i.sql", "function", "f"), ("a.py", "module", "a.py")]:
        assert want in got, want
    assert not any(n in ("hidden", "No") for _, _, n in got) and not any(p.endswith("yaml") for p, _, _ in got)
    edges = {(r.type, r.target_id) for r in tools.graph.relationships.collect()}
    assert {("imports", "external:os"), ("imports", "external:x.y"), ("imports", "external:fmt"), ("imports", "external:java.util.list"), ("imports", "external:set")} <= edges
    assert sum(t == "calls" for t, _ in edges) == 1
    assert tools.search_entities("store")[0]["name"] == "Store" and tools.get_entity("nope")["error"]
    assert {r["status"] for r in tools.incremental_parse(str(tmp_path), ["**/*.*"], ["*.yaml"]).collect()} == {"unchanged"}
    assert {(r.file_path, r.skipped) for r in tools.skipped_files(str(tmp_path), ["**/*.*"], ["*.yaml"]).collect()} == {("j.yaml", "excluded"), ("node_modules/z.py", "ignored")}
    assert tools.get_language_for_file("x/Y.RS")["language"] == "Rust" and len(tools.list_supported_languages()) == 24
    assert "Store" in tools.explain_entity("Store") and tools.analyze_codebase()
    tools.save_graph(str(tmp_path / "out"))
    assert len(GraphTools.load_graph(spark, str(tmp_path / "out")).get_graph_stats()) == len(tools.get_graph_stats())


def test_declarations_of_nothing(spark):
    empty = spark.createDataFrame([], "file_id long, graph string, file_path string, source_text string")
    found = declarations.facts(empty)
    assert declarations.declarations(found).count() == 0 and declarations.links(found).count() == 0 and declarations.parse_totals(found).count() == 0
    null = spark.createDataFrame([(1, "g", "a.py", None), (2, None, None, "class A: pass"), (3, "g", "x.unknown", "class A")], "file_id long, graph string, file_path string, source_text string")
    assert declarations.declarations(declarations.facts(null)).count() == 0 and [r.name for r in declarations.facts(null).collect()] == ["x.unknown"]


def test_parse_file_and_refresh(spark, tmp_path):
    (tmp_path / "a.py").write_text("class A:\n    def go(self): return 1\n")
    (tmp_path / "b.py").write_text("def b(): pass\n")
    (tmp_path / "big.py").write_text("x = 1\n" * 300_000)
    one = GraphTools.parse_file(spark, str(tmp_path / "big.py"))
    assert [r.name for r in one.graph.entities.collect()] == ["big.py"]
    tools = GraphTools.parse_directory(spark, str(tmp_path))
    assert {(r.file_path, r.skipped) for r in tools.skipped_files(str(tmp_path)).collect()} == {("big.py", "too large")}
    (tmp_path / "a.py").write_text("class A:\n    def run(self): return 1\n")
    (tmp_path / "b.py").unlink()
    (tmp_path / "c.py").write_text("def c(): pass\n")
    assert {r.file_path: r.status for r in tools.incremental_parse(str(tmp_path)).collect()} == {"a.py": "changed", "b.py": "deleted", "c.py": "new"}
    assert {r.name for r in tools.graph.entities.collect()} == {"a.py", "A", "run", "c.py", "c"}
    assert tools.graph.relationships.count() == 3 and {r.file_path for r in tools.graph.file_hashes.collect()} == {"a.py", "c.py"}
    for path in ("saved.json", "saved"):
        tools.save_graph(str(tmp_path / path))
        assert {r.name for r in GraphTools.load_graph(spark, str(tmp_path / path)).graph.entities.collect()} == {"a.py", "A", "run", "c.py", "c"}


def test_external_index(spark, tmp_path):
    folder = tmp_path / "Work" / ".comp"
    folder.mkdir(parents=True)
    con = sqlite3.connect(folder / "index.db")
    con.executescript(
        """CREATE TABLE files (id INTEGER PRIMARY KEY, path TEXT, hash TEXT, language TEXT, last_indexed INTEGER, char_count INTEGER);
        CREATE TABLE nodes (id INTEGER PRIMARY KEY, file_id INTEGER, name TEXT, kind TEXT, line INTEGER, col INTEGER, scope TEXT, is_exported INTEGER, signature TEXT);
        CREATE TABLE edges (from_id INTEGER, to_id INTEGER, kind TEXT);
        INSERT INTO files VALUES (1, 'src/a.ts', 'h', 'ts', 77, 9);
        INSERT INTO nodes VALUES (1, 1, 'Box', 'class', 0, -1, NULL, 1, NULL), (2, 1, 'open', 'method', 3, 2, 'Box', 0, 'open()'), (3, 1, 'odd', 'gizmo', 4, 0, 'Nowhere', 0, NULL);
        INSERT INTO edges VALUES (2, 3, 'function_call'), (1, 3, 'weird'), (1, 9, 'calls');"""
    )
    con.close()
    path = str(tmp_path / "Work")
    tables = external_index.read_tables(spark, path)
    graph, lost = external_index.to_graph(tables, external_index.alias_of(path))
    assert {(r.id, r.name, r.type, r.line, r.col, r.scope) for r in graph.entities.collect()} == {
        ("comp:work:f1", "src/a.ts", "module", 1, 0, "public"), ("comp:work:n1", "Box", "class", 1, 0, "public"), ("comp:work:n2", "open", "method", 3, 2, "private"), ("comp:work:n3", "odd", "variable", 4, 0, "private")
    }
    assert sorted(r.type for r in graph.relationships.collect()) == ["calls", "contains", "contains", "contains", "contains", "depends_on"] and lost.count() == 1
    assert external_index.index_info(tables).first().asDict() == {"files": 1, "last_indexed": 77, "nodes": 3, "edges": 3} and tables["metadata"].count() == 0


def test_git_log(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=n@e", *a], check=True, capture_output=True)
    git("init", "-q")
    for i in range(3):
        (tmp_path / "a.txt").write_text("x\n" * (i + 1))
        git("add", "-A")
        git("commit", "-qm", f"c{i}")
    log = gitlog.read_log(spark, [str(tmp_path)])
    assert sorted((r.file_path, r.author, r.lines) for r in log.collect()) == [("a.txt", "n@e", 1)] * 3


def test_repository_of_a_path(tmp_path):
    (tmp_path / "r" / ".git").mkdir(parents=True)
    (tmp_path / "r" / "a" / "b").mkdir(parents=True)
    assert gitlog.find_repository(str(tmp_path / "r" / "a" / "b")) == str(tmp_path / "r") and gitlog.find_repository(str(tmp_path)) is None


def test_command_line(spark, tmp_path, capsys):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("class Store: pass\n")
    run = lambda *a: (cli.main(list(map(str, a))), capsys.readouterr().out)[1]
    assert '"class"' in run("parse", src, "-o", tmp_path / "g.json")
    assert "Store" in run("query", tmp_path / "g.json", "store") and '"valid": true' in run("validate", tmp_path / "g.json")
    run("save", tmp_path / "g.json", tmp_path / "native")
    assert run("load", tmp_path / "native") == run("stats", tmp_path / "native") and "Python" in run("info")
    (src / "b.py").write_text("def late(): pass\n")
    assert "late" not in run("watch", src, "-o", tmp_path / "w", "--rounds", 1, "--every", 0)
    assert "late" in run("query", tmp_path / "w", "late")


def test_watch(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [("g", "a.py", "1", at(1)), ("g", "a.py", "1", at(2)), ("g", "a.py", "2", at(3)), ("g", "b.py", "1", at(1)), ("g", "b.py", None, at(4)), ("g", "c.txt", "9", at(1))]
    spark.createDataFrame(rows, watch.STATES).coalesce(1).write.parquet(str(tmp_path / "in"))
    states = watch.wanted(spark.readStream.schema(watch.STATES).parquet(str(tmp_path / "in")), ["**/*.py"], ["**/no*"])
    watch.start_ledger(watch.file_changes(states), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    changes = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.file_path, r.status) for r in changes.collect()) == [("a.py", "changed"), ("a.py", "new"), ("b.py", "deleted"), ("b.py", "new")]
    assert [tuple(r)[1:] for r in watch.ledger(changes).collect()] == [("a.py", "2")]
    bursts = watch.settled(spark.createDataFrame(rows, watch.STATES), "2 seconds")
    assert sorted((r.file_path, r.events, r.hash_value) for r in bursts.where(F.col("file_path") == "a.py").collect()) == [("a.py", 3, "2")]
