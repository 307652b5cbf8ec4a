"""Entities and relationships from source files: one pass over each file gives all its facts.

Python files go through the interpreter's own syntax tree, all others (and Python files that do
not parse) through the scanner of ``functions.scan``.  A fact is an entity with its content
(documentation, parameters, return type, decorators, bases, enclosing entity) or a relationship.
Ids are content-addressed, so that a second run gives the same ids; ``seq`` follows the files'
order and the place in the file.
"""

from __future__ import annotations

import ast
import hashlib
import itertools
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scan, text
from graphloom.functions.scan import Declared
from graphloom.graph import KnowledgeGraph
from graphloom.session import spread

FACTS = (
    "file_id long, graph string, file_path string, extension string, fact string, place int, line int, col int, end_line int, kind string, name string, id string, parent_id string, "
    "docstring string, parameters array<array<string>>, return_type string, decorators array<string>, bases array<string>, is_async boolean, target string"
)
_COLUMNS = [x.split()[0] for x in FACTS.replace("array<array<string>>", "a").split(", ")]
_CALLABLE = ("function", "method")


def entity_id(graph: str, path: str, kind: str, name: str, line: int) -> str:
    return "ent_" + hashlib.sha256(f"{graph}|{path}|{kind}|{name}|{line}".encode("utf-8", "replace")).hexdigest()[:12]


def module_id(graph: str, path: str) -> str:
    return "mod_" + hashlib.sha256(f"{graph}|{path}".encode("utf-8", "replace")).hexdigest()[:12]


def _python(source: str) -> tuple[list[Declared], set[tuple[int, int]], list[tuple[int, str]]] | None:
    """(declarations, calls, imports) from the syntax tree; None if the text does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    starts = list(itertools.accumulate((len(x) for x in source.splitlines(keepends=True)), initial=0)) if "\f" not in source and "\x0b" not in source and source.isascii() else None
    rows = source.split("\n")
    starts = starts or list(itertools.accumulate((len(x) + 1 for x in rows), initial=0))
    at = lambda line, col: starts[line - 1] + (col if source.isascii() else len(rows[line - 1].encode()[:col].decode("utf-8", "replace")))
    out: list[Declared] = []
    imports: list[tuple[int, str]] = []
    called: list[tuple[int, str]] = []
    stack: list[tuple[ast.AST, int | None, int | None]] = [(tree, None, None)]
    while stack:
        node, parent, owner = stack.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            is_class = isinstance(node, ast.ClassDef)
            inside = parent is not None and out[parent].kind == "class"
            kind = "class" if is_class else "method" if inside else "function"
            parameters = None
            if not is_class:
                a = node.args
                every = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
                parameters = [(x.arg, ast.unparse(x.annotation) if x.annotation else None) for x in every if x.arg not in ("self", "cls") or not inside]
            start = at(node.lineno, node.col_offset)
            name_at = source.find(node.name, start)
            out.append(
                Declared(
                    kind, node.name, start, name_at, at(node.end_lineno, node.end_col_offset), ast.get_docstring(node), parameters, ast.unparse(node.returns) if not is_class and node.returns else None,
                    [ast.unparse(x) for x in node.decorator_list], [("inherits", ast.unparse(x)) for x in node.bases] if is_class else [], isinstance(node, ast.AsyncFunctionDef), parent,
                )
            )
            parent = len(out) - 1
            owner = owner if is_class else parent
        elif isinstance(node, ast.Import):
            imports += [(at(node.lineno, node.col_offset), x.name) for x in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports.append((at(node.lineno, node.col_offset), "." * node.level + (node.module or "")))
        elif isinstance(node, ast.Call) and owner is not None:
            f = node.func
            called.append((owner, f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""))
        stack += [(child, parent, owner) for child in reversed(list(ast.iter_child_nodes(node)))]
    by_name = {d.name: i for i, d in sorted(enumerate(out), key=lambda x: x[1].start) if d.kind in _CALLABLE}
    links = {(i, by_name[n]) for i, n in called if n in by_name and by_name[n] != i}
    return out, links, sorted(imports)


def file_facts(file_id: int, graph: str, path: str, source: str) -> Iterator[tuple]:
    """The facts of one file in the order of FACTS; the module itself is the first."""
    source = source.replace("\r\n", "\n").replace("\r", "\n")
    base = path.rsplit("/", 1)[-1]
    extension = "." + base.rsplit(".", 1)[-1].lower() if "." in base else ""
    head = (file_id, graph, path, extension)
    own = module_id(graph, path)
    read = _python(source) if extension == ".py" else None
    if read is None:
        declared, masked = scan.scan(source, extension)
        read = declared, scan.calls(declared, masked), scan.modules(source, masked, extension)
    declared, links, imported = read
    breaks = [m.start() for m in re.finditer("\n", source)]
    line_of = lambda at: bisect_line(breaks, at)
    link = lambda n, relation, source_id, target, at=0: (*head, relation, n, line_of(at), None, None, None, None, source_id, None, None, None, None, None, None, None, target)
    yield (*head, "entity", 0, 1, 0, len(breaks) + 1, "module", base, own, None, None, None, None, None, None, None, None)
    # A block of implementations is the type that it is for.
    types = {d.name: i for i, d in enumerate(declared) if d.kind in ("class", "interface", "trait", "struct", "enum", "type")}
    ids: list[str] = []
    for d in declared:
        if d.kind == "impl":
            ids.append(ids[types[d.name]] if d.name in types and types[d.name] < len(ids) else f"type:{d.name.lower()}")
        else:
            ids.append(entity_id(graph, path, d.kind, d.name, line_of(d.name_at)))
    known = {name: ids[i] for name, i in types.items()}
    n = 0
    for i, d in enumerate(declared):
        outer = ids[d.parent] if d.parent is not None else None
        if d.kind != "impl":
            n += 1
            name_line = line_of(d.name_at)
            col = d.start - (source.rfind("\n", 0, d.start) + 1)
            parameters = [[a, b] for a, b in d.parameters] if d.parameters is not None else None
            yield (*head, "entity", n, name_line, col, line_of(d.end), d.kind, d.name, ids[i], outer, d.docstring, parameters, d.return_type, d.decorators, [b for _, b in d.bases], d.is_async, None)
            yield link(n, "contains", outer or own, ids[i], d.name_at)
        for relation, name in d.bases:
            yield link(n, relation, ids[i], known.get(name.split(".")[-1].split("::")[-1], f"external:{name.lower()}"), d.name_at)
        used = {w for t in (*(b for _, b in d.parameters or ()), d.return_type) if t for w in re.findall(r"[A-Za-z_]\w*", t)}
        for name in sorted(used & known.keys()):
            if known[name] != ids[i]:
                yield link(n, "uses_type", ids[i], known[name], d.name_at)
    for a, b in sorted(links):
        yield link(n, "calls", ids[a], ids[b], declared[a].name_at)
    for at, module in imported:
        yield link(n, "imports", own, f"external:{module.lower()}", at)


def bisect_line(breaks: list[int], at: int) -> int:
    import bisect

    return bisect.bisect_left(breaks, at) + 1


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows: list[tuple] = []
        for file_id, graph, path, source in zip(pdf["file_id"], pdf["graph"], pdf["file_path"], pdf["source_text"]):
            rows += file_facts(file_id, graph or "", path, source)
            if len(rows) > 20_000:
                yield _frame(rows)
                rows = []
        yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    clean = lambda x: x.encode("utf-8", "replace").decode() if isinstance(x, str) and not x.isascii() else x
    out = pd.DataFrame([tuple(map(clean, r)) for r in rows], columns=_COLUMNS)
    for c in ("place", "line", "col", "end_line"):
        out[c] = out[c].astype("Int32")
    out["is_async"] = out["is_async"].astype("boolean")
    return out


def facts(files: DataFrame) -> DataFrame:
    """Rows of FACTS: entities and relationships of all files, in one pass.

    files: file_id, graph, file_path, source_text.  Null texts and paths give nothing, empty texts
    and unknown extensions their module alone; a text that does not parse gives what the scanner
    finds; repeated files give repeated rows.
    """
    rows = files.where("source_text is not null and file_path is not null").select("file_id", "graph", "file_path", "source_text")
    return spread(rows).mapInPandas(_facts, FACTS)


def declarations(found: DataFrame) -> DataFrame:
    """The entities among the facts, without the modules of the files themselves."""
    columns = ["file_id", "graph", "file_path", "line", "col", "end_line", "kind", "name", "id", "parent_id", "docstring", "parameters", "return_type", "decorators", "bases", "is_async"]
    return found.where("fact = 'entity' and place > 0").select(*columns)


def links(found: DataFrame, *relations: str) -> DataFrame:
    """(file_id, graph, file_path, line, source_id, type, target_id): the relationships among the facts, of the given types or all."""
    rows = found.where(F.col("fact").isin(*relations)) if relations else found.where("fact <> 'entity'")
    return rows.select("file_id", "graph", "file_path", "line", F.col("id").alias("source_id"), F.col("fact").alias("type"), F.col("target").alias("target_id"))


def parse_totals(found: DataFrame) -> DataFrame:
    """Per graph and extension: files, lines, entities, functions, relationships."""
    module = (F.col("fact") == "entity") & (F.col("place") == 0)
    return found.groupBy("graph", "extension").agg(
        F.count_if(module).alias("files"), F.sum(F.when(module, F.col("end_line"))).alias("lines"), F.count_if((F.col("fact") == "entity") & ~module).alias("entities"),
        F.count_if(F.col("kind").isin("function", "method")).alias("functions"), F.count_if(F.col("fact") != "entity").alias("relationships"),
    )


def to_graph(found: DataFrame, hashes: DataFrame | None = None) -> KnowledgeGraph:
    """The facts as a graph; seq follows file, then place in it, and edges their file and order.

    Files are numbered by a hash of graph and path, whose upper bits leave room for the places.
    """
    base = F.shiftleft(F.pmod(F.xxhash64("graph", "file_path"), F.lit(1 << 40)), 22)
    extra = F.to_json(F.struct("parameters", "return_type", "decorators", "is_async", F.when(F.col("kind") == "method", F.col("parent_id")).alias("class_id"), "bases"))
    entities = found.where("fact = 'entity'").select(
        "graph", (base + F.col("place")).alias("seq"), "id", "name", F.col("kind").alias("type"), "file_path", "line", "col", "docstring", F.lit(None).cast("string").alias("scope"), extra.alias("extra_data"), "parent_id"
    )
    names = entities.select("graph", F.col("id").alias("parent_id"), F.col("name").alias("outer"))
    entities = entities.join(names, ["graph", "parent_id"], "left").withColumn("scope", F.col("outer")).drop("parent_id", "outer").dropDuplicates(["graph", "id"])
    edges = found.where("fact <> 'entity'").groupBy("graph", "file_path", F.col("id").alias("source_id"), F.col("target").alias("target_id"), F.col("fact").alias("type")).agg(F.min("place").alias("place"), F.min("line").alias("line"))
    number = base + F.pmod(F.xxhash64("source_id", "target_id", "type"), F.lit(1 << 22))
    edges = edges.select(number.alias("rel_id"), "graph", "source_id", "target_id", "type")
    return KnowledgeGraph(entities, edges, hashes)
