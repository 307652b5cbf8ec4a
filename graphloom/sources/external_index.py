"""External index databases in SQLite, read through the Python data source API.

Tables: files(id, path, language, last_indexed), nodes(id, file_id, name, kind, line, col,
scope, is_exported, signature), edges(from_id, to_id, kind), metadata(key, value), which older
indexes lack.  The database is opened read-only; a table is cut into ranges of its rowid.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.graph import KnowledgeGraph

# Kinds of nodes and edges in the index and their types here; others become variable and depends_on.
NODE_KINDS = {
    "function": "function", "class": "class", "interface": "interface", "struct": "struct", "enum": "enum", "type": "type", "variable": "variable", "constant": "variable",
    "module": "module", "namespace": "module", "method": "method", "property": "variable",
}
EDGE_KINDS = {
    "import": "imports", "imports": "imports", "function_call": "calls", "calls": "calls", "type_reference": "references", "references": "references",
    "inheritance": "inherits", "extends": "inherits", "implements": "implements",
}

_SCHEMAS = {
    "files": "id bigint, path string, language string, last_indexed bigint",
    "nodes": "id bigint, file_id bigint, name string, kind string, line bigint, col bigint, scope string, is_exported bigint, signature string",
    "edges": "from_id bigint, to_id bigint, kind string",
    "metadata": "key string, value string",
}


def resolve_path(path: str) -> Path:
    """The database at a path, at its index.db or in its .comp folder."""
    for p in (Path(path), Path(path) / "index.db", Path(path) / ".comp" / "index.db"):
        if p.is_file() and p.suffix == ".db":
            return p
    raise FileNotFoundError(path)


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], rows: int):
        self.path, self.table, self.columns, self.rows = path, table, columns, rows

    def _open(self):
        import sqlite3
        from urllib.parse import quote

        con = sqlite3.connect(f"file:{quote(self.path)}?mode=ro", uri=True)
        con.execute("PRAGMA busy_timeout = 5000")
        return con

    def partitions(self):
        con = self._open()
        try:
            if not con.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (self.table,)).fetchone():
                return [_Range(0, 0)]
            last = con.execute(f"SELECT coalesce(max(rowid), 0) FROM {self.table}").fetchone()[0]
        finally:
            con.close()
        return [_Range(low, low + self.rows) for low in range(0, last + 1, self.rows)]

    def read(self, partition):
        if partition.low == partition.high:
            return
        con = self._open()
        try:
            yield from con.execute(f"SELECT {', '.join(self.columns)} FROM {self.table} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high))
        finally:
            con.close()


class SqliteTable(DataSource):
    """spark.read.format("sqlite_table").option("path", ...).option("table", ...).load()"""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        return _SCHEMAS[self.options["table"]]

    def reader(self, schema):
        return _Reader(self.options["path"], self.options["table"], schema.names, int(self.options.get("rows", "100000")))


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    spark.dataSource.register(SqliteTable)
    db = str(resolve_path(path))
    return {t: spark.read.format("sqlite_table").option("path", db).option("table", t).load() for t in _SCHEMAS}


def alias_of(path: str) -> str:
    """The lower-cased name of the workspace folder."""
    p = resolve_path(path).resolve().parent
    return (p.parent if p.name == ".comp" else p).name.lower()


def _mapped(kinds: dict[str, str], kind: str, default: str) -> F.Column:
    table = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(kind)), F.lit(default))


def to_graph(tables: dict[str, DataFrame], alias: str) -> tuple[KnowledgeGraph, DataFrame]:
    """The graph of an index, and its edges with an end that is no node.

    Files become modules that contain their nodes; a node whose scope names exactly one other
    node of the file is contained by that one too.  Lines are at least 1, columns at least 0.
    """
    files, nodes, edges = tables["files"], tables["nodes"], tables["edges"]
    file_key = lambda c: F.concat(F.lit(f"comp:{alias}:f"), F.col(c).cast("string"))
    node_key = lambda c: F.concat(F.lit(f"comp:{alias}:n"), F.col(c).cast("string"))
    none = F.lit(None).cast("string").alias("extra_data")
    modules = files.select(
        F.lit(alias).alias("graph"), F.col("id").alias("seq"), file_key("id").alias("id"), F.col("path").alias("name"), F.lit("module").alias("type"), F.col("path").alias("file_path"), F.lit(1).alias("line"), F.lit(0).alias("col"),
        F.concat(F.lit("language="), "language").alias("docstring"), F.lit("public").alias("scope"), none,
    )
    placed = nodes.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id", "left")
    members = placed.select(
        F.lit(alias).alias("graph"), (F.col("id") + (1 << 40)).alias("seq"), node_key("id").alias("id"), "name", _mapped(NODE_KINDS, "kind", "variable").alias("type"), F.coalesce("file_path", F.lit("<unknown>")).alias("file_path"),
        F.greatest("line", F.lit(1)).cast("int").alias("line"), F.greatest("col", F.lit(0)).cast("int").alias("col"), F.col("signature").alias("docstring"), F.when(F.col("is_exported") != 0, "public").otherwise("private").alias("scope"), none,
    )
    contains = F.lit("contains").alias("type")
    of_file = placed.where("file_path is not null").select(file_key("file_id").alias("source_id"), node_key("id").alias("target_id"), contains)
    unique = nodes.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("file_id", "name"))).where("n = 1").select("file_id", F.col("name").alias("scope"), F.col("id").alias("outer"))
    of_scope = nodes.where("scope <> ''").join(unique, ["file_id", "scope"]).where("outer <> id").select(node_key("outer").alias("source_id"), node_key("id").alias("target_id"), contains)
    ids = nodes.select("id")
    ends = edges.join(ids.select(F.col("id").alias("from_id"), F.lit(1).alias("a")), "from_id", "left").join(ids.select(F.col("id").alias("to_id"), F.lit(1).alias("b")), "to_id", "left")
    named = ends.where("a = 1 and b = 1").select(node_key("from_id").alias("source_id"), node_key("to_id").alias("target_id"), _mapped(EDGE_KINDS, "kind", "depends_on").alias("type"))
    links = of_file.unionByName(of_scope).unionByName(named)
    links = links.select(F.xxhash64("source_id", "target_id", "type").alias("rel_id"), F.lit(alias).alias("graph"), "source_id", "target_id", "type")
    return KnowledgeGraph(modules.unionByName(members), links), ends.where("a is null or b is null").select("from_id", "to_id", "kind")


def index_info(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: files, nodes, edges, last_indexed."""
    return (
        tables["files"].agg(F.count(F.lit(1)).alias("files"), F.max("last_indexed").alias("last_indexed"))
        .crossJoin(tables["nodes"].agg(F.count(F.lit(1)).alias("nodes")))
        .crossJoin(tables["edges"].agg(F.count(F.lit(1)).alias("edges")))
    )
