"""Graph files as JSON: {entities, relationships, file_hashes}, one file per graph."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import KnowledgeGraph
from graphloom.operators.references import canonical

# Given rather than inferred, as file_hashes would be inferred as one column per path.
SCHEMA = """
entities array<struct<id:string,name:string,type:string,location:struct<file:string,line:int,column:int>,docstring:string,scope:string,
  parameters:array<array<string>>,return_type:string,decorators:array<string>,is_async:boolean,class_id:string,bases:array<string>,exports:array<string>>>,
relationships array<struct<source_id:string,target_id:string,type:string,metadata:map<string,string>>>,
file_hashes map<string,string>
"""

_FILE = r"([^/]+)\.json$"


def read_graphs(spark: SparkSession, path: str) -> KnowledgeGraph:
    """All graph files under a path; a graph is named by its file.  Order in a file becomes seq."""
    files = spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("graph", F.regexp_extract(F.input_file_name(), _FILE, 1))
    return from_documents(files)


#: What an entity has beyond the columns of the graph; kept as JSON in extra_data.
EXTRA = "parameters array<array<string>>, return_type string, decorators array<string>, is_async boolean, class_id string, bases array<string>, exports array<string>"
_EXTRA = [x.split()[0] for x in EXTRA.split(", ")]


def from_documents(files: DataFrame) -> KnowledgeGraph:
    """A graph from rows (graph, entities, relationships, file_hashes) of the schema above.

    rel_id is unique over all graphs and follows the order in the file; edges keep their metadata.
    """
    extra = F.to_json(F.struct(*[F.col(f"e.{c}").alias(c) for c in _EXTRA]))
    e = files.select("graph", F.posexplode("entities").alias("pos", "e")).select(
        "graph", F.col("pos").cast("long").alias("seq"), canonical(F.col("e.id")).alias("id"), "e.name", "e.type", F.col("e.location.file").alias("file_path"), F.col("e.location.line").alias("line"),
        F.col("e.location.column").alias("col"), "e.docstring", "e.scope", F.nullif(extra, F.lit("{}")).alias("extra_data"),
    )
    number = F.shiftleft(F.pmod(F.xxhash64("graph"), F.lit(1 << 31)), 32) + F.col("pos")
    r = files.select("graph", F.posexplode("relationships").alias("pos", "r")).select(
        number.alias("rel_id"), "graph", canonical(F.col("r.source_id")).alias("source_id"), canonical(F.col("r.target_id")).alias("target_id"), canonical(F.col("r.type")).alias("type"), "r.metadata"
    )
    h = files.select("graph", F.explode("file_hashes").alias("file_path", "hash_value"))
    return KnowledgeGraph(e, r, h)


def to_documents(g: KnowledgeGraph, per_document: int = 20_000) -> DataFrame:
    """(graph, part, document): each graph as JSON texts for exchange; the native form is Parquet.

    A graph above ``per_document`` entities or edges is cut into parts, entities by the hash of
    their ids and edges by that of rel_id, so that no text has to hold a whole graph or all
    edges of a hub.
    """
    nodes, edges = g.entities.where("graph is not null"), g.relationships.where("graph is not null")
    sizes = lambda rows: rows.groupBy("graph").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / per_document)).alias("parts"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("parts")).cast("int").alias("part")
    extra = F.from_json("extra_data", EXTRA)
    place = F.struct(F.col("file_path").alias("file"), "line", F.col("col").alias("column")).alias("location")
    item = F.struct("seq", "id", F.struct("id", "name", "type", place, "docstring", "scope", *[extra[c].alias(c) for c in _EXTRA]).alias("e"))
    entities = nodes.join(sizes(nodes), "graph").groupBy("graph", part("id")).agg(F.array_sort(F.collect_list(item)).alias("x")).select("graph", "part", F.transform("x", lambda v: v["e"]).alias("entities"))
    metadata = F.col("metadata") if "metadata" in edges.columns else F.lit(None).cast("map<string,string>").alias("metadata")
    edges = edges.withColumn("metadata", F.transform(F.map_entries(metadata), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))))
    edge = F.struct("rel_id", "source_id", "target_id", "type", "metadata")
    as_edge = lambda v: F.struct(v["source_id"].alias("source_id"), v["target_id"].alias("target_id"), v["type"].alias("type"), F.map_from_entries(v["metadata"]).alias("metadata"))
    links = edges.join(sizes(edges), "graph").groupBy("graph", part("rel_id")).agg(F.array_sort(F.collect_list(edge)).alias("x")).select("graph", "part", F.transform("x", as_edge).alias("relationships"))
    out = entities.join(links, ["graph", "part"], "full_outer")
    if g.file_hashes is not None:
        files = g.file_hashes.where("graph is not null")
        hashes = files.join(sizes(files), "graph").groupBy("graph", part("file_path")).agg(F.map_from_entries(F.collect_list(F.struct("file_path", "hash_value"))).alias("file_hashes"))
        out = out.join(hashes, ["graph", "part"], "full_outer")
    return out.select("graph", "part", F.to_json(F.struct(*[c for c in out.columns if c not in ("graph", "part")])).alias("document"))


def write_json(g: KnowledgeGraph, path: str) -> None:
    """One folder ``graph=...`` per graph with its documents as text files."""
    to_documents(g).select("graph", "document").write.mode("overwrite").partitionBy("graph").text(path)


def read_json(spark: SparkSession, path: str) -> KnowledgeGraph:
    """What ``write_json`` wrote."""
    parsed = spark.read.text(path).select(F.col("graph").cast("string").alias("graph"), F.from_json("value", " ".join(SCHEMA.split())).alias("p"))
    return from_documents(parsed.select("graph", "p.*"))


def write_parquet(g: KnowledgeGraph, path: str) -> None:
    """The native form: partitioned by graph, cut by ranges of keys so that a large graph is many files, sorted so that statistics prune lookups."""
    g.entities.repartitionByRange("graph", "id").sortWithinPartitions("graph", "id").write.mode("overwrite").partitionBy("graph").parquet(f"{path}/entities")
    g.relationships.repartitionByRange("graph", "source_id", "rel_id").sortWithinPartitions("graph", "source_id").write.mode("overwrite").partitionBy("graph").parquet(f"{path}/relationships")
    if g.file_hashes is not None:
        g.file_hashes.write.mode("overwrite").parquet(f"{path}/file_hashes")


def read_parquet(spark: SparkSession, path: str) -> KnowledgeGraph:
    fs, jvm = _file_system(spark, path)
    hashes = f"{path}/file_hashes"
    kept = spark.read.parquet(hashes) if fs.exists(jvm.org.apache.hadoop.fs.Path(hashes)) else None
    return KnowledgeGraph(spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/relationships"), kept)


_POINTER = "current."


def _versions(fs, jvm, path: str) -> list[int]:
    folder = jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removeprefix(_POINTER)) for n in names if n.startswith(_POINTER) and n.removeprefix(_POINTER).isdigit())


def commit_version(g: KnowledgeGraph, path: str) -> str:
    """Write a new version of a stored graph beside the old ones and then switch to it.

    Each switch is a new pointer file of the next number, and the greatest number counts: no
    pointer is ever deleted or changed, so that readers see the old version until the new one is
    there, and a failed write leaves it as it was.  Of two writers one gets the number.
    """
    version = f"{path}/versions/{uuid.uuid4().hex}"
    write_parquet(g, version)
    fs, jvm = _file_system(g.entities.sparkSession, path)
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}/fresh.{uuid.uuid4().hex}")
    out = fs.create(fresh)
    out.writeBytes(version)
    out.close()
    # A rename does not overwrite: it fails where another writer was first.
    number = max(_versions(fs, jvm, path), default=0) + 1
    while not fs.rename(fresh, jvm.org.apache.hadoop.fs.Path(f"{path}/{_POINTER}{number:012d}")):
        if not fs.exists(fresh):
            raise OSError(f"cannot switch {path} to {version}")
        taken = max(_versions(fs, jvm, path), default=0)
        if taken < number:
            raise OSError(f"cannot switch {path} to {version}")
        number = taken + 1
    return version


def read_current(spark: SparkSession, path: str) -> KnowledgeGraph:
    """The version that was committed last."""
    fs, jvm = _file_system(spark, path)
    last = _versions(fs, jvm, path)[-1]
    return read_parquet(spark, spark.read.text(f"{path}/{_POINTER}{last:012d}").first()[0])


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, jvm = _file_system(spark, path)
    where = jvm.org.apache.hadoop.fs.Path(path)
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm
