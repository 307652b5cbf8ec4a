"""The knowledge graph as DataFrames.

entities: graph, seq, id, name, type, file_path, line, col, docstring, scope, extra_data - one
row per (graph, id), the latest life if it is still alive.  relationships: rel_id, graph,
source_id, target_id, type - every edge once, parallel edges kept.  file_hashes: graph,
file_path, hash_value.  Order of insertion is ``seq`` for entities and ``rel_id`` for edges.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.references import canonical
from graphloom.session import ensure_checkpoint_dir, table

ENTITY_COLUMNS = ["graph", "seq", "id", "name", "type", "file_path", "line", "col", "docstring", "scope", "extra_data"]
EDGE_COLUMNS = ["rel_id", "graph", "source_id", "target_id", "type"]

# The types of entities and relationships.
ENTITY_TYPES = ["module", "class", "function", "method", "type", "variable", "interface", "trait", "struct", "enum"]
RELATIONSHIP_TYPES = ["inherits", "implements", "calls", "imports", "uses_type", "contains", "depends_on", "references", "returns"]


def current_entities(rows: DataFrame) -> DataFrame:
    """The latest life of each (graph, id), without those that ended; null keys are left out."""
    keyed = rows.withColumn("id", canonical(F.col("id"))).where("graph is not null and id is not null")
    latest = F.max_by(F.struct(*[c for c in ENTITY_COLUMNS if c not in ("graph", "id")], "removed_at"), F.struct("created_at", "ingested_at", "seq"))
    return keyed.groupBy("graph", "id").agg(latest.alias("e")).select("graph", "id", "e.*").where("removed_at is null").select(*ENTITY_COLUMNS)


def clean_edges(rows: DataFrame) -> DataFrame:
    """Edges in canonical form, each rel_id once."""
    edge = F.struct("graph", canonical(F.col("source_id")).alias("source_id"), canonical(F.col("target_id")).alias("target_id"), canonical(F.col("type")).alias("type"))
    return rows.where("rel_id is not null").groupBy("rel_id").agg(F.min(edge).alias("e")).select("rel_id", "e.*")


#: Where the current graphs of this process lie: (application, folder, state of the tables) -> path.
_BUILT: dict[tuple, str] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Lengths and times of the table files, by which a change of the tables shows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in ("entities", "relationships", "source_files"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        out += [(name, f.getLen(), f.getModificationTime()) for f in path.getFileSystem(conf).listStatus(path)]
    return tuple(out)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


@dataclass(frozen=True)
class KnowledgeGraph:
    entities: DataFrame
    relationships: DataFrame
    file_hashes: DataFrame | None = None

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str) -> KnowledgeGraph:
        files = table(spark, sf_dir, "source_files").select("graph", "file_path", "hash_value", "updated_at")
        return cls(
            current_entities(table(spark, sf_dir, "entities")),
            clean_edges(table(spark, sf_dir, "relationships")),
            files.groupBy("graph", "file_path").agg(F.max_by("hash_value", F.struct("updated_at", "hash_value")).alias("hash_value")),
        )

    @classmethod
    def current(cls, spark: SparkSession, sf_dir: str) -> KnowledgeGraph:
        """As ``from_tables``, worked out once for a state of the tables and read from the shared folder since.

        The lives and deliveries of the raw rows are settled in one pass; after that, filters and
        column choices reach the scan.  Rows lie sorted by key, so that statistics prune lookups.
        """
        key = (spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir))
        path = _BUILT.get(key)
        if path is None or not _exists(spark, f"{path}/file_hashes/_SUCCESS"):
            ensure_checkpoint_dir(spark)
            path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/graph-{uuid.uuid4().hex}"
            g = cls.from_tables(spark, sf_dir)
            g.entities.sortWithinPartitions("graph", "id").write.parquet(f"{path}/entities")
            g.relationships.sortWithinPartitions("graph", "source_id").write.parquet(f"{path}/relationships")
            g.file_hashes.write.parquet(f"{path}/file_hashes")
            _BUILT[key] = path
        return cls(*(spark.read.parquet(f"{path}/{part}") for part in ("entities", "relationships", "file_hashes")))

    def only(self, *graphs: str) -> KnowledgeGraph:
        """The part of the given graphs; with data partitioned by graph this prunes the scan."""
        keep = F.col("graph").isin(*graphs)
        return replace(self, entities=self.entities.where(keep), relationships=self.relationships.where(keep))

    def adjacency(self) -> DataFrame:
        """Distinct directed pairs (graph, src, dst); null ends are left out."""
        return self.relationships.where("source_id is not null and target_id is not null").select("graph", F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct()

    def undirected(self) -> DataFrame:
        a = self.adjacency()
        return a.unionByName(a.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
