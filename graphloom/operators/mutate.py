"""Changes to a graph: every operator gives a new graph, nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import EDGE_COLUMNS, KnowledgeGraph

_KEY = ["graph", "id"]


def add_entities(g: KnowledgeGraph, rows: DataFrame) -> tuple[KnowledgeGraph, DataFrame]:
    """The graph with new entities, and those rows whose key was there already."""
    known = g.entities.select(*_KEY)
    fresh = rows.join(known, _KEY, "left_anti")
    return KnowledgeGraph(g.entities.unionByName(fresh, allowMissingColumns=True), g.relationships, g.file_hashes), rows.join(known, _KEY, "left_semi")


def add_edges(g: KnowledgeGraph, rows: DataFrame) -> tuple[KnowledgeGraph, DataFrame]:
    """The graph with new edges, and those rows whose rel_id was there already; parallel edges are kept."""
    known = g.relationships.select("rel_id")
    fresh = rows.join(known, "rel_id", "left_anti").select(*EDGE_COLUMNS)
    return KnowledgeGraph(g.entities, g.relationships.unionByName(fresh, allowMissingColumns=True), g.file_hashes), rows.join(known, "rel_id", "left_semi")


def update_entities(g: KnowledgeGraph, rows: DataFrame) -> tuple[KnowledgeGraph, DataFrame]:
    """The graph with rows in place of entities of the same key, and those rows whose key is not there."""
    known = g.entities.select(*_KEY)
    return upsert_entities(g, rows.join(known, _KEY, "left_semi")), rows.join(known, _KEY, "left_anti")


def set_hashes(g: KnowledgeGraph, hashes: DataFrame) -> KnowledgeGraph:
    """The graph with the given file hashes (graph, file_path, hash_value) in place of those of the same files."""
    kept = g.file_hashes.join(hashes.select("graph", "file_path"), ["graph", "file_path"], "left_anti") if g.file_hashes is not None else None
    fresh = hashes.select("graph", "file_path", "hash_value")
    return KnowledgeGraph(g.entities, g.relationships, kept.unionByName(fresh) if kept is not None else fresh)


def clear(g: KnowledgeGraph) -> KnowledgeGraph:
    """A graph of the same columns without rows."""
    return KnowledgeGraph(g.entities.limit(0), g.relationships.limit(0), g.file_hashes.limit(0) if g.file_hashes is not None else None)


def refresh(g: KnowledgeGraph, parsed: KnowledgeGraph, changes: DataFrame) -> KnowledgeGraph:
    """The graph after files changed: those of ``changes`` (from ``classify_files``) that are gone or changed leave, the parsed ones come in.

    Edges from other files into an entity that keeps its id stay.
    """
    gone = changes.where("status in ('changed', 'deleted')").select("graph", "file_path")
    old = g.entities.join(gone, ["graph", "file_path"], "left_semi").select(*_KEY)
    lost = old.join(parsed.entities.select(*_KEY), _KEY, "left_anti")
    e = g.relationships.join(old.withColumnRenamed("id", "source_id"), ["graph", "source_id"], "left_anti").join(lost.withColumnRenamed("id", "target_id"), ["graph", "target_id"], "left_anti").select(*EDGE_COLUMNS)
    nodes = g.entities.join(gone, ["graph", "file_path"], "left_anti").unionByName(parsed.entities, allowMissingColumns=True)
    hashes = g.file_hashes.join(gone, ["graph", "file_path"], "left_anti").unionByName(parsed.file_hashes) if g.file_hashes is not None else parsed.file_hashes
    return KnowledgeGraph(nodes, e.unionByName(parsed.relationships.select(*EDGE_COLUMNS)), hashes)


def upsert_entities(g: KnowledgeGraph, rows: DataFrame) -> KnowledgeGraph:
    """Rows replace entities of the same key and are added otherwise; the last write wins."""
    kept = g.entities.join(rows.select(*_KEY), _KEY, "left_anti")
    return KnowledgeGraph(kept.unionByName(rows, allowMissingColumns=True), g.relationships, g.file_hashes)


def delete_entities(g: KnowledgeGraph, keys: DataFrame) -> KnowledgeGraph:
    """Without the entities and, in cascade, without the edges at them."""
    gone = keys.select(*_KEY).distinct()
    e = g.relationships
    for side in ("source_id", "target_id"):
        e = e.join(gone.withColumnRenamed("id", side), ["graph", side], "left_anti")
    return KnowledgeGraph(g.entities.join(gone, _KEY, "left_anti"), e.select(*EDGE_COLUMNS), g.file_hashes)


def delete_edges(g: KnowledgeGraph, source: str | None = None, target: str | None = None, kind: str | None = None) -> KnowledgeGraph:
    """Without the edges that meet all given criteria; none given deletes nothing."""
    hit = F.lit(False) if source is target is kind is None else F.lit(True)
    for column, value in (("source_id", source), ("target_id", target), ("type", kind)):
        if value is not None:
            hit = hit & F.col(column).eqNullSafe(value)
    return KnowledgeGraph(g.entities, g.relationships.where(~hit), g.file_hashes)


def remove_files(g: KnowledgeGraph, files: DataFrame) -> KnowledgeGraph:
    """Without the entities of the files (graph, file_path), their edges and their hashes."""
    gone = files.select("graph", "file_path").distinct()
    out = delete_entities(g, g.entities.join(gone, ["graph", "file_path"], "left_semi"))
    hashes = g.file_hashes.join(gone, ["graph", "file_path"], "left_anti") if g.file_hashes is not None else None
    return KnowledgeGraph(out.entities, out.relationships, hashes)


def replace_by_prefix(g: KnowledgeGraph, prefix: str, other: KnowledgeGraph) -> KnowledgeGraph:
    """Another graph in place of everything whose id begins with the prefix."""
    inside = F.col("id").startswith(prefix)
    cleared = delete_entities(g, g.entities.where(inside))
    return KnowledgeGraph(cleared.entities.unionByName(other.entities, allowMissingColumns=True), cleared.relationships.unionByName(other.relationships, allowMissingColumns=True), g.file_hashes)


def classify_files(current: DataFrame, ledger: DataFrame) -> DataFrame:
    """(graph, file_path, status): new, changed, unchanged or deleted against the ledger of hashes."""
    now, then = current.select("graph", "file_path", F.col("hash_value").alias("now")), ledger.select("graph", "file_path", F.col("hash_value").alias("then"))
    status = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") == F.col("then"), "unchanged").otherwise("changed")
    return now.join(then, ["graph", "file_path"], "full_outer").select("graph", "file_path", status.alias("status"))


def content_hash(files: DataFrame) -> DataFrame:
    """(file_id, hash_value, stored, same): the SHA-256 of each text beside the stored one."""
    h = F.sha2(F.col("source_text").cast("binary"), 256)
    return files.select("file_id", h.alias("hash_value"), F.col("hash_value").alias("stored"), (h == F.col("hash_value")).alias("same"))
