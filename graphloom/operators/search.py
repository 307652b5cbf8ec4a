"""Ranked search and recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.graph import KnowledgeGraph
from graphloom.operators.lookup import BRIEF, usage_counts
from graphloom.session import cut

# What tells a framework by the names in a project.
FRAMEWORK_SIGNS = {
    "fastapi": ["fastapi", "APIRouter", "FastAPI"],
    "django": ["django", "models.Model", "View"],
    "flask": ["flask", "Blueprint", "Flask"],
    "react": ["React", "useState", "useEffect"],
    "express": ["express", "Router", "middleware"],
    "spring": ["@Controller", "@Service", "@Repository"],
}


def _scored(entities: DataFrame, score: Column) -> DataFrame:
    return entities.withColumn("score", score)


def semantic_search(g: KnowledgeGraph, query: str, entity_types: list[str] | None = None, limit: int | None = 20) -> DataFrame:
    """Entities by relevance, best first, ties by insertion; rows of score 0 are left out."""
    found = _scored(g.entities, text.relevance(query, F.col("name"), F.col("docstring"), F.col("file_path"))).where("score > 0")
    if entity_types:
        found = found.where(F.col("type").isin(*entity_types))
    found = found.select(*BRIEF, F.bround("score", 3).alias("score"))
    return found.orderBy(F.desc("score"), "graph", "seq").limit(limit) if limit else found


def relevance_distribution(g: KnowledgeGraph, query: str) -> DataFrame:
    """Hits per graph that are high (7 and more), medium (3 and more) or low, before any limit."""
    s = F.col("score")
    return semantic_search(g, query, limit=None).groupBy("graph").agg(F.count_if(s >= 7).alias("high"), F.count_if((s >= 3) & (s < 7)).alias("medium"), F.count_if(s < 3).alias("low"))


def search_graphs(g: KnowledgeGraph, query: str, entity_type: str | None = None, per_graph: int = 5) -> DataFrame:
    """Names that contain the query, the best of each graph: exact ones first, then short ones.

    total_count is the number of hits in the graph before the limit.
    """
    found = g.entities.where(text.has(F.col("name"), query))
    if entity_type:
        found = found.where(F.col("type") == entity_type)
    order = [F.lower("name") != query.lower(), F.length("name"), F.col("seq")]
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("graph").orderBy(*order))).where(F.col("place") <= per_graph)
    totals = found.groupBy("graph").agg(F.count(F.lit(1)).alias("total_count"))
    return ranked.join(totals, "graph").select(*BRIEF, "place", "total_count", text.clipped(F.col("docstring")).alias("docstring"))


def similar_patterns(g: KnowledgeGraph, name: str) -> DataFrame:
    """How many names contain the pattern, per graph and type, with the first of them."""
    return g.entities.where(text.has(F.col("name"), name)).groupBy("graph", "type").agg(F.count(F.lit(1)).alias("n"), F.min_by("name", "seq").alias("first_name"))


def pattern_examples(g: KnowledgeGraph, name: str, entity_type: str | None = None, limit: int = 20) -> DataFrame:
    """The first entities whose names contain the pattern, graph by graph in order of insertion."""
    found = g.entities.where(text.has(F.col("name"), name))
    if entity_type:
        found = found.where(F.col("type") == entity_type)
    return found.select(*BRIEF, text.cut_short(F.col("docstring")).alias("docstring")).orderBy("graph", "seq").limit(limit)


def recommended(g: KnowledgeGraph, query: str, local: str, min_relevance: float = 0.3) -> DataFrame:
    """All entities of enough weighted relevance; usage counts only for the local graph."""
    usage = usage_counts(g.only(local))
    scored = g.entities.join(usage, ["graph", "id"], "left")
    own = F.when(F.col("graph") == local, F.coalesce("usage", F.lit(0))).otherwise(0)
    found = _scored(scored, text.weighted_relevance(query, F.col("name"), F.col("docstring"), F.col("file_path"), own)).where(F.col("score") >= min_relevance)
    source = F.when(F.col("graph") == local, "local").otherwise("framework").alias("source")
    return found.select(*BRIEF, source, F.bround("score", 6).alias("score"))


def recommend(g: KnowledgeGraph, query: str, local: str, limit: int = 10, min_relevance: float = 0.3) -> DataFrame:
    """The best of ``recommended``, 50 at most."""
    return recommended(g, query, local, min_relevance).orderBy(F.desc("score"), "graph", "seq").limit(min(limit, 50))


def hybrid_ranked(g: KnowledgeGraph, query: str, local: str, local_weight: float = 0.5) -> DataFrame:
    """All hits of the local graph and the frameworks with weighted scores."""
    w = min(1.0, max(0.0, local_weight))
    score = text.hybrid_relevance(query, F.col("name"), F.col("docstring"))
    is_local = F.col("graph") == local
    return _scored(g.entities, score).where("score > 0").select(
        *BRIEF, F.when(is_local, "local").otherwise("framework").alias("source"), (F.col("score") * F.when(is_local, w).otherwise(1 - w)).alias("score")
    )


def hybrid_search(g: KnowledgeGraph, query: str, local: str, local_weight: float = 0.5, limit: int = 20) -> DataFrame:
    """Hits merged and thinned: going down the ranking, a name that contains a kept one, or lies in it, is dropped.

    Equal names thin each other, so the best hit of each name stands for it; then each round
    keeps the first of what is left, which needs as many rounds as places.  Only the kept names,
    ``limit`` at most, come to the driver.
    """
    order = [F.desc("score"), "graph", "seq"]
    low = F.lower("name")
    best = hybrid_ranked(g, query, local, local_weight).withColumn("low", low).withColumn("n", F.row_number().over(Window.partitionBy("low").orderBy(*order))).where("n = 1").drop("n")
    left = best = cut(best)
    kept: list[str] = []
    while len(kept) < limit:
        first = left.orderBy(*order).limit(1).collect()
        if not first:
            break
        name = first[0].low
        kept.append(name)
        left = left.where(~(F.contains("low", F.lit(name)) | F.contains(F.lit(name), F.col("low"))))
    places = F.array_position(F.array(*map(F.lit, kept)) if kept else F.array().cast("array<string>"), F.col("low"))
    return best.where(places > 0).select((places - 1).cast("int").alias("place"), *BRIEF[:2], "id", "name", "type", "source", "score")


def source_breakdown(hits: DataFrame) -> DataFrame:
    """(source, n): how many hits are the project's own and the frameworks', before any limit."""
    return hits.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def detect_frameworks(g: KnowledgeGraph) -> DataFrame:
    """Graphs whose entity names show signs of a framework, with the number of signs."""
    signs = g.entities.sparkSession.createDataFrame([(f, x) for f, xs in FRAMEWORK_SIGNS.items() for x in xs], "framework string, sign string")
    hits = g.entities.select("graph", F.lower("name").alias("low")).distinct().join(F.broadcast(signs), F.contains(F.col("low"), F.lower("sign")))
    return hits.groupBy("graph", "framework").agg(F.count_distinct("sign").alias("signs"), F.count(F.lit(1)).alias("names"))
