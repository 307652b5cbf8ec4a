"""All registered queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.graph import KnowledgeGraph
from graphloom.operators import search, traverse
from graphloom.plans import analysis_queries, core_problems, graph_queries, lifecycle_queries

_MODULES = [core_problems, graph_queries, analysis_queries, lifecycle_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked hits with the impact that a change of each would have."""
    g = KnowledgeGraph.current(spark, sf_dir)
    hits = search.semantic_search(g, "load queue", limit=20)
    risks = traverse.impact(g, hits.select("graph", hits["id"].alias("root")), 3).withColumnRenamed("score", "impact_score").withColumnRenamed("root", "id")
    return hits.join(risks, ["graph", "id"])
