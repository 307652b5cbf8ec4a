"""The tools as plain functions over one graph.

Every tool composes the DataFrame operators.  Reports that are the best few of something, or one
row per graph or type, come to the caller as dictionaries; whatever grows with the data is
returned as a DataFrame and never cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import KnowledgeGraph
from graphloom.operators import declarations, documentation, evolution, guidance, lookup, mutate, quality, search, traverse
from graphloom.session import cut
from graphloom.sources import catalogue, external_index, files, gitlog, graph_json


def _rows(df: DataFrame, limit: int) -> list[dict]:
    """The first rows of an ordered report."""
    return [r.asDict(recursive=True) for r in df.limit(limit).collect()]


def _brief(df: DataFrame) -> list[dict]:
    """The rows of a report whose size is that of the graphs, types or formats and not of the data."""
    return [r.asDict(recursive=True) for r in df.collect()]


class GraphTools:
    """One graph and the tools over it; ``local`` names the project among the graphs."""

    def __init__(self, spark: SparkSession, graph: KnowledgeGraph, local: str = "local"):
        self.spark, self.graph, self.local = spark, graph, local

    # -- reading and writing
    @staticmethod
    def _parsed(sources: DataFrame) -> KnowledgeGraph:
        """Facts and hashes are written out, as the files may change under the graph."""
        found = cut(declarations.facts(sources.withColumn("file_id", F.xxhash64("graph", "file_path"))))
        return declarations.to_graph(found, cut(sources.select("graph", "file_path", "hash_value")))

    @classmethod
    def parse_directory(cls, spark: SparkSession, folder: str, patterns: list[str] | None = None, exclude: list[str] | None = None, graph: str = "local", max_kb: int | None = 1024) -> GraphTools:
        """A folder's files as a graph; ``skipped_files`` tells which were too large or left out."""
        return cls(spark, cls._parsed(files.scan(spark, folder, patterns, exclude, max_kb, graph)), graph)

    @classmethod
    def parse_file(cls, spark: SparkSession, path: str, graph: str = "local") -> GraphTools:
        """One file as a graph, whatever its size."""
        return cls(spark, cls._parsed(files.scan(spark, path, ["**"], None, None, graph)), graph)

    def skipped_files(self, folder: str, patterns: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
        return files.skipped_files(self.spark, folder, patterns, exclude, graph=self.local)

    def incremental_parse(self, folder: str, patterns: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
        """Parse new and changed files again, drop what is gone, and tell (graph, file_path, status) of every file."""
        sources = files.scan(self.spark, folder, patterns, exclude, graph=self.local)
        hashes = self.graph.file_hashes if self.graph.file_hashes is not None else sources.select("graph", "file_path", "hash_value").limit(0)
        status = cut(mutate.classify_files(sources, hashes.where(F.col("graph") == self.local)))
        again = sources.join(status.where("status in ('new', 'changed')").select("graph", "file_path"), ["graph", "file_path"], "left_semi")
        fresh = mutate.refresh(self.graph, self._parsed(again), status)
        self.graph = KnowledgeGraph(cut(fresh.entities), cut(fresh.relationships), cut(fresh.file_hashes))
        return status

    def save_graph(self, path: str) -> None:
        """As JSON documents if the path ends in .json, else in the native form."""
        (graph_json.write_json if path.endswith(".json") else graph_json.write_parquet)(self.graph, path)

    @classmethod
    def load_graph(cls, spark: SparkSession, path: str, local: str = "local") -> GraphTools:
        """What ``save_graph`` wrote; a path to .json files written elsewhere gives a graph per file."""
        if not path.endswith(".json"):
            return cls(spark, graph_json.read_parquet(spark, path), local)
        reader = graph_json.read_json if graph_json.is_folder(spark, path) and "*" not in path else graph_json.read_graphs
        return cls(spark, reader(spark, path), local)

    def read_external_graph(self, path: str, mode: str = "replace") -> dict:
        alias = external_index.alias_of(path)
        other, lost = external_index.to_graph(external_index.read_tables(self.spark, path), alias)
        if mode == "replace":
            self.graph = mutate.replace_by_prefix(self.graph, f"comp:{alias}:", other)
        else:
            merged = mutate.upsert_entities(self.graph, other.entities)
            self.graph = KnowledgeGraph(merged.entities, merged.relationships.unionByName(other.relationships), self.graph.file_hashes)
        return {"alias": alias, "entities": other.entities.count(), "relationships": other.relationships.count(), "skipped_edges": lost.count()}

    def get_external_graph_info(self, path: str) -> dict:
        return _rows(external_index.index_info(external_index.read_tables(self.spark, path)), 1)[0]

    # -- lookups
    def search_entities(self, query: str, entity_type: str | None = None, limit: int = 20) -> list[dict]:
        return _rows(lookup.search_entities(self.graph, query, entity_type, limit), limit)

    def get_entity(self, entity_id: str) -> dict:
        found = _rows(lookup.get_entity(self.graph, entity_id), 1)
        return found[0] if found else {"error": f"Entity not found: {entity_id}"}

    def get_related_entities(self, entity_id: str, depth: int = 1) -> DataFrame:
        starts = lookup.get_entity(self.graph, entity_id).select("graph", F.col("id").alias("root"))
        return traverse.neighbours(self.graph, starts, depth)

    def get_graph_stats(self) -> list[dict]:
        return _brief(lookup.graph_stats(self.graph).orderBy("graph", "kind", F.desc("n"), "type"))

    def list_supported_languages(self) -> list[dict]:
        return [{"language": n, "extensions": e} for n, e in lookup.LANGUAGES.items()]

    def get_language_for_file(self, file_path: str) -> dict:
        extension = "." + file_path.lower().rsplit(".", 1)[-1]
        return {"file_path": file_path, "language": next((n for n, e in lookup.LANGUAGES.items() if extension in e), None)}

    def list_frameworks(self, frameworks: DataFrame) -> list[dict]:
        return _brief(lookup.catalogue(self.graph, frameworks))

    def get_framework_info(self, summary_path: str, framework: str) -> dict | None:
        """What the catalogue summary says of a framework."""
        found = _rows(catalogue.framework_info(catalogue.read_summary(self.spark, summary_path), framework), 1)
        return found[0] if found else None

    def search_framework_docs(self, framework: str, query: str, entity_type: str | None = None, limit: int = 20) -> list[dict]:
        return _rows(search.search_graphs(self.graph.only(framework), query, entity_type, limit), limit)

    def search_all_frameworks(self, query: str, entity_type: str | None = None, limit_per_framework: int = 5) -> list[dict]:
        return _brief(search.search_graphs(self.graph, query, entity_type, limit_per_framework))

    def find_code_patterns(self, pattern_name: str, entity_type: str | None = None, limit: int = 20) -> dict:
        return {"examples": _rows(search.pattern_examples(self.graph, pattern_name, entity_type, limit), limit), "counts": _brief(search.similar_patterns(self.graph, pattern_name))}

    def get_framework_entity_context(self, framework: str, entity_id: str, depth: int = 2) -> dict:
        part = GraphTools(self.spark, self.graph.only(framework), framework)
        key = entity_id.strip().lower()
        return {
            "entity": part.get_entity(key), "related": part.get_related_entities(key, depth), "outgoing": _rows(lookup.edges(part.graph, source=key).orderBy("rel_id"), 10),
            "incoming": _rows(lookup.edges(part.graph, target=key).orderBy("rel_id"), 10),
        }

    def semantic_search(self, query: str, entity_types: list[str] | None = None, limit: int = 20) -> list[dict]:
        return _rows(search.semantic_search(self.graph.only(self.local), query, entity_types, limit), limit)

    def framework_semantic_search_tool(self, query: str, limit: int = 50) -> list[dict]:
        return _rows(search.semantic_search(self.graph, query, None, limit), limit)

    def find_by_pattern(self, pattern: str, limit: int = 20) -> list[dict]:
        return _rows(lookup.match_wildcard(self.graph.only(self.local), pattern, limit), limit)

    def framework_find_by_pattern(self, pattern: str, frameworks: list[str] | None = None, limit: int = 50) -> list[dict]:
        return _rows(lookup.match_wildcard(self.graph.only(*frameworks) if frameworks else self.graph, pattern, limit), limit)

    def _resolved(self, name: str) -> DataFrame:
        return lookup.resolve_names(self.graph.only(self.local), [name]).select("graph", "id")

    def _starts(self, name: str) -> DataFrame:
        return self._resolved(name).select("graph", F.col("id").alias("root"))

    def get_code_context(self, entity_name: str, max_related: int = 10) -> list[dict]:
        return _rows(lookup.contexts(self.graph, max_related).join(self._resolved(entity_name), ["graph", "id"], "left_semi").orderBy("category", "place"), 5 * max_related)

    def find_usage_examples(self, entity_name: str, limit: int = 10) -> list[dict]:
        return _rows(lookup.usage_examples(self.graph, limit).join(self._resolved(entity_name), ["graph", "id"], "left_semi").orderBy("place"), limit)

    # -- analysis
    def generate_documentation(self, entity_name: str, form: str = "markdown", include_examples: bool = True) -> list[dict]:
        return _brief(documentation.documentation(self.graph, form, include_examples).join(self._resolved(entity_name), ["graph", "id"], "left_semi"))

    def recommend_code(self, query: str, limit: int = 10, min_relevance: float = 0.3, sources: DataFrame | None = None) -> list[dict]:
        """The best matches, with the source around each if the source files are given."""
        found = search.recommend(self.graph, query, self.local, limit, min_relevance)
        if sources is not None:
            found = found.join(lookup.snippets(KnowledgeGraph(found, self.graph.relationships), sources).select("graph", "id", "snippet"), ["graph", "id"], "left").orderBy(F.desc("score"), "graph", "seq")
        rows = _rows(found, limit)
        return rows or [{"suggestion": f"No match; try one of: {', '.join(query.split()[:3])}"}]

    def hybrid_search(self, query: str, local_weight: float = 0.5, limit: int = 20) -> dict:
        ranked = search.hybrid_ranked(self.graph, query, self.local, local_weight)
        breakdown = {r["source"]: r["n"] for r in _brief(search.source_breakdown(ranked))}
        return {"results": _rows(search.hybrid_search(self.graph, query, self.local, local_weight, limit).orderBy("place"), limit), "source_breakdown": breakdown, "total_count": sum(breakdown.values())}

    def detect_frameworks(self) -> list[dict]:
        return _brief(search.detect_frameworks(self.graph.only(self.local)))

    def analyze_impact(self, entity_name: str, depth: int = 3) -> list[dict]:
        return _brief(traverse.impact(self.graph, self._starts(entity_name), depth))

    def find_critical_paths(self, entity_name: str, limit: int = 10) -> list[dict]:
        return _rows(traverse.critical_paths(self.graph, self._starts(entity_name), limit).orderBy("place"), limit)

    def find_path(self, source: str, target: str, max_depth: int = 10) -> list[dict]:
        pairs = self._resolved(source).select("graph", F.col("id").alias("source")).join(self._resolved(target).select("graph", F.col("id").alias("target")), "graph")
        return _brief(traverse.shortest_paths(self.graph, pairs, max_depth))

    def analyze_quality(self, entity_name: str) -> dict:
        metrics = cut(quality.quality_metrics(self.graph).join(self._resolved(entity_name), ["graph", "id"], "left_semi"))
        told = [r["recommendation"] for r in _brief(quality.recommendations(metrics, self.graph.entities))]
        return {"metrics": _brief(metrics), "recommendations": told or ["No quality issues detected."]}

    def track_evolution(self, repository: str, since: str | None = None, until: str | None = None) -> DataFrame:
        return evolution.recent_commits(gitlog.read_log(self.spark, [repository], since or f"{evolution.DAYS} days ago", until))

    def entity_evolution(self, path: str, entity_name: str, since: str | None = None, until: str | None = None) -> DataFrame:
        """The history of the entity's file in the repository that ``path`` lies in."""
        repository = gitlog.find_repository(path)
        if repository is None:
            raise ValueError(f"{path} lies in no repository")
        part = KnowledgeGraph(self.graph.entities.join(self._resolved(entity_name), ["graph", "id"], "left_semi"), self.graph.relationships)
        return evolution.entity_history(part, gitlog.read_log(self.spark, [repository], since or f"{evolution.DAYS} days ago", until), since="1970-01-01", until=None)

    def find_hotspots(self, repository: str, limit: int = 10) -> list[dict]:
        """The files of the repository that change most; with a graph, those that it knows, under their first entities."""
        log = gitlog.read_log(self.spark, [repository])
        if self.graph is not None:
            return _rows(evolution.graph_hotspots(self.graph.only(self.local), log, limit), limit)
        return _rows(evolution.hotspots(log).where("score > 0").orderBy(F.desc("score"), "file_path"), limit)

    def get_coding_guidance(self, task: str, entity_type: str = "class") -> dict:
        g = self.graph.only(self.local)
        names = _rows(guidance.suggest_names(self.spark.createDataFrame([(task,)], "task string"), entity_type), 1)[0]
        similar = _rows(guidance.similar_entities(g, task, entity_type).orderBy("place"), 10)
        conventions = _brief(guidance.naming_conventions(g).where("chosen"))
        chosen = next((c["convention"] for c in conventions if c["type"] == entity_type), "PascalCase")
        name = names[{"snake_case": "snake_case", "camelCase": "camel_case"}.get(chosen, "pascal_case")]
        directory = _brief(guidance.suggested_directories(g, task, entity_type))
        return {
            "name": name, "names": names, "template": guidance.template(entity_type).replace("{name}", name), "similar": similar, "similar_to": [s["name"] for s in similar[:3]], "conventions": conventions,
            "directory": directory[0]["directory"] if directory else guidance.DIRECTORIES.get(entity_type, "src/"), "imports": _rows(guidance.suggested_imports(g, task, entity_type).orderBy("statement"), 5), "confidence": min(len(similar) / 3, 1.0),
        }

    def detect_patterns(self, limit: int = 20, min_confidence: float = 0.5) -> list[dict]:
        return _rows(quality.pattern_report(self.graph, min_confidence).orderBy(F.desc("confidence"), "graph", "id", "pattern"), limit)

    def check_api_compatibility(self, framework: str, target_version: str) -> dict:
        """scores per graph, and issues as a DataFrame."""
        return {"issues": quality.compatibility(self.graph, framework, target_version), "scores": _brief(quality.compatibility_scores(self.graph, framework, target_version))}

    def navigate_code(self, entity_name: str, direction: str = "both", depth: int = 2, relationship_types: list[str] | None = None, depth_first: bool = False) -> DataFrame:
        if depth_first:
            sides = ["callers", "callees"] if direction == "both" else [direction]
            parts = [traverse.navigate_depth_first(self.graph, self._starts(entity_name), side, depth, relationship_types).withColumn("direction", F.lit(side)) for side in sides]
            return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return traverse.navigate(self.graph, self._starts(entity_name), direction, depth, relationship_types)

    def get_call_graph(self, entity_name: str, depth: int = 3) -> dict[str, DataFrame]:
        nodes, links = traverse.call_graph(self.graph, self._starts(entity_name), depth)
        return {"nodes": nodes, "links": links}

    def validate(self) -> list[dict]:
        return _brief(quality.validation_summary(self.graph))

    def validation_issues(self, check_orphans: bool = True, check_invalid_refs: bool = True, check_duplicates: bool = True) -> DataFrame:
        return quality.validate(self.graph, check_orphans, check_invalid_refs, check_duplicates)

    # -- prompts
    def analyze_codebase(self) -> str:
        return "\n\n".join(f"{r['graph']}\n{r['text']}" for r in _brief(documentation.codebase_overview(self.graph)))

    def explain_entity(self, entity_name: str) -> str:
        return "\n".join(r["text"] for r in self.generate_documentation(entity_name)) or f"Entity not found: {entity_name}"

    def find_dependencies(self, entity_name: str) -> list[dict]:
        return self.get_code_context(entity_name, 15)
