"""Lookups, filters and statistics over a knowledge graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.graph import ENTITY_TYPES, KnowledgeGraph

BRIEF = ["graph", "seq", "id", "name", "type", "file_path", "line"]

# Languages with their file extensions.
LANGUAGES = {
    "Python": [".py"],
    "TypeScript": [".ts", ".tsx"],
    "JavaScript": [".js", ".jsx"],
    "Rust": [".rs"],
    "Go": [".go"],
    "Ruby": [".rb"],
    "Java": [".java"],
    "C#": [".cs"],
    "C++": [".cpp", ".hpp", ".cc", ".hh", ".cxx"],
    "C": [".c", ".h"],
    "Objective-C": [".m", ".mm"],
    "PHP": [".php"],
    "Swift": [".swift"],
    "Kotlin": [".kt", ".kts"],
    "Scala": [".scala"],
    "Lua": [".lua"],
    "Haskell": [".hs"],
    "Elixir": [".ex", ".exs"],
    "Julia": [".jl"],
    "SQL": [".sql"],
    "Groovy": [".groovy"],
    "Dart": [".dart"],
    "Zig": [".zig"],
    "YAML": [".yaml", ".yml"],
}


def search_entities(g: KnowledgeGraph, query: str, entity_type: str | None = None, limit: int = 20) -> DataFrame:
    """Names that contain the query, in order of insertion; an unknown type filters nothing."""
    found = g.entities.where(text.has(F.col("name"), query))
    if entity_type in ENTITY_TYPES:
        found = found.where(F.col("type") == entity_type)
    return found.select(*BRIEF).orderBy("graph", "seq").limit(limit)


def get_entity(g: KnowledgeGraph, entity_id: str) -> DataFrame:
    return g.entities.where(F.col("id") == entity_id.strip().lower())


def by_type(g: KnowledgeGraph, entity_type: str) -> DataFrame:
    return g.entities.where(F.col("type") == entity_type).select(*BRIEF)


def by_name(g: KnowledgeGraph, name: str) -> DataFrame:
    return g.entities.where(F.col("name") == name).select(*BRIEF)


def edges(g: KnowledgeGraph, source: str | None = None, target: str | None = None, kind: str | None = None) -> DataFrame:
    """Edges by any of source, target and type."""
    out = g.relationships
    for column, value in (("source_id", source), ("target_id", target), ("type", kind)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def match_wildcard(g: KnowledgeGraph, pattern: str, limit: int = 20) -> DataFrame:
    """Names by a wildcard pattern, anchored and case-insensitive; other regex characters stay live."""
    regex = "(?i)^" + pattern.replace("*", ".*") + "$"
    return g.entities.where(F.col("name").rlike(regex)).select(*BRIEF).orderBy("graph", "seq").limit(limit)


def resolve_names(g: KnowledgeGraph, names: list[str]) -> DataFrame:
    """Per graph and name the entity it stands for: an exact match (case ignored) before one that contains it, then by insertion."""
    wanted = g.entities.sparkSession.createDataFrame([(n.lower(),) for n in names], "wanted string")
    n = F.lower("name")
    hits = g.entities.join(F.broadcast(wanted), F.contains(n, F.col("wanted")))
    first = F.min_by(F.struct("id", "name", "type", "seq"), F.struct((n != F.col("wanted")).alias("partial"), "seq"))
    return hits.groupBy("graph", "wanted").agg(first.alias("e")).select("graph", "wanted", "e.*")


def language_of(path: Column) -> Column:
    """The language of a path by its extension, null for an unknown one."""
    known = F.create_map(*[F.lit(x) for n, es in LANGUAGES.items() for e in es for x in (e, n)])
    return F.try_element_at(known, text.extension(path))


def languages_of_files(g: KnowledgeGraph) -> DataFrame:
    """Entities per language of their file, by its extension."""
    known = g.entities.sparkSession.createDataFrame([(e, n) for n, es in LANGUAGES.items() for e in es], "extension string, language string")
    return (
        g.entities.withColumn("extension", text.extension(F.col("file_path")))
        .join(F.broadcast(known), "extension", "left")
        .groupBy("extension", "language")
        .agg(F.count(F.lit(1)).alias("entities"), F.count_distinct("graph", "file_path").alias("files"))
    )


def graph_stats(g: KnowledgeGraph) -> DataFrame:
    """Counts per graph, kind and type in one long table; tracked files are a kind of their own."""
    nodes = g.entities.groupBy("graph", "type").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("entity"))
    links = g.relationships.groupBy("graph", "type").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("relationship"))
    out = nodes.unionByName(links)
    if g.file_hashes is not None:
        out = out.unionByName(g.file_hashes.groupBy("graph").agg(F.count(F.lit(1)).alias("n")).select("graph", F.lit("tracked").alias("type"), "n", F.lit("file").alias("kind")))
    return out.select("graph", "kind", "type", "n")


def catalogue(g: KnowledgeGraph, frameworks: DataFrame) -> DataFrame:
    """Each framework with its trimmed name, language, pattern count and entity counts; unknown graphs included."""
    counts = g.entities.groupBy("graph").agg(
        F.count(F.lit(1)).alias("entities"), *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in ("module", "class", "function", "method")]
    )
    known = frameworks.select("graph", F.trim("display_name").alias("display_name"), "language", F.coalesce(F.size("patterns"), F.lit(0)).alias("n_patterns"))
    return counts.join(known, "graph", "full_outer").na.fill(0, ["entities", "n_module", "n_class", "n_function", "n_method"])


def usage_counts(g: KnowledgeGraph) -> DataFrame:
    """(graph, id, usage): how many calls lead to each id."""
    return g.relationships.where("type = 'calls' and target_id is not null").groupBy("graph", F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("usage"))


def degrees(g: KnowledgeGraph) -> DataFrame:
    """(graph, id, afferent, efferent, calls, loops) of every end of an edge, parallel edges counted, in one pass."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    out = F.struct(F.col("source_id").alias("id"), F.lit(0).alias("into"), one(F.col("type") == "calls").alias("calls"), one(F.col("source_id") == F.col("target_id")).alias("loops"))
    into = F.struct(F.col("target_id").alias("id"), F.lit(1).alias("into"), F.lit(0).alias("calls"), F.lit(0).alias("loops"))
    ends = g.relationships.select("graph", F.explode(F.array(out, into)).alias("x")).select("graph", "x.*").where("id is not null")
    return ends.groupBy("graph", "id").agg(F.sum("into").alias("afferent"), F.sum(1 - F.col("into")).alias("efferent"), F.sum("calls").alias("calls"), F.sum("loops").alias("loops"))


def coupling(g: KnowledgeGraph) -> DataFrame:
    """(graph, id, afferent, efferent): edges into and out of each entity, parallel ones counted."""
    counted = degrees(g).select("graph", "id", "afferent", "efferent")
    return g.entities.select("graph", "id", "name", "type").join(counted, ["graph", "id"], "left").na.fill(0, ["afferent", "efferent"])


def contexts(g: KnowledgeGraph, max_related: int = 10) -> DataFrame:
    """The context of every entity: per category its first related entities in order of insertion.

    Categories: calls, called_by, imports, contains, contained_in.  The cap comes before the
    lookup, so a dangling end is kept with a null name.
    """
    outgoing = g.relationships.where("type in ('calls', 'imports', 'contains')").select("graph", F.col("source_id").alias("id"), F.col("type").alias("category"), F.col("target_id").alias("other"), "rel_id")
    incoming = g.relationships.where("type in ('calls', 'contains')").select(
        "graph", F.col("target_id").alias("id"), F.when(F.col("type") == "calls", "called_by").otherwise("contained_in").alias("category"), F.col("source_id").alias("other"), "rel_id"
    )
    related = outgoing.unionByName(incoming).where("id is not null")
    first = related.withColumn("place", F.row_number().over(Window.partitionBy("graph", "id", "category").orderBy("rel_id"))).where(F.col("place") <= max_related)
    ends = g.entities.select("graph", F.col("id").alias("other"), F.col("name").alias("other_name"), F.col("type").alias("other_type"))
    return first.join(g.entities.select("graph", "id"), ["graph", "id"], "left_semi").join(ends, ["graph", "other"], "left").select("graph", "id", "category", "place", "other", "other_name", "other_type")


def entity_edges(g: KnowledgeGraph, starts: DataFrame, most: int = 10) -> DataFrame:
    """(graph, root, direction, place, other, other_name, type): the first edges out of and into each start, in order of insertion."""
    ends = F.array(F.struct(F.col("source_id").alias("root"), F.col("target_id").alias("other"), F.lit("outgoing").alias("direction")), F.struct(F.col("target_id").alias("root"), F.col("source_id").alias("other"), F.lit("incoming").alias("direction")))
    rows = g.relationships.select("graph", "rel_id", "type", F.explode(ends).alias("x")).select("graph", "rel_id", "type", "x.*").join(starts.select("graph", "root").distinct(), ["graph", "root"], "left_semi")
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("graph", "root", "direction").orderBy("rel_id"))).where(F.col("place") <= most)
    names = g.entities.select("graph", F.col("id").alias("other"), F.col("name").alias("other_name"))
    return first.join(names, ["graph", "other"], "left").select("graph", "root", "direction", "place", "other", "other_name", "type")


def usage_examples(g: KnowledgeGraph, limit: int = 5) -> DataFrame:
    """Per called entity its first callers; the cap comes before dangling callers drop out."""
    calls = g.relationships.where("type = 'calls' and target_id is not null").withColumn("place", F.row_number().over(Window.partitionBy("graph", "target_id").orderBy("rel_id"))).where(F.col("place") <= limit)
    callers = g.entities.select("graph", F.col("id").alias("source_id"), F.col("name").alias("caller"), "file_path", "line")
    return calls.join(callers, ["graph", "source_id"]).select("graph", F.col("target_id").alias("id"), "place", "caller", "file_path", "line")


def relation_label(g: KnowledgeGraph, pairs: DataFrame) -> DataFrame:
    """(graph, a, b, label) for given pairs: as ``pair_labels``, seen from a, and ``related`` without any edge."""
    flipped = F.when(F.startswith("label", F.lit("inverse_")), F.substring("label", 9, 1_000)).otherwise(F.concat(F.lit("inverse_"), "label"))
    known = pair_labels(g)
    both = known.unionByName(known.where("a <> b").select("graph", F.col("b").alias("a"), F.col("a").alias("b"), flipped.alias("label")))
    return pairs.select("graph", "a", "b").join(both, ["graph", "a", "b"], "left").na.fill("related", ["label"])


def relation_totals(g: KnowledgeGraph) -> DataFrame:
    """(kind, type, n) over all graphs, with a total per kind where type is null."""
    kinds = g.entities.select(F.lit("entity").alias("kind"), "type").unionByName(g.relationships.select(F.lit("relationship").alias("kind"), "type"))
    counted = kinds.na.fill("", ["type"]).groupBy("kind", "type").agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(counted.groupBy("kind").agg(F.sum("n").alias("n")).select("kind", F.lit(None).cast("string").alias("type"), "n"))


def pair_labels(g: KnowledgeGraph) -> DataFrame:
    """(graph, a, b, label) for each unordered pair: the type of its first edge, inverse_ where it runs from b to a."""
    e = g.relationships.where("source_id is not null and target_id is not null and type is not null")
    label = F.when(F.col("source_id") <= F.col("target_id"), F.col("type")).otherwise(F.concat(F.lit("inverse_"), F.col("type")))
    return e.groupBy("graph", F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.min_by(label, "rel_id").alias("label"))


def signatures(g: KnowledgeGraph) -> DataFrame:
    """name(p: T, ...) -> R of functions and methods, from their stored parameters."""
    extra = F.from_json("extra_data", "parameters array<array<string>>, return_type string, is_async boolean")
    parameter = lambda p: F.concat(F.get(p, F.lit(0)), F.when(F.get(p, F.lit(1)).isNotNull(), F.concat(F.lit(": "), F.get(p, F.lit(1)))).otherwise(""))
    return (
        g.entities.where("type in ('function', 'method')")
        .withColumn("x", extra)
        .where("x.parameters is not null")
        .select("graph", "id", F.concat("name", F.lit("("), F.array_join(F.transform("x.parameters", parameter), ", "), F.lit(")"), F.when(F.col("x.return_type").isNotNull(), F.concat(F.lit(" -> "), F.col("x.return_type"))).otherwise("")).alias("signature"))
    )


def source_lines(spans: DataFrame, files: DataFrame, before: int, after: int) -> DataFrame:
    """(graph, id, file_path, line, snippet): the lines from ``before`` above to ``after`` below the line of each span.

    Each file is cut into lines once; every span asks for its lines by number, and lines beyond
    the file are left out.  Of several texts of a file the latest counts.
    """
    latest = files.where("source_text is not null and graph is not null and file_path is not null").groupBy("graph", "file_path").agg(F.max_by("source_text", F.struct("updated_at", "file_id")).alias("source_text"))
    lines = latest.select("graph", "file_path", F.posexplode(F.split("source_text", "\n")).alias("at", "content")).withColumn("at", F.col("at") + 1)
    wanted = spans.where("line >= 1").select("graph", "file_path", "id", "line", F.explode(F.sequence(F.greatest(F.col("line") - before, F.lit(1)), F.col("line") + after)).alias("at"))
    rows = wanted.join(lines, ["graph", "file_path", "at"]).groupBy("graph", "file_path", "id", "line").agg(F.array_sort(F.collect_list(F.struct("at", "content"))).alias("rows"))
    return rows.select("graph", "id", "file_path", "line", F.array_join(F.transform("rows", lambda r: r["content"]), "\n").alias("snippet"))


def snippets(g: KnowledgeGraph, files: DataFrame, context: int = 5) -> DataFrame:
    """The source lines around each entity whose file is among the source files."""
    return source_lines(g.entities, files, context, context)


def source_blocks(g: KnowledgeGraph, files: DataFrame, context: int = 10) -> DataFrame:
    """The source of each entity from its line on, ``context`` and 20 lines of it."""
    return source_lines(g.entities, files, 0, context + 19)
