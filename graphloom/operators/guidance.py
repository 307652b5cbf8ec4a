"""Coding guidance from what a graph already holds: naming, folders, imports, similar entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.graph import KnowledgeGraph

# Words of a task that do not go into a name.
STOP_WORDS = ["a", "an", "the", "to", "for", "of", "in", "on", "with", "new", "create"]

# Conventions in order of preference.
CONVENTIONS = ["snake_case", "camelCase", "PascalCase"]


# Folders where nothing similar tells one.
DIRECTORIES = {"class": "src/services/", "function": "src/utils/", "method": "src/", "module": "src/"}

# What a new entity begins as.
TEMPLATES = {
    "class": '''class {name}:
    """Description of the class."""

    def __init__(self):
        """Initialize the instance."""
        pass

    def execute(self):
        """Main method."""
        pass''',
    "function": '''def {name}():
    """Description of the function.

    Returns:
        Result description.
    """
    pass''',
    "method": '''def {name}(self):
    """Description of the method.

    Returns:
        Result description.
    """
    pass''',
    "module": '''"""Module description."""

# Module code here''',
}


def template(entity_type: str) -> str:
    return TEMPLATES.get(entity_type, TEMPLATES["module"])


def convention_of(name) -> F.Column:
    """snake_case, camelCase or PascalCase of a name; null for any other."""
    low, under = F.lower(name) == name, F.contains(name, F.lit("_"))
    return F.when(under & low & (F.upper(name) != name), "snake_case").when(name.rlike("^[A-Z]") & ~under, "PascalCase").when(name.rlike("^[a-z]") & ~under & ~low, "camelCase")


def naming_conventions(g: KnowledgeGraph) -> DataFrame:
    """(graph, type, convention, n, chosen): how names are formed, and the most frequent way."""
    counts = g.entities.withColumn("convention", convention_of(F.col("name"))).where("convention is not null").groupBy("graph", "type", "convention").agg(F.count(F.lit(1)).alias("n"))
    ordinal = F.array_position(F.array(*map(F.lit, CONVENTIONS)), F.col("convention"))
    w = Window.partitionBy("graph", "type").orderBy(F.desc("n"), ordinal)
    return counts.withColumn("chosen", F.row_number().over(w) == 1)


def similar_entities(g: KnowledgeGraph, task: str, entity_type: str = "class", per_graph: int = 10) -> DataFrame:
    """Per graph the first entities of the type that share a word with the task; names count 2, documentation 1.

    They stay in order of insertion; the score only decides whether they belong.
    """
    score = F.lit(0)
    for w in text.query_words(task):
        score = score + F.when(text.has(F.col("name"), w), 2).otherwise(0) + F.when(text.truthy(F.col("docstring")) & text.has(F.col("docstring"), w), 1).otherwise(0)
    found = g.entities.where(F.col("type") == entity_type).withColumn("score", score).where("score > 0")
    first = found.withColumn("place", F.row_number().over(Window.partitionBy("graph").orderBy("seq"))).where(F.col("place") <= per_graph)
    return first.select("graph", "place", "id", "name", "file_path", "score", "seq")


def suggested_directories(g: KnowledgeGraph, task: str, entity_type: str = "class") -> DataFrame:
    """Per graph the folder that most of the similar entities lie in; the first seen among equals."""
    by = similar_entities(g, task, entity_type).withColumn("directory", text.directory(F.col("file_path"))).where("directory <> ''")
    counts = by.groupBy("graph", "directory").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    return counts.groupBy("graph").agg(F.max_by(F.struct("directory", "n"), F.struct("n", (-F.col("first_seq")).alias("r"))).alias("b")).select("graph", "b.directory", "b.n")


def suggested_imports(g: KnowledgeGraph, task: str, entity_type: str = "module") -> DataFrame:
    """What the first five similar entities of each graph import: entities by file and name, else the module itself."""
    near = similar_entities(g, task, entity_type, 5).select("graph", F.col("id").alias("source_id"))
    targets = g.entities.select("graph", F.col("id").alias("target_id"), "name", "file_path")
    used = g.relationships.where("type = 'imports' and target_id is not null").join(near, ["graph", "source_id"]).join(targets, ["graph", "target_id"], "left")
    inside = F.concat(F.lit("from "), F.replace(F.replace("file_path", F.lit("/"), F.lit(".")), F.lit(".py"), F.lit("")), F.lit(" import "), "name")
    outside = F.concat(F.lit("import "), F.regexp_replace("target_id", "^(?:external:|ext_)", ""))
    return used.select("graph", F.coalesce(inside, outside).alias("statement")).distinct()


def suggest_names(tasks: DataFrame, entity_type: str = "class") -> DataFrame:
    """(task, snake_case, camelCase, PascalCase): names from the first three words of a task that mean something, else ``New`` and the type."""
    words = F.slice(F.filter(F.split(F.trim("task"), r"\s+"), lambda w: (w != "") & ~F.lower(w).isin(*STOP_WORDS)), 1, 3)
    t = tasks.withColumn("w", words).withColumn("w", F.when(F.size("w") > 0, F.col("w")).otherwise(F.array(F.lit("New"), F.lit(entity_type.capitalize()))))
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))
    return t.select(
        "task",
        F.array_join(F.transform("w", F.lower), "_").alias("snake_case"),
        F.concat(F.lower(F.get("w", F.lit(0))), F.array_join(F.transform(F.slice("w", 2, 2), capital), "")).alias("camel_case"),
        F.array_join(F.transform("w", capital), "").alias("pascal_case"),
    )
