"""Quality metrics, design patterns, compatibility and validation, for all entities at once."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.graph import KnowledgeGraph
from graphloom.operators.lookup import degrees
from graphloom.session import cut

# Words whose occurrences in the documentation raise the complexity.
BRANCH_WORDS = ["if", "else", "elif", "for", "while", "try", "except", "case", "switch"]

# Metric, bound of good, bound of warning.
THRESHOLDS = {
    "cyclomatic_complexity": (10.0, 20.0),
    "afferent_coupling": (10.0, 20.0),
    "efferent_coupling": (10.0, 15.0),
    "lcom": (0.3, 0.7),
    "method_lines": (30.0, 50.0),
    "parameter_count": (4.0, 7.0),
}

# Design pattern, category, indicators.
PATTERNS = [
    ("Singleton", "creational", ["_instance", "get_instance", "getInstance", "__new__"]),
    ("Factory Method", "creational", ["create_", "make_", "build_", "Factory"]),
    ("Builder", "creational", ["with_", "set_", "build", "Builder"]),
    ("Adapter", "structural", ["Adapter", "Wrapper", "adapt"]),
    ("Decorator", "structural", ["Decorator", "Wrapper", "@"]),
    ("Facade", "structural", ["Facade", "Manager", "Service"]),
    ("Observer", "behavioral", ["subscribe", "notify", "Observer", "Listener", "on_"]),
    ("Strategy", "behavioral", ["Strategy", "execute", "algorithm", "Policy"]),
    ("Command", "behavioral", ["Command", "execute", "undo", "Handler"]),
    ("Template Method", "behavioral", ["_do_", "hook_", "Template", "abstract"]),
]

# What a design pattern is for.
PATTERN_DESCRIPTIONS = {
    "Singleton": "Ensures a class has only one instance",
    "Factory Method": "Defines interface for creating objects",
    "Builder": "Separates construction of complex objects",
    "Adapter": "Converts interface of a class to another",
    "Decorator": "Attaches additional responsibilities dynamically",
    "Facade": "Provides unified interface to subsystems",
    "Observer": "Defines one-to-many dependency between objects",
    "Strategy": "Defines family of interchangeable algorithms",
    "Command": "Encapsulates request as an object",
    "Template Method": "Defines skeleton algorithm with customizable steps",
}

# What to consider where a design pattern is found.
PATTERN_SUGGESTIONS = {
    "Singleton": "Consider using dependency injection instead of Singleton for testability",
    "Factory Method": "Ensure factory method is properly abstracted for extensibility",
    "Observer": "Consider weak references to prevent memory leaks",
    "Strategy": "Ensure strategies are interchangeable at runtime",
}

# Metrics by their titles.
METRIC_TITLES = {
    "average_complexity": "Average Cyclomatic Complexity",
    "cyclomatic_complexity": "Cyclomatic Complexity",
    "afferent_coupling": "Afferent Coupling",
    "efferent_coupling": "Efferent Coupling",
    "lcom": "LCOM (Cohesion)",
    "method_lines": "Method Lines",
    "parameter_count": "Parameter Count",
}

# Framework, version from which it holds, API, kind of issue, hint.
KNOWN_ISSUES = [
    ("django", "4.0", "url", "removed", "Use path() instead of url()"),
    ("django", "4.0", "ugettext", "deprecated", "Use gettext instead"),
    ("django", "4.2", "default_app_config", "deprecated", "Remove default_app_config from __init__.py"),
    ("fastapi", "0.100", "on_event", "deprecated", "Use lifespan context manager instead"),
    ("react", "18.0", "componentWillMount", "removed", "Use useEffect hook instead"),
    ("react", "18.0", "componentWillReceiveProps", "removed", "Use getDerivedStateFromProps"),
    ("flask", "2.0", "before_first_request", "deprecated", "Use app context or flask-caching"),
]


def _branches(doc: Column) -> Column:
    low = F.lower(F.coalesce(doc, F.lit("")))
    return sum((F.regexp_count(low, F.lit(w)) for w in BRANCH_WORDS), F.lit(0))


def _complexity(calls: Column, doc: Column) -> Column:
    return F.least(F.lit(50), 1 + F.floor(F.coalesce(calls, F.lit(0)) / 3) + _branches(doc)).cast("long")


def complexities(g: KnowledgeGraph) -> DataFrame:
    """(graph, id, type, complexity): 1, a third of the calls made, branch words in the documentation; 50 at most."""
    e = g.entities.join(degrees(g).select("graph", "id", "calls"), ["graph", "id"], "left")
    return e.select("graph", "id", "type", _complexity(F.col("calls"), F.col("docstring")).alias("complexity"))


#: Pairs of classes at shared targets that a container may have before they are counted in blocks, and classes per block.
PAIR_ROWS, BLOCK = 1_000_000, 512


def _count_pairs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The weight of all pairs between two blocks of classes, or within one, that share a target."""
    graph, container, low, high = key
    slots, weight = {}, {}
    for side in {low, high}:
        part = rows[rows["block"] == side].drop_duplicates("slot")
        slots[side] = {s: i for i, s in enumerate(part["slot"])}
        weight[side] = part["m"].to_numpy(np.int64)
    meet = np.zeros((len(slots[low]), len(slots[high])), bool)
    for _, at in rows.groupby("target"):
        sides = {side: [slots[side][s] for s in at.loc[at["block"] == side, "slot"]] for side in (low, high)}
        meet[np.ix_(sides[low], sides[high])] = True
    if low == high:
        meet = np.triu(meet, 1)
    return pd.DataFrame({"graph": [graph], "id": [container], "pairs": [int(weight[low] @ meet @ weight[high])]})


def _sharing_pairs(children: DataFrame, edges: DataFrame, pair_rows: int) -> DataFrame:
    """(graph, id, sharing): pairs of children with a common target, by container.

    Only targets that two children of a container have matter.  Children with the same set of
    those form a class, and a pair of classes counts for as many pairs as they hold.  Classes
    meet by a join on the target; in containers where that would give more than ``pair_rows``
    rows they are cut into blocks, and each pair of blocks gives one number.
    """
    uses = children.join(edges.select("graph", F.col("source_id").alias("child"), F.col("target_id").alias("target")), ["graph", "child"]).select("graph", "id", "slot", "target")
    fan = Window.partitionBy("graph", "id", "target")
    shared = cut(uses.repartition("graph", "id", "target").distinct().withColumn("n", F.count(F.lit(1)).over(fan)).where("n > 1").drop("n"))
    # A set of targets by its size and two sums over hashes of its members.
    sets = shared.groupBy("graph", "id", "slot").agg(F.struct(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("target")).alias("x"), F.sum(F.hash("target").cast("long")).alias("h")).alias("set"))
    classes = cut(sets.groupBy("graph", "id", "set").agg(F.count(F.lit(1)).alias("m"), F.min("slot").alias("slot")).drop("set"))
    within = classes.select("graph", "id", (F.col("m") * (F.col("m") - 1) / 2).cast("long").alias("pairs"))
    uses = cut(shared.join(classes, ["graph", "id", "slot"]))
    large = cut(uses.groupBy("graph", "id", "target").agg(F.count(F.lit(1)).alias("n")).groupBy("graph", "id").agg(F.sum(F.col("n") * F.col("n")).alias("rows")).where(F.col("rows") > pair_rows).select("graph", "id"))
    has_large = not large.isEmpty()
    small = uses.join(large, ["graph", "id"], "left_anti") if has_large else uses
    other = small.select("graph", "id", "target", F.col("slot").alias("slot2"), F.col("m").alias("m2"))
    across = small.join(other, ["graph", "id", "target"]).where("slot < slot2").groupBy("graph", "id", "slot", "slot2").agg(F.max(F.col("m") * F.col("m2")).alias("pairs")).select("graph", "id", "pairs")
    if has_large:
        blocks = uses.groupBy("graph", "id").agg(F.ceil(F.count_distinct("slot") / BLOCK).cast("int").alias("blocks"))
        rows = uses.join(blocks.join(large, ["graph", "id"], "left_semi"), ["graph", "id"]).withColumn("block", F.pmod(F.xxhash64("slot"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with"))
        across = across.unionByName(rows.groupBy("graph", "id", "low", "high").applyInPandas(_count_pairs, "graph string, id string, pairs long"))
    return within.unionByName(across).groupBy("graph", "id").agg(F.sum("pairs").alias("sharing"))


def _containers(g: KnowledgeGraph, complexity: DataFrame | None, pair_rows: int) -> DataFrame:
    """As ``cohesion``, with mean, the mean complexity of the methods among the children, if their complexity is given."""
    edges = g.relationships.where("source_id is not null and target_id is not null")
    children = edges.where("type = 'contains'").select("graph", F.col("source_id").alias("id"), F.col("target_id").alias("child"), F.col("rel_id").alias("slot"))
    own = complexity.where("type = 'method'").select("graph", F.col("id").alias("child"), "complexity") if complexity is not None else None
    known = children.join(own, ["graph", "child"], "left") if own is not None else children.withColumn("complexity", F.lit(None).cast("long"))
    counted = known.groupBy("graph", "id").agg(F.count(F.lit(1)).alias("children"), F.avg(F.col("complexity").cast("double")).alias("mean"))
    counted = counted.join(_sharing_pairs(children, edges, pair_rows), ["graph", "id"], "left").na.fill(0, ["sharing"])
    pairs = (F.col("children") * (F.col("children") - 1) / 2).cast("double")
    return counted.select("graph", "id", "children", "sharing", F.when(F.col("children") <= 1, 0.0).otherwise(1.0 - F.col("sharing") / pairs).alias("lcom"), "mean")


def cohesion(g: KnowledgeGraph, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """(graph, id, children, sharing, lcom) of every container: the share of child pairs without a common target.

    Containers of one child have lcom 0.
    """
    return _containers(g, None, pair_rows).drop("mean")


def _status(metric: Column, value: Column) -> Column:
    out = F.when(metric.isNull(), "danger")
    for name, (good, warning) in THRESHOLDS.items():
        out = out.when((metric == name) & (value <= good), "good").when((metric == name) & (value <= warning), "warning")
    return out.otherwise("danger")


def parameter_count(doc: Column) -> Column:
    """Lines with a colon in the Args section; 2 without such a section."""
    section = F.split(F.get(F.split(doc, "Args:"), F.lit(1)), "\n\n")[0]
    lines = F.size(F.filter(F.split(section, "\n"), lambda x: (F.trim(x) != "") & F.contains(x, F.lit(":"))))
    return F.when(F.contains(doc, F.lit("Args:")), lines).otherwise(2)


def quality_metrics(g: KnowledgeGraph) -> DataFrame:
    """(graph, id, metric, value, status): complexity and cohesion of classes and modules, complexity, lines and parameters of functions and methods, coupling of all.

    The edges are counted once; what is known of an entity comes together in one row and is
    taken apart into metrics at the end.
    """
    counted = degrees(g)
    base = g.entities.join(counted, ["graph", "id"], "left").na.fill(0, ["afferent", "efferent"])
    base = cut(base.select("graph", "id", "type", _complexity(F.col("calls"), F.col("docstring")).alias("complexity"), F.coalesce(parameter_count(F.col("docstring")), F.lit(2)).alias("parameters"), "afferent", "efferent"))
    rows = base.join(_containers(g, base, PAIR_ROWS), ["graph", "id"], "left")
    metric = lambda name, value: F.struct(F.lit(name).alias("metric"), F.coalesce(value.cast("double"), F.lit(0.0)).alias("value"))
    container, callable_ = F.col("type").isin("class", "module"), F.col("type").isin("function", "method")
    metrics = F.array_compact(
        F.array(
            F.when(container, metric("cyclomatic_complexity", F.col("mean"))),
            F.when(container, metric("lcom", F.col("lcom"))),
            F.when(callable_, metric("cyclomatic_complexity", F.col("complexity"))),
            F.when(callable_, metric("method_lines", F.when(F.col("type") == "method", 15).otherwise(20))),
            F.when(callable_, metric("parameter_count", F.col("parameters"))),
            metric("afferent_coupling", F.col("afferent")),
            metric("efferent_coupling", F.col("efferent")),
        )
    )
    found = rows.select("graph", "id", "type", F.explode(metrics).alias("m")).select("graph", "id", "type", "m.metric", "m.value")
    return found.select("graph", "id", "metric", "value", _status(F.col("metric"), F.col("value")).alias("status"))


def recommendations(metrics: DataFrame, entities: DataFrame) -> DataFrame:
    """(graph, id, metric, recommendation) for the metrics in warning or danger, from ``quality_metrics``."""
    key = F.when((F.col("metric") == "cyclomatic_complexity") & F.col("type").isin("class", "module"), "average_complexity").otherwise(F.col("metric"))
    title = F.create_map(*[F.lit(x) for pair in METRIC_TITLES.items() for x in pair])[key]
    rows = metrics.where("status <> 'good'").join(entities.select("graph", "id", "type"), ["graph", "id"])
    number = F.bround("value", 2).cast("string")
    critical = F.concat(F.lit("CRITICAL: "), title, F.lit(" ("), number, F.lit(") exceeds danger threshold. Consider refactoring to reduce "), F.lower(title), F.lit("."))
    warning = F.concat(F.lit("WARNING: "), title, F.lit(" ("), number, F.lit(") is above optimal. Consider reviewing and optimizing."))
    return rows.select("graph", "id", "metric", F.when(F.col("status") == "danger", critical).otherwise(warning).alias("recommendation"))


def quality_scores(g: KnowledgeGraph) -> DataFrame:
    """(graph, id, score, overall): the mean of 100, 60 and 20 for good, warning and danger."""
    points = F.when(F.col("status") == "good", 100.0).when(F.col("status") == "warning", 60.0).otherwise(20.0)
    by = quality_metrics(g).groupBy("graph", "id").agg(F.avg(points).alias("score"))
    return by.withColumn("overall", F.when(F.col("score") >= 70, "good").when(F.col("score") >= 50, "warning").otherwise("danger"))


def detect_patterns(g: KnowledgeGraph, min_confidence: float = 0.4) -> DataFrame:
    """(graph, id, name, pattern, category, confidence): names count 2 per indicator, documentation 1, and the shape of the edges a little."""
    e = g.entities.where("type in ('class', 'function', 'method')").join(degrees(g).select("graph", "id", "afferent", "efferent", "loops"), ["graph", "id"], "left")
    name, doc = F.lower("name"), F.lower(F.coalesce("docstring", F.lit("")))
    rows = []
    for pattern, category, indicators in PATTERNS:
        hits = sum((F.contains(name, F.lit(x.lower())).cast("int") * 2 + F.contains(doc, F.lit(x.lower())).cast("int") for x in indicators), F.lit(0))
        bonus = {"Singleton": F.coalesce("loops", F.lit(0)).cast("double"), "Observer": F.when(F.col("afferent") > 3, 0.5).otherwise(0.0), "Facade": F.when(F.col("efferent") > 5, 0.5).otherwise(0.0)}.get(pattern, F.lit(0.0))
        rows.append(F.struct(F.lit(pattern).alias("pattern"), F.lit(category).alias("category"), F.when(hits > 0, hits + bonus).otherwise(0.0).alias("score")))
    scored = e.select("graph", "id", "name", F.explode(F.array(*rows)).alias("p")).select("graph", "id", "name", "p.*").where("score >= 2")
    return scored.withColumn("confidence", F.bround(F.least(F.col("score") / 5, F.lit(1.0)), 2)).where(F.col("confidence") >= min_confidence).drop("score")


def pattern_report(g: KnowledgeGraph, min_confidence: float = 0.4) -> DataFrame:
    """As ``detect_patterns``, with what the pattern is for and what to consider (null for most)."""
    lit = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col("pattern")]
    return detect_patterns(g, min_confidence).withColumn("description", lit(PATTERN_DESCRIPTIONS)).withColumn("suggestion", lit(PATTERN_SUGGESTIONS))


def pattern_coverage(g: KnowledgeGraph) -> DataFrame:
    """Per graph the share of distinct matched names in its entities."""
    matched = detect_patterns(g).groupBy("graph").agg(F.count_distinct("name").alias("matched"))
    return g.entities.groupBy("graph").agg(F.count(F.lit(1)).alias("entities")).join(matched, "graph", "left").na.fill(0, ["matched"]).withColumn("coverage", F.col("matched") / F.col("entities"))


def compatibility(g: KnowledgeGraph, framework: str, target_version: str, known_issues: list[tuple] = KNOWN_ISSUES) -> DataFrame:
    """(graph, id, api, issue, hint, place): uses of an API with a known issue in a name, in documentation or in an import.

    The list of known issues is a parameter; it is a literal table and therefore broadcast.
    """
    spark = g.entities.sparkSession
    known = spark.createDataFrame([x for x in known_issues if x[0] == framework], "framework string, version string, api string, issue string, hint string")
    known = F.broadcast(known.where(text.version_order(F.lit(target_version), F.col("version")) >= 0).select(F.lower("api").alias("low"), "api", "issue", "hint"))
    named = g.entities.join(known, F.contains(F.lower("name"), F.col("low"))).select("graph", "id", "api", "issue", "hint", F.lit("name").alias("place"))
    told = g.entities.join(known, F.contains(F.lower("docstring"), F.col("low"))).select("graph", "id", "api", "issue", "hint", F.lit("documentation").alias("place"))
    targets = g.entities.join(known, F.contains(F.lower("name"), F.col("low"))).select("graph", F.col("id").alias("target_id"), "api", "issue", "hint")
    sources = g.entities.select("graph", F.col("id").alias("source_id"))
    imported = g.relationships.where("type = 'imports'").join(targets, ["graph", "target_id"]).join(sources, ["graph", "source_id"]).select("graph", F.col("source_id").alias("id"), "api", "issue", "hint", F.lit("import").alias("place"))
    return named.unionByName(told).unionByName(imported)


def compatibility_scores(g: KnowledgeGraph, framework: str, target_version: str, known_issues: list[tuple] = KNOWN_ISSUES) -> DataFrame:
    """Per graph: issues and the score that loses 10 points for each, never below 0."""
    issues = compatibility(g, framework, target_version, known_issues).groupBy("graph").agg(F.count(F.lit(1)).alias("issues"))
    return g.entities.select("graph").distinct().join(issues, "graph", "left").na.fill(0, ["issues"]).withColumn("score", F.greatest(F.lit(0), 100 - 10 * F.col("issues")))


def validate(g: KnowledgeGraph, check_orphans: bool = True, check_invalid_refs: bool = True, check_duplicates: bool = True) -> DataFrame:
    """(graph, issue, severity, subject): dangling ends, entities without any edge, repeated names in a file, as far as asked for."""
    keys = g.entities.select("graph", "id")
    e = g.relationships
    bad = lambda side, issue: e.join(keys.withColumnRenamed("id", side), ["graph", side], "left_anti").select("graph", F.lit(issue).alias("issue"), F.lit("error").alias("severity"), F.col("rel_id").cast("string").alias("subject"))
    ends = e.select("graph", F.explode(F.array("source_id", "target_id")).alias("id")).where("id is not null").distinct()
    orphans = g.entities.where("type <> 'module'").join(ends, ["graph", "id"], "left_anti").select("graph", F.lit("orphan").alias("issue"), F.lit("warning").alias("severity"), F.col("id").alias("subject"))
    again = g.entities.withColumn("n", F.row_number().over(Window.partitionBy("graph", "file_path", "name").orderBy("seq"))).where("n > 1")
    repeated = again.select("graph", F.lit("duplicate").alias("issue"), F.lit("warning").alias("severity"), F.col("id").alias("subject"))
    parts = [bad("source_id", "invalid_source"), bad("target_id", "invalid_target")] if check_invalid_refs else []
    parts += [orphans] * check_orphans + [repeated] * check_duplicates
    return functools.reduce(DataFrame.unionByName, parts) if parts else orphans.limit(0)


def validation_summary(g: KnowledgeGraph) -> DataFrame:
    """Per graph: errors, warnings, and whether it is valid."""
    counts = validate(g).groupBy("graph").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return g.entities.select("graph").distinct().join(counts, "graph", "left").na.fill(0, ["errors", "warnings"]).withColumn("valid", F.col("errors") == 0)


def repair(g: KnowledgeGraph, remove_invalid: bool = True, remove_orphans: bool = False) -> KnowledgeGraph:
    """Without edges that dangle and, if asked for, without entities that then have no edge."""
    keys, e, nodes = g.entities.select("graph", "id"), g.relationships, g.entities
    if remove_invalid:
        for side in ("source_id", "target_id"):
            e = e.join(keys.withColumnRenamed("id", side), ["graph", side], "left_semi")
    if remove_orphans:
        ends = e.select("graph", F.explode(F.array("source_id", "target_id")).alias("id")).where("id is not null").distinct()
        linked = nodes.join(ends, ["graph", "id"], "left_semi")
        nodes = nodes.where("type = 'module'").unionByName(linked.where("type <> 'module'"))
    return KnowledgeGraph(nodes, e.select("rel_id", "graph", "source_id", "target_id", "type"), g.file_hashes)
