"""Documentation texts of entities, rendered set-based: one text per entity and format."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.graph import KnowledgeGraph

FORMATS = ("markdown", "jsdoc", "google", "numpy", "sphinx")


#: Edges of each kind that a text tells of, and examples of use.
LISTED, SEEN, EXAMPLES = 10, 5, 5


def related_entities(g: KnowledgeGraph) -> DataFrame:
    """(graph, id, imports, calls, callers, n_imports, n_calls, n_callers): the first edges of each entity by kind.

    The first LISTED edges of a kind in order of insertion are looked at; those whose other end
    is no entity fall out after that.  The numbers are those of all edges.
    """
    ends = F.array(
        F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("other"), F.col("type").alias("kind")),
        F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("other"), F.lit("callers").alias("kind")),
    )
    rows = g.relationships.where("type in ('calls', 'imports') and graph is not null").select("graph", "rel_id", F.explode(ends).alias("x"), "type").select("graph", "rel_id", "type", "x.*")
    rows = rows.where("id is not null and (kind <> 'callers' or type = 'calls')")
    counts = rows.groupBy("graph", "id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("imports", "calls", "callers")])
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("graph", "id", "kind").orderBy("rel_id"))).where(F.col("place") <= LISTED)
    other = g.entities.select("graph", F.col("id").alias("other"), "name", "type", "file_path", "line")
    known = first.drop("type").join(other, ["graph", "other"])
    entry = F.struct("place", "name", "type", "file_path", "line")
    lists = known.groupBy("graph", "id").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, entry))).alias(k) for k in ("imports", "calls", "callers")])
    return counts.join(lists, ["graph", "id"], "left")


def documentation(g: KnowledgeGraph, form: str = "markdown", include_examples: bool = True) -> DataFrame:
    """(graph, id, text) in one of FORMATS; an unknown one gives markdown.

    A text is a list of lines; sections without anything to tell are left out.
    """
    e = g.entities.join(related_entities(g), ["graph", "id"], "left")
    none = F.array().cast("array<string>")
    lines = lambda *parts: F.array(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    part = lambda when, *arrays: F.when(F.coalesce(when, F.lit(False)), F.concat(*arrays)).otherwise(none)
    each = lambda kind, most, f: F.coalesce(F.transform(F.filter(kind, lambda x: x["place"] <= most), f), none)
    glue = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    doc, has_doc = F.col("docstring"), text.truthy(F.col("docstring"))
    line = F.coalesce(F.col("line").cast("string"), F.lit(""))
    calls, imports, callers = F.col("n_calls") > 0, F.col("n_imports") > 0, F.col("n_callers") > 0
    if form == "jsdoc":
        told = F.when(has_doc, F.transform(F.split(doc, "\n"), lambda x: glue(" * ", x))).otherwise(F.array(glue(" * ", F.col("name"))))
        body = F.concat(lines("/**"), told, lines(" *", glue(" * @type {", F.col("type"), "}"), glue(" * @file ", F.col("file_path"))), each("calls", SEEN, lambda x: glue(" * @see ", x["name"])), lines(" */"))
    elif form in ("google", "numpy", "sphinx"):
        if form == "google":
            section = part(calls, lines("Attributes:"), each("calls", SEEN, lambda x: glue("    ", x["name"], ": ", x["type"])))
        elif form == "numpy":
            section = part(calls, lines("See Also", "--------"), each("calls", SEEN, lambda x: glue(x["name"], " : ", x["type"])))
        else:
            section = F.concat(lines(glue(":type: ", F.col("type")), glue(":file: ", F.col("file_path"))), each("calls", SEEN, lambda x: glue(":seealso: :class:`", x["name"], "`")))
        body = F.concat(lines('"""', F.when(has_doc, doc).otherwise(F.col("name")), ""), section, lines('"""'))
    else:
        kind = lambda x: glue("- `", x["name"], "` (", x["type"], ")")
        seen = each("callers", EXAMPLES, lambda x: glue("- `", x["name"], "` in `", x["file_path"], ":", F.coalesce(x["line"].cast("string"), F.lit("")), "`"))
        body = F.concat(
            lines(glue("# ", F.col("name")), "", glue("**Type**: `", F.col("type"), "`  "), glue("**File**: `", F.col("file_path"), "`  "), glue("**Line**: ", line), ""),
            part(has_doc, lines("## Description", "", doc, "")),
            part(calls | imports, lines("## Dependencies", "")),
            part(imports, lines("### Imports"), each("imports", LISTED, lambda x: glue("- `", x["name"], "`")), lines("")),
            part(calls, lines("### Calls"), each("calls", LISTED, kind), lines("")),
            part(callers, lines("## Used By", ""), each("callers", LISTED, kind), lines("")),
            part((F.size(seen) > 0) & F.lit(include_examples), lines("## Usage Examples", ""), seen, lines("")),
        )
    return e.select("graph", "id", F.array_join(body, "\n").alias("text"))


def codebase_overview(g: KnowledgeGraph) -> DataFrame:
    """(graph, text): counts by type as a text, for prompts."""
    counts = g.entities.groupBy("graph", "type").agg(F.count(F.lit(1)).alias("n"))
    lines = counts.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("r"), "type", F.concat(F.lit("- "), "type", F.lit(": "), F.col("n").cast("string")).alias("line")))).alias("x"), F.sum("n").alias("n"))
    return lines.select("graph", F.concat_ws("\n", F.concat(F.lit("Entities: "), F.col("n").cast("string")), F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("text"))
