"""Summaries of framework catalogues: one JSON text per summary, with its frameworks as a list or by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FRAMEWORK = "struct<name:string,language:string,files_processed:string,entities:string,entity_count:string,relationships:string,entity_types:map<string,string>,relationship_types:map<string,string>,graph_file:string>"
SCHEMA_LIST, SCHEMA_NAMED = f"frameworks array<{_FRAMEWORK}>", f"frameworks map<string,{_FRAMEWORK}>"


def from_summaries(summaries: DataFrame) -> DataFrame:
    """The columns beside payload, and name, language, files, entities, relationships, entity_types, relationship_types, graph_file of each framework.

    In a list the name is lower-cased with hyphens for spaces; by name the key counts as it is.
    Numbers may be texts, missing ones are 0, types with parts have the sum of no number: null.
    A payload that is null or not complete JSON has no frameworks.
    """
    others = [c for c in summaries.columns if c != "payload"]
    read = summaries.where("payload is not null").select(*others, F.from_json("payload", SCHEMA_LIST)["frameworks"].alias("listed"), F.from_json("payload", SCHEMA_NAMED)["frameworks"].alias("named"))
    listed = F.transform("listed", lambda f: F.struct(F.replace(F.lower(F.coalesce(f["name"], F.lit(""))), F.lit(" "), F.lit("-")).alias("key"), f.alias("value")))
    rows = read.select(*others, F.explode(F.coalesce(listed, F.map_entries("named"))).alias("f"))
    value = lambda c: F.col(f"f.value.{c}")
    number = lambda *cs: F.coalesce(*[value(c).try_cast("bigint") for c in cs], F.lit(0))
    types = lambda c: F.transform_values(value(c), lambda k, v: v.try_cast("bigint"))
    return rows.select(
        *others, F.col("f.key").alias("name"), value("language").alias("language"), number("files_processed").alias("files"), number("entities", "entity_count").alias("entities"), number("relationships").alias("relationships"),
        types("entity_types").alias("entity_types"), types("relationship_types").alias("relationship_types"), value("graph_file").alias("graph_file"),
    )


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The frameworks of summary files under a path, whole files being one JSON text each."""
    return from_summaries(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload")))


def framework_info(frameworks: DataFrame, name: str) -> DataFrame:
    """What a catalogue says of one framework."""
    return frameworks.where(F.col("name") == name)
