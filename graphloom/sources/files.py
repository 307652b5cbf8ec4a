"""Source files from a folder, and their change against a ledger of hashes."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import extension, glob_regex
from graphloom.operators.mutate import classify_files

# What is left out unless asked for.
IGNORED = [
    "*.pyc",
    "__pycache__",
    "node_modules",
    ".git",
    ".venv",
    "venv",
    "dist",
    "build",
]


def listed(spark: SparkSession, folder: str, patterns: list[str] | None = None, exclude: list[str] | None = None, max_kb: int | None = 1024, graph: str = "local") -> DataFrame:
    """(graph, file_path, extension, n_bytes, updated_at, skipped, content) of the files under a folder.

    Paths are relative to the folder; patterns and exclusions are globs, one without a slash
    meets base names, and the ignored ones any part of the path.  skipped is null for files
    that are read, else ``unwanted``, ``ignored``, ``excluded`` or ``too large`` (above ``max_kb``).
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace("path", r"^file:/*", "/")
    root = "/" + folder.replace("file://", "").strip("/") + "/"
    # A single file is known by its name.
    inside = F.when(F.startswith(path, F.lit(root)), F.substr(path, F.lit(len(root) + 1))).otherwise(F.regexp_extract(path, r"([^/]*)$", 1))
    rows = rows.select(inside.alias("file_path"), "content", F.col("length").alias("n_bytes"), F.col("modificationTime").alias("updated_at"))
    base = F.regexp_extract("file_path", r"([^/]*)$", 1)

    def meets(pattern: str):
        on = F.col("file_path").rlike(glob_regex(pattern))
        return on if "/" in pattern else on | base.rlike(glob_regex(pattern))

    any_of = lambda tests: functools.reduce(lambda a, b: a | b, tests, F.lit(False))
    ignored = any_of(F.col("file_path").rlike(glob_regex(f"**/{p}")) | F.col("file_path").rlike(glob_regex(f"**/{p}/**")) for p in IGNORED)
    skipped = F.when(ignored, "ignored").when(any_of(map(meets, exclude or [])), "excluded").when(~any_of(map(meets, patterns or ["**/*.py"])), "unwanted")
    if max_kb is not None:
        skipped = skipped.when(F.col("n_bytes") > max_kb * 1024, "too large")
    return rows.select(F.lit(graph).alias("graph"), "file_path", extension(F.col("file_path")).alias("extension"), "n_bytes", "updated_at", skipped.alias("skipped"), "content")


def scan(spark: SparkSession, folder: str, patterns: list[str] | None = None, exclude: list[str] | None = None, max_kb: int | None = 1024, graph: str = "local") -> DataFrame:
    """(graph, file_path, source_text, hash_value, updated_at, extension) of the files that are read; ``skipped_files`` has the others."""
    rows = listed(spark, folder, patterns, exclude, max_kb, graph).where("skipped is null")
    return rows.select("graph", "file_path", F.decode("content", "UTF-8").alias("source_text"), F.sha2("content", 256).alias("hash_value"), "updated_at", "extension")


def skipped_files(spark: SparkSession, folder: str, patterns: list[str] | None = None, exclude: list[str] | None = None, max_kb: int | None = 1024, graph: str = "local") -> DataFrame:
    """(graph, file_path, n_bytes, skipped): wanted files that are not read, with the reason; contents are not loaded."""
    return listed(spark, folder, patterns, exclude, max_kb, graph).where("skipped is not null and skipped <> 'unwanted'").select("graph", "file_path", "n_bytes", "skipped")


def changes(current: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that are new, changed, unchanged or deleted against the ledger."""
    return classify_files(current, ledger)
