"""Change history: commits per file, hotspots, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import KnowledgeGraph


def commit_log(events: DataFrame) -> DataFrame:
    """A commit log from an event stream: file, author, at, lines."""
    return events.select(
        F.concat_ws("/", "event_type", (F.col("user_id") % 100).cast("string")).alias("file_path"), F.col("user_id").alias("author"), F.col("ts").alias("at"), F.floor("value").cast("long").alias("lines"), F.col("event_id").alias("commit_id")
    )


def recent_commits(commits: DataFrame, per_file: int = 50) -> DataFrame:
    """The newest commits of each file."""
    w = Window.partitionBy("file_path").orderBy(F.desc("at"), F.desc("commit_id"))
    return commits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_file)


def hotspots(commits: DataFrame, per_file: int = 50) -> DataFrame:
    """(file_path, commits, authors, lines, score, hotspot): half by commits, 0.3 by authors, 0.2 by lines."""
    by = recent_commits(commits, per_file).groupBy("file_path").agg(F.count(F.lit(1)).alias("commits"), F.count_distinct("author").alias("authors"), F.sum("lines").alias("lines"))
    one = F.lit(1.0)
    score = 0.5 * F.least(F.col("commits") / 30, one) + 0.3 * F.least(F.col("authors") / 5, one) + 0.2 * F.least(F.col("lines") / 500, one)
    return by.withColumn("raw", score).select("file_path", "commits", "authors", "lines", F.bround("raw", 6).alias("score"), (F.col("raw") >= 0.7).alias("hotspot"))


def timeline(commits: DataFrame) -> DataFrame:
    """(file_path, month, commits, lines, authors so far months): activity per file and month with the running number of commits."""
    by = commits.groupBy("file_path", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("commits"), F.sum("lines").alias("lines"))
    return by.withColumn("commits_so_far", F.sum("commits").over(Window.partitionBy("file_path").orderBy("month")))


#: Days of history that are looked at where no other span is asked for.
DAYS = 180


def entity_history(g: KnowledgeGraph, commits: DataFrame, since=None, until=None) -> DataFrame:
    """(graph, id, file_path, commits, authors, lines, score, hotspot): the history of the file of every entity.

    Without ``since`` it is that of the DAYS before ``until`` or now.
    """
    end = F.lit(until).cast("timestamp") if until is not None else F.current_timestamp()
    start = F.lit(since).cast("timestamp") if since is not None else end - F.make_dt_interval(F.lit(DAYS))
    inside = commits.where((F.col("at") >= start) & (F.col("at") <= end))
    return g.entities.select("graph", "id", "file_path").join(hotspots(inside), "file_path")


def graph_hotspots(g: KnowledgeGraph, commits: DataFrame, limit: int | None = 10) -> DataFrame:
    """(graph, id, name, file_path, score, ...): the files of the graph that change most, each under its first entity."""
    first = g.entities.where("file_path is not null").groupBy("graph", "file_path").agg(F.min_by(F.struct("id", "name", "type"), "seq").alias("e"))
    found = first.join(hotspots(commits), "file_path").select("graph", "e.*", "file_path", "commits", "authors", "lines", "score", "hotspot").where("score > 0")
    return found.orderBy(F.desc("score"), "graph", "file_path").limit(limit) if limit else found
