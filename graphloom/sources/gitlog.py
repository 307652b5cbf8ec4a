"""Commit logs of git repositories through the Python data source API."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Repository(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], since: str | None, until: str | None):
        self.paths, self.since, self.until = paths, since, until

    def partitions(self):
        return [_Repository(p) for p in self.paths]

    def read(self, partition):
        import datetime
        import subprocess

        span = [f"--since={self.since}"] * bool(self.since) + [f"--until={self.until}"] * bool(self.until)
        log = subprocess.run(["git", "-C", partition.value, "log", "--no-renames", "--numstat", "--format=%x01%H%x02%ae%x02%ct", *span], capture_output=True, text=True, check=True).stdout
        for commit in log.split("\x01")[1:]:
            head, *files = commit.strip("\n").split("\n")
            sha, author, at = head.split("\x02")
            moment = datetime.datetime.fromtimestamp(int(at), datetime.timezone.utc).replace(tzinfo=None)
            for line in files:
                if line.strip():
                    added, removed, path = line.split("\t", 2)
                    yield partition.value, sha, author, moment, path, sum(int(x) for x in (added, removed) if x.isdigit())


class GitLog(DataSource):
    """One partition per repository; options: paths (separated by ;), since, until."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "repository string, commit_id string, author string, at timestamp_ntz, file_path string, lines bigint"

    def reader(self, schema):
        return _Reader(self.options["paths"].split(";"), self.options.get("since"), self.options.get("until"))


def find_repository(path: str) -> str | None:
    """The folder of the repository that a file or folder lies in, None outside of any."""
    start = Path(path).resolve()
    return next((str(p) for p in (start, *start.parents) if (p / ".git").exists()), None)


def read_log(spark: SparkSession, paths: list[str], since: str | None = None, until: str | None = None) -> DataFrame:
    spark.dataSource.register(GitLog)
    reader = spark.read.format("git_log").option("paths", ";".join(paths))
    for name, value in (("since", since), ("until", until)):
        reader = reader.option(name, value) if value else reader
    return reader.load()
