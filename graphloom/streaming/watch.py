"""Continuous refresh: a stream of file states keeps a ledger of hashes and reports changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.functions.text import glob_regex

STATES = "graph string, file_path string, hash_value string, at timestamp"
_CHANGES = "graph string, file_path string, status string, hash_value string, at timestamp"


def wanted(states: DataFrame, include: list[str], exclude: list[str] | None = None) -> DataFrame:
    """States of files that meet a pattern; exclusions go first."""
    keep, drop = F.lit(False), F.lit(False)
    for p in include:
        keep = keep | F.col("file_path").rlike(glob_regex(p))
    for p in exclude or []:
        drop = drop | F.col("file_path").rlike(glob_regex(p))
    return states.where(~drop & keep)


def _track(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """One file: its states in order of time against the last hash; a null hash is a deletion."""
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values("at", kind="stable")
    out = []
    for h, at in zip(rows["hash_value"], rows["at"]):
        h = h if isinstance(h, str) else None
        if h == last:
            continue
        out.append((key[0], key[1], "deleted" if h is None else "new" if last is None else "changed", h, at))
        last = h
    state.update((last,))
    yield pd.DataFrame(out, columns=["graph", "file_path", "status", "hash_value", "at"])


def file_changes(states: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Changes (graph, file_path, status, hash_value, at) from a stream of file states.

    The state per file is its last hash.  Equal hashes in a row are no change, whatever the
    number of events.
    """
    keyed = states.withWatermark("at", lateness).groupBy("graph", "file_path")
    return keyed.applyInPandasWithState(_track, _CHANGES, "hash_value string", "append", "NoTimeout")


def settled(states: DataFrame, quiet: str = "2 seconds", lateness: str = "10 minutes") -> DataFrame:
    """Bursts of events per file, closed after a quiet time: (graph, file_path, events, last hash)."""
    by = states.withWatermark("at", lateness).groupBy("graph", "file_path", F.session_window("at", quiet).alias("burst"))
    return by.agg(F.count(F.lit(1)).alias("events"), F.max_by("hash_value", "at").alias("hash_value"))


def start_ledger(changes: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append changes to a table of the ledger; ``ledger`` reads the latest state from it.

    Without ``every``, an interval such as "5 seconds", what is there is read and the query ends.
    """
    when = {"processingTime": every} if every else {"availableNow": True}
    return changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**when).start()


def ledger(changes: DataFrame) -> DataFrame:
    """The files that exist after all changes, with their hashes."""
    last = changes.groupBy("graph", "file_path").agg(F.max_by(F.struct("status", "hash_value"), "at").alias("l"))
    return last.where("l.status <> 'deleted'").select("graph", "file_path", "l.hash_value")
