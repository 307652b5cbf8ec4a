from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from graphloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 2, "4g")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.autoBroadcastJoinThreshold", "1048576")
    return s


@pytest.fixture
def frame(spark):
    """Rows as a table, with extra columns whose names clash with those that operators make."""

    def make(rows, schema, extra=True):
        df = spark.createDataFrame(rows, schema)
        if extra:
            for c in ("n", "key", "line", "parent", "label", "types", "errors", "part", "code", "seq", "alive", "week", "shard", "root_id", "low", "name", "kind"):
                if c not in df.columns:
                    df = df.selectExpr("*", f"'clash' as {c}")
        return df

    return make
