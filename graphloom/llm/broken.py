"""Source files that do not parse.

Recursive-descent statements with precedence-climbing expressions and panic-mode recovery per
language: every error of a file is kept, its first one is the cause, and a file is accepted
when it has none.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.syntax.base import Grammar
from graphloom.llm.syntax.dart import Dart
from graphloom.llm.syntax.golang import Go
from graphloom.llm.syntax.java import Java
from graphloom.llm.syntax.lexer import normalised
from graphloom.llm.syntax.php import Php
from graphloom.llm.syntax.python import Python
from graphloom.llm.syntax.ruby import Ruby
from graphloom.llm.syntax.rust import Rust
from graphloom.llm.syntax.script import JavaScript, TypeScript
from graphloom.session import spread

GRAMMARS: dict[str, type[Grammar]] = {"js": JavaScript, "ts": TypeScript, "py": Python, "rb": Ruby, "php": Php, "java": Java, "go": Go, "rs": Rust, "dart": Dart}

# Deep nesting recurses once per level; Python frames live on the heap.
_DEPTH = 200_000


def language_of(path: str | None) -> str | None:
    """The language by the extension, case ignored; None for an unknown one."""
    extension = (path or "").rsplit(".", 1)[-1].lower()
    return extension if extension in GRAMMARS else None


def parse(text: str, language: str, codes: str | None = None) -> Grammar:
    """The parsed text; its ``errors`` are empty if it was accepted."""
    limit = sys.getrecursionlimit()
    if limit < _DEPTH:
        sys.setrecursionlimit(_DEPTH)
    grammar = GRAMMARS[language](normalised(text), codes)
    try:
        grammar.parse()
    finally:
        sys.setrecursionlimit(limit)
    return grammar


@functools.lru_cache(maxsize=512)
def first_errors(text: str, path: str) -> tuple[tuple[int, int, str], ...]:
    """All errors of a text as (line, column, message), the first cause in front."""
    language = language_of(path)
    if language is None or not text.strip():
        return ()
    grammar = parse(text, language)
    return tuple(grammar.placed()) if grammar.errors else ()


_VERDICTS = "file_id long, graph string, file_path string, language string, accepted boolean, first_line int, first_cause string, errors array<struct<line:int,col:int,message:string>>"


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for file_id, graph, path, text in zip(pdf["file_id"], pdf["graph"], pdf["file_path"], pdf["source_text"]):
            errors = first_errors(text or "", path or "")
            first = errors[0] if errors else (None, None, None)
            rows.append((file_id, graph, path, language_of(path), not errors, first[0], first[2], [{"line": a, "col": b, "message": c} for a, b, c in errors]))
        out = pd.DataFrame(rows, columns=["file_id", "graph", "file_path", "language", "accepted", "first_line", "first_cause", "errors"])
        out["first_line"] = out["first_line"].astype("Int32")
        yield out


def syntax_verdicts(files: DataFrame) -> DataFrame:
    """One row per file: language, accepted, the first error's line and cause, all errors.

    Null, empty and comment-only texts are accepted, and so are files of an unknown extension
    (language null).  Repeated files give repeated rows.
    """
    return spread(files.select("file_id", "graph", "file_path", "source_text")).mapInPandas(_check, _VERDICTS)


def broken_files(files: DataFrame) -> DataFrame:
    """(file_id) of the files that are invalid for the language of their extension."""
    return syntax_verdicts(files).where("not accepted").select("file_id")


def acceptance(files: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Files, broken files and their rate per graph, the graph's language and the files' language."""
    verdicts = syntax_verdicts(files).groupBy("graph", "language").agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("accepted")).alias("broken"))
    known = frameworks.groupBy("graph").agg(F.min("language").alias("graph_language"))
    return verdicts.join(known, "graph", "left").select("graph", "graph_language", "language", "files", "broken", (F.col("broken") / F.col("files")).alias("broken_rate"))
