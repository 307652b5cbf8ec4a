"""Command line: parse, watch, save, load, info, stats, query, validate, hotspots."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame

from graphloom.api import GraphTools
from graphloom.session import build_session


def _print(out: object) -> None:
    """Results as JSON; a DataFrame row by row as it comes."""
    if isinstance(out, DataFrame):
        for row in out.toLocalIterator():
            print(json.dumps(row.asDict(recursive=True), default=str))
    else:
        print(json.dumps(out, default=str, indent=1))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, told in (("parse", "parse a folder and save its graph"), ("watch", "parse a folder and follow its changes")):
        p = commands.add_parser(name, help=told)
        p.add_argument("folder")
        p.add_argument("-o", "--output", required=True)
        p.add_argument("-p", "--pattern", action="append")
        p.add_argument("-e", "--exclude", action="append")
        if name == "watch":
            p.add_argument("--every", type=float, default=2.0, help="seconds between two looks")
            p.add_argument("--rounds", type=int, default=0, help="looks before it ends; 0: for ever")
    for name, told in (("save", "write a stored graph in another form"), ("load", "read a graph and tell its counts")):
        p = commands.add_parser(name, help=told)
        p.add_argument("graph")
        if name == "save":
            p.add_argument("output", help="a path in .json, or a folder for the native form")
    for name in ("stats", "validate"):
        commands.add_parser(name).add_argument("graph")
    query = commands.add_parser("query", help="search names")
    query.add_argument("graph")
    query.add_argument("text")
    query.add_argument("--type")
    query.add_argument("--limit", type=int, default=20)
    hot = commands.add_parser("hotspots", help="files of a git repository that change most")
    hot.add_argument("repository")
    commands.add_parser("info", help="supported languages")
    a = parser.parse_args(args)
    spark = build_session()
    if a.command in ("parse", "watch"):
        tools = GraphTools.parse_directory(spark, a.folder, a.pattern, a.exclude)
        tools.save_graph(a.output)
        _print(tools.get_graph_stats())
        _print(tools.skipped_files(a.folder, a.pattern, a.exclude))
        round_ = 0
        while a.command == "watch" and (not a.rounds or round_ < a.rounds):
            time.sleep(a.every)
            round_ += 1
            # The stored form is what the next round starts from, so that plans do not grow.
            tools = GraphTools.load_graph(spark, a.output)
            changed = tools.incremental_parse(a.folder, a.pattern, a.exclude).where("status <> 'unchanged'")
            if not changed.isEmpty():
                _print(changed)
                fresh = f"{a.output.removesuffix('.json')}.{round_ % 2}" + (".json" if a.output.endswith(".json") else "")
                tools.save_graph(fresh)
                GraphTools.load_graph(spark, fresh).save_graph(a.output)
        return 0
    if a.command == "hotspots":
        out: object = GraphTools(spark, None).find_hotspots(a.repository)
    elif a.command == "info":
        out = GraphTools(spark, None).list_supported_languages()
    else:
        tools = GraphTools.load_graph(spark, a.graph)
        if a.command == "save":
            tools.save_graph(a.output)
        out = {"validate": tools.validate, "query": lambda: tools.search_entities(a.text, a.type, a.limit)}.get(a.command, tools.get_graph_stats)()
    _print(out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
