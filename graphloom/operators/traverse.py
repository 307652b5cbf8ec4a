"""Traversal of the graph by iterative joins: neighbourhoods, paths, impact, navigation.

One kernel walks many start nodes together: the frontier is joined with the edges, what was
seen before is taken out by an anti-join, and each level is written to the checkpoint folder.
Frontiers are rows (root, node), so the memory of a task does not depend on a hub's degree.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import KnowledgeGraph
from graphloom.session import cut, discard, stored


def reach(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(graph, root, id, depth): nodes within ``depth`` steps of each root, the root itself at 0.

    starts: (graph, root).  edges: (graph, src, dst), written out once if several levels read
    them.  depth counts breadth-first levels.
    """
    edges = cut(edges) if depth > 1 else edges
    seen = cut(starts.select("graph", "root", F.col("root").alias("id"), F.lit(0).alias("depth")).distinct())
    frontier = seen
    for level in range(1, depth + 1):
        step = frontier.select("graph", "root", F.col("id").alias("src")).join(edges, ["graph", "src"]).select("graph", "root", F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen, ["graph", "root", "id"], "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def neighbours(g: KnowledgeGraph, starts: DataFrame, depth: int = 1) -> DataFrame:
    """Entities within ``depth`` undirected steps of each start, without the start and without ids that are no entity."""
    found = reach(starts, g.undirected(), depth).where("depth > 0")
    return found.join(g.entities.select("graph", "id", "name", "type"), ["graph", "id"]).select("graph", "root", "id", "name", "type", "depth")


#: Neighbours of a level up to which a search goes on from both ends at once; beyond, from the end that has fewer.
FEW_NEIGHBOURS = 64


def shortest_paths(g: KnowledgeGraph, pairs: DataFrame, max_depth: int = 10) -> DataFrame:
    """(graph, source, target, hops, path): the smallest shortest undirected path of each pair.

    Among paths of equal length the lexicographically smallest counts.  A node's path to itself
    is the node alone if it is in the graph; unreachable pairs give no row.

    Levels go out from both ends until they meet, next from the end whose level has fewer
    neighbours, so that hubs are met rather than passed.  Each node bears the smallest path to its
    end, so that the smallest path through a meeting is made of its two halves.
    """
    edges = stored(g.undirected())
    degrees = stored(edges.groupBy("graph", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree")))
    wanted = stored(pairs.select("graph", "source", "target").distinct().join(degrees.select("graph", F.col("id").alias("source")), ["graph", "source"], "left_semi"))
    found = [wanted.where("source = target").select("graph", "source", "target", F.lit(0).alias("hops"), F.array("source").alias("path"))]
    waiting = wanted.where("source <> target")
    side = lambda df, name, grows: df.select(F.lit(name).alias("side"), "graph", F.col(name).alias("root"), grows)
    ends = side(waiting, "source", F.lit(True).alias("front")).unionByName(side(waiting, "target", F.lit(True).alias("front"))).distinct()
    seen = stored(ends.select("side", "graph", "root", F.col("root").alias("id"), F.lit(0).alias("depth"), F.array("root").alias("path"), "front"))
    gone = [seen]
    while True:
        # What the next level of each end costs; an end without neighbours left has no row, and its pairs are given up.
        costs = seen.where("front").join(degrees, ["graph", "id"]).groupBy("side", "graph", "root").agg(F.sum("degree").alias("cost"), F.max("depth").alias("level"))
        of = lambda name: costs.where(F.col("side") == name).select("graph", F.col("root").alias(name), F.col("cost").alias(f"{name}_cost"), F.col("level").alias(f"{name}_level"))  # noqa: B023, E731
        turn = waiting.join(of("source"), ["graph", "source"]).join(of("target"), ["graph", "target"]).where(F.col("source_level") + F.col("target_level") < max_depth)
        few = lambda name, other: ((F.col(f"{name}_cost") <= F.col(f"{other}_cost")) | (F.col(f"{name}_cost") <= FEW_NEIGHBOURS)).alias(f"{name}_grows")
        turn = stored(turn.select("graph", "source", "target", few("source", "target"), few("target", "source")))
        gone.append(turn)
        if turn.isEmpty():
            break
        roots = side(turn, "source", F.col("source_grows").alias("grows")).unionByName(side(turn, "target", F.col("target_grows").alias("grows"))).groupBy("side", "graph", "root").agg(F.max("grows").alias("grows"))
        kept = seen.join(roots, ["side", "graph", "root"])
        step = kept.where("front and grows").withColumnRenamed("id", "src").join(edges, ["graph", "src"]).groupBy("side", "graph", "root", F.col("dst").alias("id")).agg(F.min("depth").alias("depth"), F.min("path").alias("path"))
        longer = F.when(F.col("side") == "source", F.concat("path", F.array("id"))).otherwise(F.concat(F.array("id"), "path"))
        fresh = step.join(seen, ["side", "graph", "root", "id"], "left_anti").select("side", "graph", "root", "id", (F.col("depth") + 1).alias("depth"), longer.alias("path"), F.lit(True).alias("front"))
        seen = stored(kept.select("side", "graph", "root", "id", "depth", "path", (F.col("front") & ~F.col("grows")).alias("front")).unionByName(fresh))
        gone.append(seen)
        half = lambda name: seen.where(F.col("side") == name).select("graph", F.col("root").alias(name), "id", F.col("depth").alias(f"{name}_depth"), F.col("path").alias(f"{name}_path"))  # noqa: B023, E731
        met = turn.select("graph", "source", "target").join(half("source"), ["graph", "source"]).join(half("target"), ["graph", "target", "id"])
        whole = F.struct((F.col("source_depth") + F.col("target_depth")).alias("hops"), F.concat("source_path", F.slice("target_path", 2, F.size("target_path"))).alias("path"))
        met = stored(met.groupBy("graph", "source", "target").agg(F.min(whole).alias("best")).select("graph", "source", "target", "best.hops", "best.path"))
        found.append(met.where(F.col("hops") <= max_depth))
        waiting = turn.select("graph", "source", "target").join(met, ["graph", "source", "target"], "left_anti")
    for df in gone:
        discard(df)
    return functools.reduce(DataFrame.unionByName, found)


def subgraph(g: KnowledgeGraph, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with the given (graph, id) and the edges between them."""
    keep = ids.select("graph", "id").distinct()
    ends = lambda side: keep.withColumnRenamed("id", side)
    return g.entities.join(keep, ["graph", "id"], "left_semi"), g.relationships.join(ends("source_id"), ["graph", "source_id"], "left_semi").join(ends("target_id"), ["graph", "target_id"], "left_semi")


def impact(g: KnowledgeGraph, starts: DataFrame, depth: int = 3) -> DataFrame:
    """(graph, root, direct, indirect, score, risk) of each start.

    Direct dependents are edges into the start from an entity, parallel edges and loops kept;
    indirect ones are the entities on the levels behind, once each.  The score adds 1 for each
    direct one and halves per further level.
    """
    depth = min(max(depth, 1), 10)
    known = g.entities.select("graph", F.col("id").alias("source_id"))
    incoming = g.relationships.where("target_id is not null").join(known, ["graph", "source_id"], "left_semi")
    direct = starts.join(incoming.withColumnRenamed("target_id", "root"), ["graph", "root"]).groupBy("graph", "root").agg(F.count(F.lit(1)).alias("direct"))
    levels = reach(starts, incoming.select("graph", F.col("target_id").alias("src"), F.col("source_id").alias("dst")).distinct(), depth)
    behind = levels.where("depth > 1").groupBy("graph", "root").agg(F.count(F.lit(1)).alias("indirect"), F.sum(F.pow(F.lit(0.5), F.col("depth") - 1)).alias("halves"))
    out = starts.distinct().join(direct, ["graph", "root"], "left").join(behind, ["graph", "root"], "left").na.fill(0)
    score, total = F.col("direct") + F.col("halves"), F.col("direct") + F.col("indirect")
    risk = F.when((score >= 10) | (total >= 20), "high").when((score >= 5) | (total >= 10), "medium").otherwise("low")
    return out.select("graph", "root", "direct", "indirect", F.bround(score, 2).alias("score"), risk.alias("risk"))


#: Edges of one graph beyond which its chains are prolonged by joins, as they would fill a task's memory.
EDGES_IN_A_TASK = 30_000_000

#: Steps without a chain after which a walk looks ahead before each step.
PATIENCE = 1_000

#: Edges into a hub that a walk reads at once, as it often needs the first ones only.
UPS_AT_ONCE = 1_000

#: Edges into the head of a chain that a round of joins follows; the others wait as a chain of their own.
UPS_IN_A_ROUND = 8


def _chains(ups_of, ended: np.ndarray, live: np.ndarray, root: int) -> Iterator[list[int]]:
    """The simple chains from ``root`` to an end, depth first.

    After PATIENCE steps without a chain only nodes are entered from which an end can be reached
    beside the path, so that the time for each chain stays polynomial.  What a look ahead found
    closed stays closed while the path goes on from there.
    """
    path, on, walks, steps = [root], {root}, [iter(ups_of(root))], 0
    closed: set[int] = set()
    closings: list[tuple[int, set[int]]] = []

    def opens(node: int) -> bool:
        if node in closed:
            return False
        seen, todo = {node}, [node]
        while todo:
            for up in ups_of(todo.pop()):
                if ended[up]:
                    return True
                if up not in seen and up not in on and up not in closed and live[up]:
                    seen.add(up)
                    todo.append(up)
        closed.update(seen)
        closings.append((len(path), seen))
        return False

    while walks:
        up = next(walks[-1], None)
        if up is None:
            walks.pop()
            on.discard(path.pop())
            while closings and closings[-1][0] > len(path):
                closed -= closings.pop()[1]
        elif ended[up]:
            yield [*path, up]
            steps = 0
        elif live[up] and up not in on:
            steps += 1
            if steps <= PATIENCE or opens(up):
                path.append(up)
                on.add(up)
                walks.append(iter(ups_of(up)))


def _walk(ups_of, ended: np.ndarray, live: np.ndarray, root: int, limit: int | None) -> list[list[int]]:
    """The first ``limit`` chains of one root, or all."""
    return list(itertools.islice(_chains(ups_of, ended, live, root), limit))


def _walks(limit: int | None):
    """Chains of whole graphs; rows (key, head, up, ended) come by key, first the roots with no up, then by head in order of insertion."""

    def solve(pieces: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        head, up, ended = (np.concatenate([p[i] for p in pieces]) for i in range(3))
        pieces.clear()
        n = np.count_nonzero(up < 0)
        roots, head, up, ended = head[:n], head[n:], up[n:], ended[n:]
        names = np.unique(np.concatenate([head[np.flatnonzero(np.diff(head, prepend=-1))], np.unique(up), roots]))
        head, up, roots = (np.searchsorted(names, x).astype(np.int32) for x in (head, up, roots))
        starts = np.searchsorted(head, np.arange(len(names) + 1))
        is_end = np.zeros(len(names), bool)
        is_end[up[ended]] = True
        # Nodes that lead to an end, by any way.
        back = np.argsort(up, kind="stable")
        first, back = np.searchsorted(up[back], np.arange(len(names) + 1)), head[back]
        live, frontier = is_end.copy(), np.flatnonzero(is_end)
        while len(frontier):
            n = first[frontier + 1] - first[frontier]
            at = np.repeat(first[frontier] - np.cumsum(n) + n, n) + np.arange(n.sum())
            frontier = np.unique(back[at])
            frontier = frontier[~live[frontier]]
            live[frontier] = True
        del head, ended, back, first

        def ups_of(node: int) -> Iterator[int]:
            for at in range(starts[node], starts[node + 1], UPS_AT_ONCE):
                yield from up[at : min(at + UPS_AT_ONCE, starts[node + 1])].tolist()

        found = ((names[root], place, names[chain]) for root in roots.tolist() if live[root] for place, chain in enumerate(itertools.islice(_chains(ups_of, is_end, live, root), limit), 1))
        while rows := list(itertools.islice(found, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _CHAIN.types)], schema=_CHAIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[tuple[np.ndarray, ...]] = []
        last = None
        for batch in batches:
            key, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            at = np.flatnonzero(np.diff(key)) + 1
            for keys, *piece in zip(np.split(key, at), *(np.split(c, at) for c in columns)):
                if not len(keys):
                    continue
                if pieces and last != keys[0]:
                    yield from solve(pieces)
                last = keys[0]
                pieces.append(tuple(piece))
        if pieces:
            yield from solve(pieces)

    return run


_CHAIN = pa.schema([("root", pa.int64()), ("place", pa.int32()), ("chain", pa.list_(pa.int64()))])


def critical_paths(g: KnowledgeGraph, starts: DataFrame, limit: int | None = 10, in_a_task: int = EDGES_IN_A_TASK) -> DataFrame:
    """(graph, root, place, path): simple chains of dependents up to an entity that nothing leads to.

    All edges into a node are followed, in order of insertion.  ``limit`` is how many chains of a
    root are asked for, the first ones of a depth-first walk, however long; None asks for all,
    whose number may be exponential.  The edges of a graph, as numbers, go to one task that walks
    from all its roots; graphs of more than ``in_a_task`` edges are walked by joins, with the same rows.
    """
    known = g.entities.select("graph", F.col("id").alias("source_id"))
    edges = g.relationships.where("target_id is not null and graph is not null").select("graph", "source_id", "target_id", "rel_id")
    step = stored(edges.join(known, ["graph", "source_id"], "left_semi").select("graph", F.col("target_id").alias("head"), F.col("source_id").alias("up"), "rel_id"))
    targets = edges.select("graph", F.col("target_id").alias("id")).distinct()
    roots = starts.select("graph", "root").distinct()
    large = stored(step.groupBy("graph").count().where(F.col("count") > in_a_task).select("graph"))
    if not large.isEmpty():
        ends = cut(step.select("graph", F.col("up").alias("id")).distinct().join(targets, ["graph", "id"], "left_anti").join(large, "graph", "left_semi"))
        by_joins = _chains_by_joins(cut(step.join(large, "graph", "left_semi")), ends, roots.join(large, "graph", "left_semi"), limit)
        step = stored(step.join(large, "graph", "left_anti"))
    nodes = step.select("graph", F.col("up").alias("id")).unionByName(step.select("graph", F.col("head").alias("id"))).distinct()
    nodes = stored(nodes.join(targets.withColumn("inside", F.lit(True)), ["graph", "id"], "left").select("graph", "id", F.col("inside").isNull().alias("ended"), F.monotonically_increasing_id().alias("node")))
    of = lambda name, number: nodes.select("graph", F.col("id").alias(name), F.col("node").alias(number))
    numbered = step.join(of("head", "a"), ["graph", "head"]).join(nodes.select("graph", F.col("id").alias("up"), F.col("node").alias("b"), "ended"), ["graph", "up"])
    rows = numbered.select("graph", "a", "b", "rel_id", "ended").unionByName(roots.join(of("root", "a"), ["graph", "root"]).select("graph", "a", F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("rel_id"), F.lit(False).alias("ended")))
    # Numbers are of one graph each, so that two graphs of one key do each other no harm.
    rows = rows.withColumn("key", F.xxhash64("graph")).repartition(int(step.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    chains = rows.sortWithinPartitions("key", F.expr("b >= 0"), "a", "rel_id").select("key", "a", "b", "ended").mapInArrow(_walks(limit), "root long, place int, chain array<long>")
    named = stored(chains).select("root", "place", F.posexplode("chain").alias("pos", "node")).join(nodes.select("graph", "id", "node"), "node")
    named = named.groupBy("root", "place").agg(F.min("graph").alias("graph"), F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("chain"))
    found = named.select("graph", F.col("chain")[0]["id"].alias("root"), "place", F.array_join("chain.id", " < ").alias("path"))
    return found if large.isEmpty() else found.unionByName(by_joins)


def _chains_by_joins(step: DataFrame, ends: DataFrame, starts: DataFrame, limit: int | None) -> DataFrame:
    """As ``critical_paths``, for graphs of any size.

    Ordinals of the edges taken stand for the order of the walk: each round prolongs the first
    ``limit`` open chains of a root, the others wait, and those behind its ``limit``-th finished
    chain are dropped, as all that comes of them is behind it too.  A chain is prolonged by
    UPS_IN_A_ROUND edges at a time; for those that are left it stays open, with the next ``page``
    of edges, behind all that came of the pages before.  Chains that cannot reach an end are not
    prolonged.
    """
    # Nodes that lead to an end, by any way; a few levels between two checkpoints, as their order does not matter.
    live = frontier = ends
    while not frontier.isEmpty():
        nearer = [frontier.select("graph", "id")]
        for _ in range(4):
            nearer.append(step.join(nearer[-1].select("graph", F.col("id").alias("up")), ["graph", "up"], "left_semi").select("graph", F.col("head").alias("id")).distinct())
        frontier = cut(functools.reduce(DataFrame.unionByName, nearer[1:]).distinct().join(live, ["graph", "id"], "left_anti"))
        live = live.unionByName(frontier)
    flags = cut(live.join(ends.withColumn("ended", F.lit(True)), ["graph", "id"], "left").select("graph", F.col("id").alias("up"), F.coalesce("ended", F.lit(False)).alias("ended")))
    heads = Window.partitionBy("graph", "head")
    step = step.join(flags, ["graph", "up"]).withColumn("ordinal", F.row_number().over(heads.orderBy("rel_id")))
    # The first edge of each page but the last one tells that there are more.
    step = step.join(step.groupBy("graph", "head").agg(F.max("ordinal").alias("degree")), ["graph", "head"])
    page = F.floor((F.col("ordinal") - 1) / UPS_IN_A_ROUND).cast("int")
    more = ((F.col("ordinal") - 1) % UPS_IN_A_ROUND == 0) & (F.col("ordinal") + UPS_IN_A_ROUND <= F.col("degree"))
    step = cut(step.select("graph", "head", "up", "ordinal", "ended", page.alias("page"), more.alias("more")))
    chains = starts.select("graph", "root", F.col("root").alias("head"), F.array("root").alias("path"), F.array().cast("array<int>").alias("ordinals"), F.lit(False).alias("ended"), F.lit(0).alias("page"))
    state = cut(chains.join(flags.where("not ended").select("graph", F.col("up").alias("head")), ["graph", "head"], "left_semi").select(chains.columns))
    order = Window.partitionBy("graph", "root").orderBy(F.when(F.col("ended"), F.col("ordinals")).otherwise(F.concat("ordinals", F.array(F.col("page") * UPS_IN_A_ROUND + 1))))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    while not state.where("not ended").isEmpty():
        first = F.lit(True) if limit is None else F.sum(F.when(F.col("ended"), 0).otherwise(1)).over(so_far) <= limit
        ranked = state.withColumn("turn", ~F.col("ended") & first)
        rows = [ranked.where("not turn").drop("turn")]
        grown = ranked.where("turn").drop("turn")
        for _ in range(2):  # two steps between two checkpoints
            met = grown.drop("ended").join(step, ["graph", "head", "page"])
            left = met.where("more").select("graph", "root", "head", "path", "ordinals", F.lit(False).alias("ended"), (F.col("page") + 1).alias("page"))
            longer = met.where(~F.array_contains("path", F.col("up")))
            longer = longer.select("graph", "root", F.col("up").alias("head"), F.concat("path", F.array("up")).alias("path"), F.concat("ordinals", F.array("ordinal")).alias("ordinals"), "ended", F.lit(0).alias("page"))
            rows.append(longer.where("ended"))
            grown = longer.where("not ended").unionByName(left)
        state = functools.reduce(DataFrame.unionByName, [*rows, grown])
        if limit is not None:
            finished = F.sum(F.when(F.col("ended"), 1).otherwise(0)).over(so_far) - F.when(F.col("ended"), 1).otherwise(0)
            state = state.withColumn("finished", finished).where(F.col("finished") < limit).drop("finished")
        state = cut(state)
    return state.select("graph", "root", F.row_number().over(order).alias("place"), F.array_join("path", " < ").alias("path"))


def navigate(g: KnowledgeGraph, starts: DataFrame, direction: str = "both", depth: int = 2, types: list[str] | None = None) -> DataFrame:
    """(graph, root, id, name, type, depth) by following edges against (callers) or along (callees) their direction.

    Breadth first: the depth is the shortest distance.  Ids that are no entity are not followed.
    """
    e = g.relationships.where("source_id is not null and target_id is not null")
    if types:
        e = e.where(F.col("type").isin(*types))
    along, against = e.select("graph", F.col("source_id").alias("src"), F.col("target_id").alias("dst")), e.select("graph", F.col("target_id").alias("src"), F.col("source_id").alias("dst"))
    edges = {"callees": along, "callers": against}.get(direction, along.unionByName(against))
    inside = g.entities.select("graph", F.col("id").alias("dst"))
    found = reach(starts, edges.distinct().join(inside, ["graph", "dst"], "left_semi"), depth)
    return found.join(g.entities.select("graph", "id", "name", "type"), ["graph", "id"]).select("graph", "root", "id", "name", "type", "depth")


#: Edges of a node that a depth-first walk looks at.
PER_NODE = 20


def _first_visits(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The steps of a depth-first walk among all chains of edges of one root: a node counts where it is met first.

    Chains come in the order of the walk; one that does not prolong a step is none.
    """
    rows = rows.assign(chain=[tuple(x) for x in rows["ordinals"]]).sort_values("chain")
    visited, steps, kept = {key[1]}, {()}, []
    for chain, node in zip(rows["chain"], rows["id"]):
        kept.append(chain[:-1] in steps and node not in visited)
        if kept[-1]:
            visited.add(node)
            steps.add(chain)
    rows = rows[kept]
    return pd.DataFrame({"graph": key[0], "root": key[1], "id": rows["id"], "depth": [len(x) for x in rows["chain"]], "place": range(1, len(rows) + 1), "type": rows["type"]})


def navigate_depth_first(g: KnowledgeGraph, starts: DataFrame, direction: str = "callees", depth: int = 2, types: list[str] | None = None) -> DataFrame:
    """(graph, root, place, id, name, type, depth, relationship): a depth-first walk along (callees) or against (callers) the edges.

    A node looks at its first ``PER_NODE`` edges in order of insertion, is entered where the walk
    meets it first, and bears the depth of that place.  A root has at most PER_NODE ** depth
    chains of edges, which are laid out by joins; one pass over them in order finds the steps.
    """
    e = g.relationships.where("source_id is not null and target_id is not null and graph is not null")
    if types:
        e = e.where(F.col("type").isin(*types))
    here, there = ("target_id", "source_id") if direction == "callers" else ("source_id", "target_id")
    place = F.row_number().over(Window.partitionBy("graph", here).orderBy("rel_id"))
    inside = g.entities.select("graph", F.col("id").alias("up"))
    step = e.withColumn("ordinal", place).where(F.col("ordinal") <= PER_NODE).select("graph", F.col(here).alias("head"), F.col(there).alias("up"), "ordinal", F.col("type").alias("via"))
    step = cut(step.join(inside, ["graph", "up"], "left_semi"))
    chains = starts.select("graph", "root").distinct().select("graph", "root", F.col("root").alias("id"), F.array().cast("array<int>").alias("ordinals"), F.lit("").alias("type"))
    found = None
    for _ in range(depth):
        chains = chains.withColumnRenamed("id", "head").join(step, ["graph", "head"]).where("up <> root")
        chains = cut(chains.select("graph", "root", F.col("up").alias("id"), F.concat("ordinals", F.array("ordinal")).alias("ordinals"), F.col("via").alias("type")))
        found = chains if found is None else found.unionByName(chains)
    steps = found.groupBy("graph", "root").applyInPandas(_first_visits, "graph string, root string, id string, depth int, place int, type string").withColumnRenamed("type", "relationship")
    return steps.join(g.entities.select("graph", "id", "name", "type"), ["graph", "id"]).select("graph", "root", "place", "id", "name", "type", "depth", "relationship")


def call_graph(g: KnowledgeGraph, starts: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes around each start and the edges between them, for drawing."""
    nodes = navigate(g, starts, "both", depth)
    e = g.relationships.select("graph", F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "type").distinct()
    a = nodes.select("graph", "root", F.col("id").alias("src"), F.col("name").alias("source"))
    b = nodes.select("graph", "root", F.col("id").alias("dst"), F.col("name").alias("target"))
    return nodes, e.join(a, ["graph", "src"]).join(b, ["graph", "root", "dst"]).select("graph", "root", "source", "target", "type").distinct()


#: Pairs of neighbours of one graph, both ways, beyond which its labels go round by joins, as they would fill a task's memory.
PAIRS_IN_A_TASK = 30_000_000

#: Pairs of neighbours whose labels are counted at once.
PAIRS_AT_ONCE = 2_000_000


def _settle(starts: np.ndarray, near: np.ndarray, rounds: int | None) -> np.ndarray:
    """The label of each node after all rounds; node ``k`` has the neighbours ``near[starts[k] : starts[k + 1]]``.

    Labels are the numbers of nodes.  A round looks only at nodes of which a neighbour took another
    label in the round before, as the others would choose what they have.
    """
    count = len(starts) - 1
    labels, active = np.arange(count, dtype=np.int32), np.arange(count)
    moved = was = active[:0]

    def parts(nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Some of the nodes at a time, with their numbers of neighbours and their neighbours."""
        ends = np.cumsum(starts[nodes + 1] - starts[nodes])
        cuts = np.unique(np.searchsorted(ends, np.arange(PAIRS_AT_ONCE, ends[-1], PAIRS_AT_ONCE)))
        for some in np.split(nodes, cuts):
            if len(some):
                n = starts[some + 1] - starts[some]
                yield some, n, near[np.repeat(starts[some] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def choice(n: np.ndarray, others: np.ndarray) -> np.ndarray:
        ballots = np.repeat(np.arange(len(n)) * count, n) + labels[others]
        ballots.sort()
        first = np.flatnonzero(np.diff(ballots, prepend=-1))
        votes = np.diff(first, append=len(ballots))
        voter, label = np.divmod(ballots[first], count)
        own = np.flatnonzero(np.diff(voter, prepend=-1))
        best = np.flatnonzero(votes == np.maximum.reduceat(votes, own)[voter])
        return label[best[np.flatnonzero(np.diff(voter[best], prepend=-1))]].astype(np.int32)

    turn = 0
    while len(active) and (rounds is None or turn < rounds):
        turn += 1
        chosen, old = np.concatenate([choice(n, others) for _, n, others in parts(active)]), labels[active]
        new = chosen != old
        last, before = moved, was
        moved, was, chosen = active[new], old[new], chosen[new]
        if not len(moved):
            break
        if np.array_equal(moved, last) and np.array_equal(chosen, before):  # the labels of the last round but one
            labels[moved] = np.minimum(chosen, was)
            break
        labels[moved] = chosen
        touched = np.zeros(count, bool)
        for _, _, others in parts(moved):
            touched[others] = True
        active = np.flatnonzero(touched)
    return labels


def _settled(rounds: int | None):
    """Labels of whole graphs; rows (key, a, b) come by key, a and b, pairs of neighbours both ways and each node with itself, some of them twice."""

    def solve(key: int, heads: list[np.ndarray], degrees: list[np.ndarray], near: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        starts = np.zeros(int(heads[-1][-1]) + 2, np.int64)
        np.add.at(starts, np.concatenate(heads) + 1, np.concatenate(degrees))
        pairs = np.concatenate(near)
        near.clear()
        labels = _settle(np.cumsum(starts), pairs, rounds)
        for at in range(0, len(labels), 100_000):
            some = labels[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), key)), pa.array(np.arange(at, at + len(some), dtype=np.int32)), pa.array(some)], schema=_LABEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pieces = (-1, -1, -1), ([], [], [])
        for batch in batches:
            key, a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(key):
                continue
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            fresh[0] = (key[0], a[0], b[0]) != last
            last_key, last = last[0], (key[-1], a[-1], b[-1])
            key, a, b = key[fresh], a[fresh], b[fresh]
            for some in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key)) + 1):
                if not len(some):
                    continue
                if pieces[0] and key[some[0]] != last_key:
                    yield from solve(last_key, *pieces)
                    pieces = ([], [], [])
                last_key = key[some[0]]
                for piece, rows in zip(pieces, (*np.unique(a[some], return_counts=True), b[some])):
                    piece.append(rows)
        if pieces[0]:
            yield from solve(last[0], *pieces)

    return run


_LABEL = pa.schema([("key", pa.int64()), ("node", pa.int32()), ("label", pa.int32())])


def communities(g: KnowledgeGraph, rounds: int | None = None, in_a_task: int = PAIRS_IN_A_TASK) -> DataFrame:
    """(graph, id, community) by label propagation: each round a node takes its neighbours' most frequent label, the smallest of equals.

    A node counts among its own neighbours, so that two of them do not swap labels for ever.
    Without a number of rounds each graph goes on until no label changes or the labels are those of
    the last round but one, a cycle of two, of which the smaller label of each node is taken.  The
    pairs of neighbours of a graph, as numbers, go to one task that does all rounds; graphs of more
    than ``in_a_task`` pairs go round by joins, with the same rows.
    """
    edges = stored(g.adjacency().where("graph is not null"))
    graphs = stored(edges.groupBy("graph").agg((F.count(F.lit(1)) * 2 > in_a_task).alias("large")).withColumn("key", F.monotonically_increasing_id()))
    ids = edges.select("graph", F.col("src").alias("id")).unionByName(edges.select("graph", F.col("dst").alias("id"))).distinct()
    # Numbers in the order of the ids, so that the smaller label is the smaller number.
    number = (F.row_number().over(Window.partitionBy("key").orderBy("id")) - 1).alias("node")
    nodes = stored(ids.join(graphs.where("not large").select("graph", "key"), "graph").select("graph", "key", "id", number))
    of = lambda name, number: nodes.select("graph", F.col("id").alias(name), F.col("node").alias(number))
    pairs = edges.join(of("src", "a"), ["graph", "src"]).join(nodes.select("graph", F.col("id").alias("dst"), F.col("node").alias("b"), "key"), ["graph", "dst"]).selectExpr("key", "stack(2, a, b, b, a) as (a, b)")
    pairs = pairs.unionByName(nodes.selectExpr("key", "node as a", "node as b")).repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    labels = stored(pairs.sortWithinPartitions("key", "a", "b").mapInArrow(_settled(rounds), "key long, node int, label int"))
    found = labels.join(nodes, ["key", "node"]).join(nodes.select("key", F.col("node").alias("label"), F.col("id").alias("community")), ["key", "label"]).select("graph", "id", "community")
    large = graphs.where("large").select("graph")
    if large.isEmpty():
        return found
    return found.unionByName(_labels_by_joins(edges.join(large, "graph", "left_semi"), rounds))


def _labels_by_joins(edges: DataFrame, rounds: int | None) -> DataFrame:
    """As ``communities``, for graphs of any size; a graph leaves the rounds when it has settled."""
    flip = edges.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst"))
    pairs = edges.unionByName(flip)
    pairs = stored(pairs.unionByName(pairs.select("graph", "src", F.col("src").alias("dst"))).distinct())
    labels = stored(pairs.select("graph", F.col("src").alias("id"), F.col("src").alias("community"), F.lit(None).cast("string").alias("before")).distinct())
    done, turn = [], 0
    while (rounds is None or turn < rounds) and not labels.isEmpty():
        turn += 1
        ballots = labels.select("graph", F.col("id").alias("dst"), "community")
        votes = pairs.join(ballots, ["graph", "dst"]).groupBy("graph", F.col("src").alias("id"), "community").agg(F.count(F.lit(1)).alias("n"))
        chosen = votes.groupBy("graph", "id").agg(F.min_by("community", F.struct((-F.col("n")).alias("n"), "community")).alias("chosen"))
        both = stored(labels.join(chosen, ["graph", "id"]))
        # No label moved, or all are those of the last round but one.
        stays = lambda c: F.count_if(~F.col("chosen").eqNullSafe(F.col(c))) == 0
        rest = stored(both.groupBy("graph").agg((stays("community") | stays("before")).alias("rests")).where("rests").select("graph"))
        done.append(stored(both.join(rest, "graph", "left_semi").select("graph", "id", F.least("chosen", "community").alias("community"))))
        discard(labels)
        labels = stored(both.join(rest, "graph", "left_anti").select("graph", "id", F.col("chosen").alias("community"), F.col("community").alias("before")))
        discard(both)
        discard(rest)
    return functools.reduce(DataFrame.unionByName, [*done, labels.select("graph", "id", "community")])
