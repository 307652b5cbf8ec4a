"""Parent-child links to full hierarchies.

Components are found by pointer jumping over the inner nodes only, every component is
co-located by its label, and each is walked depth first with node colouring.  Components
above ``component_limit`` nodes are never brought into one task: their columns come from
pointer jumping, by joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.references import canonical
from graphloom.session import cut, discard, stored

_WALK = "graph string, id string, root_id string, tree_depth int, kind string, cycle_id string, n_descendants long, path array<string>"


def entity_keys(entities: DataFrame) -> DataFrame:
    return entities.select("graph", canonical(F.col("id")).alias("id")).where("graph is not null and id is not null").distinct()


def parent_links(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(graph, id, parent), one row per entity that has a parent.

    Contains edges with both ends among the entities come first; of several parents the
    smallest id counts.  Other entities take the single other entity of their graph and file
    whose name equals their scope.
    """
    keys = entity_keys(entities)
    edges = (
        relationships.where(canonical(F.col("type")) == "contains")
        .select("graph", canonical(F.col("source_id")).alias("parent"), canonical(F.col("target_id")).alias("id"))
        .where("graph is not null and parent is not null and id is not null")
        .groupBy("graph", "parent", "id")
        .agg(F.lit(1).alias("n"))
    )
    edges = (
        edges.join(keys, ["graph", "id"], "left_semi")
        .join(keys.withColumnRenamed("id", "parent"), ["graph", "parent"], "left_semi")
        .groupBy("graph", "id")
        .agg(F.min("parent").alias("parent"))
    )
    rows = entities.select("graph", canonical(F.col("id")).alias("id"), "file_path", "name", "scope").where("graph is not null and id is not null and file_path is not null")
    # Of each name in a file: is it one id or two, so that self can be left out?
    named = rows.where("name is not null").groupBy("graph", "file_path", F.col("name").alias("scope")).agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.count_distinct("id").alias("ids"), F.lit(1).alias("n")
    )
    scoped = rows.where("scope is not null").select("graph", "id", "file_path", "scope", (F.col("name") == F.col("scope")).alias("own_name"))
    own = rows.where("name = scope").select("graph", "id", "file_path", "scope").distinct().withColumn("own", F.lit(True))
    tried = scoped.drop("own_name").distinct().join(named, ["graph", "file_path", "scope"]).join(own, ["graph", "id", "file_path", "scope"], "left")
    others = F.col("ids") - F.when(F.col("own"), 1).otherwise(0)
    pick = F.when(F.col("own") & (F.col("low") == F.col("id")), F.col("high")).otherwise(F.col("low"))
    by_scope = (
        tried.where(others >= 1)
        .groupBy("graph", "id")
        .agg(F.max(others).alias("most"), F.min(pick).alias("a"), F.max(pick).alias("b"))
        .where("most = 1 and a = b")
        .select("graph", "id", F.col("a").alias("parent"))
    )
    return edges.unionByName(by_scope.join(edges, ["graph", "id"], "left_anti"))


def jump_to_roots(links: DataFrame) -> DataFrame:
    """(graph, id, ptr, dist, done) of the inner nodes of ``links``, by pointer jumping.

    done: ptr is the root and dist the depth; else the node is on or below a loop.  Every round
    doubles the distance, so the rounds are the logarithm of the depth; a round that settles
    nobody proves that the rest hangs on loops.
    """
    inner = links.select("graph", F.col("parent").alias("id")).distinct()
    at_root = F.col("parent").isNull()
    state = cut(
        inner.join(links, ["graph", "id"], "left").select(
            "graph", "id", F.coalesce("parent", "id").alias("ptr"), F.when(at_root, 0).otherwise(1).alias("dist"), at_root.alias("done")
        )
    )
    waiting = state.where("not done").count()
    while waiting:
        ahead = state.select("graph", F.col("id").alias("ptr"), F.col("ptr").alias("to"), F.col("dist").alias("more"), F.col("done").alias("settled"))
        step = state.where("not done").join(ahead, ["graph", "ptr"])
        state = cut(state.where("done").unionByName(step.select("graph", "id", F.col("to").alias("ptr"), (F.col("dist") + F.col("more")).alias("dist"), F.col("settled").alias("done"))))
        left = state.where("not done").count()
        if left == waiting:
            break
        waiting = left
    return state


def loop_labels(links: DataFrame, looping: DataFrame) -> DataFrame:
    """(graph, id, loop, ring): for inner nodes on or below loops the smallest id on the loop, and whether they are on it.

    Starts afresh over those nodes alone and doubles until every pointer has passed each tail
    and each window has covered each loop.  Then the ends of the pointers are the nodes on loops.
    """
    n = looping.count()
    state = cut(looping.select("graph", "id").join(links, ["graph", "id"]).select("graph", "id", F.col("parent").alias("ptr"), F.col("id").alias("low")))
    for _ in range(max(1, math.ceil(math.log2(n + 1)))) if n else ():
        ahead = state.select("graph", F.col("id").alias("ptr"), F.col("ptr").alias("to"), F.col("low").alias("low_to"))
        state = cut(state.join(ahead, ["graph", "ptr"]).select("graph", "id", F.col("to").alias("ptr"), F.least("low", "low_to").alias("low")))
    ends = state.select("graph", F.col("id").alias("ptr"), F.col("low").alias("loop"))
    rings = state.select("graph", F.col("ptr").alias("id"), F.lit(True).alias("ring")).distinct()
    return cut(state.join(ends, ["graph", "ptr"]).join(rings, ["graph", "id"], "left").select("graph", "id", "loop", F.coalesce("ring", F.lit(False)).alias("ring")))


def closed_trees(trees: DataFrame, paths: bool = True) -> DataFrame:
    """(graph, id, n_descendants, path) of whole trees (graph, id, parent), by pointer jumping over the inner nodes.

    After k rounds a pointer is 2^k steps long, part holds the ids on those steps and total the
    children of all nodes less than 2^k steps below, so the rounds are the logarithm of the depth.
    """
    inner = trees.where("parent is not null").groupBy("graph", F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("total"))
    part = F.array("id") if paths else F.lit(None).cast("array<string>")
    state = stored(inner.join(trees, ["graph", "id"]).select("graph", "id", F.col("parent").alias("ptr"), "total", part.alias("part")))
    while not (waiting := state.where("ptr is not null")).isEmpty():
        gains = waiting.groupBy("graph", F.col("ptr").alias("id")).agg(F.sum("total").alias("gain"))
        # A pointer that has ended looks at its own node, so that no key is null and no union adds partitions.
        ahead = state.select("graph", F.col("id").alias("at"), F.col("ptr").alias("to"), F.col("part").alias("front"))
        step = state.withColumn("at", F.coalesce("ptr", "id")).join(ahead, ["graph", "at"]).join(gains, ["graph", "id"], "left")
        grown = F.when(F.col("ptr").isNull(), F.col("part")).otherwise(F.concat("front", "part"))
        step = step.select("graph", "id", F.when(F.col("ptr").isNotNull(), F.col("to")).alias("ptr"), (F.col("total") + F.coalesce("gain", F.lit(0))).alias("total"), grown.alias("part"))
        before, state = state, stored(step)
        discard(before)
    out = trees.join(state.select("graph", "id", "total"), ["graph", "id"], "left")
    path = F.lit(None).cast("array<string>")
    if paths:
        out = out.join(state.select("graph", F.col("id").alias("parent"), F.col("part").alias("front")), ["graph", "parent"], "left")
        path = F.when(F.col("parent").isNull(), F.array("id")).otherwise(F.concat("front", F.array("id")))
    return out.select("graph", "id", F.coalesce("total", F.lit(0)).cast("long").alias("n_descendants"), path.alias("path"))


def components(links: DataFrame, component_limit: int) -> DataFrame:
    """(graph, id, parent, label, on_loop, dist, ring): every linked node with its component.

    dist is the depth in trees and null where a loop is above.  The nodes at loops of a graph
    share one label while all of them together, counted, are within ``component_limit``; beyond
    it each loop is labelled by its smallest id and ring tells the nodes on it from those below.
    """
    links = cut(links)
    state = jump_to_roots(links)
    tops = state.select(
        "graph", F.col("id").alias("parent"), F.when(F.col("done"), F.col("ptr")).otherwise("").alias("label"), F.when(F.col("done"), F.col("dist")).alias("dist"), (~F.col("done")).alias("on_loop")
    )
    below = links.join(tops, ["graph", "parent"]).select("graph", "id", "parent", "label", "on_loop", (F.col("dist") + 1).alias("dist"))
    roots = state.where("dist = 0").select("graph", "id", F.lit(None).cast("string").alias("parent"), F.col("id").alias("label"), F.lit(False).alias("on_loop"), "dist")
    nodes = cut(below.unionByName(roots)).withColumn("ring", F.lit(False))
    if nodes.where("on_loop").count() <= component_limit:
        return nodes
    loops = loop_labels(links, state.where("not done").select("graph", "id"))
    relabelled = nodes.where("on_loop").drop("ring").join(loops.select("graph", F.col("id").alias("parent"), "loop"), ["graph", "parent"]).join(loops.select("graph", "id", "ring"), ["graph", "id"], "left")
    relabelled = relabelled.select("graph", "id", "parent", F.col("loop").alias("label"), "on_loop", "dist", F.coalesce("ring", F.lit(False)).alias("ring"))
    return cut(nodes.where("not on_loop").unionByName(relabelled))


WHITE, GREY, BLACK = range(3)
#: Rows, and ids in their paths, that a task holds before it hands them on.
_ROWS, _IDS = 20_000, 1_000_000


def _walk_component(nodes: list[str], parents: list[str | None], paths: bool) -> Iterator[tuple]:
    """Depth-first walk of one component: white nodes are untouched, grey ones are open, black ones closed.

    The open nodes are the path of the one that is closed; its row comes out then, so that no
    two paths are held.
    """
    children: dict[str, list[str]] = {}
    above: dict[str, str] = {}
    colour = dict.fromkeys(nodes, WHITE)
    for node, parent in zip(nodes, parents):
        if parent is not None:
            above[node] = parent
            children.setdefault(parent, []).append(node)
    for root in (n for n in nodes if n not in above):
        trail, ahead, below = [root], [iter(children.get(root, ()))], [0]
        while trail:
            node = next(ahead[-1], None)
            if node is not None:
                colour[node] = GREY
                trail.append(node)
                ahead.append(iter(children.get(node, ())))
                below.append(0)
                continue
            size = below.pop()
            yield trail[-1], root, len(trail) - 1, "tree", None, size, list(trail) if paths else None
            colour[trail.pop()] = BLACK
            ahead.pop()
            if below:
                below[-1] += size + 1
    # What no root leads to hangs on loops: go up until a grey node, whose edge is the back edge, or a black one.
    loop_of: dict[str, str] = {}
    ring: set[str] = set()
    for node in nodes:
        trail = []
        while colour[node] == WHITE:
            colour[node] = GREY
            trail.append(node)
            node = above[node]
        if trail:
            closed = trail[trail.index(node) :] if colour[node] == GREY else []
            ring.update(closed)
            loop_of.update(dict.fromkeys(trail, min(closed) if closed else loop_of[node]))
            colour.update(dict.fromkeys(trail, BLACK))
    for node, low in loop_of.items():
        yield node, low, -1, "loop" if node in ring else "below_loop", low, None, None


def _walker(paths: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by component; the last component of a batch waits for the next batch."""
        key, nodes, parents, rows = None, [], [], []
        held = 0

        def frame():
            cols = ["graph", "id", "root_id", "tree_depth", "kind", "cycle_id", "n_descendants", "path"]
            pdf = pd.DataFrame(rows, columns=cols)
            pdf["n_descendants"] = pdf["n_descendants"].astype("Int64")
            rows.clear()
            return pdf

        def close():
            nonlocal held
            if key is None:
                return
            for row in _walk_component(nodes, parents, paths):
                rows.append((key[0], *row))
                held += len(row[6] or ())
                if len(rows) >= _ROWS or held >= _IDS:
                    held = 0
                    yield frame()

        for pdf in batches:
            for graph, label, node, parent in zip(pdf["graph"], pdf["label"], pdf["id"], pdf["parent"]):
                if (graph, label) != key:
                    yield from close()
                    key, nodes, parents = (graph, label), [], []
                nodes.append(node)
                parents.append(parent)
        yield from close()
        if rows:
            yield frame()

    return run


def hierarchy(entities: DataFrame, relationships: DataFrame, paths: bool = True, component_limit: int = 500_000) -> DataFrame:
    """Every entity with root_id, tree_depth, kind, cycle_id, n_descendants and path.

    kind: ``tree``; ``loop`` (on a loop), ``below_loop``: these have depth -1, the smallest id
    on the loop as root_id and cycle_id, and no path and no n_descendants.  Entities without any
    link are trees of one node.  ``component_limit`` decides only where a component is worked
    out, in one task or by joins.
    Null keys are left out; repeated rows count once; empty tables give no rows.
    """
    return _hierarchy(entities, relationships, paths, component_limit)


def _hierarchy(entities: DataFrame, relationships: DataFrame, paths: bool, component_limit: int, sizes: bool = True) -> DataFrame:
    """As ``hierarchy``; without sizes n_descendants is not worked out for components above the limit."""
    nodes = components(parent_links(entities, relationships), component_limit)
    huge = nodes.groupBy("graph", "label", "on_loop").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > component_limit)
    is_huge = not huge.isEmpty()
    small = nodes.join(huge, ["graph", "label", "on_loop"], "left_anti") if is_huge else nodes
    walked = (
        small.select("graph", "label", "id", "parent")
        .repartition("graph", "label")
        .sortWithinPartitions("graph", "label")
        .mapInPandas(_walker(paths), _WALK)
    )
    if is_huge:
        big = nodes.join(huge, ["graph", "label", "on_loop"], "left_semi")
        if paths or sizes:
            big = stored(big)
            big = big.join(closed_trees(big.where("not on_loop"), paths), ["graph", "id"], "left")
        else:
            big = big.withColumn("n_descendants", F.lit(None).cast("long")).withColumn("path", F.lit(None).cast("array<string>"))
        walked = walked.unionByName(
            big.select(
                "graph",
                "id",
                F.col("label").alias("root_id"),
                F.coalesce("dist", F.lit(-1)).alias("tree_depth"),
                F.when(F.col("ring"), "loop").when(F.col("on_loop"), "below_loop").otherwise("tree").alias("kind"),
                F.when(F.col("on_loop"), F.col("label")).alias("cycle_id"),
                "n_descendants",
                "path",
            )
        )
    alone = entity_keys(entities).join(nodes.select("graph", "id"), ["graph", "id"], "left_anti")
    return walked.unionByName(
        alone.select(
            "graph", "id", F.col("id").alias("root_id"), F.lit(0).alias("tree_depth"), F.lit("tree").alias("kind"), F.lit(None).cast("string").alias("cycle_id"),
            F.lit(0).cast("long").alias("n_descendants"), F.array("id").alias("path"),
        )
    )


def deep_or_looping(entities: DataFrame, relationships: DataFrame, depth: int = 12, component_limit: int = 500_000) -> DataFrame:
    """(graph, id, root_id, tree_depth) of entities ``depth`` or more edges down, or with a loop above them."""
    walked = _hierarchy(entities, relationships, paths=False, component_limit=component_limit, sizes=False)
    return walked.where((F.col("tree_depth") >= depth) | (F.col("tree_depth") < 0)).select("graph", "id", "root_id", "tree_depth")


def ancestor_pairs(walked: DataFrame) -> DataFrame:
    """Closure table (graph, ancestor, id, distance) of the trees, from the paths."""
    pairs = walked.where("path is not null").select("graph", "id", F.posexplode("path").alias("pos", "ancestor"), F.size("path").alias("n"))
    return pairs.select("graph", "ancestor", "id", (F.col("n") - 1 - F.col("pos")).alias("distance")).where("distance > 0")


def cycle_edges(links: DataFrame, walked: DataFrame) -> DataFrame:
    """The edges of each loop: (graph, cycle_id, parent, id)."""
    return links.join(walked.where("kind = 'loop'").select("graph", "id", "cycle_id"), ["graph", "id"]).select("graph", "cycle_id", "parent", "id")
