from __future__ import annotations

import random

from graphloom.operators import hierarchy as h

ENT = "graph string, id string, name string, file_path string, scope string"
REL = "graph string, source_id string, target_id string, type string"


def rows(frame, ents, rels, **kw):
    return {(r.graph, r.id): r for r in h.hierarchy(frame(ents, ENT), frame(rels, REL), **kw).collect()}


def entity(i, name=None, file="f", scope=None, graph="g"):
    return (graph, i, name or i, file, scope)


def test_tree_loop_and_scope(frame):
    ents = [entity(x) for x in ("r", "a", "b", "c", "l1", "l2", "t", "self", "alone")] + [entity("m", scope="Owner"), entity("o", name="Owner"), entity("dup1", name="Twice"), entity("dup2", name="Twice"), entity("d", scope="Twice"), entity("me", name="Me", scope="Me")]
    rels = [("g", "R ", "a", " Contains"), ("g", "a", "b", "contains"), ("g", "a", "b", "contains"), ("g", "b", "c", "contains"), ("g", "l1", "l2", "contains"), ("g", "l2", "l1", "contains"), ("g", "l2", "t", "contains"), ("g", "self", "self", "contains"), ("g", "a", "r", "calls"), ("g", "ghost", "alone", "contains")]
    out = rows(frame, ents, rels)
    assert [(out["g", x].tree_depth, out["g", x].root_id) for x in "rabc"] == [(0, "r"), (1, "r"), (2, "r"), (3, "r")]
    assert out["g", "c"].path == ["r", "a", "b", "c"] and out["g", "r"].n_descendants == 3
    assert [(out["g", x].kind, out["g", x].root_id) for x in ("l1", "l2", "t", "self")] == [("loop", "l1"), ("loop", "l1"), ("below_loop", "l1"), ("loop", "self")]
    assert out["g", "m"].root_id == "o" and out["g", "d"].tree_depth == 0 and out["g", "me"].tree_depth == 0 and out["g", "alone"].tree_depth == 0
    assert len(out) == len(ents)


def test_random_forest_against_brute_force_also_beyond_the_limit(frame):
    rng = random.Random(5)
    n = 300
    parent = {i: rng.randrange(max(0, i - 6), i) if rng.random() < 0.95 else None for i in range(1, n)} | {0: None}
    parent[50], parent[7] = 290, 60
    ents = [entity(f"n{i:03d}") for i in range(n)]
    rels = [("g", f"n{p:03d}", f"n{i:03d}", "contains") for i, p in parent.items() if p is not None]

    def expect(i):
        d, x, seen = 0, i, []
        while parent[x] is not None:
            if x in seen:
                ring = seen[seen.index(x) :]
                return f"n{min(ring):03d}", -1
            seen.append(x)
            x, d = parent[x], d + 1
        return f"n{x:03d}", d

    want = {f"n{i:03d}": expect(i) for i in range(n)}
    for limit in (500_000, 20, 3):
        got = {k[1]: (r.root_id, r.tree_depth) for k, r in rows(frame, ents, rels, component_limit=limit).items()}
        assert got == want, limit


def test_all_columns_are_the_same_on_both_sides_of_the_limit(frame):
    rng = random.Random(8)
    n = 60
    parent = {i: rng.randrange(max(0, i - 5), i) if rng.random() < 0.95 else None for i in range(1, n)} | {0: None}
    parent[30], parent[4], parent[11] = 50, 20, 11
    ents = [entity(f"n{i:03d}") for i in range(n)] + [entity(f"d{i:02d}") for i in range(20)]
    rels = [("g", f"n{p:03d}", f"n{i:03d}", "contains") for i, p in parent.items() if p is not None] + [("g", f"d{i:02d}", f"d{i + 1:02d}", "contains") for i in range(19)]
    want = rows(frame, ents, rels)
    assert {r.kind for r in want.values()} == {"tree", "loop", "below_loop"} and want["g", "d00"].n_descendants == 19
    for limit in (3,):
        assert rows(frame, ents, rels, component_limit=limit) == want, limit
    walked = h.hierarchy(frame(ents, ENT), frame(rels, REL), component_limit=3)
    assert h.ancestor_pairs(walked).count() == sum(r.tree_depth for r in want.values() if r.kind == "tree")
    links = h.parent_links(frame(ents, ENT), frame(rels, REL))
    assert {(r.parent, r.id) for r in h.cycle_edges(links, walked).collect()} == {(f"n{parent[int(k[1][1:])]:03d}", k[1]) for k, r in want.items() if r.kind == "loop"}


def test_closure_and_found(frame):
    ents = [entity(f"c{i:02d}") for i in range(15)]
    rels = [("g", f"c{i:02d}", f"c{i + 1:02d}", "contains") for i in range(14)]
    deep = h.deep_or_looping(frame(ents, ENT), frame(rels, REL)).collect()
    assert sorted((r.id, r.root_id, r.tree_depth) for r in deep) == [("c12", "c00", 12), ("c13", "c00", 13), ("c14", "c00", 14)]
    assert h.ancestor_pairs(h.hierarchy(frame(ents, ENT), frame(rels, REL))).count() == 15 * 14 // 2


def test_nulls_repeats_and_empty_tables(frame):
    ents = [entity("a"), entity("a"), (None, "a", "a", "f", None), ("g", None, "x", "f", "y"), ("g", "b", None, None, None)]
    rels = [("g", "a", "b", "contains"), (None, "a", "b", "contains"), ("g", None, "b", "contains"), ("g", "a", "b", None)]
    out = rows(frame, ents, rels)
    assert {k[1]: r.tree_depth for k, r in out.items()} == {"a": 0, "b": 1}
    assert rows(frame, [], []) == {} and rows(frame, [], rels) == {}
    assert set(rows(frame, ents, [])) == {("g", "a"), ("g", "b")}
