from __future__ import annotations

import datetime as dt
import json

from graphloom.operators import drift as d

SNAP = "snapshot_id long, stream_name string, taken_at timestamp, payload string"


def changes(frame, *payloads, raw=False):
    rows = [(i, "s", dt.datetime(2024, 1, 1 + i), p if raw or p is None else json.dumps(p)) for i, p in enumerate(payloads)]
    return sorted(tuple(r) for r in d.schema_changes(frame(rows, SNAP)).collect())


def ent(i, **kw):
    return {"id": f"e{i}", **kw}


def test_added_removed_retyped_renamed(frame):
    a = {"entities": [ent(1, doc="x", line=1, location={"file": "f"}), ent(2, doc=None, line=2, location={"file": "g"})]}
    b = {"entities": [ent(1, text="x", line="1", location={"file": ["f"]}, tags=[1]), ent(2, text=None, line="2", location={"file": ["g"]}), ent(3, text="new", line="3")]}
    assert changes(frame, a, b) == [
        (1, "added", "entities[].tags", ""), (1, "renamed", "entities[].doc", "entities[].text"), (1, "retyped", "entities[].line", ""), (1, "retyped", "entities[].location.file", "")
    ]


def test_values_decide_on_a_rename(frame):
    a, b = {"entities": [ent(1, doc="x"), ent(2, doc="y")]}, {"entities": [ent(1, text="x"), ent(2, text="z")]}
    assert changes(frame, a, b) == [(1, "added", "entities[].text", ""), (1, "removed", "entities[].doc", "")]
    a, b = {"entities": [ent(1, doc=None)]}, {"entities": [ent(1, text=None)]}
    assert changes(frame, a, b) == [(1, "added", "entities[].text", ""), (1, "removed", "entities[].doc", "")]
    a, b = {"relationships": [{"source_id": "a", "target_id": "b", "type": "calls"}, {"source_id": "a", "target_id": "c", "type": "calls"}]}, {"relationships": [{"source_id": "a", "to": "c", "type": "calls"}, {"source_id": "a", "to": "b", "type": "calls"}]}
    assert changes(frame, a, b) == [(1, "renamed", "relationships[].target_id", "relationships[].to")]
    assert changes(frame, {"hashes": {"a": "1"}}, {"file_hashes": {"a": "1"}}) == [(1, "renamed", "hashes", "file_hashes")]


def test_nothing_beneath_a_reported_path(frame):
    assert changes(frame, {"a": 1}, {"a": 1, "b": {"c": [{"d": 1}]}}) == [(1, "added", "b", "")]
    assert changes(frame, {"f": [{"a": 1}]}, {"f": {"x": {"a": 1}}}) == [(1, "retyped", "f", "")]
    assert changes(frame, {"p": [1]}, {"p": ["x"]}) == [(1, "retyped", "p[]", "")]


def test_islands_order_and_resent_snapshots(frame):
    assert changes(frame, {"a": 1}, {"a": 1, "b": 1}, {"a": 1}, {"a": 1}, {"b": None, "a": 1}) == [(1, "added", "b", ""), (2, "removed", "b", ""), (4, "added", "b", "")]
    snapshots = frame([(9, "s", dt.datetime(2024, 1, 1), '{"a": 1}'), (3, "s", dt.datetime(2024, 1, 2), '{"b": 2}')] * 2, SNAP)
    assert sorted(tuple(r) for r in d.schema_changes(snapshots).collect()) == [(3, "added", "b", ""), (3, "removed", "a", "")]
    places = d.ordered(snapshots)
    assert d.lifespans(d.catalogue(snapshots, places)).count() == 2


def test_broken_null_and_empty(frame):
    assert changes(frame, '{"a": 1}', None, '{"a": 1', '{"a": 1}', raw=True) == [(1, "removed", "a", ""), (3, "added", "a", "")]
    assert changes(frame) == []
    assert d.schema_changes(frame([(1, None, None, '{"a": 1}'), (2, None, None, "{}")], SNAP)).count() == 0
    long = {"k" * 50_000: "v" * 100_000}
    assert changes(frame, {}, long)[0][1] == "added"


def test_one_consistent_table(frame):
    a = {"entities": [ent(1, name="n", docstring="x", location={"file": "f", "line": 3})]}
    b = {"entities": [ent(1, name="n", description="x", location={"path": "f", "line": "3"})]}
    c = {"entities": [ent(1, name="n", description="x", location={"path": ["f"], "line": "no"})]}
    snapshots = frame([(i, "s", dt.datetime(2024, 1, 1 + i), json.dumps(p)) for i, p in enumerate((a, b, c))], SNAP)
    table = d.consistent_entities(snapshots, d.schema_changes(snapshots)).orderBy("snapshot_id").collect()
    assert [(r.id, r.docstring, r.file, r.line) for r in table] == [("e1", "x", "f", 3), ("e1", "x", "f", 3), ("e1", "x", "f", None)]


def test_the_consistent_table_holds_every_record_and_field(frame):
    a = {"entities": [ent(1, tags=["x", "y"], docstring={"text": "d", "format": "md"})], "relationships": [{"source_id": "e1", "target_id": "e2"}], "file_hashes": {"f.py": "h1"}, "version": 2}
    b = {"frameworks": [{"name": "k", "entity_types": {"enum": 3}}, {"name": "m", "entity_types": {"enum": "many"}}], "version": 3}
    c = {"frameworks": {"k": {"entity_types": {"enum": 4}}}}
    snapshots = frame([(i, "s", dt.datetime(2024, 1, 1 + i), json.dumps(p)) for i, p in enumerate((a, b, c))] + [(0, "s", dt.datetime(2024, 1, 1), json.dumps(a))], SNAP)
    rows = d.consistent_entities(snapshots, d.schema_changes(snapshots)).collect()
    got = {(r.snapshot_id, r.record_path, r.record_no): r for r in rows}
    assert len(rows) == len(got) and set(got) == {(0, "entities[]", 0), (0, "relationships[]", 0), (0, "file_hashes[]", 0), (0, "", 0), (1, "frameworks[]", 0), (1, "frameworks[]", 1), (1, "", 0), (2, "frameworks[]", 0)}
    e = got[0, "entities[]", 0]
    assert (e.id, e.tags, e["docstring.text"], e["docstring.format"]) == ("e1", '["x", "y"]', "d", "md")
    assert got[0, "relationships[]", 0].target_id == "e2" and (got[0, "file_hashes[]", 0].path, got[0, "file_hashes[]", 0].hash) == ("f.py", "h1")
    assert [got[k].version for k in ((0, "", 0), (1, "", 0))] == [2, 3]
    assert [(r.name, r["entity_types.enum"], r.other) for r in (got[1, "frameworks[]", 0], got[1, "frameworks[]", 1], got[2, "frameworks[]", 0])] == [("k", 3, {}), ("m", None, {"entity_types.enum": "many"}), ("k", 4, {})]


def test_aliases_of_other_streams_hold_however_many_names_there_are(spark, monkeypatch):
    """beyond a number of renames the names of other streams were no longer resolved."""
    monkeypatch.setattr(d, "VOCABULARY", 2, raising=False)
    pairs = [("entities[].docstring", "entities[].text")] + [(f"f{i}", f"f{i + 1}") for i in range(5000)]
    rows = [("s", [(a, b)]) for a, b in pairs] + [("t", [("entities[].text", "entities[].words")])]
    aliases = spark.createDataFrame(rows, "stream_name string, renames array<struct<field_path:string,new_path:string>>")
    found = d.shared_aliases(aliases)
    assert found["entities[].words"] == found["entities[].text"] == "docstring" and found["f5000"] == "f0"


def test_resolved_names_by_brute_force():
    import random

    def slow(pairs):
        olds = {}
        for a, b in pairs:
            olds.setdefault(b, set()).add(a)
        out = {}
        for new in olds.keys() - {"frameworks"}:
            seen, todo = {new}, [new]
            while todo:
                more = olds.get(todo.pop(), set()) - seen
                seen |= more
                todo += more
            out[new] = min((seen & {"frameworks"}) or {x for x in seen if x not in olds} or seen)
        return out

    for seed in range(200):
        rng = random.Random(seed)
        names = [*"abcdefgh", "frameworks"]
        pairs = [tuple(rng.sample(names, 2)) for _ in range(rng.randint(1, 12))]
        assert d.resolve_aliases(pairs) == slow(pairs)
