from __future__ import annotations

import json

from graphloom.operators import nested as n

REC = "record_id long, payload string"


def params(frame, *payloads):
    df = n.parameter_rows(n.entities_table(frame([(i, p) for i, p in enumerate(payloads)], REC)))
    return sorted(tuple(r) for r in df.collect())


ENTITY = {"id": "c", "location": {"file": "f.py", "line": 3}, "parameters": [["a", "int"], ["b"], {"name": "d", "type": {"base": "list"}, "default": None}, "e", 5, None, []], "members": [{"id": "m", "location": None, "parameters": None, "members": [{"id": "x", "parameters": []}]}]}


def test_every_shape_at_every_depth(frame):
    got = params(frame, json.dumps({"entities": [ENTITY]}))
    names = ["a", "b", "d", "e", "", "", ""]
    assert got == sorted([(0, "c", "", "f.py", i, x) for i, x in enumerate(names)] + [(0, "m", "c", "", -1, ""), (0, "x", "m", "", -1, "")])


def test_wrapped_broken_null_and_odd_payloads(frame):
    whole = json.dumps({"entities": [{"id": "a"}]})
    got = params(frame, json.dumps(whole), whole[:-1], None, "", "null", "[]", "5", '"text"', '{"entities": null}', '{"entities": [null, 3]}', '{"entities": [{"id": "a", "members": 3, "parameters": {"a": 1}}]}', whole + "x", '{"entities": [{"id": NaN}]}', '{"entities":[{"id":"\\ud800"}]}')
    assert got == [(0, "a", "", "", -1, ""), (10, "a", "", "", -1, ""), (13, "?", "", "", -1, "")]


def test_very_deep_and_very_long(frame):
    deep: dict = {"id": "leaf"}
    text = json.dumps(deep)
    for i in range(3000):
        text = f'{{"id": "n{i}", "members": [{text}]}}'
    got = params(frame, f'{{"entities": [{text}]}}', json.dumps({"entities": [{"id": "w", "parameters": [["p" * 100_000]]}]}))
    assert len(got) == 3002 and (0, "leaf", "n0", "", -1, "") in got and got[-1][5] == "p" * 100_000


def test_links_and_subtypes(frame):
    entities = n.entities_table(frame([(1, json.dumps({"entities": [ENTITY, ENTITY]}))] * 2, REC))
    assert entities.count() == 12
    tables = n.subtype_tables(entities)
    assert {k: v.count() for k, v in tables.items()} == {
        "plain_entity": 4, "callable_entity": 0, "container_entity": 4, "callable_container_entity": 4,
        "named_parameter": 4, "generic_parameter": 0, "untyped_parameter": 8, "defaulted_parameter": 4, "odd_parameter": 12,
    }
    assert sum(v.count() for v in tables.values()) == 12 + n.parameters_table(entities).count() == sum(r.n for r in n.routing_counts(entities).collect())
    assert {(r.name, r.base, r.default_value) for r in tables["defaulted_parameter"].collect()} == {("d", "list", None)}
    assert {r.value for r in tables["odd_parameter"].collect()} == {"5", None, "[]"}
    assert n.variant_counts(entities).count() == 3


def test_states_rise_from_the_leaves():
    state = lambda p: n.run_automaton([{"parameters": [p]}])[1][3]
    generic = {"base": "map", "args": ["int", {"base": "list", "args": [None]}]}
    assert state(["x", generic]) == ("pair", "generic", False)
    assert state(["x", {"base": "map", "args": ["int", {"base": "list", "args": [5]}]}]) == ("pair", "odd", False)
    assert state({"name": "x", "type": generic, "default": None}) == ("object", "generic", True)
    assert [state(p) for p in ("x", ["x"], ["x", None, 1], [1], {}, 3)] == [("bare", "untyped", False), ("single", "untyped", False), ("triple", "untyped", True), ("single", "odd", False), ("object", "odd", False), ("number", "odd", False)]
    nodes = n.run_automaton([{"members": [{"members": [{}]}, {}]}])
    assert [s[0] for *_, s in nodes] == ["deep", "shallow", "flat", "flat"]


def test_empty_table(frame):
    assert params(frame) == []
