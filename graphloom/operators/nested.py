"""Deeply nested records to flat, linked tables.

A bottom-up tree automaton gives every entity, parameter and type expression of a record a
state from its leaves and the states of its children: a type is generic only if its arguments
are types, a parameter takes the state of its type, and the state of an entity rises with its
members.  The state is the variant of a node and routes it to exactly one typed subtype table;
entities keep their record and parent, parameters their entity and place.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PARAMETER = ("subtype", "variant", "name", "type", "base", "arguments", "default_value", "value")
ENTITY_FIELDS = (
    "record_id long, entity_no int, parent_no int, depth int, entity_id string, parent_id string, name string, type string, "
    "file_path string, line long, col long, docstring string, variant string, subtype string, n_members int, "
    "parameters array<struct<subtype:string,variant:string,name:string,type:string,base:string,arguments:array<string>,default_value:string,value:string>>"
)

# Transitions of the automaton.
# A leaf that stands for a type.
TYPE_STATES = {"text": "named", "null": "untyped"}
# Shape of a parameter by the leaves and states of its parts.
LIST_SHAPES = {1: "single", 2: "pair", 3: "triple"}
# How deep the members go: height of the deepest member to the height of the entity.
HEIGHTS = {None: "flat", "flat": "shallow", "shallow": "deep", "deep": "deep"}
# State of a parameter's type to the table of the parameter; those with a default have one of their own.
PARAMETER_TABLES = {"named": "named_parameter", "generic": "generic_parameter", "untyped": "untyped_parameter", "odd": "odd_parameter"}
DEFAULTED = "defaulted_parameter"
# Whether an entity has parameters and members to its table.
ENTITY_TABLES = {(False, False): "plain_entity", (True, False): "callable_entity", (False, True): "container_entity", (True, True): "callable_container_entity"}


def _leaf(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, str):
        return "text"
    if isinstance(value, bool):
        return "flag"
    if isinstance(value, (int, float)):
        return "number"
    return "list" if isinstance(value, list) else "object"


def _text(value) -> str | None:
    """Scalars as text, structures as JSON; lone surrogates are replaced, as Arrow takes UTF-8 only."""
    if value is None:
        return None
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return text.encode("utf-8", "replace").decode("utf-8")


def _whole(value) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) and abs(value) < 1 << 63 else None


def _type_of(parameter):
    """The part of a parameter that is its type."""
    if isinstance(parameter, dict):
        return parameter.get("type")
    return parameter[1] if isinstance(parameter, list) and len(parameter) > 1 else None


def _type_state(value, children: list) -> str:
    if isinstance(value, dict):
        arguments = value.get("args")
        sound = isinstance(value.get("base"), str) and (arguments is None or isinstance(arguments, list)) and "odd" not in children
        return "generic" if sound else "odd"
    return TYPE_STATES.get(_leaf(value), "odd")


def _parameter_state(value, children: list) -> tuple[str, str, bool]:
    """(shape, state of the type, with a default?)."""
    kind = children[0] if children else "untyped"
    if isinstance(value, dict):
        return "object", kind if isinstance(value.get("name"), str) else "odd", "default" in value
    if isinstance(value, list):
        shape = LIST_SHAPES.get(len(value), "list")
        return shape, kind if shape != "list" and isinstance(value[0], str) else "odd", shape == "triple"
    return ("bare", "untyped", False) if isinstance(value, str) else (_leaf(value), "odd", False)


def _entity_state(value: dict, children: list) -> tuple[str, str, list, int]:
    """(height, variant, states of the parameters in order, members)."""
    members = [x[0] for x in children if len(x) == 4]
    parameters = [x for x in reversed(children) if len(x) == 3]
    tallest = max(members, key=list(HEIGHTS).index) if members else None
    place = value.get("location")
    parts = [
        "located" if isinstance(place, dict) and isinstance(place.get("file"), str) else "unlocated",
        "documented" if isinstance(value.get("docstring"), str) else "undocumented",
        "_".join(sorted({k for _, k, _ in parameters})) or "no" if parameters or isinstance(value.get("parameters"), list) else "absent",
        HEIGHTS[tallest],
    ]
    return HEIGHTS[tallest], "+".join(parts), parameters, len(members)


_RULES = {"entity": _entity_state, "parameter": _parameter_state, "type": _type_state}


def run_automaton(roots: list) -> list[tuple]:
    """(role, value, place of the parent, state) of all entities, parameters and types, parents first.

    States are given from the last node to the first, so that those of the children are there.
    """
    nodes: list[tuple] = []
    stack = [("entity", x, -1) for x in reversed(roots) if isinstance(x, dict)]
    while stack:
        role, value, parent = stack.pop()
        at = len(nodes)
        nodes.append((role, value, parent))
        if role == "entity":
            members, parameters = value.get("members"), value.get("parameters")
            if isinstance(members, list):
                stack += [("entity", x, at) for x in reversed(members) if isinstance(x, dict)]
            if isinstance(parameters, list):
                stack += [("parameter", x, at) for x in reversed(parameters)]
        elif role == "parameter":
            stack.append(("type", _type_of(value), at))
        elif isinstance(value, dict) and isinstance(value.get("args"), list):
            stack += [("type", x, at) for x in value["args"]]
    children: list[list] = [[] for _ in nodes]
    states: list = [None] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        role, value, parent = nodes[i]
        states[i] = _RULES[role](value, children[i])
        if parent >= 0:
            children[parent].append(states[i])
    return [(role, value, parent, state) for (role, value, parent), state in zip(nodes, states)]


def routed_parameter(value, state: tuple[str, str, bool]) -> tuple:
    """A parameter as a row of its subtype table, in the order of _PARAMETER; odd ones are kept whole as JSON."""
    shape, kind, defaulted = state
    table = DEFAULTED if defaulted and kind != "odd" else PARAMETER_TABLES[kind]
    first = value.get("name") if isinstance(value, dict) else (value[0] if value else None) if isinstance(value, list) else value if isinstance(value, str) else None
    named = _text(first) if not isinstance(first, (dict, list)) else None
    type_ = _type_of(value)
    generic = type_ if kind == "generic" else {}
    default = value.get("default") if isinstance(value, dict) else value[2] if shape == "triple" else None
    return (
        table, f"{shape}_{kind}" + "_default" * defaulted, named, _text(type_), _text(generic.get("base")), [_text(x) for x in generic.get("args") or ()] if generic else None,
        _text(default), _text(value) if table == "odd_parameter" else None,
    )


def _no_constant(name: str):
    raise ValueError(name)


def load(payload: str | None):
    """The JSON value of a payload, None if it isn't complete JSON.

    A JSON string that holds a JSON text stands for that text.  Nesting too deep for the C
    scanner goes to the pure Python one, whose depth is only bounded by memory.
    """
    value = payload
    for _ in range(2):
        if not isinstance(value, str):
            return value
        try:
            value = json.loads(value, parse_constant=_no_constant)
        except RecursionError:
            value = _load_deep(value)
        except ValueError:
            return None
    return None if isinstance(value, str) else value


def _load_deep(text: str):
    decoder = json.JSONDecoder(parse_constant=_no_constant)
    decoder.scan_once = json.scanner.py_make_scanner(decoder)
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 10 * text.count("[") + 10 * text.count("{") + 1000))
    try:
        return decoder.decode(text)
    except (ValueError, RecursionError):
        return None
    finally:
        sys.setrecursionlimit(limit)


def flatten_record(record_id: int, payload: str | None) -> Iterator[tuple]:
    """Rows of ENTITY_FIELDS in document order; entity_no is the key within the record."""
    value = load(payload)
    top = value.get("entities") if isinstance(value, dict) else value
    if not isinstance(top, list):
        return
    nodes = run_automaton(top)
    numbers: dict[int, int] = {}
    depths: dict[int, int] = {}
    for at, (role, node, parent, state) in enumerate(nodes):
        if role != "entity":
            continue
        numbers[at] = len(numbers)
        depths[at] = depths[parent] + 1 if parent >= 0 else 0
        place = node.get("location")
        place = place if isinstance(place, dict) else {}
        _, variant, parameter_states, n_members = state
        yield (
            record_id, numbers[at], numbers.get(parent), depths[at], _text(node.get("id")) or "", _text(nodes[parent][1].get("id")) or "" if parent >= 0 else "", _text(node.get("name")),
            _text(node.get("type")), _text(place.get("file")) or "", _whole(place.get("line")), _whole(place.get("column")), _text(node.get("docstring")),
            variant, ENTITY_TABLES[bool(parameter_states), n_members > 0], n_members, [routed_parameter(p, s) for p, s in zip(node.get("parameters") or (), parameter_states)],
        )


_COLUMNS = [x.split()[0] for x in ENTITY_FIELDS.split(", ")]


def _flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for record_id, payload in zip(pdf["record_id"], pdf["payload"]):
            rows.extend(flatten_record(record_id, payload))
            if len(rows) >= 20_000:
                yield _frame(rows)
                rows = []
        if rows:
            yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=_COLUMNS)
    for c in ("parent_no", "line", "col"):
        pdf[c] = pdf[c].astype("Int64")
    pdf["parameters"] = [[dict(zip(_PARAMETER, p)) for p in ps] for ps in pdf["parameters"]]
    return pdf


def entities_table(records: DataFrame) -> DataFrame:
    """The supertype table: one row per entity at any depth, keyed by (record_id, entity_no).

    parent_no and parent_id name the entity whose members hold it (null and '' at the top);
    entity ids may repeat between records and within one.  Null, broken or empty payloads
    give no rows; members and parameters of a foreign type count as absent.
    """
    return records.select("record_id", "payload").where("payload is not null").mapInPandas(_flatten, ENTITY_FIELDS)


def parameters_table(entities: DataFrame) -> DataFrame:
    """All parameters with the keys of their entity, their place and the table that each is routed to."""
    return entities.select("record_id", "entity_no", "entity_id", "parent_id", "file_path", F.posexplode("parameters").alias("pos", "p")).select(
        "record_id", "entity_no", "entity_id", "parent_id", "file_path", "pos", "p.*"
    )


def subtype_tables(entities: DataFrame) -> dict[str, DataFrame]:
    """The typed tables: every entity and every parameter is in exactly one of them.

    All hold the common keys and links; beyond those, each has the columns of its variant.
    """
    keys = ["record_id", "entity_no", "parent_no", "entity_id", "parent_id", "file_path"]
    typed = {
        "plain_entity": [], "callable_entity": [F.size("parameters").alias("n_parameters")], "container_entity": ["n_members"],
        "callable_container_entity": [F.size("parameters").alias("n_parameters"), "n_members"],
    }
    out = {t: entities.where(F.col("subtype") == t).select(*keys, *columns) for t, columns in typed.items()}
    places = ["record_id", "entity_no", "entity_id", "parent_id", "file_path", "pos"]
    typed = {
        "named_parameter": ["name", "type"], "generic_parameter": ["name", "base", "arguments"], "untyped_parameter": ["name"],
        "defaulted_parameter": ["name", "type", "base", "arguments", "default_value"], "odd_parameter": ["name", "value"],
    }
    parameters = parameters_table(entities)
    return out | {t: parameters.where(F.col("subtype") == t).select(*places, *columns) for t, columns in typed.items()}


def parameter_rows(entities: DataFrame) -> DataFrame:
    """The parameters of all typed tables, and a row with pos -1 and an empty name per entity of a table without parameters.

    The tables are disjoint parts of the routed rows, so that their union is read in one pass
    instead of one per table.
    """
    bare = F.col("subtype").isin("plain_entity", "container_entity")
    none = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("name")))
    own = F.transform("parameters", lambda p, i: F.struct(i.alias("pos"), p["name"].alias("name")))
    return entities.select("record_id", "entity_id", "parent_id", "file_path", F.explode(F.when(bare, none).otherwise(own)).alias("p")).select(
        "record_id", "entity_id", "parent_id", "file_path", "p.pos", F.coalesce("p.name", F.lit("")).alias("param_name")
    )


def routing_counts(entities: DataFrame) -> DataFrame:
    """(subtype, n): the rows of every typed table."""
    kinds = F.explode(F.concat(F.array("subtype"), F.transform("parameters", lambda p: p["subtype"]))).alias("subtype")
    return entities.select(kinds).groupBy("subtype").agg(F.count(F.lit(1)).alias("n"))


def variant_counts(entities: DataFrame) -> DataFrame:
    """How many entities took each variant, at which depths."""
    return entities.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.min("depth").alias("least_depth"), F.max("depth").alias("most_depth"))
