"""Schemas that drift between files.

A catalogue holds, per snapshot, every field with its JSON types.  Window functions find
where the lifespan of a (stream, field) and of a (stream, field, types) begins and ends;
starts and endings that meet under one parent are compared by value, record by record, to
tell renames.  The renames make an alias table from which casts for one consistent table
are generated.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.nested import load
from graphloom.session import cut

# Fields by which records are told apart, in this order.
IDENTITIES = (("id",), ("name",), ("source_id", "target_id", "type"))


def _kind(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "object"


def field_types(value) -> dict[str, tuple[str, set[str]]]:
    """path -> (path of the object that holds it, JSON types of its non-null values).

    Keys join by '.', array elements are '[]'.  Keys may hold dots themselves, so the parent is
    kept and never cut from the path.
    """
    out: dict[str, tuple[str, set[str]]] = {}
    stack = [("", value)]
    while stack:
        path, node = stack.pop()
        if isinstance(node, dict):
            inner = [(f"{path}.{k}" if path else k, v) for k, v in node.items()]
        elif isinstance(node, list):
            inner = [(f"{path}[]", v) for v in node]
        else:
            continue
        for p, v in inner:
            types = out.setdefault(p, (path, set()))[1]
            if v is not None:
                types.add(_kind(v))
                if isinstance(v, (dict, list)):
                    stack.append((p, v))
    return out


def _utf8(text: str) -> str:
    return text.encode("utf-8", "replace").decode()


_CATALOGUE = "stream_name string, snapshot_id long, seq long, field_path string, parent string, types string"


def _catalogue(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for stream, snapshot, seq, payload in zip(pdf["stream_name"], pdf["snapshot_id"], pdf["seq"], pdf["payload"]):
            for path, (parent, types) in field_types(load(payload)).items():
                rows.append((stream, snapshot, seq, _utf8(path), _utf8(parent), ",".join(sorted(types))))
        yield pd.DataFrame(rows, columns=["stream_name", "snapshot_id", "seq", "field_path", "parent", "types"])


def ordered(snapshots: DataFrame) -> DataFrame:
    """Snapshots with their place in the stream (by taken_at, then snapshot_id) and the one before."""
    w = Window.partitionBy("stream_name").orderBy("taken_at", "snapshot_id")
    places = snapshots.select("stream_name", "snapshot_id", "taken_at").dropDuplicates(["stream_name", "snapshot_id"])
    return places.select("stream_name", "snapshot_id", "taken_at", F.row_number().over(w).cast("long").alias("seq"), F.lag("snapshot_id").over(w).alias("before_id"))


def catalogue(snapshots: DataFrame, places: DataFrame) -> DataFrame:
    """(stream_name, snapshot_id, seq, field_path, parent, types): the fields of each snapshot.

    A payload that is null or not complete JSON has no fields.  A snapshot that comes twice has
    its fields twice here; ``lifespans`` counts them once, so that no payload is moved for it.
    """
    rows = snapshots.select("stream_name", "snapshot_id", "payload").where("payload is not null")
    return rows.join(places.select("stream_name", "snapshot_id", "seq"), ["stream_name", "snapshot_id"]).mapInPandas(_catalogue, _CATALOGUE)


def lifespans(fields: DataFrame) -> DataFrame:
    """Islands of consecutive snapshots per (stream, field, types): first_seq, last_seq, snapshots.

    All steps keep the partitioning by (stream, field), so that the catalogue moves once.
    """
    w = Window.partitionBy("stream_name", "field_path").orderBy("seq")
    once = fields.repartition("stream_name", "field_path").groupBy("stream_name", "field_path", "seq").agg(F.min("parent").alias("parent"), F.min("types").alias("types"))
    follows = (F.lag("seq").over(w) == F.col("seq") - 1) & (F.lag("types").over(w) == F.col("types"))
    starts = F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)
    return (
        once.withColumn("starts", starts)
        .withColumn("island", F.sum("starts").over(w))
        .groupBy("stream_name", "field_path", "island")
        .agg(F.min("parent").alias("parent"), F.min("types").alias("types"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("snapshots"))
        .drop("island")
    )


def starts_and_endings(spans: DataFrame, places: DataFrame) -> DataFrame:
    """(stream_name, seq, field_path, parent, event): the log of lifespans that start, end or follow one of other types.

    An ending bears the seq of the first snapshot without the field.  Fields of a stream's first
    snapshot do not start.
    """
    w = Window.partitionBy("stream_name", "field_path").orderBy("first_seq")
    last = places.groupBy("stream_name").agg(F.max("seq").alias("end_seq"))
    seen = spans.select(
        "stream_name", "field_path", "parent", "types", "first_seq", "last_seq", F.lag("last_seq").over(w).alias("seq_before"), F.lag("types").over(w).alias("types_before"), F.lead("first_seq").over(w).alias("seq_after")
    ).join(last, "stream_name")
    follows = F.coalesce(F.col("seq_before") == F.col("first_seq") - 1, F.lit(False))
    goes_on = F.coalesce(F.col("seq_after") == F.col("last_seq") + 1, F.lit(False))
    log = lambda seq, event: F.struct(seq.alias("seq"), F.lit(event).alias("event"))
    event = F.array_compact(
        F.array(
            F.when(~follows & (F.col("first_seq") > 1), log(F.col("first_seq"), "added")),
            F.when(follows & (F.col("types") != "") & (F.col("types_before") != ""), log(F.col("first_seq"), "retyped")),
            F.when((F.col("last_seq") < F.col("end_seq")) & ~goes_on, log(F.col("last_seq") + 1, "removed")),
        )
    )
    events = seen.select("stream_name", "field_path", "parent", F.explode(event).alias("e")).select("stream_name", "e.seq", "field_path", "parent", "e.event")
    return events.where("event = 'retyped' or field_path not like '%[]'")


def records_of(value, parent: str) -> list[tuple[tuple, dict]]:
    """The objects at the path ``parent``, each with the array elements around it."""
    found: list[tuple[tuple, dict]] = []
    stack: list[tuple[object, str, tuple]] = [(value, "", ())]
    while stack:
        node, path, chain = stack.pop()
        if path == parent and isinstance(node, dict):
            found.append((chain, node))
        if not parent.startswith(path):
            continue
        if isinstance(node, list):
            stack += [(x, f"{path}[]", (*chain, x if isinstance(x, dict) else None)) for x in node]
        elif isinstance(node, dict):
            stack += [(v, f"{path}.{k}" if path else k, chain) for k, v in node.items() if isinstance(v, (dict, list))]
    return found


def _identity_keys(before: list[dict], after: list[dict], skip: set[str]) -> tuple[str, ...]:
    """Fields that name a record in both snapshots: as few as tell the records apart."""

    def usable(records: list[dict], k: str) -> set[str]:
        return {_kind(r[k]) for r in records if r.get(k) is not None} & {"string", "number"}

    for keys in IDENTITIES:
        kept = tuple(k for k in keys if k not in skip and usable(before, k) and usable(before, k) == usable(after, k))
        if kept:
            return kept
    shared = {k for r in before for k in r} & {k for r in after for k in r}
    return tuple(sorted(k for k in shared if k not in skip and usable(before, k) and usable(before, k) == usable(after, k)))


def takes_over(before, after, parent: str, old: str, new: str) -> bool:
    """Does the key ``new`` under ``parent`` carry the values of ``old`` in the shared records?

    Records are matched by their identity fields; where an identity is not unique the smaller
    set of values must lie in the larger.  All pairs must agree and one must not be null.
    """
    left, right = records_of(before, parent), records_of(after, parent)
    skip = {old, new}
    depth = max((len(c) for c, _ in left + right), default=0)
    keys = [_identity_keys([c[i] for c, _ in left if c[i]], [c[i] for c, _ in right if c[i]], skip) for i in range(depth)]

    def grouped(rows, name):
        out: dict[tuple, Counter] = defaultdict(Counter)
        for chain, node in rows:
            if name in node:
                who = tuple(tuple(json.dumps(r.get(k)) for k in ks) if r else None for r, ks in zip(chain, keys))
                out[who][json.dumps(node[name], sort_keys=True)] += 1
        return out

    a, b = grouped(left, old), grouped(right, new)
    solid = False
    for who in a.keys() & b.keys():
        small, large = sorted((a[who], b[who]), key=Counter.total)
        if small - large:
            return False
        solid = solid or any(v != "null" for v in small)
    return solid


_RENAMES = "stream_name string, seq long, old_path string, new_path string"


def _match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for stream, seq, gone, come, before, after in zip(pdf["stream_name"], pdf["seq"], pdf["gone"], pdf["come"], pdf["before"], pdf["after"]):
            old_value, new_value = load(before), load(after)
            free = sorted((x["parent"], x["field_path"]) for x in come)
            for parent, old in sorted((x["parent"], x["field_path"]) for x in gone):
                start = len(parent) + 1 if parent else 0
                for place, new in free:
                    if place == parent and takes_over(old_value, new_value, parent, old[start:], new[start:]):
                        rows.append((stream, seq, old, new))
                        free.remove((place, new))
                        break
        yield pd.DataFrame(rows, columns=["stream_name", "seq", "old_path", "new_path"])


def renames(events: DataFrame, snapshots: DataFrame, places: DataFrame) -> DataFrame:
    """(stream_name, seq, old_path, new_path): endings whose values a start under the same parent takes over.

    Only snapshots with both under one parent are read again.
    """
    # Keys that come or go together with their parent follow from it.
    top = _outermost(events)
    of = lambda event: F.collect_list(F.when(F.col("event") == event, F.struct("parent", "field_path")))
    met = (
        top.where("event <> 'retyped'")
        .groupBy("stream_name", "seq", "parent")
        .agg(of("removed").alias("gone"), of("added").alias("come"))
        .where("size(gone) > 0 and size(come) > 0")
        .groupBy("stream_name", "seq")
        .agg(F.flatten(F.collect_list("gone")).alias("gone"), F.flatten(F.collect_list("come")).alias("come"))
    )
    wanted = cut(met.join(places.select("stream_name", "seq", F.col("snapshot_id"), "before_id"), ["stream_name", "seq"]))
    ends = wanted.select("stream_name", F.explode(F.array("snapshot_id", "before_id")).alias("snapshot_id")).distinct()
    payloads = snapshots.select("stream_name", "snapshot_id", "payload").join(ends, ["stream_name", "snapshot_id"], "left_semi").dropDuplicates(["stream_name", "snapshot_id"])
    both = wanted.join(payloads.withColumnRenamed("payload", "after"), ["stream_name", "snapshot_id"]).join(
        payloads.select("stream_name", F.col("snapshot_id").alias("before_id"), F.col("payload").alias("before")), ["stream_name", "before_id"]
    )
    return both.select("stream_name", "seq", "gone", "come", "before", "after").mapInPandas(_match, _RENAMES)


def _outermost(changes: DataFrame, path: str = "field_path") -> DataFrame:
    """Changes without those beneath a path that is itself changed in the same snapshot."""
    reported = changes.groupBy("stream_name", "seq").agg(F.collect_set(path).alias("reported"))
    beneath = F.exists("reported", lambda p: F.startswith(F.col(path), F.concat(p, F.lit("."))) | F.startswith(F.col(path), F.concat(p, F.lit("[]"))))
    return changes.join(reported, ["stream_name", "seq"]).where(~beneath).drop("reported")


def schema_changes(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, change_kind, field_path, new_path) of every snapshot against the one before in its stream.

    change_kind: added, removed, renamed, retyped; new_path is '' unless renamed.  Nothing is
    reported beneath a reported path.  The first snapshot of a stream reports nothing; ties in
    taken_at go by snapshot_id; a snapshot that is sent again unchanged changes nothing; null
    stream names form no stream; empty tables give no rows.
    """
    named = snapshots.where("stream_name is not null and snapshot_id is not null")
    places = cut(ordered(named))
    events = cut(starts_and_endings(lifespans(catalogue(named, places)), places))
    moved = cut(renames(events, named, places))
    # A rename takes both of its paths out of the plain events, and hides what is beneath them.
    ended = moved.select("stream_name", "seq", F.col("old_path").alias("field_path"), F.lit("removed").alias("event"))
    began = moved.select("stream_name", "seq", F.col("new_path").alias("field_path"), F.lit("added").alias("event"))
    plain = _outermost(events).join(ended.unionByName(began), ["stream_name", "seq", "field_path", "event"], "left_anti")
    changes = plain.select("stream_name", "seq", F.col("event").alias("change_kind"), "field_path", F.lit("").alias("new_path")).unionByName(
        moved.select("stream_name", "seq", F.lit("renamed").alias("change_kind"), F.col("old_path").alias("field_path"), "new_path")
    )
    return changes.join(places.select("stream_name", "seq", "snapshot_id"), ["stream_name", "seq"]).select("snapshot_id", "change_kind", "field_path", "new_path")


# --- one consistent table -------------------------------------------------------------

# Fields of entities whose names win over their aliases, and their Spark types; all others follow the data.
ENTITY_CASTS = {
    "id": "string", "name": "string", "type": "string", "location.file": "string", "location.line": "bigint", "location.column": "bigint",
    "docstring": "string", "parameters": "string", "return_type": "string", "is_async": "boolean", "class_id": "string",
}

# Lists of records that also come as objects, with the fields that their keys and plain values take.
KEYED = {"frameworks": ("name", "value"), "file_hashes": ("path", "hash")}

#: Fields beyond so many, by frequency, have no column of their own and stay in ``other``.
COLUMNS = 400

_RECORDS = "stream_name string, snapshot_id long, record_path string, record_no long, fields map<string,struct<kind:string,value:string>>"


def _leaf(value) -> tuple[str, str]:
    """(kind, text) of a value that is not null; structures are JSON."""
    kind = _kind(value)
    if kind == "number":
        kind = "integer" if isinstance(value, int) else "double"
    elif kind == "array" and len(value) == 1 and isinstance(value[0], str):
        kind = "one"
    return kind, _utf8(value if isinstance(value, str) else json.dumps(value))


def _record(value, path: str, aliases: dict[str, str], skip: frozenset[str] = frozenset()) -> dict[str, tuple[str, str]]:
    """All fields of a record, inner ones joined by '.', under the names of ``aliases``.

    Objects are there beside their fields.  Of two names for one field the canonical one counts,
    the other stays under its own name.
    """
    found: list[tuple[str, str, object]] = []
    stack = [("", "", value)]
    while stack:
        raw, name, node = stack.pop()
        for k, v in node.items():
            inner = f"{raw}.{k}" if raw else k
            if v is None or (not raw and k in skip):
                continue
            known = aliases.get(path + inner) or (f"{name}.{k}" if name else k)
            found.append((inner, known, v))
            if isinstance(v, dict) and v:
                stack.append((inner, known, v))
    out: dict[str, tuple[str, str]] = {}
    for raw, name, v in sorted(found, key=lambda x: (x[0] != x[1], x[0])):
        out[_utf8(raw if name in out else name)] = _leaf(v)
    return out


def _records(shared: dict[str, str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, dict[str, str]] = {}
        for pdf in batches:
            rows = []
            for stream, snapshot, payload, renames in zip(pdf["stream_name"], pdf["snapshot_id"], pdf["payload"], pdf["renames"]):
                pairs = tuple((r["field_path"], r["new_path"]) for r in renames) if renames is not None else ()
                if pairs not in known:
                    known = {pairs: shared | resolve_aliases(list(pairs))}
                aliases = known[pairs]
                value = load(payload)
                if value is None:
                    continue
                value = value if isinstance(value, dict) else {"value": value}
                lists = set()
                for k, v in value.items():
                    name = aliases.get(k, k)
                    if name in KEYED and isinstance(v, dict):
                        key, plain = KEYED[name]
                        # A field that bears the key's name is kept beside it.
                        v = [({key: x, **y} if y.get(key, x) == x else {**y, f"{key}.key": x}) if isinstance(y, dict) else {key: x, plain: y} for x, y in v.items()]
                    if isinstance(v, list) and any(isinstance(x, dict) for x in v):
                        lists.add(k)
                        for n, x in enumerate(v):
                            if x is not None:
                                rows.append((stream, snapshot, _utf8(f"{name}[]"), n, _record(x if isinstance(x, dict) else {"value": x}, f"{name}[].", aliases)))
                top = _record(value, "", aliases, frozenset(lists))
                if top:
                    rows.append((stream, snapshot, "", 0, top))
            pdf = pd.DataFrame(rows, columns=["stream_name", "snapshot_id", "record_path", "record_no", "fields"])
            pdf["fields"] = [{k: {"kind": a, "value": b} for k, (a, b) in x.items()} for x in pdf["fields"]]
            yield pdf

    return run


def _place(path: str, tops: dict[str, str]) -> str | None:
    """A catalogued path with keys of keyed lists as '[]' and the canonical name of the list; null for keys themselves."""
    for raw in sorted({*KEYED, *(k for k, v in tops.items() if v in KEYED)}):
        if path.startswith(f"{raw}."):
            inner = path[len(raw) + 1 :].split(".", 1)
            return f"{tops.get(raw, raw)}[].{inner[1]}" if len(inner) == 2 and tops.get(raw, raw) != "file_hashes" else None
    head, mark, rest = path.partition("[].")
    return f"{tops.get(head, head)}[].{rest}" if mark else path


def resolve_aliases(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """path -> canonical name of the field in its record, over chains of renames (old, new) of any length.

    The canonical name is a fixed one if the chain has one, else the name that nothing was renamed to.
    """
    fixed = {f"entities[].{f}" for f in ENTITY_CASTS} | {"entities", "relationships", *KEYED}

    def resolved(links: list[tuple[str, str]]) -> dict[str, str]:
        olds, news = defaultdict(set), defaultdict(set)
        for old, new in links:
            olds[new].add(old)
            news[old].add(new)
        names = sorted({*olds, *news})
        best: dict[str, str] = {}
        # Fixed names first, then those that nothing was renamed to, then any; the smallest of a kind takes all that comes of it, each name once.
        for kind in ([x for x in names if x in fixed], [x for x in names if not olds.get(x)], names):
            taken: dict[str, str] = {}
            for first in kind:
                todo = [first]
                while todo:
                    name = todo.pop()
                    if name not in taken:
                        taken[name] = first
                        todo += news.get(name, ())
            best = taken | best
        return {new: best[new] for new in olds if new not in fixed}

    tops = resolved([(a, b) for a, b in pairs if "[]" not in a and "." not in a])
    inner = [(_place(a, tops), _place(b, tops)) for a, b in pairs if a.split("[]")[0] != a or "." in a]
    found = resolved([(a, b) for a, b in inner if a and b and a != b])
    return tops | {new: old.split("[].", 1)[-1] for new, old in found.items()}


def alias_table(snapshots: DataFrame, changes: DataFrame) -> DataFrame:
    """(stream_name, renames): the renames (field_path, new_path) of each stream; keys of file_hashes are data and left out."""
    moved = changes.where("change_kind = 'renamed'").where(~F.col("field_path").startswith("file_hashes.")).select("snapshot_id", "field_path", "new_path")
    streams = snapshots.select("snapshot_id", "stream_name").join(moved.select("snapshot_id").distinct(), "snapshot_id", "left_semi").distinct()
    return moved.join(streams, "snapshot_id").groupBy("stream_name").agg(F.array_sort(F.collect_set(F.struct("field_path", "new_path"))).alias("renames"))


def shared_aliases(aliases: DataFrame) -> dict[str, str]:
    """Aliases from the renames of all streams, for names that a stream never renamed itself.

    Each pair of names counts once, however many streams and snapshots have it.
    """
    pairs = aliases.select(F.explode("renames").alias("r")).select("r.*").distinct().collect()
    return resolve_aliases(sorted((r[0], r[1]) for r in pairs))


def _column_types(records: DataFrame) -> dict[str, tuple[str, bool]]:
    """field -> (type, whether lists of one text stand for that text), the commonest type of its values.

    Fields that are always objects have no column, as their own fields have.
    """
    kinds = records.select(F.explode("fields").alias("field", "leaf")).groupBy("field", "leaf.kind").count()
    fields = kinds.groupBy("field").agg(F.map_from_entries(F.collect_list(F.struct("kind", "count"))).alias("kinds"), F.sum("count").alias("n"))
    counted = fields.where("size(kinds) > 1 or not map_contains_key(kinds, 'object')").orderBy(F.desc("n"), "field").limit(COLUMNS).collect()
    out: dict[str, tuple[str, bool]] = {}
    taken = {"stream_name", "snapshot_id", "record_path", "record_no", "other"}
    for r in sorted(counted, key=lambda r: (r.field not in ENTITY_CASTS, r.field)):
        name = r.field.removeprefix("location.") if r.field in ENTITY_CASTS else r.field
        if name.lower() in taken or len(name) > 200:
            continue
        taken.add(name.lower())
        count = lambda *ks: sum(r.kinds.get(k, 0) for k in ks)  # noqa: E731, B023
        number, text, flag, lists = count("integer", "double"), count("string"), count("boolean"), count("array", "one")
        kind = "string" if max(text, lists, count("object")) >= max(number, flag) else "boolean" if flag > number else "double" if count("double") else "bigint"
        out[r.field] = ENTITY_CASTS.get(r.field, kind), number + text + flag > lists
    return out


def consistent_entities(snapshots: DataFrame, changes: DataFrame) -> DataFrame:
    """All records of all snapshots in one schema: aliases resolved, values cast.

    record_path names the list a record is in (entities[], relationships[], ...) and is '' for
    what a snapshot holds beside its lists.  Each field that occurs has a column of the
    commonest type of its values; structures are JSON text.  Values that do not cast become null
    there and stay in the map ``other``, as do values whose field has no column.  A stream's own
    renames count first; a name that it never renamed takes the alias that other streams gave it.
    """
    rows = snapshots.select("stream_name", "snapshot_id", "payload").where("payload is not null").dropDuplicates(["stream_name", "snapshot_id"])
    aliases = cut(alias_table(snapshots, changes))
    records = cut(rows.join(aliases, "stream_name", "left").mapInPandas(_records(shared_aliases(aliases)), _RECORDS))
    columns = _column_types(records)
    values, fits = [], []
    for field, (kind, unwrap) in columns.items():
        leaf = F.col("fields")[F.lit(field)]
        text = F.when(leaf["kind"] == "one", F.get_json_object(leaf["value"], "$[0]")).otherwise(leaf["value"]) if unwrap else leaf["value"]
        value = text.try_cast(kind)
        if kind == "double":  # more digits than a double holds
            value = F.when((F.length(text) <= 15) | (leaf["kind"] == "double"), value)
        name = field.removeprefix("location.") if field in ENTITY_CASTS else field
        values.append(value.alias(name))
        if kind != "string":
            fits.append(F.when(leaf.isNotNull() & value.isNull(), F.lit(field)))
    names = F.array(*map(F.lit, columns)) if columns else F.array().cast("array<string>")
    lost = F.array_compact(F.array(*fits)) if fits else F.array().cast("array<string>")
    kept = F.map_filter("fields", lambda k, v: (~F.array_contains(names, k) & (v["kind"] != "object")) | F.array_contains(lost, k) | (~F.array_contains(names, k) & (v["value"] == "{}")))
    return records.select("stream_name", "snapshot_id", "record_path", "record_no", *values, F.transform_values(kept, lambda k, v: v["value"]).alias("other"))
