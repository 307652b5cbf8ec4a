from __future__ import annotations

import datetime as dt
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.graph import KnowledgeGraph, clean_edges, current_entities
from graphloom.operators import documentation, evolution, guidance, lookup, mutate, quality, search, traverse
from graphloom.sources import catalogue, graph_json

T = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)


@pytest.fixture(scope="module")
def g(spark):
    e = spark.createDataFrame(
        [
            ("p", 1, "m", "app", "module", "src/app.py", 1, 0, None, None, None),
            ("p", 2, "c", "OrderStore", "class", "src/app.py", 3, 0, "Keeps the orders. if for", None, None),
            ("p", 3, "f1", "load_order", "method", "src/app.py", 5, 4, "Args:\n  a: x\n  b: y\n\nif", None, '{"parameters": [["a", "int"], ["b", null]], "return_type": "str", "is_async": false}'),
            ("p", 4, "f2", "save_order", "method", "src/app.py", 9, 4, "", None, None),
            ("p", 5, "f3", "load_order", "function", "src/app.py", 12, 0, None, None, None),
            ("q", 1, "x", "orderHelper", "function", "lib/x.js", 1, 0, "load order again", None, None),
        ],
        "graph string, seq long, id string, name string, type string, file_path string, line int, col int, docstring string, scope string, extra_data string",
    )
    r = spark.createDataFrame(
        [
            (1, "p", "m", "c", "contains"), (2, "p", "c", "f1", "contains"), (3, "p", "c", "f2", "contains"), (4, "p", "f1", "f3", "calls"), (5, "p", "f2", "f3", "calls"), (6, "p", "f1", "f3", "calls"),
            (7, "p", "m", "external:os", "imports"), (8, "p", "f3", "f3", "calls"), (9, "p", "ghost", "c", "calls"),
        ],
        "rel_id long, graph string, source_id string, target_id string, type string",
    )
    return KnowledgeGraph(e, r, spark.createDataFrame([("p", "src/app.py", "h1")], "graph string, file_path string, hash_value string"))


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def starts(g, i):
    return g.entities.where(F.col("id") == i).select("graph", F.col("id").alias("root"))


def test_current_entities_and_clean_edges(spark):
    row = lambda i, n, created, removed, ingested: ("g", 1, i, n, "class", "f", 1, 0, None, None, None, T(created), removed and T(removed), T(ingested))
    schema = "graph string, seq long, id string, name string, type string, file_path string, line int, col int, docstring string, scope string, extra_data string, created_at timestamp, removed_at timestamp, ingested_at timestamp"
    rows = [row("A ", "old", 0, 5, 0), row("a", "new", 6, None, 6), row("b", "gone", 0, 3, 0), row("c", "late", 0, None, 2), row("c", "first", 0, None, 1), row(None, "x", 0, None, 0)]
    assert sorted(tuple(r) for r in current_entities(spark.createDataFrame(rows, schema)).select("id", "name").collect()) == [("a", "new"), ("c", "late")]
    e = clean_edges(spark.createDataFrame([(1, "g", " A", "b\t", "CALLS "), (1, "g", " A", "b\t", "CALLS "), (None, "g", "a", "b", "calls")], "rel_id long, graph string, source_id string, target_id string, type string"))
    assert [tuple(r) for r in e.collect()] == [(1, "g", "a", "b", "calls")]


def test_lookups(g):
    assert ids(lookup.search_entities(g, "ORDER", "method")) == ["f1", "f2"] and len(ids(lookup.search_entities(g, "order", "constant"))) == 5
    assert ids(lookup.match_wildcard(g, "load*")) == ["f1", "f3"]
    assert {(r.graph, r.wanted): r.id for r in lookup.resolve_names(g, ["load_order", "order"]).collect()} == {("p", "load_order"): "f1", ("p", "order"): "c", ("q", "order"): "x"}
    assert {r.id: r.usage for r in lookup.usage_counts(g).collect()} == {"f3": 4, "c": 1}
    assert {(r.id, r.afferent, r.efferent) for r in lookup.coupling(g).collect()} >= {("f3", 4, 1), ("x", 0, 0), ("c", 2, 2)}
    context = [(r.category, r.place, r.other, r.other_name) for r in lookup.contexts(g).where("id = 'm' or id = 'c'").orderBy("id", "category", "place").collect()]
    assert context == [("called_by", 1, "ghost", None), ("contained_in", 1, "m", "app"), ("contains", 1, "f1", "load_order"), ("contains", 2, "f2", "save_order"), ("contains", 1, "c", "OrderStore"), ("imports", 1, "external:os", None)]
    assert [r.signature for r in lookup.signatures(g).collect()] == ["load_order(a: int, b) -> str"]
    assert {r.label for r in lookup.pair_labels(g).where("a = 'f1'").collect()} == {"calls"} and {r.label for r in lookup.pair_labels(g).where("a = 'c' and b = 'm'").collect()} == {"inverse_contains"}


def test_search_scores(g):
    top = search.semantic_search(g, "load order").collect()
    assert [(r.id, r.score) for r in top] == [("x", 3.0 + 0.5 * 2 + 2 * 0)] + [] or {r.id: r.score for r in top}["x"] == 3.0
    assert {r.id: r.score for r in search.semantic_search(g, "load_order", limit=None).collect()}["f3"] == 10.0
    thinned = search.hybrid_search(g, "order", "p").collect()
    assert [r.name for r in thinned][0] in ("OrderStore", "load_order") and len({r.name for r in thinned}) == len(thinned)
    assert {r.graph: r.high + r.medium + r.low for r in search.relevance_distribution(g, "order").collect()} == {"p": 4, "q": 1}
    assert search.recommend(g, "load_order", "p", min_relevance=0.3).first().id in ("f1", "f3")


def test_traversal(g):
    assert ids(traverse.neighbours(g, starts(g, "m"), 1)) == ["c"] and ids(traverse.neighbours(g, starts(g, "m"), 2)) == ["c", "f1", "f2"]
    assert traverse.neighbours(g, starts(g, "x"), 3).count() == 0
    pair = starts(g, "m").select("graph", F.col("root").alias("source"), F.lit("f3").alias("target"))
    assert [tuple(r)[3:] for r in traverse.shortest_paths(g, pair).collect()] == [(4 - 1, ["m", "c", "f1", "f3"])]
    assert traverse.shortest_paths(g, pair, max_depth=2).count() == 0
    i = traverse.impact(g, starts(g, "f3"), 3).first()
    assert (i.direct, i.indirect, i.score, i.risk) == (4, 2, 4.75, "low")
    assert [r.path for r in traverse.critical_paths(g, starts(g, "f3")).orderBy("place").collect()] == ["f3 < f1 < c < m", "f3 < f2 < c < m", "f3 < f1 < c < m"]
    assert ids(traverse.navigate(g, starts(g, "c"), "callees", 2)) == ["c", "f1", "f2", "f3"] and ids(traverse.navigate(g, starts(g, "c"), "callers", 2)) == ["c", "m"]
    assert traverse.subgraph(g, g.entities.where("id in ('c', 'f1')"))[1].count() == 1
    assert {r.community for r in traverse.communities(g, 3).where("id in ('f1', 'f3')").collect()}


def test_quality(g):
    c = {r.id: r.complexity for r in quality.complexities(g).collect()}
    assert (c["c"], c["f1"], c["f3"]) == (3, 2, 1)
    lcom = {r.id: (r.children, r.sharing, r.lcom) for r in quality.cohesion(g).collect()}
    assert lcom == {"m": (1, 0, 0.0), "c": (2, 1, 0.0)}
    metrics = {(r.id, r.metric): (r.value, r.status) for r in quality.quality_metrics(g).collect()}
    assert metrics["f1", "parameter_count"] == (2.0, "good") and metrics["c", "cyclomatic_complexity"] == (1.5, "good") and metrics["f2", "method_lines"] == (15.0, "good")
    problems = sorted((r.issue, r.subject) for r in quality.validate(g).collect())
    assert problems == [("duplicate", "f3"), ("invalid_source", "9"), ("invalid_target", "7"), ("orphan", "x")]
    assert quality.repair(g).relationships.count() == 7 and ids(quality.repair(g, remove_orphans=True).entities) == ["c", "f1", "f2", "f3", "m"]
    issues = quality.compatibility(g, "k", "2.0", [("k", "1.0", "order", "removed", ""), ("k", "3.0", "load", "removed", "")])
    assert {(r.id, r.place) for r in issues.collect()} == {("c", "name"), ("f1", "name"), ("f2", "name"), ("f3", "name"), ("x", "name"), ("c", "documentation"), ("x", "documentation")}


def test_changes(g, spark):
    fresh = g.entities.where("id = 'x'").withColumn("name", F.lit("renamed"))
    assert mutate.add_entities(g, fresh)[1].count() == 1 and mutate.upsert_entities(g, fresh).entities.where("name = 'renamed'").count() == 1
    assert mutate.delete_entities(g, g.entities.where("id = 'c'")).relationships.count() == 5
    assert mutate.delete_edges(g).relationships.count() == 9 and mutate.delete_edges(g, kind="calls", source="f1").relationships.count() == 7
    assert mutate.remove_files(g, g.entities.where("id = 'c'")).entities.count() == 1
    f = "graph string, file_path string, hash_value string"
    now, then = spark.createDataFrame([("p", "a", "1"), ("p", "b", "2"), ("p", "c", "3")], f), spark.createDataFrame([("p", "b", "2"), ("p", "c", "x"), ("p", "d", "4")], f)
    assert {r.file_path: r.status for r in mutate.classify_files(now, then).collect()} == {"a": "new", "b": "unchanged", "c": "changed", "d": "deleted"}


def test_texts_and_guidance(g, spark):
    assert {r.chosen for r in guidance.naming_conventions(g).where("type = 'method'").collect()} == {True}
    assert tuple(guidance.suggest_names(spark.createDataFrame([("create the new user profile page view",)], "task string")).first())[1:] == ("user_profile_page", "userProfilePage", "UserProfilePage")
    texts = {form: documentation.documentation(g, form).where("id = 'f1'").first().text for form in documentation.FORMATS}
    assert texts["markdown"].endswith("## Dependencies\n\n### Calls\n- `load_order` (function)\n- `load_order` (function)\n") and texts["markdown"].startswith("# load_order\n\n**Type**: `method`  \n**File**: `src/app.py`  \n**Line**: 5\n\n## Description\n\nArgs:")
    assert texts["jsdoc"] == "/**\n * Args:\n *   a: x\n *   b: y\n * \n * if\n *\n * @type {method}\n * @file src/app.py\n * @see load_order\n * @see load_order\n */"
    assert documentation.documentation(g, "google").where("id = 'f2'").first().text == '"""\nsave_order\n\nAttributes:\n    load_order: function\n"""'
    assert texts["numpy"].endswith('\n\nSee Also\n--------\nload_order : function\nload_order : function\n"""') and texts["sphinx"].endswith(':type: method\n:file: src/app.py\n:seealso: :class:`load_order`\n:seealso: :class:`load_order`\n"""')
    used = documentation.documentation(g).where("id = 'c'").first().text
    assert used.endswith("## Used By\n\n") and "Usage Examples" not in used  # the only caller is no entity
    assert "Usage Examples" in documentation.documentation(g).where("id = 'f3'").first().text and "Usage Examples" not in documentation.documentation(g, include_examples=False).where("id = 'f3'").first().text
    assert guidance.suggest_names(spark.createDataFrame([("create the new",)], "task string"), "function").first().snake_case == "new_function" and guidance.template("other") == guidance.TEMPLATES["module"]
    log = spark.createDataFrame([("f", 1, T(1), 100, 1), ("f", 2, T(2), 600, 2), ("h", 1, T(1), 1, 3)], "file_path string, author long, at timestamp, lines long, commit_id long")
    assert {r.file_path: r.score for r in evolution.hotspots(log).collect()}["f"] == pytest.approx(0.5 * 2 / 30 + 0.3 * 2 / 5 + 0.2)
    row = spark.range(1).select(text.version_order(F.lit("1.10"), F.lit("1.9")).alias("a"), text.version_order(F.lit("1"), F.lit("1.0")).alias("b"), text.version_order(F.lit("1.x"), F.lit("2")).alias("c"), (text.semver_key(F.lit("1.0.0-alpha.2")) < text.semver_key(F.lit("1.0.0"))).alias("d"), (text.semver_key(F.lit("1.0.0-alpha.2")) < text.semver_key(F.lit("1.0.0-alpha.10"))).alias("e")).first()
    assert tuple(row) == (1, 0, 0, True, True)


def rough(spark, n, edges, seed):
    """A random graph with loops, hubs and parallel edges."""
    rng = random.Random(seed)
    name = lambda i: f"n{i:02d}"
    links = [(k, name(rng.randrange(n)), name(rng.choice([0, rng.randrange(n)]) if rng.random() < 0.3 else rng.randrange(n))) for k in range(edges)]
    e = spark.createDataFrame([("g", i, name(i), name(i), "class", "f", 1, 0, None, None, None) for i in range(n)], "graph string, seq long, id string, name string, type string, file_path string, line int, col int, docstring string, scope string, extra_data string")
    r = spark.createDataFrame([(k, "g", a, b, rng.choice(["calls", "contains"])) for k, a, b in links], "rel_id long, graph string, source_id string, target_id string, type string")
    return KnowledgeGraph(e, r), links, [name(i) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 4])
def test_walks_against_brute_force(spark, seed):
    g, links, names = rough(spark, 14, 22, seed)
    roots = names[:6]

    def chains(node, path, out):
        into = [a for _, a, b in links if b == node]
        if not into and len(path) > 1:
            out.append(" < ".join(path))
        for a in into[:5]:
            if a not in path:
                chains(a, [*path, a], out)
        return out

    df = spark.createDataFrame([("g", r) for r in roots], "graph string, root string")
    got = {r: [] for r in roots}
    for row in traverse.critical_paths(g, df, limit=4).orderBy("root", "place").collect():
        got[row.root].append(row.path)
    assert got == {r: chains(r, [r], [])[:4] for r in roots}

    def visit(node, depth, seen, out):
        for _, a, b in [x for x in links if x[1] == node][: traverse.PER_NODE]:
            if b not in seen and depth < 2:
                seen.add(b)
                out.append((b, depth + 1))
                visit(b, depth + 1, seen, out)
        return out

    steps = {r: [] for r in roots}
    for row in traverse.navigate_depth_first(g, df).orderBy("root", "place").collect():
        steps[row.root].append((row.id, row.depth))
    assert steps == {r: visit(r, 0, {r}, []) for r in roots}

    near = {x: sorted({b for _, a, b in links if a == x} | {a for _, a, b in links if b == x}) for x in names}

    def shortest(a, b):
        layer = {a: [a]}
        seen = {a}
        while layer:
            if b in layer:
                return layer[b]
            ahead = {}
            for x in sorted(layer, key=lambda k: layer[k]):
                for y in near[x]:
                    if y not in seen and y not in ahead:
                        ahead[y] = [*layer[x], y]
            seen |= set(ahead)
            layer = ahead
        return None

    pairs = [(a, b) for a in roots for b in names if near[a]]
    found = {(r.source, r.target): list(r.path) for r in traverse.shortest_paths(g, spark.createDataFrame([("g", *p) for p in pairs], "graph string, source string, target string")).collect()}
    assert found == {p: w for p in pairs if (w := shortest(*p))}


def test_cohesion_in_blocks(spark):
    g, _, _ = rough(spark, 30, 200, 9)
    want = sorted(tuple(r) for r in quality.cohesion(g).collect())
    assert any(r[3] for r in want) and sorted(tuple(r) for r in quality.cohesion(g, pair_rows=0).collect()) == want


def test_thinning_goes_down_the_whole_ranking(spark):
    names = ["load"] * 700 + ["queue", "loader", "reload", "my_queue", "load queue", "Queue"]
    e = spark.createDataFrame([("p", i, f"e{i}", x, "class", "f", 1, 0, None, None, None) for i, x in enumerate(names)], "graph string, seq long, id string, name string, type string, file_path string, line int, col int, docstring string, scope string, extra_data string")
    g = KnowledgeGraph(e, e)
    assert [r.name for r in search.hybrid_search(g, "load queue", "p").orderBy("place").collect()] == ["load queue", "my_queue"]
    ranked = [(r.id, r.name.lower()) for r in search.hybrid_ranked(g, "load", "p").orderBy(F.desc("score"), "graph", "seq").collect()]
    kept = []
    for i, x in ranked:
        if not any(x in k or k in x for _, k in kept):
            kept.append((i, x))
    assert [(r.id, r.name.lower()) for r in search.hybrid_search(g, "load", "p").orderBy("place").collect()] == kept[:20]


def test_labels_stop(spark):
    g, _, names = rough(spark, 14, 22, 3)
    found = {r.id: r.community for r in traverse.communities(g).collect()}
    assert set(found) <= set(names) and set(found.values()) <= set(names)
    pair = KnowledgeGraph(g.entities, g.relationships.limit(0).unionByName(spark.createDataFrame([(1, "g", "n01", "n02", "calls")], g.relationships.schema)))
    assert {r.id: r.community for r in traverse.communities(pair).collect()} == {"n01": "n01", "n02": "n01"}


def test_refresh_and_edges(g, spark):
    fresh = spark.createDataFrame([(1, "p", "m", "c", "contains"), (99, "p", "c", "f3", "calls")], g.relationships.schema)
    more, again = mutate.add_edges(g, fresh)
    assert more.relationships.count() == 10 and again.count() == 1
    changed, missing = mutate.update_entities(g, g.entities.where("id in ('x', 'c')").withColumn("id", F.when(F.col("id") == "x", "nobody").otherwise(F.col("id"))).withColumn("name", F.lit("new")))
    assert missing.count() == 1 and changed.entities.where("name = 'new'").count() == 1 and changed.entities.count() == 6
    assert mutate.clear(g).entities.count() == 0
    parsed = KnowledgeGraph(g.entities.where("id in ('m', 'c')"), g.relationships.where("rel_id = 1"), g.file_hashes)
    status = spark.createDataFrame([("p", "src/app.py", "changed")], "graph string, file_path string, status string")
    after = mutate.refresh(g, parsed, status)
    assert ids(after.entities) == ["c", "m", "x"] and sorted(r.rel_id for r in after.relationships.collect()) == [1, 9]
    log = spark.createDataFrame([("src/app.py", 1, T(1), 100, 1), ("src/app.py", 2, T(300), 600, 2)], "file_path string, author long, at timestamp, lines long, commit_id long")
    assert {(r.id, r.commits) for r in evolution.entity_history(g, log, until=T(301)).collect()} == {(i, 1) for i in ("m", "c", "f1", "f2", "f3")}
    assert [(r.id, r.commits) for r in evolution.graph_hotspots(g, log).collect()] == [("m", 2)]
    label = lookup.relation_label(g, spark.createDataFrame([("p", "c", "m"), ("p", "m", "c"), ("p", "m", "f3")], "graph string, a string, b string"))
    assert {(r.a, r.b): r.label for r in label.collect()} == {("c", "m"): "inverse_contains", ("m", "c"): "contains", ("m", "f3"): "related"}


def test_json_round_trip(g, tmp_path, spark):
    for r in graph_json.to_documents(g).collect():
        (tmp_path / f"{r.graph}.json").write_text(r.document)
    back = graph_json.read_graphs(spark, str(tmp_path))
    assert ids(back.entities) == ids(g.entities) and back.relationships.count() == 9 and back.file_hashes.count() == 1
    graph_json.write_parquet(g, str(tmp_path / "store"))
    assert graph_json.read_parquet(spark, str(tmp_path / "store")).entities.where("graph = 'q'").count() == 1
    for part in (g.only("q"), g):
        graph_json.commit_version(part, f"file://{tmp_path}/versioned")
    assert ids(graph_json.read_current(spark, f"file://{tmp_path}/versioned").entities) == ids(g.entities)
    assert sorted(x.name for x in (tmp_path / "versioned").glob("current.*")) == ["current.000000000001", "current.000000000002"]


def test_no_field_of_a_graph_file_is_lost(tmp_path, spark):
    whole = {
        "entities": [
            {"id": "a", "name": "A", "type": "class", "location": {"file": "a.py", "line": 1, "column": 2}, "docstring": "d", "bases": ["B"], "decorators": ["x"]},
            {"id": "f", "name": "f", "type": "method", "location": {"file": "a.py", "line": 3, "column": 4}, "parameters": [["p", "int"], ["q", None]], "return_type": "str", "is_async": True, "class_id": "a", "decorators": []},
            {"id": "m", "name": "m", "type": "module", "location": {"file": "a.py", "line": 1, "column": 0}, "exports": ["A", "f"], "scope": "s"},
        ],
        "relationships": [{"source_id": "a", "target_id": "f", "type": "contains", "metadata": {"k": "v"}}, {"source_id": "f", "target_id": "a", "type": "calls"}],
        "file_hashes": {"a.py": "h"},
    }
    (tmp_path / "in").mkdir()
    for name in ("one", "two"):
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps(whole))
    g = graph_json.read_graphs(spark, str(tmp_path / "in"))
    assert g.relationships.select("rel_id").distinct().count() == 4
    for per_document in (20_000, 1):
        back = graph_json.to_documents(g, per_document)
        parts = [json.loads(r.document) for r in back.where("graph = 'one'").collect()]
        for key in ("entities", "relationships"):
            assert sorted((json.dumps(x, sort_keys=True) for p in parts for x in p.get(key, ()))) == sorted(json.dumps(x, sort_keys=True) for x in whole[key])
        assert [p["file_hashes"] for p in parts if p.get("file_hashes")] == [whole["file_hashes"]]
    graph_json.write_json(g, str(tmp_path / "out"))
    again = graph_json.read_json(spark, str(tmp_path / "out"))
    columns = ["graph", "id", "name", "docstring", "line", "col", "scope", "extra_data"]
    assert sorted(map(str, again.entities.select(columns).collect())) == sorted(map(str, g.entities.select(columns).collect()))
    assert sorted(map(str, again.relationships.select("graph", "source_id", "target_id", "type", F.to_json("metadata")).collect())) == sorted(map(str, g.relationships.select("graph", "source_id", "target_id", "type", F.to_json("metadata")).collect()))


def test_catalogue_summaries(tmp_path, spark):
    entry = {"language": "dart", "entities": "12", "relationships": 5, "entity_types": {"module": 1, "method": {"total": 2}}}
    (tmp_path / "list.json").write_text(json.dumps({"frameworks": [{"name": "My Kit", **entry}, {"entity_count": 3}]}))
    (tmp_path / "named.json").write_text(json.dumps({"frameworks": {"other": entry}}))
    (tmp_path / "broken.json").write_text('{"frameworks": [')
    found = catalogue.read_summary(spark, str(tmp_path))
    assert {(r.name, r.entities, r.relationships) for r in found.collect()} == {("my-kit", 12, 5), ("", 3, 0), ("other", 12, 5)}
    assert catalogue.framework_info(found, "other").first().entity_types == {"module": 1, "method": None}


def test_critical_paths_end_where_joins_would_go_on_for_ever(spark):
    """a root above many closed ways took a round of joins for every few of them."""
    links = []
    for i in range(18):  # 2 ** 18 ways through a ladder whose last rung only leads back to the root
        links += [(f"a{i}", f"a{i + 1}"), (f"a{i}", f"b{i + 1}"), (f"b{i}", f"a{i + 1}"), (f"b{i}", f"b{i + 1}")]
    links = [("root", "a0"), ("root", "out"), *links, ("a18", "root"), ("b18", "root"), ("out", "end")]
    names = sorted({x for pair in links for x in pair})
    e = spark.createDataFrame([("g", n) for n in names], "graph string, id string")
    r = spark.createDataFrame([(i, "g", up, head, "calls") for i, (head, up) in enumerate(links)], "rel_id long, graph string, source_id string, target_id string, type string")
    roots = spark.createDataFrame([("g", "root"), ("g", "end")], "graph string, root string")
    assert [tuple(x) for x in traverse.critical_paths(KnowledgeGraph(e, r), roots).collect()] == [("g", "root", 1, "root < out < end")]


def test_critical_paths_of_large_graphs_are_the_same(spark):
    for seed in (1, 4):
        g, _, names = rough(spark, 14, 22, seed)
        df = spark.createDataFrame([("g", r) for r in names], "graph string, root string")
        rows = [sorted(tuple(x) for x in traverse.critical_paths(g, df, limit=4, in_a_task=n).collect()) for n in (10**6, 0)]
        assert rows[0] and rows[0] == rows[1]


@pytest.mark.parametrize(("limit", "in_a_task"), [(10, 10**6), (None, 10**6), (21, 0)])
def test_critical_paths_follow_every_edge_into_a_node(spark, limit, in_a_task):
    """only the first five edges into a node were followed, so that all chains through later ones were lost."""
    links = [("hub", f"loop{i:02d}") for i in range(30)] + [(f"loop{i:02d}", "hub") for i in range(30)] + [("hub", f"end{i:02d}") for i in range(20)] + [("hub", "mid"), ("mid", "end00"), ("mid", "end20")]
    e = spark.createDataFrame([("g", n) for n in sorted({x for pair in links for x in pair})], "graph string, id string")
    r = spark.createDataFrame([(i, "g", up, head, "calls") for i, (head, up) in enumerate(links)], "rel_id long, graph string, source_id string, target_id string, type string")
    g, roots = KnowledgeGraph(e, r), spark.createDataFrame([("g", "hub"), ("g", "loop07")], "graph string, root string")
    ways = [*(f"hub < end{i:02d}" for i in range(20)), "hub < mid < end00", "hub < mid < end20"]
    found = traverse.critical_paths(g, roots, limit, in_a_task=in_a_task).collect()
    assert sorted(tuple(x) for x in found) == sorted(("g", root, i, before + way) for root, before in (("hub", ""), ("loop07", "loop07 < ")) for i, way in enumerate(ways[:limit], 1))


@pytest.mark.parametrize("seed", [3, 8])
def test_critical_paths_with_hubs_against_brute_force(spark, seed):
    """hubs with more edges than a page, with all chains and with the first ones."""
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(12)]
    links = [(k, rng.choice(names), rng.choice([*names[:2], *names[:7]])) for k in range(34)]

    def chains(node, path):
        into = [a for _, a, b in links if b == node]
        for a in into:
            if a not in path:
                yield from chains(a, [*path, a])
        if not into and len(path) > 1:
            yield " < ".join(path)

    e = spark.createDataFrame([("g", n) for n in names], "graph string, id string")
    r = spark.createDataFrame([(k, "g", a, b, "calls") for k, a, b in links], "rel_id long, graph string, source_id string, target_id string, type string")
    g, df = KnowledgeGraph(e, r), spark.createDataFrame([("g", n) for n in names], "graph string, root string")
    assert max(sum(b == n for _, _, b in links) for n in names) > traverse.UPS_IN_A_ROUND
    for limit, in_a_task in ((None, 10**6), (7, 10**6), (7, 0)):
        got = {n: [] for n in names}
        for row in traverse.critical_paths(g, df, limit, in_a_task=in_a_task).orderBy("root", "place").collect():
            got[row.root].append(row.path)
        assert any(got.values()) and got == {n: list(chains(n, [n]))[:limit] for n in names}


def test_looking_ahead_changes_no_chain(monkeypatch):
    import numpy as np

    for seed in range(300):
        rng = random.Random(seed)
        n = 9
        ups = [rng.sample(range(n), rng.randint(0, 3)) for _ in range(n)]
        ended = np.array([not u for u in ups])
        found = []
        for patience in (10**9, 0, 2):
            monkeypatch.setattr(traverse, "PATIENCE", patience)
            found.append([traverse._walk(lambda x: ups[x], ended, np.ones(n, bool), root, 4) for root in range(n)])
        assert found[0] == found[1] == found[2]


def test_shortest_paths_meet_at_hubs_and_do_not_pass_them(spark, monkeypatch):
    """levels from the targets alone passed every hub, and held all of its neighbours for each target."""
    links = [(f"m{i:03d}", "hub") for i in range(400)] + [(f"m{i:03d}", f"leaf{i:03d}") for i in range(400)]
    e = spark.createDataFrame([("g", x) for x in sorted({x for p in links for x in p})], "graph string, id string")
    r = spark.createDataFrame([(i, "g", a, b, "calls") for i, (a, b) in enumerate(links)], "rel_id long, graph string, source_id string, target_id string, type string")
    pairs = spark.createDataFrame([("g", f"leaf{i:03d}", f"leaf{399 - i:03d}") for i in range(100)], "graph string, source string, target string")
    rows = []
    monkeypatch.setattr(traverse, "cut", lambda df, *a: rows.append(df.count()) or df)
    monkeypatch.setattr(traverse, "stored", lambda df, keep=traverse.stored: (x := keep(df), rows.append(x.count()))[0])
    found = {(x.source, x.target): list(x.path) for x in traverse.shortest_paths(KnowledgeGraph(e, r), pairs).collect()}
    assert found == {(f"leaf{i:03d}", f"leaf{399 - i:03d}"): [f"leaf{i:03d}", f"m{i:03d}", "hub", f"m{399 - i:03d}", f"leaf{399 - i:03d}"] for i in range(100)}
    assert max(rows) < 5000


@pytest.mark.parametrize("few", [0, 3, 10**6])
def test_shortest_paths_from_either_end(spark, monkeypatch, few):
    monkeypatch.setattr(traverse, "FEW_NEIGHBOURS", few)
    g, links, names = rough(spark, 24, 30, 7)
    near = {x: {b for _, a, b in links if a == x} | {a for _, a, b in links if b == x} for x in names}

    def paths(path, target, left, out):
        if path[-1] == target:
            out.append(path)
        elif left:
            for y in near[path[-1]] - set(path):
                paths([*path, y], target, left - 1, out)
        return out

    pairs = [(a, b) for a in names for b in names[::3] if near[a]]
    found = {(x.source, x.target): list(x.path) for x in traverse.shortest_paths(g, spark.createDataFrame([("g", *p) for p in pairs], "graph string, source string, target string"), 5).collect()}
    assert found == {p: min(every, key=lambda w: (len(w), w)) for p in pairs if (every := paths([p[0]], p[1], 5, []))}


def settled(links, rounds=None):
    """Labels of one graph by the definition, and the number of rounds."""
    near = {}
    for a, b in links:
        for x, y in ((a, b), (b, a), (a, a), (b, b)):
            near.setdefault(x, set()).add(y)
    labels, before, turn = {x: x for x in near}, None, 0
    while rounds is None or turn < rounds:
        turn += 1
        votes = {x: Counter(labels[y] for y in near[x]) for x in near}
        chosen = {x: min(v, key=lambda c: (-v[c], c)) for x, v in votes.items()}
        if chosen == before:
            return {x: min(chosen[x], labels[x]) for x in near}, turn
        labels, before = chosen, labels
        if labels == before:
            break
    return labels, turn


def linked(spark, links):
    """A graph of the given (graph, source, target)."""
    e = spark.createDataFrame([], "graph string, seq long, id string, name string, type string, file_path string, line int, col int, docstring string, scope string, extra_data string")
    return KnowledgeGraph(e, spark.createDataFrame([(k, *x, "calls") for k, x in enumerate(links)], "rel_id long, graph string, source_id string, target_id string, type string"))


def test_communities_start_no_jobs_for_each_round(spark):
    """each round was joins of all edges with all labels."""
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(80)]
    want, turns = settled(chain)
    spark.sparkContext.setJobGroup("communities", "")
    try:
        found = {r.id: r.community for r in traverse.communities(linked(spark, [("g", *x) for x in chain])).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == want
    assert turns > 60 > len(spark.sparkContext.statusTracker().getJobIdsForGroup("communities")) > 0


def test_communities_of_each_graph_by_the_definition(spark):
    rng = random.Random(5)
    parts = {f"g{k}": [(f"n{rng.randrange(n)}", rng.choice(["n0", f"é{rng.randrange(n)}", f"n{rng.randrange(n)}"])) for _ in range(m)] for k, (n, m) in enumerate([(9, 12), (30, 40), (25, 90), (1, 1), (60, 80)])}
    parts["cycle"] = [("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("x", ""), ("x", "x")]
    links = [(k, *x) for k, v in parts.items() for x in v] + [("g1", None, "n1"), ("g1", "n1", None), (None, "n1", "n2")]
    g = linked(spark, links)
    for rounds in (None, 0, 1, 2, 3):
        want = sorted((k, *x) for k, v in parts.items() for x in settled(v, rounds)[0].items())
        assert sorted(tuple(r) for r in traverse.communities(g, rounds).collect()) == want
    want = sorted((k, *x) for k, v in parts.items() for x in settled(v)[0].items())
    assert sorted(tuple(r) for r in traverse.communities(g, in_a_task=100).collect()) == want  # some graphs by joins
    assert sorted(tuple(r) for r in traverse.communities(g, 2, in_a_task=0).collect()) == sorted((k, *x) for k, v in parts.items() for x in settled(v, 2)[0].items())


def test_labels_are_counted_in_parts(monkeypatch):
    import numpy as np

    rng = random.Random(8)
    for n, m in [(2, 2), (20, 30), (70, 90), (70, 300)]:
        links = [(rng.randrange(n), rng.choice([0, rng.randrange(n)])) for _ in range(m)] + [(k, k) for k in range(n)]
        pairs = np.array(sorted({x for a, b in links for x in ((a, b), (b, a))}))
        starts = np.searchsorted(pairs[:, 0], np.arange(n + 1))
        for at_once in (1, 7, 10**6):
            monkeypatch.setattr(traverse, "PAIRS_AT_ONCE", at_once)
            assert dict(enumerate(traverse._settle(starts, pairs[:, 1], None).tolist())) == settled(links)[0]
