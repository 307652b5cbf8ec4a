"""Registered queries over the knowledge graph: lookups, statistics, search."""

from __future__ import annotations

from graphloom.graph import KnowledgeGraph
from graphloom.operators import lookup, search
from graphloom.session import table

LOCAL = "express"


def _kg(f):
    return lambda spark, sf_dir: f(KnowledgeGraph.current(spark, sf_dir))


QUERIES = {
    "entities_current": _kg(lambda g: g.entities.drop("extra_data")),
    "edges_clean": _kg(lambda g: g.relationships),
    "search_entities": _kg(lambda g: lookup.search_entities(g, "queue")),
    "search_entities_typed": _kg(lambda g: lookup.search_entities(g, "store", "class", 50)),
    "get_entity": _kg(lambda g: lookup.get_entity(g, " MODULE_0001 ").drop("extra_data")),
    "get_by_type": _kg(lambda g: lookup.by_type(g, "interface")),
    "get_by_name": _kg(lambda g: lookup.by_name(g, "palette")),
    "edges_out": _kg(lambda g: lookup.edges(g, source="module_0001")),
    "edges_in": _kg(lambda g: lookup.edges(g, target="external:corekit")),
    "edges_by_type": _kg(lambda g: lookup.edges(g, kind="inherits")),
    "find_by_pattern": _kg(lambda g: lookup.match_wildcard(g, "load*config", 200)),
    "framework_find_by_pattern": _kg(lambda g: lookup.match_wildcard(g.only("express", "flutter"), "load*", 200)),
    "resolve_names": _kg(lambda g: lookup.resolve_names(g, ["queue", "loader", "scanQueue"])),
    "languages_of_files": _kg(lookup.languages_of_files),
    "graph_stats": _kg(lookup.graph_stats),
    "framework_catalogue": lambda spark, sf_dir: lookup.catalogue(KnowledgeGraph.current(spark, sf_dir), table(spark, sf_dir, "frameworks")),
    "usage_frequency": _kg(lookup.usage_counts),
    "coupling": _kg(lookup.coupling),
    "code_context": _kg(lookup.contexts),
    "usage_examples": _kg(lookup.usage_examples),
    "relationship_label": _kg(lookup.pair_labels),
    "signature_render": _kg(lookup.signatures),
    "semantic_search": _kg(lambda g: search.semantic_search(g, "load queue")),
    "semantic_search_typed": _kg(lambda g: search.semantic_search(g, "parse index", ["class", "method"], 100)),
    "relevance_distribution": _kg(lambda g: search.relevance_distribution(g, "load queue")),
    "search_all_frameworks": _kg(lambda g: search.search_graphs(g, "registry")),
    "similar_patterns": _kg(lambda g: search.similar_patterns(g, "loader")),
    "pattern_examples": _kg(lambda g: search.pattern_examples(g, "loader", limit=50)),
    "recommend_code": _kg(lambda g: search.recommend(g, "queue", LOCAL, limit=50, min_relevance=0.1)),
    "hybrid_ranked": _kg(lambda g: search.hybrid_ranked(g, "load queue", LOCAL, 0.6)),
    "hybrid_search": _kg(lambda g: search.hybrid_search(g, "load queue", LOCAL, 0.6)),
    "hybrid_search_words": _kg(lambda g: search.hybrid_search(g, "parse index", LOCAL, 0.6)),
    "hybrid_breakdown": _kg(lambda g: search.source_breakdown(search.hybrid_ranked(g, "parse index", LOCAL, 0.6))),
    "recommend_breakdown": _kg(lambda g: search.source_breakdown(search.recommended(g, "queue", LOCAL, 0.1))),
    "detect_frameworks": _kg(search.detect_frameworks),
}


def norm(c: str) -> str:
    return rf"nullif(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '')"


BASE = f"""
ents AS (
  SELECT graph, seq, id, name, type, file_path, line, col, docstring, scope, extra_data FROM (
    SELECT graph, seq, {norm("id")} AS id, name, type, file_path, line, col, docstring, scope, extra_data, removed_at,
      row_number() OVER (PARTITION BY graph, {norm("id")} ORDER BY created_at DESC, ingested_at DESC, seq DESC) AS rn
    FROM entities WHERE graph IS NOT NULL AND {norm("id")} IS NOT NULL)
  WHERE rn = 1 AND removed_at IS NULL),
rels AS (
  SELECT rel_id, min(graph) AS graph, min({norm("source_id")}) AS source_id, min({norm("target_id")}) AS target_id, min({norm("type")}) AS type
  FROM relationships WHERE rel_id IS NOT NULL GROUP BY rel_id)
"""


def over(select: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{BASE}{', ' + more if more else ''} {select}"


_BRIEF = "graph, seq, id, name, type, file_path, line"


def _overlap(list_sql: str, words: list[str]) -> str:
    return f"coalesce(len(list_intersect({list_sql}, {words!r})), 0)"


_IDENT = "list_distinct(regexp_extract_all(lower(name), '[a-z]+'))"
_WORDS = "list_distinct(list_filter(string_split_regex(lower(docstring), '\\s+'), lambda w: w <> ''))"


def _name_score(q: str) -> str:
    return f"CASE WHEN lower(name) = '{q}' THEN 10.0 WHEN contains(lower(name), '{q}') THEN 5.0 WHEN contains('{q}', lower(name)) THEN 3.0 ELSE 0.0 END"


def _relevance(q: str) -> str:
    w = sorted(set(q.split()))
    return f"""({_name_score(q)} + 2.0 * {_overlap(_IDENT, w)}
      + CASE WHEN coalesce(docstring, '') <> '' AND contains(lower(docstring), '{q}') THEN 2.0 ELSE 0.0 END
      + CASE WHEN coalesce(docstring, '') <> '' THEN 0.5 * {_overlap(_WORDS, w)} ELSE 0.0 END
      + CASE WHEN contains(lower(file_path), '{q}') THEN 1.0 ELSE 0.0 END)::DOUBLE"""


def _hybrid(q: str) -> str:
    w = sorted(set(q.split()))
    return f"({_name_score(q)} + 2.0 * {_overlap(_IDENT, w)} + CASE WHEN coalesce(docstring, '') <> '' AND contains(lower(docstring), '{q}') THEN 2.0 ELSE 0.0 END)::DOUBLE"


def _weighted(q: str, usage: str) -> str:
    w = sorted(set(q.split()))
    return f"""(CASE WHEN lower(name) = '{q}' THEN 1.0 WHEN contains(lower(name), '{q}') THEN 0.7 WHEN contains('{q}', lower(name)) THEN 0.5
        ELSE least(0.3 * {_overlap(_IDENT, w)}, 0.9) END)::DOUBLE * 0.4::DOUBLE
      + (CASE WHEN coalesce(docstring, '') = '' THEN 0.0 WHEN contains(lower(docstring), '{q}') THEN 0.8 ELSE least(0.2 * {_overlap(_WORDS, w)}, 0.7) END)::DOUBLE * 0.3::DOUBLE
      + (CASE WHEN contains(lower(file_path), '{q}') THEN 0.5 ELSE 0.0 END)::DOUBLE * 0.2::DOUBLE
      + (CASE WHEN {usage} > 10 THEN 1.0 WHEN {usage} > 5 THEN 0.7 WHEN {usage} > 0 THEN 0.4 ELSE 0.0 END)::DOUBLE * 0.1::DOUBLE"""


def _thinned(q: str) -> str:
    return over(
        """SELECT unnest(range(len(kept))) AS place, unnest(kept, recursive := true) FROM (
          SELECT list_slice(list_reduce(list_transform(rows, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: contains(lower(k.name), lower(x[1].name)) OR contains(lower(x[1].name), lower(k.name)))) > 0 THEN acc ELSE list_concat(acc, x) END), 1, 20) AS kept
          FROM (SELECT list({graph: graph, seq: seq, id: id, name: name, type: type, source: source, score: score} ORDER BY score DESC, graph, seq) AS rows
            FROM (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY score DESC, graph, seq) = 1)))""",
        f"ranked AS ({_hybrid_ranked(q)})",
    )


def _hybrid_ranked(q: str) -> str:
    return f"""SELECT {_BRIEF}, CASE WHEN graph = '{LOCAL}' THEN 'local' ELSE 'framework' END AS source,
    s * CASE WHEN graph = '{LOCAL}' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS score FROM (SELECT *, {_hybrid(q)} AS s FROM ents) WHERE s > 0"""


# The reference values of the framework signs, as the SQL's own.
_SIGNS = """('fastapi', 'fastapi'), ('fastapi', 'APIRouter'), ('fastapi', 'FastAPI'), ('django', 'django'), ('django', 'models.Model'), ('django', 'View'), ('flask', 'flask'), ('flask', 'Blueprint'), ('flask', 'Flask'),
  ('react', 'React'), ('react', 'useState'), ('react', 'useEffect'), ('express', 'express'), ('express', 'Router'), ('express', 'middleware'), ('spring', '@Controller'), ('spring', '@Service'), ('spring', '@Repository')"""

_LANGUAGES = """('.py', 'Python'), ('.ts', 'TypeScript'), ('.tsx', 'TypeScript'), ('.js', 'JavaScript'), ('.jsx', 'JavaScript'), ('.rs', 'Rust'), ('.go', 'Go'), ('.rb', 'Ruby'), ('.java', 'Java'), ('.cs', 'C#'), ('.cpp', 'C++'), ('.hpp', 'C++'),
  ('.cc', 'C++'), ('.hh', 'C++'), ('.cxx', 'C++'), ('.c', 'C'), ('.h', 'C'), ('.m', 'Objective-C'), ('.mm', 'Objective-C'), ('.php', 'PHP'), ('.swift', 'Swift'), ('.kt', 'Kotlin'), ('.kts', 'Kotlin'), ('.scala', 'Scala'), ('.lua', 'Lua'),
  ('.hs', 'Haskell'), ('.ex', 'Elixir'), ('.exs', 'Elixir'), ('.jl', 'Julia'), ('.sql', 'SQL'), ('.groovy', 'Groovy'), ('.dart', 'Dart'), ('.zig', 'Zig'), ('.yaml', 'YAML'), ('.yml', 'YAML')"""

SQL = {
    "entities_current": over("SELECT graph, seq, id, name, type, file_path, line, col, docstring, scope FROM ents"),
    "edges_clean": over("SELECT rel_id, graph, source_id, target_id, type FROM rels"),
    "search_entities": over(f"SELECT {_BRIEF} FROM ents WHERE contains(lower(name), 'queue') ORDER BY graph, seq LIMIT 20"),
    "search_entities_typed": over(f"SELECT {_BRIEF} FROM ents WHERE contains(lower(name), 'store') AND type = 'class' ORDER BY graph, seq LIMIT 50"),
    "get_entity": over("SELECT graph, seq, id, name, type, file_path, line, col, docstring, scope FROM ents WHERE id = 'module_0001'"),
    "get_by_type": over(f"SELECT {_BRIEF} FROM ents WHERE type = 'interface'"),
    "get_by_name": over(f"SELECT {_BRIEF} FROM ents WHERE name = 'palette'"),
    "edges_out": over("SELECT rel_id, graph, source_id, target_id, type FROM rels WHERE source_id = 'module_0001'"),
    "edges_in": over("SELECT rel_id, graph, source_id, target_id, type FROM rels WHERE target_id = 'external:corekit'"),
    "edges_by_type": over("SELECT rel_id, graph, source_id, target_id, type FROM rels WHERE type = 'inherits'"),
    "find_by_pattern": over(f"SELECT {_BRIEF} FROM ents WHERE regexp_matches(name, '^load.*config$', 'i') ORDER BY graph, seq LIMIT 200"),
    "framework_find_by_pattern": over(f"SELECT {_BRIEF} FROM ents WHERE graph IN ('express', 'flutter') AND starts_with(lower(name), 'load') ORDER BY graph, seq LIMIT 200"),
    "resolve_names": over(
        """SELECT graph, wanted, id, name, type, seq FROM (
        SELECT e.graph, w.wanted, e.id, e.name, e.type, e.seq, row_number() OVER (PARTITION BY e.graph, w.wanted ORDER BY lower(e.name) <> w.wanted, e.seq) AS rn
        FROM ents e JOIN (VALUES ('queue'), ('loader'), ('scanqueue')) w(wanted) ON contains(lower(e.name), w.wanted)) WHERE rn = 1"""
    ),
    "languages_of_files": over(
        f"""SELECT x.extension, k.language, count(*) AS entities, count(DISTINCT (x.graph, x.file_path)) AS files
        FROM (SELECT *, regexp_extract(lower(file_path), '(\\.[^./]+)$', 1) AS extension FROM ents) x
        LEFT JOIN (VALUES {_LANGUAGES}) k(extension, language) ON k.extension = x.extension GROUP BY 1, 2"""
    ),
    "graph_stats": over("SELECT graph, 'entity' AS kind, type, count(*) AS n FROM ents GROUP BY 1, 3 UNION ALL SELECT graph, 'relationship', type, count(*) FROM rels GROUP BY 1, 3 UNION ALL SELECT graph, 'file', 'tracked', count(*) FROM (SELECT DISTINCT graph, file_path FROM source_files) GROUP BY 1"),
    "framework_catalogue": over(
        """SELECT coalesce(f.graph, c.graph) AS graph, trim(f.display_name) AS display_name, f.language, CASE WHEN f.graph IS NULL THEN NULL ELSE coalesce(len(f.patterns), 0) END AS n_patterns,
        coalesce(c.entities, 0) AS entities, coalesce(c.n_module, 0) AS n_module, coalesce(c.n_class, 0) AS n_class, coalesce(c.n_function, 0) AS n_function, coalesce(c.n_method, 0) AS n_method
        FROM (SELECT graph, count(*) AS entities, count(*) FILTER (type = 'module') AS n_module, count(*) FILTER (type = 'class') AS n_class,
          count(*) FILTER (type = 'function') AS n_function, count(*) FILTER (type = 'method') AS n_method FROM ents GROUP BY 1) c FULL JOIN frameworks f ON f.graph = c.graph"""
    ),
    "usage_frequency": over("SELECT graph, target_id AS id, count(*) AS usage FROM rels WHERE type = 'calls' AND target_id IS NOT NULL GROUP BY 1, 2"),
    "coupling": over(
        """SELECT e.graph, e.id, e.name, e.type, coalesce(a.n, 0) AS afferent, coalesce(o.n, 0) AS efferent FROM ents e
        LEFT JOIN (SELECT graph, target_id AS id, count(*) AS n FROM rels GROUP BY 1, 2) a ON a.graph = e.graph AND a.id = e.id
        LEFT JOIN (SELECT graph, source_id AS id, count(*) AS n FROM rels GROUP BY 1, 2) o ON o.graph = e.graph AND o.id = e.id"""
    ),
    "code_context": over(
        """SELECT r.graph, r.id, r.category, r.place, r.other, o.name AS other_name, o.type AS other_type FROM (
          SELECT *, row_number() OVER (PARTITION BY graph, id, category ORDER BY rel_id) AS place FROM (
            SELECT graph, source_id AS id, type AS category, target_id AS other, rel_id FROM rels WHERE type IN ('calls', 'imports', 'contains')
            UNION ALL SELECT graph, target_id, CASE WHEN type = 'calls' THEN 'called_by' ELSE 'contained_in' END, source_id, rel_id FROM rels WHERE type IN ('calls', 'contains'))
          WHERE id IS NOT NULL) r
        JOIN ents e ON e.graph = r.graph AND e.id = r.id LEFT JOIN ents o ON o.graph = r.graph AND o.id = r.other WHERE r.place <= 10"""
    ),
    "usage_examples": over(
        """SELECT c.graph, c.target_id AS id, c.place, e.name AS caller, e.file_path, e.line FROM (
          SELECT *, row_number() OVER (PARTITION BY graph, target_id ORDER BY rel_id) AS place FROM rels WHERE type = 'calls' AND target_id IS NOT NULL) c
        JOIN ents e ON e.graph = c.graph AND e.id = c.source_id WHERE c.place <= 5"""
    ),
    "relationship_label": over(
        """SELECT graph, a, b, arg_min(label, rel_id) AS label FROM (
          SELECT graph, least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, rel_id, CASE WHEN source_id <= target_id THEN type ELSE 'inverse_' || type END AS label
          FROM rels WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND type IS NOT NULL) GROUP BY 1, 2, 3"""
    ),
    "semantic_search": over(f"SELECT {_BRIEF}, round(s, 3) AS score FROM (SELECT *, {_relevance('load queue')} AS s FROM ents) WHERE s > 0 ORDER BY score DESC, graph, seq LIMIT 20"),
    "semantic_search_typed": over(
        f"SELECT {_BRIEF}, round(s, 3) AS score FROM (SELECT *, {_relevance('parse index')} AS s FROM ents) WHERE s > 0 AND type IN ('class', 'method') ORDER BY score DESC, graph, seq LIMIT 100"
    ),
    "relevance_distribution": over(
        f"""SELECT graph, count(*) FILTER (s >= 7) AS high, count(*) FILTER (s >= 3 AND s < 7) AS medium, count(*) FILTER (s < 3) AS low
        FROM (SELECT graph, {_relevance("load queue")} AS s FROM ents) WHERE s > 0 GROUP BY 1"""
    ),
    "search_all_frameworks": over(
        f"""SELECT {_BRIEF}, place, total_count, CASE WHEN length(docstring) > 200 THEN left(docstring, 200) || '...' ELSE docstring END AS docstring FROM (
          SELECT *, row_number() OVER (PARTITION BY graph ORDER BY lower(name) <> 'registry', length(name), seq) AS place, count(*) OVER (PARTITION BY graph) AS total_count FROM ents WHERE contains(lower(name), 'registry')) WHERE place <= 5"""
    ),
    "similar_patterns": over("SELECT graph, type, count(*) AS n, arg_min(name, seq) AS first_name FROM ents WHERE contains(lower(name), 'loader') GROUP BY 1, 2"),
    "pattern_examples": over(f"SELECT {_BRIEF}, left(docstring, 200) AS docstring FROM ents WHERE contains(lower(name), 'loader') ORDER BY graph, seq LIMIT 50"),
    "recommend_code": over(
        f"""SELECT {_BRIEF}, source, round(s, 6) AS score FROM (
          SELECT e.*, CASE WHEN e.graph = '{LOCAL}' THEN 'local' ELSE 'framework' END AS source, {_weighted("queue", "u")} AS s
          FROM (SELECT e.*, CASE WHEN e.graph = '{LOCAL}' THEN coalesce(c.usage, 0) ELSE 0 END AS u FROM ents e
            LEFT JOIN (SELECT graph, target_id AS id, count(*) AS usage FROM rels WHERE type = 'calls' GROUP BY 1, 2) c ON c.graph = e.graph AND c.id = e.id) e)
        WHERE s >= 0.1 ORDER BY score DESC, graph, seq LIMIT 50"""
    ),
    "hybrid_ranked": over(_hybrid_ranked("load queue")),
    "hybrid_search": _thinned("load queue"),
    "hybrid_search_words": _thinned("parse index"),
    "hybrid_breakdown": over(f"SELECT source, count(*) AS n FROM ({_hybrid_ranked('parse index')}) GROUP BY 1"),
    "recommend_breakdown": over(
        f"""SELECT source, count(*) AS n FROM (
          SELECT CASE WHEN e.graph = '{LOCAL}' THEN 'local' ELSE 'framework' END AS source, {_weighted("queue", "u")} AS s
          FROM (SELECT e.*, CASE WHEN e.graph = '{LOCAL}' THEN coalesce(c.usage, 0) ELSE 0 END AS u FROM ents e
            LEFT JOIN (SELECT graph, target_id AS id, count(*) AS usage FROM rels WHERE type = 'calls' GROUP BY 1, 2) c ON c.graph = e.graph AND c.id = e.id) e)
        WHERE s >= 0.1 GROUP BY 1"""
    ),
    "detect_frameworks": over(
        f"""SELECT e.graph, s.framework, count(DISTINCT s.sign) AS signs, count(*) AS names FROM (SELECT DISTINCT graph, lower(name) AS low FROM ents) e
        JOIN (VALUES {_SIGNS}) s(framework, sign) ON contains(e.low, lower(s.sign)) GROUP BY 1, 2"""
    ),
    "signature_render": over(
        """SELECT graph, id, name || '(' || coalesce(array_to_string(list_transform(p, lambda x: x[1] || CASE WHEN x[2] IS NULL THEN '' ELSE ': ' || x[2] END), ', '), '') || ')' || CASE WHEN r IS NULL THEN '' ELSE ' -> ' || r END AS signature
        FROM (SELECT graph, id, name, from_json(json_extract(extra_data, '$.parameters'), '[["VARCHAR"]]') AS p, json_extract_string(extra_data, '$.return_type') AS r FROM ents WHERE type IN ('function', 'method')) WHERE p IS NOT NULL"""
    ),
}
