"""Registered queries over the knowledge graph: traversal, quality, patterns, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.graph import KnowledgeGraph
from graphloom.operators import lookup, quality, traverse
from graphloom.plans.graph_queries import _kg, over


def _starts(g: KnowledgeGraph, where: str):
    """Start nodes (graph, root) among the entities, by a condition that follows the tables."""
    return g.entities.where(where).select("graph", F.col("id").alias("root"))


# Issues of the invented frameworks in the tables; the last one is for a later version.
_ISSUE_LIST = [("express", "4.0", "quota", "removed", ""), ("express", "4.2", "kit", "deprecated", ""), ("express", "9.0", "queue", "deprecated", "")]

_CLASSES = "type = 'enum'"
_TRAITS = "type = 'trait'"


def _paths(g: KnowledgeGraph):
    """From the first to the last entity of every file."""
    files = g.entities.where("file_path is not null").groupBy("graph", "file_path").agg(F.min_by("id", "seq").alias("source"), F.max_by("id", "seq").alias("target"))
    found = traverse.shortest_paths(g, files.select("graph", "source", "target"))
    return found.select("graph", "source", "target", "hops", F.array_join("path", " > ").alias("path"))


def _subgraph(g: KnowledgeGraph):
    ids = g.entities.where("type in ('class', 'interface', 'trait')").select("graph", "id")
    return traverse.subgraph(g, ids)[1].select("rel_id", "graph", "source_id", "target_id", "type")


QUERIES = {
    "neighbors_d1": _kg(lambda g: traverse.neighbours(g, _starts(g, _TRAITS), 1)),
    "neighbors_d2": _kg(lambda g: traverse.neighbours(g, _starts(g, _CLASSES), 2)),
    "shortest_path": _kg(_paths),
    "subgraph": _kg(_subgraph),
    "entity_context": _kg(lambda g: lookup.entity_edges(g, _starts(g, _TRAITS))),
    "impact": _kg(lambda g: traverse.impact(g, _starts(g, _TRAITS), 3)),
    "critical_paths": _kg(lambda g: traverse.critical_paths(g, _starts(g, _CLASSES))),
    "navigate_callees": _kg(lambda g: traverse.navigate(g, _starts(g, _TRAITS), "callees", 2)),
    "navigate_callers": _kg(lambda g: traverse.navigate(g, _starts(g, _TRAITS), "callers", 2, ["contains", "calls"])),
    "call_graph": _kg(lambda g: traverse.call_graph(g, _starts(g, _TRAITS))[1]),
    "navigate_depth_first": _kg(lambda g: traverse.navigate_depth_first(g, _starts(g, _TRAITS))),
    "communities": _kg(lambda g: traverse.communities(g)),
    "complexity": _kg(quality.complexities),
    "lcom": _kg(quality.cohesion),
    "quality_metrics": _kg(quality.quality_metrics),
    "quality_score": _kg(quality.quality_scores),
    "quality_recommendations": _kg(lambda g: quality.recommendations(quality.quality_metrics(g), g.entities)),
    "detect_patterns": _kg(quality.detect_patterns),
    "pattern_report": _kg(quality.pattern_report),
    "pattern_coverage": _kg(quality.pattern_coverage),
    "api_compatibility": _kg(lambda g: quality.compatibility(g, "express", "5.0", _ISSUE_LIST).drop("hint")),
    "compat_score": _kg(lambda g: quality.compatibility_scores(g, "express", "5.0", _ISSUE_LIST)),
    "api_compatibility_known": _kg(lambda g: quality.compatibility(g, "django", "4.2")),
    "relation_totals": _kg(lookup.relation_totals),
    "validate": _kg(quality.validate),
    "validation_summary": _kg(quality.validation_summary),
    "repair": _kg(lambda g: quality.repair(g).relationships),
    "repair_orphans": _kg(lambda g: quality.repair(g, remove_orphans=True).entities.select("graph", "id", "name", "type")),
}

_ADJ = "adj AS (SELECT DISTINCT graph, source_id AS src, target_id AS dst FROM rels WHERE source_id IS NOT NULL AND target_id IS NOT NULL)"
_UND = _ADJ + ", und AS (SELECT graph, src, dst FROM adj UNION SELECT graph, dst, src FROM adj)"


def _reach(edges: str, starts: str, depth: int) -> str:
    """Levels of a breadth-first walk, the smallest depth of each node."""
    return f"""walk AS (
      SELECT graph, id AS root, id, 0 AS depth FROM ents WHERE {starts}
      UNION
      SELECT w.graph, w.root, e.dst, w.depth + 1 FROM walk w JOIN {edges} e ON e.graph = w.graph AND e.src = w.id WHERE w.depth < {depth}),
    reach AS (SELECT graph, root, id, min(depth) AS depth FROM walk GROUP BY 1, 2, 3)"""


_NEAR = "SELECT r.graph, r.root, r.id, e.name, e.type, r.depth FROM reach r JOIN ents e ON e.graph = r.graph AND e.id = r.id WHERE r.depth > 0"
_NAV = "SELECT r.graph, r.root, r.id, e.name, e.type, r.depth FROM reach r JOIN ents e ON e.graph = r.graph AND e.id = r.id"

_COMPLEX = f"""cx AS (
  SELECT e.graph, e.id, e.type, least(50, 1 + coalesce(c.n, 0) // 3 + {" + ".join(f"(length(lower(coalesce(e.docstring, ''))) - length(replace(lower(coalesce(e.docstring, '')), '{w}', ''))) // {len(w)}" for w in quality.BRANCH_WORDS)}) AS complexity
  FROM ents e LEFT JOIN (SELECT graph, source_id AS id, count(*) AS n FROM rels WHERE type = 'calls' GROUP BY 1, 2) c ON c.graph = e.graph AND c.id = e.id)"""

_LCOM = """kids AS (SELECT graph, source_id AS id, target_id AS child, rel_id AS slot FROM rels WHERE type = 'contains' AND source_id IS NOT NULL AND target_id IS NOT NULL),
  tg AS (SELECT DISTINCT graph, source_id AS child, target_id AS target FROM rels WHERE source_id IS NOT NULL AND target_id IS NOT NULL),
  uses AS (SELECT k.graph, k.id, k.slot, t.target FROM kids k JOIN tg t ON t.graph = k.graph AND t.child = k.child),
  share AS (SELECT a.graph, a.id, count(DISTINCT (a.slot, b.slot)) AS sharing FROM uses a JOIN uses b ON a.graph = b.graph AND a.id = b.id AND a.target = b.target AND a.slot < b.slot GROUP BY 1, 2),
  lc AS (SELECT k.graph, k.id, k.children, coalesce(s.sharing, 0) AS sharing, CASE WHEN k.children <= 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - coalesce(s.sharing, 0)::DOUBLE / (k.children * (k.children - 1) / 2)::DOUBLE END AS lcom
    FROM (SELECT graph, id, count(*) AS children FROM kids GROUP BY 1, 2) k LEFT JOIN share s ON s.graph = k.graph AND s.id = k.id)"""

_STATUS = "CASE " + " ".join(f"WHEN metric = '{m}' AND value <= {g} THEN 'good' WHEN metric = '{m}' AND value <= {w} THEN 'warning'" for m, (g, w) in quality.THRESHOLDS.items()) + " ELSE 'danger' END"

_METRICS = (
    _COMPLEX
    + ", "
    + _LCOM
    + f""",
  mean AS (SELECT r.graph, r.source_id AS id, avg(c.complexity::DOUBLE) AS mean FROM rels r JOIN cx c ON c.graph = r.graph AND c.id = r.target_id AND c.type = 'method' WHERE r.type = 'contains' GROUP BY 1, 2),
  rows AS (
    SELECT e.graph, e.id, 'cyclomatic_complexity' AS metric, coalesce(m.mean, 0)::DOUBLE AS value FROM ents e LEFT JOIN mean m ON m.graph = e.graph AND m.id = e.id WHERE e.type IN ('class', 'module')
    UNION ALL SELECT e.graph, e.id, 'lcom', coalesce(l.lcom, 0)::DOUBLE FROM ents e LEFT JOIN lc l ON l.graph = e.graph AND l.id = e.id WHERE e.type IN ('class', 'module')
    UNION ALL SELECT graph, id, 'cyclomatic_complexity', complexity::DOUBLE FROM cx WHERE type IN ('function', 'method')
    UNION ALL SELECT graph, id, 'method_lines', CASE WHEN type = 'method' THEN 15 ELSE 20 END FROM ents WHERE type IN ('function', 'method')
    UNION ALL SELECT graph, id, 'parameter_count', CASE WHEN contains(docstring, 'Args:') THEN len(list_filter(string_split(string_split(string_split(docstring, 'Args:')[2], chr(10) || chr(10))[1], chr(10)), lambda x: trim(x) <> '' AND contains(x, ':'))) ELSE 2 END FROM ents WHERE type IN ('function', 'method')
    UNION ALL SELECT e.graph, e.id, 'afferent_coupling', count(r.rel_id) FROM ents e LEFT JOIN rels r ON r.graph = e.graph AND r.target_id = e.id GROUP BY 1, 2
    UNION ALL SELECT e.graph, e.id, 'efferent_coupling', count(r.rel_id) FROM ents e LEFT JOIN rels r ON r.graph = e.graph AND r.source_id = e.id GROUP BY 1, 2),
  metrics AS (SELECT graph, id, metric, value::DOUBLE AS value, {_STATUS} AS status FROM rows)"""
)


def _pattern_sql() -> str:
    parts = []
    for pattern, category, indicators in quality.PATTERNS:
        hits = " + ".join(f"2 * contains(lower(name), '{x.lower()}')::INT + contains(lower(coalesce(docstring, '')), '{x.lower()}')::INT" for x in indicators)
        bonus = {"Singleton": "loops", "Observer": "CASE WHEN afferent > 3 THEN 0.5 ELSE 0 END", "Facade": "CASE WHEN efferent > 5 THEN 0.5 ELSE 0 END"}.get(pattern, "0")
        parts.append(f"SELECT graph, id, name, '{pattern}' AS pattern, '{category}' AS category, (CASE WHEN {hits} > 0 THEN {hits} + {bonus} ELSE 0 END)::DOUBLE AS score FROM cand")
    return f"""cand AS (SELECT e.graph, e.id, e.name, e.docstring,
        (SELECT count(*) FROM rels r WHERE r.graph = e.graph AND r.target_id = e.id) AS afferent,
        (SELECT count(*) FROM rels r WHERE r.graph = e.graph AND r.source_id = e.id) AS efferent,
        (SELECT count(*) FROM rels r WHERE r.graph = e.graph AND r.source_id = e.id AND r.target_id = e.id) AS loops
      FROM ents e WHERE e.type IN ('class', 'function', 'method')),
    found AS (SELECT graph, id, name, pattern, category, round(least(score / 5, 1.0), 2)::DOUBLE AS confidence FROM ({" UNION ALL ".join(parts)}) WHERE score >= 2)"""


_APIS = "apis AS (SELECT * FROM (VALUES ('quota', 'removed'), ('kit', 'deprecated')) a(api, issue))"
_ISSUES = """issues AS (
  SELECT e.graph, e.id, a.api, a.issue, 'name' AS place FROM ents e JOIN apis a ON contains(lower(e.name), a.api)
  UNION ALL SELECT e.graph, e.id, a.api, a.issue, 'documentation' FROM ents e JOIN apis a ON contains(lower(e.docstring), a.api)
  UNION ALL SELECT r.graph, r.source_id, a.api, a.issue, 'import' FROM rels r JOIN ents t ON t.graph = r.graph AND t.id = r.target_id JOIN apis a ON contains(lower(t.name), a.api)
    JOIN ents s ON s.graph = r.graph AND s.id = r.source_id WHERE r.type = 'imports')"""

_VALID = """problems AS (
  SELECT r.graph, 'invalid_source' AS issue, 'error' AS severity, r.rel_id::VARCHAR AS subject FROM rels r WHERE NOT EXISTS (SELECT 1 FROM ents e WHERE e.graph = r.graph AND e.id = r.source_id)
  UNION ALL SELECT r.graph, 'invalid_target', 'error', r.rel_id::VARCHAR FROM rels r WHERE NOT EXISTS (SELECT 1 FROM ents e WHERE e.graph = r.graph AND e.id = r.target_id)
  UNION ALL SELECT e.graph, 'orphan', 'warning', e.id FROM ents e WHERE e.type <> 'module' AND NOT EXISTS (SELECT 1 FROM rels r WHERE r.graph = e.graph AND r.source_id = e.id) AND NOT EXISTS (SELECT 1 FROM rels r WHERE r.graph = e.graph AND r.target_id = e.id)
  UNION ALL SELECT graph, 'duplicate', 'warning', id FROM (SELECT *, row_number() OVER (PARTITION BY graph, file_path, name ORDER BY seq) AS n FROM ents) WHERE n > 1)"""

_SOUND = "sound AS (SELECT r.* FROM rels r JOIN ents a ON a.graph = r.graph AND a.id = r.source_id JOIN ents b ON b.graph = r.graph AND b.id = r.target_id)"

_INTO = "into_ AS (SELECT r.* FROM rels r JOIN ents s ON s.graph = r.graph AND s.id = r.source_id WHERE r.target_id IS NOT NULL), back AS (SELECT DISTINCT graph, target_id AS src, source_id AS dst FROM into_)"

SQL = {
    "neighbors_d1": over(_NEAR, f"{_UND}, {_reach('und', _TRAITS, 1)}", True),
    "neighbors_d2": over(_NEAR, f"{_UND}, {_reach('und', _CLASSES, 2)}", True),
    "shortest_path": over(
        "SELECT graph, source, target, len(path) - 1 AS hops, array_to_string(path, ' > ') AS path FROM walk WHERE id = target",
        f"""{_UND}, files AS (SELECT DISTINCT graph, arg_min(id, seq) AS source, arg_max(id, seq) AS target FROM ents WHERE file_path IS NOT NULL GROUP BY graph, file_path),
        pairs AS (SELECT f.* FROM files f WHERE EXISTS (SELECT 1 FROM und u WHERE u.graph = f.graph AND u.src = f.source)),
        dist(graph, target, id, depth) USING KEY (graph, target, id) AS (
          SELECT DISTINCT graph, target, target, 0 FROM pairs
          UNION
          SELECT DISTINCT f.graph, f.target, u.dst, f.depth + 1 FROM dist f JOIN und u ON u.graph = f.graph AND u.src = f.id
          LEFT JOIN recurring.dist k ON k.graph = f.graph AND k.target = f.target AND k.id = u.dst WHERE k.id IS NULL AND f.depth < 10),
        nearer AS (SELECT a.graph, a.target, a.id, min(b.id) AS next FROM dist a JOIN und u ON u.graph = a.graph AND u.src = a.id JOIN dist b ON b.graph = a.graph AND b.target = a.target AND b.id = u.dst AND b.depth = a.depth - 1 GROUP BY 1, 2, 3),
        walk AS (
          SELECT p.graph, p.source, p.target, p.source AS id, [p.source] AS path FROM pairs p
          UNION ALL
          SELECT w.graph, w.source, w.target, n.next, list_append(w.path, n.next) FROM walk w JOIN nearer n ON n.graph = w.graph AND n.target = w.target AND n.id = w.id)""",
        True,
    ),
    "subgraph": over("SELECT r.rel_id, r.graph, r.source_id, r.target_id, r.type FROM rels r JOIN k a ON a.graph = r.graph AND a.id = r.source_id JOIN k b ON b.graph = r.graph AND b.id = r.target_id", "k AS (SELECT graph, id FROM ents WHERE type IN ('class', 'interface', 'trait'))"),
    "entity_context": over(
        """SELECT x.graph, x.root, x.direction, x.place, x.other, o.name AS other_name, x.type FROM (
          SELECT *, row_number() OVER (PARTITION BY graph, root, direction ORDER BY rel_id) AS place FROM (
            SELECT graph, source_id AS root, target_id AS other, 'outgoing' AS direction, type, rel_id FROM rels UNION ALL SELECT graph, target_id, source_id, 'incoming', type, rel_id FROM rels)) x
        JOIN ents s ON s.graph = x.graph AND s.id = x.root AND s.type = 'trait' LEFT JOIN ents o ON o.graph = x.graph AND o.id = x.other WHERE x.place <= 10"""
    ),
    "impact": over(
        """SELECT graph, root, direct, indirect, round(direct + halves, 2)::DOUBLE AS score, CASE WHEN direct + halves >= 10 OR direct + indirect >= 20 THEN 'high' WHEN direct + halves >= 5 OR direct + indirect >= 10 THEN 'medium' ELSE 'low' END AS risk
        FROM (SELECT s.graph, s.id AS root, (SELECT count(*) FROM into_ i WHERE i.graph = s.graph AND i.target_id = s.id) AS direct,
          (SELECT count(*) FROM reach r WHERE r.graph = s.graph AND r.root = s.id AND r.depth > 1) AS indirect,
          coalesce((SELECT sum(pow(0.5, r.depth - 1)) FROM reach r WHERE r.graph = s.graph AND r.root = s.id AND r.depth > 1), 0) AS halves
          FROM ents s WHERE s.type = 'trait')""",
        f"{_INTO}, {_reach('back', _TRAITS, 3)}",
        True,
    ),
    "navigate_callees": over(_NAV, f"{_ADJ}, ine AS (SELECT a.* FROM adj a JOIN ents e ON e.graph = a.graph AND e.id = a.dst), {_reach('ine', _TRAITS, 2)}", True),
    "navigate_callers": over(_NAV, f"ine AS (SELECT DISTINCT r.graph, r.target_id AS src, r.source_id AS dst FROM rels r JOIN ents e ON e.graph = r.graph AND e.id = r.source_id WHERE r.target_id IS NOT NULL AND r.type IN ('contains', 'calls')), {_reach('ine', _TRAITS, 2)}", True),
    "call_graph": over(
        "SELECT DISTINCT r.graph, a.root, ea.name AS source, eb.name AS target, r.type FROM rels r JOIN reach a ON a.graph = r.graph AND a.id = r.source_id JOIN reach b ON b.graph = r.graph AND b.root = a.root AND b.id = r.target_id JOIN ents ea ON ea.graph = a.graph AND ea.id = a.id JOIN ents eb ON eb.graph = b.graph AND eb.id = b.id",
        f"{_UND}, ine AS (SELECT u.* FROM und u JOIN ents e ON e.graph = u.graph AND e.id = u.dst), {_reach('ine', _TRAITS, 3)}",
        True,
    ),
    "complexity": over("SELECT graph, id, type, complexity FROM cx", _COMPLEX),
    "lcom": over("SELECT graph, id, children, sharing, lcom FROM lc", _LCOM),
    "quality_metrics": over("SELECT graph, id, metric, value, status FROM metrics", _METRICS),
    "quality_score": over("SELECT graph, id, score, CASE WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'warning' ELSE 'danger' END AS overall FROM (SELECT graph, id, avg(CASE status WHEN 'good' THEN 100.0 WHEN 'warning' THEN 60.0 ELSE 20.0 END) AS score FROM metrics GROUP BY 1, 2)", _METRICS),
    "detect_patterns": over("SELECT graph, id, name, pattern, category, confidence FROM found WHERE confidence >= 0.4", _pattern_sql()),
    "pattern_coverage": over("SELECT e.graph, e.entities, coalesce(f.matched, 0) AS matched, coalesce(f.matched, 0) / e.entities AS coverage FROM (SELECT graph, count(*) AS entities FROM ents GROUP BY 1) e LEFT JOIN (SELECT graph, count(DISTINCT name) AS matched FROM found WHERE confidence >= 0.4 GROUP BY 1) f ON f.graph = e.graph", _pattern_sql()),
    "quality_recommendations": over(
        """SELECT m.graph, m.id, m.metric, CASE WHEN m.status = 'danger' THEN 'CRITICAL: ' || t.title || ' (' || n || ') exceeds danger threshold. Consider refactoring to reduce ' || lower(t.title) || '.'
            ELSE 'WARNING: ' || t.title || ' (' || n || ') is above optimal. Consider reviewing and optimizing.' END AS recommendation
        FROM (SELECT *, round_even(value, 2)::VARCHAR AS n FROM metrics WHERE status <> 'good') m JOIN ents e ON e.graph = m.graph AND e.id = m.id
        JOIN (VALUES ('cyclomatic_complexity', true, 'Average Cyclomatic Complexity'), ('cyclomatic_complexity', false, 'Cyclomatic Complexity'), ('lcom', true, 'LCOM (Cohesion)'), ('method_lines', false, 'Method Lines'), ('parameter_count', false, 'Parameter Count'),
          ('afferent_coupling', true, 'Afferent Coupling'), ('afferent_coupling', false, 'Afferent Coupling'), ('efferent_coupling', true, 'Efferent Coupling'), ('efferent_coupling', false, 'Efferent Coupling')) t(metric, container, title)
          ON t.metric = m.metric AND t.container = (e.type IN ('class', 'module'))""",
        _METRICS,
    ),
    "pattern_report": over(
        """SELECT f.graph, f.id, f.name, f.pattern, f.category, f.confidence, d.description, d.suggestion FROM found f JOIN (VALUES
          ('Singleton', 'Ensures a class has only one instance', 'Consider using dependency injection instead of Singleton for testability'), ('Factory Method', 'Defines interface for creating objects', 'Ensure factory method is properly abstracted for extensibility'),
          ('Builder', 'Separates construction of complex objects', NULL), ('Adapter', 'Converts interface of a class to another', NULL), ('Decorator', 'Attaches additional responsibilities dynamically', NULL), ('Facade', 'Provides unified interface to subsystems', NULL),
          ('Observer', 'Defines one-to-many dependency between objects', 'Consider weak references to prevent memory leaks'), ('Strategy', 'Defines family of interchangeable algorithms', 'Ensure strategies are interchangeable at runtime'),
          ('Command', 'Encapsulates request as an object', NULL), ('Template Method', 'Defines skeleton algorithm with customizable steps', NULL)) d(pattern, description, suggestion) ON d.pattern = f.pattern WHERE f.confidence >= 0.4""",
        _pattern_sql(),
    ),
    "relation_totals": over(
        """SELECT kind, type, n FROM (SELECT 'entity' AS kind, coalesce(type, '') AS type, count(*) AS n FROM ents GROUP BY 2 UNION ALL SELECT 'relationship', coalesce(type, ''), count(*) FROM rels GROUP BY 2)
        UNION ALL SELECT 'entity', NULL, count(*) FROM ents UNION ALL SELECT 'relationship', NULL, count(*) FROM rels"""
    ),
    "api_compatibility_known": over(
        """SELECT graph, id, api, issue, hint, 'name' AS place FROM ents JOIN known ON contains(lower(name), lower(api))
        UNION ALL SELECT graph, id, api, issue, hint, 'documentation' FROM ents JOIN known ON contains(lower(docstring), lower(api))
        UNION ALL SELECT r.graph, r.source_id, k.api, k.issue, k.hint, 'import' FROM rels r JOIN ents t ON t.graph = r.graph AND t.id = r.target_id JOIN known k ON contains(lower(t.name), lower(k.api)) JOIN ents s ON s.graph = r.graph AND s.id = r.source_id WHERE r.type = 'imports'""",
        "known(api, issue, hint) AS (VALUES ('url', 'removed', 'Use path() instead of url()'), ('ugettext', 'deprecated', 'Use gettext instead'), ('default_app_config', 'deprecated', 'Remove default_app_config from __init__.py'))",
    ),
    "api_compatibility": over("SELECT graph, id, api, issue, place FROM issues", f"{_APIS}, {_ISSUES}"),
    "compat_score": over("SELECT e.graph, count(i.id) AS issues, greatest(0, 100 - 10 * count(i.id)) AS score FROM (SELECT DISTINCT graph FROM ents) e LEFT JOIN issues i ON i.graph = e.graph GROUP BY 1", f"{_APIS}, {_ISSUES}"),
    "validate": over("SELECT graph, issue, severity, subject FROM problems", _VALID),
    "validation_summary": over("SELECT e.graph, count(p.issue) FILTER (severity = 'error') AS errors, count(p.issue) FILTER (severity = 'warning') AS warnings, count(p.issue) FILTER (severity = 'error') = 0 AS valid FROM (SELECT DISTINCT graph FROM ents) e LEFT JOIN problems p ON p.graph = e.graph GROUP BY 1", _VALID),
    "repair": over("SELECT rel_id, graph, source_id, target_id, type FROM sound", _SOUND),
    "repair_orphans": over("SELECT graph, id, name, type FROM ents e WHERE type = 'module' OR EXISTS (SELECT 1 FROM sound s WHERE s.graph = e.graph AND s.source_id = e.id) OR EXISTS (SELECT 1 FROM sound s WHERE s.graph = e.graph AND s.target_id = e.id)", _SOUND),
}
