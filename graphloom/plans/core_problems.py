"""Registered queries of the general data problems, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import drift, hierarchy, nested, references
from graphloom.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.parameter_rows(nested.entities_table(table(spark, sf_dir, "parse_records")))


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = nested.entities_table(table(spark, sf_dir, "parse_records"))
    return entities.select("record_id", "entity_id", "parent_id", "depth", "name", "type", "file_path", "line", "docstring", "n_members")


def p2_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.variant_counts(nested.entities_table(table(spark, sf_dir, "parse_records")))


def p2_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.routing_counts(nested.entities_table(table(spark, sf_dir, "parse_records")))


def p2_generic_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = nested.subtype_tables(nested.entities_table(table(spark, sf_dir, "parse_records")))
    return tables["generic_parameter"].select("record_id", "entity_id", "pos", "name", "base", F.size("arguments").alias("n_arguments"))


def p2_defaulted_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = nested.subtype_tables(nested.entities_table(table(spark, sf_dir, "parse_records")))
    return tables["defaulted_parameter"].select("record_id", "entity_id", "pos", "name", "base")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.deep_or_looping(table(spark, sf_dir, "entities"), table(spark, sf_dir, "relationships"))


def p3_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = hierarchy.hierarchy(table(spark, sf_dir, "entities"), table(spark, sf_dir, "relationships"))
    return walked.select("graph", "id", "root_id", "tree_depth", "kind", "n_descendants", F.array_join("path", "/").alias("path"))


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.ancestor_pairs(hierarchy.hierarchy(table(spark, sf_dir, "entities"), table(spark, sf_dir, "relationships")))


def p3_cycle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, relationships = table(spark, sf_dir, "entities"), table(spark, sf_dir, "relationships")
    return hierarchy.cycle_edges(hierarchy.parent_links(entities, relationships), hierarchy.hierarchy(entities, relationships, paths=False))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_changes(table(spark, sf_dir, "graph_snapshots"))


def p5_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of starts, endings and changes of type, before renames are told from it."""
    snapshots = table(spark, sf_dir, "graph_snapshots")
    places = drift.ordered(snapshots)
    return drift.starts_and_endings(drift.lifespans(drift.catalogue(snapshots, places)), places).drop("parent")


def p5_lifespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = table(spark, sf_dir, "graph_snapshots")
    return drift.lifespans(drift.catalogue(snapshots, drift.ordered(snapshots))).drop("parent")


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = table(spark, sf_dir, "graph_snapshots")
    return drift.consistent_entities(snapshots, drift.schema_changes(snapshots))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("rel_id", "side", "reason")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, sf_dir))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_references(table(spark, sf_dir, "relationships"), table(spark, sf_dir, "entities"), table(spark, sf_dir, "external_modules"))


QUERIES = {
    "p2_found": p2_found,
    "p2_entities": p2_entities,
    "p2_variants": p2_variants,
    "p2_routing": p2_routing,
    "p2_generic_parameters": p2_generic_parameters,
    "p2_defaulted_parameters": p2_defaulted_parameters,
    "p3_found": p3_found,
    "p3_hierarchy": p3_hierarchy,
    "p3_descendants": p3_descendants,
    "p3_cycle_edges": p3_cycle_edges,
    "p5_found": p5_found,
    "p5_events": p5_events,
    "p5_lifespans": p5_lifespans,
    "p5_entities": p5_entities,
    "p6_found": p6_found,
    "p6_report": p6_report,
}

_LINKS = r"""
keys AS (SELECT DISTINCT graph, lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS id FROM entities WHERE graph IS NOT NULL AND regexp_replace(id, '^\s+|\s+$', '', 'g') <> ''),
edges AS (
  SELECT r.graph, lower(regexp_replace(target_id, '^\s+|\s+$', '', 'g')) AS id, min(lower(regexp_replace(source_id, '^\s+|\s+$', '', 'g'))) AS parent
  FROM relationships r
  JOIN keys a ON a.graph = r.graph AND a.id = lower(regexp_replace(r.source_id, '^\s+|\s+$', '', 'g'))
  JOIN keys b ON b.graph = r.graph AND b.id = lower(regexp_replace(r.target_id, '^\s+|\s+$', '', 'g'))
  WHERE lower(regexp_replace(r.type, '^\s+|\s+$', '', 'g')) = 'contains' GROUP BY 1, 2),
scoped AS (
  SELECT graph, id, min(parent) AS parent FROM (
    SELECT a.graph, lower(regexp_replace(a.id, '^\s+|\s+$', '', 'g')) AS id, lower(regexp_replace(b.id, '^\s+|\s+$', '', 'g')) AS parent
    FROM entities a JOIN entities b ON a.graph = b.graph AND a.file_path = b.file_path AND a.scope = b.name
    WHERE lower(regexp_replace(a.id, '^\s+|\s+$', '', 'g')) <> lower(regexp_replace(b.id, '^\s+|\s+$', '', 'g')))
  GROUP BY 1, 2 HAVING count(DISTINCT parent) = 1),
links AS (
  SELECT * FROM edges UNION ALL
  SELECT * FROM scoped s WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph = s.graph AND e.id = s.id)),
tree AS (
  SELECT graph, id, id AS root_id, 0 AS tree_depth, id AS path FROM keys k
  WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.graph = k.graph AND l.id = k.id)
  UNION ALL
  SELECT l.graph, l.id, t.root_id, t.tree_depth + 1, t.path || '/' || l.id FROM tree t JOIN links l ON l.graph = t.graph AND l.parent = t.id),
lost AS (SELECT l.* FROM links l WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.graph = l.graph AND t.id = l.id)),
above AS (
  SELECT graph, id, parent AS up FROM lost
  UNION
  SELECT a.graph, a.id, l.parent FROM above a JOIN lost l ON l.graph = a.graph AND l.id = a.up),
loops AS (SELECT graph, id FROM above WHERE id = up),
low AS (
  SELECT a.graph, a.id, min(a.up) AS root_id FROM above a JOIN loops o ON o.graph = a.graph AND o.id = a.up GROUP BY 1, 2)
"""

_ORPHANS = r"""
refs AS (
  SELECT rel_id, graph, created_at AS moment, 'source' AS side, lower(regexp_replace(source_id, '^\s+|\s+$', '', 'g')) AS k FROM relationships
  UNION SELECT rel_id, graph, created_at, 'target', lower(regexp_replace(target_id, '^\s+|\s+$', '', 'g')) FROM relationships),
lives AS (
  SELECT DISTINCT graph, lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS k, created_at AS born, removed_at AS died FROM entities),
outside AS (SELECT DISTINCT lower(regexp_replace(target_id, '^\s+|\s+$', '', 'g')) AS k, added_at AS born, removed_at AS died FROM external_modules),
judged AS (
  SELECT r.rel_id, r.side, r.moment,
    count(x.born) AS n, coalesce(bool_or(x.born <= r.moment AND (x.died IS NULL OR x.died > r.moment)), false) AS ok, min(x.born) AS first_born
  FROM refs r LEFT JOIN (
    SELECT r2.rel_id, r2.side, l.born, l.died FROM refs r2 JOIN lives l ON l.graph = r2.graph AND l.k = r2.k
    UNION ALL
    SELECT r2.rel_id, r2.side, o.born, o.died FROM refs r2 JOIN outside o ON o.k = r2.k) x ON x.rel_id = r.rel_id AND x.side = r.side
  GROUP BY 1, 2, 3),
orphans AS (
  SELECT rel_id, side, moment, CASE WHEN n = 0 THEN 'missing' WHEN first_born > moment THEN 'late' ELSE 'deleted' END AS reason FROM judged WHERE NOT ok)
"""

_RECORDS = r"""
outer_ AS (SELECT record_id, payload AS p FROM parse_records WHERE json_valid(payload)),
texts AS (SELECT record_id, CASE WHEN json_type(p) = 'VARCHAR' THEN json_extract_string(p, '$') ELSE p END AS p FROM outer_),
docs AS (SELECT record_id, p FROM texts WHERE json_valid(p) AND json_type(p) = 'OBJECT'),
tree AS (
  SELECT record_id, unnest(json_extract(p, '$.entities[*]')) AS e, '' AS parent_id, 0 AS depth FROM docs
  UNION ALL
  SELECT record_id, unnest(json_extract(e, '$.members[*]')), coalesce(json_extract_string(e, '$.id'), ''), depth + 1 FROM tree),
placed AS (SELECT record_id, e, coalesce(json_extract_string(e, '$.id'), '') AS entity_id, parent_id, depth, coalesce(json_extract_string(e, '$.location.file'), '') AS file_path, json_extract(e, '$.parameters[*]') AS ps FROM tree)
"""

_PARAMETERS = """
each AS (SELECT record_id, entity_id, unnest(ps) AS q, generate_subscripts(ps, 1) - 1 AS pos FROM placed WHERE len(ps) > 0),
parts AS (
  SELECT *, CASE json_type(q) WHEN 'OBJECT' THEN json_extract_string(q, '$.name') WHEN 'ARRAY' THEN json_extract_string(q, '$[0]') WHEN 'VARCHAR' THEN json_extract_string(q, '$') END AS name,
    CASE json_type(q) WHEN 'OBJECT' THEN json_extract(q, '$.type') WHEN 'ARRAY' THEN json_extract(q, '$[1]') END AS t,
    CASE json_type(q) WHEN 'OBJECT' THEN list_contains(json_keys(q), 'default') ELSE false END AS defaulted FROM each),
routed AS (
  SELECT *, CASE WHEN name IS NULL OR json_type(t) NOT IN ('VARCHAR', 'OBJECT', 'NULL') THEN 'odd_parameter' WHEN defaulted THEN 'defaulted_parameter'
    WHEN json_type(t) = 'OBJECT' THEN 'generic_parameter' WHEN json_type(t) = 'VARCHAR' THEN 'named_parameter' ELSE 'untyped_parameter' END AS subtype FROM parts)
"""

_FIELDS = r"""
places AS (SELECT stream_name, snapshot_id, row_number() OVER (PARTITION BY stream_name ORDER BY taken_at, snapshot_id) AS seq FROM (SELECT stream_name, snapshot_id, min(taken_at) AS taken_at FROM graph_snapshots GROUP BY 1, 2)),
valid AS (SELECT DISTINCT stream_name, snapshot_id, CASE WHEN json_type(payload) = 'VARCHAR' THEN json_extract_string(payload, '$') ELSE payload END AS p FROM graph_snapshots WHERE json_valid(payload)),
docs AS (SELECT p.stream_name, p.seq, v.p FROM valid v JOIN places p USING (stream_name, snapshot_id) WHERE json_valid(v.p)),
nodes AS MATERIALIZED (SELECT d.stream_name, d.seq, t.id, t.parent, t.key, t.type FROM docs d, json_tree(d.p) t),
paths AS (
  SELECT stream_name, seq, id, '' AS path, type FROM nodes WHERE parent IS NULL
  UNION ALL
  SELECT n.stream_name, n.seq, n.id, CASE WHEN p.type = 'ARRAY' THEN p.path || '[]' WHEN p.path = '' THEN n.key ELSE p.path || '.' || n.key END, n.type
  FROM paths p JOIN nodes n ON n.stream_name = p.stream_name AND n.seq = p.seq AND n.parent = p.id),
kinds AS (SELECT stream_name, seq, path, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind FROM paths WHERE id <> 0),
fields AS (SELECT stream_name, seq, path, coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind), '') AS types FROM kinds GROUP BY 1, 2, 3)
"""

SQL = {
    "p2_found": f"""WITH RECURSIVE {_RECORDS}
        SELECT record_id, entity_id, parent_id, file_path, -1 AS pos, '' AS param_name FROM placed WHERE len(ps) = 0
        UNION ALL
        SELECT record_id, entity_id, parent_id, file_path, (pos - 1)::INT, coalesce(CASE json_type(q) WHEN 'OBJECT' THEN json_extract_string(q, '$.name') WHEN 'ARRAY' THEN json_extract_string(q, '$[0]') WHEN 'VARCHAR' THEN json_extract_string(q, '$') END, '')
        FROM (SELECT record_id, entity_id, parent_id, file_path, unnest(ps) AS q, generate_subscripts(ps, 1) AS pos FROM placed WHERE len(ps) > 0)""",
    "p2_entities": f"""WITH RECURSIVE {_RECORDS}
        SELECT record_id, entity_id, parent_id, depth, json_extract_string(e, '$.name') AS name, json_extract_string(e, '$.type') AS type, file_path, json_extract(e, '$.location.line')::BIGINT AS line,
          json_extract_string(e, '$.docstring') AS docstring, len(json_extract(e, '$.members[*]')) AS n_members FROM placed""",
    "p2_routing": f"""WITH RECURSIVE {_RECORDS}, {_PARAMETERS}
        SELECT subtype, count(*) AS n FROM routed GROUP BY 1
        UNION ALL
        SELECT CASE WHEN len(ps) > 0 THEN CASE WHEN members > 0 THEN 'callable_container_entity' ELSE 'callable_entity' END WHEN members > 0 THEN 'container_entity' ELSE 'plain_entity' END, count(*)
        FROM (SELECT ps, len(json_extract(e, '$.members[*]')) AS members FROM placed) GROUP BY 1""",
    "p2_generic_parameters": f"""WITH RECURSIVE {_RECORDS}, {_PARAMETERS}
        SELECT record_id, entity_id, pos, name, json_extract_string(t, '$.base') AS base, len(json_extract(t, '$.args[*]')) AS n_arguments FROM routed WHERE subtype = 'generic_parameter'""",
    "p2_defaulted_parameters": f"""WITH RECURSIVE {_RECORDS}, {_PARAMETERS}
        SELECT record_id, entity_id, pos, name, json_extract_string(t, '$.base') AS base FROM routed WHERE subtype = 'defaulted_parameter'""",
    "p3_found": f"""WITH RECURSIVE {_LINKS}
        SELECT graph, id, root_id, tree_depth FROM tree WHERE tree_depth >= 12
        UNION ALL SELECT graph, id, root_id, -1 FROM low""",
    "p3_hierarchy": f"""WITH RECURSIVE {_LINKS},
        sub AS (SELECT graph, id, tree_depth, path FROM tree),
        anc AS (SELECT graph, unnest(string_split(path, '/')) AS id FROM tree),
        below AS (SELECT graph, id, count(*) - 1 AS n FROM anc GROUP BY 1, 2)
        SELECT t.graph, t.id, t.root_id, t.tree_depth, 'tree' AS kind, b.n AS n_descendants, t.path
        FROM tree t JOIN below b ON b.graph = t.graph AND b.id = t.id
        UNION ALL
        SELECT w.graph, w.id, w.root_id, -1, CASE WHEN o.id IS NULL THEN 'below_loop' ELSE 'loop' END, NULL, NULL
        FROM low w LEFT JOIN loops o ON o.graph = w.graph AND o.id = w.id""",
    "p3_descendants": f"""WITH RECURSIVE {_LINKS}
        SELECT graph, ancestor, id, tree_depth - place + 1 AS distance
        FROM (SELECT graph, id, tree_depth, unnest(string_split(path, '/')) AS ancestor, generate_subscripts(string_split(path, '/'), 1) AS place FROM tree) WHERE place <= tree_depth""",
    "p3_cycle_edges": f"""WITH RECURSIVE {_LINKS}
        SELECT l.graph, w.root_id AS cycle_id, l.parent, l.id FROM links l JOIN loops o ON o.graph = l.graph AND o.id = l.id JOIN low w ON w.graph = l.graph AND w.id = l.id""",
    "p5_lifespans": f"""WITH RECURSIVE {_FIELDS},
islands AS (SELECT *, seq - row_number() OVER (PARTITION BY stream_name, path, types ORDER BY seq) AS island FROM fields)
SELECT stream_name, path AS field_path, types, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS snapshots FROM islands GROUP BY stream_name, path, types, island""",
    "p5_events": f"""WITH RECURSIVE {_FIELDS},
ends AS (SELECT stream_name, max(seq) AS end_seq FROM places GROUP BY 1),
steps AS (SELECT coalesce(a.stream_name, b.stream_name) AS stream_name, coalesce(b.seq, a.seq + 1) AS seq, coalesce(a.path, b.path) AS field_path, a.types AS before, b.types AS after
  FROM fields a FULL JOIN fields b ON b.stream_name = a.stream_name AND b.path = a.path AND b.seq = a.seq + 1)
SELECT * FROM (
  SELECT stream_name, seq, field_path, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' WHEN before <> after AND before <> '' AND after <> '' THEN 'retyped' END AS event FROM steps JOIN ends USING (stream_name) WHERE seq > 1 AND seq <= end_seq)
WHERE event = 'retyped' OR event IS NOT NULL AND NOT ends_with(field_path, '[]')""",
    "p6_found": f"WITH {_ORPHANS} SELECT rel_id, side, reason FROM orphans",
    "p6_report": f"""WITH {_ORPHANS}
        SELECT 'relationships.' || side || '_id' AS reference, strftime(moment, '%Y-%m') AS period, reason, count(*) AS n FROM orphans GROUP BY 1, 2, 3""",
}
