"""Registered queries: guidance, documentation, history, changes, declarations in source files."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.graph import KnowledgeGraph, current_entities
from graphloom.operators import declarations, documentation, evolution, guidance, lookup, mutate
from graphloom.plans.graph_queries import _LANGUAGES as LANGUAGES_SQL
from graphloom.plans.graph_queries import _kg, over
from graphloom.session import ensure_checkpoint_dir, table
from graphloom.sources import catalogue, external_index, graph_json
from graphloom.streaming import watch

TASK = "load the typed queue"


def _files(f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, "source_files"))


def _facts(f):
    return lambda spark, sf_dir: f(declarations.facts(table(spark, sf_dir, "source_files")))


def _commits(f):
    return lambda spark, sf_dir: f(evolution.commit_log(table(spark, sf_dir, "events")))


def _snapshots(documents):
    """Two states of the documents as files: the first lacks every tenth, the second the ones after it, and every third text differs."""
    file = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    rows = documents.where("text is not null").select(F.coalesce("source", F.lit("")).alias("graph"), file.alias("file_path"), "doc_id", "text")
    before = rows.where("doc_id % 10 <> 0").select("graph", "file_path", F.sha2("text", 256).alias("hash_value"))
    after = rows.where("doc_id % 10 <> 1").select("graph", "file_path", F.sha2(F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash_value"))
    return before.dropDuplicates(["graph", "file_path"]), after.dropDuplicates(["graph", "file_path"])


def _incremental(spark, sf_dir):
    before, after = _snapshots(table(spark, sf_dir, "documents"))
    return mutate.classify_files(after, before)


def _deleted(spark, sf_dir):
    before, after = _snapshots(table(spark, sf_dir, "documents"))
    return before.join(after, ["graph", "file_path"], "left_anti").select("graph", "file_path")


def _remove_modules(g: KnowledgeGraph):
    files = g.entities.where("type = 'trait'").select("graph", "file_path")
    return mutate.remove_files(g, files).relationships


def _upsert(g: KnowledgeGraph):
    rows = g.entities.where("type = 'class'").withColumn("docstring", F.lit("revised")).withColumn("name", F.upper("name"))
    return mutate.upsert_entities(g, rows).entities.select("graph", "id", "name", "type", "docstring")


def _replace(g: KnowledgeGraph):
    other = KnowledgeGraph(g.entities.where("type = 'class' and id like '%1'"), g.relationships.where("type = 'inherits'"))
    return mutate.replace_by_prefix(g, "class_", other).entities.select("graph", "id", "name")


def _versions(spark, sf_dir):
    """Version numbers built from part sizes, compared with one another's neighbours."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string"), (F.col("p_partkey") % 3).cast("string")).alias("version"))
    return p.select("p_partkey", "version", text.version_order(F.col("version"), F.lit("25.3")).alias("order_to_25_3"))


def _snippets(spark, sf_dir):
    """Three lines around each class-like declaration."""
    files = table(spark, sf_dir, "source_files")
    spans = declarations.declarations(declarations.facts(files)).where("kind in ('class', 'struct', 'interface', 'trait', 'enum')").select("graph", "file_path", "id", "line")
    return lookup.snippets(KnowledgeGraph(spans, spans), files, context=1)


def _blocks(spark, sf_dir):
    """A block of every file, from a line that its number gives."""
    files = table(spark, sf_dir, "source_files")
    spans = files.select("graph", "file_path", F.col("file_id").cast("string").alias("id"), (F.col("file_id") % 50 + 1).cast("int").alias("line"))
    return lookup.source_blocks(KnowledgeGraph(spans, spans), files)


def _saved_graphs(spark, sf_dir):
    """The saved graphs among the snapshots, read by the schema of graph files; each snapshot is a graph."""
    rows = table(spark, sf_dir, "graph_snapshots").where("payload is not null and graph <> 'summary'")
    parsed = rows.select(F.concat_ws("#", "stream_name", F.col("snapshot_id").cast("string")).alias("graph"), F.from_json("payload", graph_json.SCHEMA).alias("p"))
    return graph_json.from_documents(parsed.select("graph", "p.*"))


def _watched(spark, sf_dir):
    """The source files as a stream of states, run to its end; the ledger that results."""
    ensure_checkpoint_dir(spark)
    out = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/watch-{uuid.uuid4().hex}"
    source = f"{sf_dir}/source_files.parque[t]"  # a pattern, as a stream takes no single file
    states = spark.readStream.schema(table(spark, sf_dir, "source_files").schema).parquet(source).select("graph", "file_path", "hash_value", F.col("updated_at").cast("timestamp").alias("at"))
    watch.start_ledger(watch.file_changes(states), f"{out}/changes", f"{out}/state").awaitTermination()
    return watch.ledger(spark.read.schema("graph string, file_path string, status string, hash_value string, at timestamp").parquet(f"{out}/changes"))


def _tasks(g: KnowledgeGraph):
    return guidance.suggest_names(g.entities.where("docstring is not null").select(F.col("docstring").alias("task")).distinct())


def _summaries(spark, sf_dir):
    """The frameworks in the catalogue summaries among the snapshots."""
    rows = table(spark, sf_dir, "graph_snapshots").where("graph = 'summary'").select("snapshot_id", "payload")
    found = catalogue.from_summaries(rows)
    return found.select("snapshot_id", "name", "language", "files", "entities", "relationships", F.coalesce(F.size("entity_types"), F.lit(0)).alias("n_types"), "graph_file")


def _number(*parts: str):
    """A number of a text that any engine can work out."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("bigint")


def _index(g: KnowledgeGraph):
    """The graph in the tables of an external index."""
    e = g.entities.where("file_path is not null")
    files = e.groupBy("graph", "file_path").agg(F.max("seq").alias("last_indexed")).select(_number("graph", "file_path").alias("id"), F.col("file_path").alias("path"), F.lit("any").alias("language"), "last_indexed")
    nodes = e.select(
        _number("graph", "id").alias("id"), _number("graph", "file_path").alias("file_id"), "name", F.col("type").alias("kind"), F.col("line").cast("bigint").alias("line"), F.col("col").cast("bigint").alias("col"),
        "scope", F.when(F.col("scope") == "public", 1).otherwise(0).cast("bigint").alias("is_exported"), F.col("docstring").alias("signature"),
    )
    ends = g.relationships.where("source_id is not null and target_id is not null")
    return {"files": files, "nodes": nodes, "edges": ends.select(_number("graph", "source_id").alias("from_id"), _number("graph", "target_id").alias("to_id"), F.col("type").alias("kind"))}


def _semver(spark, sf_dir):
    """Version numbers built from the parts, in their order."""
    p = table(spark, sf_dir, "part")
    number = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string"), (F.col("p_partkey") % 3).cast("string"))
    version = F.when(F.col("p_partkey") % 5 == 0, F.concat(number, F.lit("-rc."), (F.col("p_partkey") % 13).cast("string"))).otherwise(number)
    versions = p.select(version.alias("version")).distinct()
    near = Window.partitionBy(F.split("version", r"\.")[0]).orderBy(text.semver_key(F.col("version")))
    return versions.select("version", F.lag("version").over(near).alias("before"))


QUERIES = {
    "semver_order": _semver,
    "external_import_entities": _kg(lambda g: external_index.to_graph(_index(g), "work")[0].entities.drop("extra_data")),
    "external_import_edges": _kg(lambda g: external_index.to_graph(_index(g), "work")[0].relationships.drop("rel_id")),
    "external_skipped_edges": _kg(lambda g: external_index.to_graph(_index(g), "work")[1]),
    "external_stats": _kg(lambda g: external_index.index_info(_index(g))),
    "naming_convention": _kg(guidance.naming_conventions),
    "similar_entities": _kg(lambda g: guidance.similar_entities(g, TASK)),
    "directory_suggestion": _kg(lambda g: guidance.suggested_directories(g, TASK)),
    "import_suggestions": _kg(lambda g: guidance.suggested_imports(g, TASK, "module")),
    "suggested_name": _kg(_tasks),
    **{f"documentation_{form}": _kg(lambda g, form=form: documentation.documentation(g, form)) for form in documentation.FORMATS},
    "codebase_overview": _kg(documentation.codebase_overview),
    "hotspots": _commits(evolution.hotspots),
    "evolution_timeline": _commits(evolution.timeline),
    "incremental_classify": _incremental,
    "deleted_files": _deleted,
    "file_hash": _files(mutate.content_hash),
    "remove_file": _kg(_remove_modules),
    "upsert_entities": _kg(_upsert),
    "replace_import": _kg(_replace),
    "delete_edges": _kg(lambda g: mutate.delete_edges(g, kind="calls").relationships),
    "version_compare": _versions,
    "declarations": _facts(declarations.declarations),
    "declared_imports": _facts(lambda found: declarations.links(found, "imports")),
    "declared_calls": _facts(lambda found: declarations.links(found, "calls")),
    "declared_bases": _facts(lambda found: declarations.links(found, "inherits", "implements", "uses_type")),
    "parse_totals": _facts(declarations.parse_totals),
    "parsed_files": _facts(lambda found: found.where("fact = 'entity' and place = 0").select("file_id", "graph", "file_path", "name", F.col("end_line").alias("lines"))),
    "parsed_python": _facts(lambda found: declarations.declarations(found).where("lower(file_path) like '%.py'").select("file_id", "kind", "name", "line")),
    "parsed_entities": _facts(lambda found: declarations.to_graph(found).entities.drop("extra_data")),
    "list_languages": lambda spark, sf_dir: table(spark, sf_dir, "source_files").select(lookup.language_of(F.col("file_path")).alias("language")).distinct(),
    "source_snippet": _snippets,
    "source_block": _blocks,
    "watch_stream": _watched,
    "snapshot_entities": lambda spark, sf_dir: _saved_graphs(spark, sf_dir).entities.drop("extra_data"),
    "snapshot_edges": lambda spark, sf_dir: _saved_graphs(spark, sf_dir).relationships.select("graph", "source_id", "target_id", "type"),
    "snapshot_hashes": lambda spark, sf_dir: _saved_graphs(spark, sf_dir).file_hashes,
    "summary_frameworks": _summaries,
    "graph_documents": _kg(graph_json.to_documents),
    "docstring_truncate": lambda spark, sf_dir: current_entities(table(spark, sf_dir, "entities")).select("graph", "id", text.clipped(F.col("docstring")).alias("docstring"), text.cut_short(F.col("docstring")).alias("short")),
    "identifier_words": _kg(lambda g: g.entities.select("graph", "id", F.array_join(F.array_sort(text.identifier_words(F.col("name"))), " ").alias("words"))),
}

_DOCS = "docs AS (SELECT coalesce(source, '') AS graph, 'doc/' || doc_id AS file_path, doc_id, text FROM documents WHERE text IS NOT NULL), before AS (SELECT DISTINCT graph, file_path, sha256(text) AS h FROM docs WHERE doc_id % 10 <> 0), after AS (SELECT DISTINCT graph, file_path, sha256(CASE WHEN doc_id % 10 = 2 THEN text || '!' ELSE text END) AS h FROM docs WHERE doc_id % 10 <> 1)"
_LOG = "log AS (SELECT event_type || '/' || (user_id % 100) AS file_path, user_id AS author, ts AS at_, floor(value)::BIGINT AS lines, event_id AS commit_id FROM events)"


def _similar(kind: str, n: int, task: str = TASK) -> str:
    score = " + ".join(f"2 * contains(lower(name), '{w}')::INT + contains(lower(coalesce(docstring, '')), '{w}')::INT" for w in sorted(set(task.split())))
    return f"sim AS (SELECT * FROM (SELECT *, {score} AS score, row_number() OVER (PARTITION BY graph ORDER BY seq) AS place FROM ents WHERE type = '{kind}' AND {score} > 0) WHERE place <= {n})"


_NL = "chr(10)"
_CTX = f"""ends AS (
  SELECT graph, source_id AS id, target_id AS other, type AS kind, rel_id FROM rels WHERE type IN ('calls', 'imports')
  UNION ALL SELECT graph, target_id, source_id, 'callers', rel_id FROM rels WHERE type = 'calls'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY graph, id, kind ORDER BY rel_id) AS place FROM ends WHERE id IS NOT NULL AND graph IS NOT NULL),
known AS (SELECT n.graph, n.id, n.kind, n.place, o.name, o.type, o.file_path, o.line FROM numbered n JOIN ents o ON o.graph = n.graph AND o.id = n.other WHERE n.place <= 10),
told AS (
  SELECT graph, id,
    string_agg({_NL} || '- `' || name || '`', '' ORDER BY place) FILTER (kind = 'imports') AS imports,
    string_agg({_NL} || '- `' || name || '` (' || type || ')', '' ORDER BY place) FILTER (kind = 'calls') AS calls,
    string_agg({_NL} || '- `' || name || '` (' || type || ')', '' ORDER BY place) FILTER (kind = 'callers') AS users,
    string_agg({_NL} || '- `' || name || '` in `' || file_path || ':' || line || '`', '' ORDER BY place) FILTER (kind = 'callers' AND place <= 5) AS examples,
    string_agg({_NL} || ' * @see ' || name, '' ORDER BY place) FILTER (kind = 'calls' AND place <= 5) AS sees,
    string_agg({_NL} || '    ' || name || ': ' || type, '' ORDER BY place) FILTER (kind = 'calls' AND place <= 5) AS attributes,
    string_agg({_NL} || name || ' : ' || type, '' ORDER BY place) FILTER (kind = 'calls' AND place <= 5) AS also,
    string_agg({_NL} || ':seealso: :class:`' || name || '`', '' ORDER BY place) FILTER (kind = 'calls' AND place <= 5) AS classes
  FROM known GROUP BY 1, 2),
kinds AS (SELECT graph, id, count(*) FILTER (kind = 'imports') AS ni, count(*) FILTER (kind = 'calls') AS nc, count(*) FILTER (kind = 'callers') AS nu FROM numbered GROUP BY 1, 2),
d AS (SELECT e.graph, e.id, e.name, e.type, e.file_path, e.line, nullif(e.docstring, '') AS doc, coalesce(k.ni, 0) AS ni, coalesce(k.nc, 0) AS nc, coalesce(k.nu, 0) AS nu, t.* EXCLUDE (graph, id)
  FROM ents e LEFT JOIN kinds k ON k.graph = e.graph AND k.id = e.id LEFT JOIN told t ON t.graph = e.graph AND t.id = e.id)"""

_QUOTED = f"""'\"\"\"' || {_NL} || coalesce(doc, name) || {_NL}"""
_TEXTS = {
    "markdown": f"""concat('# ', name, {_NL}, {_NL}, '**Type**: `', type, '`  ', {_NL}, '**File**: `', file_path, '`  ', {_NL}, '**Line**: ', line, {_NL},
      CASE WHEN doc IS NOT NULL THEN {_NL} || '## Description' || {_NL} || {_NL} || doc || {_NL} END,
      CASE WHEN ni + nc > 0 THEN {_NL} || '## Dependencies' || {_NL} END,
      CASE WHEN ni > 0 THEN {_NL} || '### Imports' || coalesce(imports, '') || {_NL} END,
      CASE WHEN nc > 0 THEN {_NL} || '### Calls' || coalesce(calls, '') || {_NL} END,
      CASE WHEN nu > 0 THEN {_NL} || '## Used By' || {_NL} || coalesce(users, '') || {_NL} END,
      CASE WHEN examples IS NOT NULL THEN {_NL} || '## Usage Examples' || {_NL} || examples || {_NL} END)""",
    "jsdoc": f"""concat('/**', {_NL}, ' * ', replace(coalesce(doc, name), {_NL}, {_NL} || ' * '), {_NL}, ' *', {_NL}, ' * @type {{', type, '}}', {_NL}, ' * @file ', file_path, sees, {_NL}, ' */')""",
    "google": f"""concat({_QUOTED}, CASE WHEN nc > 0 THEN {_NL} || 'Attributes:' || coalesce(attributes, '') END, {_NL}, '\"\"\"')""",
    "numpy": f"""concat({_QUOTED}, CASE WHEN nc > 0 THEN {_NL} || 'See Also' || {_NL} || '--------' || coalesce(also, '') END, {_NL}, '\"\"\"')""",
    "sphinx": f"""concat({_QUOTED}, {_NL}, ':type: ', type, {_NL}, ':file: ', file_path, classes, {_NL}, '\"\"\"')""",
}

_UNION_REMOVED = "gone AS (SELECT DISTINCT e.graph, e.id FROM ents e JOIN (SELECT DISTINCT graph, file_path FROM ents WHERE type = 'trait') f ON f.graph = e.graph AND f.file_path = e.file_path)"

def _n(*parts: str) -> str:
    return f"('0x' || left(md5({' || chr(124) || '.join(parts)}), 15))::BIGINT"


_INDEX = f"""files AS (SELECT {_n("graph", "file_path")} AS id, file_path AS path, max(seq) AS last_indexed FROM ents WHERE file_path IS NOT NULL GROUP BY graph, file_path),
  nodes AS (SELECT {_n("graph", "id")} AS id, {_n("graph", "file_path")} AS file_id, name, type AS kind, line, col, scope, file_path, docstring FROM ents WHERE file_path IS NOT NULL),
  edges AS (SELECT {_n("graph", "source_id")} AS from_id, {_n("graph", "target_id")} AS to_id, type AS kind FROM rels WHERE source_id IS NOT NULL AND target_id IS NOT NULL)"""

SQL = {
    "semver_order": """SELECT version, lag(version) OVER (PARTITION BY a ORDER BY a, b, c, rc) AS before FROM (
        SELECT DISTINCT p_size || '.' || p_partkey % 7 || '.' || p_partkey % 3 || CASE WHEN p_partkey % 5 = 0 THEN '-rc.' || p_partkey % 13 ELSE '' END AS version, p_size AS a, p_partkey % 7 AS b, p_partkey % 3 AS c, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 13 ELSE 99 END AS rc FROM part)""",
    "external_import_entities": over(
        """SELECT 'work' AS graph, id AS seq, 'comp:work:f' || id AS id, path AS name, 'module' AS type, path AS file_path, 1 AS line, 0 AS col, 'language=any' AS docstring, 'public' AS scope FROM files
        UNION ALL SELECT 'work', id + 1099511627776, 'comp:work:n' || id, name, CASE WHEN kind IN ('function', 'class', 'interface', 'struct', 'enum', 'type', 'variable', 'module', 'method') THEN kind ELSE 'variable' END, file_path, greatest(line, 1), greatest(col, 0), docstring,
          CASE WHEN scope = 'public' THEN 'public' ELSE 'private' END FROM nodes""",
        _INDEX,
    ),
    "external_import_edges": over(
        """SELECT 'work' AS graph, 'comp:work:f' || file_id AS source_id, 'comp:work:n' || id AS target_id, 'contains' AS type FROM nodes
        UNION ALL SELECT 'work', 'comp:work:n' || o.id, 'comp:work:n' || n.id, 'contains' FROM nodes n JOIN (SELECT file_id, name, min(id) AS id FROM nodes GROUP BY 1, 2 HAVING count(*) = 1) o ON o.file_id = n.file_id AND o.name = n.scope AND o.id <> n.id WHERE n.scope <> ''
        UNION ALL SELECT 'work', 'comp:work:n' || from_id, 'comp:work:n' || to_id, CASE WHEN kind IN ('imports', 'calls', 'references', 'implements') THEN kind ELSE 'depends_on' END FROM edges WHERE from_id IN (SELECT id FROM nodes) AND to_id IN (SELECT id FROM nodes)""",
        _INDEX,
    ),
    "external_skipped_edges": over("SELECT from_id, to_id, kind FROM edges WHERE from_id NOT IN (SELECT id FROM nodes) OR to_id NOT IN (SELECT id FROM nodes)", _INDEX),
    "external_stats": over("SELECT (SELECT count(*) FROM files) AS files, (SELECT max(last_indexed) FROM files) AS last_indexed, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges", _INDEX),
    "parsed_files": r"""SELECT file_id, coalesce(graph, '') AS graph, file_path, regexp_extract(file_path, '([^/]*)$', 1) AS name,
        length(replace(replace(source_text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) - length(replace(replace(replace(source_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), '')) + 1 AS lines
        FROM source_files WHERE source_text IS NOT NULL AND file_path IS NOT NULL""",
    "source_block": """SELECT f.graph, f.file_id::VARCHAR AS id, f.file_path, (f.file_id % 50 + 1)::INT AS line, array_to_string(l.lines[f.file_id % 50 + 1 : f.file_id % 50 + 30], chr(10)) AS snippet
        FROM source_files f JOIN (SELECT graph, file_path, string_split(arg_max(source_text, (updated_at, file_id)), chr(10)) AS lines FROM source_files WHERE source_text IS NOT NULL GROUP BY 1, 2) l ON l.graph = f.graph AND l.file_path = f.file_path
        WHERE len(l.lines) >= f.file_id % 50 + 1""",
    "list_languages": f"""SELECT DISTINCT k.language FROM (SELECT regexp_extract(lower(file_path), '(\\.[^./]+)$', 1) AS extension FROM source_files) f LEFT JOIN (VALUES {LANGUAGES_SQL}) k(extension, language) ON k.extension = f.extension""",
    "naming_convention": over(
        """SELECT graph, type, convention, n, row_number() OVER (PARTITION BY graph, type ORDER BY n DESC, list_position(['snake_case', 'camelCase', 'PascalCase'], convention)) = 1 AS chosen FROM (
        SELECT graph, type, convention, count(*) AS n FROM (SELECT graph, type, CASE WHEN contains(name, '_') AND lower(name) = name AND upper(name) <> name THEN 'snake_case' WHEN regexp_matches(name, '^[A-Z]') AND NOT contains(name, '_') THEN 'PascalCase'
          WHEN regexp_matches(name, '^[a-z]') AND NOT contains(name, '_') AND lower(name) <> name THEN 'camelCase' END AS convention FROM ents) WHERE convention IS NOT NULL GROUP BY 1, 2, 3)"""
    ),
    "similar_entities": over("SELECT graph, place, id, name, file_path, score, seq FROM sim", _similar("class", 10)),
    "directory_suggestion": over(
        "SELECT graph, directory, n FROM (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY n DESC, first_seq) AS rn FROM (SELECT graph, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS directory, count(*) AS n, min(seq) AS first_seq FROM sim GROUP BY 1, 2) WHERE directory <> '') WHERE rn = 1",
        _similar("class", 10),
    ),
    "import_suggestions": over(
        "SELECT DISTINCT r.graph, coalesce('from ' || replace(replace(t.file_path, '/', '.'), '.py', '') || ' import ' || t.name, 'import ' || regexp_replace(r.target_id, '^(?:external:|ext_)', '')) AS statement FROM rels r JOIN sim s ON s.graph = r.graph AND s.id = r.source_id LEFT JOIN ents t ON t.graph = r.graph AND t.id = r.target_id WHERE r.type = 'imports' AND r.target_id IS NOT NULL",
        _similar("module", 5),
    ),
    "suggested_name": over(
        """SELECT task, array_to_string(list_transform(w, lambda x: lower(x)), '_') AS snake_case, lower(w[1]) || coalesce(array_to_string(list_transform(w[2:3], lambda x: upper(x[1]) || lower(x[2:])), ''), '') AS camel_case,
          array_to_string(list_transform(w, lambda x: upper(x[1]) || lower(x[2:])), '') AS pascal_case
        FROM (SELECT task, CASE WHEN len(v) > 0 THEN v[1:3] ELSE ['New', 'Class'] END AS w FROM (
          SELECT task, list_filter(string_split_regex(trim(task), '\\s+'), lambda x: x <> '' AND lower(x) NOT IN ('a', 'an', 'the', 'to', 'for', 'of', 'in', 'on', 'with', 'new', 'create')) AS v
          FROM (SELECT DISTINCT docstring AS task FROM ents WHERE docstring IS NOT NULL)))"""
    ),
    "summary_frameworks": """WITH s AS (SELECT snapshot_id, json_extract(payload, '$.frameworks') AS f FROM graph_snapshots WHERE graph = 'summary' AND json_valid(payload)),
        rows AS (
          SELECT snapshot_id, replace(lower(coalesce(json_extract_string(v, '$.name'), '')), ' ', '-') AS name, v FROM (SELECT snapshot_id, unnest(json_extract(f, '$[*]')) AS v FROM s WHERE json_type(f) = 'ARRAY')
          UNION ALL
          SELECT snapshot_id, k, json_extract(f, '$.\"' || k || '\"') FROM (SELECT snapshot_id, f, unnest(json_keys(f)) AS k FROM s WHERE json_type(f) = 'OBJECT'))
        SELECT snapshot_id, name, json_extract_string(v, '$.language') AS language, coalesce(try_cast(json_extract_string(v, '$.files_processed') AS BIGINT), 0) AS files,
          coalesce(try_cast(json_extract_string(v, '$.entities') AS BIGINT), try_cast(json_extract_string(v, '$.entity_count') AS BIGINT), 0) AS entities, coalesce(try_cast(json_extract_string(v, '$.relationships') AS BIGINT), 0) AS relationships,
          coalesce(len(json_keys(v, '$.entity_types')), 0) AS n_types, json_extract_string(v, '$.graph_file') AS graph_file FROM rows""",
    **{f"documentation_{form}": over(f"SELECT graph, id, {sql} AS text FROM d", _CTX) for form, sql in _TEXTS.items()},
    "codebase_overview": over(
        f"SELECT graph, concat_ws({_NL}, 'Entities: ' || sum(n), string_agg('- ' || type || ': ' || n, {_NL} ORDER BY n DESC, type)) AS text FROM (SELECT graph, type, count(*) AS n FROM ents GROUP BY 1, 2) GROUP BY 1"
    ),
    "hotspots": f"""WITH {_LOG} SELECT file_path, commits, authors, lines, round(raw, 6) AS score, raw >= 0.7 AS hotspot FROM (
        SELECT *, 0.5::DOUBLE * least(commits / 30, 1.0) + 0.3::DOUBLE * least(authors / 5, 1.0) + 0.2::DOUBLE * least(lines / 500, 1.0) AS raw FROM (
          SELECT file_path, count(*) AS commits, count(DISTINCT author) AS authors, sum(lines)::BIGINT AS lines FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY at_ DESC, commit_id DESC) AS rn FROM log) WHERE rn <= 50 GROUP BY 1))""",
    "evolution_timeline": f"""WITH {_LOG} SELECT *, (sum(commits) OVER (PARTITION BY file_path ORDER BY month))::BIGINT AS commits_so_far FROM (
        SELECT file_path, strftime(at_, '%Y-%m') AS month, count(*) AS commits, sum(lines)::BIGINT AS lines FROM log GROUP BY 1, 2)""",
    "incremental_classify": f"WITH {_DOCS} SELECT coalesce(a.graph, b.graph) AS graph, coalesce(a.file_path, b.file_path) AS file_path, CASE WHEN b.h IS NULL THEN 'new' WHEN a.h IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS status FROM after a FULL JOIN before b ON a.graph = b.graph AND a.file_path = b.file_path",
    "deleted_files": f"WITH {_DOCS} SELECT graph, file_path FROM before b WHERE NOT EXISTS (SELECT 1 FROM after a WHERE a.graph = b.graph AND a.file_path = b.file_path)",
    "file_hash": "SELECT file_id, sha256(source_text) AS hash_value, hash_value AS stored, sha256(source_text) = hash_value AS same FROM source_files",
    "remove_file": over("SELECT r.rel_id, r.graph, r.source_id, r.target_id, r.type FROM rels r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.graph = r.graph AND g.id = r.source_id) AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.graph = r.graph AND g.id = r.target_id)", _UNION_REMOVED),
    "upsert_entities": over("SELECT graph, id, CASE WHEN type = 'class' THEN upper(name) ELSE name END AS name, type, CASE WHEN type = 'class' THEN 'revised' ELSE docstring END AS docstring FROM ents"),
    "replace_import": over("SELECT graph, id, name FROM ents WHERE NOT starts_with(id, 'class_') UNION ALL SELECT graph, id, name FROM ents WHERE type = 'class' AND id LIKE '%1'"),
    "delete_edges": over("SELECT rel_id, graph, source_id, target_id, type FROM rels WHERE type IS DISTINCT FROM 'calls'"),
    "version_compare": """SELECT p_partkey, p_size || '.' || p_partkey % 7 || '.' || p_partkey % 3 AS version,
        CASE WHEN [p_size::BIGINT, p_partkey % 7, p_partkey % 3] < [25, 3, 0] THEN -1 WHEN [p_size::BIGINT, p_partkey % 7, p_partkey % 3] > [25, 3, 0] THEN 1 ELSE 0 END AS order_to_25_3 FROM part""",
    "watch_stream": "SELECT graph, file_path, arg_max(hash_value, updated_at) AS hash_value FROM source_files WHERE hash_value IS NOT NULL GROUP BY 1, 2",
    "docstring_truncate": over("SELECT graph, id, CASE WHEN length(docstring) > 200 THEN left(docstring, 200) || '...' ELSE docstring END AS docstring, left(docstring, 200) AS short FROM ents"),
    "identifier_words": over("SELECT graph, id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(name), '[a-z]+'))), ' '), '') AS words FROM ents"),
}
