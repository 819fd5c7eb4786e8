"""Queries p3_, p4_ and p6_ over the tables of the code index, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import fanin, nested, orphans
from tessera.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_items(table(spark, d, "session_records"))


def p3_sharing(spark: SparkSession, d: str) -> DataFrame:
    return nested.sharing(table(spark, d, "session_records"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    n_rows = sum(t(n).count() for n in ("symbol_edges", "anchors", "files", "symbols", "shared_symbols", "live_hashes"))  # of the files' footers
    return orphans.orphans(orphans.references(t("symbol_edges"), t("anchors")), orphans.parents(t("files"), t("symbols"), t("shared_symbols"), t("live_hashes")), n_rows)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_id", "ref_field").distinct()


def p4_by_period(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).groupBy("ref_table", "ref_field", "period").agg(F.countDistinct("ref_id").alias("n_orphans"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return fanin.hot_targets(table(spark, d, "symbol_edges"), table(spark, d, "edges"))


def p6_targets(spark: SparkSession, d: str) -> DataFrame:
    return fanin.target_report(table(spark, d, "symbol_edges"), table(spark, d, "edges")).withColumn("share", F.round("share", 6))


def p6_files(spark: SparkSession, d: str) -> DataFrame:
    return fanin.file_report(table(spark, d, "symbol_edges"), table(spark, d, "edges"), table(spark, d, "files"))


QUERIES = {f.__name__: f for f in (p3_found, p3_sharing, p4_found, p4_by_period, p6_found, p6_targets, p6_files)}

_KEY = "regexp_replace(replace({0}, chr(92), '/'), '^\\./', '')"
_EDGES = "SELECT edge_id, max(src) AS src, max(dst) AS dst FROM symbol_edges WHERE edge_id IS NOT NULL GROUP BY edge_id"
_PAIRS = f"SELECT {_KEY.format('dst')} AS dst, {_KEY.format('src')} AS src, count(*) AS n FROM ({_EDGES}) WHERE dst IS NOT NULL GROUP BY 1, 2"
_TARGETS = f"SELECT dst, CAST(sum(n) AS BIGINT) AS n_edges, count(src) AS n_sources FROM ({_PAIRS}) GROUP BY dst"
_LIVE = "SELECT file_id FROM (SELECT file_id, deleted_at, row_number() OVER (PARTITION BY file_id ORDER BY indexed_at DESC NULLS LAST, received_at DESC NULLS LAST) AS rn FROM files) WHERE rn = 1 AND deleted_at IS NULL"
_ORPHANS = f"""
WITH live AS ({_LIVE}), ids AS (SELECT file_id AS k FROM live UNION SELECT symbol_id FROM symbols WHERE deleted_at IS NULL UNION SELECT symbol_id FROM shared_symbols UNION SELECT file_id FROM shared_symbols),
versions AS (SELECT repo, {_KEY.format('path')} AS path, regexp_replace(lower(hash), '^sha256:', '') AS hash FROM live_hashes),
refs AS (
  SELECT 'symbol_edges' AS ref_table, edge_id AS ref_id, 'src' AS ref_field, strftime(seen_at, '%Y-%m') AS period FROM symbol_edges WHERE src IS NOT NULL AND {_KEY.format('src')} NOT IN (SELECT k FROM ids WHERE k IS NOT NULL)
  UNION SELECT 'symbol_edges', edge_id, 'dst', strftime(seen_at, '%Y-%m') FROM symbol_edges WHERE dst IS NOT NULL AND NOT (coalesce(type, '') IN ('extends', 'implements') AND NOT contains(dst, '#') AND NOT contains(replace(dst, chr(92), '/'), '/')) AND {_KEY.format('dst')} NOT IN (SELECT k FROM ids WHERE k IS NOT NULL)
  UNION SELECT 'anchors', anchor_id, 'path', strftime(verified_at, '%Y-%m') FROM anchors WHERE path IS NOT NULL AND repo IS NOT NULL AND repo || '/' || {_KEY.format('path')} NOT IN (SELECT file_id FROM live)
  UNION SELECT 'anchors', anchor_id, 'hash', strftime(verified_at, '%Y-%m') FROM anchors a WHERE path IS NOT NULL AND repo IS NOT NULL AND hash IS NOT NULL AND hash <> 'missing' AND NOT EXISTS (SELECT 1 FROM versions v WHERE v.repo = a.repo AND v.path = {_KEY.format('a.path')} AND v.hash = regexp_replace(lower(a.hash), '^sha256:', '')))
"""

SQL = {
    "p4_found": _ORPHANS + "SELECT DISTINCT ref_table, ref_id, ref_field FROM refs",
    "p4_by_period": _ORPHANS + "SELECT ref_table, ref_field, period, count(DISTINCT ref_id) AS n_orphans FROM refs GROUP BY 1, 2, 3",
    "p6_found": f"SELECT dst FROM ({_TARGETS}) WHERE n_edges >= 0.01 * (SELECT count(DISTINCT edge_id) FROM symbol_edges)",
    "p6_targets": f"""
WITH imports AS (SELECT {_KEY.format('dst')} AS file_id, count(*) AS n_imports FROM edges WHERE dst IS NOT NULL GROUP BY 1)
SELECT dst, n_edges, n_sources, round(n_edges / (SELECT count(DISTINCT edge_id) FROM symbol_edges)::DOUBLE, 6) AS share, coalesce(n_imports, 0) AS n_imports, n_edges * coalesce(n_imports, 0) AS n_pairs
FROM ({_TARGETS}) LEFT JOIN imports ON split_part(dst, '#', 1) = imports.file_id""",
    "p6_files": f"""
WITH calls AS (SELECT split_part(dst, '#', 1) AS file_id, CAST(sum(n_edges) AS BIGINT) AS n_edges FROM ({_TARGETS}) GROUP BY 1),
imports AS (SELECT dst AS file_id, CAST(sum(n) AS BIGINT) AS n_imports, count(src) AS n_importers FROM (SELECT {_KEY.format('dst')} AS dst, {_KEY.format('src')} AS src, count(*) AS n FROM edges WHERE dst IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
stored AS (SELECT file_id, imported_by_count FROM (SELECT file_id, imported_by_count, row_number() OVER (PARTITION BY file_id ORDER BY indexed_at DESC NULLS LAST, received_at DESC NULLS LAST) AS rn FROM files WHERE file_id IS NOT NULL) WHERE rn = 1)
SELECT file_id, coalesce(n_edges, 0) AS n_edges, coalesce(n_imports, 0) AS n_imports, coalesce(n_importers, 0) AS n_importers, coalesce(n_edges, 0) * coalesce(n_imports, 0) AS n_pairs, CAST(imported_by_count AS BIGINT) AS stored_count
FROM imports FULL JOIN calls USING (file_id) FULL JOIN stored USING (file_id)""",
}

_STRING = "json_type({0}) = 'VARCHAR'"
_VALUE = "json_extract_string({0}, '$')"
SQL["p3_found"] = f"""
WITH RECURSIVE j AS (SELECT DISTINCT record_id, kind, CAST(raw AS JSON) AS v FROM session_records WHERE raw IS NOT NULL AND json_valid(raw)),
post AS (SELECT record_id, json_extract(v, '$.postToolUse') AS p FROM j WHERE kind = 'hook'),
ti AS (SELECT record_id, 'tool_input.command' AS path, json_extract(v, '$.tool_input.command') AS c FROM j WHERE kind = 'hook'
  UNION ALL SELECT record_id, 'postToolUse.tool_input.command', json_extract(p, '$.tool_input.command') FROM post WHERE json_type(p) = 'OBJECT'
  UNION ALL SELECT record_id, 'postToolUse[' || (n - 1) || '].tool_input.command', json_extract(e, '$.tool_input.command') FROM (SELECT record_id, unnest(CAST(p AS JSON[])) AS e, generate_subscripts(CAST(p AS JSON[]), 1) AS n FROM post WHERE json_type(p) = 'ARRAY')),
cmd AS (SELECT record_id, path, c FROM ti UNION ALL SELECT record_id, path || '[' || (n - 1) || ']', e FROM (SELECT record_id, path, unnest(CAST(c AS JSON[])) AS e, generate_subscripts(CAST(c AS JSON[]), 1) AS n FROM ti WHERE json_type(c) = 'ARRAY')),
outp AS (SELECT record_id, CASE WHEN json_type(o) = 'VARCHAR' AND json_valid({_VALUE.format('o')}) THEN CAST({_VALUE.format('o')} AS JSON) ELSE o END AS o FROM (SELECT record_id, json_extract(v, '$.payload.output') AS o FROM j WHERE kind = 'rollout')),
arr AS (
  SELECT record_id, 'type' AS key, 'message.content' AS path, json_extract(v, '$.message.content') AS a FROM j WHERE kind = 'transcript' AND json_type(v, '$.message.content') = 'ARRAY'
  UNION ALL SELECT record_id, 'text', 'payload.output', o FROM outp WHERE json_type(o) = 'ARRAY'
  UNION ALL SELECT record_id, key, path || '[' || (n - 1) || '].content', json_extract(e, '$.content') FROM (SELECT record_id, key, path, unnest(CAST(a AS JSON[])) AS e, generate_subscripts(CAST(a AS JSON[]), 1) AS n FROM arr) WHERE json_type(e) = 'OBJECT' AND json_type(e, '$.content') = 'ARRAY'),
item AS (SELECT record_id, path || '[' || (n - 1) || '].' || key AS path, json_extract(e, '$.' || key) AS c FROM (SELECT record_id, key, path, unnest(CAST(a AS JSON[])) AS e, generate_subscripts(CAST(a AS JSON[]), 1) AS n FROM arr) WHERE json_type(e) = 'OBJECT')
SELECT DISTINCT record_id, path AS item_path, {_VALUE.format('c')} AS value FROM (SELECT * FROM cmd UNION ALL SELECT * FROM item) WHERE {_STRING.format('c')}"""

SQL["p3_sharing"] = """
WITH r AS (SELECT DISTINCT record_id, kind, CAST(raw AS JSON) AS v FROM session_records WHERE raw IS NOT NULL AND json_valid(raw)),
u AS (SELECT record_id, kind, CASE WHEN kind = 'rollout' AND json_type(v, '$.payload.output') = 'VARCHAR' AND json_valid(json_extract_string(v, '$.payload.output')) AND json_type(json_extract_string(v, '$.payload.output')) = 'ARRAY' THEN json_merge_patch(v, json_object('payload', json_object('output', CAST(json_extract_string(v, '$.payload.output') AS JSON)))) ELSE v END AS v FROM r),
t AS (SELECT record_id, kind, v, (SELECT list_sort(list(fullkey || '=' || type || '=' || coalesce(CAST(atom AS VARCHAR), ''))) FROM json_tree(v)) AS sig FROM u),
d AS (SELECT DISTINCT record_id, kind, sig, CASE json_type(v) WHEN 'OBJECT' THEN len(json_keys(v)) WHEN 'ARRAY' THEN json_array_length(v) ELSE 0 END AS kids FROM t)
SELECT kind, count(*) AS records, count(DISTINCT sig) AS distinct_roots, CAST((SELECT sum(k) FROM (SELECT DISTINCT sig, kids AS k FROM d e WHERE e.kind IS NOT DISTINCT FROM d.kind)) AS BIGINT) AS root_children FROM d GROUP BY kind"""
