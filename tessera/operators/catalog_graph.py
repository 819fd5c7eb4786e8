"""Queries of the graph and of gs over the code index, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed as K
from tessera.functions import text as X
from tessera.operators import graph as G
from tessera.operators.catalog_find import BASE, _LINES, TERMS
from tessera.plans import find as P
from tessera.plans import gs
from tessera.session import table

SLICE_NAMES = ["constructor", "ledgerclient", "parse"]
PATHS = ["src/index.ts", "ledger-client.go", "modules/ledger"]
BODY_PATTERN = "harbor|cursor_list"


def _t(spark, d):
    return lambda n: table(spark, d, n)


def _files(spark, d):
    return P.live_files(table(spark, d, "files"))


def _symbols(spark, d):
    return P.live_symbols(table(spark, d, "symbols"))


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return G.adjacency(table(spark, d, "edges"))


def imported_by(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(table(spark, d, "edges"), _files(spark, d))


def hub_filter(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(table(spark, d, "edges"), _files(spark, d)).where(F.col("imported_by") > K.HUB_DEGREE).select("file_id", "imported_by")


def barrel_flag(spark: SparkSession, d: str) -> DataFrame:
    return G.barrels(table(spark, d, "edges"), _files(spark, d))


def transitive_one_hop(spark: SparkSession, d: str) -> DataFrame:
    return G.transitive_one_hop(table(spark, d, "edges"), _files(spark, d))


def import_closure(spark: SparkSession, d: str) -> DataFrame:
    start = _files(spark, d).where("is_test_file").select("file_id")
    return G.closure(table(spark, d, "edges"), start, 3)


def file_domains(spark: SparkSession, d: str) -> DataFrame:
    return G.file_tokens(_files(spark, d))


def plural_fold(spark: SparkSession, d: str) -> DataFrame:
    return G.with_singulars(G.file_tokens(_files(spark, d)))


def strip_barrel_tokens(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return G.strip_barrel_tokens(G.file_tokens(f), G.barrels(table(spark, d, "edges"), f))


def token_df(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return G.token_df(G.file_tokens(f), G.barrels(table(spark, d, "edges"), f))


def callers_topk(spark: SparkSession, d: str) -> DataFrame:
    return G.callers(table(spark, d, "symbol_edges"), _symbols(spark, d))


def callees(spark: SparkSession, d: str) -> DataFrame:
    return G.callees(table(spark, d, "symbol_edges"), _symbols(spark, d))


def importers_sorted(spark: SparkSession, d: str) -> DataFrame:
    return G.importers(table(spark, d, "edges"), _files(spark, d))


def internal_imports(spark: SparkSession, d: str) -> DataFrame:
    """Distinct imports of a file that are files of the index."""
    return G.adjacency(table(spark, d, "edges")).join(_files(spark, d).select(F.col("file_id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("file_id"), F.col("dst").alias("imported"))


def consumers_left(spark: SparkSession, d: str) -> DataFrame:
    """The importers of every anchored path; a path nobody indexes keeps a null."""
    paths = table(spark, d, "anchors").where("repo is not null and path is not null").select(F.concat("repo", F.lit("/"), "path").alias("file_id")).distinct()
    known = _files(spark, d).select("file_id", F.lit(True).alias("indexed"))
    n = G.adjacency(table(spark, d, "edges")).groupBy(F.col("dst").alias("file_id")).agg(F.count(F.lit(1)).alias("n"))
    return paths.join(known, "file_id", "left").join(n, "file_id", "left").select("file_id", F.when(F.col("indexed"), F.coalesce("n", F.lit(0))).alias("n_consumers"))


def _points(spark, d):
    sy = _symbols(spark, d).select(F.col("symbol_id").alias("src"), "file_id")
    return G.calls(table(spark, d, "symbol_edges")).where("line > 0").join(sy, "src").select("file_id", "line")


def innermost_enclosing(spark: SparkSession, d: str) -> DataFrame:
    return G.enclosing(_points(spark, d), _symbols(spark, d))


def drop_containers(spark: SparkSession, d: str) -> DataFrame:
    s = _symbols(spark, d).where("end_line is not null and start_line is not null").select("symbol_id", "file_id", "start_line", "end_line")
    return G.drop_containers(s).select("symbol_id")


def default_symbols(spark: SparkSession, d: str) -> DataFrame:
    return gs.default_symbols(_symbols(spark, d)).select("symbol_id", "place")


def match_fallback(spark: SparkSession, d: str) -> DataFrame:
    return gs.match_symbols(gs.default_symbols_plain(_symbols(spark, d)), X.match_predicate("/^(load|parse)/", "name")).select("symbol_id", "missed")


def symbol_display(spark: SparkSession, d: str) -> DataFrame:
    return gs.display_names(_symbols(spark, d)).select("symbol_id", "owner", "display", "nested")


def god_file_symbols(spark: SparkSession, d: str) -> DataFrame:
    return gs.top_symbols(_symbols(spark, d), table(spark, d, "symbol_edges"))


def path_lookup_priority(spark: SparkSession, d: str) -> DataFrame:
    return gs.find_path(_files(spark, d), PATHS)


def tiered_symbol_pick(spark: SparkSession, d: str) -> DataFrame:
    return gs.pick_symbols(_symbols(spark, d), SLICE_NAMES)


def body_refs(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    shown = f.where(F.col("file_id").contains("harbor")).select("file_id")
    return gs.body_refs(P.content_tokens(table(spark, d, "documents")), f, X.match_predicate(BODY_PATTERN, "token"), shown)


def _hit_lines(spark, d):
    hit = F.lit(False)
    for t in TERMS:
        hit = hit | F.lower("text").contains(t.lower())
    return P.lines(table(spark, d, "documents")).where(hit).select("file_id", "line")


def _lengths(spark, d):
    return table(spark, d, "documents").where("file_id is not null and text is not null").select("file_id", X.line_count("text").alias("n_lines"))


def merge_regions(spark: SparkSession, d: str) -> DataFrame:
    r = gs.regions(_hit_lines(spark, d), _lengths(spark, d))
    return r.select("file_id", F.col("region").cast("bigint").alias("region"), "first", "last").where(F.col("region") <= K.REGIONS)


def line_budget(spark: SparkSession, d: str) -> DataFrame:
    s = gs.default_symbols_plain(_symbols(spark, d)).where("end_line >= start_line").select("file_id", "symbol_id", "start_line", (F.col("end_line") - F.col("start_line") + 1).alias("n_lines"))
    return gs.line_budget(s, 60, ["start_line", "symbol_id"]).select("file_id", "symbol_id", "take")


def method_term_coverage(spark: SparkSession, d: str) -> DataFrame:
    return gs.method_matches(P.lines(table(spark, d, "documents")), _symbols(spark, d), P.matching(F.col("text"), TERMS)).where(F.col("place") <= K.MATCH_SYMBOLS)


def matched_symbols_topk(spark: SparkSession, d: str) -> DataFrame:
    """Symbols whose name has a term, in files of eighty lines or more: the six with most terms, back in line order."""
    s = _symbols(spark, d).select("file_id", "symbol_id", "start_line", F.size(P.matching(F.col("name"), TERMS, True)).cast("bigint").alias("n_terms")).where("n_terms > 0")
    s = s.join(_files(spark, d).where(F.col("line_count") >= K.LONG_FILE).select("file_id"), "file_id", "left_semi")
    rank = F.row_number().over(P.Window.partitionBy("file_id").orderBy(F.desc("n_terms"), F.col("start_line").asc_nulls_last(), "symbol_id"))
    back = F.row_number().over(P.Window.partitionBy("file_id").orderBy(F.col("start_line").asc_nulls_last(), "symbol_id"))
    return s.withColumn("r", rank).where(F.col("r") <= K.MATCHED_SYMBOLS).withColumn("place", back.cast("bigint")).select("file_id", "symbol_id", "n_terms", "place")


def language_counts(spark: SparkSession, d: str) -> DataFrame:
    """Files per repository and language with subtotals (rollup)."""
    f = _files(spark, d).select("repo", X.language_of_path("path").alias("language"))
    return f.rollup("repo", "language").agg(F.count(F.lit(1)).alias("n_files"), F.grouping_id().cast("bigint").alias("level"))


def token_cube(spark: SparkSession, d: str) -> DataFrame:
    """Symbols by kind and export, every combination (cube)."""
    return _symbols(spark, d).cube("kind", "is_exported").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_id").alias("n_files"))


def invariant_lint(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose end is no live file, and symbols of files that aren't live, counted per check."""
    ids = _files(spark, d).select("file_id")
    e = G.adjacency(table(spark, d, "edges"))
    bad = lambda df, col, name: df.join(ids.withColumnRenamed("file_id", col), col, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
    return bad(e, "src", "edge-source").unionByName(bad(e, "dst", "edge-target")).unionByName(bad(_symbols(spark, d), "file_id", "symbol-file"))


QUERIES = {f.__name__: f for f in (
    adjacency, imported_by, hub_filter, barrel_flag, transitive_one_hop, import_closure, file_domains, plural_fold, strip_barrel_tokens, token_df, callers_topk, callees, importers_sorted,
    internal_imports, consumers_left, innermost_enclosing, drop_containers, default_symbols, match_fallback, symbol_display, god_file_symbols, path_lookup_priority, tiered_symbol_pick, body_refs,
    merge_regions, line_budget, method_term_coverage, matched_symbols_topk, language_counts, token_cube, invariant_lint,
)}

_STOP = ", ".join(f"'{w}'" for w in K.NAME_STOP_WORDS)
_GEN = ", ".join(f"'{w}'" for w in K.GENERIC_DIRS)
_ENT = ", ".join(f"'{w}'" for w in K.ENTRY_NAMES)
_SPLIT = "list_transform(regexp_split_to_array(regexp_replace(regexp_replace({}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[\\s\\-_./]+'), lambda w: lower(w))"
TOKENIZE = "list_filter(" + _SPLIT + f", lambda w: length(w) > 1 AND w NOT IN ({_STOP}))"
_COMP = f"CASE WHEN length({{0}}) > 3 AND lower({{0}}) NOT IN ({_STOP}) THEN [lower({{0}})] ELSE [] END"
_G = "WITH " + BASE + """,
adj AS (SELECT DISTINCT src, dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL),
deg AS (SELECT file_id, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS imported_by FROM cur LEFT JOIN (SELECT src AS file_id, count(*) AS o FROM adj GROUP BY 1) USING (file_id) LEFT JOIN (SELECT dst AS file_id, count(*) AS i FROM adj GROUP BY 1) USING (file_id)),
bar AS (SELECT file_id, coalesce(language IN ('typescript', 'javascript') AND reexport_ratio > 0.5 AND imported_by > 1 AND len(exports) > 0, false) AS is_barrel FROM cur JOIN deg USING (file_id)),
call AS (SELECT edge_id, max(src) AS src, max(dst) AS dst, max(line) AS line FROM symbol_edges WHERE type = 'calls' AND src IS NOT NULL AND dst IS NOT NULL GROUP BY 1),
shown AS (SELECT * FROM sym WHERE coalesce(is_exported, false) OR kind IN ('class', 'function', 'method'))
"""
_TOKS = f""",
fp AS (SELECT file_id, exports, string_split(path, '/')[:-2] AS dirs, string_split(path, '/')[-1] AS name FROM cur),
fe AS (SELECT *, CASE WHEN lower(regexp_replace(name, '(.)\\.[^.]*$', '\\1')) IN ({_ENT}) THEN coalesce(dirs[-1], '') ELSE regexp_replace(name, '(.)\\.[^.]*$', '\\1') END AS eff FROM fp),
tk AS (
  SELECT file_id, unnest({TOKENIZE.format('dd')}) AS token, 'path' AS kind FROM (SELECT file_id, unnest(dirs) AS dd FROM fe) WHERE lower(dd) NOT IN ({_GEN})
  UNION ALL SELECT file_id, unnest(list_concat({TOKENIZE.format('eff')}, {_COMP.format('eff')})), 'filename' FROM fe WHERE eff <> '' AND lower(eff) NOT IN ({_GEN}, {_STOP})
  UNION ALL SELECT file_id, unnest(list_concat({TOKENIZE.format('x')}, {_COMP.format('x')})), 'symbol' FROM (SELECT file_id, unnest(exports) AS x FROM fe)),
toks AS (SELECT file_id, token, count(*) FILTER (kind = 'filename') AS n_filename, count(*) FILTER (kind = 'path') AS n_path, count(*) FILTER (kind = 'symbol') AS n_symbol FROM tk WHERE token <> '' GROUP BY 1, 2)
"""
_CALLERS = """,
c AS (SELECT call.dst AS symbol_id, s.file_id AS caller_file, s.name AS caller, line, edge_id FROM call JOIN sym x ON x.symbol_id = call.dst AND x.is_exported JOIN sym s ON s.symbol_id = call.src WHERE s.file_id <> x.file_id),
cf AS (SELECT symbol_id, caller_file, row_number() OVER (PARTITION BY symbol_id ORDER BY caller_file) AS file_rank, count(*) OVER (PARTITION BY symbol_id) AS n_files FROM (SELECT DISTINCT symbol_id, caller_file FROM c))
"""
_HITS = ", hl AS (SELECT DISTINCT file_id, line FROM ln, terms WHERE contains(lower(text), low)), nl AS (SELECT file_id, count(*) AS n_lines FROM ln GROUP BY 1)"
SQL = {
    "adjacency": _G + "SELECT * FROM adj",
    "imported_by": _G + "SELECT * FROM deg",
    "hub_filter": _G + "SELECT file_id, imported_by FROM deg WHERE imported_by > 30",
    "barrel_flag": _G + "SELECT * FROM bar",
    "transitive_one_hop": _G + "SELECT file_id, imported_by AS own, CAST(imported_by + coalesce(extra, 0) AS BIGINT) AS transitive FROM deg LEFT JOIN (SELECT adj.dst AS file_id, sum(b.imported_by) AS extra FROM adj JOIN (SELECT file_id, imported_by FROM deg JOIN bar USING (file_id) WHERE is_barrel) b ON b.file_id = adj.src GROUP BY 1) USING (file_id)",
    "import_closure": _G.replace("WITH ", "WITH RECURSIVE ", 1) + ", r AS (SELECT DISTINCT file_id, 0 AS hops FROM cur WHERE is_test_file UNION SELECT adj.dst, hops + 1 FROM r JOIN adj ON adj.src = r.file_id WHERE hops < 3) SELECT file_id, CAST(min(hops) AS INT) AS hops FROM r GROUP BY 1",
    "file_domains": _G + _TOKS + "SELECT * FROM toks",
    "plural_fold": _G + _TOKS + f""", pl AS (SELECT *, CASE WHEN token LIKE '%es' THEN token[:-3] WHEN token LIKE '%s' THEN token[:-2] END AS one FROM toks WHERE length(token) >= 5),
nw AS (SELECT file_id, one, min({{'token': token, 'a': n_filename, 'b': n_path, 'c': n_symbol}}) AS r FROM pl WHERE length(one) >= 4 AND one NOT IN ({_STOP}) GROUP BY 1, 2)
SELECT * FROM toks UNION ALL SELECT file_id, one, r.a, r.b, r.c FROM nw WHERE (file_id, one) NOT IN (SELECT (file_id, token) FROM toks)""",
    "strip_barrel_tokens": _G + _TOKS + "SELECT file_id, token, n_filename, n_path, CASE WHEN is_barrel THEN 0 ELSE n_symbol END AS n_symbol FROM toks JOIN bar USING (file_id) WHERE NOT is_barrel OR n_filename + n_path > 0",
    "token_df": _G + _TOKS + "SELECT token, count(*) AS df FROM toks WHERE file_id NOT IN (SELECT file_id FROM bar WHERE is_barrel) GROUP BY 1",
    "callers_topk": _G + _CALLERS + "SELECT symbol_id, caller_file, caller, line, file_rank, line_rank, n_files FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id, caller_file ORDER BY line NULLS LAST, caller, edge_id) AS line_rank FROM c JOIN cf USING (symbol_id, caller_file) WHERE file_rank <= 12) WHERE line_rank <= 3",
    "callees": _G + "SELECT src AS symbol_id, dst AS callee, place FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS place FROM (SELECT DISTINCT src, dst FROM call) WHERE dst IN (SELECT symbol_id FROM sym)) WHERE place <= 10",
    "importers_sorted": _G + "SELECT dst AS file_id, src AS importer, place, n_importers FROM (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src) AS place, count(*) OVER (PARTITION BY dst) AS n_importers FROM adj WHERE src IN (SELECT file_id FROM cur)) WHERE place <= 20",
    "internal_imports": _G + "SELECT src AS file_id, dst AS imported FROM adj WHERE dst IN (SELECT file_id FROM cur)",
    "consumers_left": _G + "SELECT file_id, CASE WHEN file_id IN (SELECT file_id FROM cur) THEN coalesce(n, 0) END AS n_consumers FROM (SELECT DISTINCT repo || '/' || path AS file_id FROM anchors WHERE repo IS NOT NULL AND path IS NOT NULL) LEFT JOIN (SELECT dst AS file_id, count(*) AS n FROM adj GROUP BY 1) USING (file_id)",
    "innermost_enclosing": _G + ", p AS (SELECT DISTINCT file_id, line FROM call JOIN sym ON sym.symbol_id = call.src WHERE line > 0) SELECT p.file_id, p.line, arg_min(s.symbol_id, (s.end_line - s.start_line, s.start_line, s.symbol_id)) FILTER (s.symbol_id IS NOT NULL) AS symbol_id FROM p LEFT JOIN (SELECT * FROM sym WHERE end_line >= start_line) s ON s.file_id = p.file_id AND p.line BETWEEN s.start_line AND s.end_line GROUP BY 1, 2",
    "drop_containers": _G + ", s AS (SELECT * FROM sym WHERE start_line IS NOT NULL AND end_line IS NOT NULL) SELECT symbol_id FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.file_id = b.file_id AND a.start_line <= b.start_line AND a.end_line >= b.end_line AND a.end_line - a.start_line > b.end_line - b.start_line)",
    "default_symbols": _G + "SELECT symbol_id, row_number() OVER (PARTITION BY file_id ORDER BY start_line NULLS FIRST, symbol_id) AS place FROM shown",
    "match_fallback": _G + "SELECT symbol_id, missed FROM (SELECT symbol_id, h, sum(h::INT) OVER (PARTITION BY file_id) = 0 AS missed FROM (SELECT *, coalesce(regexp_matches(name, '(?i)^(load|parse)'), false) AS h FROM shown)) WHERE h OR missed",
    "symbol_display": _G + ", o AS (SELECT *, last_value(CASE WHEN kind = 'class' THEN name END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY start_line NULLS FIRST, symbol_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS owner FROM sym) SELECT symbol_id, owner, CASE WHEN coalesce(starts_with(name, owner || '.'), false) THEN name[length(owner) + 2:] ELSE name END AS display, coalesce(starts_with(name, owner || '.'), false) AS nested FROM o",
    "god_file_symbols": _G + _CALLERS + ", n AS (SELECT symbol_id, count(*) AS n_caller_files FROM cf GROUP BY 1), s AS (SELECT file_id, symbol_id, start_line, coalesce(n_caller_files, 0) AS n_caller_files, count(*) OVER (PARTITION BY file_id) AS n_symbols FROM shown LEFT JOIN n USING (symbol_id)) SELECT file_id, symbol_id, n_caller_files, place, n_symbols FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY CASE WHEN n_symbols > 20 THEN -n_caller_files ELSE 0 END, start_line NULLS FIRST, symbol_id) AS place FROM s) WHERE n_symbols <= 20 OR place <= 15",
    "path_lookup_priority": _G + ", a AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}')" for p in PATHS) + ") v(asked)), h AS (SELECT asked, file_id, CASE WHEN path = asked OR file_id = asked THEN 0 WHEN suffix(file_id, asked) THEN 1 WHEN contains(file_id, asked) THEN 2 END AS tier FROM cur, a) SELECT asked, arg_min(file_id, (tier, file_id)) AS file_id FROM h WHERE tier IS NOT NULL GROUP BY 1",
    "tiered_symbol_pick": _G + ", a AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}')" for p in SLICE_NAMES) + ") v(asked)), h AS (SELECT file_id, asked, symbol_id, CASE WHEN lower(name) = asked THEN 0 WHEN string_split(lower(name), '.')[-1] = asked THEN 1 WHEN contains(lower(name), asked) THEN 2 END AS tier FROM sym, a WHERE name IS NOT NULL) SELECT DISTINCT file_id, asked, symbol_id FROM (SELECT *, min(tier) OVER (PARTITION BY file_id, asked) AS best FROM h WHERE tier IS NOT NULL) WHERE tier = best",
    "body_refs": _G + "," + _LINES + "," + __import__("tessera.operators.catalog_find", fromlist=["_TOK"])._TOK + "SELECT file_id, row_number() OVER (ORDER BY t, file_id) AS place FROM (SELECT file_id, (regexp_matches(path, '(^|/)tests?/') OR regexp_matches(path, '_tests?\\.[a-z]+$') OR regexp_matches(path, '\\.tests?\\.[a-z]+$'))::INT AS t FROM cur WHERE file_id IN (SELECT file_id FROM tok WHERE contains(token, 'harbor') OR contains(token, 'cursor_list')) AND NOT contains(file_id, 'harbor') ORDER BY t, file_id LIMIT 8)",
    "merge_regions": _G + "," + _LINES + _HITS + ", r AS (SELECT file_id, greatest(0, line - 2) AS a, least(n_lines - 1, line + 2) AS b FROM hl JOIN nl USING (file_id)), m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY file_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS nw FROM r), g AS (SELECT *, sum(nw) OVER (PARTITION BY file_id ORDER BY a, b) AS region FROM m) SELECT file_id, CAST(region AS BIGINT) AS region, min(a) AS first, max(b) AS last FROM g WHERE region <= 8 GROUP BY 1, 2",
    "line_budget": _G + ", s AS (SELECT file_id, symbol_id, start_line, end_line - start_line + 1 AS n FROM shown WHERE end_line >= start_line) SELECT file_id, symbol_id, CAST(greatest(0, least(n, 60 - coalesce(sum(n) OVER (PARTITION BY file_id ORDER BY start_line, symbol_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS take FROM s",
    "method_term_coverage": _G + "," + _LINES + ", h AS (SELECT file_id, line + 1 AS line, term FROM ln, terms WHERE contains(lower(text), low)), p AS (SELECT DISTINCT file_id, line FROM h), b AS (SELECT p.file_id, p.line, arg_min(s.symbol_id, (s.end_line - s.start_line, s.start_line, s.symbol_id)) AS symbol_id FROM p JOIN (SELECT * FROM shown WHERE end_line >= start_line) s ON s.file_id = p.file_id AND p.line BETWEEN s.start_line AND s.end_line GROUP BY 1, 2), n AS (SELECT file_id, symbol_id, count(DISTINCT term) AS n_terms FROM h JOIN b USING (file_id, line) GROUP BY 1, 2) SELECT file_id, symbol_id, n_terms, place FROM (SELECT n.*, row_number() OVER (PARTITION BY n.file_id ORDER BY n_terms DESC, sym.start_line, symbol_id) AS place FROM n JOIN sym USING (symbol_id)) WHERE place <= 4",
    "matched_symbols_topk": _G + ", s AS (SELECT sym.file_id, symbol_id, start_line, count(*) AS n_terms FROM sym, terms WHERE contains(replace(replace(lower(name), '-', ''), '_', ''), folded) AND sym.file_id IN (SELECT file_id FROM cur WHERE line_count >= 80) GROUP BY ALL) SELECT file_id, symbol_id, n_terms, row_number() OVER (PARTITION BY file_id ORDER BY start_line NULLS LAST, symbol_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n_terms DESC, start_line NULLS LAST, symbol_id) AS r FROM s) WHERE r <= 6",
    "language_counts": _G + ", x AS (SELECT repo, map_extract_value(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in K.EXTENSION_LANGUAGE.items()) + "}, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1))) AS language FROM cur) SELECT repo, language, count(*) AS n_files, CAST(grouping(repo, language) AS BIGINT) AS level FROM x GROUP BY ROLLUP (repo, language)",
    "token_cube": _G + "SELECT kind, is_exported, count(*) AS n, count(DISTINCT file_id) AS n_files FROM sym GROUP BY CUBE (kind, is_exported)",
    "invariant_lint": _G + "SELECT 'edge-source' AS \"check\", count(*) AS n FROM adj WHERE src NOT IN (SELECT file_id FROM cur) UNION ALL SELECT 'edge-target', count(*) FROM adj WHERE dst NOT IN (SELECT file_id FROM cur) UNION ALL SELECT 'symbol-file', count(*) FROM sym WHERE file_id NOT IN (SELECT file_id FROM cur)",
}
