"""Queries of find over the code index, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.plans import find as P
from tessera.session import table, top_k

QUERY = "ledger harbor-view trackerPool anvil"
TERMS = X.parse_terms(QUERY)


class _Find:
    """The pieces of one query, built once per call."""

    def __init__(self, spark: SparkSession, d: str):
        self.docs, self.imports = table(spark, d, "documents"), table(spark, d, "edges")
        self.files, self.symbols = P.live_files(table(spark, d, "files")), P.symbol_names(table(spark, d, "symbols"))
        self.cand = P.candidates(self.docs, self.files, self.symbols, TERMS)

    def weights(self) -> DataFrame:
        self.n = self.files.count()  # one number, from a few columns of the files
        return P.term_weights(self.cand, TERMS, self.n)

    def evidence(self) -> DataFrame:
        return P.evidence(self.cand, self.weights(), self.imports)


def find_coverage(spark: SparkSession, d: str) -> DataFrame:
    return P.body_coverage(table(spark, d, "documents"), TERMS).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_terms"))


def find_name_channel(spark: SparkSession, d: str) -> DataFrame:
    return P.name_coverage(P.live_files(table(spark, d, "files")), P.symbol_names(table(spark, d, "symbols")), TERMS)


def find_union_channels(spark: SparkSession, d: str) -> DataFrame:
    return _Find(spark, d).cand


def find_df(spark: SparkSession, d: str) -> DataFrame:
    return P.doc_freq(_Find(spark, d).cand, TERMS)


def find_idf(spark: SparkSession, d: str) -> DataFrame:
    return _Find(spark, d).weights().select("term", F.round("idf", 6).alias("idf"), F.round("max_idf", 6).alias("max_idf"))


def find_rare_terms(spark: SparkSession, d: str) -> DataFrame:
    return _Find(spark, d).weights().where("is_rare").select("term", "df")


def find_disc_terms(spark: SparkSession, d: str) -> DataFrame:
    return _Find(spark, d).weights().where("is_disc").select("term", "df")


def find_rank(spark: SparkSession, d: str) -> DataFrame:
    f = _Find(spark, d)
    return P.rank(f.cand, f.weights())


def find_evidence_class(spark: SparkSession, d: str) -> DataFrame:
    f = _Find(spark, d)
    return f.evidence()


def find_partition_classes(spark: SparkSession, d: str) -> DataFrame:
    f = _Find(spark, d)
    return P.partition(f.cand, f.files, f.evidence())


def find_noise_floor(spark: SparkSession, d: str) -> DataFrame:
    return find_partition_classes(spark, d).where("shown").groupBy("class").agg(F.count(F.lit(1)).alias("n_shown"))


def find_page(spark: SparkSession, d: str) -> DataFrame:
    """The listed files per class: twelve of code, four documents, four styles, best first."""
    f = _Find(spark, d)
    w = f.weights()
    return P.listed(f.cand, w, f.files, P.evidence(f.cand, w, f.imports))


def find_sections(spark: SparkSession, d: str) -> DataFrame:
    """The page as a whole: roles, symbols to read, relations and their terms of the listed files."""
    f = _Find(spark, d)
    symbols = P.live_symbols(table(spark, d, "symbols"))
    p = P.page(f.cand, f.weights(), f.files, symbols, f.imports, TERMS)
    return p.select(*[F.array_join(c, ", ").alias(c) if t.startswith("array") else F.col(c) for c, t in p.dtypes])


def find_bridged(spark: SparkSession, d: str) -> DataFrame:
    f = _Find(spark, d)
    w = f.weights()
    top = P.cut(P.listed(f.cand, w, f.files, P.evidence(f.cand, w, f.imports)))
    code = top.where("class = 'code'")
    b = P.bridged(code.where(F.col("place") <= P.K.DETAILED), code, P.content_tokens(f.docs), f.files, f.imports, TERMS)
    return b.withColumn("tokens", F.array_join("tokens", ", "))


def line_mask(spark: SparkSession, d: str) -> DataFrame:
    return P.line_counts(table(spark, d, "documents"))


def _converged(spark: SparkSession, d: str) -> DataFrame:
    f = _Find(spark, d)
    w = f.weights()
    return P.convergence(f.docs, w, TERMS, f.n)


def line_convergence(spark: SparkSession, d: str) -> DataFrame:
    return _converged(spark, d).select("file_id", F.col("line").cast("bigint").alias("line"), "n_terms", "score")


def gap_clusters(spark: SparkSession, d: str) -> DataFrame:
    c = P.clusters(_converged(spark, d))
    return c.select("file_id", F.col("cluster").cast("bigint").alias("cluster"), F.col("first_line").cast("bigint").alias("first_line"), F.col("last_line").cast("bigint").alias("last_line"))


def cluster_peaks(spark: SparkSession, d: str) -> DataFrame:
    return P.clusters(_converged(spark, d)).where(F.col("peak_rank") <= P.K.PREVIEW_CLUSTERS).select("file_id", F.col("first_line").cast("bigint").alias("first_line"), "peak", "peak_rank")


def _related(spark: SparkSession, d: str) -> DataFrame:
    f = _Find(spark, d)
    return P.relations(f.cand, f.imports)


def direct_relations(spark: SparkSession, d: str) -> DataFrame:
    return _related(spark, d).where("relation = 'consumes'").select("a", "b")


def cocitation_siblings(spark: SparkSession, d: str) -> DataFrame:
    return _related(spark, d).where("relation = 'siblings'").select("a", "b")


def via_terms(spark: SparkSession, d: str) -> DataFrame:
    """Why a file consumes another."""
    f = _Find(spark, d)
    w = f.weights()
    return P.via(P.relations(f.cand, f.imports).where("relation = 'consumes'").select("a", "b"), P.evidence(f.cand, w, f.imports), f.cand, w)


def import_target_first(spark: SparkSession, d: str) -> DataFrame:
    f = _Find(spark, d)
    return P.import_targets(f.cand, f.imports)


def rare_postings(spark: SparkSession, d: str) -> DataFrame:
    p = P.rare_postings(P.content_tokens(table(spark, d, "documents")), P.live_files(table(spark, d, "files")))
    return p.select("token", "df", F.array_join("files", ",").alias("files"))


def content_tokens(spark: SparkSession, d: str) -> DataFrame:
    return P.content_tokens(table(spark, d, "documents")).groupBy("bits").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("token").alias("n_tokens"))


def rare_token_bridge(spark: SparkSession, d: str) -> DataFrame:
    tokens = P.content_tokens(table(spark, d, "documents"))
    return P.bridges(P.rare_postings(tokens, P.live_files(table(spark, d, "files"))), tokens, table(spark, d, "edges"))


def related_files(spark: SparkSession, d: str) -> DataFrame:
    return P.related_files(rare_token_bridge(spark, d))


def bridge_gate(spark: SparkSession, d: str) -> DataFrame:
    """Postings whose token contains a stem of the query or is contained in one."""
    p = P.rare_postings(P.content_tokens(table(spark, d, "documents")), P.live_files(table(spark, d, "files")))
    return P.near_query(p, TERMS).select("token", "df")


def name_echo(spark: SparkSession, d: str) -> DataFrame:
    return P.name_echo(P.live_files(table(spark, d, "files")), TERMS + ["roster"])


_NAMES = (
    find_coverage, find_name_channel, find_union_channels, find_df, find_idf, find_rare_terms, find_disc_terms, find_rank, find_evidence_class, find_partition_classes, find_noise_floor, find_page, find_sections, find_bridged,
    line_mask, line_convergence, gap_clusters, cluster_peaks, direct_relations, cocitation_siblings, via_terms, import_target_first, rare_postings, content_tokens, rare_token_bridge, related_files, bridge_gate, name_echo,
)
QUERIES = {f.__name__: f for f in _NAMES}

# ---- the same in SQL -------------------------------------------------------------------------------

_T = "(VALUES " + ", ".join(f"('{t}', '{t.lower()}', '{t.lower().replace('_', '').replace('-', '')}')" for t in TERMS) + ") AS t(term, low, folded)"
_FOLD = "replace(replace(lower({}), '-', ''), '_', '')"
BASE = f"""
terms AS (SELECT * FROM {_T}),
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY indexed_at DESC NULLS LAST, received_at DESC NULLS LAST) AS rn FROM files WHERE file_id IS NOT NULL) WHERE rn = 1 AND deleted_at IS NULL),
sym AS (SELECT DISTINCT symbol_id, file_id, name, kind, start_line, end_line, is_exported, extends_name FROM symbols WHERE deleted_at IS NULL AND symbol_id IS NOT NULL),
body AS (SELECT DISTINCT file_id, term FROM documents, terms WHERE file_id IS NOT NULL AND contains(lower(text), low)),
nm AS (SELECT file_id, term, bool_or(n) AS in_name, bool_or(p) AS in_path FROM (
  SELECT file_id, term, false AS n, true AS p FROM cur, terms WHERE contains({_FOLD.format('path')}, folded)
  UNION ALL SELECT file_id, term, true, false FROM sym, terms WHERE contains({_FOLD.format('name')}, folded)) GROUP BY 1, 2),
cand AS (SELECT file_id, term, coalesce(in_name, false) AS in_name, coalesce(in_path, false) AS in_path, b IS NOT NULL AS in_body
  FROM nm FULL JOIN (SELECT *, true AS b FROM body) USING (file_id, term) WHERE file_id IN (SELECT file_id FROM cur)),
df AS (SELECT term, coalesce(n, 0) AS df FROM terms LEFT JOIN (SELECT term, count(*) AS n FROM cand GROUP BY 1) USING (term)),
idf AS (SELECT term, df, ln(1 + ((SELECT count(*) FROM cur) - df + 0.5) / (df + 0.5)) AS idf FROM df),
w AS (SELECT term, df, idf, greatest(1.0, max(idf) OVER ()) AS max_idf, df / (SELECT count(*) FROM cur)::DOUBLE < 0.05 AS is_rare, idf >= (SELECT list_sort(list(idf))[((count(*) - 1) // 2 + 1)::BIGINT] FROM idf) AS is_disc FROM idf),
ranked AS (SELECT file_id, round(3 * count(*) + sum((3 * idf * in_name::INT + 2 * idf * in_path::INT) / max_idf), 4) AS score, count(*) AS coverage FROM cand JOIN w USING (term) GROUP BY 1),
decl AS (SELECT DISTINCT file_id, term FROM sym, terms WHERE contains({_FOLD.format('name')}, folded)),
carry AS (SELECT file_id AS dst, term FROM cur, terms WHERE contains({_FOLD.format('path')}, folded) UNION SELECT file_id, term FROM decl WHERE file_id IN (SELECT file_id FROM cur)),
spec AS (SELECT DISTINCT src AS file_id, term FROM edges JOIN carry USING (dst)),
ev AS (SELECT file_id, term, CASE WHEN d.term IS NOT NULL THEN 'declares' WHEN in_path THEN 'in_path' WHEN is_rare AND s.term IS NOT NULL THEN 'imports' WHEN is_rare AND in_body THEN 'mentions' END AS class
  FROM cand JOIN w USING (term) LEFT JOIN decl d USING (file_id, term) LEFT JOIN spec s USING (file_id, term)),
ev1 AS (SELECT * FROM ev WHERE class IS NOT NULL),
part1 AS (SELECT file_id, CASE WHEN regexp_matches(lower(path), '\\.(md|markdown|rst|txt|adoc|rdoc)$') THEN 'doc' WHEN regexp_matches(lower(path), '\\.(css|scss|sass|less)$') THEN 'style' ELSE 'code' END AS class,
  regexp_matches(lower(path), '(^|/)(node_modules|vendor|bower_components)/') OR regexp_matches(lower(path), '\\.min\\.(js|css)$') OR coalesce(regexp_matches(lower(path), '\\.(js|jsx|ts|tsx|mjs|cjs|css|scss|sass|less)$') AND token_estimate * 4 / nullif(line_count, 0)::DOUBLE > 1000, false) AS vendored,
  coalesce(disc, 0) AS disc FROM cur LEFT JOIN (SELECT file_id, count(*) AS disc FROM ev1 GROUP BY 1) USING (file_id) WHERE file_id IN (SELECT file_id FROM cand)),
part AS (SELECT *, NOT vendored AND (class <> 'code' OR disc > 0) AS shown FROM part1)
"""
_LINES = """
ln AS (SELECT file_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE file_id IS NOT NULL AND text IS NOT NULL),
q AS (SELECT *, len(regexp_split_to_array(text, '\\x22\\x22\\x22|\\x27\\x27\\x27')) - 1 AS quotes FROM ln),
mask AS (SELECT file_id, line, text, coalesce(sum(quotes) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 OR quotes > 0 OR regexp_matches(trim(text), '^(#|//|/\\*|\\*|<!--|;;|--\\s)') AS excluded FROM q)
"""
_CONV = """,
hit AS (SELECT file_id, line, text, term, df, is_rare FROM mask, terms JOIN w USING (term) WHERE NOT excluded AND contains(lower(text), low)),
near AS (SELECT DISTINCT a.file_id, a.line, b.term, b.df FROM hit a JOIN hit b ON a.file_id = b.file_id AND b.line BETWEEN a.line - 3 AND a.line + 3),
near1 AS (SELECT file_id, line, count(*) AS n_terms, sum((SELECT count(*) FROM cur)::DOUBLE / greatest(1, df)) AS weight FROM near GROUP BY 1, 2),
perline AS (SELECT file_id, line, bool_or(is_rare) AS rare, any_value(text) AS text FROM hit GROUP BY 1, 2),
conv AS (SELECT file_id, line, n_terms, round(weight * CASE WHEN regexp_matches(text, '^\\s*(import\\b|from\\s+[\\w.]+\\s+import\\b|export\\s+[^=]*\\bfrom\\b|(const|let|var)\\s+[^=]*=\\s*require\\s*\\(|require\\s*\\(|use\\s+[\\w:\\\\]+|using\\s+[\\w.]+|#include\\b|@import\\b)') THEN 1.5 ELSE 1.0 END, 6) AS score
  FROM near1 JOIN perline USING (file_id, line) WHERE n_terms >= 2 OR rare),
gap AS (SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY file_id ORDER BY line) > 3 THEN 1 ELSE 0 END AS g FROM conv),
clu AS (SELECT file_id, cluster, min(line) AS first_line, max(line) AS last_line, max(score) AS peak FROM (SELECT *, sum(g) OVER (PARTITION BY file_id ORDER BY line) AS cluster FROM gap) GROUP BY 1, 2),
clu1 AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY peak DESC, first_line) AS peak_rank FROM clu)
"""
_REL = """,
e AS (SELECT DISTINCT src, dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst),
among AS (SELECT DISTINCT file_id FROM cand),
direct AS (SELECT src AS a, dst AS b FROM e WHERE src IN (SELECT file_id FROM among) AND dst IN (SELECT file_id FROM among)),
shared AS (SELECT 't:' || dst AS key, src AS f FROM e WHERE dst IN (SELECT dst FROM e GROUP BY 1 HAVING count(*) <= 30) AND src IN (SELECT file_id FROM among)
  UNION SELECT 's:' || src, dst FROM e WHERE src IN (SELECT src FROM e GROUP BY 1 HAVING count(*) <= 30) AND dst IN (SELECT file_id FROM among)),
sib AS (SELECT DISTINCT x.f AS a, y.f AS b FROM shared x JOIN shared y ON x.key = y.key AND x.f < y.f EXCEPT SELECT least(a, b), greatest(a, b) FROM direct)
"""
_TOK = """
code AS (SELECT file_id, text FROM mask WHERE NOT excluded),
raw AS (SELECT file_id, unnest(regexp_extract_all(regexp_replace(text, '"[^"]*"|''[^'']*''', ' ', 'g'), '[A-Za-z][A-Za-z0-9_]*')) AS token, 1 AS bit FROM code
  UNION ALL SELECT file_id, unnest(regexp_extract_all(array_to_string(regexp_extract_all(text, '"[^"]*"|''[^'']*'''), ' '), '[A-Za-z][A-Za-z0-9_]*')), 2 FROM code),
tok AS (SELECT file_id, lower(token) AS token, bit_or(bit) AS bits FROM raw WHERE length(token) >= 5 AND (regexp_matches(token, '^[a-z][a-z0-9]*(_[a-z0-9]+)+$') OR regexp_matches(token, '^[a-z]+[a-z0-9]*([A-Z][a-z0-9]*)+$') OR regexp_matches(token, '^([A-Z][a-z0-9]+){2,}$') OR regexp_matches(token, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$')) GROUP BY 1, 2),
post AS (SELECT token, count(DISTINCT file_id) AS df, list_sort(list(DISTINCT file_id)) AS files FROM tok WHERE file_id IN (SELECT file_id FROM cur WHERE NOT coalesce(is_test_file, false) AND NOT coalesce(is_barrel, false)) GROUP BY 1 HAVING count(DISTINCT file_id) BETWEEN 2 AND 5)
"""
_W = "WITH " + BASE
SQL = {
    "find_coverage": _W + "SELECT file_id, count(*) AS n_terms FROM body GROUP BY 1",
    "find_name_channel": _W + "SELECT * FROM nm",
    "find_union_channels": _W + "SELECT * FROM cand",
    "find_df": _W + "SELECT * FROM df",
    "find_idf": _W + "SELECT term, round(idf, 6) AS idf, round(max_idf, 6) AS max_idf FROM w",
    "find_rare_terms": _W + "SELECT term, df FROM w WHERE is_rare",
    "find_disc_terms": _W + "SELECT term, df FROM w WHERE is_disc",
    "find_rank": _W + "SELECT * FROM ranked ORDER BY score DESC, file_id LIMIT 40",
    "find_evidence_class": _W + "SELECT * FROM ev1",
    "find_partition_classes": _W + "SELECT * FROM part",
    "find_noise_floor": _W + "SELECT class, count(*) AS n_shown FROM part WHERE shown GROUP BY 1",
    "find_page": _W + "SELECT * FROM (SELECT file_id, score, coverage, class, row_number() OVER (PARTITION BY class ORDER BY score DESC, file_id) AS place FROM ranked JOIN part USING (file_id) WHERE shown) WHERE place <= CASE WHEN class = 'code' THEN 12 ELSE 4 END",
    "line_mask": "WITH " + _LINES + "SELECT file_id, count(*) AS n_lines, CAST(sum(excluded::INT) AS BIGINT) AS n_excluded FROM mask GROUP BY 1",
    "line_convergence": _W + "," + _LINES + _CONV + "SELECT * FROM conv",
    "gap_clusters": _W + "," + _LINES + _CONV + "SELECT file_id, CAST(cluster AS BIGINT) AS cluster, first_line, last_line FROM clu",
    "cluster_peaks": _W + "," + _LINES + _CONV + "SELECT file_id, first_line, peak, peak_rank FROM clu1 WHERE peak_rank <= 2",
    "direct_relations": _W + _REL + "SELECT * FROM direct",
    "cocitation_siblings": _W + _REL + "SELECT * FROM sib",
    "via_terms": _W + _REL + "SELECT * FROM (SELECT a, b, term, row_number() OVER (PARTITION BY a, b ORDER BY idf DESC, term) AS place FROM direct JOIN (SELECT file_id AS b, term FROM ev1 WHERE class = 'declares') USING (b) JOIN (SELECT term, idf FROM w WHERE is_disc) USING (term) WHERE (a, term) IN (SELECT (file_id, term) FROM cand)) WHERE place <= 2",
    "import_target_first": _W + "SELECT src AS file_id, term, arg_min(dst, (ord, dst)) AS target FROM (SELECT DISTINCT src, dst, ord FROM edges WHERE src IS NOT NULL) JOIN carry USING (dst) GROUP BY 1, 2",
    "rare_postings": _W + "," + _LINES + "," + _TOK + "SELECT token, df, array_to_string(files, ',') AS files FROM post",
    "content_tokens": "WITH cur AS (SELECT 1 AS file_id, false AS is_test_file, false AS is_barrel)," + _LINES + "," + _TOK.replace("file_id IN (SELECT file_id FROM cur", "false AND 1 IN (SELECT file_id FROM cur") + "SELECT bits, count(*) AS n, count(DISTINCT token) AS n_tokens FROM tok GROUP BY 1",
    "rare_token_bridge": _W + "," + _LINES + "," + _TOK + """, p AS (SELECT p0.token, df, f, bits FROM (SELECT token, df, unnest(files) AS f FROM post) p0 JOIN tok ON tok.file_id = f AND tok.token = p0.token),
 prs AS (SELECT a.token, a.df, a.f AS a, b.f AS b, ((a.bits | b.bits) & 2) // 2 AS quoted FROM p a JOIN p b ON a.token = b.token AND a.f < b.f WHERE regexp_replace(a.f, '/[^/]*$', '') <> regexp_replace(b.f, '/[^/]*$', '')),
 s AS (SELECT a, b, count(*) AS n_shared, min(df) AS min_df, max(len(regexp_split_to_array(token, '[\\s\\-_./]+'))) AS words, max(quoted) AS quoted FROM prs GROUP BY 1, 2)
SELECT a, b, n_shared, min_df FROM s WHERE (n_shared >= 2 OR quoted = 1 OR (min_df <= 3 AND words >= 3)) AND (a, b) NOT IN (SELECT (least(src, dst), greatest(src, dst)) FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL)""",
    "bridge_gate": _W + "," + _LINES + "," + _TOK + ", stem AS (SELECT DISTINCT s FROM (SELECT unnest([low] || regexp_split_to_array(low, '[_\\W]+')) AS s FROM terms) WHERE length(s) >= 4) SELECT DISTINCT token, df FROM post, stem WHERE contains(token, s) OR contains(s, token)",
    "name_echo": _W.replace(_T, _T.replace("(VALUES ", "(VALUES ('roster', 'roster', 'roster'), ")) + f", h AS (SELECT DISTINCT file_id, term FROM cur, terms WHERE contains({_FOLD.format(chr(39).join(['regexp_extract(path, ', '[^/]*$', ')']))}, folded)) SELECT file_id, term FROM h WHERE term IN (SELECT term FROM h GROUP BY 1 HAVING count(*) <= 200)",
}

_LISTED = """, top AS (SELECT * FROM (SELECT file_id, score, coverage, class, row_number() OVER (PARTITION BY class ORDER BY score DESC, file_id) AS place FROM ranked JOIN part USING (file_id) WHERE shown) WHERE place <= CASE WHEN class = 'code' THEN 12 ELSE 4 END),
code12 AS (SELECT file_id, place FROM top WHERE class = 'code')"""
_ORDER = "CASE term " + " ".join(f"WHEN '{t}' THEN {n}" for n, t in enumerate(TERMS)) + " END"
_FIRST3 = "array_to_string(list(o ORDER BY n)[1:3], ', ')"
SQL["find_sections"] = _W + _REL.replace("among AS (SELECT DISTINCT file_id FROM cand)", "among AS (SELECT file_id FROM code12)").replace(",\ne AS", _LISTED + ",\ne AS", 1) + f""",
role AS (SELECT file_id, {", ".join(f"coalesce(array_to_string(list(term ORDER BY {_ORDER}) FILTER (class = '{c}'), ', '), '') AS {c}" for c in ("declares", "in_path", "imports", "mentions"))} FROM ev1 GROUP BY 1),
ms AS (SELECT s.file_id, symbol_id, s.name, start_line, end_line, round(sum(idf), 6) AS weight FROM sym s JOIN cur USING (file_id), terms JOIN w USING (term) WHERE is_disc AND line_count >= 80 AND contains({_FOLD.format('s.name')}, folded) GROUP BY ALL),
mi AS (SELECT * FROM ms m WHERE NOT EXISTS (SELECT 1 FROM ms o WHERE o.file_id = m.file_id AND m.start_line <= o.start_line AND m.end_line >= o.end_line AND m.end_line - m.start_line > o.end_line - o.start_line)),
mt AS (SELECT file_id, array_to_string(list(name || ' [L' || coalesce(start_line::VARCHAR, 'null') || '-' || coalesce(end_line::VARCHAR, 'null') || ']' ORDER BY start_line NULLS LAST, symbol_id), ', ') AS symbols FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY weight DESC, start_line NULLS LAST, symbol_id) AS r FROM mi) WHERE r <= 6 GROUP BY 1),
us AS (SELECT a AS file_id, {_FIRST3} AS uses FROM (SELECT a, b AS o, place AS n FROM direct JOIN code12 ON b = file_id) GROUP BY 1),
ub AS (SELECT b AS file_id, {_FIRST3} AS used_by FROM (SELECT b, a AS o, place AS n FROM direct JOIN code12 ON a = file_id) GROUP BY 1),
nr AS (SELECT a AS file_id, {_FIRST3} AS near FROM (SELECT a, b AS o, place AS n FROM (SELECT a, b FROM sib UNION SELECT b, a FROM sib) JOIN code12 ON b = file_id) GROUP BY 1),
vi AS (SELECT a AS file_id, array_to_string(list_sort(list(DISTINCT term)), ', ') AS via FROM (SELECT a, b, term, row_number() OVER (PARTITION BY a, b ORDER BY idf DESC, term) AS p FROM direct JOIN (SELECT file_id AS b, term FROM ev1 WHERE class = 'declares') USING (b) JOIN (SELECT term, idf FROM w WHERE is_disc) USING (term) WHERE (a, term) IN (SELECT (file_id, term) FROM cand)) WHERE p <= 2 GROUP BY 1)
SELECT class, place, file_id, score, coverage, coalesce(declares, '') AS declares, coalesce(in_path, '') AS in_path, coalesce(imports, '') AS imports, coalesce(mentions, '') AS mentions, coalesce(symbols, '') AS symbols, coalesce(uses, '') AS uses, coalesce(used_by, '') AS used_by, coalesce(near, '') AS near, coalesce(via, '') AS via
FROM top LEFT JOIN role USING (file_id) LEFT JOIN mt USING (file_id) LEFT JOIN us USING (file_id) LEFT JOIN ub USING (file_id) LEFT JOIN nr USING (file_id) LEFT JOIN vi USING (file_id)"""

_B = SQL["rare_token_bridge"]
SQL["find_bridged"] = "WITH bridge AS (" + _B + "), " + BASE + "," + _LINES + "," + _TOK + _LISTED + """, two AS (SELECT a AS source, b AS related, n_shared, min_df FROM bridge UNION ALL SELECT b, a, n_shared, min_df FROM bridge),
mine AS (SELECT two.*, place AS rank FROM two JOIN code12 ON source = file_id WHERE place <= 3 AND related NOT IN (SELECT file_id FROM code12)),
pf AS (SELECT token, unnest(files) AS f FROM post),
nm2 AS (SELECT source, related, list_sort(list(DISTINCT x.token)) AS tokens FROM mine JOIN pf x ON x.f = source JOIN pf y ON y.f = related AND y.token = x.token GROUP BY 1, 2),
stem AS (SELECT DISTINCT s FROM (SELECT unnest([low] || regexp_split_to_array(low, '[_\\W]+')) AS s FROM terms) WHERE length(s) >= 4),
near3 AS (SELECT DISTINCT source, related FROM (SELECT source, related, unnest(tokens) AS t FROM nm2), stem WHERE contains(t, s) OR contains(s, t)),
r3 AS (SELECT * FROM (SELECT mine.*, tokens, row_number() OVER (PARTITION BY source ORDER BY n_shared DESC, min_df, related) AS place FROM mine JOIN nm2 USING (source, related) WHERE (source, related) IN (SELECT (source, related) FROM near3)) WHERE place <= 3),
o3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY related ORDER BY rank, place, source) AS o FROM r3) WHERE o = 1)
SELECT source, related, array_to_string(tokens[1:3], ', ') AS tokens, row_number() OVER (ORDER BY rank, place) AS place FROM o3 ORDER BY place LIMIT 6"""
SQL["related_files"] = "WITH bridge AS (" + _B + "), two AS (SELECT a AS file_id, b AS related, n_shared, min_df FROM bridge UNION ALL SELECT b, a, n_shared, min_df FROM bridge) SELECT file_id, related, n_shared, place FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n_shared DESC, min_df, related) AS place FROM two) WHERE place <= 3"
