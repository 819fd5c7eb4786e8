"""Queries of the notebook over notes and anchors of the code index, and the same in SQL.

Notes are the documents of kind note, of several texts the newest: the first line is the title, a type comes from the id, an
alias is the second heading. Anchors are those of the index; a flow's steps are its anchors' paths as they are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed as K
from tessera.functions import text as X
from tessera.operators import fold as L
from tessera.operators.catalog_fold import RECORDS_SQL
from tessera.operators.catalog_fold import records as fold_records
from tessera.operators.catalog_graph import _files, _symbols, _G
from tessera.operators.catalog_text import STEM
from tessera.plans import kb as N
from tessera.session import key_form, table

QUERY = "Where does the ledger counter wrap, see loadHarbor and the retries of flushLedger"
TERMS = [t for t in X.parse_terms(QUERY) if t.lower() not in K.PROSE_STOP_WORDS]
IGNORE = ["*.md", "generated/", "src/ledger/", "!src/ledger/*.ts"]


def notes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").where("kind = 'note' and note_id is not null").groupBy("note_id").agg(F.max_by("text", F.struct("created_at", "text")).alias("text"))
    m = (F.ascii(F.substring("note_id", -1, 1)) + F.length("note_id")) % 10
    typ = F.when(m < 4, "file").when(m < 8, "flow").otherwise("lesson")
    status = F.when(m == 3, "superseded").when(m == 7, "retracted").otherwise("active")
    first = F.regexp_replace(F.substring_index("text", "\n", 1), r"^[\s#]+", "")
    alias = F.filter(F.array(F.regexp_extract("text", r"\n## ([^\n]+)", 1)), lambda a: (a != "") & (m % 2 == 0))
    return n.select("note_id", typ.alias("type"), status.alias("status"), F.coalesce(first, F.lit("")).alias("title"), alias.alias("aliases"), F.coalesce("text", F.lit("")).alias("body"))


def anchors(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "anchors").where("note_id is not null").groupBy("anchor_id").agg(F.max_by(F.struct("note_id", "repo", "path", "symbols", "hash"), F.struct("verified_at", "note_id")).alias("r")).select("r.*")
    return a.select("note_id", F.concat("repo", F.lit("/"), key_form(F.col("path"))).alias("path"), "symbols", "hash")


def shaped(spark: SparkSession, d: str) -> DataFrame:
    """Notes with the scope terms of lessons, two words of the title, and the steps of flows; every third has none."""
    a = table(spark, d, "anchors").where("note_id is not null and path is not null").groupBy("note_id").agg(F.array_sort(F.collect_set(F.concat("repo", F.lit("/"), "path"))).alias("written"))
    terms = F.array_distinct(F.slice(F.filter(X.symbol_tokens("title"), lambda t: F.length(t) >= 4), 1, 2))
    some = F.pmod(F.length("note_id"), F.lit(3)) > 0
    return notes(spark, d).join(a, "note_id", "left").withColumns({"scope_terms": F.when((F.col("type") == "lesson") & some, terms), "steps": F.when((F.col("type") == "flow") & some, F.col("written"))}).drop("written")


def live(spark: SparkSession, d: str) -> DataFrame:
    """Live files with the hash of their version seen last."""
    h = table(spark, d, "live_hashes").groupBy(F.concat("repo", F.lit("/"), "path").alias("path")).agg(F.max_by("hash", F.struct("seen_at", "hash")).alias("hash"))
    return h.join(_files(spark, d).select(F.col("file_id").alias("path")), "path", "left_semi")


def _gone(spark, d):
    h = table(spark, d, "live_hashes").groupBy(F.concat("repo", F.lit("/"), "path").alias("path")).agg(F.max_by("hash", F.struct("seen_at", "hash")).alias("hash"))
    return h.join(_files(spark, d).select(F.col("file_id").alias("path")), "path", "left_anti")


def _renames(spark, d):
    return N.unique_renames(_gone(spark, d), live(spark, d), _gone(spark, d))


def _stamped(spark, d):
    return N.stamp(anchors(spark, d).where("path is not null"), live(spark, d), _renames(spark, d))


def _channels(spark, d):
    return N.channels(notes(spark, d), anchors(spark, d))


def _declared(spark, d):
    return anchors(spark, d).where("path is not null").select("path", F.explode_outer("symbols").alias("s")).distinct().groupBy("path").agg(F.collect_set("s").alias("symbols"))


def anchor_freshness(spark: SparkSession, d: str) -> DataFrame:
    return _stamped(spark, d).distinct()


def rename_unique_hash(spark: SparkSession, d: str) -> DataFrame:
    return _renames(spark, d)


def freshness_rollup(spark: SparkSession, d: str) -> DataFrame:
    return N.rollup(_stamped(spark, d)).groupBy("worst").agg(F.count(F.lit(1)).alias("n_notes"), F.sum("n_anchors").alias("n_anchors"))


def bm25_tool(spark: SparkSession, d: str) -> DataFrame:
    return N.bm25(_channels(spark, d), TERMS)


def note_term_df(spark: SparkSession, d: str) -> DataFrame:
    return N.stats(_channels(spark, d), TERMS).select("term", "df", "n", F.round("avg_len", 6).alias("avg_len"), F.round("avg_name", 6).alias("avg_name"))


def _hook(spark, d):
    return N.hook(_channels(spark, d), anchors(spark, d).where("path is not null"), _declared(spark, d), QUERY, TERMS)


def hook_score(spark: SparkSession, d: str) -> DataFrame:
    return _hook(spark, d).select("note_id", "score", "strong_terms", "carriers")


def hook_gates(spark: SparkSession, d: str) -> DataFrame:
    return _hook(spark, d).groupBy("rare", "convergence").agg(F.count(F.lit(1)).alias("n"))


def tier_rank(spark: SparkSession, d: str) -> DataFrame:
    t = N.tiers(N.bm25(_channels(spark, d), TERMS), notes(spark, d), _stamped(spark, d))
    return N.page(t, 8).select("note_id", "tier", "score", "place")


def relative_floor(spark: SparkSession, d: str) -> DataFrame:
    t = N.tiers(N.bm25(_channels(spark, d), TERMS), notes(spark, d), _stamped(spark, d)).where("tier = 0")
    return N.page(t, 20, K.HOOK_FLOOR).select("note_id", "score", "place")


def cap_then_exclude(spark: SparkSession, d: str) -> DataFrame:
    """A session that has seen the notes whose id ends in a letter gets a shorter page, never a refilled one."""
    t = N.tiers(N.bm25(_channels(spark, d), TERMS), notes(spark, d), _stamped(spark, d)).where("tier = 0")
    return N.page(t, 12).where(~F.col("note_id").rlike("[m-z]$")).select("note_id", "place")


def implant_flag(spark: SparkSession, d: str) -> DataFrame:
    h = N.tiers(_hook(spark, d), notes(spark, d), _stamped(spark, d)).where("not inactive")
    return N.implant(N.page(h, 3, K.HOOK_FLOOR))


def convergence_lane(spark: SparkSession, d: str) -> DataFrame:
    return N.symbol_files(_declared(spark, d), TERMS)


def anchor_lane(spark: SparkSession, d: str) -> DataFrame:
    return N.anchor_lane(_declared(spark, d), TERMS)


def _asked(spark, d, known=None):
    """Lessons ask for two words of their title, half of them in some files only."""
    words = F.filter(X.symbol_tokens("title"), lambda t: F.length(t) >= 4)
    globs = F.when(F.length("note_id") % 2 == 0, F.array(F.lit("*.ts"), F.lit("*.py"))).otherwise(F.array().cast("array<string>"))
    return (notes(spark, d) if known is None else known).where("type = 'lesson'").select("note_id", F.array_distinct(F.slice(words, 1, 2)).alias("terms"), globs.alias("globs")).where("size(terms) > 0")


def _stamped_absence(spark, d, known=None):
    return N.absence_stamp(_asked(spark, d, known), table(spark, d, "documents").where("file_id is not null and text is not null").select("file_id", "text"))


def absence_stamp(spark: SparkSession, d: str) -> DataFrame:
    return _stamped_absence(spark, d).withColumn("samples", F.array_join("samples", ","))


def absence_verdict(spark: SparkSession, d: str) -> DataFrame:
    a = _asked(spark, d)
    s = _stamped_absence(spark, d).join(a, "note_id")
    stamped = F.when(F.pmod(F.length("note_id"), F.lit(3)) == 0, None).otherwise(F.reverse("terms"))
    return s.select("note_id", N.absence_verdict(stamped, F.col("terms"), F.col("n_matches")).alias("verdict"))


def exact_address_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every note filed at the address of any anchor with a symbol: notes that share (path, symbol)."""
    a = anchors(spark, d).where("path is not null")
    at = a.select("path", F.explode_outer("symbols").alias("symbol"), "note_id").distinct()
    n = notes(spark, d).where("status = 'active'").select("note_id", "type")
    return at.join(n, "note_id").groupBy("path", "symbol").agg(F.countDistinct("note_id").alias("n_notes"), F.min("note_id").alias("first_note")).where("symbol is not null")


def kb_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Lookup of the path with the most anchors (ties by path)."""
    a = anchors(spark, d).where("path is not null")
    top = a.groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path").first()
    return N.lookup(notes(spark, d), a, top["path"] if top else "")


def note_map_best(spark: SparkSession, d: str) -> DataFrame:
    return N.note_map(notes(spark, d), anchors(spark, d), TERMS)


def wikilink_backlinks(spark: SparkSession, d: str) -> DataFrame:
    """Notes whose text names another note's title in brackets: links are written in here, one per note to the next by id."""
    n = notes(spark, d)
    nxt = F.lead("note_id").over(N.Window.partitionBy("type").orderBy("note_id"))
    linked = n.withColumn("to", nxt).withColumn("body", F.concat("body", F.when(F.col("to").isNotNull(), F.concat(F.lit(" [["), "to", F.lit("]]"))).otherwise(""), F.lit(" [[no-such-note]]")))
    return N.wikilinks(linked.drop("to"))


def dup_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return N.duplicate_flows(notes(spark, d), anchors(spark, d))


def lint_findings(spark: SparkSession, d: str) -> DataFrame:
    n, a = N.cut(notes(spark, d)), N.cut(anchors(spark, d).where("path is not null"))  # each is read by several checks
    f = N.lint(n, a, N.stamp(a, live(spark, d), _renames(spark, d)), IGNORE, _stamped_absence(spark, d, n), L.warnings(fold_records(table(spark, d, "events"))))
    return f.groupBy("check").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("note_id").alias("n_notes"))


def repair_checks(spark: SparkSession, d: str) -> DataFrame:
    return N.repairs(shaped(spark, d), anchors(spark, d))


def page_omitted(spark: SparkSession, d: str) -> DataFrame:
    t = N.tiers(N.bm25(_channels(spark, d), TERMS), notes(spark, d), _stamped(spark, d))
    return N.omitted(t, 8)


def symbol_backfill(spark: SparkSession, d: str) -> DataFrame:
    dec = _symbols(spark, d).where("name is not null").select(F.col("file_id").alias("path"), "name", "start_line")
    b = N.symbol_backfill(notes(spark, d), anchors(spark, d), dec)
    return b.select("note_id", "path", F.size("symbols").cast("bigint").alias("n_symbols"), F.element_at("symbols", 1).alias("first_symbol"))


def status_totals(spark: SparkSession, d: str) -> DataFrame:
    return N.totals(notes(spark, d), _stamped(spark, d))


def paged_worklist(spark: SparkSession, d: str) -> DataFrame:
    return N.paged(N.repairs(shaped(spark, d), anchors(spark, d)), ["check", "note_id"], 10, 25)[0]


def notebook_toc(spark: SparkSession, d: str) -> DataFrame:
    """Contents by type: the titles of active notes, a row each, in the order of a range partitioning."""
    return notes(spark, d).where("status = 'active'").select("type", "note_id", "title").orderBy("type", "note_id")


def note_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids coined from titles: the slug, and ``-2``, ``-3`` where it is taken, by note id."""
    n = notes(spark, d).withColumn("slug", X.slugify("title")).withColumn("slug", F.when(F.col("slug") == "", "note").otherwise(F.col("slug")))
    r = F.row_number().over(N.Window.partitionBy("slug").orderBy("note_id"))
    return n.withColumn("r", r).select("note_id", F.when(F.col("r") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), "r")).alias("coined"))


QUERIES = {f.__name__: f for f in (
    anchor_freshness, rename_unique_hash, freshness_rollup, bm25_tool, note_term_df, hook_score, hook_gates, tier_rank, relative_floor, cap_then_exclude, page_omitted, implant_flag, convergence_lane, anchor_lane, absence_stamp,
    absence_verdict, exact_address_lookup, kb_lookup, note_map_best, wikilink_backlinks, dup_jaccard, lint_findings, repair_checks, symbol_backfill, status_totals, paged_worklist, notebook_toc, note_ids,
)}

_CODE = [t for t in TERMS if any(c.isdigit() or c in "_-" for c in t) or any(c.isupper() for c in t[1:])]
_V = ", ".join(f"('{t}', '{t.lower()}', {str(t in _CODE).lower()})" for t in TERMS)
_SQ = "regexp_replace(lower({}), '[-_/.\\s]+', '', 'g')"
_TOK = "list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: lower(w))"
_WORDS = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"
_KEYP = "regexp_replace(replace(path, chr(92), '/'), '^\\./', '')"
_ANCH = f"""
anc AS (SELECT note_id, repo || '/' || {_KEYP} AS path, symbols, hash FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY verified_at DESC NULLS LAST, note_id DESC) AS rn FROM anchors WHERE note_id IS NOT NULL) WHERE rn = 1),
lh AS (SELECT repo || '/' || path AS path, arg_max(hash, {{'a': seen_at, 'b': hash}}) AS hash FROM live_hashes GROUP BY 1),
liv AS (SELECT * FROM lh WHERE path IN (SELECT file_id FROM cur)), gone AS (SELECT * FROM lh WHERE path NOT IN (SELECT file_id FROM cur)),
ren AS (SELECT g.path, o.to_path, g.hash FROM gone g JOIN (SELECT hash, min(path) AS to_path FROM liv GROUP BY 1 HAVING count(*) = 1) o USING (hash) WHERE g.hash IN (SELECT hash FROM gone GROUP BY 1 HAVING count(*) = 1)),
st AS (SELECT note_id, a.path, CASE WHEN l.hash IS NULL AND a.hash <> 'missing' AND r.hash = a.hash THEN 'moved' WHEN l.hash IS NULL THEN 'missing' WHEN a.hash IS NULL THEN 'unverified' WHEN a.hash = 'missing' THEN 'changed' WHEN l.hash = a.hash THEN 'fresh' ELSE 'changed' END AS state, CASE WHEN l.hash IS NULL AND a.hash <> 'missing' AND r.hash = a.hash THEN r.to_path END AS moved_to FROM (SELECT * FROM anc WHERE path IS NOT NULL) a LEFT JOIN liv l USING (path) LEFT JOIN ren r USING (path))
"""
_F = _G + "," + _ANCH
_DEC = ", dec AS (SELECT path, list(DISTINCT s) FILTER (s IS NOT NULL) AS symbols FROM (SELECT path, unnest(CASE WHEN len(symbols) > 0 THEN symbols ELSE [NULL] END) AS s FROM anc WHERE path IS NOT NULL) GROUP BY 1), tm AS (SELECT * FROM (VALUES " + _V + ") v(term, low, code))"
SQL = {
    "anchor_freshness": _F + "SELECT DISTINCT * FROM st",
    "rename_unique_hash": _F + "SELECT path, to_path FROM ren",
    "freshness_rollup": _F + "SELECT worst, count(*) AS n_notes, CAST(sum(n) AS BIGINT) AS n_anchors FROM (SELECT note_id, arg_max(state, CASE state WHEN 'missing' THEN 4 WHEN 'changed' THEN 3 WHEN 'moved' THEN 2 WHEN 'unverified' THEN 1 ELSE 0 END) AS worst, count(*) AS n FROM st GROUP BY 1) GROUP BY 1",
    "convergence_lane": _F + _DEC + f"SELECT DISTINCT path, term FROM (SELECT path, unnest(symbols) AS s FROM dec), tm WHERE CASE WHEN code THEN contains(lower(s), low) ELSE list_contains({_TOK.format('s')}, low) END",
    "anchor_lane": _F + _DEC + "SELECT DISTINCT path, term FROM dec, tm WHERE contains(lower(path), low) OR len(list_filter(coalesce(symbols, []), lambda s: contains(lower(s), low))) > 0",
}

_NOTES = f""",
nt0 AS (SELECT note_id, text, (ascii(note_id[-1]) + length(note_id)) % 10 AS m FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY created_at DESC NULLS LAST, text DESC NULLS LAST) AS rn FROM documents WHERE kind = 'note' AND note_id IS NOT NULL) WHERE rn = 1),
nt AS (SELECT note_id, CASE WHEN m < 4 THEN 'file' WHEN m < 8 THEN 'flow' ELSE 'lesson' END AS type, CASE WHEN m = 3 THEN 'superseded' WHEN m = 7 THEN 'retracted' ELSE 'active' END AS status,
 coalesce(regexp_replace(split_part(text, chr(10), 1), '^[\\s#]+', ''), '') AS title, list_filter([regexp_extract(text, '\\n## ([^\\n]+)', 1)], lambda a: a IS NOT NULL AND a <> '' AND m % 2 = 0) AS aliases, coalesce(text, '') AS body FROM nt0),
tm AS (SELECT * FROM (VALUES {_V}) v(term, low, code)),
ch0 AS (SELECT nt.*, coalesce(lower(anc1.a), '') AS anchor, concat_ws(' ', title, array_to_string(aliases, ' ')) AS name_raw FROM nt LEFT JOIN (SELECT note_id, array_to_string(list_sort(list(DISTINCT concat_ws(' ', path, array_to_string(symbols, ' ')))), ' ') AS a FROM anc WHERE path IS NOT NULL GROUP BY 1) anc1 USING (note_id)),
ch AS (SELECT *, lower(name_raw) AS name, lower(body) AS lbody, greatest(1, {_WORDS.format('name_raw')}) AS n_name, 3 * {_WORDS.format('name_raw')} + 2 * {_WORDS.format('anchor')} + {_WORDS.format('lower(body)')} AS length FROM ch0),
pr AS (SELECT ch.*, term, low, code, contains(name, low) OR contains({_SQ.format('name')}, {_SQ.format('low')}) AS in_name, contains(anchor, low) OR contains({_SQ.format('anchor')}, {_SQ.format('low')}) AS in_anchor, contains(lbody, low) AS in_body FROM ch, tm),
sts AS (SELECT tm.term, coalesce(df, 0) AS df, (SELECT count(*) FROM ch) AS n, (SELECT greatest(1.0, avg(length)) FROM ch) AS avg_len, (SELECT greatest(1.0, avg(n_name)) FROM ch) AS avg_name FROM tm LEFT JOIN (SELECT term, count(*) AS df FROM pr WHERE in_name OR in_anchor OR in_body GROUP BY 1) USING (term)),
tfs AS (SELECT note_id, term, length, 3 * CASE WHEN contains(name, low) THEN (length(name) - length(replace(name, low, ''))) / length(low)::DOUBLE WHEN contains({_SQ.format('name')}, {_SQ.format('low')}) THEN 1 ELSE 0 END
 + 2 * CASE WHEN contains(anchor, low) THEN (length(anchor) - length(replace(anchor, low, ''))) / length(low)::DOUBLE WHEN contains({_SQ.format('anchor')}, {_SQ.format('low')}) THEN 1 ELSE 0 END + (length(lbody) - length(replace(lbody, low, ''))) / length(low)::DOUBLE AS tf FROM pr WHERE in_name OR in_anchor OR in_body),
bm AS (SELECT note_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * length / avg_len))), 6) AS score, count(*) AS covered FROM tfs JOIN sts USING (term) GROUP BY 1),
gn AS (SELECT note_id, bool_and(state = 'missing') AS g FROM st GROUP BY 1),
ti AS (SELECT note_id, score, CASE WHEN type <> 'lesson' AND coalesce(g, false) THEN 2 WHEN status <> 'active' THEN 1 ELSE 0 END AS tier FROM bm JOIN nt USING (note_id) LEFT JOIN gn USING (note_id)),
ask AS (SELECT note_id, terms, length(note_id) % 2 = 0 AS globbed FROM (SELECT note_id, list_distinct((list_filter({_TOK.format('title')}, lambda t: length(t) >= 4))[1:2]) AS terms FROM nt WHERE type = 'lesson') WHERE len(terms) > 0),
src AS (SELECT file_id, lower(text) AS low, regexp_matches(file_id, '\\.(ts|py)$') AS typed FROM documents WHERE file_id IS NOT NULL AND text IS NOT NULL),
met AS (SELECT DISTINCT t, file_id, typed FROM (SELECT DISTINCT unnest(terms) AS t FROM ask), src WHERE contains(low, t)),
abm AS (SELECT note_id, file_id FROM (SELECT note_id, unnest(terms) AS t, len(terms) AS k, globbed FROM ask) JOIN met USING (t) WHERE typed OR NOT globbed GROUP BY note_id, file_id, k HAVING count(*) = k),
ab AS (SELECT note_id, coalesce(n, 0) AS n_matches, sample, coalesce(samples, '') AS samples FROM ask LEFT JOIN (SELECT note_id, count(*) AS n, min(file_id) AS sample, array_to_string(list_sort(list(file_id))[1:3], ',') AS samples FROM abm GROUP BY 1) USING (note_id)),
asy AS (SELECT note_id, max((len(list_filter(coalesce(symbols, []), lambda x: x <> '')) > 0)::INT) AS s FROM anc GROUP BY 1),
stp AS (SELECT DISTINCT a.note_id, a.repo || '/' || a.path AS p FROM anchors a JOIN nt USING (note_id) WHERE a.path IS NOT NULL AND a.repo IS NOT NULL AND type = 'flow' AND status = 'active' AND length(note_id) % 3 > 0),
loo AS (SELECT note_id, array_to_string(list_sort(list(p)), ',') AS detail FROM stp WHERE p <> '' AND (note_id, p) NOT IN (SELECT (note_id, path) FROM anc WHERE path IS NOT NULL) GROUP BY 1),
act AS (SELECT * FROM nt WHERE status = 'active'),
rep AS (SELECT 'missing-identity-aliases' AS "check", note_id, '' AS detail FROM act WHERE type IN ('file', 'flow') AND len(aliases) = 0 UNION ALL SELECT 'file-no-symbols', note_id, '' FROM act LEFT JOIN asy USING (note_id) WHERE type = 'file' AND coalesce(s, 0) = 0
 UNION ALL SELECT 'flow-no-steps', note_id, '' FROM act WHERE type = 'flow' AND note_id NOT IN (SELECT note_id FROM stp) UNION ALL SELECT 'flow-steps-unanchored', note_id, detail FROM loo
 UNION ALL SELECT 'missing-scope-terms', note_id, '' FROM act LEFT JOIN ask USING (note_id) WHERE type = 'lesson' AND (terms IS NULL OR length(note_id) % 3 = 0)),
fl AS (SELECT DISTINCT note_id, path FROM anc JOIN nt USING (note_id) WHERE path IS NOT NULL AND status = 'active' AND type = 'flow'),
fs AS (SELECT note_id, count(*) AS n FROM fl GROUP BY 1 HAVING count(*) >= 2),
dj AS (SELECT a.note_id AS a, b.note_id AS b, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*))::DOUBLE, 6) AS jaccard FROM fl a JOIN fl b ON a.path = b.path AND a.note_id < b.note_id JOIN fs x ON x.note_id = a.note_id JOIN fs y ON y.note_id = b.note_id GROUP BY 1, 2)
"""
_N = _F + _NOTES
_HITS = " + ".join(f"contains(nm, '{t.lower().replace('-', '').replace('_', '')}')::INT" for t in TERMS)
_NXT = "(SELECT note_id AS src, lead(note_id) OVER (PARTITION BY type ORDER BY note_id) AS dst FROM nt)"
SQL |= {
    "bm25_tool": _N + "SELECT * FROM bm",
    "note_term_df": _N + "SELECT term, df, n, round(avg_len, 6) AS avg_len, round(avg_name, 6) AS avg_name FROM sts",
    "tier_rank": _N + "SELECT note_id, tier, score, row_number() OVER (ORDER BY tier, score DESC, note_id) AS place FROM ti ORDER BY place LIMIT 8",
    "relative_floor": _N + "SELECT note_id, score, place FROM (SELECT note_id, score, row_number() OVER (ORDER BY score DESC, note_id) AS place, max(score) OVER () AS best FROM ti WHERE tier = 0) WHERE score >= 0.4 * best AND place <= 20",
    "cap_then_exclude": _N + "SELECT note_id, place FROM (SELECT note_id, row_number() OVER (ORDER BY score DESC, note_id) AS place FROM ti WHERE tier = 0) WHERE place <= 12 AND NOT regexp_matches(note_id, '[m-z]$')",
    "absence_stamp": _N + "SELECT * FROM ab",
    "absence_verdict": _N + "SELECT note_id, CASE WHEN length(note_id) % 3 = 0 THEN 'unverified' WHEN n_matches = 0 THEN 'holds' ELSE 'stale' END AS verdict FROM ab",
    "exact_address_lookup": _N + "SELECT path, symbol, count(DISTINCT note_id) AS n_notes, min(note_id) AS first_note FROM (SELECT path, unnest(symbols) AS symbol, note_id FROM anc WHERE path IS NOT NULL) JOIN nt USING (note_id) WHERE status = 'active' AND symbol IS NOT NULL GROUP BY 1, 2",
    "kb_lookup": _N + "SELECT DISTINCT note_id, CASE type WHEN 'file' THEN 'file-note' WHEN 'flow' THEN 'anchor' ELSE 'lesson' END AS via FROM anc JOIN nt USING (note_id) WHERE status = 'active' AND path = (SELECT path FROM anc WHERE path IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, path LIMIT 1)",
    "note_map_best": _N + f", nn AS (SELECT note_id, type, replace(replace(lower(concat_ws(' ', title, array_to_string(aliases, ' '))), '-', ''), '_', '') AS nm FROM nt WHERE status = 'active'), h AS (SELECT note_id, {_HITS} AS hits, CASE type WHEN 'file' THEN 0 WHEN 'flow' THEN 1 ELSE 2 END AS rk FROM nn) SELECT path, arg_min(note_id, (-hits, rk, note_id)) AS note_id, CAST(arg_min(hits, (-hits, rk, note_id)) AS BIGINT) AS hits FROM (SELECT DISTINCT note_id, path FROM anc WHERE path IS NOT NULL) JOIN h USING (note_id) GROUP BY 1",
    "wikilink_backlinks": _N + f"SELECT src, dst FROM {_NXT} WHERE dst IS NOT NULL",
    "dup_jaccard": _N + "SELECT * FROM dj WHERE jaccard >= 0.6",
    "lint_findings": _N + """, ig AS (SELECT DISTINCT note_id, path FROM anc JOIN nt USING (note_id) WHERE status = 'active' AND path IS NOT NULL AND CASE WHEN regexp_matches(path, '^src/ledger/[^/]*\\.ts(/.*)?$') THEN false WHEN regexp_matches(path, '^src/ledger/.*$') THEN true WHEN regexp_matches(path, '(^|/)generated/.*$') THEN true WHEN regexp_matches(path, '(^|/)[^/]*\\.md(/.*)?$') THEN true ELSE false END),
fnd AS (SELECT DISTINCT 'dead-anchor' AS "check", note_id, path AS detail FROM st JOIN nt USING (note_id) WHERE state = 'missing' AND status = 'active' UNION ALL SELECT 'duplicate-flows', a, b FROM dj WHERE jaccard >= 0.6
 UNION ALL SELECT 'orphan', note_id, '' FROM nt WHERE status = 'active' AND type <> 'file' UNION ALL SELECT 'ignored-anchor', note_id, path FROM ig UNION ALL SELECT 'absence-stale', note_id, '' FROM ab JOIN nt USING (note_id) WHERE n_matches > 0 AND status = 'active')
SELECT "check", count(*) AS n, count(DISTINCT note_id) AS n_notes FROM (SELECT "check", note_id FROM fnd UNION ALL SELECT 'malformed', note_id FROM (""" + RECORDS_SQL["fold_warnings"] + """)) GROUP BY 1""",
    "page_omitted": _N + ", o AS (SELECT score, row_number() OVER (ORDER BY tier, score DESC, note_id) AS place, first_value(score) OVER (ORDER BY tier, score DESC, note_id) AS best FROM ti) SELECT count(*) AS n_omitted FROM o WHERE place > 8 AND score >= 0.25 * best",
    "repair_checks": _N + "SELECT * FROM rep",
    "symbol_backfill": _N + ", d1 AS (SELECT file_id AS path, list(name ORDER BY start_line NULLS FIRST, name) AS l FROM sym WHERE name IS NOT NULL GROUP BY 1) SELECT DISTINCT note_id, path, least(15, len(l)) AS n_symbols, l[1] AS first_symbol FROM anc JOIN nt USING (note_id) JOIN d1 USING (path) WHERE len(coalesce(symbols, [])) = 0 AND status = 'active' AND type = 'file'",
    "status_totals": _N + ", wo AS (SELECT note_id, max(CASE state WHEN 'missing' THEN 4 WHEN 'changed' THEN 3 WHEN 'moved' THEN 2 WHEN 'unverified' THEN 1 ELSE 0 END) AS w FROM st GROUP BY 1) SELECT type, status, count(*) AS n_notes, CAST(sum((coalesce(w, 0) >= 3)::INT) AS BIGINT) AS n_flagged FROM nt LEFT JOIN wo USING (note_id) GROUP BY 1, 2",
    "paged_worklist": _N + 'SELECT * FROM rep ORDER BY "check", note_id LIMIT 25 OFFSET 10',
    "notebook_toc": _N + "SELECT type, note_id, title FROM nt WHERE status = 'active'",
    "note_ids": _N + ", sl AS (SELECT note_id, regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:60], '-+$', '') AS slug FROM nt), s2 AS (SELECT note_id, CASE WHEN slug = '' THEN 'note' ELSE slug END AS slug FROM sl) SELECT note_id, CASE WHEN r = 1 THEN slug ELSE slug || '-' || r END AS coined FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY note_id) AS r FROM s2)",
}

_SAME = STEM.format("lower(w)")
_WH = "len(list_filter(regexp_extract_all({0}, '[A-Za-z0-9]+'), lambda w: lower(w) = low OR " + _SAME + " = ts OR " + _SAME + " = ts || 'e' OR " + _SAME + " || 'e' = ts)) > 0"
_SQUASHED = "".join(c for c in QUERY.lower() if c not in "-_/." and not c.isspace())
_HOOK = f""",
lane AS (SELECT DISTINCT path, term FROM (SELECT path, unnest(symbols) AS s FROM anc WHERE path IS NOT NULL), tm WHERE CASE WHEN code THEN contains(lower(s), low) ELSE list_contains({_TOK.format('s')}, low) END),
cv AS (SELECT DISTINCT note_id, term FROM anc JOIN lane USING (path)),
h0 AS (SELECT pr.*, {STEM.format('low')} AS ts FROM pr),
h1 AS (SELECT *, {_WH.format('name_raw')} AS word FROM h0),
h2 AS (SELECT note_id, term, low, ts, code, word, n_name, title, aliases, in_name OR (NOT in_anchor AND NOT in_body AND NOT code AND word) AS in_name, in_anchor, in_body, df, n, avg_name, (note_id, term) IN (SELECT (note_id, term) FROM cv) AS converged FROM h1 JOIN sts USING (term)),
h3 AS (SELECT *, df <= ceil(n / 10.0) AS rare FROM h2 WHERE (in_name OR in_anchor OR in_body) AND (df = 1 OR df * 2 <= n) AND CASE WHEN code THEN in_name OR in_anchor ELSE word END),
grp AS (SELECT note_id, max(k) AS density FROM (SELECT note_id, g, count(*) FILTER ({_WH.format('txt')}) AS k FROM (SELECT note_id, low, ts, unnest([title] || aliases) AS txt, generate_subscripts([title] || aliases, 1) AS g FROM h3 WHERE in_name) GROUP BY 1, 2) GROUP BY 1),
h4 AS (SELECT note_id, sum((CASE WHEN in_name THEN 3 / greatest(1.0, n_name / avg_name) ELSE 0 END + CASE WHEN in_anchor THEN 2 ELSE 0 END + CASE WHEN in_body THEN 1 ELSE 0 END) * ln(1 + n / (1.0 + df))) AS boost, count(*) FILTER (in_name OR in_anchor) AS strong, bool_or(rare) AS rare, bool_or(converged) AS convergence, bool_or((converged AND rare) OR code) AS hard, count(*) AS carriers, bool_and(in_name AND NOT in_anchor AND NOT in_body AND NOT converged) AS name_only FROM h3 GROUP BY 1),
nmd AS (SELECT DISTINCT note_id FROM anc WHERE path IS NOT NULL AND length({_SQ.format('path')}) >= 6 AND contains('{_SQUASHED}', {_SQ.format('path')})),
hk AS (SELECT note_id, round(coalesce(boost, 0) + CASE WHEN nmd.note_id IS NOT NULL THEN 100 ELSE 0 END, 6) AS score, CAST(greatest(coalesce(strong, 0), (nmd.note_id IS NOT NULL)::INT) AS BIGINT) AS strong_terms, coalesce(rare, false) OR nmd.note_id IS NOT NULL AS rare, coalesce(convergence, false) AS convergence, CAST(coalesce(carriers, 0) + (nmd.note_id IS NOT NULL)::INT AS BIGINT) AS carriers
  FROM h4 FULL JOIN nmd USING (note_id) LEFT JOIN grp USING (note_id) WHERE nmd.note_id IS NOT NULL OR (strong > 0 AND (hard OR carriers >= 2) AND NOT (note_id IN (SELECT note_id FROM anc WHERE path IS NOT NULL) AND name_only AND coalesce(density, 0) < 2)))
"""
_K = _N + _HOOK
SQL["hook_score"] = _K + "SELECT note_id, score, strong_terms, carriers FROM hk"
SQL["hook_gates"] = _K + "SELECT rare, convergence, count(*) AS n FROM hk GROUP BY 1, 2"
SQL["implant_flag"] = _K + ", t3 AS (SELECT hk.*, CASE WHEN status <> 'active' THEN 1 ELSE 0 END AS tier FROM hk JOIN nt USING (note_id) LEFT JOIN gn USING (note_id) WHERE NOT (type <> 'lesson' AND coalesce(g, false))), o3 AS (SELECT *, row_number() OVER (ORDER BY tier, score DESC, note_id) AS place, first_value(score) OVER (ORDER BY tier, score DESC, note_id) AS best FROM t3), k3 AS (SELECT *, row_number() OVER (ORDER BY place) AS p FROM o3 WHERE score >= 0.4 * best), l3 AS (SELECT *, lead(score) OVER (ORDER BY p) AS nxt FROM k3 WHERE p <= 3) SELECT note_id, convergence OR nxt IS NULL OR score >= 1.8 * nxt AS implant FROM l3 WHERE p = 1"
