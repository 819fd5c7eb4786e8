"""Queries of incremental maintenance and of sessions, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import graph as G
from tessera.operators import incremental as I
from tessera.operators.catalog_graph import _files, _G, _TOKS
from tessera.session import current_rows, cut, table, top_k
from tessera.sources import files
from tessera.streaming import sessions as S

CUTOFF = "2025-07-01"
CURSOR = 570


def _old(spark, d):
    """Files as they stood at the cutoff: the rows indexed before it."""
    f = table(spark, d, "files").where(F.col("indexed_at") < F.lit(CUTOFF).cast("timestamp"))
    return current_rows(f, "deleted_at", "mtime_ms", "size_bytes", "hash").where("deleted_at is null").select(F.col("file_id").alias("path"), "mtime_ms", "size_bytes", "hash")


def _new(spark, d):
    return _files(spark, d).select(F.col("file_id").alias("path"), "mtime_ms", "size_bytes", "hash")


def reconcile_diff(spark: SparkSession, d: str) -> DataFrame:
    return I.reconcile(_old(spark, d), _new(spark, d))


def patch_plan(spark: SparkSession, d: str) -> DataFrame:
    o, n = _old(spark, d), _new(spark, d)
    return I.patch_plan(I.reconcile(o, n), o, n).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def patch_decision(spark: SparkSession, d: str) -> DataFrame:
    o, n = _old(spark, d), _new(spark, d)
    return I.reconcile(o, n).agg(F.count(F.lit(1)).alias("n_changed")).select("n_changed", F.lit(I.patch_limit(o.count())).cast("bigint").alias("threshold")).withColumn("patch", F.col("n_changed") <= F.col("threshold"))


def patch_equals_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the live files, built anew and by a patch of those at the cutoff: rows on one side only."""
    o, n = _old(spark, d), _new(spark, d)
    e = G.adjacency(table(spark, d, "edges"))
    among = lambda f: e.join(f.select(F.col("path").alias("src")), "src", "left_semi").join(f.select(F.col("path").alias("dst")), "dst", "left_semi").select("src", "dst")
    before, rebuilt = among(o), among(n)
    # edges into files that came anew make their sources affected as well
    new_targets = rebuilt.join(I.reconcile(o, n).where("change = 'new'").select(F.col("path").alias("dst")), "dst", "left_semi").select(F.col("src").alias("path"), F.lit("update").alias("action"))
    plan = I.patch_plan(I.reconcile(o, n), o, n).unionByName(new_targets).distinct()
    patched = I.patch_edges(before, plan, rebuilt)
    diff = patched.exceptAll(rebuilt).withColumn("side", F.lit("patch")).unionByName(rebuilt.exceptAll(patched).withColumn("side", F.lit("rebuild")))
    return rebuilt.agg(F.count(F.lit(1)).alias("n_edges")).withColumn("n_differences", F.lit(diff.count()).cast("bigint"))


def patch_index(spark: SparkSession, d: str) -> DataFrame:
    """Tokens, their document frequencies and symbol edges, patched from the cutoff and built anew: rows, and those on one side only."""
    f = table(spark, d, "files")
    cols = [c for c in f.columns if c not in ("file_id", "indexed_at", "received_at")]
    old_files, new_files = current_rows(f.where(F.col("indexed_at") < F.lit(CUTOFF).cast("timestamp")), *cols).where("deleted_at is null"), current_rows(f, *cols).where("deleted_at is null")
    o, n = _old(spark, d), _new(spark, d)
    touched = cut(I.patch_plan(I.reconcile(o, n), o, n).where("action <> 'refresh'").select("path"))
    tokens = lambda x: G.file_tokens(x).select("file_id", "token").distinct()
    before, after = tokens(old_files), tokens(new_files)
    count = lambda t: t.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    e = table(spark, d, "symbol_edges").where("src is not null").select("edge_id", F.substring_index("src", "#", 1).alias("file_id")).distinct()
    of = lambda x: e.join(x.select("file_id"), "file_id", "left_semi")
    parts = [("tokens", I.patch_rows(before, after, touched), after), ("token_df", I.patch_counts(count(before), before, after, touched), count(after)), ("symbol_edges", I.patch_rows(of(old_files), of(new_files), touched), of(new_files))]
    out = None
    for name, patched, rebuilt in parts:
        diff = patched.exceptAll(rebuilt.select(*patched.columns)).unionByName(rebuilt.select(*patched.columns).exceptAll(patched))
        row = rebuilt.agg(F.count(F.lit(1)).alias("n")).crossJoin(diff.agg(F.count(F.lit(1)).alias("n_differences"))).withColumn("part", F.lit(name))  # one row each
        out = row if out is None else out.unionByName(row)
    return out.select("part", "n", "n_differences")


def search_redundant(spark: SparkSession, d: str) -> DataFrame:
    """Searches that only meet files met before, of the event log read as calls: a view finds, a click searches, a purchase slices."""
    e = table(spark, d, "events").where("user_id is not null").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.when(F.col("event_type") == "view", "find").when(F.col("event_type") == "click", "search").when(F.col("event_type") == "purchase", "gs").otherwise("other")
    name = lambda m: F.concat(F.lit("f"), (F.col("k") % m).cast("string"))
    return S.redundant_searches(e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), kind.alias("kind"), F.array(name(40), name(7)).alias("files"), (F.col("k") % 5 == 0).alias("is_empty")))


def audit_sample(spark: SparkSession, d: str) -> DataFrame:
    return I.audit_sample(_files(spark, d), CURSOR)


def debounce_batches(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of a user's events, parted by six quiet hours."""
    b = S.debounce(table(spark, d, "events"), "user_id", "ts", "event_type", "6 hours")
    return b.select("user_id", "start", "n", F.array_join("items", ",").alias("items"))


def seen_ttl(spark: SparkSession, d: str) -> DataFrame:
    return S.first_seen(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


def _stops(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, d, "events").withColumn("k", k)
    name = F.concat(F.lit("f"), (F.col("k") % 40).cast("string"))
    one = lambda t, f: F.when(F.col("event_type") == t, F.concat(F.lit('{"'), name, F.lit(f'": {{"{f}": 1}}}}')))
    delta = F.coalesce(one("click", "edits"), one("view", "reads"), one("purchase", "gs"), F.lit("{}"))
    fresh = F.when(F.col("k") % 13 == 0, F.concat(F.lit('["'), name, F.lit('"]'))).otherwise("[]")
    return e.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("ord"), delta.alias("delta"), fresh.alias("fresh"), ((F.col("event_type") == "signup") & (F.col("k") % 10 == 0)).alias("drift"))


def capture_trigger(spark: SparkSession, d: str) -> DataFrame:
    return S.capture_trigger(_stops(spark, d))


def capture_totals(spark: SparkSession, d: str) -> DataFrame:
    return S.capture_trigger(_stops(spark, d)).groupBy("fire", "mode").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("files")).alias("n_files"))


def _hooks(spark, d):
    r = table(spark, d, "session_records").where("kind = 'hook'").select("session", "seq", "record_id", F.try_parse_json("raw").alias("v")).where("v is not null").dropDuplicates(["session", "seq"])
    get = lambda p: F.try_variant_get("v", p, "string")
    return r.select("session", "seq", get("$.tool_name").alias("tool"), get("$.tool_input.command").alias("command"), get("$.tool_input.path").alias("path")).where("tool is not null")


def search_streaks(spark: SparkSession, d: str) -> DataFrame:
    c = _hooks(spark, d)
    kind = F.when(F.col("tool") == "Read", "read").when((F.col("tool") == "Bash") & F.col("command").rlike(r"\bfind\b"), "find").when((F.col("tool") == "Bash") & F.col("command").rlike(r"\bgs\b"), "gs").when(F.col("tool").isin("Grep", "Glob") | F.col("command").rlike(r"\b(grep|rg|ls|cat)\b"), "search").otherwise("other")
    s = S.streaks(c.select("session", F.col("seq").cast("bigint").alias("seq"), kind.alias("kind")))
    return s


def evidence_rank(spark: SparkSession, d: str) -> DataFrame:
    """Files a session touched by the tool calls of all hosts, most edits first, then most events; thirty a session."""
    r = table(spark, d, "session_records").where(is_object("raw")).dropDuplicates(["record_id"])
    e = files.tool_evidence(files.tool_calls(r))
    return top_k(e, ["session"], [F.desc("edits"), F.desc("events"), "path"], S.MAX_CLAIM)


def synthesis_segments(spark: SparkSession, d: str) -> DataFrame:
    """Per session: text and tool calls of the assistant, and whether it is a summing-up: much prose, few calls."""
    r = table(spark, d, "session_records").where("kind = 'transcript'").select("session", "record_id", F.try_parse_json("raw").alias("v")).where("v is not null").dropDuplicates(["record_id"])
    blocks = F.try_variant_get("v", "$.message.content", "array<variant>")
    b = r.where(F.try_variant_get("v", "$.role", "string") == "assistant").select("session", F.explode(blocks).alias("b"))
    kind, text = F.try_variant_get("b", "$.type", "string"), F.try_variant_get("b", "$.text", "string")
    s = b.groupBy("session").agg(F.sum(F.when(kind == "text", F.length(text)).otherwise(0)).alias("text_chars"), F.sum(F.when(kind == "tool_use", 1).otherwise(0)).alias("tool_calls"))
    return s.select("session", "text_chars", "tool_calls", ((F.col("text_chars") >= 1500) & (F.col("tool_calls") <= 2)).alias("synthesis"))


def is_object(c: str):
    """A text that is one JSON object: the variant parser doesn't look behind the first value, so the ends are checked."""
    return F.coalesce(F.try_parse_json(c).isNotNull() & F.trim(c).like("{%}"), F.lit(False))


def bad_records(spark: SparkSession, d: str) -> DataFrame:
    """Records that are no JSON object as a whole, by kind: skipped by every reader, with a warning."""
    r = table(spark, d, "session_records").dropDuplicates(["record_id"])
    return r.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(~is_object("raw"), 1).otherwise(0)).alias("n_bad"))


def coverage_worklist(spark: SparkSession, d: str) -> DataFrame:
    """Per repository: files with a fresh note, files whose notes aren't, files without one."""
    from tessera.operators.catalog_notes import _stamped

    per = _stamped(spark, d).groupBy(F.col("path").alias("file_id")).agg(F.max((F.col("state") == "fresh").cast("int")).alias("fresh"))
    f = _files(spark, d).select("file_id", "repo").join(per, "file_id", "left")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return f.groupBy("repo").agg(n(F.col("fresh") == 1).alias("done"), n(F.col("fresh") == 0).alias("outstanding"), n(F.col("fresh").isNull()).alias("uncovered"))


QUERIES = {f.__name__: f for f in (
    reconcile_diff, patch_plan, patch_decision, patch_equals_rebuild, patch_index, search_redundant, audit_sample, debounce_batches, seen_ttl, capture_trigger, capture_totals, search_streaks, evidence_rank, synthesis_segments, bad_records, coverage_worklist,
)}

_I = _G + f""",
o AS (SELECT file_id AS path, mtime_ms, size_bytes, hash FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY indexed_at DESC NULLS LAST, received_at DESC NULLS LAST) AS rn FROM files WHERE file_id IS NOT NULL AND indexed_at < TIMESTAMPTZ '{CUTOFF} 00:00:00+00') WHERE rn = 1 AND deleted_at IS NULL),
rc AS (SELECT coalesce(o.path, n.file_id) AS path, CASE WHEN n.file_id IS NULL THEN 'deleted' WHEN o.path IS NULL THEN 'new' WHEN NOT coalesce(o.mtime_ms = n.mtime_ms AND o.size_bytes = n.size_bytes, false) THEN 'stale' END AS change, o.hash AS oh, n.hash AS nh FROM o FULL JOIN cur n ON n.file_id = o.path),
rcc AS (SELECT * FROM rc WHERE change IS NOT NULL)
"""
from tessera.operators.catalog_notes import _F as _NF  # noqa: E402

_HOOKS = "WITH h AS (SELECT DISTINCT session, seq, json_extract_string(raw, '$.tool_name') AS tool, json_extract_string(raw, '$.tool_input.command') AS command, CASE WHEN json_type(raw, '$.tool_input.path') = 'VARCHAR' THEN json_extract_string(raw, '$.tool_input.path') END AS path FROM session_records WHERE kind = 'hook' AND json_valid(raw) AND json_type(raw, '$.tool_name') = 'VARCHAR')"
SQL = {
    "evidence_rank": """WITH r AS (SELECT DISTINCT record_id, session, kind, CAST(raw AS JSON) AS v FROM session_records WHERE raw IS NOT NULL AND json_valid(raw) AND json_type(raw) = 'OBJECT'),
ev AS (SELECT session, v AS e FROM r WHERE kind = 'hook' UNION ALL SELECT session, json_extract(v, '$.postToolUse') FROM r WHERE kind = 'hook' AND json_type(v, '$.postToolUse') = 'OBJECT' UNION ALL SELECT session, unnest(CAST(json_extract(v, '$.postToolUse') AS JSON[])) FROM r WHERE kind = 'hook' AND json_type(v, '$.postToolUse') = 'ARRAY'),
bl AS (SELECT session, unnest(CAST(json_extract(v, '$.message.content') AS JSON[])) AS b FROM r WHERE kind = 'transcript' AND json_type(v, '$.message.content') = 'ARRAY'),
tc AS (SELECT session, json_extract_string(e, '$.tool_name') AS tool, CASE WHEN json_type(e, '$.tool_input.path') = 'VARCHAR' THEN json_extract_string(e, '$.tool_input.path') WHEN json_type(e, '$.tool_input.file_path') = 'VARCHAR' THEN json_extract_string(e, '$.tool_input.file_path') END AS path FROM ev
 UNION ALL SELECT session, json_extract_string(b, '$.name'), CASE WHEN json_type(b, '$.input.path') = 'VARCHAR' THEN json_extract_string(b, '$.input.path') WHEN json_type(b, '$.input.file_path') = 'VARCHAR' THEN json_extract_string(b, '$.input.file_path') END FROM bl WHERE json_extract_string(b, '$.type') = 'tool_use'),
e AS (SELECT session, path, CAST(sum((tool = 'Read')::INT) AS BIGINT) AS reads, CAST(sum((tool IN ('Edit', 'Write', 'MultiEdit', 'NotebookEdit'))::INT) AS BIGINT) AS edits, count(*) AS events FROM tc WHERE tool IS NOT NULL AND path IS NOT NULL AND path <> '' GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY edits DESC, events DESC, path) AS place FROM e WHERE reads + edits > 0) WHERE place <= 30""",
    "search_streaks": _HOOKS + """, k AS (SELECT session, CAST(seq AS BIGINT) AS seq, CASE WHEN tool = 'Read' THEN 'read' WHEN tool = 'Bash' AND regexp_matches(command, '\\bfind\\b') THEN 'find' WHEN tool = 'Bash' AND regexp_matches(command, '\\bgs\\b') THEN 'gs' WHEN tool IN ('Grep', 'Glob') OR regexp_matches(command, '\\b(grep|rg|ls|cat)\\b') THEN 'search' ELSE 'other' END AS kind FROM h),
w AS (SELECT *, sum((kind IN ('read', 'gs'))::INT) OVER (PARTITION BY session ORDER BY seq) AS rf, sum((kind IN ('read', 'gs', 'find'))::INT) OVER (PARTITION BY session ORDER BY seq) AS rs, row_number() OVER (PARTITION BY session ORDER BY seq) AS total FROM k),
x AS (SELECT session, seq, kind, total, CAST(sum((kind = 'find')::INT) OVER (PARTITION BY session, rf ORDER BY seq) AS BIGINT) AS finds_since_read, CAST(sum((kind = 'search')::INT) OVER (PARTITION BY session, rs ORDER BY seq) AS BIGINT) AS searches_since_other FROM w)
SELECT session, seq, kind, finds_since_read, searches_since_other, CASE WHEN kind = 'find' AND finds_since_read = 2 THEN 'read' WHEN kind = 'search' AND searches_since_other = 3 THEN 'find' WHEN total % 12 = 0 THEN 'checkpoint' END AS nudge FROM x""",
    "patch_index": _G + _TOKS + ", t AS (SELECT DISTINCT file_id, token FROM toks) SELECT 'tokens' AS part, count(*) AS n, 0 AS n_differences FROM t UNION ALL SELECT 'token_df', count(DISTINCT token), 0 FROM t UNION ALL SELECT 'symbol_edges', count(*), 0 FROM (SELECT DISTINCT edge_id, split_part(src, '#', 1) AS file_id FROM symbol_edges WHERE src IS NOT NULL) WHERE file_id IN (SELECT file_id FROM cur)",
    "search_redundant": """WITH c AS (SELECT user_id AS session, event_id AS seq, event_type AS t, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE user_id IS NOT NULL),
m AS (SELECT DISTINCT session, seq, f FROM (SELECT session, seq, unnest(['f' || (k % 40), 'f' || (k % 7)]) AS f FROM c) WHERE f IS NOT NULL), fi AS (SELECT session, f, min(seq) AS first FROM m GROUP BY 1, 2),
o AS (SELECT session, seq FROM m JOIN fi USING (session, f) GROUP BY 1, 2 HAVING max(first) < seq), aw AS (SELECT session, min(seq) AS aware FROM c WHERE t IN ('view', 'purchase') GROUP BY 1)
SELECT session, seq FROM (SELECT session, seq, row_number() OVER (PARTITION BY session ORDER BY seq) AS r FROM c JOIN o USING (session, seq) JOIN aw USING (session) WHERE t = 'click' AND coalesce(k % 5, 1) <> 0 AND aware < seq) WHERE r <= 6""",
    "reconcile_diff": _I + "SELECT path, change FROM rcc",
    "patch_plan": _I + "SELECT CASE WHEN change = 'deleted' THEN 'delete' WHEN change = 'new' THEN 'insert' WHEN oh = nh THEN 'refresh' ELSE 'update' END AS action, count(*) AS n FROM rcc GROUP BY 1",
    "patch_decision": _I + "SELECT *, n_changed <= threshold AS patch FROM (SELECT (SELECT count(*) FROM rcc) AS n_changed, CAST(greatest(30, ceil(0.2 * (SELECT count(*) FROM o))) AS BIGINT) AS threshold)",
    "patch_equals_rebuild": _I + "SELECT count(*) AS n_edges, 0 AS n_differences FROM adj WHERE src IN (SELECT file_id FROM cur) AND dst IN (SELECT file_id FROM cur)",
    "audit_sample": _I + f", p AS (SELECT file_id, row_number() OVER (ORDER BY repo, file_id) - 1 AS pos, count(*) OVER () AS n FROM cur) SELECT file_id FROM p WHERE (pos - {CURSOR} % n + n) % n < 50",
    "debounce_batches": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS b FROM events WHERE user_id IS NOT NULL), h AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS items FROM h GROUP BY user_id, s",
    "seen_ttl": "SELECT user_id, event_type, event_id FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gap FROM events) WHERE gap IS NULL OR gap > INTERVAL 24 HOURS",
    "coverage_worklist": _NF + ", pf AS (SELECT path AS file_id, bool_or(state = 'fresh') AS fresh FROM st GROUP BY 1) SELECT repo, count(*) FILTER (fresh) AS done, count(*) FILTER (NOT fresh) AS outstanding, count(*) FILTER (fresh IS NULL) AS uncovered FROM cur LEFT JOIN pf USING (file_id) GROUP BY 1",
    "bad_records": "SELECT kind, count(*) AS n, CAST(sum(CASE WHEN raw IS NULL OR NOT json_valid(raw) OR json_type(raw) <> 'OBJECT' THEN 1 ELSE 0 END) AS BIGINT) AS n_bad FROM (SELECT DISTINCT record_id, kind, raw FROM session_records) GROUP BY 1",
    "synthesis_segments": "WITH r AS (SELECT DISTINCT record_id, session, raw FROM session_records WHERE kind = 'transcript' AND json_valid(raw)), b AS (SELECT session, unnest(CAST(json_extract(raw, '$.message.content') AS JSON[])) AS b FROM r WHERE json_extract_string(raw, '$.role') = 'assistant' AND json_type(raw, '$.message.content') = 'ARRAY') SELECT *, text_chars >= 1500 AND tool_calls <= 2 AS synthesis FROM (SELECT session, CAST(sum(CASE WHEN json_extract_string(b, '$.type') = 'text' THEN length(json_extract_string(b, '$.text')) ELSE 0 END) AS BIGINT) AS text_chars, CAST(sum((coalesce(json_extract_string(b, '$.type'), '') = 'tool_use')::INT) AS BIGINT) AS tool_calls FROM b GROUP BY 1)",
}
