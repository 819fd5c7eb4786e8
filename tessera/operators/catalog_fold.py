"""Queries of the fold over an event log, and the same in SQL.

The log is the ``events`` table read as records of notes: a user is a note, views, clicks and purchases are puts, errors
retracts, sign-ups supersedes; the payload comes from the event's number ``k``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import fold as L
from tessera.session import table


def records(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    e = events.withColumn("k", k)
    typ = F.element_at(F.array(*map(F.lit, L.NOTE_TYPES)), (F.pmod(F.col("user_id") + (F.col("event_id") % 97 == 0).cast("int"), F.lit(3)) + 1).cast("int"))
    kind = lambda *t: F.col("event_type").isin(*t)
    s = lambda p, m: F.concat(F.lit(p), (F.col("k") % m).cast("string"))
    path = F.concat(F.lit("src/"), (F.col("k") % 12).cast("string"), F.lit(".ts"))
    no = F.lit(None).cast("string")
    words = lambda c: F.when(c, F.array(s("a", 10), s("b", 7)))
    rk = F.element_at(F.array(*map(F.lit, ("note", "alias", "anchor", "invariant", "bogus"))), (F.col("k") % 5 + 1).cast("int"))
    r = e.select(
        F.col("user_id").cast("string").alias("note_id"), F.when(F.col("event_id") % 101 == 0, 2).otherwise(1).alias("v"), F.struct("ts", "event_id").alias("ord"), typ.alias("type"),
        F.when(kind("error"), "retract").when(kind("signup"), "supersede").otherwise("put").alias("op"), F.when(F.col("k") % 4 == 0, s("title ", 8)).alias("title"), F.when(kind("purchase"), F.concat(F.lit("summary "), F.col("k").cast("string"))).otherwise(no).alias("summary"), no.alias("body"),
        F.concat(F.lit("h"), F.col("k").cast("string")).alias("head"), words(kind("view")).alias("aliases"), F.when(kind("purchase") & (F.col("k") % 3 != 0), F.array(s("i", 5), s("a", 10))).alias("incident"), F.when(kind("click"), F.array(s("inv", 6))).alias("invariants"),
        F.when(kind("click"), F.struct(path.alias("path"), F.array(s("s", 6)).alias("symbols"), F.when(F.col("k") % 2 == 0, s("x", 9)).alias("hash"))).alias("anchor"),
        rk.alias("kind"), F.when(rk == "alias", s("a", 10)).when(rk == "anchor", path).when(rk == "invariant", s("inv", 6)).alias("key"), F.when(F.col("k") % 3 != 0, F.concat(F.lit("n"), F.col("k").cast("string"))).alias("by"),
    )
    return L.validate(r)


def _valid(spark, d):
    return records(table(spark, d, "events")).where("valid")


def fold_lww(spark: SparkSession, d: str) -> DataFrame:
    return L.scalars(_valid(spark, d)).select("note_id", "type", "title", "summary", "head")


def fold_status(spark: SparkSession, d: str) -> DataFrame:
    return L.scalars(_valid(spark, d)).select("note_id", "status", "superseded_by", "edits", F.col("updated.ts").alias("updated"))


def fold_union(spark: SparkSession, d: str) -> DataFrame:
    return L.union_with_tombstones(_valid(spark, d), F.col("aliases"), "alias").select("note_id", "value", F.col("first.event_id").alias("first_event"))


def fold_tombstone(spark: SparkSession, d: str) -> DataFrame:
    return L.union_with_tombstones(_valid(spark, d), F.col("invariants"), "invariant").select("note_id", "value", F.col("first.event_id").alias("first_event"))


def fold_title_demote(spark: SparkSession, d: str) -> DataFrame:
    return L.demoted_titles(_valid(spark, d)).select("note_id", "value", F.col("first.event_id").alias("first_event"))


def fold_incident_replace(spark: SparkSession, d: str) -> DataFrame:
    return L.incidents(_valid(spark, d)).select("note_id", F.array_join("incident", ",").alias("incident"))


def fold_keyed_upsert(spark: SparkSession, d: str) -> DataFrame:
    return L.anchors(_valid(spark, d)).select("note_id", "path", F.array_join("symbols", ",").alias("symbols"), "hash")


def fold_warnings(spark: SparkSession, d: str) -> DataFrame:
    return L.warnings(records(table(spark, d, "events")))


def fold_full(spark: SparkSession, d: str) -> DataFrame:
    """The state of every note in one row."""
    v = L.own_records(_valid(spark, d))
    al = L.union_with_tombstones(v, F.col("aliases"), "alias", True).unionByName(L.demoted_titles(v, True)).groupBy("note_id", "value").agg(F.min("first").alias("first"))
    al = al.groupBy("note_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "value"))), lambda x: x["value"]).alias("aliases"))
    one = F.concat_ws("|", "path", F.array_join("symbols", "+"), "hash")
    an = L.anchors(v, True).groupBy("note_id").agg(F.array_join(F.array_sort(F.collect_list(one)), ";").alias("anchors"))
    inv = L.union_with_tombstones(v, F.col("invariants"), "invariant", True).groupBy("note_id").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("invariants"))
    joined = L.scalars(v).join(al, "note_id", "left").join(an, "note_id", "left").join(inv, "note_id", "left").join(L.incidents(v, True), "note_id", "left")
    return joined.select("note_id", "type", "title", "summary", "head", "status", "superseded_by", "edits", F.array_join("incident", ",").alias("incident"), F.array_join(X.cap_aliases("aliases"), ",").alias("aliases"), "anchors", "invariants")


def _alias_lists(spark, d):
    v = _valid(spark, d)
    return L.union_with_tombstones(v, F.col("aliases"), "alias").groupBy("note_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "value"))), lambda x: x["value"]).alias("aliases"))


def alias_cap(spark: SparkSession, d: str) -> DataFrame:
    return _alias_lists(spark, d).select("note_id", F.array_join(X.cap_aliases("aliases"), ",").alias("aliases"))


def alias_hidden(spark: SparkSession, d: str) -> DataFrame:
    """Aliases beyond the cap: what a repair has to show before it takes any away."""
    a = _alias_lists(spark, d)
    return a.select("note_id", F.size("aliases").cast("bigint").alias("n_aliases"), F.array_join(F.array_sort(F.array_except("aliases", X.cap_aliases("aliases"))), ",").alias("hidden"))


QUERIES = {f.__name__: f for f in (fold_lww, fold_status, fold_union, fold_tombstone, fold_title_demote, fold_incident_replace, fold_keyed_upsert, fold_warnings, fold_full, alias_cap, alias_hidden)}

_REC = """
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
rec0 AS (SELECT CAST(user_id AS VARCHAR) AS note_id, CASE WHEN event_id % 101 = 0 THEN 2 ELSE 1 END AS v, ts, event_id, {'a': ts, 'b': event_id} AS ord, (['file', 'flow', 'lesson'])[(user_id + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) % 3 + 1] AS type,
 CASE event_type WHEN 'error' THEN 'retract' WHEN 'signup' THEN 'supersede' ELSE 'put' END AS op, CASE WHEN k % 4 = 0 THEN 'title ' || (k % 8) END AS title, CASE WHEN event_type = 'purchase' THEN 'summary ' || k END AS summary, 'h' || k AS head,
 CASE WHEN event_type = 'view' THEN ['a' || (k % 10), 'b' || (k % 7)] END AS aliases, CASE WHEN event_type = 'purchase' AND k % 3 <> 0 THEN ['i' || (k % 5), 'a' || (k % 10)] END AS incident, CASE WHEN event_type = 'click' THEN ['inv' || (k % 6)] END AS invariants,
 CASE WHEN event_type = 'click' THEN 'src/' || (k % 12) || '.ts' END AS path, 's' || (k % 6) AS symbol, CASE WHEN k % 2 = 0 THEN 'x' || (k % 9) END AS hash,
 (['note', 'alias', 'anchor', 'invariant', 'bogus'])[k % 5 + 1] AS kind, CASE k % 5 WHEN 1 THEN 'a' || (k % 10) WHEN 2 THEN 'src/' || (k % 12) || '.ts' WHEN 3 THEN 'inv' || (k % 6) END AS key, CASE WHEN k % 3 <> 0 THEN 'n' || k END AS by1 FROM e),
val AS (SELECT * FROM rec0 WHERE v = 1),
ty AS (SELECT note_id, arg_min(type, ord) AS type FROM val GROUP BY 1),
r AS (SELECT val.* FROM val JOIN ty USING (note_id, type)),
un AS (SELECT note_id, value, min(ord) AS first FROM (SELECT note_id, ord, unnest(aliases) AS value FROM r WHERE op = 'put') p LEFT JOIN (SELECT note_id, key AS value, max(ord) AS gone FROM r WHERE op = 'retract' AND kind = 'alias' GROUP BY 1, 2) g USING (note_id, value) WHERE gone IS NULL OR ord > gone GROUP BY 1, 2),
lists AS (SELECT note_id, list(value ORDER BY first, value) AS aliases FROM un GROUP BY 1)
"""
_CAP = "(aliases)[greatest(1, len(aliases) - 11):]"
SQL = {
    "fold_lww": _REC + "SELECT note_id, any_value(type) AS type, arg_max(title, ord) FILTER (op = 'put' AND title IS NOT NULL) AS title, arg_max(summary, ord) FILTER (op = 'put' AND summary IS NOT NULL) AS summary, arg_max(head, ord) FILTER (op = 'put') AS head FROM r GROUP BY 1",
    "fold_status": _REC + ", m AS (SELECT note_id, max(ord) FILTER (op = 'put') AS p, max(ord) FILTER (op = 'retract' AND kind = 'note') AS r1, max(ord) FILTER (op = 'supersede' AND by1 IS NOT NULL) AS s, arg_max(by1, ord) FILTER (op = 'supersede' AND by1 IS NOT NULL) AS superseded_by, count(*) FILTER (op = 'put' OR (op = 'retract' AND kind <> 'bogus') OR (op = 'supersede' AND by1 IS NOT NULL)) AS edits, max(ts) FILTER (op = 'put' OR (op = 'retract' AND kind <> 'bogus') OR (op = 'supersede' AND by1 IS NOT NULL)) AS updated FROM r GROUP BY 1) SELECT note_id, CASE WHEN s IS NOT NULL AND (r1 IS NULL OR s > r1) THEN 'superseded' WHEN r1 IS NOT NULL AND (p IS NULL OR r1 > p) THEN 'retracted' ELSE 'active' END AS status, superseded_by, edits, updated FROM m",
    "fold_union": _REC + "SELECT note_id, value, first.b AS first_event FROM un",
    "fold_tombstone": _REC + ", u2 AS (SELECT note_id, value, min(ord) AS first FROM (SELECT note_id, ord, unnest(invariants) AS value FROM r WHERE op = 'put') p LEFT JOIN (SELECT note_id, key AS value, max(ord) AS gone FROM r WHERE op = 'retract' AND kind = 'invariant' GROUP BY 1, 2) g USING (note_id, value) WHERE gone IS NULL OR ord > gone GROUP BY 1, 2) SELECT note_id, value, first.b AS first_event FROM u2",
    "fold_title_demote": _REC + ", t AS (SELECT note_id, title AS value, ord, lead(title) OVER (PARTITION BY note_id ORDER BY ord) AS nxt FROM r WHERE op = 'put' AND title IS NOT NULL), f AS (SELECT note_id, value, min(ord) AS first FROM t GROUP BY 1, 2) SELECT note_id, value, first.b AS first_event FROM f WHERE (note_id, value) IN (SELECT (note_id, value) FROM t WHERE nxt <> value)",
    "fold_incident_replace": _REC + ", w AS (SELECT note_id, max(ord) AS ord, arg_max(coalesce(incident, []), ord) AS words FROM r WHERE op = 'put' AND summary IS NOT NULL GROUP BY 1), g AS (SELECT note_id, key, max(ord) AS gone FROM r WHERE op = 'retract' AND kind = 'alias' GROUP BY 1, 2), x AS (SELECT w.note_id, list(DISTINCT u.key) FILTER (gone IS NULL OR w.ord > gone) AS l FROM w LEFT JOIN (SELECT note_id, unnest(words) AS key FROM w) u ON u.note_id = w.note_id LEFT JOIN g ON g.note_id = w.note_id AND g.key = u.key GROUP BY 1) SELECT note_id, array_to_string(list_sort(coalesce(list_filter(l, lambda q: q IS NOT NULL), [])), ',') AS incident FROM x",
    "fold_keyed_upsert": _REC + ", p AS (SELECT note_id, path, ord, symbol, hash, gone FROM (SELECT * FROM r WHERE op = 'put' AND path IS NOT NULL) a LEFT JOIN (SELECT note_id, key AS path, max(ord) AS gone FROM r WHERE op = 'retract' AND kind = 'anchor' GROUP BY 1, 2) g USING (note_id, path)) SELECT note_id, path, array_to_string(list_sort(list(DISTINCT symbol)), ',') AS symbols, arg_max(hash, ord) FILTER (hash IS NOT NULL) AS hash FROM p WHERE gone IS NULL OR ord > gone GROUP BY 1, 2",
    "fold_warnings": _REC + "SELECT note_id, 'newer version' AS reason, count(*) AS n FROM rec0 WHERE v > 1 GROUP BY 1 UNION ALL SELECT note_id, 'type changed', count(*) FROM val JOIN ty USING (note_id) WHERE val.type <> ty.type GROUP BY 1",
    "alias_cap": _REC + f"SELECT note_id, array_to_string({_CAP}, ',') AS aliases FROM lists",
    "alias_hidden": _REC + f"SELECT note_id, len(aliases) AS n_aliases, array_to_string(list_sort(list_filter(aliases, lambda q: NOT list_contains({_CAP}, q))), ',') AS hidden FROM lists",
}
_PART = lambda k: SQL[k].removeprefix(_REC)
SQL["fold_full"] = _REC + ", " + ", ".join(f"{k}_ AS ({('WITH ' + _PART(k).removeprefix(', ')) if _PART(k).startswith(', ') else _PART(k)})" for k in ("fold_lww", "fold_status", "fold_incident_replace", "fold_keyed_upsert", "fold_tombstone", "fold_title_demote")) + """,
alv AS (SELECT note_id, value, min(first) AS first FROM (SELECT note_id, value, first.b AS first FROM un UNION ALL SELECT note_id, value, first_event FROM fold_title_demote_) GROUP BY 1, 2),
ord_ AS (SELECT event_id, ts FROM events),
all_ AS (SELECT note_id, list(value ORDER BY ts, event_id, value) AS l FROM alv JOIN ord_ ON event_id = first GROUP BY 1),
an_ AS (SELECT note_id, array_to_string(list_sort(list(concat_ws('|', path, symbols, hash))), ';') AS anchors FROM fold_keyed_upsert_ GROUP BY 1),
in_ AS (SELECT note_id, array_to_string(list_sort(list(DISTINCT value)), ',') AS invariants FROM fold_tombstone_ GROUP BY 1)
SELECT note_id, type, title, summary, head, status, superseded_by, edits, incident, array_to_string(l[greatest(1, len(l) - 11):], ',') AS aliases, anchors, invariants
FROM fold_lww_ JOIN fold_status_ USING (note_id) LEFT JOIN fold_incident_replace_ USING (note_id) LEFT JOIN all_ USING (note_id) LEFT JOIN an_ USING (note_id) LEFT JOIN in_ USING (note_id)"""

RECORDS_SQL = SQL
