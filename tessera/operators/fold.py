"""Event-sourced notes: the log of a note folded into its state.

A record's place is ``ord``, a struct of its time and a canonical key, so a log is a multiset and the fold doesn't
depend on how logs were merged. Nothing here numbers or sorts a note's records: last writers are ``max_by``, unions are
distinct values, a tombstone is the greatest ``ord`` that retracts a key. All of them are partial aggregates, so a
note that owns a third of all records is no hot task.

The type of a note is that of its first valid record and records of another type don't count; every aggregate is kept
per (note, type) until the type is known, which saves a second pass.

Expected columns: note_id, type, op (put, retract, supersede), ord, valid, and the payload: title, summary, body, head,
aliases, incident, invariants, anchor (path, symbols, hash), facet, kind/key of a retract, by, verified. With ``settled`` the records are those of ``own_records`` and types aren't looked up again.

Defined cases: invalid records (see ``validate``) are left out and listed; a note without a valid record has no state;
a null payload field changes nothing; an empty log gives no note.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

NOTE_TYPES = ("file", "flow", "lesson")
RETRACT_KINDS = ("behavior", "feature", "facet", "anchor", "invariant", "alias", "note")


def canonical_json(c: Column | str) -> Column:
    """Canonical text of a JSON record: a variant prints its keys sorted; null where it is no JSON."""
    return F.to_json(F.try_parse_json(c))


def validate(records: DataFrame) -> DataFrame:
    """Adds ``valid`` and ``reason``: version, time, op, type, and what retracts and supersedes need."""
    checks = [
        (F.col("v").isNull(), "missing v"), (F.col("v") > 1, "newer version"), (F.col("ord").isNull(), "missing ts"), (~F.coalesce(F.col("op").isin("put", "retract", "supersede"), F.lit(False)), "unknown op"),
        (~F.coalesce(F.col("type").isin(*NOTE_TYPES), F.lit(False)), "unknown type"),
    ]
    reason = F.lit(None).cast("string")
    for bad, why in reversed(checks):
        reason = F.when(bad, why).otherwise(reason)
    return records.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def applied() -> Column:
    """Whether a valid record of the note's type counts as an edit: bad retracts and supersedes without ``by`` don't."""
    return F.when(F.col("op") == "retract", F.coalesce(F.col("kind").isin(*RETRACT_KINDS), F.lit(False))).when(F.col("op") == "supersede", F.col("by").isNotNull()).otherwise(True)


def _of_type(per_type: DataFrame, types: DataFrame | None) -> DataFrame:
    return per_type if types is None else per_type.join(types, ["note_id", "type"], "left_semi")


def own_records(valid: DataFrame) -> DataFrame:
    """The valid records that are of their note's type, written once: what the parts of one fold read with ``settled``."""
    return cut(valid.join(note_types(valid), ["note_id", "type"], "left_semi"))


def note_types(valid: DataFrame) -> DataFrame:
    """(note_id, type): the type of the first valid record."""
    return valid.groupBy("note_id").agg(F.min_by("type", "ord").alias("type"))


def scalars(valid: DataFrame) -> DataFrame:
    """(note_id, type, title, summary, body, head, edits, updated, status): last writers and counts."""
    put, ok = F.col("op") == "put", applied()
    last = lambda c, cond=put: F.max_by(c, F.when(cond & F.col(c).isNotNull(), F.col("ord")))
    retracted = F.max(F.when((F.col("op") == "retract") & (F.col("kind") == "note"), F.col("ord")))
    superseded = F.max(F.when((F.col("op") == "supersede") & F.col("by").isNotNull(), F.col("ord")))
    per = valid.groupBy("note_id", "type").agg(
        last("title").alias("title"), last("summary").alias("summary"), last("body").alias("body"), last("head").alias("head"), F.sum(ok.cast("bigint")).alias("edits"),
        F.max(F.when(ok, F.col("ord"))).alias("updated"), F.max(F.when(put, F.col("ord"))).alias("p"), retracted.alias("r"), superseded.alias("s"), F.max_by("by", F.when((F.col("op") == "supersede") & F.col("by").isNotNull(), F.col("ord"))).alias("superseded_by"), F.min("ord").alias("first"),
    )
    best = per.groupBy("note_id").agg(F.min_by(F.struct("type", "title", "summary", "body", "head", "edits", "updated", "p", "r", "s", "superseded_by"), "first").alias("b")).select("note_id", "b.*")
    status = F.when(F.col("s").isNotNull() & (F.col("r").isNull() | (F.col("s") > F.col("r"))), "superseded").when(F.col("r").isNotNull() & (F.col("p").isNull() | (F.col("r") > F.col("p"))), "retracted").otherwise("active")
    return best.withColumn("status", status).drop("p", "r", "s")


def union_with_tombstones(valid: DataFrame, values: Column, kind: str, settled: bool = False) -> DataFrame:
    """(note_id, value, first): texts ever put that no later retract of ``kind`` took back; ``first`` is the put that brought them in.

    After a retract a text starts anew, so ``first`` is the first put behind its last retract.
    """
    types = None if settled else note_types(valid)
    puts = valid.where("op = 'put'").select("note_id", "type", "ord", F.explode(values).alias("value")).where("value is not null")
    gone = valid.where((F.col("op") == "retract") & (F.col("kind") == kind)).groupBy("note_id", "type", F.col("key").alias("value")).agg(F.max("ord").alias("gone"))
    alive = puts.join(gone, ["note_id", "type", "value"], "left").where("gone is null or ord > gone")
    return _of_type(alive.groupBy("note_id", "type", "value").agg(F.min("ord").alias("first")), types).select("note_id", "value", "first")


def demoted_titles(valid: DataFrame, settled: bool = False) -> DataFrame:
    """(note_id, value, first): titles that a later one replaced, as aliases. A title put again last isn't demoted by itself, but stays one if it was."""
    types = None if settled else note_types(valid)
    t = valid.where("op = 'put' and title is not null").select("note_id", "type", F.trim("title").alias("value"), "ord").where("value <> ''")
    spans = t.groupBy("note_id", "type", "value").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"))
    ends = t.groupBy("note_id", "type").agg(F.max("ord").alias("last"), F.max_by("value", "ord").alias("title"))
    after = spans.join(ends, ["note_id", "type"])
    # replaced at least once: another title came after its first put
    other = t.select("note_id", "type", F.col("value").alias("v2"), F.col("ord").alias("o2")).groupBy("note_id", "type", "v2").agg(F.max("o2").alias("hi2"))
    by_max = other.groupBy("note_id", "type").agg(F.max(F.struct("hi2", "v2")).alias("m1"))
    second = other.join(by_max, ["note_id", "type"]).where("v2 <> m1.v2").groupBy("note_id", "type").agg(F.max("hi2").alias("hi2"))
    joined = after.join(second, ["note_id", "type"], "left").where("(value <> title) or (hi2 is not null and hi2 > lo)")
    return _of_type(joined, types).select("note_id", "value", F.col("lo").alias("first"))


def incidents(valid: DataFrame, settled: bool = False) -> DataFrame:
    """(note_id, incident): the symptom words of the last put with a summary or body; an empty list replaces too.

    Words that a later retract names are taken out.
    """
    types = None if settled else note_types(valid)
    put = valid.where("op = 'put' and (summary is not null or body is not null)").groupBy("note_id", "type").agg(F.max(F.struct("ord", F.coalesce("incident", F.array().cast("array<string>")).alias("words"))).alias("b"))
    gone = valid.where("op = 'retract' and kind = 'alias' and key is not null").groupBy("note_id", "type", "key").agg(F.max("ord").alias("gone"))
    words = put.select("note_id", "type", F.col("b.ord").alias("ord"), F.explode_outer(F.array_distinct("b.words")).alias("key"))
    left = words.join(gone, ["note_id", "type", "key"], "left").groupBy("note_id", "type").agg(F.array_sort(F.collect_set(F.when(F.col("gone").isNull() | (F.col("ord") > F.col("gone")), F.col("key")))).alias("incident"))
    return _of_type(left, types).select("note_id", "incident")


def anchors(valid: DataFrame, settled: bool = False) -> DataFrame:
    """(note_id, path, symbols, hash): keyed by path; symbols are united, the hash is the last one, a retract starts anew."""
    types = None if settled else note_types(valid)
    puts = valid.where("op = 'put' and anchor.path is not null").select("note_id", "type", "ord", "anchor.*")
    gone = valid.where("op = 'retract' and kind = 'anchor'").groupBy("note_id", "type", F.col("key").alias("path")).agg(F.max("ord").alias("gone"))
    alive = puts.join(gone, ["note_id", "type", "path"], "left").where("gone is null or ord > gone")
    per = alive.groupBy("note_id", "type", "path").agg(F.max_by("hash", F.when(F.col("hash").isNotNull(), F.col("ord"))).alias("hash"))
    sym = alive.select("note_id", "type", "path", F.explode_outer("symbols").alias("s")).groupBy("note_id", "type", "path").agg(F.array_sort(F.collect_set("s")).alias("symbols"))
    return _of_type(per.join(sym, ["note_id", "type", "path"]), types).select("note_id", "path", "symbols", "hash")


def keyed_last(valid: DataFrame, entries: Column, kind: str, settled: bool = False) -> DataFrame:
    """(note_id, key, value): the last value put for a key behind the last retract of it; for behaviours, features and facets.

    ``entries`` is an array of structs (key, value). A null value keeps an earlier one, as a feature put without a role does.
    """
    types = None if settled else note_types(valid)
    puts = valid.where("op = 'put'").select("note_id", "type", "ord", F.explode(entries).alias("e")).select("note_id", "type", "ord", "e.key", "e.value").where("key is not null")
    gone = valid.where((F.col("op") == "retract") & (F.col("kind") == kind)).groupBy("note_id", "type", "key").agg(F.max("ord").alias("gone"))
    alive = puts.join(gone, ["note_id", "type", "key"], "left").where("gone is null or ord > gone")
    per = alive.groupBy("note_id", "type", "key").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("ord"))).alias("value"))
    return _of_type(per, types).select("note_id", "key", "value")


def last_whole(valid: DataFrame, column: str, settled: bool = False) -> DataFrame:
    """(note_id, value): a field that is replaced as a whole (steps, scope), by its last put that has it."""
    types = None if settled else note_types(valid)
    per = valid.where(F.col("op") == "put").where(F.col(column).isNotNull()).groupBy("note_id", "type").agg(F.max_by(column, "ord").alias("value"))
    return _of_type(per, types).select("note_id", "value")


def extra_fields(valid: DataFrame, fields: str = "extra", settled: bool = False) -> DataFrame:
    """(note_id, key, value): unknown fields (a map column), each by its last put."""
    types = None if settled else note_types(valid)
    rows = valid.where("op = 'put'").select("note_id", "type", "ord", F.explode(fields).alias("key", "value"))
    return _of_type(rows.groupBy("note_id", "type", "key").agg(F.max_by("value", "ord").alias("value")), types).select("note_id", "key", "value")


def fold_logs(logs: DataFrame) -> DataFrame:
    """(note_id, note, warnings) of ``note_id, raw`` JSON records: the definition itself, over sorted partitions.

    Spark sorts each log by time and canonical text; a task folds its logs record by record and holds one note's
    state, never its log.
    """

    def run(batches):
        import pandas as pd

        at, state = None, None
        for pdf in batches:
            out = []
            for nid, raw in zip(pdf["note_id"], pdf["raw"], strict=True):
                if nid != at:
                    if at is not None:
                        out.append(state.result())
                    at, state = nid, Fold(nid)
                try:
                    rec = json.loads(raw)
                except (ValueError, TypeError):
                    rec = None
                state.add(rec)
            yield pd.DataFrame(out, columns=["note_id", "note", "warnings"])
        if at is not None:
            yield pd.DataFrame([state.result()], columns=["note_id", "note", "warnings"])

    ts = F.get_json_object("raw", "$.ts")
    return logs.where("note_id is not null").withColumns({"_ts": ts, "_canon": canonical_json("raw")}).repartition("note_id").sortWithinPartitions("note_id", "_ts", "_canon").select("note_id", "raw").mapInPandas(run, "note_id string, note string, warnings array<string>")


def warnings(validated: DataFrame) -> DataFrame:
    """(note_id, reason, n) of the records that don't count, the change of type included."""
    types = note_types(validated.where("valid")).withColumnRenamed("type", "own")
    bad = validated.where("not valid").select("note_id", "reason")
    changed = validated.where("valid").groupBy("note_id", "type").agg(F.count(F.lit(1)).alias("n")).join(types, "note_id").where("type <> own").select("note_id", F.lit("type changed").alias("reason"), "n")
    return bad.groupBy("note_id", "reason").agg(F.count(F.lit(1)).alias("n")).unionByName(changed.groupBy("note_id", "reason").agg(F.sum("n").alias("n")))


def fold_records(note_id: str, records: list[Any]) -> tuple[dict | None, list[str]]:
    """The fold of one note's records: the definition the decomposed aggregates are tested against."""
    order = lambda r: (r.get("ts") if isinstance(r, dict) and isinstance(r.get("ts"), str) else "", json.dumps(r, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
    f = Fold(note_id)
    for rec in sorted(records, key=order):
        f.add(rec)
    return f.finish()


_KNOWN = frozenset("v ts head id type op title identityAliases incidentAliases aliases anchors verified summary character facets behaviors features steps invariants kind body scope target by aliasesVerified".split())


def _texts(x: Any) -> list[str]:
    return [t for t in x if isinstance(t, str)] if isinstance(x, list) else []


class Fold:
    """State of one note while its records come in order."""

    def __init__(self, note_id: str):
        self.note_id, self.note, self.warn = note_id, None, []

    def _problem(self, rec: Any) -> str | None:
        if not isinstance(rec, dict):
            return "not an object"
        if not isinstance(rec.get("v"), int | float) or isinstance(rec.get("v"), bool):
            return "missing v"
        if rec["v"] > 1:
            return "newer version"
        if not isinstance(rec.get("ts"), str):
            return "missing ts"
        if rec.get("op") not in ("put", "retract", "supersede"):
            return "unknown op"
        if isinstance(rec.get("id"), str) and rec["id"] != self.note_id:
            return "other note"
        return None if rec.get("type") in NOTE_TYPES else "unknown type"

    def add(self, rec: Any) -> None:
        if why := self._problem(rec):
            self.warn.append(why)
            return
        if self.note is None:
            self.note = {"id": self.note_id, "type": rec["type"], "title": "", "aliases": [], "incident": [], "anchors": {}, "facets": {}, "behaviors": {}, "features": {}, "steps": [], "invariants": [], "status": "active", "edits": 0, "updated": rec["ts"], "extra": {}}
        note = self.note
        if rec["type"] != note["type"]:
            self.warn.append("type changed")
            return
        if rec["op"] == "put":
            _put(note, rec, _texts, _KNOWN)
        elif rec["op"] == "retract":
            target = rec.get("target")
            kind = target.get("kind") if isinstance(target, dict) else None
            if kind not in RETRACT_KINDS:
                self.warn.append("bad retract")
                return
            _retract(note, kind, target.get("key"))
        else:
            if not isinstance(rec.get("by"), str):
                self.warn.append("supersede without by")
                return
            note["status"], note["superseded_by"] = "superseded", rec["by"]
        note["edits"] += 1
        if rec["op"] == "put" and rec.get("aliasesVerified") is True:
            note["verified_at_edit"] = note["edits"]
        note["updated"] = max(note["updated"], rec["ts"])

    def finish(self) -> tuple[dict | None, list[str]]:
        note = self.note
        if note and not note["title"]:
            note["title"] = next(iter(note["anchors"]), self.note_id) if note["type"] == "file" else self.note_id
        return note, self.warn

    def result(self) -> tuple[str, str | None, list[str]]:
        note, warn = self.finish()
        return self.note_id, None if note is None else json.dumps(note, sort_keys=True, ensure_ascii=False), warn


def _put(note: dict, rec: dict, texts, known: set[str]) -> None:
    if note["status"] == "retracted":
        note["status"] = "active"
    title = rec["title"].strip() if isinstance(rec.get("title"), str) else ""
    if title:
        if note["title"] and note["title"] != title and note["title"] not in note["aliases"]:
            note["aliases"].append(note["title"])
        note["title"] = title
    for a in texts(rec.get("identityAliases")) + texts(rec.get("aliases")):
        if a not in note["aliases"]:
            note["aliases"].append(a)
    if isinstance(rec.get("summary"), str) or isinstance(rec.get("body"), str):
        note["incident"] = texts(rec.get("incidentAliases"))
    for field in ("summary", "body", "head", "kind", "character"):
        if isinstance(rec.get(field), str):
            note[field] = rec[field]
    if isinstance(rec.get("scope"), dict):
        note["scope"] = {"terms": texts(rec["scope"].get("terms")), "globs": texts(rec["scope"].get("globs"))}
    for a in rec.get("anchors") or []:
        if isinstance(a, dict) and isinstance(a.get("path"), str):
            own = note["anchors"].setdefault(a["path"], {"symbols": []})
            own["symbols"] += [s for s in texts(a.get("symbols")) if s not in own["symbols"]]
            own |= {k: a[k] for k in ("hash", "head") if isinstance(a.get(k), str)}
    for f in rec.get("facets") or []:
        if isinstance(f, dict) and isinstance(f.get("symbol"), str) and isinstance(f.get("detail"), str):
            own = note["facets"].setdefault(f["symbol"], {"flows": []})
            own["detail"] = f["detail"]
            own["flows"] += [x for x in texts(f.get("flows")) if x not in own["flows"]]
    for b in rec.get("behaviors") or []:
        if isinstance(b, dict) and isinstance(b.get("concept_id"), str) and isinstance(b.get("detail"), str):
            note["behaviors"][b["concept_id"]] = {"detail": b["detail"], "symbols": texts(b.get("symbols"))}
    for f in rec.get("features") or []:
        if isinstance(f, dict) and isinstance(f.get("concept_id"), str):
            role = f.get("role") if isinstance(f.get("role"), str) else None
            note["features"][f["concept_id"]] = role if role is not None else note["features"].get(f["concept_id"], "")
    if isinstance(rec.get("steps"), list):
        note["steps"] = [s for s in rec["steps"] if isinstance(s, dict) and isinstance(s.get("path"), str) and isinstance(s.get("role"), str)]
    note["invariants"] += [i for i in dict.fromkeys(texts(rec.get("invariants"))) if i not in note["invariants"]]
    note["extra"] |= {k: v for k, v in rec.items() if k not in known}


def _retract(note: dict, kind: str, key: str | None) -> None:
    if kind == "note":
        note["status"] = "retracted"
    elif kind == "alias":
        note["aliases"] = [a for a in note["aliases"] if a != key]
        note["incident"] = [a for a in note["incident"] if a != key]
    elif kind == "invariant":
        note["invariants"] = [i for i in note["invariants"] if i != key]
    else:
        note[{"anchor": "anchors", "facet": "facets", "behavior": "behaviors", "feature": "features"}[kind]].pop(key, None)
