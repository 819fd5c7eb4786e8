"""Notebook: notes with anchors, searched, stamped, looked up, linted and repaired.

A note is ``note_id, type, title, aliases, body, status`` with ``anchors(note_id, path, symbols, hash)``. A search explodes
notes by the terms of one query, so its rows are notes times a handful of terms; document frequencies are one row a term.

Defined cases: no usable term finds nothing (unless the prompt names an anchored path); null titles and bodies are
empty; a note without anchors can't be inactive; ties rank by note id; an empty notebook gives empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import fixed as K
from tessera.functions import text as X
from tessera.session import cut, top_k

ONE = lambda: Window.partitionBy(F.lit(1))  # noqa: E731  windows over a page or over a query's terms only


def channels(notes: DataFrame, anchors: DataFrame) -> DataFrame:
    """note_id with its three channels in lower case, the raw name, and their weighted length."""
    a = anchors.where("path is not null").groupBy("note_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "path", F.array_join("symbols", " ")))), " ").alias("anchor_raw"))
    n = notes.join(a, "note_id", "left")
    name = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "))
    groups = F.concat(F.array(F.coalesce("title", F.lit(""))), F.coalesce("aliases", F.array().cast("array<string>")))
    c = n.select("note_id", "type", "status", groups.alias("groups"), name.alias("name_raw"), F.lower(name).alias("name"), F.lower(F.coalesce("anchor_raw", F.lit(""))).alias("anchor"), F.lower(F.coalesce("body", F.lit(""))).alias("body"))
    words = lambda x: F.size(F.filter(F.split(x, r"\s+", -1), lambda w: w != ""))
    return c.withColumn("n_name", F.greatest(F.lit(1), words("name"))).withColumn("length", K.CHANNELS["name"] * words("name") + K.CHANNELS["anchor"] * words("anchor") + K.CHANNELS["body"] * words("body"))


def _terms(terms: list[str]) -> Column:
    return F.array(*[F.struct(F.lit(t).alias("raw"), F.lit(t.lower()).alias("low")) for t in terms])


#: What a note has of a term: where it meets it, whether a word of its name is it, how often per channel.
_HIT = "in_name in_anchor in_body word n_names n_anchors n_bodies".split()


def note_hits(ch: DataFrame, terms: list[str]) -> DataFrame:
    """(note_id, groups, n_name, length, hits), a row a note, written once: the terms of the query that the note has, with flags and counts.

    Terms meet the channels inside the note's row, so no text leaves it, and statistics and scores read the same few columns.
    """
    c = ch.select("note_id", "groups", "name_raw", "name", "anchor", "body", "n_name", "length", X.squash("name").alias("sq_name"), X.squash("anchor").alias("sq_anchor"))
    code = F.array(*[F.struct(F.lit(t).alias("raw"), F.lit(t.lower()).alias("low"), X.squash(F.lit(t.lower())).alias("sq")) for t in terms])

    def hit(t: Column) -> Column:
        n = [X.count_plain(F.col(x), t["low"]) for x in ("name", "anchor", "body")]
        # squashed texts count once where the plain ones don't meet
        either = [F.when(n[0] > 0, n[0]).when(F.col("sq_name").contains(t["sq"]), 1.0).otherwise(0.0), F.when(n[1] > 0, n[1]).when(F.col("sq_anchor").contains(t["sq"]), 1.0).otherwise(0.0), n[2]]
        return F.struct(t["raw"].alias("term"), *[(x > 0).alias(k) for x, k in zip(either, _HIT[:3], strict=True)], X.word_hit("name_raw", t["raw"]).alias("word"), *[x.alias(k) for x, k in zip(either, _HIT[4:], strict=True)])

    kept = F.filter(F.transform(code, hit), lambda h: h["in_name"] | h["in_anchor"] | h["in_body"] | F.coalesce(h["word"], F.lit(False)))
    return cut(c.select("note_id", "groups", "n_name", "length", kept.alias("hits")))


def _exploded(hits: DataFrame) -> DataFrame:
    return hits.select("note_id", "groups", "n_name", "length", F.explode("hits").alias("h")).select("note_id", "groups", "n_name", "length", "h.*")


def _stats(hits: DataFrame, terms: list[str]) -> DataFrame:
    p = _exploded(hits).where("in_name or in_anchor or in_body").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    t = hits.sparkSession.createDataFrame([(x,) for x in terms], "term string")
    all_ = hits.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.lit(1.0), F.avg("length")).alias("avg_len"), F.greatest(F.lit(1.0), F.avg("n_name")).alias("avg_name")).first()  # three numbers
    return t.join(p, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"), F.lit(all_["n"]).alias("n"), F.lit(all_["avg_len"] or 1.0).alias("avg_len"), F.lit(all_["avg_name"] or 1.0).alias("avg_name"))


def stats(ch: DataFrame, terms: list[str]) -> DataFrame:
    """(term, df, n, avg_len, avg_name): one row a term."""
    return _stats(note_hits(ch, terms), terms)


def bm25(ch: DataFrame, terms: list[str]) -> DataFrame:
    """(note_id, score, covered): tool mode, term frequencies over weighted channels, saturated and normalised by length."""
    hits = note_hits(ch, terms)
    p = _exploded(hits).where("in_name or in_anchor or in_body").join(F.broadcast(_stats(hits, terms)), "term")  # stats: a row per term
    tf = K.CHANNELS["name"] * F.col("n_names") + K.CHANNELS["anchor"] * F.col("n_anchors") + K.CHANNELS["body"] * F.col("n_bodies")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("tf") * (K.BM25_K1 + 1)) / (F.col("tf") + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * F.col("length") / F.col("avg_len")))
    return p.withColumn("tf", tf).withColumn("part", part).groupBy("note_id").agg(F.round(F.sum("part"), 6).alias("score"), F.count(F.lit(1)).alias("covered"))


def symbol_files(anchor_symbols: DataFrame, terms: list[str]) -> DataFrame:
    """(path, term): files whose declared symbols have the term: as a part if it is code, as a whole word if it is plain."""
    code = [t for t in terms if any(c.isdigit() or c in "_-" for c in t) or any(c.isupper() for c in t[1:])]
    s = anchor_symbols.select("path", F.explode("symbols").alias("symbol"))
    hits = F.filter(_terms(terms), lambda t: F.when(t["raw"].isin(*code), F.lower("symbol").contains(t["low"])).otherwise(F.array_contains(X.symbol_tokens("symbol"), t["low"])) if code else F.array_contains(X.symbol_tokens("symbol"), t["low"]))
    return s.select("path", F.explode(F.transform(hits, lambda t: t["raw"])).alias("term")).distinct()


def anchor_lane(anchor_symbols: DataFrame, terms: list[str]) -> DataFrame:
    """(path, term): anchored paths that contain a term, or declare a symbol that does."""
    any_symbol = lambda t: F.exists(F.coalesce("symbols", F.array().cast("array<string>")), lambda s: F.lower(s).contains(t["low"]))
    hits = F.filter(_terms(terms), lambda t: F.lower("path").contains(t["low"]) | any_symbol(t))
    return anchor_symbols.select("path", F.explode(F.transform(hits, lambda t: t["raw"])).alias("term")).distinct()


def hook(ch: DataFrame, anchors: DataFrame, anchor_symbols: DataFrame, prompt: str, terms: list[str]) -> DataFrame:
    """(note_id, score, strong_terms, rare, convergence, carriers): hook mode with its gates per note.

    A term counts only if it is in a minority of notes and fits its shape; a note needs a strong channel, two
    carriers unless one is hard evidence, and, if all carriers are in names only, two of them in one authored string.
    A prompt that names an anchored path overrides the gates.
    """
    hits = note_hits(ch, terms)
    conv = symbol_files(anchor_symbols, terms).join(anchors.select("note_id", "path").distinct(), "path").select("note_id", "term").distinct().withColumn("converged", F.lit(True))
    p = _exploded(hits).join(F.broadcast(_stats(hits, terms)), "term").join(conv, ["note_id", "term"], "left").withColumn("converged", F.coalesce("converged", F.lit(False)))
    code, word = X.is_code_shaped("term"), F.col("word")
    p = p.withColumn("in_name", F.col("in_name") | (~F.col("in_anchor") & ~F.col("in_body") & ~code & word))
    p = p.where("in_name or in_anchor or in_body").where((F.col("df") == 1) | (F.col("df") * 2 <= F.col("n"))).where(F.when(code, F.col("in_name") | F.col("in_anchor")).otherwise(word))
    rare = F.col("df") <= F.ceil(F.col("n") / K.RARITY_DIVISOR)
    part = (F.when(F.col("in_name"), K.CHANNELS["name"] / F.greatest(F.lit(1.0), F.col("n_name") / F.col("avg_name"))).otherwise(0.0) + F.when(F.col("in_anchor"), K.CHANNELS["anchor"]).otherwise(0) + F.when(F.col("in_body"), K.CHANNELS["body"]).otherwise(0)) * F.log(1 + F.col("n") / (1 + F.col("df")))
    strong = F.col("in_name") | F.col("in_anchor")
    name_only = F.col("in_name") & ~F.col("in_anchor") & ~F.col("in_body") & ~F.col("converged")
    g = p.groupBy("note_id").agg(
        F.sum(part).alias("boost"), F.sum(strong.cast("bigint")).alias("strong_terms"), F.max(rare).alias("rare"), F.max("converged").alias("convergence"), F.max((F.col("converged") & rare) | code).alias("hard"), F.count(F.lit(1)).alias("carriers"), F.min(name_only).alias("name_only"), F.collect_set(F.when(F.col("in_name"), F.col("term"))).alias("name_terms"), F.first("groups").alias("groups"),
    )
    squashed = "".join(c for c in prompt.lower() if c not in "-_/." and not c.isspace())
    named = anchors.where((F.length(X.squash("path")) >= K.PATH_MIN) & F.lit(squashed).contains(X.squash("path"))).select("note_id").distinct().withColumn("named", F.lit(True))
    anchored = anchors.select("note_id").distinct().withColumn("anchored", F.lit(True))
    g = g.join(named, "note_id", "full").join(anchored, "note_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    num = lambda c: F.coalesce(F.col(c), F.lit(0))
    none = F.array().cast("array<string>")
    matched = F.coalesce("name_terms", none)
    density = F.coalesce(F.array_max(F.transform(F.coalesce("groups", none), lambda g: F.size(F.filter(matched, lambda t: X.word_hit(g, t))))), F.lit(0))
    keep = flag("named") | ((num("strong_terms") > 0) & (flag("hard") | (num("carriers") >= K.MIN_CARRIERS)) & ~(flag("anchored") & flag("name_only") & (density < K.NAME_DENSITY)))
    return g.where(keep).select("note_id", F.round(num("boost") + F.when(flag("named"), K.PATH_BOOST).otherwise(0), 6).alias("score"), F.greatest(num("strong_terms"), flag("named").cast("bigint")).alias("strong_terms"), (flag("rare") | flag("named")).alias("rare"), flag("convergence").alias("convergence"), (num("carriers") + flag("named").cast("bigint")).alias("carriers"))


def tiers(hits: DataFrame, notes: DataFrame, stamped: DataFrame) -> DataFrame:
    """Adds ``tier, inactive``: active 0, withdrawn 1, all anchored files gone 2 (lessons exempt)."""
    gone = stamped.groupBy("note_id").agg(F.min((F.col("state") == "missing").cast("int")).alias("gone"))
    h = hits.join(notes.select("note_id", "type", "status"), "note_id").join(gone, "note_id", "left")
    inactive = (F.col("type") != "lesson") & (F.coalesce("gone", F.lit(0)) == 1)
    return h.withColumn("inactive", inactive).withColumn("tier", F.when(inactive, 2).when(F.col("status") != "active", 1).otherwise(0)).drop("gone")


def page(tiered: DataFrame, cap: int, floor: float | None = None, seen: list[str] = ()) -> DataFrame:
    """The first ``cap`` hits by tier, score and id, those below ``floor`` of the first left out before the cap; what the session has
    seen is taken off after the cap, so the page shrinks. ``place`` is the place before that."""
    if floor:
        first = tiered.agg(F.min_by("score", F.struct("tier", -F.col("score"), "note_id")).alias("best"))  # one row
        tiered = tiered.crossJoin(F.broadcast(first)).where(F.col("score") >= floor * F.col("best")).drop("best")
    top = tiered.orderBy("tier", F.desc("score"), "note_id").limit(cap)
    kept = top.withColumn("place", F.row_number().over(ONE().orderBy("tier", F.desc("score"), "note_id")).cast("bigint"))
    return kept.where(~F.col("note_id").isin(*seen)) if seen else kept


def omitted(tiered: DataFrame, cap: int, floor: float | None = None) -> DataFrame:
    """(n_omitted): one row, how many hits the cap alone keeps off a page: behind it, but not below the floor of results."""
    first = tiered.agg(F.min_by("score", F.struct("tier", -F.col("score"), "note_id")).alias("best"))  # one row
    left = tiered.crossJoin(F.broadcast(first)).where(F.col("score") >= F.lit(floor or 0.0) * F.col("best"))
    shown = left.orderBy("tier", F.desc("score"), "note_id").limit(cap).agg(F.sum((F.col("score") >= K.RESULT_FLOOR * F.col("best")).cast("bigint")).alias("shown"))
    all_ = left.agg(F.sum((F.col("score") >= K.RESULT_FLOOR * F.col("best")).cast("bigint")).alias("n"))
    return all_.crossJoin(F.broadcast(shown)).select((F.coalesce("n", F.lit(0)) - F.coalesce("shown", F.lit(0))).alias("n_omitted"))  # one row each


def suppressed(first: dict | None, n_notes: int) -> bool:
    """Page gate of hook mode: the best hit is neither rare nor converged and has fewer than four strong terms."""
    return bool(first) and n_notes >= K.RARITY_MIN_NOTES and not first["rare"] and not first["convergence"] and first["strong_terms"] < K.CONVERGE_MIN


def implant(paged: DataFrame) -> DataFrame:
    """Whether the first hit of a page is shown whole: it converged, is alone, or leads by 1.8."""
    nxt = F.lead("score").over(ONE().orderBy("place"))
    return paged.withColumn("next", nxt).where("place = 1").select("note_id", (F.col("convergence") | F.col("next").isNull() | (F.col("score") >= K.IMPLANT_RATIO * F.col("next"))).alias("implant"))


# ---- freshness ---------------------------------------------------------------------------------------


def stamp(anchors: DataFrame, live: DataFrame, renames: DataFrame) -> DataFrame:
    """(note_id, path, state, moved_to): fresh, changed, missing, unverified or moved, by the live hashes and the renames."""
    h = live.select("path", F.col("hash").alias("live"))
    r = renames.select("path", "to_path").join(live.select(F.col("path").alias("to_path"), F.col("hash").alias("to_hash")), "to_path")
    a = anchors.join(h, "path", "left").join(r, "path", "left")
    real = F.col("hash").isNotNull() & (F.col("hash") != "missing")
    moved = F.col("live").isNull() & real & F.coalesce(F.col("to_hash") == F.col("hash"), F.lit(False))
    state = F.when(moved, "moved").when(F.col("live").isNull(), "missing").when(F.col("hash").isNull(), "unverified").when(F.col("hash") == "missing", "changed").when(F.col("live") == F.col("hash"), "fresh").otherwise("changed")
    return a.select("note_id", "path", state.alias("state"), F.when(moved, F.col("to_path")).alias("moved_to"))


def unique_renames(gone: DataFrame, live: DataFrame, before: DataFrame) -> DataFrame:
    """(path, to_path): a vanished path to the one live file with its bytes that wasn't there before; copies and ties don't count."""
    fresh = live.join(before.select("path").distinct(), "path", "left_anti")
    one = fresh.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("to_path")).where("n = 1")
    alone = gone.groupBy("hash").agg(F.count(F.lit(1)).alias("m")).where("m = 1").select("hash")
    return gone.join(alone, "hash", "left_semi").join(one, "hash").select("path", "to_path")


STATE_RANK = {"missing": 4, "changed": 3, "moved": 2, "unverified": 1, "fresh": 0}


def rollup(stamped: DataFrame) -> DataFrame:
    """(note_id, worst, n_anchors): the worst state of a note's anchors."""
    rank = F.create_map(*[F.lit(x) for kv in STATE_RANK.items() for x in kv])
    return stamped.groupBy("note_id").agg(F.max_by("state", rank[F.col("state")]).alias("worst"), F.count(F.lit(1)).alias("n_anchors"))


# ---- lookup, lint, repair ------------------------------------------------------------------------------


def lookup(notes: DataFrame, anchors: DataFrame, path: str, symbol: str | None = None) -> DataFrame:
    """(note_id, via): active notes filed at a path: the file's own note, flows and lessons that anchor it.

    With a symbol, an anchor that declares symbols must declare it; one that declares none can't be ruled out.
    """
    at = anchors.where(F.regexp_replace("path", r"^\./", "") == path.removeprefix("./"))
    if symbol:
        at = at.where((F.size(F.coalesce("symbols", F.array().cast("array<string>"))) == 0) | F.array_contains("symbols", symbol))
    return notes.where("status = 'active'").join(at.select("note_id").distinct(), "note_id").select("note_id", F.when(F.col("type") == "file", "file-note").when(F.col("type") == "flow", "anchor").otherwise("lesson").alias("via"))


def note_map(notes: DataFrame, anchors: DataFrame, terms: list[str]) -> DataFrame:
    """(path, note_id, hits): the best active note of every path: most query terms in its name, then file before flow before lesson, then id."""
    name = X.fold_sep(F.lower(F.concat_ws(" ", "title", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "))))
    hits = sum((name.contains(t.lower().replace("-", "").replace("_", "")).cast("int") for t in terms), F.lit(0))
    rank = F.when(F.col("type") == "file", 0).when(F.col("type") == "flow", 1).otherwise(2)
    n = notes.where("status = 'active'").select("note_id", hits.alias("hits"), rank.alias("rank"))
    best = anchors.where("path is not null").select("note_id", "path").distinct().join(n, "note_id").groupBy("path").agg(F.min(F.struct((-F.col("hits")).alias("h"), "rank", "note_id")).alias("b"))
    return best.select("path", F.col("b.note_id").alias("note_id"), (-F.col("b.h")).cast("bigint").alias("hits"))


def flow_references(refs: DataFrame, notes: DataFrame) -> DataFrame:
    """(note_id, ref, target, problem) of ``refs(note_id, ref)``: the id of an active note, else the one active flow whose
    title it is but for case and blanks; what is neither stays as written, with the problem named."""
    active = notes.where("status = 'active'")
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    ids = active.select(F.col("note_id").alias("ref"), F.col("type").alias("id_type"))
    titles = active.where("type = 'flow'").groupBy(norm(F.col("title")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("note_id").alias("by_title"))
    r = refs.withColumn("key", norm(F.col("ref"))).join(ids, "ref", "left").join(titles, "key", "left")
    known, one = F.col("id_type").isNotNull(), F.coalesce(F.col("n") == 1, F.lit(False))
    problem = F.when(known & (F.col("id_type") != "flow"), "not a flow").when(known | one, None).when(F.col("n") > 1, "ambiguous").otherwise("dangling")
    return r.select("note_id", "ref", F.when(~known & one, F.col("by_title")).otherwise(F.col("ref")).alias("target"), problem.alias("problem"))


def wikilinks(notes: DataFrame) -> DataFrame:
    """(src, dst): links ``[[id]]`` of bodies to other notes that exist."""
    raw = notes.select(F.col("note_id").alias("src"), F.explode(F.regexp_extract_all("body", F.lit(r"\[\[([a-z0-9-]+)\]\]"), F.lit(1))).alias("dst")).distinct()
    return raw.where("src <> dst").join(notes.select(F.col("note_id").alias("dst")), "dst", "left_semi").select("src", "dst")


def duplicate_flows(notes: DataFrame, anchors: DataFrame, least: float = K.DUPLICATE_JACCARD) -> DataFrame:
    """(a, b, jaccard): active flows of two anchors or more that share most of them.

    Pairs come from shared paths. Two sets with a Jaccard of ``least`` share at least one of the rarest paths of each: of
    a set of n, the ceil(n * (1 - least)) + 1 rarest in one global order, so only those are joined (prefix filter) and
    a path that many flows anchor makes no pairs unless all their paths are as common.
    """
    flows = notes.where("status = 'active' and type = 'flow'").select("note_id")
    s = anchors.where("path is not null").select("note_id", "path").distinct().join(flows, "note_id", "left_semi")
    freq = s.groupBy("path").agg(F.count(F.lit(1)).alias("df"))
    sets = s.join(freq, "path").groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("df", "path"))).alias("p")).where("size(p) >= 2")
    keep = F.least(F.size("p"), F.size("p") - F.ceil(F.lit(least) * F.size("p")).cast("int") + 1)
    pre = sets.select("note_id", F.explode(F.slice("p", F.lit(1), keep)).alias("x")).select("note_id", F.col("x.path").alias("path"))
    cand = pre.withColumnRenamed("note_id", "a").join(pre.withColumnRenamed("note_id", "b"), "path").where("a < b").select("a", "b").distinct()
    full = sets.select("note_id", F.transform("p", lambda x: x["path"]).alias("paths"))
    j = cand.join(full.select(F.col("note_id").alias("a"), F.col("paths").alias("pa")), "a").join(full.select(F.col("note_id").alias("b"), F.col("paths").alias("pb")), "b")
    return j.select("a", "b", F.round(F.size(F.array_intersect("pa", "pb")) / F.size(F.array_union("pa", "pb")), 6).alias("jaccard")).where(F.col("jaccard") >= least)


def references(notes: DataFrame) -> DataFrame:
    """(note_id): notes that another note's text links to, or that a feature or facet names (columns ``features``, ``flows`` where given)."""
    linked = wikilinks(notes).select(F.col("dst").alias("note_id"))
    for c in ("features", "flows"):
        if c in notes.columns:
            linked = linked.unionByName(notes.select(F.explode(c).alias("note_id")))
    return linked.distinct()


def lint(notes: DataFrame, anchors: DataFrame, stamped: DataFrame, ignore: list[str], absence: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """(check, note_id, detail): dead anchors, duplicate flows, orphans, ignored anchors and stale absences of active notes, and
    records that don't count (``warnings(note_id, reason)``) of any note."""
    active = cut(notes.where("status = 'active'").select("note_id", "type"))
    own = cut(anchors.where("path is not null").select("note_id", "path").distinct().join(active.select("note_id"), "note_id", "left_semi"))
    row = lambda df, check, detail: df.select(F.lit(check).alias("check"), "note_id", detail.alias("detail"))
    dead = row(stamped.where("state = 'missing'").join(active.select("note_id"), "note_id", "left_semi"), "dead-anchor", F.col("path")).distinct()
    dup = row(duplicate_flows(active.withColumn("status", F.lit("active")), own).withColumnRenamed("a", "note_id"), "duplicate-flows", F.col("b"))
    orphan = row(active.where("type <> 'file'").join(references(notes), "note_id", "left_anti"), "orphan", F.lit(""))
    skip = row(own.where(X.ignored("path", ignore)), "ignored-anchor", F.col("path"))
    stale = row(absence.where("n_matches > 0").join(active.select("note_id"), "note_id", "left_semi"), "absence-stale", F.col("n_matches").cast("string"))
    out = dead.unionByName(dup).unionByName(orphan).unionByName(skip).unionByName(stale)
    return out if warnings is None else out.unionByName(row(warnings, "malformed", F.col("reason")))


def repairs(notes: DataFrame, anchors: DataFrame) -> DataFrame:
    """(check, note_id, detail): what makes an active note hard to find; ``detail`` lists the steps without an anchor.

    ``notes`` may have ``scope_terms`` (lessons) and ``steps``, paths in order (flows); without them no note has any.
    """
    none = F.array().cast("array<string>")
    of = lambda c: F.filter(F.coalesce(F.col(c), none), lambda x: x.isNotNull() & (x != "")) if c in notes.columns else none
    sym = anchors.groupBy("note_id").agg(F.max((F.size(F.filter(F.coalesce("symbols", none), lambda x: x != "")) > 0).cast("int")).alias("s"), F.collect_set("path").alias("paths"))
    n = notes.where("status = 'active'").select("note_id", "type", of("aliases").alias("aliases"), of("scope_terms").alias("terms"), of("steps").alias("steps")).join(sym, "note_id", "left")
    n = n.withColumn("loose", F.array_sort(F.array_except("steps", F.coalesce("paths", none))))
    is_ = lambda *t: F.col("type").isin(*t)
    checks = [
        (is_("file", "flow") & (F.size("aliases") == 0), "missing-identity-aliases"), (is_("lesson") & (F.size("terms") == 0), "missing-scope-terms"), (is_("file") & (F.coalesce("s", F.lit(0)) == 0), "file-no-symbols"),
        (is_("flow") & (F.size("steps") == 0), "flow-no-steps"), (is_("flow") & (F.size("loose") > 0), "flow-steps-unanchored"),
    ]
    named = F.array(*[F.when(bad, F.lit(check)) for bad, check in checks])
    return n.select(F.explode(F.filter(named, lambda c: c.isNotNull())).alias("check"), "note_id", "loose").select("check", "note_id", F.when(F.col("check") == "flow-steps-unanchored", F.array_join("loose", ",")).otherwise("").alias("detail"))


def symbol_backfill(notes: DataFrame, anchors: DataFrame, declared: DataFrame, cap: int = K.BACKFILL_SYMBOLS) -> DataFrame:
    """(note_id, path, symbols): active file notes whose anchor has no symbols get the first fifteen that the file declares."""
    bare = anchors.where((F.size(F.coalesce("symbols", F.array().cast("array<string>"))) == 0) & F.col("path").isNotNull()).select("note_id", "path").distinct()
    first = declared.groupBy("path").agg(F.slice(F.array_sort(F.collect_list(F.struct("start_line", "name"))), 1, cap).alias("s"))
    return bare.join(notes.where("status = 'active' and type = 'file'").select("note_id"), "note_id", "left_semi").join(first, "path").select("note_id", "path", F.transform("s", lambda x: x["name"]).alias("symbols"))


_WORD = re.compile("[a-z0-9_]+")


def _searches(batches: Iterator[pa.RecordBatch], sets: list[tuple[list[str], list[str]]]) -> Iterator[pa.RecordBatch]:
    """(search, file_id) of every text that contains all terms of a search, in one pass: a term's longest part of word
    characters lies inside one of the text's words, and what each word contains is worked out once per worker."""
    by_term: dict[str, list[int]] = {}  # searches by their longest term
    for n, (terms, _) in enumerate(sets):
        by_term.setdefault(max(terms, key=len), []).append(n)
    by_part: dict[str, list[str]] = {}
    for term in {t for terms, _ in sets for t in terms}:
        by_part.setdefault(max(_WORD.findall(term), key=len, default=""), []).append(term)
    bare = by_part.pop("", [])
    globs = [[re.compile(X.glob_regex(g)) for g in gs] for _, gs in sets]
    lengths = sorted({len(p) for p in by_part})
    known: dict[str, tuple[str, ...]] = {}

    def parts(word: str) -> tuple[str, ...]:
        if len(word) > min(64, len(by_part)):
            return tuple(p for p in by_part if p in word)
        if word not in known:
            if len(known) > 1_000_000:
                known.clear()
            known[word] = tuple({p for n in lengths for at in range(len(word) - n + 1) if (p := word[at : at + n]) in by_part})
        return known[word]

    for batch in batches:
        found, files = [], []
        for file_id, path, text in zip(*(batch.column(c).to_pylist() for c in ("file_id", "path", "text")), strict=True):
            inside = {p for w in set(_WORD.findall(text)) for p in parts(w)}
            hits = {t for p in inside for t in by_part[p] if t == p or t in text} | {t for t in bare if t in text}
            for n in (n for t in hits for n in by_term.get(t, ())):
                if hits.issuperset(sets[n][0]) and (not globs[n] or any(g.fullmatch(path or "") for g in globs[n])):
                    found.append(n)
                    files.append(file_id)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(files, pa.string())], names=["search", "file_id"])


def absence_stamp(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """(note_id, n_matches, sample, samples): how many texts contain all of a note's terms, with the least and the least three.

    Containment is that of texts, in lower case. ``asked(note_id, terms)`` may have ``globs``: with some, only files whose
    ``path`` (the file id where ``texts`` has none) fits one of them count. Each distinct search, not each note, is sent to
    the one pass over the texts, which move nowhere. A note without terms matches nothing.
    """
    clean = lambda c: F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))))
    globs = clean(F.col("globs")) if "globs" in asked.columns else F.array().cast("array<string>")
    notes = asked.select("note_id", F.array_sort(F.array_distinct(F.transform(clean(F.col("terms")), F.lower))).alias("terms"), globs.alias("globs"))
    sets = [(list(r["terms"]), list(r["globs"])) for r in notes.where("size(terms) > 0").select("terms", "globs").distinct().collect()]  # a row per distinct search
    numbers = asked.sparkSession.createDataFrame([(n, *x) for n, x in enumerate(sets)], "search int, terms array<string>, globs array<string>")
    path = F.col("path") if "path" in texts.columns else F.col("file_id")
    read = texts.where("file_id is not null and text is not null").select("file_id", path.alias("path"), F.lower("text").alias("text"))
    fits = cut(read.mapInArrow(partial(_searches, sets=sets), "search int, file_id string").distinct())
    counts = fits.groupBy("search").agg(F.count(F.lit(1)).alias("n_matches"))
    least = top_k(fits, ["search"], ["file_id"], 3).groupBy("search").agg(F.array_sort(F.collect_list("file_id")).alias("samples"))
    found = numbers.join(counts.join(least, "search"), "search").select("terms", "globs", "n_matches", "samples")
    stamped = notes.join(found, ["terms", "globs"], "left")
    return stamped.select("note_id", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.get("samples", F.lit(0)).alias("sample"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def absence_verdict(stamp_terms: Column, note_terms: Column, n_matches: Column) -> Column:
    """unverified unless the stamp was made for the same terms in any order; else holds or stale."""
    low = lambda c: F.array_sort(F.transform(c, lambda t: F.lower(t)))
    return F.when(stamp_terms.isNull() | (low(stamp_terms) != low(note_terms)), "unverified").when(n_matches == 0, "holds").otherwise("stale")


def totals(notes: DataFrame, stamped: DataFrame) -> DataFrame:
    """Notes by type and status, with those that have an anchor not fresh."""
    worst = rollup(stamped)
    flagged = F.coalesce(F.col("worst").isin("missing", "changed"), F.lit(False)).cast("bigint")
    return notes.join(worst, "note_id", "left").groupBy("type", "status").agg(F.count(F.lit(1)).alias("n_notes"), F.sum(flagged).alias("n_flagged"))


def paged(df: DataFrame, order: list, offset: int, limit: int) -> tuple[DataFrame, int, int | None]:
    """(page, remaining, next offset) of an ordered worklist."""
    n = df.count()
    rest = max(0, n - offset - limit)
    return df.orderBy(*order).offset(offset).limit(limit), rest, (offset + limit if rest else None)
