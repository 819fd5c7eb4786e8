"""The engine's entry points: find, gs, consumers, index, and the notebook's verbs over one set of tables."""

from __future__ import annotations

import json
import re
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed as K
from tessera.functions import text as X
from tessera.operators import graph as G
from tessera.operators.fold import NOTE_TYPES
from tessera.plans import find as P
from tessera.plans import gs, kb
from tessera.session import top_k

ID = re.compile(r"[a-z0-9][a-z0-9-]{0,99}")


class CodeIndex:
    """Tables files, symbols, symbol_edges, edges and documents (texts by ``file_id``), as they are stored."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self.t = spark, tables
        self.files, self.symbols = P.live_files(tables["files"]), P.live_symbols(tables["symbols"])

    @cached_property
    def tokens(self) -> DataFrame:
        """Content tokens of all files, read from the texts once per index."""
        return P.content_tokens(self.t["documents"])

    def register(self, prefix: str = "") -> None:
        """Temporary views of the live tables, for queries in SQL."""
        for name, df in {**self.t, "files": self.files, "symbols": self.symbols}.items():
            df.createOrReplaceTempView(prefix + name)

    def find(self, query: str, path: str | None = None, tests: bool = True, limit: int = K.JSON_LISTED, notes: Notebook | None = None) -> dict[str, Any]:
        """Ranked files of a query, its page and the page's sections; ``path`` and ``tests`` are plain filters, ``notes`` adds the best note of each file."""
        terms = X.parse_terms(query)
        if not terms:
            return {"status": "no usable terms", "terms": []}
        files = self.files
        if path:
            files = files.where(F.col("path").contains(path))
        if not tests:
            files = files.where(~F.coalesce("is_test_file", X.is_test_path("path")))
        cand = P.candidates(self.t["documents"], files, P.symbol_names(self.t["symbols"]), terms)
        n = files.count()  # one number
        w = P.term_weights(cand, terms, n)
        ev = P.evidence(cand, w, self.t["edges"])
        conv = P.convergence(self.t["documents"], w, terms, n)
        top = P.listed(cand, w, files, ev).where("class = 'code'")
        noted = kb.note_map(notes.notes, notes.anchors, terms) if notes else None
        return {
            "status": "ok", "terms": terms, "rank": P.rank(cand, w, limit), "weights": w, "evidence": ev, "classes": P.partition(cand, files, ev), "relations": P.relations(cand, self.t["edges"]),
            "preview": P.clusters(conv).where(F.col("peak_rank") <= K.PREVIEW_CLUSTERS), "targets": P.import_targets(cand, self.t["edges"]), "page": P.page(cand, w, files, self.symbols, self.t["edges"], terms, noted),
            "related": P.bridged(top.where(F.col("place") <= K.DETAILED), top, self.tokens, files, self.t["edges"], terms),
        }

    def gs(self, path: str, view: str | None = None, match: str | None = None, symbol: str | None = None) -> dict[str, Any]:
        """One file: its symbols, imports, importers and callers, or the slices of a symbol."""
        name, known = gs.view_of(view)
        hit = gs.find_path(self.files, [path]).first()
        if hit is None:
            return {"status": "not found", "path": path}
        fid = hit["file_id"]
        own = self.symbols.where(F.col("file_id") == fid)
        out: dict[str, Any] = {"status": "ok" if known else "unknown view, all of it shown", "file_id": fid}
        edges = self.t["symbol_edges"]
        if symbol:
            return out | self._slices(fid, own, symbol)
        if name in ("full", "symbols"):
            shown = gs.default_symbols_plain(own)
            kept = gs.match_symbols(shown, X.match_predicate(match, "name")) if match else shown.join(gs.top_symbols(own, edges).select("symbol_id", "n_caller_files", "n_symbols"), "symbol_id")
            out["symbols"] = gs.display_names(kept)
        if name in ("full", "imports"):
            out["imports"] = G.adjacency(self.t["edges"].where(F.col("src") == fid)).join(self.files.select(F.col("file_id").alias("dst")), "dst", "left_semi")
        if name in ("full", "importers"):
            out["importers"] = G.importers(self.t["edges"].where(F.col("dst") == fid), self.files)
        if name in ("full", "callers"):
            mine = self.symbols.where(F.col("is_exported") & (F.col("file_id") == fid)).select(F.col("symbol_id").alias("dst"))
            out["callers"] = G.callers(edges.join(mine, "dst", "left_semi"), self.symbols)
        if name == "full":
            linked = P.bridges(P.rare_postings(self.tokens, self.files), self.tokens, self.t["edges"])
            out["related"] = P.related_files(linked.where((F.col("a") == fid) | (F.col("b") == fid))).where(F.col("file_id") == fid)
            if match:
                importers = G.adjacency(self.t["edges"].where(F.col("dst") == fid)).select(F.col("src").alias("file_id"))
                shown = importers.unionByName(self.spark.createDataFrame([(fid,)], "file_id string"))
                out["body_refs"] = gs.body_refs(self.tokens, self.files, X.match_predicate(match, "token"), shown)
        return out

    def _slices(self, fid: str, own: DataFrame, symbol: str) -> dict[str, Any]:
        """The bodies of the named symbols within their line budget, their callers and callees; where no symbol has the name, the
        methods around lines that hold the words (within a smaller budget), and the regions of such lines."""
        picked = gs.pick_symbols(own, [s for s in re.split(r"[,|]", symbol) if s.strip()]).select("symbol_id").distinct()
        sized = lambda df: df.withColumn("n_lines", F.col("end_line") - F.col("start_line") + 1)
        body = sized(own.join(picked, "symbol_id", "left_semi"))
        out: dict[str, Any] = {"slices": gs.line_budget(top_k(body, ["file_id"], ["start_line", "symbol_id"], K.SLICE_SYMBOLS), K.SLICE_LINES, ["start_line", "symbol_id"])}
        edges = self.t["symbol_edges"]
        exported = picked.join(self.symbols.where("is_exported"), "symbol_id", "left_semi").select(F.col("symbol_id").alias("dst"))
        out["callers"] = G.callers(edges.join(exported, "dst", "left_semi"), self.symbols)
        out["callees"] = G.callees(edges.join(picked.select(F.col("symbol_id").alias("src")), "src", "left_semi"), self.symbols)
        text = self.t["documents"].where(F.col("file_id") == fid)
        lines, terms = P.lines(text), X.parse_terms(symbol) or [symbol]
        hit = P.matching(F.col("text"), terms)
        methods = gs.method_matches(lines, own, hit).where(F.col("place") <= K.MATCH_SYMBOLS)
        out["methods"] = gs.line_budget(sized(methods.join(own.select("symbol_id", "start_line", "end_line"), "symbol_id")), K.MATCH_LINES, ["place"])
        lengths = text.where("text is not null").select("file_id", X.line_count("text").alias("n_lines"))
        around = gs.regions(lines.where(F.size(hit) > 0).select("file_id", "line"), lengths).where(F.col("region") <= K.REGIONS)
        region = around.withColumn("n_lines", F.col("last") - F.col("first") + 1)
        out["regions"] = gs.line_budget(region.join(picked.limit(1).select(F.lit(fid).alias("file_id")), "file_id", "left_anti"), K.REGION_LINES, ["region"])
        return out

    def consumers(self, paths: list[str]) -> DataFrame:
        """(path, consumer) of each path; an unindexed one keeps a null."""
        asked = self.spark.createDataFrame([(p,) for p in paths], "path string")
        e = G.adjacency(self.t["edges"]).select(F.col("dst").alias("path"), F.col("src").alias("consumer"))
        return asked.join(e, "path", "left")


class Notebook:
    """Notes and anchors, live hashes and declared symbols."""

    def __init__(self, notes: DataFrame, anchors: DataFrame, live: DataFrame, renames: DataFrame, declared: DataFrame):
        self.notes, self.anchors, self.live, self.renames, self.declared = notes, anchors, live, renames, declared

    def stamped(self) -> DataFrame:
        return kb.stamp(self.anchors.where("path is not null"), self.live, self.renames)

    def search(self, query: str, cap: int = 8, seen: list[str] = ()) -> DataFrame:
        """Tool mode: BM25 with tiers; an empty result where no term is left."""
        terms = X.parse_terms(query, K.PROSE_STOP_WORDS)
        ch = kb.channels(self.notes, self.anchors)
        return kb.page(kb.tiers(kb.bm25(ch, terms or [query]), self.notes, self.stamped()), cap, None, list(seen))

    def recall(self, prompt: str, cap: int = 3, seen: list[str] = ()) -> DataFrame:
        """Hook mode: gates per note, then the page gate, the floor, the cap and what the session has seen."""
        terms = X.parse_terms(prompt, K.PROSE_STOP_WORDS)
        ch = kb.channels(self.notes, self.anchors)
        hits = kb.tiers(kb.hook(ch, self.anchors.where("path is not null"), self.declared, prompt, terms or ["\x00"]), self.notes, self.stamped()).where("not inactive")
        first = kb.page(hits, 1).first()
        if kb.suppressed(first.asDict() if first else None, self.notes.count()):
            return kb.page(hits.limit(0), cap)
        return kb.page(hits, cap, K.HOOK_FLOOR, list(seen))

    def lookup(self, path: str, symbol: str | None = None) -> DataFrame:
        return kb.lookup(self.notes, self.anchors, path, symbol)

    def status(self) -> DataFrame:
        return kb.totals(self.notes, self.stamped())

    def repair(self) -> DataFrame:
        return kb.repairs(self.notes, self.anchors)

    def status_of(self, paths: list[str]) -> DataFrame:
        """(path, note_id, state) of each path; one without a note keeps nulls."""
        asked = self.notes.sparkSession.createDataFrame([(p,) for p in paths], "path string")
        return asked.join(self.stamped().select("path", "note_id", "state"), "path", "left")

    def candidates(self, spec: dict[str, Any]) -> DataFrame:
        """Notes a new one may repeat: of one address for anchored lessons, else the five best of its type that are active."""
        anchors = [a for a in spec.get("anchors") or [] if isinstance(a, dict) and a.get("path")]
        if spec.get("type") == "lesson" and anchors:
            cond = F.lit(False)
            for a in anchors:
                same = F.col("path") == a["path"]
                if a.get("symbols"):
                    same = same & F.arrays_overlap("symbols", F.array(*map(F.lit, a["symbols"])))
                cond = cond | same
            return self.anchors.where(cond).select("note_id").distinct()
        active = self.notes.where((F.col("status") == "active") & (F.col("type") == spec["type"]))
        words = " ".join([spec.get("title") or "", *(spec.get("identityAliases") or [])])
        terms = X.parse_terms(words, K.PROSE_STOP_WORDS)
        if not terms:
            return active.select("note_id").limit(0)
        return kb.bm25(kb.channels(active, self.anchors), terms).orderBy(F.desc("score"), "note_id").limit(5).select("note_id")

    def write(self, spec: dict[str, Any], new: bool = False, into: str | None = None) -> dict[str, Any]:
        """Validate a spec and give the record to append, the candidates it may repeat, or an error; nothing is written here."""
        problem = check_spec(spec)
        if problem:
            return {"status": "error", "message": problem}
        op, typ, character = spec.get("op", "put"), spec.get("type"), spec.get("character")
        if typ in ("file-hub", "file-single"):
            typ, character = "file", typ.removeprefix("file-")
        nid = into or spec.get("id")
        if nid:
            known = self.notes.where(F.col("note_id") == nid).select("type").first()
            if known is None and (into or op != "put"):
                return {"status": "error", "message": f"no note {nid}"}
            typ = typ or (known["type"] if known else None)
            if known and typ and known["type"] != typ:
                return {"status": "error", "message": f"{nid} is of type {known['type']}"}
        if typ not in NOTE_TYPES:
            return {"status": "error", "message": "type needed"}
        if op == "put" and typ == "file":
            if not spec.get("path"):
                return {"status": "error", "message": "a file note needs a path"}
            derived = self.notes.sparkSession.range(1).select(X.file_note_id(F.lit(spec["path"])).alias("i")).first()["i"]
            if nid and nid != derived:
                return {"status": "error", "message": f"ids of file notes come from the path: {derived}"}
            nid = derived
        elif op == "put" and not nid:
            if not (spec.get("title") or "").strip():
                return {"status": "error", "message": "a title is needed"}
            if not new:
                found = [r["note_id"] for r in self.candidates({**spec, "type": typ}).collect()]  # five at most, or those of one address
                if found:
                    return {"status": "candidates", "candidates": found}
            nid = self._coin(spec["title"])
        record = {k: v for k, v in spec.items() if k not in ("id", "path")} | {"op": op, "type": typ, "id": nid}
        if character:
            record["character"] = character
        if typ == "file" and op == "put" and not any(isinstance(a, dict) and a.get("path") == spec["path"] for a in record.get("anchors") or []):
            record["anchors"] = [*(record.get("anchors") or []), {"path": spec["path"], "symbols": [f["symbol"] for f in spec.get("facets") or []]}]
        return {"status": "ok", "note_id": nid, "record": json.dumps(record, sort_keys=True), "warnings": missing_fields(spec)}

    def _coin(self, title: str) -> str:
        base = self.notes.sparkSession.range(1).select(X.slugify(F.lit(title)).alias("s")).first()["s"] or "note"
        taken = {r["note_id"] for r in self.notes.where(F.col("note_id").rlike(f"^{base}(-[0-9]+)?$")).select("note_id").collect()}  # the copies of one title
        n = 2
        while (nid := base if base not in taken else f"{base}-{n}") in taken:
            n += 1
        return nid

    def write_batch(self, specs: list[dict[str, Any]]) -> dict[str, Any]:
        """Each spec by itself: one that fails leaves the others alone; counts per outcome."""
        results = []
        for s in specs:
            try:
                results.append(self.write(s))
            except Exception as e:  # a spec of any shape may come in
                results.append({"status": "error", "message": str(e)[:200]})
        counts: dict[str, int] = {}
        for r in results:
            counts[r["status"]] = counts.get(r["status"], 0) + 1
        return {"results": results, "counts": counts}


def check_spec(spec: Any) -> str | None:
    """What is wrong with a spec's shape, or None."""
    if not isinstance(spec, dict):
        return "a spec is an object"
    op = spec.get("op", "put")
    if op not in ("put", "retract", "supersede"):
        return f"unknown op {op!r}"
    typ, character = spec.get("type"), spec.get("character")
    if typ in ("file-hub", "file-single"):
        if character and character != typ.removeprefix("file-"):
            return "type and character disagree"
    elif character is not None and typ != "file":
        return "only file notes have a character"
    if character not in (None, "hub", "single"):
        return "a character is hub or single"
    if spec.get("facets") is not None:
        if typ not in ("file", "file-hub", "file-single"):
            return "only file notes have facets"
        if not isinstance(spec["facets"], list) or not spec["facets"] or not all(isinstance(f, dict) and str(f.get("symbol") or "").strip() and str(f.get("detail") or "").strip() for f in spec["facets"]):
            return "each facet needs symbol and detail"
    if spec.get("id") is not None and not ID.fullmatch(str(spec["id"])):
        return "invalid id"
    return None


def missing_fields(spec: dict[str, Any]) -> list[str]:
    """Fields whose lack makes a note hard to find."""
    typ = spec.get("type", "")
    out = []
    if typ != "lesson" and not [a for a in spec.get("identityAliases") or [] if a]:
        out.append("identityAliases")
    if typ.startswith("file") and not any(a.get("symbols") for a in spec.get("anchors") or []) and not spec.get("facets"):
        out.append("anchors[].symbols")
    if typ == "lesson" and not [t for t in (spec.get("scope") or {}).get("terms", []) if t]:
        out.append("scope.terms")
    if typ == "flow" and not spec.get("steps"):
        out.append("steps")
    return out


def flow_evidence(spec: dict[str, Any], evidence: DataFrame) -> tuple[int, int]:
    """(steps whose path the session read, steps)."""
    paths = [s["path"] for s in spec.get("steps") or [] if isinstance(s, dict) and s.get("path")]
    n = evidence.where("reads + edits > 0").where(F.col("path").isin(*paths)).select("path").distinct().count() if paths else 0
    return n, len(set(paths))
