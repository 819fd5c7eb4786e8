"""Properties and brute force of the engine's own operators."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import fixed as K
from tessera.functions import text as X
from tessera.operators import fold as L
from tessera.operators import incremental as I
from tessera.plans import api, find, gs, kb
from tessera.streaming import sessions as S

T = dt.datetime(2025, 1, 1)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


# ---- text ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name, want", [("parseHTTPRequest", ["parse", "http", "request"]), ("user-profile_index.ts", ["user", "profile", "ts"]), ("", []), ("a", []), ("getX", [])])
def test_tokenize(spark, name, want):
    assert one(spark, X.tokenize_name(F.lit(name))) == want


@pytest.mark.parametrize("word, want", [("fires", "fire"), ("boxes", "box"), ("stopping", "stop"), ("queries", "query"), ("class", "class"), ("called", "call"), ("is", "is")])
def test_stem(spark, word, want):
    assert one(spark, X.stem(F.lit(word))) == want


@pytest.mark.parametrize("path, want", [("src/latest.js", False), ("a/foo.test.ts", True), ("x/foo_test.go", True), ("e2e-tests/a.ts", True), ("src/Contest.java", False), ("MyITCase.java", True), ("conftest.py", True), ("TestFoo.java", True), ("integrationtest/A.java", True)])
def test_is_test(spark, path, want):
    assert one(spark, X.is_test_path(F.lit(path))) is want


def test_terms_and_patterns(spark):
    assert X.parse_terms("find [Foo], foo bar-baz a1 'x' 9ab load_x") == ["find", "Foo", "bar-baz", "load_x"]
    assert X.parse_terms("") == []
    for p, s, want in (("/^lo/i", "Load", True), ("/[/", "a[b", False), ("ab|cd", "xCDx", True), ("zz", "x", False)):
        assert one(spark, X.match_predicate(p, F.lit(s))) is want
    ign = ["*.css", "!keep.css", "/lib/*.py", "gen/"]
    for p, want in (("a/b.css", True), ("a/keep.css", False), ("lib/a.py", True), ("x/lib/a.py", False), ("gen/x/y.ts", True), ("generic.ts", False)):
        assert one(spark, X.ignored(F.lit(p), ign)) is want
    words = [f"w{i} a b c d e" for i in range(20)]
    assert one(spark, X.cap_aliases(F.array(*map(F.lit, words)))) == words[-6:]
    assert one(spark, X.cap_aliases(F.array(*[F.lit("x " * 30)] * 6))) == ["x " * 30] * 4
    assert one(spark, X.first_sentence(F.lit("A long first sentence here. Second."), 80)) == "A long first sentence here."
    assert one(spark, X.slugify(F.lit("--Hello, World!  " + "x" * 80))) == ("hello-world-" + "x" * 80)[:60]
    assert one(spark, X.fold_sep(F.lit(None).cast("string"))) is None


# ---- fold ----------------------------------------------------------------------------------------------


def log(r, n):
    out = []
    for i in range(n):
        op = r.choice(["put"] * 4 + ["retract", "retract", "supersede"])
        rec = {"v": r.choice([1, 1, 1, 1, 2]), "ts": f"2025-01-{r.randrange(1, 28):02d}", "type": r.choice(["flow"] * 9 + ["file"]), "op": op, "n": i}
        if op == "put":
            if r.random() < 0.4:
                rec["title"] = f"t{r.randrange(4)}"
            if r.random() < 0.3:
                rec["summary"] = f"s{i}"
                rec["incidentAliases"] = [f"a{r.randrange(6)}" for _ in range(r.randrange(3))]
            if r.random() < 0.5:
                rec["identityAliases"] = [f"a{r.randrange(6)}" for _ in range(2)]
            if r.random() < 0.4:
                rec["anchors"] = [{"path": f"p{r.randrange(3)}", "symbols": [f"y{r.randrange(4)}"], **({"hash": f"h{i}"} if r.random() < 0.5 else {})}]
            if r.random() < 0.3:
                rec["invariants"] = [f"i{r.randrange(3)}"]
        elif op == "retract":
            kind = r.choice(["note", "alias", "anchor", "invariant", "bogus"])
            rec["target"] = {"kind": kind, "key": {"alias": f"a{r.randrange(6)}", "anchor": f"p{r.randrange(3)}", "invariant": f"i{r.randrange(3)}"}.get(kind)}
        elif r.random() < 0.7:
            rec["by"] = f"n{i}"
        out.append(rec)
    return out


def as_rows(logs):
    rows = []
    for nid, recs in logs.items():
        for rec in recs:
            t = rec.get("target") or {}
            a = (rec.get("anchors") or [None])[0]
            rows.append((nid, rec["v"], (rec["ts"], json.dumps(rec, sort_keys=True, separators=(",", ":"))), rec["type"], rec["op"], rec.get("title"), rec.get("summary"), None, None, rec.get("identityAliases"), rec.get("incidentAliases"), rec.get("invariants"), (a["path"], a["symbols"], a.get("hash")) if a else None, t.get("kind"), t.get("key"), rec.get("by")))
    return rows


LOG = "note_id string, v int, ord struct<ts:string,canon:string>, type string, op string, title string, summary string, body string, head string, aliases array<string>, incident array<string>, invariants array<string>, anchor struct<path:string,symbols:array<string>,hash:string>, kind string, key string, by string"


def test_fold_decomposed_equals_definition(spark):
    r = random.Random(11)
    logs = {f"n{i}": log(r, r.randrange(1, 40)) for i in range(60)}
    df = L.validate(spark.createDataFrame(as_rows(logs), LOG)).cache()
    v = df.where("valid")
    scal = {x.note_id: x for x in L.scalars(v).collect()}
    inv: dict = {}
    for x in L.union_with_tombstones(v, F.col("invariants"), "invariant").collect():
        inv.setdefault(x.note_id, set()).add(x.value)
    anc: dict = {}
    for x in L.anchors(v).collect():
        anc.setdefault(x.note_id, {})[x.path] = (sorted(x.symbols), x.hash)
    inc = {x.note_id: x.incident for x in L.incidents(v).collect()}
    for nid, recs in logs.items():
        note, _ = L.fold_records(nid, recs)
        shuffled = recs[:]
        r.shuffle(shuffled)
        assert L.fold_records(nid, shuffled)[0] == note
        if note is None:
            assert nid not in scal
            continue
        s = scal[nid]
        assert (s.type, s.status, s.edits, s.title or nid, s.summary) == (note["type"], note["status"], note["edits"], note["title"] if note["type"] != "file" or s.title else nid, note.get("summary")), nid
        assert inv.get(nid, set()) == set(note["invariants"])
        assert anc.get(nid, {}) == {p: (sorted(a["symbols"]), a.get("hash")) for p, a in note["anchors"].items()}
        assert inc.get(nid, []) == sorted(set(note["incident"]))


def test_fold_logs_streams(spark):
    r = random.Random(12)
    logs = {f"n{i}": log(r, r.randrange(1, 30)) for i in range(20)}
    rows = [(nid, json.dumps(rec)) for nid, recs in logs.items() for rec in recs] + [("n0", "not json"), ("n1", None), ("only", "[]")]
    r.shuffle(rows)
    got = {x.note_id: x.note for x in L.fold_logs(spark.createDataFrame(rows, "note_id string, raw string")).collect()}
    for nid, recs in logs.items():
        want = L.fold_records(nid, recs)[0]
        assert (json.loads(got[nid]) if got[nid] else None) == want
    assert got["only"] is None


def test_fold_keyed_and_whole(spark):
    rows = [("n", "flow", "put", 1, None, None, [("c", "one"), ("d", "x")], ["s1"], {"z": "1"}), ("n", "flow", "retract", 2, "feature", "c", None, None, None), ("n", "flow", "put", 3, None, None, [("c", "two")], None, {"z": "2", "y": "3"}), ("n", "flow", "put", 4, None, None, [("c", None)], ["s2", "s3"], None), ("n", "file", "put", 5, None, None, [("q", "no")], ["no"], {"z": "9"})]
    v = spark.createDataFrame(rows, "note_id string, type string, op string, ord int, kind string, key string, features array<struct<key:string,value:string>>, steps array<string>, extra map<string,string>")
    assert {(r.key, r.value) for r in L.keyed_last(v, F.col("features"), "feature").collect()} == {("c", "two"), ("d", "x")}
    assert L.last_whole(v, "steps").first()["value"] == ["s2", "s3"]
    assert {(r.key, r.value) for r in L.extra_fields(v).collect()} == {("z", "2"), ("y", "3")}


def test_fold_bad_records():
    note, warn = L.fold_records("n", [None, [], {"v": True}, {"v": 1}, {"v": 1, "ts": "1", "op": "x"}, {"v": 1, "ts": "1", "op": "put", "type": "q"}, {"v": 1, "ts": "1", "op": "put", "type": "flow", "id": "other"}])
    assert note is None and len(warn) == 7
    note, _ = L.fold_records("n", [{"v": 1, "ts": "2", "op": "put", "type": "flow", "title": "b", "zz": 1}, {"v": 1, "ts": "1", "op": "put", "type": "flow", "title": "a", "features": [{"concept_id": "c", "role": "r"}], "facets": [{"symbol": "s", "detail": "d", "flows": ["f"]}]}])
    assert note["title"] == "b" and note["aliases"] == ["a"] and note["extra"] == {"zz": 1} and note["features"] == {"c": "r"}


# ---- notebook ------------------------------------------------------------------------------------------


def notebook(spark, n=40):
    notes = [(f"n{i:02d}", ["file", "flow", "lesson"][i % 3], "active", f"mechanism topic{i} common", [f"alias{i}"], f"body about common things rare{i} loadThing{i}") for i in range(n)]
    notes += [("gone", "flow", "active", "vanished subject", [], "x"), ("old", "flow", "superseded", "old topic1", [], "topic1"), ("nul", "flow", "active", None, None, None)]
    anchors = [(f"n{i:02d}", f"src/mod{i}.ts", [f"loadThing{i}"] if i % 2 else [], f"h{i}") for i in range(n)] + [("gone", "src/gone.ts", [], "hg"), (None, "x", None, None)]
    live = [(f"src/mod{i}.ts", f"h{i}" if i % 4 else "other") for i in range(n)] + [("src/new.ts", "hz")]
    nd = spark.createDataFrame(notes, "note_id string, type string, status string, title string, aliases array<string>, body string")
    ad = spark.createDataFrame(anchors, "note_id string, path string, symbols array<string>, hash string")
    ld = spark.createDataFrame(live, "path string, hash string")
    ren = spark.createDataFrame([], "path string, to_path string")
    declared = ad.where("path is not null").groupBy("path").agg(F.flatten(F.collect_list(F.coalesce("symbols", F.array().cast("array<string>")))).alias("symbols"))
    return api.Notebook(nd, ad, ld, ren, declared)


def test_notebook(spark):
    nb = notebook(spark)
    assert nb.search("topic7 mechanism").first()["note_id"] == "n07"
    assert [r.note_id for r in nb.search("vanished").collect()] == ["gone"] and nb.search("vanished").first()["inactive"]
    assert nb.recall("vanished subject").count() == 0
    assert [r.note_id for r in nb.recall("why does loadThing7 fail").collect()] == ["n07"]
    assert nb.recall("please list the common things").count() == 0
    assert nb.recall("look at src/mod9.ts").first()["note_id"] == "n09"
    assert nb.recall("why does loadThing7 fail", seen=["n07"]).count() == 0
    assert {r.note_id for r in nb.lookup("src/mod3.ts").collect()} == {"n03"} and nb.lookup("src/mod3.ts", "nope").count() == 0
    states = {r.path: r.state for r in nb.stamped().collect()}
    assert states["src/mod1.ts"] == "fresh" and states["src/mod4.ts"] == "changed" and states["src/gone.ts"] == "missing"
    assert nb.status_of(["src/none.ts"]).first()["note_id"] is None
    assert nb.repair().where("check = 'file-no-symbols'").count() > 0
    assert kb.implant(nb.recall("why does loadThing7 fail")).first()["implant"]


def test_absence_is_containment(spark):
    texts = spark.createDataFrame([("src/a.ts", "const LedgerClient = 1"), ("src/b.ts", "trim_ledger(x)"), ("lib/c.py", "the ledger, a cache-key"), ("lib/d.go", "cache key; v1.2 ledgers"), ("e.md", "::")], "file_id string, text string")
    asked = spark.createDataFrame([
        ("part", ["ledger"], None), ("again", ["LEDGER", "ledger"], None), ("both", ["ledger", "client"], None), ("dash", ["cache-key"], None), ("dot", ["v1.2"], None), ("no part", ["::"], None), ("short", ["x"], None),
        ("absent", ["ledger", "harbor"], None), ("glob", ["ledger"], ["src/*", "*.{go,rs}"]), ("deep", ["ledger"], ["**/c.??"]), ("other", ["ledger"], ["*.ts/x", "src"]), ("none", [], None),
    ], "note_id string, terms array<string>, globs array<string>")
    three = ["lib/c.py", "lib/d.go", "src/a.ts"]
    want = {
        "part": (4, three), "again": (4, three), "both": (1, ["src/a.ts"]), "dash": (1, ["lib/c.py"]), "dot": (1, ["lib/d.go"]), "no part": (1, ["e.md"]), "short": (1, ["src/b.ts"]),
        "absent": (0, []), "glob": (3, ["lib/d.go", "src/a.ts", "src/b.ts"]), "deep": (1, ["lib/c.py"]), "other": (0, []), "none": (0, []),
    }
    got = kb.absence_stamp(asked, texts).collect()
    assert {r.note_id: (r.n_matches, r.samples) for r in got} == want and all(r.sample == (r.samples or [None])[0] for r in got)


def test_floor_before_the_cap(spark):
    """More hits of the first tier than a page of candidates, nearly all below the floor: the next tier's take their place."""
    rows = [("named", 0, 100.0)] + [(f"low{i:03d}", 0, 1.0) for i in range(90)] + [("next", 1, 60.0), ("last", 2, 50.0)]
    hits = spark.createDataFrame([(*r, False) for r in rows], "note_id string, tier int, score double, convergence boolean")
    assert [(r.note_id, r.place) for r in kb.page(hits, 3, K.HOOK_FLOOR).orderBy("place").collect()] == [("named", 1), ("next", 2), ("last", 3)]
    assert not kb.implant(kb.page(hits, 3, K.HOOK_FLOOR)).first()["implant"]
    assert kb.page(hits.limit(0), 3, K.HOOK_FLOOR).count() == 0


def test_write(spark):
    nb = notebook(spark)
    ok = nb.write({"type": "flow", "title": "quite different words", "identityAliases": ["x"], "steps": [{"path": "a", "role": "r"}]})
    assert ok["status"] == "ok" and ok["note_id"] == "quite-different-words" and not ok["warnings"]
    assert nb.write({"type": "flow", "title": "mechanism topic1"})["status"] == "candidates"
    assert nb.write({"type": "flow", "title": "mechanism topic1"}, new=True)["status"] == "ok"
    assert nb.write({"type": "file", "path": "src/a.ts"})["note_id"].startswith("src-a-ts-")
    assert nb.write({"op": "retract", "type": "flow", "id": "nowhere"})["status"] == "error"
    assert nb.write_batch([{"type": "flow"}, {"type": "file", "path": "b"}, 3])["counts"] == {"error": 2, "ok": 1}


def test_duplicates_and_renames(spark):
    sets = {"a": "pqrst", "b": "pqrsx", "c": "pq", "d": "xyz", "e": "pqrst"}
    notes = spark.createDataFrame([(k, "flow", "active", "", [], "") for k in sets], "note_id string, type string, status string, title string, aliases array<string>, body string")
    anchors = spark.createDataFrame([(k, p, [], None) for k, v in sets.items() for p in v], "note_id string, path string, symbols array<string>, hash string")
    got = {(r.a, r.b): r.jaccard for r in kb.duplicate_flows(notes, anchors).collect()}
    want = {(a, b): round(len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])), 6) for a in sets for b in sets if a < b}
    assert got == {k: v for k, v in want.items() if v >= 0.6}
    live = spark.createDataFrame([("new", "h1"), ("c1", "h2"), ("c2", "h2"), ("kept", "h3")], "path string, hash string")
    gone = spark.createDataFrame([("old", "h1"), ("dup", "h2"), ("edited", "h9")], "path string, hash string")
    assert [tuple(r) for r in kb.unique_renames(gone, live, spark.createDataFrame([("kept",)], "path string")).collect()] == [("old", "new")]


# ---- find and gs ---------------------------------------------------------------------------------------


def test_find_by_hand(spark):
    docs = spark.createDataFrame([("a.ts", "alpha beta\nx\nalpha"), ("b.ts", "ALPHA"), ("c.md", "beta"), (None, "alpha"), ("d.ts", None)], "file_id string, text string")
    files = spark.createDataFrame([("a.ts", "a.ts", 3, 4), ("b.ts", "src/alpha_view/b.ts", 1, 1), ("c.md", "c.md", 1, 1), ("d.ts", "d.ts", 0, 0)], "file_id string, path string, line_count int, token_estimate int")
    sym = spark.createDataFrame([("a.ts#alphaView", "a.ts", "alphaView"), ("d.ts#n", "d.ts", None)], "symbol_id string, file_id string, name string")
    cand = find.candidates(docs, files, sym, ["alpha-view", "beta", "alpha"])
    got = {(r.file_id, r.term): (r.in_name, r.in_path, r.in_body) for r in cand.collect()}
    assert got == {("a.ts", "alpha-view"): (True, False, False), ("b.ts", "alpha-view"): (False, True, False), ("a.ts", "beta"): (False, False, True), ("c.md", "beta"): (False, False, True), ("a.ts", "alpha"): (True, False, True), ("b.ts", "alpha"): (False, True, True)}
    w = find.term_weights(cand, ["alpha-view", "beta", "alpha", "zeta"], 4)
    assert {r.term: r.df for r in w.collect()} == {"alpha-view": 2, "beta": 2, "alpha": 2, "zeta": 0}
    assert [r.file_id for r in find.rank(cand, w).collect()] == ["a.ts", "b.ts", "c.md"]


def test_mask(spark):
    text = 'x = 1\n"""doc\nbeta\n"""\n# c\n  // d\ny'
    mask = lambda t: [(x.text, x.excluded) for x in find.masked_lines(spark.createDataFrame([("f", t)], "file_id string, text string")).first().lines]
    assert [e for _, e in mask(text)] == [False, True, True, True, True, True, False]
    assert mask("") == [("", False)] and mask("a '''b''' c\nd")[1] == ("d", False) and [e for _, e in mask('"""\n\n')] == [True, True, True]
    assert [t for t, e in mask("p\n﷐q\n") if not e] == ["p", "�q", ""]
    long = "\n".join(f"line {i}" if i % 7 else '"""' for i in range(30000))
    parity, want = 0, []
    for line in long.split("\n"):
        want.append(parity % 2 == 1 or '"""' in line)
        parity += line.count('"""')
    assert [e for _, e in mask(long)] == want
    assert find.line_counts(spark.createDataFrame([("f", None), (None, "x"), ("g", text)], "file_id string, text string")).collect()[0][:] == ("g", 7, 5)


def test_imports_follow_the_edge(spark):
    """A file imports a term if the target declares it or has it in its path, whatever the specifier says; dead targets don't count."""
    docs = spark.createDataFrame([("a.ts", "alpha"), ("b.ts", "alpha"), ("c.ts", "alpha")] + [(f"n{i}.ts", "x") for i in range(100)], "file_id string, text string")
    files = spark.createDataFrame([(f, f) for f in ["a.ts", "b.ts", "c.ts", "def.ts"] + [f"n{i}.ts" for i in range(100)]], "file_id string, path string")
    sym = spark.createDataFrame([("def.ts", "makeAlpha")], "file_id string, name string")
    cand = find.candidates(docs, files, sym, ["alpha"])
    edges = spark.createDataFrame([("a.ts", "def.ts", "@/other", 1), ("b.ts", "n1.ts", "./alpha", 1), ("c.ts", "gone/alpha.ts", "x", 1)], "src string, dst string, specifier string, ord int")
    got = {r.file_id: r["class"] for r in find.evidence(cand, find.term_weights(cand, ["alpha"], 104), edges).collect()}
    assert got == {"a.ts": "imports", "b.ts": "mentions", "c.ts": "mentions", "def.ts": "declares"}


def test_regions_and_budget(spark):
    hits = spark.createDataFrame([("f", n) for n in (1, 2, 9, 30)], "file_id string, line int")
    r = gs.regions(hits, spark.createDataFrame([("f", 32)], "file_id string, n_lines int")).orderBy("first").collect()
    assert [(x.first, x.last) for x in r] == [(0, 4), (7, 11), (28, 31)]
    s = spark.createDataFrame([("f", n, 10) for n in range(5)], "file_id string, n int, n_lines int")
    assert [x.take for x in gs.line_budget(s, 25, ["n"]).orderBy("n").collect()] == [10, 10, 5, 0, 0]


# ---- incremental and sessions --------------------------------------------------------------------------


def test_reconcile(spark):
    schema = "path string, mtime_ms double, size_bytes bigint, hash string"
    old = spark.createDataFrame([("same", 1.0, 1, "a"), ("edited", 1.0, 1, "a"), ("touched", 1.0, 1, "a"), ("gone", 1.0, 1, "a"), ("unstamped", None, None, "a"), (None, 1.0, 1, "a")], schema)
    new = spark.createDataFrame([("same", 1.0, 1, "a"), ("edited", 2.0, 2, "b"), ("touched", 3.0, 1, "a"), ("fresh", 1.0, 1, "c"), ("unstamped", 1.0, 1, "a")], schema)
    diff = I.reconcile(old, new)
    assert {r.path: r.change for r in diff.collect()} == {"edited": "stale", "touched": "stale", "gone": "deleted", "fresh": "new", "unstamped": "stale"}
    assert {r.path: r.action for r in I.patch_plan(diff, old, new).collect()} == {"edited": "update", "touched": "refresh", "gone": "delete", "fresh": "insert", "unstamped": "refresh"}
    assert I.patch_limit(10) == 30 and I.patch_limit(1000) == 200


def test_audit_wraps(spark):
    f = spark.createDataFrame([(f"r{i % 3}", f"r{i % 3}/{i:03d}") for i in range(60)], "repo string, file_id string")
    order = sorted(r.file_id for r in f.collect())
    assert sorted(r.file_id for r in I.audit_sample(f, 50, 20).collect()) == sorted(order[50:] + order[:10])
    assert I.audit_sample(f.limit(0), 5).count() == 0


def stops(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        delta = {f"f{r.randrange(12)}": {r.choice(["reads", "edits", "gs"]): 1} for _ in range(r.randrange(3))}
        out.append((f"s{r.randrange(4)}", i, json.dumps(delta), json.dumps(["f1"] if r.random() < 0.2 else []), r.random() < 0.05))
    return out


STOPS = "session string, ord int, delta string, fresh string, drift boolean"


def test_capture_trigger_batch_and_stream(spark, tmp_path):
    rows = stops(5, 300)
    want = []
    state: dict = {}
    for s, _, d, fr, dr in rows:
        got = S.advance(st := state.setdefault(s, S.new_state()), json.loads(d), set(json.loads(fr)), dr)
        if got:
            want.append((s, st["stop"], got["fire"], got["mode"], tuple(got["files"]), got["score"]))
    assert want
    df = spark.createDataFrame(rows, STOPS)
    key = lambda r: (r.session, r.stop, r.fire, r.mode, tuple(r.files), r.score)
    assert sorted(map(key, S.capture_trigger(df).collect())) == sorted(want)
    for n in range(3):
        spark.createDataFrame(rows[n * 100 : n * 100 + 100], STOPS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(STOPS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = S.capture_trigger_stream(src).writeStream.format("memory").queryName("decisions").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(key, spark.table("decisions").collect())) == sorted(want)


def test_debounce_and_seen(spark, tmp_path):
    t = lambda s: T + dt.timedelta(seconds=s)
    rows = [("a", t(0), "x"), ("a", t(0.3), "y"), ("a", t(0.3), "x"), ("a", t(1), "z"), ("b", t(0), "x"), (None, t(0), "q"), ("a", None, "q")]
    df = spark.createDataFrame(rows, "key string, ts timestamp, item string")
    got = sorted((r.key, tuple(r.items), r.n) for r in S.debounce(df, "key", "ts", "item").collect())
    assert got == [("a", ("x", "y"), 3), ("a", ("z",), 1), ("b", ("x",), 1)]
    e = spark.createDataFrame([("k", t(0), 1), ("k", t(80000), 2), ("k", t(160000), 3), ("k", t(260000), 4), ("j", t(5), 5)], "key string, ts timestamp, id int")
    assert sorted(r.id for r in S.first_seen(e, ["key"], "ts", "id").collect()) == [1, 4, 5]
    df.where("key is not null and ts is not null").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = S.first_seen_stream(src, ["key", "item"], "ts").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.key, r.item) for r in spark.table("seen").collect()) == [("a", "x"), ("a", "y"), ("a", "z"), ("b", "x")]
    for n in range(4):  # a sighting a batch, each renews the time to live
        e.where(F.col("id") == n + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in2"))
    src = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in2"))
    q = S.first_seen_stream(src, ["key"], "ts").writeStream.format("memory").queryName("seen2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.id for r in spark.table("seen2").collect()) == [1, 4]


def test_streaks(spark):
    kinds = "find find read search search search other search gs find find find".split()
    df = spark.createDataFrame([("s", n, k) for n, k in enumerate(kinds)], "session string, seq bigint, kind string")
    got = [r.nudge for r in S.streaks(df).orderBy("seq").collect()]
    assert got == [None, "read", None, None, None, "find", None, None, None, None, "read", "checkpoint"]


def test_nudges_and_breaker(spark):
    c = spark.createDataFrame([("s", 1, "gs", "f", False, True), ("s", 2, "gs", "f", False, False), ("s", 3, "gs", "f", False, False), ("s", 4, "gs", "f", False, False), ("s", 5, "search", None, True, False), ("s", 6, "find", None, True, False), ("s", 7, "find", None, True, False)], "session string, seq int, kind string, file string, is_empty boolean, is_menu boolean")
    assert [r.seq for r in S.slice_nudges(c).collect()] == [3] and sorted(r.seq for r in S.empty_nudges(c).collect()) == [5, 6] and [r.seq for r in S.repeat_guesses(c).collect()] == [2]
    p = spark.createDataFrame([("k", n, x) for n, x in enumerate([1, 0, 2, 1, 1, 4, 0])], "keeper string, ord int, n_fixed int")
    assert [r.stopped for r in S.breaker(p).orderBy("ord").collect()] == [False] * 5 + [True] * 2
    assert [S.retry_delay(n) for n in (1, 3, 4)] == [60, 180, None]


def test_redundant_searches(spark):
    """Only what earlier calls met, after a find, with a result; six a session."""
    rows = [("s", 1, "search", ["a"], False), ("s", 2, "search", ["a"], False), ("s", 3, "find", ["a", "b"], False), ("s", 4, "search", ["a", "b"], False), ("s", 5, "search", ["a", "c"], False), ("s", 6, "search", [], False), ("s", 7, "search", ["c", "c"], True), ("s", 8, "search", None, None)]
    rows += [("s", 10 + n, "search", ["c"], None) for n in range(9)] + [("t", 1, "search", ["a"], False)]
    c = spark.createDataFrame(rows, "session string, seq int, kind string, files array<string>, is_empty boolean")
    assert sorted((r.session, r.seq) for r in S.redundant_searches(c).collect()) == [("s", 4)] + [("s", 10 + n) for n in range(5)]
    assert S.redundant_searches(c.limit(0)).count() == 0


def test_bridges_and_links(spark):
    toks = [("a/x.py", "limit_choices_to", 1), ("b/y.py", "limit_choices_to", 1), ("a/x.py", "child_node", 1), ("c/z.py", "child_node", 1), ("a/x.py", "in_text", 2), ("d/w.py", "in_text", 1), ("a/twin.py", "limit_choices_to", 1), ("e/v.py", "two_a", 1), ("f/u.py", "two_a", 1), ("e/v.py", "two_b", 1), ("f/u.py", "two_b", 1)]
    t = spark.createDataFrame(toks, "file_id string, token string, bits int")
    files = t.select("file_id").distinct().withColumns({"is_test_file": F.lit(False), "is_barrel": F.lit(None).cast("boolean")})
    e = spark.createDataFrame([("e/v.py", "f/u.py")], "src string, dst string")
    got = {(r.a, r.b) for r in find.bridges(find.rare_postings(t, files), t, e).collect()}
    assert got == {("a/x.py", "b/y.py"), ("a/twin.py", "b/y.py"), ("a/x.py", "d/w.py")}
    assert find.page_links([("a", "b", 2), ("a", "c", 2), ("b", "c", 3)]) == [("b", "c", 3), ("a", "b", 2)]
    assert len(find.page_links([(f"a{i}", f"b{i}", 2) for i in range(9)])) == 6


def test_flow_references(spark):
    n = spark.createDataFrame([("f1", "flow", "active", "Order  Flow"), ("f2", "flow", "active", "twice"), ("f3", "flow", "active", "Twice"), ("x", "file", "active", "file"), ("old", "flow", "retracted", "gone")], "note_id string, type string, status string, title string")
    refs = spark.createDataFrame([("n", r) for r in ("f1", "order flow", "TWICE", "x", "gone", "nothing")], "note_id string, ref string")
    got = {r.ref: (r.target, r.problem) for r in kb.flow_references(refs, n).collect()}
    assert got == {"f1": ("f1", None), "order flow": ("f1", None), "TWICE": ("TWICE", "ambiguous"), "x": ("x", "not a flow"), "gone": ("gone", "dangling"), "nothing": ("nothing", "dangling")}


def test_wrap_and_buckets(spark):
    assert one(spark, X.wrap_text(F.lit("aa bb ccc dddddddd e"), 5)) == ["aa bb", "ccc", "dddddddd", "e"] and one(spark, X.wrap_text(F.lit(""), 5)) == []
    for s, want in (("./a", "regular"), ("const:Foo", "const:*"), ("convention:django:include", "convention:django:include"), ("partial:a:Bar", "partial:a:*")):
        assert one(spark, X.edge_bucket(F.lit(s))) == want


def test_top_k_of_hot_keys(spark):
    from tessera.session import top_k

    r = random.Random(6)
    rows = [("hot" if i % 3 else f"k{i % 50}", r.randrange(1000), i) for i in range(3000)]
    df = spark.createDataFrame(rows + [(None, 1, -1)], "key string, score int, id int")
    got = sorted((x.key or "", x.place, x.id) for x in top_k(df, ["key"], [F.desc("score"), "id"], 4).collect())
    want = []
    for k in {x[0] for x in rows} | {None}:
        own = sorted((x for x in [*rows, (None, 1, -1)] if x[0] == k), key=lambda x: (-x[1], x[2]))[:4]
        want += [(k or "", n + 1, x[2]) for n, x in enumerate(own)]
    assert got == sorted(want)


def test_queries_have_matching_columns(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(re.fullmatch(r"[a-z0-9_]+", k) for k in e.queries())
    assert "find_rank" in e.queries() and K.JSON_LISTED == 40


# ---- entry points ----------------------------------------------------------------------------------------


def index(spark):
    text = {"r/a.ts": "export function loadAlpha() {\n  return fetchBeta();\n}\n" + "// filler\n" * 90 + "const alpha_key = 'wire_name_x';\n", "r/alphaUse.ts": "import { loadAlpha } from './a';\nloadAlpha();\n", "r/lib/c.py": "def other():\n    alpha = WIRE\n    return 'wire_name_x'\n", "r/doc.md": "alpha is loaded"}
    docs = spark.createDataFrame([(f, t, 1) for f, t in text.items()] + [(None, "alpha", 1)], "file_id string, text string, path int")
    row = lambda f, t: (f, "r", f[2:], None, t.count("\n") + 1, len(t) // 4, False, False, 0.0, None, None, 0.0, len(t), 0, T, T, None, None, [])
    T = None
    files = spark.createDataFrame([row(f, t) for f, t in text.items()], "file_id string, repo string, path string, language string, line_count int, token_estimate int, is_barrel boolean, is_test_file boolean, reexport_ratio double, package_name string, hash string, mtime_ms double, size_bytes bigint, imported_by_count int, indexed_at timestamp, received_at timestamp, deleted_at timestamp, domain_map map<string,int>, exports array<string>")
    sym = spark.createDataFrame([("r/a.ts#loadAlpha", "r/a.ts", "loadAlpha", "function", 1, 3, True, None, [], None, None), ("r/a.ts#fetchBeta", "r/a.ts", "fetchBeta", "function", 50, 52, True, None, [], None, None), ("r/alphaUse.ts#main", "r/alphaUse.ts", "main", "function", 1, 2, True, None, [], None, None)], "symbol_id string, file_id string, name string, kind string, start_line int, end_line int, is_exported boolean, extends_name string, implements array<string>, indexed_at timestamp, deleted_at timestamp")
    calls = spark.createDataFrame([(1, "r/alphaUse.ts#main", "r/a.ts#loadAlpha", "calls", 2), (2, "r/a.ts#loadAlpha", "r/a.ts#fetchBeta", "calls", 2)], "edge_id bigint, src string, dst string, type string, line int")
    edges = spark.createDataFrame([("r/alphaUse.ts", "r/a.ts", "import", "./a", 1)], "src string, dst string, type string, specifier string, ord int")
    return api.CodeIndex(spark, {"documents": docs, "files": files, "symbols": sym, "symbol_edges": calls, "edges": edges})


def test_find_page(spark):
    ix = index(spark)
    notes = spark.createDataFrame([("n1", "file", "active", "alpha", [], "")], "note_id string, type string, status string, title string, aliases array<string>, body string")
    anchors = spark.createDataFrame([("n1", "r/a.ts", [], None)], "note_id string, path string, symbols array<string>, hash string")
    out = ix.find("alpha fetchBeta", notes=api.Notebook(notes, anchors, anchors, anchors, anchors))
    page = {r.file_id: r for r in out["page"].collect()}
    a, b = page["r/a.ts"], page["r/alphaUse.ts"]
    assert (a["class"], a.place, a.note_id, a.declares, a.used_by) == ("code", 1, "n1", ["alpha", "fetchBeta"], ["r/alphaUse.ts"]) and a.symbols == ["loadAlpha [L1-3]", "fetchBeta [L50-52]"]
    assert b.uses == ["r/a.ts"] and b.via == ["alpha"] and page["r/doc.md"]["class"] == "doc" and ix.find("!!")["status"] == "no usable terms"
    assert out["related"].collect() == []  # c.py shares a rare name, but is listed itself
    assert len(out["rank"].collect()) == 4


def test_gs_views(spark):
    ix = index(spark)
    full = ix.gs("./a.ts", match="wire_name")
    assert [r.symbol_id for r in full["symbols"].collect()] and full["symbols"].where("missed").count() == 2 and [r.file_id for r in full["body_refs"].collect()] == ["r/lib/c.py"]
    assert [(r.related, r.place) for r in full["related"].collect()] == [("r/lib/c.py", 1)] and [r.caller_file for r in full["callers"].collect()] == ["r/alphaUse.ts"]
    cut = ix.gs("r/a.ts", symbol="loadAlpha")
    assert [(r.symbol_id, r.take) for r in cut["slices"].collect()] == [("r/a.ts#loadAlpha", 3)] and [r.callee for r in cut["callees"].collect()] == ["r/a.ts#fetchBeta"] and [r.caller for r in cut["callers"].collect()] == ["main"]
    assert cut["regions"].count() == 0
    none = ix.gs("r/a.ts", symbol="alpha_key")
    assert none["slices"].count() == 0 and [(r.first, r.last, r.take) for r in none["regions"].collect()] == [(91, 94, 4)]
    assert ix.gs("nope.ts")["status"] == "not found" and ix.gs("a.ts", view="odd")["status"].startswith("unknown")
