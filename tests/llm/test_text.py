"""Operators on text: brute force, round trips and the hard cases of each."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import encoding, handwritten, mojibake, packing, syntax, terms

DOCS = "doc_id bigint, text string, file_id string, n_tokens string, ids int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, f, "clash", 1) for i, t, f in rows], DOCS)


# ---- encoding and packing ------------------------------------------------------------------------------


def corpus(seed=1, n=120):
    r = random.Random(seed)
    lines = [f"line {i} of prose, naïve — ½ 日本語 {r.random()}" for i in range(40)]
    out = []
    for i in range(n):
        out.append((i, "\n".join(r.choice(lines) for _ in range(r.randrange(0, 60))) + r.choice(["", "\n", "\n\n  ", " \t\n x"]), None))
    long = "".join(r.choice("ab c\n") for _ in range(60000))
    return out + [(1000, None, None), (1001, "", None), (1002, " \n\n ", None), (1003, "<|endoftext|> x", None), (1004, long, None), (1005, "a" * 50000, None), (1006, out[5][1], None), (1006, out[5][1], None), (None, "no id", None), (1007, "\n".join(lines) * 30, None)]


def test_encoding_is_exact(spark):
    rows = corpus()
    enc = encoding.encoder().encode_ordinary
    got = [(r.doc_id, tuple(r.ids)) for r in encoding.encode_corpus(docs(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(((i, tuple(enc(t)) if t else ()) for i, t, _ in rows), key=repr)


def test_encoding_empty(spark):
    assert encoding.encode_corpus(docs(spark, [])).count() == 0
    assert [r.ids for r in encoding.encode_corpus(docs(spark, [(1, None, None)])).collect()] == [[]]


@pytest.mark.parametrize("most", [7, 50, 16384])
def test_chunks_join(monkeypatch, most):
    monkeypatch.setattr(encoding, "MAX_CHARS", most)
    enc = encoding.encoder().encode_ordinary
    for _, t, _ in corpus(2, 40):
        t = (t or "")[:4000]
        parts = encoding.chunks(t)
        assert "".join(parts) == t
        assert encoding.join_ids(parts, [enc(p) for p in parts], enc) == enc(t)


def test_chunks_are_content_defined():
    """A passage in one line gives the same chunks whatever stands before it."""
    r = random.Random(7)
    passage = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(400))
    a, b = (set(encoding.chunks(head + passage)) for head in ("first ", "another begin of some length, here: " * 3))
    assert len(a & b) > 0.7 * len(a) > 5


def test_repair_reuses_ids():
    """Only the text around a join is encoded anew; ids away from it are those that were given."""
    enc = encoding.encoder().encode_ordinary
    left, right = "some words before the cut and a brok", "en word then many words after the cut"
    calls = []

    def spy(text):
        calls.append(text)
        return enc(text)

    assert encoding.join_ids([left, right], [enc(left), enc(right)], spy) == enc(left + right) and calls == [" broken"]
    calls.clear()
    parts = ["a" * 50, "b" * 50, "c d"]  # no anchor at all until the last part
    assert encoding.join_ids(parts, [enc(p) for p in parts], spy) == enc("".join(parts))


@pytest.mark.parametrize("copies", [3, 70])
def test_hot_chunks_are_spread(spark, monkeypatch, copies):
    monkeypatch.setattr(encoding, "HOT", 20)
    licence = " ".join(f"word{i} of a licence" for i in range(200))
    rows = [(i, f"{i} {licence} {i * 7}", None) for i in range(copies)]
    enc = encoding.encoder().encode_ordinary
    assert {r.doc_id: r.ids for r in encoding.encode_corpus(docs(spark, rows)).collect()} == {i: enc(t) for i, t, _ in rows}


def test_packing(spark):
    rows = corpus(3)[:-4] + [(1007, "word " * 9000, None)]
    budgets = spark.createDataFrame([(1, "s", 64), (2, "m", 700), (3, "none", 0), (4, "null", None)], "budget_id int, budget_name string, capacity_tokens int")
    enc = encoding.encoder().encode_ordinary
    size = {i: len(enc(t)) if t else 0 for i, t, _ in rows}
    got = packing.windows(docs(spark, rows), budgets).collect()
    assert {r.budget_id for r in got} == {1, 2}
    for b, cap in ((1, 64), (2, 700)):
        own = [r for r in got if r.budget_id == b]
        room: dict = {}
        for r in own:
            room[r.window_id] = room.get(r.window_id, 0) + r.n_tokens
        assert max(room.values()) <= cap and sum(room.values()) / (len(room) * cap) > 0.85
        for i, n in size.items():
            mine = sorted((r.start_token, r.n_tokens) for r in own if r.doc_id == i)
            assert sum(x for _, x in mine) == n and mine and mine[0][0] == 0
            assert all(a + x == b2 for (a, x), (b2, _) in zip(mine, mine[1:], strict=False))
            assert n > cap or len(mine) == 1
    assert packing.windows(docs(spark, []), budgets).count() == 0
    assert packing.windows(docs(spark, rows[:3]), budgets.limit(0)).count() == 0


def test_differencing():
    r = random.Random(4)
    for _ in range(60):
        s = [r.randrange(1, 100) for _ in range(r.randrange(1, 40))]
        k = r.randrange(1, 9)
        w = packing.difference(s, k)
        assert sorted(i for x in w for i in x) == list(range(len(s))) and len(w) <= k
        sums = [sum(s[i] for i in x) for x in w]
        assert max(sums) <= sum(s) / k + max(s)
        cap = max(s) + r.randrange(50)
        p = packing.pack(s, cap)
        assert max(sum(s[i] for i in x) for x in p) <= cap and sorted(i for x in p for i in x) == list(range(len(s)))
    assert packing.pack([], 5) == [] and packing.pack([5, 5], 5) in ([[0], [1]], [[1], [0]])


def test_tiny_items_fill_as_well():
    """Items of one or two tokens are combined first, so a block of them is as full as any other and no slower."""
    for sizes, cap in (([1] * (8192 * 48), 8192), ([1, 2] * 40000, 4096), ([1] * 5000 + [700] * 50, 1024), ([1] * 10, 512), ([3] * 1000, 3)):
        w = packing.pack(sizes, cap)
        assert sorted(i for x in w for i in x) == list(range(len(sizes))) and max(sum(sizes[i] for i in x) for x in w) <= cap
        least = max(-(-sum(sizes) // cap), sum(2 * s > cap for s in sizes))  # two items of more than half never share a window
        assert len(w) <= least + 1, (len(w), least)


# ---- terms ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("burst, route", [(1024, 50000), (4, 20), (2, 3)])
def test_terms_brute_force(spark, monkeypatch, burst, route):
    monkeypatch.setattr(terms, "ROUTE_TERMS", route)
    r = random.Random(5)
    records = []
    for i in range(400):
        ts = [r.choice(["hot", "", None, "a" * r.randrange(1, 30), f"t{int(r.paretovariate(0.6)) % 300}", "é日" + str(r.randrange(5))]) for _ in range(r.randrange(0, 8))]
        records.append((r.choice(["x", "y"]), ts, [r.choice([None, 0, 1, 3]) for _ in ts], "clash", i))
    df = spark.createDataFrame(records, "field string, terms array<string>, counts array<bigint>, term string, n_records int").repartition(5)
    occ: dict = {}
    rec: dict = {}
    having: dict = {}
    for f, ts, ns, *_ in records:
        for t in {t for t in ts if t}:
            rec[f, t] = rec.get((f, t), 0) + 1
        for t, n in zip(ts, ns, strict=True):
            if t:
                occ[f, t] = occ.get((f, t), 0) + (n or 0)
        having[f] = having.get(f, 0) + any(ts)
    got = {(x.field, x.term): (x.n_occurrences, x.n_records, x.mark) for x in terms.marked_terms(df).collect()}
    mark = lambda f, n: "rare" if n == 1 else "common" if n > having[f] * terms.COMMON else None
    assert got == {k: (occ[k], rec[k], mark(k[0], rec[k])) for k in rec}
    trie = terms.BurstTrie(burst)
    for (_, t), n in occ.items():
        trie.add(t, n, 1)
    flat: dict = {}
    for p, entries in trie.containers():
        assert len(entries) <= burst + 1
        for t, o, n in entries:
            assert t.startswith(p) and t not in flat
            flat[t] = (o, n)
    assert set(flat) == {t for _, t in occ}


def test_terms_counted_by_uneven_tasks(spark):
    """A task that bursts a heavy prefix and others that don't: one row a term, with the sum."""
    many = [f"get{i:05d}" for i in range(50_200)]
    few = ["get00007", "get", "g", "getter", "other", "get50199"]
    rows = [[("f", many, [1] * len(many))], [("f", few, [2] * len(few))], [("f", few[:3], [3] * 3), ("f", few[2:], [1] * 4)]]
    df = spark.createDataFrame(spark.sparkContext.parallelize([r for p in rows for r in p], 4), "field string, terms array<string>, counts array<bigint>")
    want = {t: [1, 1] for t in many}
    for part in rows[1:]:
        for _, ts, ns in part:
            for t, n in zip(ts, ns, strict=True):
                o = want.setdefault(t, [0, 0])
                want[t] = [o[0] + n, o[1] + 1]
    got = [(r.term, [r.n_occurrences, r.n_records]) for r in terms.count_terms(df).collect()]
    assert len(got) == len(want)
    assert dict(got) == want


def test_terms_index(spark):
    files = spark.createDataFrame([], "file_id string, indexed_at timestamp, received_at timestamp, domain_map map<string, struct<filename:int,path:int,symbol:int>>, exports array<string>")
    symbols = spark.createDataFrame([("a", "n"), ("a", "n"), ("b", None), (None, "q"), ("c", "n")], "symbol_id string, name string")
    got = {(r.field, r.term): r.n_records for r in terms.count_terms(terms.index_records(files, symbols)).collect()}
    assert got == {("name", "n"): 2}


# ---- garbled text --------------------------------------------------------------------------------------

CLEAN = ["Don’t call it — naïve café, “quoted” 5 µs ±3 °C ©", "São necessárias ATENÇÃO NÃO Âge à côté déjà où", "Если размер буфера ограничен — ждём", "設定が空の場合、既定値を使います。", "├── src\n│   └── a", "emoji 👩‍💻 🚀", "łąka źdźbło", "plain ascii & more", "Reports show `Ã©` where `é` was typed", "`&#8212;` and `â€™` and `�` are drawn", "﻿bom", "«é» ’à", ""]


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250"])
def test_garbled_round_trip(codec):
    good = "Don’t call it — naïve café, “quoted” 5 µs ±3"
    bad = good.encode().decode(codec, "replace" if codec == "x" else "strict") if codec not in ("cp1252", "cp1250") else "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in good.encode())
    damaged, restored, way = mojibake.examine("intro\n" + bad)
    assert damaged and way
    assert restored == "intro\n" + good


def test_garbled_twice_partly_escaped_lowered():
    once = "naïve — yes".encode().decode("cp1252")
    twice = once.encode("utf-8").decode("latin-1")
    assert mojibake.examine(twice)[1] == "naïve — yes"
    assert mojibake.examine("fine ’ here and " + once)[1] == "fine ’ here and naïve — yes"
    escaped = "".join(c if c < "\x80" else f"&#{ord(c)};" for c in once)
    assert mojibake.examine(escaped)[:2] == (True, "naïve — yes")
    assert mojibake.examine("the path â€” naã¯ve and â±3".lower())[1] == "the path — naïve and ±3"
    assert mojibake.examine("By �507 the probe")[0] and mojibake.examine("a\x81b")[0] and mojibake.examine("donât go")[0]


def test_single_byte_encodings_taken_for_one_another():
    good = "Размер буфера ограничен, остальное отбрасывается; берём не всё"
    for wrong, right in (("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp1252", "cp1251"), ("cp866", "cp1251")):
        bad = good.encode(right).decode(wrong, "replace" if wrong == "x" else "strict")
        assert mojibake.examine("see x.py: " + bad)[:2] == (True, "see x.py: " + good), (wrong, right)
    for text in ("ОШИБКА в БУФЕРЕ", "ПРОВЕРКА", "żółć łąść", "ÄÖÜ ÀÉÈ"):
        assert mojibake.examine(text)[:2] == (False, text)


def test_quotations_of_any_length():
    for text in ("`Ã© stands for é in cp1252 output`", "Output was `naÃ¯ve and cafÃ©`, see above", "- `Ã©`"):
        assert mojibake.examine(text)[:2] == (False, text)
    assert mojibake.examine("const s = `naÃ¯ve and cafÃ© ${x}`;")[:2] == (True, "const s = `naïve and café ${x}`;")
    assert mojibake.examine("return `Menü and cafÃ© too`;")[0] and mojibake.examine("f(`cafÃ© and more`)")[0]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_stays(text):
    assert mojibake.examine(text)[:2] == (False, text)


def test_garbled_table(spark):
    rows = [(1, None, None), (2, "", None), (3, "cafÃ©", None), (3, "cafÃ©", None), (None, "cafÃ©", None), (4, "x" * 200000 + " cafÃ©", None), (5, "ok", None)]
    got = [r.doc_id for r in mojibake.damaged(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([3, 3, None, 4], key=str)
    assert mojibake.damaged(docs(spark, [])).count() == 0


# ---- hand-written --------------------------------------------------------------------------------------

HAND = "import { a } from './b';\n\nexport function load(x) {\n  // nothing generated here, vendors are people\n  return x.map((y) => y + 1);\n}\n"


@pytest.mark.parametrize(
    "path, text, want",
    [
        ("src/a.ts", HAND, []), ("src/a.ts", "// Code generated by tool v1. DO NOT EDIT.\n" + HAND, ["generated"]), ("src/a.ts", "// Was generated once, rewritten since; edit freely.\n" + HAND, []), ("src/a.py", "# TODO: do not edit the table while a release runs\nx = 1\n", []),
        ("a.py", 'def f():\n    banner = "generated by hand; DO NOT EDIT"\n', []), ("a.go", "// <auto-generated> tool: x </auto-generated>\npackage a\n", ["generated"]), ("src/lib.js", "/* lib 2.1.0 - Copyright (c) the lib authors. Released under the BSD license. */\n" + HAND, ["vendored"]),
        ("src/a.js", "// Copyright (c) the ledger team. Internal use.\n" + HAND, []), ("src/b.js", "!function(e,t){e.ax=function(u,n){for(var i=0;i<n.length;i++)u[i]&&t(n[i])};e.q=u=>u?u.b:void 0;e.r=u=>u?u.c:void 0;var k=e.ledger||{};t({a:1,b:[2,3]})}(this,console.log);", ["minified"]),
        ("d.py", "X = [\n" + "\n".join("  1, 2.5, -3, 4," for _ in range(60)) + "\n]\n", ["data"]), ("d.py", "X = [1, 2, 3]\n" + "def f():\n    return X\n", []), ("i.ts", "export const PATH = '" + "M22,25L18,5 6,7L60,17 " * 60 + "';\n", []), ("e.js", "", []), ("e.js", None, []),
    ],
)
def test_content_evidence(path, text, want):
    assert handwritten.content_evidence(path, text) == want


def test_path_patterns():
    assert handwritten.path_patterns("m/gen/gen/v2/a_pb2.py") == ["**/m/**", "**/gen/**", "*_pb2.*"] and handwritten.path_patterns("app-0a1b2c3d4e.js") == ["*[.-]<hash>.*"] and handwritten.path_patterns("") == []
    assert handwritten.library("m/third_party/lib/index.js")[2] and handwritten.library("vendor/lib/lib.go")[2]
    assert not handwritten.library("apps/vendor/11c/src/a.py")[2] and not handwritten.library("src/vendor/ledger.ts")[2]


def test_repeated_forms():
    assert handwritten.repeats_forms("".join(f"public String get{c}() {{ return {c.lower()}; }}\n" for c in "ABCDEFGH"))
    assert not handwritten.repeats_forms(HAND) and not handwritten.repeats_forms(None) and not handwritten.repeats_forms("x = 1\n" * 7)


def own(n):
    """A text of its own that a person may have written."""
    return HAND.replace("load", f"load{n}") + f"// {n}\n" + "\n".join(f"const k{n}x{i} = {'f(' * (i % 5 + 1)}{n}{')' * (i % 5 + 1)};" for i in range(4))


def test_patterns_mined_from_declared_repositories(spark):
    """Three repositories declare what lies under stubs/ as generated; a fourth without attribute files gets the rule, one that takes the kind back doesn't."""
    rows = [(n, "stubs/** linguist-generated\n", f"r{n}/.gitattributes") for n in range(3)]
    rows += [(100 * n + i, own(100 * n + i), f"r{n}/stubs/f{i}.ts") for n in range(3) for i in range(60)]
    rows += [(900 + i, own(900 + i), f"r{i % 4}/src/g{i}.ts") for i in range(40)]
    rows += [(1000, own(1000), "r9/lib/stubs/a.ts"), (1001, own(1001), "r8/stubs/b.ts"), (1002, "*.ts -linguist-generated\n", "r8/.gitattributes"), (1003, own(1003), "r7/stubs/c.ts"), (1004, "*.ts -linguist-vendored\n*.ts !linguist-generated\n", "r7/.gitattributes")]
    files = spark.createDataFrame([], "file_id string, line_count int, token_estimate int")
    got = {r.file_id: r.reasons for r in handwritten.judge(docs(spark, rows), files).collect()}
    assert got["r9/lib/stubs/a.ts"] == ["path:**/stubs/**"] and got["r7/stubs/c.ts"] == ["path:**/stubs/**"] and "r8/stubs/b.ts" not in got
    assert all(got[f"r{n}/stubs/f{i}.ts"] == ["declared:generated"] for n in range(3) for i in range(60)) and len(got) == 182


def test_patterns_mined_from_evidence(spark):
    """A suffix whose files mostly carry a header holds for a file without one, unless that file shows no sign and support is small."""
    form = "".join(f"export const F{i}: number = {i};\n" for i in range(20))
    rows = [(n, "// @generated by tool\n" + own(n), f"r{n % 4}/a/b{n}_stub.ts") for n in range(19)] + [(50, form, "s/x_stub.ts"), (51, own(51), "s/y_stub.ts"), (52, form, "s/x_plain.ts")]
    files = spark.createDataFrame([], "file_id string, line_count int, token_estimate int")
    got = {r.file_id: r.reasons for r in handwritten.judge(docs(spark, rows), files).collect()}
    assert got["s/x_stub.ts"] == ["path:*_stub.*"] and "s/y_stub.ts" not in got and "s/x_plain.ts" not in got and len(got) == 20


def test_unset_takes_back_its_kind_only(spark):
    banner = "/* lib 2.1.0 - Copyright (c) the lib authors. Released under the BSD license. */\n" + HAND
    rows = [(1, "*.js -linguist-generated\n", "r/.gitattributes"), (2, banner, "r/a.js"), (3, "// @generated by x\n" + HAND, "r/b.js"), (4, "// @generated by x\n" + HAND, "r/c.ts"), (5, '"odd name.ts" linguist-generated\n!x.ts linguist-generated\n# x\n', "q/.gitattributes"), (6, own(6), "q/odd name.ts"), (7, own(7), "q/x.ts")]
    files = spark.createDataFrame([], "file_id string, line_count int, token_estimate int")
    assert {r.file_id: r.reasons for r in handwritten.judge(docs(spark, rows), files).collect()} == {"r/a.js": ["vendored"], "r/c.ts": ["generated"], "q/odd name.ts": ["declared:generated"]}


def test_libraries_of_package_trees(spark):
    same = "export function debounce(f, wait) {\n  return later(f, wait);\n}\n" * 6
    rows = [("a/third_party/lodash/debounce.js", same), ("b/web/far.js", same), ("a/third_party/lodash/deep/other.js", "x"), ("a/vendor/github.com/pkg/errors/stack.go", "package errors"), ("a/third_party/zlib-1.3/inflate.js", "x"), ("a/vendor/base64/index.js", "x")]
    rows += [("a/vendor/left/package.json", "{}"), ("a/vendor/left/pad.js", "x"), ("a/external/billing/invoice.js", "const own = 1"), ("a/src/lodash/other.js", "x")]
    docs = spark.createDataFrame(rows, "file_id string, text string")
    files = spark.createDataFrame([], "file_id string, token_estimate int, line_count int")
    got = {r.file_id for r in handwritten.judge(docs, files).collect()}
    assert got == {f for f, _ in rows} - {"b/web/far.js", "a/external/billing/invoice.js", "a/src/lodash/other.js"} | (got & {"b/web/far.js"})


def test_attributes_precedence(spark):
    rows = [
        (1, "*.gen.ts linguist-generated\nlib/** linguist-vendored\n# c\nlib/own/** -linguist-vendored\n", "r/.gitattributes"), (2, "*.ts linguist-generated=false\nbig.css linguist-generated=true\n", "r/sub/.gitattributes"),
        (3, HAND, "r/a.gen.ts"), (4, HAND, "r/lib/x.js"), (5, HAND + "//1", "r/lib/own/y.js"), (6, HAND + "//2", "r/sub/b.gen.ts"), (7, "", "r/sub/big.css"), (8, HAND + "//3", "other/a.gen.ts"), (9, None, None), (10, "// @generated by x\n" + HAND, "r/sub/c.ts"), (10, "// @generated by x\n" + HAND, "r/sub/c.ts"),
    ]
    files = spark.createDataFrame([("r/nodoc.min.js", 10, 100000), ("r/zero.js", 0, 5), (None, 1, 1)], "file_id string, line_count int, token_estimate int")
    got = {r.file_id: r.reasons for r in handwritten.judge(docs(spark, rows), files).collect()}
    assert set(got) == {"r/a.gen.ts", "r/lib/x.js", "r/sub/big.css", "r/nodoc.min.js"}  # r/sub takes generated back from all .ts, other/ has too few files to mine from
    assert handwritten.judge(docs(spark, []), files.limit(0)).count() == 0


def test_pattern_regex():
    import re

    for pattern, path, want in (("*.js", "a/b.js", True), ("/*.js", "a/b.js", False), ("a/**/b", "a/x/y/b", True), ("dir/", "dir/x", True), ("[ab].c", "x/a.c", True), ("f?.c", "fo.c", True), ("a.c", "abc", False)):
        assert bool(re.fullmatch(handwritten.pattern_regex(pattern), path)) is want, (pattern, path)


# ---- syntax --------------------------------------------------------------------------------------------

VALID = {
    "javascript": ["", "// x\n", "const a = 1;\nlet b = a ? 2 : 3\nfoo(a, ...b)\n", "import { a as b } from 'x';\nexport default class A extends B { constructor(x) { super(); this.x = x; } static async *gen() { yield 1 } get a() { return 1 } #p = 3; }\n", "const r = /[)}\\]]+/.test(x);\nif (a)\n  b()\nelse\n  c()\n",
                   "try { a() } catch { b() } finally { c() }\nswitch (x) { case 1: case 2: foo(); break; default: bar() }\ndo { x++ } while (x < 5)\nlabel: for (;;) { break label }", "const s = `\n<<<<<<< HEAD\n${a + `b`}\n=======\n`;", "x => y => ({ z: 1 })"],
    "typescript": ["export async function f(a: string[], b = 23): Promise<unknown> { return a.slice(0, b); }", "class A<T> extends B<T> implements C, D<E> { private readonly x: number = 1; constructor(private y: string) { super() } async m<T extends X>(rows: any[]): Promise<Map<string, Array<number>>> { return x as unknown as T } }",
                   "export interface X extends Y<Z> { a?: string; readonly b: number[]; c(x: number): void; [k: string]: any }\nexport type K = string | number;\ntype M = { [K in keyof T]?: T[K] };\nenum E { A, B = 2 }", "declare module 'x' { export const a: number; }\nfunction isX(a: any): a is X { return !!a }"],
    "python": ["", "def f(x: int = 1, /, *a, **k) -> int:\n    return x\n", "﻿x = 1\n"],
    "java": ["package a.b;\nimport java.util.*;\n@Deprecated\npublic final class A<T extends B> extends C<T> implements D, E<F> {\n  private static final int X = 1, Y[] = {1, 2};\n  static { foo(); }\n  A(int a, String... b) throws Q { super(a); }\n  <R> R map(Function<? super T, ? extends R> f) { for (var x : xs) { if (x instanceof String s && s.isEmpty()) continue; } return (R) f.apply(null); }\n  enum K { P, Q { int z() { return 1; } }; int n; }\n  Runnable r = () -> { try (var q = open()) { q.run(); } catch (IOException | Foo e) { throw new RuntimeException(e); } };\n  int s(int i) { return switch (i) { case 1, 2 -> 3; default -> { yield 4; } }; }\n}\n"],
    "go": ["package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype T struct {\n\tA, B int `json:\"a\"`\n\t*E\n}\n\ntype I interface {\n\tM(a int) (string, error)\n}\n\nfunc (t *T) M(a int, b ...string) (n int, err error) {\n\tfor i, v := range b {\n\t\tif v == \"\" || len(v) > 3 {\n\t\t\tcontinue\n\t\t}\n\t\tm := map[string][]int{\"a\": {1, 2}}\n\t\tgo func() { ch <- m }()\n\t\tdefer t.close(i)\n\t}\n\tswitch x := y.(type) {\n\tcase int, string:\n\t\treturn 1, nil\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\t\t_ = v\n\t}\n\treturn T{A: 1}.A, nil\n}\n\nfunc G[K comparable, V any](m map[K]V) {}\n"],
    "rust": ["use crate::a::{B, c::*};\n\n#[derive(Debug, Clone)]\npub struct S<'a, T: X + 'a> {\n    a: &'a [T],\n    pub b: Option<Vec<u8>>,\n}\n\nimpl<'a, T> S<'a, T> where T: X {\n    pub fn new(x: usize) -> Result<Self, E> {\n        let v: Vec<_> = (0..x).map(|i| i * 2).collect::<Vec<u8>>();\n        for (i, c) in v.iter().enumerate() { if i > 3 && c != &b'x' { break; } }\n        let m = match x { 0 => None, n if n > 3 => Some(n + 1), _ => { warn!(\"a {}\", x); return Err(E::Y) } };\n        Ok(S { a: &v[..x], b: m? })\n    }\n}\n\nenum E { A, B(u8), C { d: i32 } }\nconst K: usize = 0x1F;\nmacro_rules! q { ($x:expr) => { $x }; }\n"],
    "json": ["1", '{"a": [1, -2.5e3, null, "\\u00e9"]}', " [] "],
}
BROKEN = {
    "javascript": ["const a = ;", "foo(", "const a: number = 1;", "interface A { x: string }", "class A { private x = 1 }", "foo() bar()", "<<<<<<< ours\nfoo()\n=======\nbar()\n>>>>>>> x\n", 'let x = "abc\nfoo()', "def f(x):\n  return 1\n", "<!DOCTYPE html>", "version pointer/v1\noid sha256:12ab\n", "function f(a b) {}", "x = {a: 1 b: 2}", "@@ -1,2 +3,4 @@\nfoo()", "<%= foo %>\nx()", "... rest unchanged ..."],
    "typescript": ["const x: = 3;", "interface A { x string }", "class A { foo(): { }", "package ledger\n", "class {{ name }} {\n}", "const x = [1, 2;\n"], "python": ["def f(:\n", 'print "x"\n', "if x:\ny\n", "<<<<<<< HEAD\n", "return 1\n", "\x00"],
    "java": ["public class A { int f( { } }", "class A { int x = 1 }", "class A { void f() { foo() } }", "class A {", "import a.b\nclass A {}", "export const a = 1;"], "go": ["", "package a\nfunc f() {", "package a\nfunc f() {\n\tfoo(1\n}\n", "package a;\nimport java.util.List;\n", "func f() {}\n", 'package a\nvar x = "abc\n'],
    "rust": ["fn f() {", "fn f( { }", "struct S { a u8 }", 'fn f() { let x = "abc; }', "package main\n", "fn f() { let = 3; }"], "json": ["", "{'a': 1}", "[1,]", "NaN", "{} {}", '"\t"', "// c\n{}"],
}


@pytest.mark.parametrize("language", VALID)
def test_valid(language):
    for t in VALID[language]:
        assert syntax.parses(t, language), t
    if language == "javascript":
        for t in VALID[language]:
            assert syntax.parses(t, "typescript"), t


@pytest.mark.parametrize("language", BROKEN)
def test_broken(language):
    for t in BROKEN[language]:
        assert not syntax.parses(t, language), t


# Early errors of modules, targets of assignments, statements that are none; and what looks like one but is valid.
EARLY = {
    "javascript": ['const x;', 'with (a) {}', 'return 1', 'break;', '1 = x', 'f() = 1', 'a?.b = 1', 'let let = 1', 'let x = 08n;', 'var r = /(/;', 'for (let x of a, b) {}', 'if (a) b(); else c(); else d();', 'else {}', 'const {a};', 'continue', 'x = 010', '!a = 1'],
    "java": ['class A { void f() { 1 + 2; } }', 'class A { void f() { else {} } }', 'class A { void f() { a; } }', 'class A { void f() { new int[3]; } }', 'class A { void f() { if (a) b(); else c(); else d(); } }'],
}
LATE = {
    "javascript": ['const x = 1, {a} = b;', 'function f() { return 1 }', 'for (const x of y) { if (x) break; else continue }', 'a.b = c[d] = e', '[a, b] = [b, a]', '({a} = b)', 'x => y => z = 1', 'a ? b = 1 : c = 2', 'l: { break l }', 'switch (x) { case 1: break }', 'f(a => { return a })', 'class A { m() { return 1 } static x = 1 }', 'const o = { return() {}, break: 1, get continue() { return 1 } }', 'a.return(1)', 'if (a) { b() } else if (c) d(); else { e() }', 'if (a)\n  b()\nelse\n  c()\n', 'var r = /(?:a|(b))+?[(]/g;', 'let y = async (a) => { await a }', 'f()[0] = 1; f().x += 2; this.x = 1; new A().b = 3; (a) = 1', 'function* g() { const x = yield; yield* f(); x = yield 1 }', 'x >>>= 2; y >>= 1; a ??= b', 'for (;;) { while (1) { do { break } while (0) } }', 'try { return_() } catch (e) { f() }', 'export default (a) => a ? 1 : 2', 'const f = function () { return }', 'arr.forEach(function (x) { if (!x) return; y() })', 'for await (const x of y) { if (x) { continue } }', 'async function* f() { for (const k in o) delete o[k]; }', 'a = b ? c : d ? e : f', 'x = function () {}, y = class {}', 'const {a = 1, ...b} = c, [d, , e] = f', '`a${b}`.c = 1', 'a.b?.c.d()', 'if (x) return_; else { y = 1 }'],
    "typescript": ['type A = abstract new () => void;', 'let x = <T>y;', 'const a = <Foo<Bar>>b.c();', "type B = typeof import('x');", "let q: import('y').Z<number>;", 'const x: number;', 'let f = <T>(a: T) => a;', 'if (a < b && c > d) {}', '(x as any).y = 1; x!.z = 2; (<any>w).v = 3', 'for (const a of b as c[]) {}', 'let a = f<string>(b);', 'class A<T> { private x?: T; constructor(private y = 1) { this.x = y as T } }', 'function f(a: number): a is string { return true }', 'x = y as unknown as Z;', 'const x = 1, {a} = b;', 'function f() { return 1 }', 'for (const x of y) { if (x) break; else continue }', 'a.b = c[d] = e', '[a, b] = [b, a]', '({a} = b)', 'x => y => z = 1', 'a ? b = 1 : c = 2', 'l: { break l }', 'switch (x) { case 1: break }', 'f(a => { return a })', 'class A { m() { return 1 } static x = 1 }', 'const o = { return() {}, break: 1, get continue() { return 1 } }', 'a.return(1)', 'if (a) { b() } else if (c) d(); else { e() }', 'if (a)\n  b()\nelse\n  c()\n', 'var r = /(?:a|(b))+?[(]/g;', 'let y = async (a) => { await a }', 'f()[0] = 1; f().x += 2; this.x = 1; new A().b = 3; (a) = 1', 'function* g() { const x = yield; yield* f(); x = yield 1 }', 'x >>>= 2; y >>= 1; a ??= b', 'for (;;) { while (1) { do { break } while (0) } }', 'try { return_() } catch (e) { f() }', 'export default (a) => a ? 1 : 2', 'const f = function () { return }', 'arr.forEach(function (x) { if (!x) return; y() })', 'for await (const x of y) { if (x) { continue } }', 'async function* f() { for (const k in o) delete o[k]; }', 'a = b ? c : d ? e : f', 'x = function () {}, y = class {}', 'const {a = 1, ...b} = c, [d, , e] = f', '`a${b}`.c = 1', 'a.b?.c.d()', 'if (x) return_; else { y = 1 }'],
    "java": ['module a { requires b; requires transitive c.d; requires static e; exports f.g to h, i.j; opens k; uses l.M; provides n.O with p.Q, r.S; }', 'open module a.b { }', 'class A { void f() { a.b(); new B(); i++; --j; x = y = 1; a[0] += 2; this.f(); super.g(); A.<T>h(); new C() { int x; }; s >>>= 2; if (a) b(); else if (c) { d(); } else e(); } }', 'class A { A() { this(1); } void g() { (a).b(); ((B) c).d(); } }', 'class A { void f() { foo().bar().baz(x -> { return x; }); list.forEach(System.out::println); int[] a = {1, 2}; String s = a ? b : c; for (int i = 0; i < n; i++) sum += i; do { x--; } while (x > 0); label: for (;;) break label; } }'],
    "go": ['package a\nfunc F[U ~int|~string](x U) {}\n', 'package a\ntype N interface { ~int | ~float64 }\nfunc G[K comparable, V ~int](m map[K]V) {}\n'],
}


@pytest.mark.parametrize("language", EARLY)
def test_early_errors(language):
    assert [t for t in EARLY[language] if syntax.parses(t, language)] == []


@pytest.mark.parametrize("language", LATE)
def test_no_early_error(language):
    assert [t for t in LATE[language] if not syntax.parses(t, language)] == []


def test_all_grammars_are_tried():
    """A rejected text counts as whatever accepts it, also if it holds no word of that language."""
    assert syntax.examine("x = 1 if y else 2", "rust") == (False, "python") and syntax.examine("[1]", "go")[1] is not None
    assert syntax.examine("}{ ][", "go") == (False, None) and syntax.examine(" ", "json") == (False, None)
    assert syntax.examine("[" * 5000 + "]" * 5000, "json")[0]  # nesting alone is no error


@pytest.mark.parametrize("language", [k for k in VALID if k not in ("json",)])
def test_truncations_are_rejected(language):
    """A text cut inside a bracket is never valid."""
    for t in VALID[language]:
        if t.rstrip().endswith("}") and "{" in t and language != "python":
            assert not syntax.parses(t.rstrip()[:-1], language), t


def test_parsed_table(spark):
    rows = [(1, VALID["go"][0], "r/a.go"), (2, VALID["go"][0], "r/b.rs"), (3, "}{", "r/c.ts"), (4, None, "r/d.ts"), (5, "", "r/e.py"), (6, "", "r/f.json"), (7, "x {", "r/g.css"), (8, "x", None), (9, "x" * 300000, "r/h.js"), (10, "const a: number = 1", "r/i.js"), (11, "def f(", "r/j.weird"), (12, "[" * 50000, "r/k.json"), (13, "(" * 20000, "r/l.py")]
    files = spark.createDataFrame([("r/i.js", "typescript", None, None, "x"), ("r/i.js", "typescript", None, None, "x"), ("r/c.ts", "TypeScript ", None, None, "x"), ("r/a.go", None, None, None, "x"), (None, "go", None, None, "x")], "file_id string, language string, indexed_at timestamp, received_at timestamp, text string")
    got = {r.file_id: (r.language, r.valid, r.accepted_as) for r in syntax.parsed(docs(spark, rows), files).collect()}
    assert got["r/a.go"] == ("go", True, None) and got["r/b.rs"] == ("rust", False, "go") and got["r/c.ts"] == ("typescript", False, None)
    assert got["r/e.py"][1] and not got["r/f.json"][1] and "r/g.css" not in got and "r/d.ts" not in got and got["r/h.js"][1] and got["r/i.js"] == ("typescript", True, None)
    assert not got["r/k.json"][1] and not got["r/l.py"][1] and "r/j.weird" not in got
    rates = {(r.repo, r.language): (r.n_files, r.n_rejected, r.n_wrong_extension, r.rate) for r in syntax.rates(syntax.parsed(docs(spark, rows), files)).collect()}
    assert rates["r", "rust"] == (1, 1, 1, 1.0)
    assert syntax.parsed(docs(spark, []), files.limit(0)).count() == 0


def test_queries(spark):
    from tessera.llm import queries as q

    assert {"p1_found", "p2_found", "p5_found", "p7_ids", "p8_windows", "p9_found"} <= set(q.QUERIES) and set(q.SQL) <= set(q.QUERIES)
    assert F is not None
