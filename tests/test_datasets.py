"""Nested records, orphan references and fan-in: brute force, and the hard cases of each."""

import datetime as dt
import json
import random

import pytest

from tessera.operators import fanin, nested, orphans

T = dt.datetime(2025, 3, 1, tzinfo=dt.UTC)


def leaves(rid, kind, raw):
    """Brute force: the items of one record."""
    out = set()
    ok, v = nested.parse_strict(raw)
    if not ok or not isinstance(v, dict):
        return out

    def text(x):
        return isinstance(x, str) and not isinstance(x, nested._Number)

    def command(obj, path):
        c = obj.get("command") if isinstance(obj, dict) else None
        if text(c):
            out.add((rid, f"{path}.command", c))
        elif isinstance(c, list):
            out.update((rid, f"{path}.command[{n}]", x) for n, x in enumerate(c) if text(x))

    def blocks(a, path, key):
        for n, x in enumerate(a if isinstance(a, list) else []):
            if isinstance(x, dict):
                if text(x.get(key)):
                    out.add((rid, f"{path}[{n}].{key}", x[key]))
                blocks(x.get("content"), f"{path}[{n}].content", key)

    if kind == "hook":
        command(v.get("tool_input"), "tool_input")
        post = v.get("postToolUse")
        if isinstance(post, dict):
            command(post.get("tool_input"), "postToolUse.tool_input")
        for n, x in enumerate(post if isinstance(post, list) else []):
            command(x.get("tool_input") if isinstance(x, dict) else None, f"postToolUse[{n}].tool_input")
    elif kind == "transcript":
        m = v.get("message")
        blocks(m.get("content") if isinstance(m, dict) else None, "message.content", "type")
    elif kind == "rollout":
        p = v.get("payload")
        o = p.get("output") if isinstance(p, dict) else None
        if text(o):
            o = nested.parse_strict(o)[1]
        blocks(o, "payload.output", "text")
    return out


def test_nested_brute_force(spark):
    r = random.Random(3)

    def value(d):
        k = r.random()
        if d > 6 or k < 0.35:
            return r.choice([None, "", "x", "y", "z", "é\n", 1, 2.5, True, 10**400, "[1]", '[{"text":"in","content":[{"text":"deep"}]}]'])
        if k < 0.6:
            return [value(d + 1) for _ in range(r.randrange(4))]
        return {r.choice(["tool_input", "command", "content", "type", "text"]): value(d + 1) for _ in range(r.randrange(1, 6))}

    rows = []
    for i in range(1500):
        kind = r.choice(["hook", "transcript", "rollout", "hook", "transcript", "rollout", "odd", None])
        root = {"hook": "postToolUse", "transcript": "message", "rollout": "payload"}.get(kind, "x")
        v = {root: value(1), "tool_input": value(2)}
        if kind == "transcript":
            v["message"] = {"content": [value(2) for _ in range(3)]}
        if kind == "rollout":
            v["payload"] = {"output": value(2)}
        rows.append((i % 1300, kind, json.dumps(v)))
    rows += [(900, "hook", None), (901, "hook", ""), (902, "hook", "{} x"), (903, "hook", '{"tool_input":{"command":NaN}}'), (904, "hook", "﻿{}"), (905, "hook", '{"tool_input":{"command":"\\ud800"}}'), (None, "hook", '{"tool_input":{"command":"n"}}'), (906, "hook", '{"tool_input":{"command":"' + "y" * 300000 + '"}}')]
    df = spark.createDataFrame([(a, b, c, "clash", 1) for a, b, c in rows], "record_id bigint, kind string, raw string, item_path string, value int")
    got = {tuple(x) for x in nested.flat_items(df).collect()}
    want = set().union(*(leaves(*x) for x in rows))
    want = {(a, p, "�" if v == "\ud800" else v) for a, p, v in want}
    assert got == want and len(want) > 60


def test_nested_empty_and_sharing(spark):
    empty = spark.createDataFrame([], "record_id bigint, kind string, raw string")
    assert nested.flat_items(empty).count() == 0 and nested.sharing(empty).count() == 0
    same = spark.createDataFrame([(i, "hook", '{"b":{"a":1},"c":{"a":1}}') for i in range(50)], "record_id bigint, kind string, raw string")
    roots, bridges = nested.merkle_tables(same)
    assert roots.count() == 50 and roots.select("root_hash").distinct().count() == 1
    assert bridges.count() == 3  # b, c of the root, and one a for both


def test_nested_identity_is_injective():
    key = lambda s: nested.identities(nested.parse_strict(s)[1])
    me = lambda s: (lambda o, k: k[id(o[0])])(*key(s))
    texts = ['{"x":"1"}', '{"x":1}', '{"x":[1]}', '{"x":["1"]}', '{"x":null}', '{"x":""}', '{"x\\u001fy":"a"}', '{"x":"y\\u001fstring\\u001fa"}', '{"x":"y","z":"a"}', '{"x":{"y":"a"}}', '{"x":true}', '{"x":"true"}', '["x","1"]', '["x1"]', '{"":"x1"}', '{}', '[]', '[[]]', '{"x":"3:abc"}', '{"x3:abc":""}']
    assert len({me(t) for t in texts}) == len(texts)
    assert me('{"a":1,"b":[2]}') == me(' {"b": [2], "a":1}')


def test_nested_separators_in_values(spark):
    rows = [(1, "hook", '{"tool_input":{"command":"x","y":"z"}}'), (2, "hook", json.dumps({"tool_input": {"command": "x\x1fy\x1fstring\x1fz"}})), (3, "hook", json.dumps({"tool_input": {"command\x1fy": "q", "command": "r"}}))]
    got = {tuple(x) for x in nested.flat_items(spark.createDataFrame(rows, "record_id bigint, kind string, raw string")).collect()}
    assert got == {(1, "tool_input.command", "x"), (2, "tool_input.command", "x\x1fy\x1fstring\x1fz"), (3, "tool_input.command", "r")}


def deep(n, leaf):
    return '{"type":"t","content":[' * n + leaf + "]}" * n


def test_nested_any_depth(spark):
    """1,200 asked levels, 100,000 others; a tree of that depth that isn't closed is no JSON."""
    rows = [
        (1, "transcript", '{"message":{"content":[' + deep(1200, '{"type":"end"}') + "]}}"),
        (2, "hook", '{"tool_input":{"command":"c","x":' + "[" * 100_000 + "]" * 100_000 + "}}"),
        (3, "hook", '{"tool_input":{"command":"d","x":' + '{"a":' * 100_000 + "1.50" + "}" * 100_000 + "}}"),
        (4, "hook", '{"tool_input":{"command":"e","x":' + "[" * 100_000 + "]" * 99_999 + "}}"),
        (5, "rollout", json.dumps({"payload": {"output": "[" * 100_000 + "]" * 100_000}})),
    ]
    df = spark.createDataFrame(rows, "record_id bigint, kind string, raw string")
    got = {tuple(x) for x in nested.flat_items(df).collect()}
    want = {(1, "message.content[0]" + ".content[0]" * n + ".type", "t" if n < 1200 else "end") for n in range(1201)}
    assert got == want | {(2, "tool_input.command", "c"), (3, "tool_input.command", "d")}
    assert nested.merkle_tables(df)[0].count() == 4


@pytest.mark.parametrize("text", ["[]", " [ 1 , -0.5e+3, {} ] ", '{"a":[true,false,null,"\\u00e9\\ud83d\\ude00"],"a":2,"":{"b":[[]]}}', "1", '"x"', "", " ", "[1,]", "[1 2]", '{"a"}', '{"a":}', '{"a":1,}', "{1:2}", "01", "1.", "-", "+1", "tru", "nulll", '"a\nb"', "[", "]", '{"a":[1}', "NaN", "[Infinity]", "\ufeff1", "[1]x"])
def test_deep_parser_agrees(text):
    try:
        want = json.loads(text, parse_constant=nested._no_constant, parse_int=str, parse_float=str)
    except ValueError:
        with pytest.raises(ValueError):
            nested._parse_deep(text)
    else:
        assert nested._parse_deep(text) == want


def rebuilt(bridges, h, vtype):
    """The value of an identity, put together from the bridges."""
    rows = sorted(bridges.get(h, []), key=lambda r: r.ordinal)
    item = lambda r: rebuilt(bridges, r.child_hash, r.vtype) if r.child_hash else {"null": None, "true": True, "false": False}.get(r.value if r.vtype == "boolean" else r.vtype, r.value)
    return {r.key: item(r) for r in rows} if vtype == "object" else [item(r) for r in rows]


def test_nested_round_trip(spark):
    r = random.Random(11)

    def value(d):
        k = r.random()
        if d > 5 or k < 0.3:
            return r.choice([None, True, False, "", "x", "null", "1\x1f"])
        return [value(d + 1) for _ in range(r.randrange(4))] if k < 0.6 else {r.choice("abcd"): value(d + 1) for _ in range(r.randrange(4))}

    values = {n: {"v": value(0)} for n in range(300)}
    roots, bridges = nested.merkle_tables(spark.createDataFrame([(n, "odd", json.dumps(v)) for n, v in values.items()], "record_id bigint, kind string, raw string"))
    by_parent = {}
    for b in bridges.collect():
        by_parent.setdefault(b.parent_hash, []).append(b)
    assert {x.record_id: rebuilt(by_parent, x.root_hash, x.root_type) for x in roots.collect()} == values


def tables(spark, edges, anchors=(), files=(), symbols=(), versions=()):
    e = spark.createDataFrame(list(edges), "edge_id bigint, src string, dst string, type string, seen_at timestamp, key string")
    a = spark.createDataFrame(list(anchors), "anchor_id bigint, repo string, path string, hash string, verified_at timestamp")
    f = spark.createDataFrame(list(files), "file_id string, indexed_at timestamp, received_at timestamp, deleted_at timestamp, imported_by_count int")
    s = spark.createDataFrame(list(symbols), "symbol_id string, deleted_at timestamp")
    v = spark.createDataFrame(list(versions), "repo string, path string, hash string")
    shared = spark.createDataFrame([("sh/x#y", "sh/x")], "symbol_id string, file_id string")
    return e, a, f, s, v, shared


def found(t):
    e, a, f, s, v, shared = t
    return {(r.ref_table, r.ref_id, r.ref_field) for r in orphans.orphans(orphans.references(e, a), orphans.parents(f, s, shared, v), 10).collect()}


def test_orphans(spark):
    late = T + dt.timedelta(days=90)
    t = tables(
        spark,
        [(1, "./r/a", "r\\b", "calls", T, "k"), (1, "./r/a", "r\\b", "calls", T, "k"), (2, "r/a", "r/gone", "calls", T, "k"), (3, None, "Base", "extends", T, None), (4, "r/a", "Base", "calls", T, "k"), (5, "r/a", "sh/x", "exports", None, "k"), (6, "r/dead", "r/a#s", None, T, "k"), (7, "r/a", "r/a#old", "calls", T, "k"), (8, "r/a", "pkg/Base", "implements", T, "k")],
        [(1, "r", "./a", "SHA256:ABC", T), (2, "r", "a", "sha256:zzz", T), (3, "r", "none", None, None), (4, "r", None, "sha256:abc", T), (5, "r", "a", "missing", T), (6, None, "a", "abc", T)],
        [("r/a", T, T, None, 0), ("r/b", late, late, None, 0), ("r/dead", T, T, None, 0), ("r/dead", late, late, late, 0)],
        [("r/a#s", None), ("r/a#old", T)],
        [("r", "a", "sha256:abc")],
    )
    assert found(t) == {("symbol_edges", 2, "dst"), ("symbol_edges", 4, "dst"), ("symbol_edges", 6, "src"), ("symbol_edges", 7, "dst"), ("symbol_edges", 8, "dst"), ("anchors", 2, "hash"), ("anchors", 3, "path")}
    assert found(tables(spark, [])) == set()


def test_orphans_hot_key_and_many(spark):
    edges = [(i, "r/a", "hot" if i % 3 == 0 else f"r/f{i % 900}", "calls", T, "k") for i in range(3000)]
    files = [(f"r/f{i}", T, T, None, 0) for i in range(0, 900, 2)] + [("r/a", T, T, None, 0)]
    live = {f[0] for f in files}
    assert found(tables(spark, edges, files=files)) == {("symbol_edges", i, "dst") for i, _, d, *_ in edges if d not in live}


def test_fanin(spark):
    rows = [(i, f"s{i % 7}", "./hot" if i % 2 else f"d{i % 500}", "calls", T, "k") for i in range(2000)]
    rows += rows[:300] + [(9000, None, "hot", "calls", T, "k"), (9001, "s", None, "calls", T, "k"), (None, "s", "hot", "calls", T, "k")]
    e = spark.createDataFrame(rows, "edge_id bigint, src string, dst string, type string, seen_at timestamp, n_edges string")
    imports = spark.createDataFrame([("a", "hot", 1), ("a", "hot", 2), ("b", "hot", 1), (None, "d0", 1)], "src string, dst string, file_id int")
    got = {r.dst: (r.n_edges, r.n_sources) for r in fanin.target_report(e, imports).collect()}
    assert got["hot"] == (1001, 7) and got["d0"] == (4, 4)
    hot = next(r for r in fanin.target_report(e, imports).collect() if r.dst == "hot")
    assert hot.share == 1001 / 2002 and (hot.n_imports, hot.n_pairs) == (3, 3003)  # the edge without a target is one of all
    assert {r.dst for r in fanin.hot_targets(e, imports).collect()} == {"hot"}
    files = spark.createDataFrame([("hot", T, T, 5), ("hot", T - dt.timedelta(1), T, 9), ("x", None, None, None)], "file_id string, indexed_at timestamp, received_at timestamp, imported_by_count int")
    rep = {r.file_id: r[1:] for r in fanin.file_report(e, imports, files).collect()}
    assert rep["hot"] == (1001, 3, 2, 3003, 5) and rep["x"] == (0, 0, 0, 0, None) and rep["d0"][:3] == (4, 1, 0)
    none = e.limit(0)
    assert fanin.hot_targets(none, imports.limit(0)).count() == 0 and fanin.file_report(none, imports.limit(0), files.limit(0)).count() == 0


@pytest.mark.parametrize("text, ok", [("1", True), ("[", False), ('{"a":1}{', False), ("Infinity", False), (" {} ", True), (None, False)])
def test_strict(text, ok):
    assert nested.parse_strict(text)[0] is ok
