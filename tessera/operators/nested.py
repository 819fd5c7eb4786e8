"""Deeply nested records as flat tables (Merkle subtree identities).

Every object and array of a JSON record is canonicalised and hashed bottom-up: 128 bits over its type, its keys in
order and its children, each with its length, so that no two values share an identity by their spelling. Identical
objects are stored once, however many records hold them; every occurrence stays in the parent-child bridges with
its place in the parent. A record is put together again by walking the bridges from its root.

``merkle_tables`` gives all of it: ``roots(record_id, kind, root_hash, root_type)`` and
``bridges(parent_hash, ordinal, key, child_hash, value, vtype)``, the children of each distinct object or array, scalars inlined.

``flat_items`` asks for some paths only (``ASKED``), and what is asked for goes into the decomposition as a column list goes into
a scan: of an object only the bridges that lead on are kept, arrays count as places of their object's bridges.
Occurrences are walked by doubling, so records nested n objects deep take about log2(n) joins, not n.

Defined cases: null, empty and non-JSON texts (also ``NaN``, a byte-order mark, trailing text) give no root and
no bridge; of a repeated key the last value counts; repeated records share one root; a lone surrogate escape
becomes U+FFFD; empty objects and arrays have an identity and no children; records may be nested to any depth; an empty
table gives empty tables.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import blake2b
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

#: What is asked for: kind -> state of an object -> path of keys in it -> (shapes, state of the objects there). Shapes: a string,
#: strings of an array, one object, the objects of an array. Objects on the way of a path have one way on and need no bridge of their own.
ASKED: dict[str, dict[str, dict[str, tuple[str, str]]]] = {
    "hook": {"root": {"tool_input.command": ("string strings", ""), "postToolUse": ("object array", "post")}, "post": {"tool_input.command": ("string strings", "")}},
    "transcript": {"root": {"message.content": ("array", "block")}, "block": {"type": ("string", ""), "content": ("array", "block")}},
    "rollout": {"root": {"payload.output": ("array", "item")}, "item": {"text": ("string", ""), "content": ("array", "item")}},
}
#: Paths whose string value, if it holds a JSON array, is read as that array.
EMBEDDED = {"rollout": ("payload", "output")}


class _Number(str):
    """A JSON number by its spelling, so none is too long or loses digits."""


def _no_constant(name: str) -> None:
    raise ValueError(name)


def parse_strict(text: str | None) -> tuple[bool, Any]:
    """Whether a text is JSON as a whole, and its value; nested too deeply for the recursive parser, it is read with a stack."""
    if not text:
        return False, None
    try:
        try:
            return True, json.loads(text, parse_constant=_no_constant, parse_int=_Number, parse_float=_Number)
        except RecursionError:
            return True, _parse_deep(text)
    except ValueError:
        return False, None


_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_WORDS = {"true": True, "false": False, "null": None}


def _parse_deep(text: str) -> Any:
    """The value of a JSON text by an explicit stack of (container, key that waits for its value)."""
    skip = lambda at: _BLANK.match(text, at).end()

    def key(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError("a key is a string")
        name, at = json.decoder.scanstring(text, at + 1, True)
        at = skip(at)
        if text[at : at + 1] != ":":
            raise ValueError("no colon")
        return name, skip(at + 1)

    stack: list[tuple[Any, str | None]] = []
    at = skip(0)
    while True:
        c = text[at : at + 1]
        if c and c in "{[":
            value: Any = {} if c == "{" else []
            at = skip(at + 1)
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                name = None
                if c == "{":
                    name, at = key(at)
                stack.append((value, name))
                continue
            at += 1
        elif c == '"':
            value, at = json.decoder.scanstring(text, at + 1, True)
        elif word := next((w for w in _WORDS if text.startswith(w, at)), None):
            value, at = _WORDS[word], at + len(word)
        elif m := _NUMBER.match(text, at):
            value, at = _Number(m.group()), m.end()
        else:
            raise ValueError("no value")
        while stack:
            box, name = stack[-1]
            if name is None:
                box.append(value)
            else:
                box[name] = value
            at = skip(at)
            c = text[at : at + 1]
            if c == ",":
                at = skip(at + 1)
                if name is not None:
                    name, at = key(at)
                    stack[-1] = (box, name)
                break
            if c != ("]" if name is None else "}"):
                raise ValueError("not closed")
            stack.pop()
            value, at = box, at + 1
        else:
            if skip(at) != len(text):
                raise ValueError("text behind the value")
            return value


def _clean(s: str) -> str:
    try:
        s.encode("utf-8")
        return s
    except UnicodeEncodeError:
        return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _form(v: Any, known: dict[int, bytes]) -> bytes:
    """One child for its parent's hash: a tag, and its identity or its text behind the text's length."""
    if isinstance(v, (dict, list)):
        return b"c" + known[id(v)]
    if isinstance(v, str):
        b = v.encode("utf-8", "surrogatepass")
        return b"%s%d:%s" % (b"n" if isinstance(v, _Number) else b"s", len(b), b)
    return b"z" if v is None else b"t" if v else b"f"


def identities(root: Any) -> tuple[list[Any], dict[int, bytes]]:
    """The containers of a value, parents first, and the identity of each by its ``id()``."""
    order = [root] if isinstance(root, (dict, list)) else []
    for c in order:
        order.extend(v for v in (c.values() if isinstance(c, dict) else c) if isinstance(v, (dict, list)))
    known: dict[int, bytes] = {}
    for c in reversed(order):
        if isinstance(c, dict):
            parts = [b"o"]
            for k in sorted(c):
                kb = k.encode("utf-8", "surrogatepass")
                parts += (b"%d:" % len(kb), kb, _form(c[k], known))
        else:
            parts = [b"a", *(_form(v, known) for v in c)]
        known[id(c)] = blake2b(b"".join(parts), digest_size=16).digest()
    return order, known


def _value(kind: str | None, raw: str | None) -> tuple[bool, Any]:
    ok, value = parse_strict(raw)
    if ok and kind in EMBEDDED:
        *path, last = EMBEDDED[kind]
        at = value
        for k in path:
            at = at.get(k) if isinstance(at, dict) else None
        inner = at.get(last) if isinstance(at, dict) else None
        if isinstance(inner, str) and not isinstance(inner, _Number):
            found, inner = parse_strict(inner)
            if found and isinstance(inner, list):
                at[last] = inner
    return ok, value


def _scalar(v: Any) -> tuple[str | None, str]:
    if isinstance(v, _Number):
        return str(v), "number"
    if isinstance(v, str):
        return _clean(v), "string"
    return (None, "null") if v is None else ("true" if v else "false", "boolean")


def _records(batch: pa.RecordBatch) -> Iterator[tuple[int, str, Any]]:
    for rid, kind, raw in zip(*(batch.column(c).to_pylist() for c in ("record_id", "kind", "raw")), strict=True):
        ok, value = _value(kind, raw)
        if ok:
            yield rid, kind, value


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)


_NODES = pa.schema([("record_id", pa.int64()), ("kind", pa.string()), ("parent_hash", pa.binary()), ("ordinal", pa.int32()), ("key", pa.string()), ("child_hash", pa.binary()), ("value", pa.string()), ("vtype", pa.string())])
_NODES_DDL = "record_id bigint, kind string, parent_hash binary, ordinal int, key string, child_hash binary, value string, vtype string"


def _decompose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per record (no parent), and the bridges of each identity that is new to the batch."""
    kind_of = lambda v: "object" if isinstance(v, dict) else "array"
    for batch in batches:
        seen: set[bytes] = set()
        out: list[tuple] = []
        for rid, kind, value in _records(batch):
            order, known = identities(value)
            out.append((rid, kind, None, None, None, known[id(value)], None, kind_of(value)) if order else (rid, kind, None, None, None, None, *_scalar(value)))
            for c in order:
                me = known[id(c)]
                if me not in seen:
                    seen.add(me)
                    for n, (k, v) in enumerate(sorted(c.items()) if isinstance(c, dict) else ((None, v) for v in c)):
                        k = None if k is None else _clean(k)
                        out.append((None, None, me, n, k, known[id(v)], None, kind_of(v)) if isinstance(v, (dict, list)) else (None, None, me, n, k, None, *_scalar(v)))
        yield _columns(out, _NODES)


def merkle_tables(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots, bridges) of ``record_id, kind, raw``. The parse runs once; identities are made distinct by their hash."""
    nodes = cut(records.select(F.col("record_id").cast("bigint"), "kind", "raw").mapInArrow(_decompose, _NODES_DDL))
    roots = nodes.where("parent_hash is null").select("record_id", "kind", F.col("child_hash").alias("root_hash"), F.col("vtype").alias("root_type")).distinct()
    bridges = nodes.where("parent_hash is not null").select("parent_hash", "ordinal", "key", "child_hash", "value", "vtype").dropDuplicates(["parent_hash", "ordinal"])
    return roots, bridges


_STORE = pa.schema([
    ("record_id", pa.int64()), ("hops", pa.int32()), ("hash", pa.binary()), ("state", pa.string()),
    ("links", pa.list_(pa.struct([("step", pa.string()), ("child", pa.binary()), ("state", pa.string())]))), ("leaves", pa.list_(pa.struct([("step", pa.string()), ("value", pa.string())]))),
])
_STORE_DDL = "record_id bigint, hops int, hash binary, state string, links array<struct<step:string,child:binary,state:string>>, leaves array<struct<step:string,value:string>>"


def _decompose_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per record (root, its state, how many bridges lie below it at most), and one per identity and state new to the batch."""
    for batch in batches:
        seen: set[tuple[bytes, str]] = set()
        out: list[tuple] = []
        for rid, kind, value in _records(batch):
            asked = ASKED.get(kind)
            if asked is None or not isinstance(value, dict):
                continue
            _, known = identities(value)
            todo, hops = [(value, "root", 0)], 0
            for at, state, depth in todo:
                hops = max(hops, depth)
                links, leaves = [], []
                for key, (shapes, below) in asked[state].items():
                    v = at
                    for k in key.split("."):
                        v = v.get(k) if isinstance(v, dict) else None
                    if isinstance(v, dict):
                        places = [(key, v)] if "object" in shapes else []
                    elif isinstance(v, list):
                        places = [(f"{key}[{n}]", x) for n, x in enumerate(v)] if "array" in shapes or "strings" in shapes else []
                    else:
                        places = [(key, v)] if "string" in shapes.split() else []
                    for step, x in places:
                        if isinstance(x, dict) and below:
                            links.append({"step": step, "child": known[id(x)], "state": f"{kind}.{below}"})
                            todo.append((x, below, depth + 1))
                        elif isinstance(x, str) and not below and not isinstance(x, _Number):
                            leaves.append({"step": step, "value": _clean(x)})
                me = known[id(at)], f"{kind}.{state}"
                if (links or leaves) and me not in seen:
                    seen.add(me)
                    out.append((None, None, *me, links, leaves))
            out.append((rid, hops, known[id(value)], f"{kind}.root", None, None))
        yield _columns(out, _STORE)


def occurrences(roots: DataFrame, links: DataFrame, hops: int) -> DataFrame:
    """``record_id, path, hash, state`` of every object on the asked paths, by doubling: after n joins, all objects less than 2^n bridges below their root."""
    path = lambda a, b: F.when(F.col(a) == "", F.col(b)).otherwise(F.concat(a, F.lit("."), b))
    found, jump, span = roots.withColumn("path", F.lit("")), links, 1
    while span <= hops:
        down = found.join(jump, ["hash", "state"]).select("record_id", path("path", "step").alias("path"), F.col("child").alias("hash"), F.col("child_state").alias("state"))
        found = found.select("record_id", "path", "hash", "state").unionByName(down)
        span *= 2
        if span <= hops:
            far = jump.select(F.col("hash").alias("child"), F.col("state").alias("child_state"), F.col("step").alias("far"), F.col("child").alias("far_child"), F.col("child_state").alias("far_state"))
            jump = jump.join(far, ["child", "child_state"]).select("hash", "state", path("step", "far").alias("step"), F.col("far_child").alias("child"), F.col("far_state").alias("child_state"))
            if span > 4:  # the plan doubles with each round
                found, jump = cut(found), cut(jump)
    return found


def flat_items(records: DataFrame) -> DataFrame:
    """Commands, block types and output texts of the records as ``(record_id, item_path, value)``, distinct."""
    rows = cut(records.select(F.col("record_id").cast("bigint"), "kind", "raw").mapInArrow(_decompose_asked, _STORE_DDL))
    hops = rows.agg(F.max("hops")).first()[0] or 0  # one number
    roots = rows.where("hops is not null").select("record_id", "hash", "state")
    store = cut(rows.where("hops is null").groupBy("hash", "state").agg(F.first(F.struct("links", "leaves")).alias("o")))
    links = store.select("hash", "state", F.explode("o.links").alias("l")).select("hash", "state", "l.step", "l.child", F.col("l.state").alias("child_state"))
    leaves = store.where("size(o.leaves) > 0").select("hash", "state", "o.leaves")
    hits = occurrences(roots, links, hops).join(leaves, ["hash", "state"]).select("record_id", "path", F.explode("leaves").alias("x"))
    return hits.select("record_id", F.when(F.col("path") == "", F.col("x.step")).otherwise(F.concat("path", F.lit("."), "x.step")).alias("item_path"), F.col("x.value").alias("value")).distinct()


def sharing(records: DataFrame) -> DataFrame:
    """Per kind of record: occurrences, distinct roots and the identities reachable in one step (how much is stored once)."""
    roots, bridges = merkle_tables(records)
    per_root = roots.groupBy("kind", "root_hash").agg(F.count("*").alias("n"))
    children = bridges.groupBy("parent_hash").agg(F.count("*").alias("children"))
    joined = per_root.join(children, per_root.root_hash == children.parent_hash, "left")
    return joined.groupBy("kind").agg(F.sum("n").alias("records"), F.count("*").alias("distinct_roots"), F.coalesce(F.sum("children"), F.lit(0)).alias("root_children"))
