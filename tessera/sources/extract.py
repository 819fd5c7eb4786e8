"""Extractors: the text of a file to its imports, exports, symbols and calls, one fixed schema for all languages.

Python is read by its own parser. Brace languages share one scanner: comments and strings are blanked out in place, so
positions stay, declarations are found by a table of patterns per language, and a body ends where its brace closes.
Data languages (YAML, TOML, XML, env, GraphQL, Gradle) give their keys as symbols. An extractor that can't read a
text gives an empty result, never a failure.

Defined cases: null and empty texts, unknown languages and token-only languages give empty arrays; repeated names in a
data file count once; a body that never closes ends at the last line.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "file_id string, package_name string, has_default_export boolean, reexport_ratio double, imports array<struct<specifier:string,is_bonus:boolean>>, exports array<string>, "
    "symbols array<struct<name:string,kind:string,start_line:int,end_line:int,is_exported:boolean,extends_name:string,implements:array<string>,calls:array<struct<callee:string,line:int>>>>, refs array<struct<kind:string,value:string>>"
)
Result = dict[str, Any]


def empty() -> Result:
    return {"package_name": None, "has_default_export": False, "reexport_ratio": None, "imports": [], "exports": [], "symbols": [], "refs": []}


def _symbol(name: str, kind: str, start: int, end: int, exported: bool, extends: str | None = None, implements: list[str] = (), calls: list[tuple[str, int]] = ()) -> dict:
    return {"name": name, "kind": kind, "start_line": start, "end_line": end, "is_exported": exported, "extends_name": extends, "implements": list(implements), "calls": [{"callee": c, "line": n} for c, n in calls]}


# ---- the scanner of brace languages ---------------------------------------------------------------------

_MASK = {
    "c": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"),
    "rust": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:\\[\s\S]|[^\"\\])*\"|'(?:\\.|[^'\\\n])'"),
    "php": re.compile(r"//[^\n]*|#(?!\[)[^\n]*|/\*[\s\S]*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'"),
    "ruby": re.compile(r"#[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"),
}
_BLANK = re.compile(r"[^\n]")


def mask(text: str, family: str) -> str:
    """Comments and strings to blanks of the same length."""
    return _MASK[family].sub(lambda m: _BLANK.sub(" ", m.group()), text)


@lru_cache(maxsize=8)
def _breaks(text: str) -> list[int]:
    return [m.start() for m in re.finditer("\n", text)]


def _line(text: str, at: int) -> int:
    return bisect_left(_breaks(text), at) + 1


_BRACE = re.compile(r"[{}]")


def _close(masked: str, at: int) -> int:
    """Position of the brace that closes the first one at or behind ``at``, before a statement ends; ``at`` where there is none."""
    start = masked.find("{", at)
    semi = masked.find(";", at)
    if start < 0 or 0 <= semi < start:
        return at
    depth = 0
    for m in _BRACE.finditer(masked, start):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.start()
    return len(masked) - 1


_CALL = re.compile(r"(?<![\w$.#])(?:(?:this|self|super|\w+)\s*(?:\.|::|->)\s*)*([A-Za-z_$][\w$]*)\s*(?:::<[^>]*>)?\(")
_NO_CALL = frozenset("if for while switch catch return function await typeof new super constructor match loop when with using lock foreach elif not and or in is fn func def sizeof".split())


def calls_in(masked: str, start: int, end: int, own: str | None) -> list[tuple[str, int]]:
    """First line of each distinct callee of a body, itself left out."""
    out: dict[str, int] = {}
    body = masked.find("{", start, end + 1)
    for m in _CALL.finditer(masked, body if body >= 0 else start, end):
        name = m.group(1)
        if name not in _NO_CALL and name != own:
            out.setdefault(name, _line(masked, m.start(1)))
    return list(out.items())


def _names(text: str | None) -> list[str]:
    return [n for n in (re.sub(r"<.*", "", p).strip().rsplit(".", 1)[-1] for p in re.split(r",(?![^<]*>)", text or "")) if n]


def _declared(masked: str, rules: list[tuple[str, str]], exported: Callable[[re.Match, str], bool], prefix: Callable[[re.Match, str, list], str] | None = None, self_calls: bool = False) -> list[dict]:
    """Symbols by a table of (kind, pattern); groups: name, and where there are any extends and implements."""
    found = []
    for kind, pattern in rules:
        for m in re.finditer(pattern, masked, re.MULTILINE):
            name = m.group("name")
            end = _close(masked, m.end())
            g = m.groupdict()
            found.append((m.start("name"), kind, name, end, m, g))
    found.sort(key=lambda x: (x[0], x[1]))
    out, seen = [], set()
    types: list[tuple[int, int, str]] = [(a, e, n) for a, k, n, e, _, _ in found if k in ("class", "interface", "enum", "type")]
    for at, kind, name, end, m, g in found:
        owner = next((t for t in reversed(types) if t[0] < at <= t[1]), None)
        full = f"{owner[2]}.{name}" if kind == "method" and owner else name
        if prefix:
            full = prefix(m, full, types)
        if (full, at) in seen:
            continue
        seen.add((full, at))
        first = (_names(g.get("ext")) or [None])[0]
        out.append(_symbol(full, kind, _line(masked, at), max(_line(masked, at), _line(masked, end)), exported(m, name), first, _names(g.get("impl")), calls_in(masked, m.end(), end, None if self_calls else name) if kind in ("function", "method") else []))
    return out


# ---- languages -------------------------------------------------------------------------------------------


def script(text: str, _: str = "") -> Result:
    """TypeScript and JavaScript, with CommonJS requires and re-exports."""
    masked, r = mask(text, "c"), empty()
    specs = [(m.start(), m.group(1)) for m in re.finditer(r"(?:\bfrom|\bimport|\brequire\s*\(|\bimport\s*\()\s*['\"]([^'\"\n]+)['\"]", text)]
    specs = [(a, s) for a, s in specs if masked[a : a + 4].strip()]
    r["imports"] = [{"specifier": s, "is_bonus": False} for s in dict.fromkeys(s for _, s in specs)]
    rules = [
        ("class", r"^\s*(?P<x>export\s+(?:default\s+)?)?(?:declare\s+)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)(?:<[^{]*?>)?(?:\s+extends\s+(?P<ext>[\w$.]+)(?:<[^{]*?>)?)?(?:\s+implements\s+(?P<impl>[^{]+))?"),
        ("interface", r"^\s*(?P<x>export\s+)?(?:declare\s+)?interface\s+(?P<name>[\w$]+)(?:<[^{]*?>)?(?:\s+extends\s+(?P<ext>[^{]+))?"),
        ("type", r"^\s*(?P<x>export\s+)?(?:declare\s+)?(?:type\s+(?P<name>[\w$]+)(?:<[^=]*>)?\s*=)"),
        ("enum", r"^\s*(?P<x>export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(?P<name>[\w$]+)"),
        ("function", r"^\s*(?P<x>export\s+(?:default\s+)?)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)"),
        ("function", r"^\s*(?P<x>export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::\s*[^=\n]+)?=>"),
        ("constant", r"^(?P<x>export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=(?!\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::\s*[^=\n]+)?=>)"),
        ("method", r"^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*(?!(?:if|for|while|switch|catch|return|function|await|else|do|try|new|super)\b)(?P<name>[\w$]+)\s*(?:<[^>(]*>)?\([^;{}]*\)\s*(?::\s*[^;{}=]+)?\{"),
    ]
    listed = {n.split(" as ")[-1].strip() for block in re.findall(r"^\s*export\s*\{([^}]*)\}\s*;?\s*$", masked, re.MULTILINE) for n in block.split(",")}
    symbols = _declared(masked, rules, lambda m, n: bool(m.groupdict().get("x")) or n in listed)
    symbols = [s for s in symbols if s["kind"] != "method" or "." in s["name"]]
    again = [n.split(" as ")[-1].strip() for block in re.findall(r"export\s*(?:type\s*)?\{([^}]*)\}\s*from", masked) for n in block.split(",") if n.strip()]
    stars = len(re.findall(r"^\s*export\s*\*", masked, re.MULTILINE))
    r["symbols"] = symbols
    r["exports"] = list(dict.fromkeys([s["name"] for s in symbols if s["is_exported"] and s["kind"] != "method"] + sorted(x for x in listed if x) + again))
    r["has_default_export"] = bool(re.search(r"^\s*export\s+default\b|^\s*module\.exports\s*=", masked, re.MULTILINE))
    total = len(r["exports"]) + stars
    r["reexport_ratio"] = round((len(again) + stars) / total, 3) if total else None
    if "angular.module" in text:
        names = re.findall(r"\.(?:controller|service|factory|directive|component|filter|provider|value|constant)\s*\(\s*['\"]([^'\"]+)['\"]", text) + re.findall(r"\bthis\.([A-Za-z_$][\w$]*)\s*=", text) + re.findall(r"\$scope\.([A-Za-z_$][\w$]*)\s*=", text)
        r["symbols"] += [_symbol(n, "constant", 1, 1, True) for n in dict.fromkeys(names)]
    _qualify(r)
    return r


def _qualify(r: Result) -> None:
    """Calls of symbols of the same file get their qualified name, those of the own class first."""
    by_last: dict[str, list[str]] = {}
    for s in r["symbols"]:
        by_last.setdefault(s["name"].rsplit(".", 1)[-1], []).append(s["name"])
    for s in r["symbols"]:
        scope = s["name"].rpartition(".")[0]
        for c in s["calls"]:
            own = by_last.get(c["callee"])
            if own:
                c["callee"] = "#" + (f"{scope}.{c['callee']}" if f"{scope}.{c['callee']}" in own else own[0])


def python(text: str, path: str = "") -> Result:
    r = empty()
    tree = ast.parse(text)
    imports: list[tuple[str, bool]] = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports += [(a.name, False) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            base = "." * node.level + (node.module or "")
            imports.append((base, False))
            imports += [(base + ("" if base.endswith(".") else ".") + a.name, True) for a in node.names if a.name != "*"]
    r["imports"] = [{"specifier": s, "is_bonus": b} for s, b in dict.fromkeys(imports)]

    def called(fn: ast.AST) -> list[tuple[str, int]]:
        out: dict[str, int] = {}
        for n in ast.walk(fn):
            if isinstance(n, ast.Call):
                name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else None
                if name:
                    out[name] = min(out.get(name, n.lineno), n.lineno)
        return sorted(out.items(), key=lambda x: x[1])

    public = None
    for node in tree.body:
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, ast.List | ast.Tuple):
            public = [e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
    shown = lambda n: n in public if public is not None else not n.startswith("_")
    name_of = lambda b: b.id if isinstance(b, ast.Name) else b.attr if isinstance(b, ast.Attribute) else None
    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            r["symbols"].append(_symbol(node.name, "function", node.lineno, node.end_lineno, shown(node.name), calls=called(node)))
        elif isinstance(node, ast.ClassDef):
            bases = [b for b in map(name_of, node.bases) if b]
            r["symbols"].append(_symbol(node.name, "class", node.lineno, node.end_lineno, shown(node.name), bases[0] if bases else None, bases[1:]))
            r["symbols"] += [_symbol(f"{node.name}.{m.name}", "method", m.lineno, m.end_lineno, False, calls=called(m)) for m in node.body if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef)]
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            r["symbols"] += [_symbol(t.id, "constant", node.lineno, node.end_lineno, shown(t.id)) for t in targets if isinstance(t, ast.Name) and re.fullmatch(r"[A-Z][A-Z0-9_]*", t.id)]
    r["exports"] = public if public is not None else [s["name"] for s in r["symbols"] if s["is_exported"]]
    # references by convention: dotted strings of settings, included routes, modules loaded by name
    dotted = r"['\"]([A-Za-z_]\w*(?:\.\w+)+)['\"]"
    refs = [("settings", v) for block in re.findall(r"^(?:MIDDLEWARE|INSTALLED_APPS|AUTHENTICATION_BACKENDS|ROOT_URLCONF|WSGI_APPLICATION)\s*=\s*(\[[^\]]*\]|\([^)]*\)|['\"][^'\"]+['\"])", text, re.MULTILINE) for v in re.findall(dotted, block)]
    refs += [("include", v) for v in re.findall(r"\binclude\(\s*" + dotted, text)] + [("importlib", v) for v in re.findall(r"\bimport_module\(\s*" + dotted, text)]
    r["refs"] = [{"kind": k, "value": v} for k, v in dict.fromkeys(refs)]
    return r


# Names of the standard library that are no references of a project.
_JDK = frozenset("String Object Integer Long Double Float Boolean Byte Short Character Math System List Map Set Collection Iterable Exception RuntimeException Override Deprecated Thread Runnable Number Void Class Enum Record Comparable StringBuilder".split())


def java(text: str, _: str = "") -> Result:
    masked, r = mask(text, "c"), empty()
    m = re.search(r"^\s*package\s+([\w.]+)\s*;", masked, re.MULTILINE)
    r["package_name"] = m[1] if m else None
    named = [s for s in re.findall(r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", masked, re.MULTILINE)]
    mod = r"(?:(?:public|protected|private|static|final|abstract|sealed|synchronized|native|default|strictfp|transient|volatile)\s+)*"
    rules = [
        ("class", rf"^\s*(?P<m>{mod})(?:class|record)\s+(?P<name>\w+)(?:<[^{{]*?>)?(?:\s*\([^)]*\))?(?:\s+extends\s+(?P<ext>[\w.<>, ]+?))?(?:\s+implements\s+(?P<impl>[^{{]+))?\s*(?=\{{)"),
        ("interface", rf"^\s*(?P<m>{mod})@?interface\s+(?P<name>\w+)(?:<[^{{]*?>)?(?:\s+extends\s+(?P<ext>[^{{]+))?\s*(?=\{{)"),
        ("enum", rf"^\s*(?P<m>{mod})enum\s+(?P<name>\w+)(?:\s+implements\s+(?P<impl>[^{{]+))?\s*(?=\{{)"),
        ("method", rf"^[ \t]+(?P<m>{mod})(?:<[^>]+>\s+)?(?!(?:return|new|else|throw|case)\b)[\w.]++(?:<[^;(){{}}=]*>)?(?:\[\])*+\s+(?P<name>\w+)\s*\([^;{{}}]*\)\s*(?:throws [\w., ]+)?(?=\{{|;)"),
        ("constant", r"^\s*(?P<m>(?:(?:public|protected|private)\s+)?static\s+final\s+)[\w.]++(?:<[^;(){}=]*>)?(?:\[\])*+\s+(?P<name>[A-Z][A-Z0-9_]*)\s*="),
    ]
    r["symbols"] = _declared(masked, rules, lambda m, n: "public" in (m.groupdict().get("m") or ""))
    r["exports"] = [s["name"] for s in r["symbols"] if s["is_exported"]]
    known = {s.rsplit(".", 1)[-1] for s in named} | {s["name"] for s in r["symbols"]}
    if r["package_name"]:
        bare = dict.fromkeys(x for x in re.findall(r"(?<![\w.@])([A-Z]\w+)(?=\s*(?:[<.\s]\s*[a-z<]|\())", masked) if x not in known and x not in _JDK)
        same = [f"{r['package_name']}.{b}" for b in bare]
    else:
        same = []
    r["imports"] = [{"specifier": s, "is_bonus": b} for s, b in dict.fromkeys([(s, False) for s in named if not s.endswith(".*")] + [(s, True) for s in same])]
    return r


def kotlin(text: str, _: str = "") -> Result:
    masked, r = mask(text, "c"), empty()
    m = re.search(r"^\s*package\s+([\w.]+)", masked, re.MULTILINE)
    r["package_name"] = m[1] if m else None
    r["imports"] = [{"specifier": s, "is_bonus": False} for s in dict.fromkeys(re.findall(r"^\s*import\s+([\w.]+)(?!\.\*)", masked, re.MULTILINE))]
    mod = r"(?:(?:public|private|internal|protected|open|abstract|data|sealed|inline|suspend|override|enum|companion|operator|const|lateinit)\s+)*"
    rules = [
        ("class", rf"^\s*(?P<m>{mod})(?:class|object)\s+(?P<name>\w+)(?:<[^{{(]*?>)?(?:\s*\([^{{]*?\))?(?:\s*:\s*(?P<ext>\w+)[^{{\n]*)?"), ("interface", rf"^\s*(?P<m>{mod})interface\s+(?P<name>\w+)"),
        ("function", rf"^(?P<m>{mod})fun\s+(?:<[^>]+>\s*)?(?:[\w.]+\.)?(?P<name>\w+)\s*\("), ("method", rf"^[ \t]+(?P<m>{mod})fun\s+(?:<[^>]+>\s*)?(?P<name>\w+)\s*\("), ("constant", rf"^\s*(?P<m>{mod})val\s+(?P<name>[A-Z][A-Z0-9_]+)\s*[:=]"),
    ]
    r["symbols"] = _declared(masked, rules, lambda m, n: "private" not in (m.groupdict().get("m") or "") and "internal" not in (m.groupdict().get("m") or ""))
    r["exports"] = [s["name"] for s in r["symbols"] if s["is_exported"]]
    return r


def go(text: str, _: str = "") -> Result:
    masked, r = mask(text, "c"), empty()
    m = re.search(r"^package\s+(\w+)", masked, re.MULTILINE)
    r["package_name"] = m[1] if m else None
    block = "\n".join(re.findall(r"^import\s*\(([^)]*)\)", text, re.MULTILINE)) + "\n" + "\n".join(re.findall(r"^import\s+((?:[\w.]+\s+)?\"[^\"]+\")", text, re.MULTILINE))
    r["imports"] = [{"specifier": s, "is_bonus": False} for s in dict.fromkeys(re.findall(r'"([^"]+)"', block))]
    rules = [
        ("interface", r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b"), ("class", r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b"), ("type", r"^type\s+(?P<name>\w+)\s+=?\s*(?!struct\b|interface\b)[\w*\[\]]"),
        ("function", r"^func\s+(?P<name>\w+)\s*[\[(]"), ("method", r"^func\s+\(\s*(?:\w+\s+)?\*?(?P<recv>\w+)(?:\[[^\]]*\])?\s*\)\s*(?P<name>\w+)\s*\("), ("constant", r"^(?:const|var)\s+(?P<name>[A-Z]\w*)\b"),
    ]
    r["symbols"] = _declared(masked, rules, lambda m, n: n[:1].isupper(), lambda m, full, _t: f"{m.group('recv')}.{m.group('name')}" if "recv" in m.groupdict() and m.group("recv") else full)
    r["exports"] = [s["name"] for s in r["symbols"] if s["is_exported"] and s["kind"] != "method"]
    return r


def rust(text: str, _: str = "") -> Result:
    masked, r = mask(text, "rust"), empty()
    uses = []
    for m in re.finditer(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", masked, re.MULTILINE):
        flat = re.sub(r"\s+", "", re.sub(r"\bas\s+\w+", "", m[1]))
        head, _, inner = flat.partition("{")
        uses += [head + i for i in inner.rstrip("}").split(",") if i] if inner else [flat]
    mods = re.findall(r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;", masked, re.MULTILINE)
    r["imports"] = [{"specifier": s, "is_bonus": False} for s in dict.fromkeys(mods + [u if "::" in u else u + "::" for u in uses])]
    pub = r"(?P<p>pub(?:\([^)]*\))?\s+)?"
    rules = [
        ("class", rf"^\s*{pub}(?:struct|union)\s+(?P<name>\w+)"), ("enum", rf"^\s*{pub}enum\s+(?P<name>\w+)"), ("interface", rf"^\s*{pub}(?:unsafe\s+)?trait\s+(?P<name>\w+)"), ("type", rf"^\s*{pub}type\s+(?P<name>\w+)"),
        ("function", rf"^\s*{pub}(?:const\s+|async\s+|unsafe\s+|extern\s+)*fn\s+(?P<name>\w+)"), ("constant", rf"^\s*{pub}(?:const|static)\s+(?:mut\s+)?(?P<name>[A-Z]\w*)\s*:"),
    ]
    r["symbols"] = _declared(masked, rules, lambda m, n: bool(m.group("p")))
    spans = [(m[1], m.start(), _close(masked, m.end())) for m in re.finditer(r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>', ]+\s+for\s+)?(\w+)", masked, re.MULTILINE)]
    for s in r["symbols"]:
        for owner, a, e in spans:
            if s["kind"] == "function" and _line(masked, a) <= s["start_line"] and s["end_line"] <= _line(masked, e):
                s["name"], s["kind"] = f"{owner}.{s['name']}", "method"
                break
    r["exports"] = [s["name"] for s in r["symbols"] if s["is_exported"] and s["kind"] != "method"]
    return r


def csharp(text: str, _: str = "") -> Result:
    masked, r = mask(text, "c"), empty()
    m = re.search(r"^\s*namespace\s+([\w.]+)", masked, re.MULTILINE)
    r["package_name"] = m[1] if m else None
    r["imports"] = [{"specifier": s, "is_bonus": False} for s in dict.fromkeys(re.findall(r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;", masked, re.MULTILINE))]
    mod = r"(?:(?:public|private|protected|internal|static|abstract|sealed|partial|readonly|override|virtual|async|new|unsafe|const)\s+)*"
    rules = [
        ("class", rf"^\s*(?P<m>{mod})(?:class|struct|record)\s+(?P<name>\w+)(?:<[^{{:]*>)?(?:\s*:\s*(?P<ext>[^{{,\n]+)(?:,(?P<impl>[^{{\n]+))?)?"), ("interface", rf"^\s*(?P<m>{mod})interface\s+(?P<name>\w+)"), ("enum", rf"^\s*(?P<m>{mod})enum\s+(?P<name>\w+)"),
        ("method", rf"^[ \t]+(?P<m>{mod})(?!(?:return|new|else|throw|await)\b)[\w.?]++(?:<[^;(){{}}=]*>)?(?:\[\])*+\??\s+(?P<name>\w+)\s*(?:<[^>(]*>)?\([^;{{}}]*\)\s*(?=\{{|=>)"),
    ]
    r["symbols"] = _declared(masked, rules, lambda m, n: "public" in (m.groupdict().get("m") or ""))
    r["exports"] = [s["name"] for s in r["symbols"] if s["is_exported"]]
    r["refs"] = [{"kind": "partial", "value": n} for n in dict.fromkeys(re.findall(r"\bpartial\s+(?:class|struct|interface|record)\s+(\w+)", masked))]
    return r


# Fixed value: headers of the standard libraries that name no file of a project.
_STD_HEADERS = re.compile(r"^(?:[a-z_]+|c[a-z]+|std[a-z]+\.h|(?:assert|ctype|errno|float|limits|locale|math|setjmp|signal|string|time|unistd|pthread)\.h|(?:sys|linux|boost|gtest|gmock|windows)/.*)$")


def cpp(text: str, _: str = "") -> Result:
    masked, r = mask(text, "c"), empty()
    inc = re.findall(r"^\s*#\s*include\s*(\"[^\"]+\"|<[^>]+>)", text, re.MULTILINE)
    r["imports"] = [{"specifier": s, "is_bonus": False} for s in dict.fromkeys(i[1:-1] for i in inc if i[0] == '"' or not _STD_HEADERS.match(i[1:-1]))]
    rules = [
        ("class", r"^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct)\s+(?P<name>\w+)(?:\s+final)?(?:\s*:\s*(?:public|protected|private)?\s*(?P<ext>[\w:]+)[^{;]*)?\s*(?=\{)"), ("enum", r"^\s*enum\s+(?:class\s+)?(?P<name>\w+)"),
        ("function", r"^(?!\s*(?:return|else|if|for|while|switch)\b)[\w:<>*&,~ \t]+?[\s*&](?P<name>(?:\w+::)*~?\w+)\s*\([^;{}]*\)\s*(?:const|noexcept|override|\s)*(?=\{)"),
    ]
    r["symbols"] = _declared(masked, rules, lambda m, n: True, self_calls=True)
    r["exports"] = [s["name"] for s in r["symbols"]]
    return r


def php(text: str, _: str = "") -> Result:
    masked, r = mask(text, "php"), empty()
    m = re.search(r"^\s*(?:<\?php\s+)?namespace\s+([\w\\]+)", masked, re.MULTILINE)
    r["package_name"] = m[1] if m else None
    uses = []
    for u in re.findall(r"^\s*use\s+(?:function\s+|const\s+)?([\w\\]+(?:\s*\{[^}]*\})?)(?:\s+as\s+\w+)?\s*;", masked, re.MULTILINE):
        head, _, inner = u.partition("{")
        uses += [head.strip() + i.strip().split(" as ")[0] for i in inner.rstrip("}").split(",")] if inner else [head.strip()]
    uses += re.findall(r"(?:require|include)(?:_once)?\s*\(?\s*(?:__DIR__\s*\.\s*)?['\"]([^'\"]+)['\"]", text)
    r["imports"] = [{"specifier": s, "is_bonus": False} for s in dict.fromkeys(uses)]
    mod = r"(?:(?:public|private|protected|static|abstract|final|readonly)\s+)*"
    rules = [
        ("class", rf"^\s*{mod}(?:class|enum|trait)\s+(?P<name>\w+)(?:\s+extends\s+(?P<ext>[\w\\]+))?(?:\s+implements\s+(?P<impl>[^{{]+))?"), ("interface", r"^\s*interface\s+(?P<name>\w+)"),
        ("function", r"^function\s+(?P<name>\w+)"), ("method", rf"^[ \t]+(?P<m>{mod})function\s+&?(?P<name>\w+)"),
    ]
    r["symbols"] = _declared(masked, rules, lambda m, n: "private" not in (m.groupdict().get("m") or ""))
    r["exports"] = [s["name"] for s in r["symbols"] if s["kind"] != "method"]
    full = {u.rsplit("\\", 1)[-1]: u for u in uses}
    rel = re.findall(r"->\s*(?:hasOne|hasMany|belongsTo|belongsToMany|morphMany|morphOne|hasManyThrough)\s*\(\s*\\?([\w\\]+)::class", masked)
    box = re.findall(r"(?:\bapp|\bresolve|->make|->bind|->singleton)\s*\(\s*\\?([\w\\]+)::class", masked)
    r["refs"] = [{"kind": k, "value": full.get(v, v)} for k, v in dict.fromkeys([("eloquent", v) for v in rel] + [("container", v) for v in box])]
    return r


def ruby(text: str, _: str = "") -> Result:
    masked, r = mask(text, "ruby"), empty()
    req = re.findall(r"^\s*require\s+['\"]([^'\"]+)['\"]", text, re.MULTILINE)
    rel = ["./" + s if not s.startswith(".") else s for s in re.findall(r"^\s*require_relative\s+['\"]([^'\"]+)['\"]", text, re.MULTILINE)]
    r["imports"] = [{"specifier": s, "is_bonus": False} for s in dict.fromkeys(req + rel)]
    stack: list[tuple[str, dict | None]] = []
    refs: dict[str, None] = {}
    private = False
    for n, line in enumerate(masked.split("\n"), 1):
        s = line.strip()
        scope = "::".join(x for x, _ in stack if x)
        if m := re.match(r"(class|module)\s+([A-Z][\w:]*)(?:\s*<\s*([A-Z][\w:]*))?", s):
            full = f"{scope}::{m[2]}" if scope else m[2]
            sym = _symbol(full, "class", n, n, True, m[3])
            r["symbols"].append(sym)
            stack.append((m[2], sym))
            private = False
        elif m := re.match(r"def\s+(?:self\.)?([\w?!=]+)", s):
            sym = _symbol(f"{scope}::{m[1]}" if scope else m[1], "method" if scope else "function", n, n, not private)
            r["symbols"].append(sym)
            if not re.search(r"\bend\s*$|=\s*\S", s[m.end() :]):
                stack.append(("", sym))
        elif m := re.match(r"([A-Z][A-Z0-9_]*)\s*=", s):
            r["symbols"].append(_symbol(f"{scope}::{m[1]}" if scope else m[1], "constant", n, n, True))
        elif re.match(r"private\s*$", s):
            private = True
        elif re.match(r"(?:if|unless|while|until|case|begin|for)\b", s) or re.search(r"\bdo\s*(?:\|[^|]*\|)?\s*$", s):
            stack.append(("", None))
        if re.match(r"end\b", s) and stack:
            _, sym = stack.pop()
            if sym:
                sym["end_line"] = n
        for c in re.findall(r"(?<![\w:])([A-Z]\w*(?:::[A-Z]\w*)*)", s):
            nest = scope.split("::") if scope else []
            refs["|".join(["::".join(nest[:k] + [c]) for k in range(len(nest), -1, -1)])] = None
        if (own := next((x for _, x in reversed(stack) if x and x["kind"] != "class"), None)) is not None and own["start_line"] != n:
            have = {c["callee"] for c in own["calls"]}
            own["calls"] += [{"callee": c, "line": n} for c in dict.fromkeys(re.findall(r"(?:^|[\s.(])([a-z_]\w*[?!]?)\s*\(", s)) if c not in have and c not in _NO_CALL]
    r["exports"] = [s["name"] for s in r["symbols"] if s["is_exported"]]
    r["refs"] = [{"kind": "constant", "value": v} for v in refs]
    return r


def groovy(text: str, _: str = "") -> Result:
    r = empty()
    names: dict[str, int] = {}
    for pattern in (r"^\s*task\s*\(?\s*['\"]?(\w+)", r"^\s*(?:implementation|api|compileOnly|runtimeOnly|testImplementation|annotationProcessor)\b[^\n]*?name:\s*['\"]([^'\"]+)['\"]", r"^\s*(?:implementation|api|compileOnly|runtimeOnly|testImplementation|annotationProcessor)\s*\(?\s*['\"][^:'\"]+:([^:'\"]+)", r"^\s*id\s*\(?\s*['\"]([^'\"]+)['\"]", r"\bstage\s*\(\s*['\"]([^'\"]+)['\"]", r"^\s*(?:def|void|class)\s+(\w+)"):
        for m in re.finditer(pattern, text, re.MULTILINE):
            names.setdefault(m[1], _line(text, m.start(1)))
    return _keys(r, sorted(names.items(), key=lambda x: (x[1], x[0])))


def _keys(r: Result, names: list[tuple[str, int]]) -> Result:
    first: dict[str, int] = {}
    for n, line in names:
        first.setdefault(n, line)
    r["symbols"] = [_symbol(n, "constant", line, line, True) for n, line in first.items()]
    r["exports"] = list(first)
    return r


def yaml(text: str, _: str = "") -> Result:
    """Top-level keys and those one level below, as ``key`` and ``key.sub``."""
    out, top, indent = [], None, None
    for n, line in enumerate(text.split("\n"), 1):
        m = re.match(r"^(\s*)([A-Za-z_][\w-]*)\s*:(?:\s|$)", line)
        if line.startswith("- ") or line.startswith("---"):
            top = None
        if not m:
            continue
        if not m[1]:
            top, indent = m[2], None
            out.append((top, n))
        elif top and (indent is None or len(m[1]) == indent):
            indent = len(m[1])
            out.append((f"{top}.{m[2]}", n))
    return _keys(empty(), out)


def toml(text: str, _: str = "") -> Result:
    out, section = [], None
    for n, line in enumerate(text.split("\n"), 1):
        if m := re.match(r"^\s*\[\[?\s*([\w.\"'-]+)\s*\]\]?", line):
            section = m[1].replace('"', "").replace("'", "")
            out.append((section, n))
        elif m := re.match(r"^\s*([\w.\"'-]+)\s*=", line):
            key = m[1].replace('"', "").replace("'", "")
            out.append((f"{section}.{key}" if section else key, n))
    return _keys(empty(), out)


def xml(text: str, _: str = "") -> Result:
    """Values of id, name, key and ref attributes (also with a namespace), last part of class, text of artifactId and groupId."""
    found = []
    for m in re.finditer(r"(?:[\w-]+:)?\b(id|name|key|ref|class)\s*=\s*(\"[^\"]*\"|'[^']*')", text):
        v = m[2][1:-1]
        v = v.rsplit(".", 1)[-1] if m[1] == "class" else v
        if v:
            found.append((m.start(), v))
    found += [(m.start(), m[2].strip()) for m in re.finditer(r"<(artifactId|groupId)>([^<]+)</\1>", text) if m[2].strip()]
    return _keys(empty(), [(v, _line(text, a)) for a, v in sorted(found)])


def env(text: str, _: str = "") -> Result:
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        if m := re.match(r"^\s*(?:export\s+)?([A-Za-z_]\w*)(?:\s*=|\s*$)", line.split("#", 1)[0]):
            out.append((m[1], n))
    return _keys(empty(), out)


def graphql(text: str, _: str = "") -> Result:
    r = empty()
    r["imports"] = [{"specifier": s, "is_bonus": False} for s in re.findall(r"^\s*#\s*import\s+['\"]([^'\"]+)['\"]", text, re.MULTILINE)]
    body = re.sub(r"#[^\n]*", lambda m: " " * len(m.group()), text)
    kinds = {"fragment": "constant", "query": "function", "mutation": "function", "subscription": "function", "interface": "interface", "enum": "type", "union": "type", "scalar": "type", "input": "class", "type": "class"}
    seen = set()
    for m in re.finditer(r"\b(query|mutation|subscription|fragment|type|interface|enum|input|scalar|union)\s+([A-Za-z_]\w*)\b", body):
        if m[2] not in seen:
            seen.add(m[2])
            start = body.find("{", m.start())
            end = _close(body, m.start()) if 0 <= start < m.start() + 200 else m.start()
            r["symbols"].append(_symbol(m[2], kinds[m[1]], _line(body, m.start()), _line(body, end), True))
    r["exports"] = [s["name"] for s in r["symbols"]]
    return r


def component(text: str, path: str = "") -> Result:
    """Single-file components: their script blocks (or front matter) as one script; lines are those of the blocks joined."""
    blocks = re.findall(r"(?is)<script[^>]*>(.*?)</script>", text)
    if m := re.match(r"\A---\n(.*?)\n---", text, re.DOTALL):
        blocks.insert(0, m[1])
    return script("\n".join(blocks), path) if blocks else empty()


EXTRACTORS: dict[str, Callable[[str, str], Result]] = {
    "typescript": script, "javascript": script, "python": python, "java": java, "kotlin": kotlin, "go": go, "rust": rust, "csharp": csharp, "cpp": cpp, "php": php, "ruby": ruby, "groovy": groovy,
    "yaml": yaml, "toml": toml, "xml": xml, "env": env, "graphql": graphql, "vue": component, "svelte": component, "astro": component,
}


def extract_text(text: str | None, language: str | None, path: str = "") -> Result:
    f = EXTRACTORS.get(language or "")
    if not f or not text:
        return empty()
    try:
        return f(text, path)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return empty()


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [{"file_id": f, **extract_text(t, lang, f)} for f, t, lang in zip(pdf["file_id"], pdf["text"], pdf["language"], strict=True)]
        yield pd.DataFrame(rows, columns=["file_id", "package_name", "has_default_export", "reexport_ratio", "imports", "exports", "symbols", "refs"])


def extract(files: DataFrame) -> DataFrame:
    """Extraction of ``file_id, language, text``; one row a file, texts never leave their task."""
    return files.select("file_id", "text", "language").mapInPandas(_extract, SCHEMA)


def symbols_of(extracted: DataFrame) -> DataFrame:
    s = extracted.select("file_id", F.explode("symbols").alias("s")).select("file_id", "s.*")
    return s.withColumn("symbol_id", F.concat("file_id", F.lit("#"), "name"))


def calls_of(extracted: DataFrame) -> DataFrame:
    """(symbol_id, file_id, callee, line): calls inside the file carry its qualified id."""
    c = symbols_of(extracted).select("symbol_id", "file_id", F.explode("calls").alias("c"))
    return c.select("symbol_id", "file_id", F.when(F.col("c.callee").startswith("#"), F.concat("file_id", "c.callee")).otherwise(F.col("c.callee")).alias("callee"), F.col("c.line").alias("line"))


def imports_of(extracted: DataFrame, languages: DataFrame) -> DataFrame:
    return extracted.select("file_id", F.explode("imports").alias("i")).select("file_id", "i.*").join(languages.select("file_id", "language"), "file_id")


class _Extract:
    """The table function ``extract(content, language)``."""

    def eval(self, content: str, language: str):
        r = extract_text(content, language)
        for s in r["symbols"]:
            yield s["name"], s["kind"], s["start_line"], s["end_line"], s["is_exported"]


def register(spark: SparkSession) -> None:
    """SQL surface: the table function and the scalar functions by name."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("extract", udtf(_Extract, returnType="name string, kind string, start_line int, end_line int, is_exported boolean"))
    for name, sql in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{sql}")


#: Scalar functions as SQL, for queries in text.
SQL_FUNCTIONS = {
    "fold_sep": "(s STRING) RETURNS STRING RETURN translate(s, '-_', '')",
    "squash": "(s STRING) RETURNS STRING RETURN regexp_replace(lower(s), '[-_/.\\\\s]+', '')",
    "token_estimate": "(s STRING) RETURNS BIGINT RETURN CAST(ceil(length(s) / 4) AS BIGINT)",
    "line_count": "(s STRING) RETURNS INT RETURN size(split(s, '\\n', -1))",
    "short_sha256": "(s STRING) RETURNS STRING RETURN concat('sha256:', substr(sha2(s, 256), 1, 12))",
    "slugify": "(s STRING) RETURNS STRING RETURN regexp_replace(substr(regexp_replace(regexp_replace(lower(s), '[^a-z0-9]+', '-'), '^-+|-+$', ''), 1, 60), '-+$', '')",
    "is_code_shaped": "(s STRING) RETURNS BOOLEAN RETURN s rlike '[0-9_-]' OR substr(s, 2) rlike '[A-Z]'",
    "idf_find": "(df BIGINT, n BIGINT) RETURNS DOUBLE RETURN ln(1 + (n - df + 0.5D) / (df + 0.5D))",
}
