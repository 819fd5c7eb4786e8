"""Import and call resolution: base paths with an ordinal, one equality join, the least ordinal wins.

Every rule of a language turns a specifier into an ordered array of base paths inside the plan. Extensions and index files are not
tried one by one: ``probe_index`` holds every file once under each base it answers to, with the place of its
extension, so a base is one key of one join, and ``min_by`` takes the first base that has a file. No rule looks at the file
system, and "the first file wins" always means the least id, so results don't depend on any order of reading.

Ids are paths from the root of the indexed tree, the repository being the first segment; walks towards the root
stop at ``root_depth`` segments (1: at the repository). Scopes (aliases, modules, manifests, gems, crates, include
roots) are tables keyed by the directory they govern and join on exploded ancestors or prefixes, never by a range.

Defined cases: null specifiers resolve to null; a specifier that leaves the root stops at it; repeated imports
resolve once; an empty scope table resolves nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import top_k

# Order in which extensions and index files are tried.
EXTENSIONS = ".ts .tsx .mts .cts .d.ts .js .jsx .mjs .cjs .py .go .rs .java .cs .cpp .c .h .hpp .rb .php .swift .kt .dart".split()
INDEX_FILES = "index.ts index.tsx index.js index.jsx index.mjs index.cjs index.py index.go __init__.py mod.rs".split()
JS_TO_TS = {".js": [".ts", ".tsx"], ".jsx": [".tsx"], ".mjs": [".mts"], ".cjs": [".cts"]}
RUBY_ROOTS = ["lib", "app", "spec", "test"]
JVM_MARKERS = ["src/main/java/", "src/test/java/", "src/main/kotlin/", "src/test/kotlin/", "src/"]


#: Columns of the scope tables; one that isn't given is empty.
SCOPES = {
    "aliases": "scope string, prefix string, target string, ord int", "modules": "scope string, kind string, name string, dir string, ord int", "psr4": "scope string, prefix string, dir string, ord int",
    "gems": "scope string, name string, lib string, ord int", "crates": "scope string, name string, src string", "include_roots": "scope string, dir string, ord int",
}


def _no_scope(imports: DataFrame, name: str) -> DataFrame:
    """An empty scope table that the optimizer knows to be empty."""
    return imports.sparkSession.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in SCOPES[name].split(", "))]).where(F.lit(False))


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(path: Column) -> Column:
    """``.`` and empty segments out, ``..`` takes one back; what leaves the root stays at it."""
    none = F.array().cast("array<string>")
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s))
    return F.array_join(F.aggregate(F.split(path, "/", -1), none, step), "/")


def dirname(path: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(path), r"^[^/]*$", ""), "/[^/]*$", "")


def join_path(*parts: Column) -> Column:
    return normalize(F.concat_ws("/", *parts))


def exact(path: Column) -> Column:
    """Key of a path as it stands."""
    return F.concat(F.lit("="), path)


def probe(base: Column) -> Column:
    """Key of a base path: itself where it has an extension, else whatever extension or index file completes it."""
    ext = F.regexp_extract(base, r"(?<=[^/])(\.[^./]+)$", 1)
    return F.when(ext != "", exact(base)).otherwise(F.concat(F.lit("~"), base))


def probe_index(files: DataFrame) -> DataFrame:
    """``key, target``: the file that a key finds first.

    A path finds itself, a JavaScript path then its TypeScript sources, a base without extension first the extensions and then the index files, each in their order.
    """
    f = F.col("file_id")
    none = F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("place"))
    entry = lambda key, place: F.struct(key.alias("key"), F.lit(place).alias("place"))
    without = lambda end: F.substring(f, F.lit(1), F.length(f) - len(end))
    keys = [entry(exact(f), 0)]
    keys += [F.when(f.endswith(alt), entry(F.concat(F.lit("="), without(alt), F.lit(js)), n)).otherwise(none) for js, alts in JS_TO_TS.items() for n, alt in enumerate(alts, 1)]
    keys += [F.when(f.endswith(e), entry(F.concat(F.lit("~"), without(e)), n)).otherwise(none) for n, e in enumerate(EXTENSIONS)]
    keys += [F.when(f.endswith("/" + i), entry(F.concat(F.lit("~"), without("/" + i)), len(EXTENSIONS) + n)).otherwise(none) for n, i in enumerate(INDEX_FILES)]
    rows = files.where("file_id is not null").select("file_id", F.explode(F.filter(F.array(*keys), lambda k: k["key"].isNotNull())).alias("k"))
    return rows.groupBy("k.key").agg(F.min(F.struct("k.place", "file_id")).alias("b")).select("key", F.col("b.file_id").alias("target"))


def ancestors(directory: Column, root_depth: int = 1) -> Column:
    """A directory and those above it, nearest first, down to ``root_depth`` segments."""
    parts = F.filter(F.split(directory, "/", -1), lambda s: s != "")
    depth = F.size(parts)
    n = F.when(depth < root_depth, F.array(depth)).otherwise(F.reverse(F.sequence(F.lit(root_depth), F.greatest(depth, F.lit(root_depth)))))
    return F.transform(n, lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def prefixes(specifier: Column, sep: str) -> Column:
    """All prefixes of a specifier at ``sep``, longest first."""
    parts = F.split(specifier, sep.replace("\\", "\\\\").replace(".", "\\."), -1)
    joiner = sep
    return F.transform(F.reverse(F.sequence(F.lit(1), F.size(parts))), lambda k: F.array_join(F.slice(parts, 1, k), joiner))


def first_hit(imports: DataFrame, bases: Column, files: DataFrame) -> DataFrame:
    """``file_id, specifier, target``: what the first of the keys of ``bases`` finds, null if none finds a file."""
    keys = imports.select("file_id", "specifier").distinct()
    rows = imports.select("file_id", "specifier", F.posexplode(bases).alias("ordinal", "key"))
    hits = rows.join(probe_index(files), "key").groupBy("file_id", "specifier").agg(F.min_by("target", "ordinal").alias("target"))
    return keys.join(hits, ["file_id", "specifier"], "left")


def _least(rows: DataFrame, target: str, *order: str) -> DataFrame:
    return rows.groupBy("file_id", "specifier").agg(F.min(F.struct(*order, F.col(target).alias("_t"))).alias("b")).select("file_id", "specifier", F.col("b._t").alias("target"))


def resolve_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Specifiers that begin with ``.`` or ``/``, from the importing file's directory."""
    rel = imports.where("specifier like '.%' or specifier like '/%'")
    return first_hit(rel, F.array(probe(join_path(dirname("file_id"), F.col("specifier")))), files)


def resolve_alias(imports: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """Other specifiers by ``aliases(scope, prefix, target, ord)``: the longest prefix of the nearest scope alone counts,
    its targets are tried in order, and none of them means null. A target that begins with ``/`` is a path from the root, others are relative to the scope."""
    i = imports.where("specifier not like '.%' and specifier not like '/%'")
    rows = i.select("file_id", "specifier", F.explode(prefixes(F.col("specifier"), "/")).alias("prefix"), ancestors(dirname("file_id")).alias("scopes"))
    m = rows.join(aliases, "prefix").where("array_contains(scopes, scope)")
    best = Window.partitionBy("file_id", "specifier").orderBy(F.desc(F.length("scope")), F.desc(F.length("prefix")))
    m = m.withColumn("r", F.dense_rank().over(best)).where("r = 1")
    base = join_path(F.when(F.col("target").startswith("/"), F.lit("")).otherwise(F.col("scope")), F.col("target"), F.expr("substring(specifier, length(prefix) + 1)"))
    tried = m.select("file_id", "specifier", "ord", probe(base).alias("key")).join(probe_index(files), "key")
    return i.select("file_id", "specifier").distinct().join(_least(tried, "target", "ord"), ["file_id", "specifier"], "left")


def resolve_python(imports: DataFrame, files: DataFrame, root_depth: int = 1) -> DataFrame:
    """Leading dots climb from the package; absolute names are looked up beside each ancestor, then in its ``src``."""
    dots = F.length(F.regexp_extract("specifier", r"^(\.*)", 1))
    name = F.translate(F.regexp_replace("specifier", r"^\.+", ""), ".", "/")
    climbed = join_path(dirname("file_id"), F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))))
    relative = F.array(F.when(name == "", exact(F.concat(climbed, F.lit("/__init__.py")))).otherwise(probe(join_path(climbed, name))))
    up = ancestors(dirname("file_id"), root_depth)
    absolute = F.flatten(F.transform(up, lambda a: F.array(probe(join_path(a, name)), probe(join_path(a, F.lit("src"), name)))))
    return first_hit(imports, F.when(dots > 0, relative).otherwise(absolute), files)


def fqcn_index(files: DataFrame) -> DataFrame:
    """``fqcn, target`` of the JVM files: declared package and name, else the path below a source root, else the whole path."""
    jvm = files.where(r"file_id rlike '\\.(java|kt|kts|groovy|scala)$'")
    stem = F.regexp_extract("file_id", r"([^/]+)\.[^.]+$", 1)
    bare = F.regexp_replace("file_id", r"\.[^.]+$", "")
    rooted = bare
    for marker in reversed(JVM_MARKERS):
        at = F.instr(bare, marker)
        rooted = F.when(at > 0, bare.substr(at + len(marker), F.length(bare))).otherwise(rooted)
    name = F.when(F.col("package_name").isNotNull(), F.concat("package_name", F.lit("."), stem)).otherwise(F.translate(rooted, "/", "."))
    return jvm.select(name.alias("fqcn"), "file_id").groupBy("fqcn").agg(F.min("file_id").alias("target"))


def resolve_jvm(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The class itself, else without its last segment (static members, inner classes); ``.*`` resolves to nothing."""
    i = imports.where("specifier not like '%.*'").select("file_id", "specifier").distinct()
    trimmed = F.when(F.col("specifier").contains("."), F.regexp_replace("specifier", r"\.[^.]*$", ""))
    rows = i.select("file_id", "specifier", F.posexplode(F.array(F.col("specifier"), trimmed)).alias("ordinal", "fqcn")).where("fqcn is not null")
    hits = _least(rows.join(fqcn_index(files), "fqcn"), "target", "ordinal")
    return imports.select("file_id", "specifier").distinct().join(hits, ["file_id", "specifier"], "left")


def go_packages(files: DataFrame) -> DataFrame:
    """``dir, target``: a package directory stands for its least file."""
    return files.where("file_id like '%.go'").groupBy(dirname("file_id").alias("dir")).agg(F.min("file_id").alias("target"))


def resolve_go(imports: DataFrame, files: DataFrame, modules: DataFrame) -> DataFrame:
    """By ``modules(scope, kind, name, dir, ord)``; kind is work, module or replace.

    A workspace above the file alone decides: its modules in declared order, the first with the package. Else the
    nearest module: a specifier below its name is looked up there and nowhere else, others by its replacements in order.
    """
    i = imports.select("file_id", "specifier").distinct()
    rows = i.select("file_id", "specifier", F.posexplode(ancestors(dirname("file_id"), 0)).alias("up", "scope")).join(modules, "scope")
    work = F.min(F.when(F.col("kind") == "work", F.col("up"))).over(Window.partitionBy("file_id", "specifier"))
    mod = F.min(F.when(F.col("kind") != "work", F.col("up"))).over(Window.partitionBy("file_id", "specifier"))
    rows = rows.withColumns({"w": work, "m": mod}).where("(w is not null and kind = 'work' and up = w) or (w is null and kind <> 'work' and up = m)")
    below = F.expr("specifier = name or startswith(specifier, concat(name, '/'))")
    rows = rows.where(below)
    own = F.max(F.col("kind") == "module").over(Window.partitionBy("file_id", "specifier"))
    rows = rows.withColumn("own", own).where("kind = 'work' or kind = 'module' or not own")
    rows = rows.select("file_id", "specifier", "ord", join_path(F.col("dir"), F.expr("substring(specifier, length(name) + 1)")).alias("at"))
    hits = _least(rows.join(go_packages(files).withColumnRenamed("dir", "at"), "at"), "target", "ord")
    return i.join(hits, ["file_id", "specifier"], "left")


def resolve_php(imports: DataFrame, files: DataFrame, psr4: DataFrame) -> DataFrame:
    """By ``psr4(scope, prefix, dir, ord)``: nearest manifest first, there the longest prefix, with fall-through to shorter
    prefixes and farther manifests; several directories of a prefix in order. Relative includes as everywhere."""
    i = imports.where("specifier not like '.%' and specifier not like '/%'").withColumn("norm", F.translate("specifier", "\\", "/"))
    scopes = i.select("file_id", "specifier", "norm", F.posexplode(ancestors(dirname("file_id"), 0)).alias("up", "scope"))
    rules = psr4.select("scope", F.translate("prefix", "\\", "/").alias("prefix"), "dir", "ord")
    m = scopes.join(rules, "scope").where("norm = prefix or startswith(norm, concat(prefix, '/'))")
    base = join_path(F.col("dir"), F.expr("substring(norm, length(prefix) + 1)"))
    tried = m.select("file_id", "specifier", "up", (-F.length("prefix")).alias("short"), "ord", probe(base).alias("key")).join(probe_index(files), "key")
    named = i.select("file_id", "specifier").distinct().join(_least(tried, "target", "up", "short", "ord"), ["file_id", "specifier"], "left")
    return named.unionByName(resolve_relative(imports, files))


def resolve_ruby(imports: DataFrame, files: DataFrame, gems: DataFrame, root_depth: int = 1) -> DataFrame:
    """Load roots of each ancestor, nearest first; then ``gems(scope, name, lib, ord)`` of the nearest gem file."""
    i = imports.where("specifier not like '.%' and specifier not like '/%'")
    up = ancestors(dirname("file_id"), root_depth)
    roots = F.flatten(F.transform(up, lambda a: F.array(*[probe(join_path(a, F.lit(r), F.col("specifier"))) for r in RUBY_ROOTS])))
    walked = first_hit(i, roots, files)
    g = i.select("file_id", "specifier", F.posexplode(ancestors(dirname("file_id"), 0)).alias("up", "scope")).join(gems, "scope")
    g = g.withColumn("near", F.min("up").over(Window.partitionBy("file_id", "specifier"))).where("up = near and (specifier = name or startswith(specifier, concat(name, '/')))")
    tried = g.select("file_id", "specifier", "ord", probe(join_path(F.col("lib"), F.col("specifier"))).alias("key")).join(probe_index(files), "key")
    by_gem = _least(tried, "target", "ord").withColumnRenamed("target", "gem")
    both = walked.join(by_gem, ["file_id", "specifier"], "left").select("file_id", "specifier", F.coalesce("target", "gem").alias("target"))
    return both.unionByName(resolve_relative(imports, files))


def resolve_rust(imports: DataFrame, files: DataFrame, crates: DataFrame) -> DataFrame:
    """One segment: the sibling module. Else by ``crates(scope, name, src)`` of the nearest workspace: the longest path that is a file, at last the crate's root."""
    i = imports.select("file_id", "specifier").distinct()
    one = F.when(~F.col("specifier").contains("::"), F.array(F.concat(join_path(dirname("file_id"), F.col("specifier")), F.lit(".rs")), F.concat(join_path(dirname("file_id"), F.col("specifier")), F.lit("/mod.rs")))).otherwise(F.array().cast("array<string>"))
    sibling = first_hit(i, F.transform(one, exact), files)
    parts = F.filter(F.split("specifier", "::"), lambda s: s != "")
    w = i.select("file_id", "specifier", parts.alias("parts"), F.posexplode(ancestors(dirname("file_id"), 0)).alias("up", "scope")).join(crates, "scope")
    w = w.withColumn("near", F.min("up").over(Window.partitionBy("file_id", "specifier"))).where("up = near and name = try_element_at(parts, 1)")
    deep = F.transform(F.reverse(F.sequence(F.lit(1), F.greatest(F.size("parts") - 1, F.lit(1)))), lambda k: F.array_join(F.slice("parts", 2, k), "/"))
    sub = F.flatten(F.transform(F.when(F.size("parts") > 1, deep).otherwise(F.array().cast("array<string>")), lambda p: F.array(F.concat_ws("/", "src", F.concat(p, F.lit(".rs"))), F.concat_ws("/", "src", p, F.lit("mod.rs")))))
    cand = F.concat(sub, F.array(F.concat_ws("/", "src", F.lit("lib.rs")), F.concat_ws("/", "src", F.lit("main.rs"))))
    by_crate = first_hit(w, F.transform(cand, lambda p: exact(normalize(p))), files).withColumnRenamed("target", "crate")
    return sibling.join(by_crate, ["file_id", "specifier"], "left").select("file_id", "specifier", F.coalesce("target", "crate").alias("target"))


def resolve_cpp(imports: DataFrame, files: DataFrame, include_roots: DataFrame) -> DataFrame:
    """Beside the file, then each of ``include_roots(scope, dir, ord)`` above it, then from the repository."""
    i = imports.select("file_id", "specifier").distinct()
    up = i.select("file_id", "specifier", F.posexplode(ancestors(dirname("file_id"), 0)).alias("up", "scope")).join(include_roots, "scope")
    roots = up.groupBy("file_id", "specifier").agg(F.transform(F.array_sort(F.collect_list(F.struct("up", "ord", "dir"))), lambda r: r["dir"]).alias("dirs"))
    j = i.join(roots, ["file_id", "specifier"], "left")
    dirs = F.concat(F.array(dirname("file_id")), F.coalesce("dirs", F.array().cast("array<string>")), F.array(F.substring_index("file_id", "/", 1)))
    return first_hit(j, F.transform(dirs, lambda d: probe(join_path(d, F.col("specifier")))), files)


def resolve_csharp(imports: DataFrame, files: DataFrame) -> DataFrame:
    """A file that declares the namespace, else the namespace as a directory below a source root, else any directory that ends with it."""
    cs = files.where("file_id like '%.cs'").select("file_id", "package_name", dirname("file_id").alias("dir"))
    i = imports.select("file_id", "specifier").distinct().withColumn("ns", F.translate("specifier", ".", "/"))
    declared = i.join(cs.where("package_name is not null").groupBy(F.col("package_name").alias("specifier")).agg(F.min("file_id").alias("target")), "specifier").select("file_id", "specifier", F.lit(0).alias("tier"), "target")
    per_dir = cs.groupBy("dir").agg(F.min("file_id").alias("target"))
    below_src = F.when(F.instr("dir", "/src/") > 0, F.expr("substring(dir, instr(dir, '/src/') + 5)"))
    rooted = i.join(per_dir.select(F.explode(F.array_distinct(F.array(F.col("dir"), below_src, F.regexp_replace("dir", "^[^/]+/", "")))).alias("ns"), "target"), "ns").select("file_id", "specifier", F.lit(1).alias("tier"), "target")
    parts = F.split("dir", "/", -1)
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    tail = i.join(per_dir.select(F.explode(tails).alias("ns"), "target"), "ns").select("file_id", "specifier", F.lit(2).alias("tier"), "target")
    return i.select("file_id", "specifier").join(_least(declared.unionByName(rooted).unionByName(tail), "target", "tier"), ["file_id", "specifier"], "left")


def resolve_imports(imports: DataFrame, files: DataFrame, scopes: dict[str, DataFrame]) -> DataFrame:
    """All languages: ``file_id, specifier, language, target, is_bonus``; self edges are dropped, null targets are unresolved.

    ``imports`` has file_id, specifier, language and is_bonus; a bonus (a submodule that may exist) adds a target
    only where the file hasn't it yet, and never counts as unresolved.
    """
    of = lambda *langs: imports.where(F.col("language").isin(*langs))
    parts = [resolve_python(of("python"), files), resolve_jvm(of("java", "kotlin", "groovy"), files), resolve_csharp(of("csharp"), files)]
    named = "typescript javascript python java kotlin groovy csharp go php ruby rust cpp".split()
    web = imports.where(F.col("language").isin("typescript", "javascript", "vue", "svelte", "astro", "css", "html", "graphql") | ~F.col("language").isin(*named))
    parts.append(resolve_relative(web, files))
    parts.append(resolve_alias(web, files, scopes["aliases"] if "aliases" in scopes else _no_scope(imports, "aliases")))
    for name, langs, f in (("modules", ("go",), resolve_go), ("psr4", ("php",), resolve_php), ("gems", ("ruby",), resolve_ruby), ("crates", ("rust",), resolve_rust), ("include_roots", ("cpp",), resolve_cpp)):
        parts.append(f(of(*langs), files, scopes[name] if name in scopes else _no_scope(imports, name)))
    done = parts[0]
    for p in parts[1:]:
        done = done.unionByName(p)
    all_ = imports.select("file_id", "specifier", "language", "is_bonus").distinct().join(done, ["file_id", "specifier"], "left").where("target is null or target <> file_id")
    first = Window.partitionBy("file_id", "target").orderBy("is_bonus", "specifier")
    ranked = all_.withColumn("r", F.when(F.col("target").isNotNull(), F.row_number().over(first)).otherwise(1))
    return ranked.where("(not is_bonus) or (target is not null and r = 1)").drop("r")


def resolution_stats(resolved: DataFrame) -> DataFrame:
    """Per language: imports, resolved ones and the ratio."""
    r = resolved.where("not is_bonus").groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.count("target").alias("n_resolved"))
    return r.withColumn("ratio", F.round(F.col("n_resolved") / F.col("n"), 3))


def unresolved_top(resolved: DataFrame, k: int = 30) -> DataFrame:
    """Per language the specifiers that most imports of which resolve to nothing, with the least file as a sample."""
    per = resolved.where("target is null and not is_bonus").groupBy("language", "specifier").agg(F.count(F.lit(1)).alias("n"), F.min("file_id").alias("sample"))
    return top_k(per, ["language"], [F.desc("n"), "specifier"], k)


# ---- calls -----------------------------------------------------------------------------------------


def export_suffixes(exports: DataFrame) -> DataFrame:
    """(file_id, suffix, name) of qualified exports whose last part is unique in the file."""
    suffix = F.regexp_extract("name", r"^.+(?:\.|::)([^.:]+)$", 1)
    return exports.select("file_id", "name", suffix.alias("suffix")).where("suffix <> ''").groupBy("file_id", "suffix").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name")).where("n = 1").drop("n")


def resolve_calls(calls: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """(symbol_id, callee, line, target, pass): direct exports of imported files, the first import wins; else a unique
    qualified export of exactly one imported file. Calls that are qualified already pass through, others are dropped.

    ``calls``: symbol_id, file_id, callee, line; ``imports``: src, dst, ord; ``exports``: file_id, name.
    """
    done = calls.where("callee like '%#%'").select("symbol_id", "callee", "line", F.col("callee").alias("target"), F.lit(0).alias("pass"))
    bare = calls.where("callee not like '%#%'")
    per_file = bare.select("file_id", "callee").distinct()
    e = imports.where("src <> dst").groupBy("src", "dst").agg(F.min("ord").alias("ord"))
    reach = per_file.join(e.withColumnRenamed("src", "file_id"), "file_id")
    direct = reach.join(exports.select(F.col("file_id").alias("dst"), F.col("name").alias("callee")).distinct(), ["dst", "callee"])
    p1 = direct.groupBy("file_id", "callee").agg(F.min(F.struct("ord", "dst")).alias("b")).select("file_id", "callee", F.concat("b.dst", F.lit("#"), "callee").alias("target"), F.lit(1).alias("pass"))
    rest = reach.join(p1.select("file_id", "callee"), ["file_id", "callee"], "left_anti")
    suffix = rest.join(export_suffixes(exports).select(F.col("file_id").alias("dst"), F.col("suffix").alias("callee"), "name"), ["dst", "callee"])
    p2 = suffix.groupBy("file_id", "callee").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("dst"), F.min("name").alias("name")).where("n = 1").select("file_id", "callee", F.concat("dst", F.lit("#"), "name").alias("target"), F.lit(2).alias("pass"))
    return bare.join(p1.unionByName(p2), ["file_id", "callee"]).select("symbol_id", "callee", "line", "target", "pass").unionByName(done)


def symbol_edge_table(symbols: DataFrame, calls: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """All symbol edges: exports, resolved calls, and extends and implements by their bare names."""
    out = symbols.where("is_exported").select(F.col("file_id").alias("src"), F.col("symbol_id").alias("dst"), F.lit("exports").alias("type"), F.lit(None).cast("int").alias("line"))
    called = resolve_calls(calls, imports, exports).select(F.col("symbol_id").alias("src"), F.col("target").alias("dst"), F.lit("calls").alias("type"), "line")
    ext = symbols.where("extends_name is not null").select(F.col("symbol_id").alias("src"), F.col("extends_name").alias("dst"), F.lit("extends").alias("type"), F.lit(None).cast("int").alias("line"))
    imp = symbols.select(F.col("symbol_id").alias("src"), F.explode("implements").alias("dst"), F.lit("implements").alias("type"), F.lit(None).cast("int").alias("line")).where("dst is not null")
    return out.unionByName(called).unionByName(ext).unionByName(imp)


# ---- edges by convention ----------------------------------------------------------------------------


def underscore(c: Column | str) -> Column:
    """A constant's path: ``::`` to ``/``, words of a camel name by underscores, lower case."""
    s = F.regexp_replace(_c(c), "::", "/")
    return F.lower(F.regexp_replace(F.regexp_replace(s, "([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z\d])([A-Z])", "$1_$2"))


def rails_constants(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, specifier) of ``refs(file_id, candidates)``: the first candidate constant that an autoload path defines.

    Autoload roots are ``app/<category>`` and its ``concerns``, views and assets aside; of one key the root by name
    and then the least file wins.
    """
    m = r"^(.*/)?app/([^/]+)/(concerns/)?(.+)\.rb$"
    index = files.where(F.col("file_id").rlike(m)).select(F.regexp_extract("file_id", m, 4).alias("key"), F.regexp_extract("file_id", m, 2).alias("cat"), F.length(F.regexp_extract("file_id", m, 3)).alias("deep"), "file_id").where("cat not in ('views', 'javascript', 'assets')")
    index = index.groupBy("key").agg(F.min(F.struct("cat", "deep", "file_id")).alias("b")).select("key", F.col("b.file_id").alias("dst"))
    rows = refs.select("file_id", "candidates", F.posexplode("candidates").alias("ord", "name")).withColumn("key", underscore("name"))
    hits = rows.join(index, "key").groupBy("file_id", "candidates").agg(F.min(F.struct("ord", "name", "dst")).alias("b"))
    return hits.select(F.col("file_id").alias("src"), "b.dst", F.concat(F.lit("const:"), "b.name").alias("specifier")).where("src <> dst").groupBy("src", "dst").agg(F.min("specifier").alias("specifier"))


def rails_views(files: DataFrame) -> DataFrame:
    """(src, dst, specifier): controllers and mailers to the templates of their view folder."""
    c, m, v = r"^(.*?)app/controllers/(.+)_controller\.rb$", r"^(.*?)app/mailers/(.+)_mailer\.rb$", r"^(.*?)app/views/(.+)/[^/]+$"
    side = lambda rx, end: files.where(F.col("file_id").rlike(rx)).select(F.col("file_id").alias("src"), F.concat(F.regexp_extract("file_id", rx, 1), F.lit("::"), F.regexp_extract("file_id", rx, 2), F.lit(end)).alias("key"))
    views = files.where(F.col("file_id").rlike(v)).select(F.col("file_id").alias("dst"), F.concat(F.regexp_extract("file_id", v, 1), F.lit("::"), F.regexp_extract("file_id", v, 2)).alias("key"))
    return side(c, "").unionByName(side(m, "_mailer")).join(views, "key").select("src", "dst", F.lit("convention:views").alias("specifier"))


def django_references(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, specifier) of ``refs(file_id, kind, value)``: the value as a module, else without its last segment."""
    both = refs.select("file_id", "kind", "value", F.posexplode(F.array(F.col("value"), F.when(F.instr("value", ".") > 1, F.regexp_replace("value", r"\.[^.]*$", "")))).alias("n", "specifier")).where("specifier is not null")
    done = resolve_python(both.select("file_id", "specifier").distinct(), files).where("target is not null")
    hits = both.join(done, ["file_id", "specifier"]).groupBy("file_id", "kind", "value").agg(F.min_by("target", "n").alias("dst")).where("dst <> file_id")
    return hits.select(F.col("file_id").alias("src"), "dst", F.concat(F.lit("convention:django:"), "kind").alias("specifier")).groupBy("src", "dst").agg(F.min("specifier").alias("specifier"))


def laravel_references(refs: DataFrame, files: DataFrame, psr4: DataFrame) -> DataFrame:
    """(src, dst, specifier) of ``refs(file_id, kind, value)``: relations of models only, container bindings everywhere."""
    ok = refs.where("kind = 'container' or (kind = 'eloquent' and file_id like '%app/Models/%')").withColumn("specifier", F.regexp_replace("value", r"^\\", ""))
    done = resolve_php(ok.select("file_id", "specifier").distinct(), files, psr4).where("target is not null")
    return ok.join(done, ["file_id", "specifier"]).where("target <> file_id").select(F.col("file_id").alias("src"), F.col("target").alias("dst"), F.concat(F.lit("convention:"), "kind").alias("specifier")).groupBy("src", "dst").agg(F.min("specifier").alias("specifier"))


def partial_pairs(declarations: DataFrame) -> DataFrame:
    """(src, dst, specifier): all ordered pairs of files of one (namespace, name). The pairs are the feature; groups are
    the parts of one type, written by hand, so they are small."""
    p = declarations.select(F.coalesce("namespace", F.lit("")).alias("ns"), "name", "file_id").distinct()
    q = p.select("ns", "name", F.col("file_id").alias("dst"))
    return p.join(q, ["ns", "name"]).where("file_id <> dst").groupBy(F.col("file_id").alias("src"), "dst").agg(F.concat(F.lit("partial:"), F.min("name")).alias("specifier"))


def merge_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges and the new ones that connect pairs not connected yet: merging twice changes nothing."""
    fresh = new.where("src is not null and dst is not null").join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti").groupBy("src", "dst").agg(F.min("specifier").alias("specifier"))
    return edges.select("src", "dst", "specifier").unionByName(fresh)
