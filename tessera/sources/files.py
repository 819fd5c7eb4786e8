"""Sources and sinks: source trees, event logs, snapshots, transcripts, configurations, version control.

Readers never fail on one bad input: a broken line or file becomes a warning row. Writers commit by a marker that is
written last, so a reader sees a whole generation or the one before.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import fixed as K
from tessera.functions import text as X
from tessera.session import cut

VERSION = "1"
#: Configuration files that are read though their names have no language.
CONFIG_NAMES = ("go.mod", "go.work", "Gemfile", "CMakeLists.txt")


# ---- source trees ---------------------------------------------------------------------------------------


def walk(spark: SparkSession, root: str, excludes: list[str] = (), includes: list[str] = ()) -> DataFrame:
    """(file_id, path, language, size_bytes, mtime_ms, text) of a tree on a file system that all tasks share.

    Left out: hidden and excluded directories, generated names, files above a million bytes and of no known language,
    links. Directories are pruned while walking, so nothing below an excluded one is even listed. The driver only
    looks at directories until there are enough of them to share out; tasks walk and read.
    """
    base = os.path.abspath(root)
    skip = frozenset([*K.EXCLUDED_DIRS, *excludes])
    todo: list[tuple[str, bool]] = [(base, True)]
    while len(todo) < 256 and any(deep for _, deep in todo):
        at = next(n for n, (_, deep) in enumerate(todo) if deep)
        folder = todo.pop(at)[0]
        todo.append((folder, False))
        todo += [(e.path, True) for e in sorted(os.scandir(folder), key=lambda e: e.name) if e.is_dir(follow_symlinks=False) and e.name not in skip and not e.name.startswith(".")]

    def read(batches):
        import pandas as pd

        for pdf in batches:
            for folder, deep in zip(pdf["folder"], pdf["deep"], strict=True):
                rows = []
                for at, dirs, names in os.walk(folder):
                    dirs[:] = sorted(d for d in dirs if d not in skip and not d.startswith(".")) if deep else []
                    for n in sorted(names):
                        full = os.path.join(at, n)
                        if os.path.islink(full):
                            continue
                        st = os.stat(full)
                        if st.st_size <= K.MAX_BYTES:
                            rows.append((os.path.relpath(full, base).replace(os.sep, "/"), st.st_size, st.st_mtime * 1000, full))
                    for lo in range(0, len(rows), 200):
                        part = rows[lo : lo + 200]
                        yield pd.DataFrame([(p, s, m, open(f, "rb").read().decode("utf-8", "replace")) for p, s, m, f in part], columns=["path", "size_bytes", "mtime_ms", "text"])
                    rows = []

    shares = spark.createDataFrame(todo, "folder string, deep boolean").repartition(min(len(todo), spark.sparkContext.defaultParallelism * 4))
    return _indexable(shares.mapInPandas(read, "path string, size_bytes bigint, mtime_ms double, text string"), includes)


def walk_objects(spark: SparkSession, root: str, excludes: list[str] = (), includes: list[str] = ()) -> DataFrame:
    """The same from an object store by ``binaryFile``, which itself leaves out names that begin with a dot or underscore."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= K.MAX_BYTES)
    rel = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split("/")[-1]) + "/", "")
    f = raw.select(rel.alias("path"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") / 1000).alias("mtime_ms"), F.decode("content", "UTF-8").alias("text"))
    return _indexable(f.where(~F.exists(X.dirs_of("path"), lambda d: d.isin(*excludes)) if excludes else F.lit(True)), includes)


def _indexable(f: DataFrame, includes: list[str]) -> DataFrame:
    ok = ~X.under_excluded_dir("path") & ~X.is_generated_name("path")
    if includes:
        ok = ok & reduce(lambda a, b: a | b, [F.col("path").startswith(i.rstrip("/") + "/") | (F.col("path") == i) for i in includes])
    config = F.when(F.element_at(F.split("path", "/"), -1).isin(*CONFIG_NAMES), "config")
    f = f.where(ok).withColumn("language", F.coalesce(X.language_of_path("path"), config)).where("language is not null")
    return f.select(F.col("path").alias("file_id"), "path", "language", "size_bytes", "mtime_ms", "text")


def file_rows(walked: DataFrame) -> DataFrame:
    """Adds hash, line count, token estimate and the test flag: the scalar part of an indexed file."""
    return walked.withColumns({"hash": F.md5("text"), "line_count": X.line_count("text"), "token_estimate": X.token_estimate("text").cast("int"), "is_test_file": X.is_test_path("path")})


# ---- event logs -----------------------------------------------------------------------------------------


def read_log(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(records, warnings) of JSON-lines logs, one file a note: ``note_id, raw, record`` and ``note_id, line``."""
    rows = spark.read.text(os.path.join(folder, "*.jsonl")).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1).alias("note_id"), F.col("value").alias("raw")).where(F.trim("raw") != "")
    parsed = rows.withColumn("record", F.try_parse_json("raw"))
    good = F.col("record").isNotNull() & F.trim("raw").like("{%}")
    return parsed.where(good), parsed.where(~F.coalesce(good, F.lit(False))).select("note_id", F.col("raw").alias("line"))


def list_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Notes that have a log, sorted."""
    return spark.read.format("binaryFile").load(os.path.join(folder, "*.jsonl")).select(F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("note_id")).distinct().orderBy("note_id")


class Store:
    """A folder on any file system that Spark reaches, through its own client: existence, whole small files, exclusive creation, atomic replacement."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf, self.folder = spark._jvm, spark._jsc.hadoopConfiguration(), folder
        self.fs = self.path().getFileSystem(self.conf)

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.folder.rstrip("/"), *parts)))

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self.path(*parts))

    def names(self) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self.path())] if self.exists() else []

    def read(self, *parts: str) -> str | None:
        if not self.exists(*parts):
            return None
        stream = self.fs.open(self.path(*parts))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, text: str, *parts: str) -> bool:
        """Create a file unless it is there; of several writers one succeeds."""
        try:
            out = self.fs.create(self.path(*parts), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def replace(self, text: str, *parts: str) -> None:
        """Write a file beside its place and move it there in one step."""
        *folder, name = parts
        part = (*folder, f".{name}-{uuid.uuid4().hex}")
        self.create(text, *part)
        self.remove(*folder, f".{name}.crc")  # a local file's checksum would outlive it
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        rename = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        how = SparkSession.active().sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        how[0] = next(x for x in rename.getEnumConstants() if x.toString() == "OVERWRITE")
        context.rename(self.path(*part), self.path(*parts), how)

    def remove(self, *parts: str) -> None:
        self.fs.delete(self.path(*parts), True)


#: Folders of a log that its notes are dealt to by a hash of their ids.
LOG_BUCKETS = 64


def append_records(records: DataFrame, folder: str, head: str | None = None, live: DataFrame | None = None, exclusive: bool = False) -> None:
    """Append ``note_id, record (JSON)`` to a log in buckets: version, time and head are stamped, verified paths hashed.

    With ``exclusive`` a note that has a log already is an error. The ids of the batch, as few as the specs it was made of, are claimed by
    exclusive creation before anything is written, so of two writers of one new note one fails.
    """
    spark = records.sparkSession
    store = Store(spark, folder)
    if exclusive:
        ids = [r.note_id for r in records.select("note_id").distinct().collect()]  # the specs of one call
        if any(n.startswith("bucket=") for n in store.names()) and not records.join(spark.read.parquet(folder).select("note_id").distinct(), "note_id", "left_semi").isEmpty():
            raise ValueError("a note of this id exists")
        claimed = [i for i in ids if store.create("", "_claims", i)]
        if len(claimed) < len(ids):
            for i in claimed:
                store.remove("_claims", i)
            raise ValueError("a note of this id exists")
    out = records.withColumns({"v": F.lit(1), "ts": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "head": F.lit(head).cast("string")})
    if live is not None:
        paths = out.select("note_id", F.explode(F.from_json("record", "struct<verified:array<string>>")["verified"]).alias("path")).join(live, "path", "left")
        hashed = paths.groupBy("note_id").agg(F.collect_list(F.struct("path", F.coalesce("hash", F.lit("missing")).alias("hash"))).alias("hashes"))
        out = out.join(hashed, "note_id", "left")
    bucket = F.pmod(F.xxhash64("note_id"), F.lit(LOG_BUCKETS)).cast("int")
    out.withColumn("bucket", bucket).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(folder)


# ---- snapshots ------------------------------------------------------------------------------------------


def save_snapshot(tables: dict[str, DataFrame], folder: str, head: str | None = None, expected: tuple[str, ...] = ()) -> int:
    """Write the next generation of all tables, then the marker; generations two or more behind are swept.

    A partial set of tables is refused, as it would lose the others. A generation's number is claimed by exclusive creation,
    so two writers never share one, and the marker is replaced in one step, never by that of an earlier generation.
    """
    missing = [t for t in expected if t not in tables]
    if missing:
        raise ValueError(f"partial snapshot: {missing}")
    store = Store(SparkSession.active(), folder)
    of = lambda names: [int(m[1]) for n in names if (m := re.fullmatch(r"gen=(\d+)", n))]
    gen = max([*of(store.names()), (read_meta(folder) or {}).get("gen", 0)], default=0) + 1
    while not store.create("", f"gen={gen}", "_claim"):
        gen += 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/gen={gen}/{name}")
    if (read_meta(folder) or {}).get("gen", 0) < gen:
        store.replace(json.dumps({"version": VERSION, "gen": gen, "head": head, "tables": sorted(tables), "saved_at": time.time()}), "_meta.json")
    for old in of(store.names()):
        if old <= gen - 2:
            store.remove(f"gen={old}")
    return gen


def read_meta(folder: str) -> dict | None:
    try:
        meta = json.loads(Store(SparkSession.active(), folder).read("_meta.json") or "")
    except (ValueError, Py4JJavaError):  # no JSON, or a file whose checksum is wrong
        return None
    return meta if isinstance(meta, dict) else None


def load_snapshot(spark: SparkSession, folder: str, tables: tuple[str, ...] | None = None) -> dict[str, DataFrame] | None:
    """The tables of the committed generation; None (build anew) for another version or a broken snapshot. Columns are pruned by use."""
    meta = read_meta(folder)
    if not meta or meta.get("version") != VERSION:
        return None
    wanted = [t for t in meta["tables"] if tables is None or t in tables]
    try:
        return {t: spark.read.parquet(f"{folder.rstrip('/')}/gen={meta['gen']}/{t}") for t in wanted}
    except Exception:  # a generation that lost files is as good as none
        return None


def update_head(folder: str, head: str) -> bool:
    """Another head for the same data: only the marker is written."""
    meta = read_meta(folder)
    if not meta:
        return False
    Store(SparkSession.active(), folder).replace(json.dumps(meta | {"head": head}), "_meta.json")
    return True


# ---- metrics and keeper state ---------------------------------------------------------------------------


def log_metrics(rows: DataFrame, folder: str, kind: str) -> None:
    """Append metric rows of one kind (misses, injections, captures)."""
    rows.select(F.current_timestamp().alias("ts"), F.lit(kind).alias("kind"), F.to_json(F.struct("*")).alias("payload")).write.mode("append").partitionBy("kind").parquet(folder)


def latest_state(log: DataFrame) -> DataFrame:
    """(key, value, ts): the last value of every key of a state log."""
    return log.groupBy("key").agg(F.max(F.struct("ts", "value")).alias("b")).select("key", "b.value", "b.ts")


def tail(log: DataFrame, n: int) -> DataFrame:
    return log.orderBy(F.desc("ts")).limit(n)


# ---- version control ------------------------------------------------------------------------------------


def _git(root: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def vcs_head(root: str) -> str | None:
    out = _git(root, "rev-parse", "--short=12", "HEAD")
    return out.strip() if out else None


def vcs_changes(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """(path, change, old_path): committed since a head, dirty, untracked, and exact renames. Empty outside of a repository."""
    rows: list[tuple[str, str, str | None]] = []
    if since and (out := _git(root, "diff", "--name-status", "-M100%", "-z", since, "HEAD")):
        parts = out.split("\0")
        at = 0
        while at < len(parts) - 1:
            code = parts[at]
            if code.startswith("R"):
                rows.append((parts[at + 2], "renamed", parts[at + 1]))
                at += 3
            else:
                rows.append((parts[at + 1], {"A": "added", "D": "deleted"}.get(code[:1], "modified"), None))
                at += 2
    if out := _git(root, "status", "--porcelain", "-z", "--no-renames", "--untracked-files=all"):
        rows += [(e[3:], "untracked" if e[:2] == "??" else "dirty", None) for e in out.split("\0") if len(e) > 3]
    return spark.createDataFrame(rows, "path string, change string, old_path string")


# ---- transcripts ----------------------------------------------------------------------------------------


def tool_calls(records: DataFrame) -> DataFrame:
    """(session, seq, record_id, tool, call_id, command, path) of three shapes of agent records (hook, transcript, rollout).

    A hook record is one event, or wraps one or several as ``postToolUse``.
    """
    v = records.select("session", "seq", "record_id", "kind", F.try_parse_json("raw").alias("v")).where("v is not null")
    get = lambda c, p: F.try_variant_get(c, p, "string")
    post = F.coalesce(F.try_variant_get("v", "$.postToolUse", "array<variant>"), F.array(F.try_variant_get("v", "$.postToolUse", "variant")))
    events = v.where("kind = 'hook'").select("session", "seq", "record_id", F.explode(F.concat(F.array("v"), post)).alias("e"))
    hook = events.select("session", "seq", "record_id", get("e", "$.tool_name").alias("tool"), F.lit(None).cast("string").alias("call_id"), get("e", "$.tool_input.command").alias("command"), F.coalesce(get("e", "$.tool_input.path"), get("e", "$.tool_input.file_path")).alias("path"))
    blocks = v.where("kind = 'transcript'").select("session", "seq", "record_id", F.explode(F.try_variant_get("v", "$.message.content", "array<variant>")).alias("b"))
    use = blocks.where(get("b", "$.type") == "tool_use").select("session", "seq", "record_id", get("b", "$.name").alias("tool"), get("b", "$.id").alias("call_id"), get("b", "$.input.command").alias("command"), F.coalesce(get("b", "$.input.path"), get("b", "$.input.file_path")).alias("path"))
    roll = v.where("kind = 'rollout'").where(get("v", "$.payload.type").isin("custom_tool_call", "function_call")).select("session", "seq", "record_id", get("v", "$.payload.name").alias("tool"), get("v", "$.payload.call_id").alias("call_id"), F.regexp_extract(get("v", "$.payload.input"), r'cmd"?\s*:\s*"((?:[^"\\]|\\.)*)"', 1).alias("command"), F.lit(None).cast("string").alias("path"))
    return hook.unionByName(use).unionByName(roll).where("tool is not null")


def tool_evidence(calls: DataFrame) -> DataFrame:
    """(session, path, reads, edits, events): what a session did to files; searches are no contact."""
    n = lambda *t: F.sum(F.col("tool").isin(*t).cast("bigint"))
    e = calls.where("path is not null and path <> ''").groupBy("session", "path").agg(n("Read").alias("reads"), n("Edit", "Write", "MultiEdit", "NotebookEdit").alias("edits"), F.count(F.lit(1)).alias("events"))
    return e.where("reads + edits > 0")


# ---- configurations -------------------------------------------------------------------------------------


def configs(files: DataFrame) -> dict[str, DataFrame]:
    """Scope tables for import resolution from the configuration files of a tree (``file_id, text``).

    aliases of tsconfig and jsconfig files with what they extend, and of workspace packages (npm, yarn, pnpm; an alias of the same name wins),
    Go modules and workspaces with replacements, namespaces of composer files, path gems and crates of Cargo workspaces.
    A file that doesn't parse gives no row.
    """
    name = F.element_at(F.split("file_id", "/"), -1)
    wanted = files.where(name.isin("package.json", "pnpm-workspace.yaml", "go.mod", "go.work", "composer.json", "Gemfile", "Cargo.toml", "CMakeLists.txt"))
    rows = cut(wanted.select("file_id", "text").mapInPandas(_config_rows, "kind string, scope string, a string, b string, c string, ord int"))
    pick = lambda k, **cols: rows.where(F.col("kind").isin(*k.split())).select("scope", *[F.col(src).alias(dst) for dst, src in cols.items()], "ord")
    paths = tsconfig_aliases(files)
    packages = workspace_aliases(rows).join(paths.select("scope", "prefix").distinct(), ["scope", "prefix"], "left_anti")
    globbed = members(rows, "crate_glob", "crate_dir").select("scope", F.col("name"), F.concat("dir", F.lit("/src")).alias("src"))
    return {
        "aliases": paths.unionByName(packages), "modules": rows.where("kind in ('work', 'module', 'replace')").select("scope", "kind", F.col("a").alias("name"), F.col("b").alias("dir"), "ord"),
        "psr4": pick("psr4", prefix="a", dir="b"), "gems": pick("gem", name="a", lib="b"), "crates": pick("crate", name="a", src="b").drop("ord").unionByName(globbed).distinct(), "workspaces": pick("workspace", name="a", dir="b"), "include_roots": pick("include", dir="b"),
    }


def members(rows: DataFrame, glob: str, member: str) -> DataFrame:
    """``scope, name, dir`` of the ``member`` rows whose directory a ``glob`` row of a directory above names.

    A member meets the globs of its ancestors by whole keys; ``*`` stands for part of one segment.
    """
    m = rows.where(F.col("kind") == member).select(F.col("scope").alias("dir"), F.col("a").alias("name")).where("name <> ''")
    parts = F.filter(F.split("dir", "/"), lambda s: s != "")
    up = m.select("dir", "name", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("scope"))
    g = rows.where(F.col("kind") == glob).select("scope", F.col("c").alias("glob")).distinct()
    relative = F.when(F.col("scope") == "", F.col("dir")).otherwise(F.expr("substring(dir, length(scope) + 2)"))
    return up.join(g, "scope").withColumn("relative", relative).where(F.expr("relative rlike concat('^', glob, '$')")).select("scope", "name", "dir").distinct()


def workspace_aliases(rows: DataFrame) -> DataFrame:
    """``scope, prefix, target, ord``: packages of a workspace by their names, for the files below the workspace's root; of one name the least directory first."""
    order = F.row_number().over(Window.partitionBy("scope", "name").orderBy("dir"))
    return members(rows, "workspace", "package").select("scope", F.col("name").alias("prefix"), F.concat(F.lit("/"), "dir").alias("target"), order.alias("ord"))


_TSCONFIG = "root string, place array<int>, trail array<string>, kind string, a string, b string, ord int"


def tsconfig_aliases(files: DataFrame) -> DataFrame:
    """``scope, prefix, target, ord`` of all tsconfig and jsconfig files, targets as paths from the root.

    A chain of ``extends`` is followed a step at a time, until no file extends one that isn't on its way yet. Of
    several definitions the file's own wins, then the later entry of ``extends``, nearer before farther; so a definition's
    place is the list of entries that lead to it, compared from the left.
    """
    front = files.where(F.element_at(F.split("file_id", "/"), -1).isin("tsconfig.json", "jsconfig.json")).select(F.col("file_id").alias("root"), F.array().cast("array<int>").alias("place"), F.array("file_id").alias("trail"), "text")
    steps = []
    while True:
        parsed = cut(front.mapInPandas(_tsconfig_rows, _TSCONFIG))
        steps.append(parsed.where("kind <> 'extends'"))
        more = parsed.where("kind = 'extends' and not array_contains(trail, a)")
        if more.isEmpty():
            break
        front = more.join(files.select(F.col("file_id").alias("a"), "text"), "a").select("root", F.array_append("place", F.col("ord")).alias("place"), F.array_append("trail", F.col("a")).alias("trail"), "text")
    defs = reduce(lambda x, y: x.unionByName(y), steps).withColumn("place", F.array_append("place", F.lit(2147483647)))
    base = defs.where("kind = 'base'").groupBy("root").agg(F.max_by("a", "place").alias("base"))
    paths = defs.where("kind = 'path'")
    best = paths.groupBy("root", "a").agg(F.max("place").alias("place"))
    scope = F.regexp_replace(F.regexp_replace("root", "^[^/]*$", ""), "/[^/]*$", "")
    kept = paths.join(best, ["root", "a", "place"]).join(base, "root", "left").withColumn("scope", scope)
    return kept.select("scope", F.col("a").alias("prefix"), F.concat(F.lit("/"), F.coalesce("base", "scope"), F.lit("/"), "b").alias("target"), "ord").distinct()


def _tsconfig_rows(batches):
    import pandas as pd

    for pdf in batches:
        out = []
        for root, place, trail, text in zip(pdf["root"], pdf["place"], pdf["trail"], pdf["text"], strict=True):
            folder = trail[-1].rpartition("/")[0]
            try:
                bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m[1] or "", text or "")
                cfg = json.loads(re.sub(r",(\s*[}\]])", r"\1", bare))
                options, extends = cfg.get("compilerOptions") or {}, cfg.get("extends") or []
                rows = [("extends", _join(folder, e if e.endswith(".json") else e + ".json"), None, n) for n, e in enumerate([extends] if isinstance(extends, str) else extends)]
                if options.get("baseUrl"):
                    rows.append(("base", _join(folder, options["baseUrl"]), None, 0))
                rows += [("path", k.removesuffix("/*"), t.removesuffix("/*"), n) for k, ts in (options.get("paths") or {}).items() for n, t in enumerate(ts)]
            except (ValueError, TypeError, AttributeError):
                continue
            out += [(root, list(place), list(trail), *r) for r in rows]
        yield pd.DataFrame(out, columns=["root", "place", "trail", "kind", "a", "b", "ord"])


def _config_rows(batches):
    import pandas as pd

    for pdf in batches:
        out = []
        for fid, text in zip(pdf["file_id"], pdf["text"], strict=True):
            folder, _, name = fid.rpartition("/")
            try:
                out += [(k, folder, a, b, c, n) for n, (k, a, b, c) in enumerate(_parse_config(name, folder, text or ""))]
            except (ValueError, TypeError, AttributeError):
                continue
        yield pd.DataFrame(out, columns=["kind", "scope", "a", "b", "c", "ord"])


def _join(*parts: str) -> str:
    """A path from the root; what leaves the root stays at it."""
    path = os.path.normpath("/" + "/".join(p for p in parts if p)).lstrip("/")
    return "" if path == "." else path


def _segments(glob: str) -> str:
    """The expression of a workspace glob, ``*`` within one segment."""
    return "/".join("[^/]*".join(map(re.escape, seg.split("*"))) for seg in os.path.normpath(glob).split("/"))


def _parse_config(name: str, folder: str, text: str) -> list[tuple[str, str, str | None, str | None]]:
    if name == "package.json":
        cfg = json.loads(text)
        ws = cfg.get("workspaces", [])
        ws = ws.get("packages", []) if isinstance(ws, dict) else ws
        own = [("package", cfg["name"], None, None)] if isinstance(cfg.get("name"), str) else []
        return own + [("workspace", cfg.get("name") or "", _join(folder, w), _segments(w)) for w in ws if not w.startswith("!")]
    if name == "pnpm-workspace.yaml":
        globs = re.findall(r"(?m)^\s+-\s+['\"]?([^'\"#\s]+)['\"]?", text)
        return [("workspace", "", _join(folder, w), _segments(w)) for w in globs if not w.startswith("!")]
    if name == "composer.json":
        cfg = json.loads(text)
        out = []
        for section in ("autoload", "autoload-dev"):
            for prefix, dirs in cfg.get(section, {}).get("psr-4", {}).items():
                out += [("psr4", prefix.rstrip("\\"), _join(folder, d), None) for d in ([dirs] if isinstance(dirs, str) else dirs)]
        return out
    if name == "go.mod":
        out = [("module", m[1], folder, None) for m in re.finditer(r"(?m)^module\s+(\S+)", text)]
        return out + [("replace", m[1], _join(folder, m[2]), None) for m in re.finditer(r"(?m)^(?:replace\s+)?\s*(\S+)(?:\s+v\S+)?\s+=>\s+(\.{1,2}/\S*)", text)]
    if name == "go.work":
        dirs = re.findall(r"(?m)^use\s+(\S+)$", text) + [d for block in re.findall(r"use\s*\(([^)]*)\)", text) for d in block.split()]
        return [("work", d.rsplit("/", 1)[-1], _join(folder, d), None) for d in dirs]
    if name == "Gemfile":
        return [("gem", m[1], _join(folder, m[2], "lib"), None) for m in re.finditer(r"gem\s+['\"]([^'\"]+)['\"]\s*,[^#\n]*\bpath:\s*['\"]([^'\"]+)['\"]", text)]
    if name == "CMakeLists.txt":
        dirs = [d for m in re.finditer(r"(?:target_)?include_directories\s*\(([^)]*)\)", text) for d in m[1].split()]
        plain = [re.sub(r"\$\{(?:CMAKE_CURRENT_SOURCE_DIR|PROJECT_SOURCE_DIR|CMAKE_SOURCE_DIR)\}/?", "", d.strip('"')) for d in dirs]
        return [("include", "", _join(folder, d), None) for d in plain if d and not d.isupper() and "$" not in d]
    if name == "Cargo.toml":
        import tomllib

        cfg = tomllib.loads(text)
        out = [("crate", m.rsplit("/", 1)[-1].replace("-", "_"), _join(folder, m, "src"), None) for m in cfg.get("workspace", {}).get("members", []) if "*" not in m]
        out += [("crate_glob", "", None, _segments(m)) for m in cfg.get("workspace", {}).get("members", []) if "*" in m]
        if "package" in cfg:
            out.append(("crate_dir", cfg["package"]["name"].replace("-", "_"), None, None))
            out.append(("crate", cfg["package"]["name"].replace("-", "_"), _join(folder, "src"), None))
        return out
    return []


# ---- notes as documents ---------------------------------------------------------------------------------


def render_notes(notes: DataFrame) -> DataFrame:
    """(note_id, markdown): front matter and a body by type, as one string expression."""
    line = lambda k, c: F.concat(F.lit(f"{k}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))
    front = F.concat_ws("\n", F.lit("---"), line("id", "note_id"), line("type", "type"), line("status", "status"), F.concat(F.lit("aliases: "), F.coalesce(F.array_join("aliases", ", "), F.lit(""))), F.lit("---"))
    return notes.select("note_id", F.concat_ws("\n", front, F.concat(F.lit("# "), "title"), F.coalesce("summary", F.lit("")), F.coalesce("body", F.lit(""))).alias("markdown"))


def view_data(notes: DataFrame, links: DataFrame, worst: DataFrame) -> DataFrame:
    """What a browser of the notebook shows: notes with their freshness, links and back-links."""
    out = links.groupBy(F.col("src").alias("note_id")).agg(F.array_sort(F.collect_set("dst")).alias("links"))
    back = links.groupBy(F.col("dst").alias("note_id")).agg(F.array_sort(F.collect_set("src")).alias("backlinks"))
    return notes.select("note_id", "type", "status", "title").join(worst.select("note_id", "worst"), "note_id", "left").join(out, "note_id", "left").join(back, "note_id", "left")
