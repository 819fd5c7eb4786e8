"""Import and call graphs: adjacency, degrees, barrels, callers, callees, importers, enclosing symbols.

Edges join on whole keys; range conditions only ever run inside one file's rows, after an equality on the file.

Defined cases: edges with a null end are none; repeated edges count once; files without edges have degree 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import fixed as K
from tessera.functions import text as X
from tessera.session import top_k

N = lambda: F.count(F.lit(1))


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst)."""
    return edges.where("src is not null and dst is not null").select("src", "dst").distinct()


def degrees(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, out_degree, imported_by) of every file, 0 where it has no edge."""
    e = adjacency(edges)
    out = e.groupBy(F.col("src").alias("file_id")).agg(N().alias("o"))
    into = e.groupBy(F.col("dst").alias("file_id")).agg(N().alias("i"))
    zero = lambda c, n: F.coalesce(F.col(c), F.lit(0)).alias(n)
    return files.select("file_id").join(out, "file_id", "left").join(into, "file_id", "left").select("file_id", zero("o", "out_degree"), zero("i", "imported_by"))


def barrels(edges: DataFrame, files: DataFrame) -> DataFrame:
    """``file_id, is_barrel``: scripts that mostly re-export, have exports and more than one importer."""
    f = files.join(degrees(edges, files), "file_id")
    flag = F.col("language").isin("typescript", "javascript") & (F.col("reexport_ratio") > K.BARREL_RATIO) & (F.col("imported_by") > K.BARREL_IMPORTERS) & (F.size("exports") > 0)
    return f.select("file_id", F.coalesce(flag, F.lit(False)).alias("is_barrel"))


def transitive_one_hop(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, own, transitive): importers, plus those of the barrels that import it. One hop, never recursive."""
    d = degrees(edges, files).select("file_id", F.col("imported_by").alias("own"))
    b = barrels(edges, files).where("is_barrel").select(F.col("file_id").alias("src")).join(d.select(F.col("file_id").alias("src"), F.col("own").alias("through")), "src")
    extra = adjacency(edges).join(b, "src").groupBy(F.col("dst").alias("file_id")).agg(F.sum("through").alias("extra"))
    return d.join(extra, "file_id", "left").select("file_id", "own", (F.col("own") + F.coalesce("extra", F.lit(0))).alias("transitive"))


def closure(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(file_id, hops) reached from ``start.file_id`` in at most ``depth`` hops: one semi-naive join a hop.

    An extension: the depth is the caller's and small, so the plan is a fixed chain of joins.
    """
    e = adjacency(edges)
    seen = start.select("file_id", F.lit(0).alias("hops")).distinct()
    front = seen
    for n in range(1, depth + 1):
        front = front.join(e, front.file_id == e.src).select(F.col("dst").alias("file_id"), F.lit(n).alias("hops")).distinct().join(seen.select("file_id"), "file_id", "left_anti")
        seen = seen.unionByName(front)
    return seen


def file_tokens(files: DataFrame) -> DataFrame:
    """(file_id, token, n_filename, n_path, n_symbol) of the path and the exports of every file."""
    low_dir = lambda d: ~F.lower(d).isin(*K.GENERIC_DIRS)
    dirs = X.dirs_of("path")
    name = F.element_at(F.split("path", "/", -1), -1)
    bare = F.regexp_replace(name, r"(.)\.[^.]*$", "$1")
    parent = F.coalesce(F.try_element_at(dirs, F.lit(-1)), F.lit(""))
    effective = F.when(F.lower(bare).isin(*K.ENTRY_NAMES), parent).otherwise(bare)
    compound = lambda s: F.when((F.length(s) > 3) & ~F.lower(s).isin(*K.NAME_STOP_WORDS), F.array(F.lower(s))).otherwise(F.array().cast("array<string>"))
    named = F.when((effective != "") & ~F.lower(effective).isin(*K.GENERIC_DIRS, *K.NAME_STOP_WORDS), F.concat(X.tokenize_name(effective), compound(effective)))
    part = lambda tokens, kind: files.select("file_id", F.explode(tokens).alias("token"), F.lit(kind).alias("kind"))
    rows = (
        part(F.flatten(F.transform(F.filter(dirs, low_dir), X.tokenize_name)), "path")
        .unionByName(part(named, "filename"))
        .unionByName(part(F.flatten(F.transform("exports", lambda s: F.concat(X.tokenize_name(s), compound(s)))), "symbol"))
    )
    n = lambda k: F.sum((F.col("kind") == k).cast("bigint")).alias(f"n_{k}")
    return rows.where("token <> ''").groupBy("file_id", "token").agg(n("filename"), n("path"), n("symbol"))


def with_singulars(tokens: DataFrame) -> DataFrame:
    """Adds the singular of tokens of five letters or more, with their counts, where a file hasn't it."""
    t = F.col("token")
    singular = F.when(t.endswith("es"), t.substr(F.lit(1), F.length(t) - 2)).when(t.endswith("s"), t.substr(F.lit(1), F.length(t) - 1))
    new = tokens.where(F.length("token") >= 5).withColumn("one", singular).where((F.length("one") >= 4) & ~F.col("one").isin(*K.NAME_STOP_WORDS))
    first = new.groupBy("file_id", "one").agg(F.min(F.struct("token", "n_filename", "n_path", "n_symbol")).alias("r"))
    added = first.select("file_id", F.col("one").alias("token"), "r.n_filename", "r.n_path", "r.n_symbol").join(tokens.select("file_id", "token"), ["file_id", "token"], "left_anti")
    return tokens.unionByName(added)


def strip_barrel_tokens(tokens: DataFrame, barrel: DataFrame) -> DataFrame:
    """Tokens of barrels keep what names and paths say; what only their exports say goes."""
    b = tokens.join(barrel, "file_id", "left").withColumn("b", F.coalesce("is_barrel", F.lit(False)))
    kept = b.where("not b or n_filename + n_path > 0")
    return kept.select("file_id", "token", "n_filename", "n_path", F.when(F.col("b"), 0).otherwise(F.col("n_symbol")).cast("bigint").alias("n_symbol"))


def token_df(tokens: DataFrame, barrel: DataFrame) -> DataFrame:
    """(token, df) over the files that are no barrels."""
    return tokens.join(barrel.where("is_barrel").select("file_id"), "file_id", "left_anti").groupBy("token").agg(N().alias("df"))


def calls(symbol_edges: DataFrame) -> DataFrame:
    """One row per call edge with both ends."""
    return symbol_edges.where("type = 'calls' and src is not null and dst is not null").groupBy("edge_id").agg(F.max(F.struct("src", "dst", "line")).alias("e")).select("edge_id", "e.*")


def callers(symbol_edges: DataFrame, symbols: DataFrame, files: int = K.CALLER_FILES, per_file: int = K.CALLER_LINES) -> DataFrame:
    """(symbol_id, caller_file, caller, line, file_rank, line_rank, n_files): callers of exported symbols in other files.

    At most twelve files a symbol and three lines a file are kept; ``n_files`` says how many there are. A hot
    symbol's callers are first reduced to (symbol, file), so the ranking of files is over files, not calls.
    """
    exported = symbols.where("is_exported").select(F.col("symbol_id").alias("dst"), F.col("file_id").alias("home"))
    source = symbols.select(F.col("symbol_id").alias("src"), F.col("name").alias("caller"), F.col("file_id").alias("caller_file"))
    c = calls(symbol_edges).join(exported, "dst").join(source, "src").where("caller_file <> home").select(F.col("dst").alias("symbol_id"), "caller_file", "caller", "line", "edge_id")
    per = c.groupBy("symbol_id", "caller_file").agg(N().alias("n"))
    ranked = top_k(per.select("symbol_id", "caller_file"), ["symbol_id"], ["caller_file"], files, "file_rank").join(per.groupBy("symbol_id").agg(N().alias("n_files")), "symbol_id")
    line = Window.partitionBy("symbol_id", "caller_file").orderBy(F.col("line").asc_nulls_last(), "caller", "edge_id")
    top = c.join(ranked, ["symbol_id", "caller_file"]).withColumn("line_rank", F.row_number().over(line)).where(F.col("line_rank") <= per_file)
    return top.select("symbol_id", "caller_file", "caller", "line", F.col("file_rank").cast("bigint").alias("file_rank"), F.col("line_rank").cast("bigint").alias("line_rank"), "n_files")


def callees(symbol_edges: DataFrame, symbols: DataFrame, cap: int = K.CALLEES) -> DataFrame:
    """(symbol_id, callee, place): distinct callees that are known symbols, ten a symbol."""
    known = symbols.select(F.col("symbol_id").alias("dst"), "start_line")
    c = calls(symbol_edges).select("src", "dst").distinct().join(known, "dst")
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst")).cast("bigint")
    return c.withColumn("place", place).where(F.col("place") <= cap).select(F.col("src").alias("symbol_id"), F.col("dst").alias("callee"), "place")


def importers(edges: DataFrame, files: DataFrame, cap: int = K.IMPORTERS) -> DataFrame:
    """(file_id, importer, place, n_importers): sorted importers, twenty a file."""
    e = adjacency(edges).join(files.select(F.col("file_id").alias("src")), "src", "left_semi")
    ranked = top_k(e, ["dst"], ["src"], cap).join(e.groupBy("dst").agg(N().alias("n_importers")), "dst")
    return ranked.select(F.col("dst").alias("file_id"), F.col("src").alias("importer"), "place", "n_importers")


def enclosing(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, line, symbol_id): the innermost symbol around each point, null where none is.

    Equality on the file makes it a hash or merge join; the range is its residual condition.
    """
    p = points.select("file_id", "line").distinct()
    s = symbols.where("end_line >= start_line").select("file_id", "symbol_id", "start_line", "end_line")
    inside = p.join(s, (p.file_id == s.file_id) & F.col("line").between(F.col("start_line"), F.col("end_line"))).select(p.file_id, "line", "symbol_id", (F.col("end_line") - F.col("start_line")).alias("span"), "start_line")
    best = inside.groupBy("file_id", "line").agg(F.min(F.struct("span", "start_line", "symbol_id")).alias("b"))
    return p.join(best, ["file_id", "line"], "left").select("file_id", "line", F.col("b.symbol_id").alias("symbol_id"))


def drop_containers(matched: DataFrame) -> DataFrame:
    """Matched symbols that don't strictly contain another matched symbol of their file."""
    inner = matched.select("file_id", F.col("start_line").alias("s2"), F.col("end_line").alias("e2"))
    outer = matched.alias("m")
    around = (F.col("m.file_id") == inner.file_id) & (F.col("start_line") <= F.col("s2")) & (F.col("end_line") >= F.col("e2")) & ((F.col("end_line") - F.col("start_line")) > (F.col("e2") - F.col("s2")))
    return outer.join(inner, around, "left_anti")


def callers_files(symbol_edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, n_caller_files) of exported symbols."""
    exported = symbols.where("is_exported").select(F.col("symbol_id").alias("dst"), F.col("file_id").alias("home"))
    source = symbols.select(F.col("symbol_id").alias("src"), F.col("file_id").alias("caller_file"))
    c = calls(symbol_edges).select("src", "dst").distinct().join(exported, "dst").join(source, "src").where("caller_file <> home")
    return c.select("dst", "caller_file").distinct().groupBy(F.col("dst").alias("symbol_id")).agg(N().alias("n_caller_files"))
