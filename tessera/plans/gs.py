"""gs: one file in depth, as DataFrames over all files or for one of them.

Every function takes the whole tables, so a view of one file is the same plan behind a filter on ``file_id``,
which reaches the scan.

Defined cases: a name or path nobody has gives the whole set and a flag (symbols) or nothing (paths); null lines of
symbols enclose nothing; budgets of 0 cut everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import fixed as K
from tessera.functions import text as X
from tessera.operators import graph

VIEWS = ("full", "symbols", "imports", "importers", "callers")


def view_of(name: str | None) -> tuple[str, bool]:
    """(view, known): an unknown view is the full one, with a warning."""
    return (name, True) if name in VIEWS else ("full", name is None)


def default_symbols(symbols: DataFrame) -> DataFrame:
    """Exported symbols, classes, functions and methods; ``place`` orders them by their line."""
    shown = symbols.where("coalesce(is_exported, false) or kind in ('class', 'function', 'method')")
    return shown.withColumn("place", F.row_number().over(Window.partitionBy("file_id").orderBy("start_line", "symbol_id")).cast("bigint"))


def match_symbols(symbols: DataFrame, matches: Column) -> DataFrame:
    """The file's symbols that match, or all of a file where none does, with ``missed`` set."""
    n = F.sum(F.coalesce(matches, F.lit(False)).cast("int")).over(Window.partitionBy("file_id"))
    return symbols.withColumn("hit", F.coalesce(matches, F.lit(False))).withColumn("missed", n == 0).where("hit or missed").drop("hit")


def display_names(symbols: DataFrame) -> DataFrame:
    """``display, nested``: the prefix of the class seen last is taken off the names that have it."""
    order = Window.partitionBy("file_id").orderBy("start_line", "symbol_id")
    owner = F.last(F.when(F.col("kind") == "class", F.col("name")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    nested = F.coalesce(F.expr("startswith(name, concat(owner, '.'))"), F.lit(False))
    return symbols.withColumn("owner", owner).withColumn("nested", nested).withColumn("display", F.expr("if(nested, substring(name, length(owner) + 2), name)"))


def top_symbols(symbols: DataFrame, symbol_edges: DataFrame) -> DataFrame:
    """(file_id, symbol_id, n_caller_files, place, n_symbols): files of more than twenty symbols show fifteen, most called first."""
    shown = default_symbols_plain(symbols)
    per = graph.callers_files(symbol_edges, symbols)
    w = Window.partitionBy("file_id")
    s = shown.join(per, "symbol_id", "left").withColumn("n_caller_files", F.coalesce("n_caller_files", F.lit(0))).withColumn("n_symbols", F.count(F.lit(1)).over(w))
    huge = F.col("n_symbols") > K.HUGE_SYMBOLS
    order = w.orderBy(F.when(huge, -F.col("n_caller_files")).otherwise(0), "start_line", "symbol_id")
    ranked = s.withColumn("place", F.row_number().over(order).cast("bigint"))
    return ranked.where(~huge | (F.col("place") <= K.TOP_SYMBOLS)).select("file_id", "symbol_id", "n_caller_files", "place", "n_symbols")


def default_symbols_plain(symbols: DataFrame) -> DataFrame:
    return symbols.where("coalesce(is_exported, false) or kind in ('class', 'function', 'method')")


def find_path(files: DataFrame, asked: list[str]) -> DataFrame:
    """(asked, file_id): the path itself, else the first that ends with it, else the first that contains it."""
    keys = [a.replace("\\", "/").removeprefix("./") for a in asked]
    tier = lambda k: F.when((F.col("path") == k) | (F.col("file_id") == k), 0).when(F.col("file_id").endswith(k), 1).when(F.col("file_id").contains(k), 2)
    hits = F.filter(F.array(*[F.struct(F.lit(a).alias("asked"), tier(k).alias("tier")) for a, k in zip(asked, keys, strict=True)]), lambda h: h["tier"].isNotNull())
    return files.select("file_id", F.explode(hits).alias("h")).groupBy("h.asked").agg(F.min(F.struct("h.tier", "file_id")).alias("b")).select("asked", F.col("b.file_id").alias("file_id"))


def pick_symbols(symbols: DataFrame, names: list[str]) -> DataFrame:
    """(file_id, asked, symbol_id): per file and name the exact symbols, else those whose last part is it, else those that contain it."""
    low = F.lower("name")
    tier = lambda n: F.when(low == n, 0).when(F.element_at(F.split(low, r"\.", -1), -1) == n, 1).when(low.contains(n), 2)
    hits = F.filter(F.array(*[F.struct(F.lit(n).alias("asked"), tier(n.lower()).alias("tier")) for n in names]), lambda h: h["tier"].isNotNull())
    s = symbols.where("name is not null").select("file_id", "symbol_id", F.explode(hits).alias("h")).select("file_id", "symbol_id", "h.*")
    best = F.min("tier").over(Window.partitionBy("file_id", "asked"))
    return s.withColumn("best", best).where("tier = best").select("file_id", "asked", "symbol_id").distinct()


def body_refs(tokens: DataFrame, files: DataFrame, matches: Column, shown: DataFrame, cap: int = K.BODY_REFS) -> DataFrame:
    """(file_id, place): files with a matching content token that aren't shown already, sources before tests."""
    hits = files.join(tokens.where(matches).select("file_id").distinct(), "file_id", "left_semi").join(shown.select("file_id"), "file_id", "left_anti")
    rank = hits.select("file_id", gs_test_path("path").cast("int").alias("t")).orderBy("t", "file_id").limit(cap)
    return rank.withColumn("place", F.row_number().over(Window.orderBy("t", "file_id")).cast("bigint")).drop("t")  # over ``cap`` rows


def gs_test_path(path: str) -> Column:
    p = F.col(path)
    return p.rlike(r"(^|/)tests?/") | p.rlike(r"_tests?\.[a-z]+$") | p.rlike(r"\.tests?\.[a-z]+$")


def regions(hits: DataFrame, length: DataFrame, context: int = K.REGION_CONTEXT) -> DataFrame:
    """(file_id, region, first, last): hit lines with two lines around them, touching stretches merged."""
    h = hits.join(length, "file_id").select("file_id", F.greatest(F.lit(0), F.col("line") - context).alias("a"), F.least(F.col("n_lines") - 1, F.col("line") + context).alias("b"))
    w = Window.partitionBy("file_id").orderBy("a", "b")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = h.withColumn("new", F.when(F.col("a") <= before + 1, 0).otherwise(1)).withColumn("region", F.sum("new").over(w))
    return marked.groupBy("file_id", "region").agg(F.min("a").cast("bigint").alias("first"), F.max("b").cast("bigint").alias("last"))


def line_budget(slices: DataFrame, budget: int, order: list[str]) -> DataFrame:
    """Adds ``take``: how many lines of each slice fit, in order, a slice being cut where the budget ends."""
    w = Window.partitionBy("file_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("n_lines").over(w), F.lit(0))
    return slices.withColumn("take", F.greatest(F.lit(0), F.least(F.col("n_lines"), F.lit(budget) - spent)).cast("bigint"))


def method_matches(lines: DataFrame, symbols: DataFrame, matched: Column) -> DataFrame:
    """(file_id, symbol_id, n_terms, place): symbols around the lines that hold a term, by how many terms they hold."""
    hits = lines.select("file_id", (F.col("line") + 1).alias("line"), F.explode(matched).alias("term"))
    around = graph.enclosing(hits, default_symbols_plain(symbols)).where("symbol_id is not null")
    per = hits.join(around, ["file_id", "line"]).groupBy("file_id", "symbol_id").agg(F.countDistinct("term").alias("n_terms"))
    per = per.join(symbols.select("symbol_id", "start_line"), "symbol_id")
    place = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("n_terms"), "start_line", "symbol_id")).cast("bigint")
    return per.withColumn("place", place).select("file_id", "symbol_id", "n_terms", "place")
