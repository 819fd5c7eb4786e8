"""Index build: a source tree to the tables of the code index, as one lazy plan cut where several stages read it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import graph as G
from tessera.operators import resolve as R
from tessera.session import cut
from tessera.sources import extract as E
from tessera.sources import files as S


def build(spark: SparkSession, root: str, excludes: list[str] = (), includes: list[str] = ()) -> dict[str, DataFrame]:
    """files, symbols, call_sites, edges, symbol_edges, file_tokens, token_df and unresolved of a tree.

    Order: files, edges, degrees, barrels, then what depends on them; nothing below reads the tree again.
    """
    walked = cut(S.walk(spark, root, excludes, includes))
    return build_tables(walked)


def build_tables(walked: DataFrame) -> dict[str, DataFrame]:
    """The same of ``file_id, path, language, size_bytes, mtime_ms, text`` rows."""
    configs, walked = walked, walked.where("language <> 'config'")
    got = cut(E.extract(walked))
    base = S.file_rows(walked).drop("text").join(got.select("file_id", "package_name", "has_default_export", "reexport_ratio", "exports"), "file_id")
    scopes = S.configs(configs)
    imports = E.imports_of(got, base)
    resolved = cut(R.resolve_imports(imports, base.select("file_id", "package_name"), scopes))
    plain = resolved.where("target is not null").select(F.col("file_id").alias("src"), F.col("target").alias("dst"), "specifier")
    refs = got.select("file_id", F.explode("refs").alias("r")).select("file_id", "r.*")
    constants = refs.where("kind = 'constant'").select("file_id", F.split("value", "\\|").alias("candidates"))
    partials = refs.where("kind = 'partial'").join(base.select("file_id", F.col("package_name").alias("namespace")), "file_id").select("namespace", F.col("value").alias("name"), "file_id")
    new = R.rails_constants(constants, base).unionByName(R.rails_views(walked)).unionByName(R.django_references(refs.where("kind in ('settings', 'include', 'importlib')"), base)).unionByName(R.laravel_references(refs.where("kind in ('eloquent', 'container')"), base, scopes["psr4"])).unionByName(R.partial_pairs(partials))
    edges = cut(R.merge_edges(plain.groupBy("src", "dst").agg(F.min("specifier").alias("specifier")), new))
    symbols = E.symbols_of(got).drop("calls")
    ordered = edges.withColumn("ord", F.row_number().over(R.Window.partitionBy("src").orderBy("specifier", "dst")))
    exports = got.select("file_id", F.explode("exports").alias("name"))
    symbol_edges = R.symbol_edge_table(symbols, E.calls_of(got), ordered, exports)
    barrels = G.barrels(edges, base)
    files = base.join(barrels, "file_id").join(G.transitive_one_hop(edges, base).withColumnRenamed("own", "imported_by_count"), "file_id")
    tokens = G.strip_barrel_tokens(G.with_singulars(G.file_tokens(base)), barrels)
    return {
        "files": files, "symbols": symbols, "call_sites": E.calls_of(got), "edges": edges.withColumn("type", F.lit("import")), "symbol_edges": symbol_edges, "file_tokens": tokens, "token_df": G.token_df(tokens, barrels),
        "unresolved": resolved.where("target is null and not is_bonus"), "resolved": resolved,
    }


def probe(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """How well imports resolve: ratios and the top unresolved specifiers per language, and edges by kind of specifier."""
    kinds = tables["edges"].groupBy(X.edge_bucket("specifier").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return {"stats": R.resolution_stats(tables["resolved"]), "unresolved": R.unresolved_top(tables["resolved"]), "buckets": kinds}


def summary(files: DataFrame) -> DataFrame:
    """Files and estimated tokens per language with totals (rollup)."""
    return files.rollup(X.language_of_path("path").alias("language")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("token_estimate").alias("n_tokens"))
