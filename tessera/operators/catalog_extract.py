"""Queries of the extractors over the source files of the index; and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.sources import extract as E
from tessera.session import table


def _extracted(spark, d):
    docs = table(spark, d, "documents").where("file_id is not null and text is not null")
    return E.extract(docs.select("file_id", "text", X.language_of_path("file_id").alias("language")))


def extract_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols found in the texts, next to those of the index that they agree with."""
    got = E.symbols_of(_extracted(spark, d)).select("file_id", F.substring_index("name", ".", -1).alias("name")).distinct()
    have = table(spark, d, "symbols").where("name is not null").select("file_id", F.trim("name").alias("name"), F.lit(1).alias("known")).distinct()
    both = got.withColumn("found", F.lit(1)).join(have, ["file_id", "name"], "full")
    lang = X.language_of_path("file_id")
    n = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    return both.groupBy(lang.alias("language")).agg(n("found").alias("n_found"), n("known").alias("n_known"), F.sum(F.when(F.col("found").isNotNull() & F.col("known").isNotNull(), 1).otherwise(0)).alias("n_both"))


def extract_imports(spark: SparkSession, d: str) -> DataFrame:
    e = _extracted(spark, d)
    return e.select(X.language_of_path("file_id").alias("language"), F.explode("imports").alias("i")).groupBy("language", F.col("i.is_bonus").alias("is_bonus")).agg(F.count(F.lit(1)).alias("n"))


def extract_calls(spark: SparkSession, d: str) -> DataFrame:
    return E.calls_of(_extracted(spark, d)).groupBy("callee").agg(F.count(F.lit(1)).alias("n_calls"), F.countDistinct("file_id").alias("n_files"))


def env_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of lines that look like settings, first line of each: pure expressions, no extractor."""
    docs = table(spark, d, "documents").where("file_id is not null and text is not null")
    rows = docs.select("file_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    key = F.regexp_extract(F.regexp_replace(F.substring_index("line", "#", 1), r"^\s*(export\s+)?", ""), r"^([A-Z_][A-Z0-9_]*)\s*=", 1)
    return rows.select("file_id", key.alias("key"), (F.col("n") + 1).alias("n")).where("key <> ''").groupBy("file_id", "key").agg(F.min("n").cast("bigint").alias("line"))


QUERIES = {f.__name__: f for f in (extract_symbols, extract_imports, extract_calls, env_keys)}
SQL = {
    "env_keys": "WITH ln AS (SELECT file_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE file_id IS NOT NULL AND text IS NOT NULL), k AS (SELECT file_id, n, regexp_extract(regexp_replace(split_part(line, '#', 1), '^\\s*(export\\s+)?', ''), '^([A-Z_][A-Z0-9_]*)\\s*=', 1) AS key FROM ln) SELECT file_id, key, min(n) AS line FROM k WHERE key <> '' GROUP BY 1, 2",
}
