"""Queries p1_, p2_, p5_, p7_, p8_ and p9_ over the tables of the code index, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import encoding, handwritten, mojibake, packing, syntax, terms
from tessera.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_files(spark, d).select("file_id")


def p1_files(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.judge(table(spark, d, "documents"), table(spark, d, "files"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return syntax.parsed(table(spark, d, "documents"), table(spark, d, "files"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("not valid").select("file_id").distinct()


def p2_rejected(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("not valid")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(_parsed(spark, d))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(terms.index_records(table(spark, d, "files"), table(spark, d, "symbols")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where("mark is not null").select("field", "term", "mark")


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, d, "documents"))


def p8_windows(spark: SparkSession, d: str) -> DataFrame:
    return packing.windows(table(spark, d, "documents"), table(spark, d, "context_budgets"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    budgets = table(spark, d, "context_budgets")
    return packing.fill(packing.windows(table(spark, d, "documents"), budgets), budgets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.damaged(table(spark, d, "documents")).select("doc_id").distinct()


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.damaged(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_files, p2_found, p2_rejected, p2_rates, p5_found, p5_terms, p7_ids, p8_windows, p8_fill, p9_found, p9_restored)}

_CURRENT = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY indexed_at DESC NULLS LAST, received_at DESC NULLS LAST) AS rn FROM files WHERE file_id IS NOT NULL) WHERE rn = 1"
_TERMS = f"""
WITH cur AS ({_CURRENT}),
t AS (
  SELECT 'domain_map' AS field, file_id AS rec, e.key AS term, coalesce(e.value.filename, 0) + coalesce(e.value.path, 0) + coalesce(e.value.symbol, 0) AS n FROM (SELECT file_id, unnest(map_entries(domain_map)) AS e FROM cur)
  UNION ALL SELECT 'exports', file_id, term, 1 FROM (SELECT file_id, unnest(exports) AS term FROM cur)
  UNION ALL SELECT 'name', symbol_id, name, 1 FROM (SELECT DISTINCT symbol_id, name FROM symbols WHERE symbol_id IS NOT NULL)),
u AS (SELECT * FROM t WHERE term IS NOT NULL AND term <> ''),
tot AS (SELECT field, count(DISTINCT rec) AS total FROM u GROUP BY field),
c AS (SELECT field, term, CAST(sum(n) AS BIGINT) AS n_occurrences, count(DISTINCT rec) AS n_records FROM u GROUP BY field, term),
m AS (SELECT field, term, n_occurrences, n_records, CASE WHEN n_records = 1 THEN 'rare' WHEN n_records > total * 0.02 THEN 'common' END AS mark FROM c JOIN tot USING (field))
"""

SQL: dict[str, str] = {
    "p5_found": _TERMS + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p5_terms": _TERMS + "SELECT * FROM m",
}
