"""Per-key results when a few keys hold most rows (eager aggregation through joins).

Both inputs of a join are aggregated by the join key before they meet, so the join sees one compact state per
key and side; counts of pairs come from multiplying the states' counts, sums from combining them, and a roll-up
follows. No task ever holds the rows of one key: the first aggregation is by (key, source), which spreads a hot
key over all partitions, and only its counters go on.

Defined cases: null keys count in the total and are dropped after it, a null source counts as an edge but not as a source; repeated rows of one
edge count once; keys on one side only keep the other side's counts as 0 (or null for the stored count).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import current_rows, cut, key_form


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One row per edge: repeated rows are equal but for ``received_at``."""
    return edges.where("edge_id is not null").groupBy("edge_id").agg(F.max("src").alias("src"), F.max("dst").alias("dst"))


def target_states(edges: DataFrame) -> DataFrame:
    """``(dst, n_edges, n_sources)`` by two aggregations: by (dst, src), then by dst; edges without a target are the state of a null."""
    pairs = distinct_edges(edges).groupBy(key_form(F.col("dst")).alias("dst"), key_form(F.col("src")).alias("src")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("dst").agg(F.sum("n").alias("n_edges"), F.count("src").alias("n_sources"))


def import_states(imports: DataFrame) -> DataFrame:
    """``(dst, n_imports, n_importers)`` of the import edges."""
    pairs = imports.where("dst is not null").groupBy(key_form(F.col("dst")).alias("dst"), key_form(F.col("src")).alias("src")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("dst").agg(F.sum("n").alias("n_imports"), F.count("src").alias("n_importers"))


def target_report(edges: DataFrame, imports: DataFrame) -> DataFrame:
    """``dst, n_edges, n_sources, share`` per target of symbol edges, with the imports of its file and the pairs of both.

    The edges are aggregated by target and the imports by file before they meet, so the join on the file sees a row per target;
    pairs come from multiplied counts. All edges, also those without a target, are the roll-up of the same joined states.
    """
    calls = target_states(edges).withColumn("file_id", F.substring_index("dst", "#", 1))
    states = calls.join(import_states(imports).withColumnRenamed("dst", "file_id"), "file_id", "left").select("dst", "n_edges", "n_sources", F.coalesce("n_imports", F.lit(0)).alias("n_imports"))
    states = cut(states)  # read for the total and for the rows: a row per target
    total = states.agg(F.coalesce(F.sum("n_edges"), F.lit(0)).alias("total"))
    share = F.try_divide(F.col("n_edges"), F.col("total"))
    return states.crossJoin(F.broadcast(total)).where("dst is not null").select("dst", "n_edges", "n_sources", share.alias("share"), "n_imports", (F.col("n_edges") * F.col("n_imports")).alias("n_pairs"))  # total: one row


def hot_targets(edges: DataFrame, imports: DataFrame, share: float = 0.01) -> DataFrame:
    """``dst`` of the targets that hold at least ``share`` of the distinct edges, from the joined states of ``target_report``."""
    return target_report(edges, imports).where(F.col("share") >= F.lit(share)).select("dst")


def file_report(edges: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """Per file: symbol edges into its symbols, import edges and importers, their pairs, next to the stored count.

    ``n_pairs`` is the size of the join of both edge tables on the file, had from the product of the states.
    """
    calls = target_states(edges).where("dst is not null").groupBy(F.substring_index("dst", "#", 1).alias("file_id")).agg(F.sum("n_edges").alias("n_edges"))
    stored = current_rows(files, "imported_by_count")
    both = import_states(imports).withColumnRenamed("dst", "file_id").join(calls, "file_id", "full").join(stored, "file_id", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return both.select("file_id", zero("n_edges"), zero("n_imports"), zero("n_importers"), (F.coalesce("n_edges", F.lit(0)) * F.coalesce("n_imports", F.lit(0))).cast("bigint").alias("n_pairs"), F.col("imported_by_count").cast("bigint").alias("stored_count"))
