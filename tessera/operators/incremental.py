"""Incremental maintenance: snapshots compared, patched and audited.

A snapshot is a table of files with fingerprints; a change is found by one full outer join on the path. A patch is
the untouched rows and the recomputed ones; it equals a rebuild because what depends on a changed file is recomputed
from the base tables, never edited in place.

Defined cases: a file without a stored fingerprint is stale; null paths are no files; equal hashes with new times only
refresh the fingerprint; an empty old snapshot makes every file new.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import fixed as K


def reconcile(old: DataFrame, live: DataFrame) -> DataFrame:
    """(path, change): stale, deleted or new; ``old`` and ``live`` have path, mtime_ms and size_bytes."""
    o = old.where("path is not null").select("path", F.col("mtime_ms").alias("om"), F.col("size_bytes").alias("os"), F.lit(True).alias("was"))
    n = live.where("path is not null").select("path", F.col("mtime_ms").alias("nm"), F.col("size_bytes").alias("ns"), F.lit(True).alias("is"))
    same = (F.col("om") == F.col("nm")) & (F.col("os") == F.col("ns"))
    change = F.when(F.col("is").isNull(), "deleted").when(F.col("was").isNull(), "new").when(~F.coalesce(same, F.lit(False)), "stale")
    return o.join(n, "path", "full").select("path", change.alias("change")).where("change is not null")


def patch_limit(n_files: int) -> int:
    """Up to so many changed files are patched, beyond it the index is built anew."""
    return max(K.PATCH_FLOOR, math.ceil(n_files * K.PATCH_RATIO))


def patch_plan(changes: DataFrame, old: DataFrame, live: DataFrame) -> DataFrame:
    """(path, action): delete, update, insert, or refresh where the content's hash is the same."""
    h = changes.join(old.select("path", F.col("hash").alias("oh")), "path", "left").join(live.select("path", F.col("hash").alias("nh")), "path", "left")
    action = F.when(F.col("change") == "deleted", "delete").when(F.col("change") == "new", "insert").when(F.col("oh") == F.col("nh"), "refresh").otherwise("update")
    return h.select("path", action.alias("action"))


def patch_edges(old_edges: DataFrame, plan: DataFrame, fresh_edges: DataFrame) -> DataFrame:
    """Edges after a patch: those of untouched sources whose target wasn't deleted, and the recomputed ones of the others.

    Importers of a deleted file are affected too: their edges are recomputed with the rest.
    """
    touched = plan.where("action in ('delete', 'update', 'insert')").select(F.col("path").alias("src"))
    gone = plan.where("action = 'delete'").select(F.col("path").alias("dst"))
    cascade = old_edges.join(gone, "dst", "left_semi").select("src")
    affected = touched.unionByName(cascade).distinct()
    kept = old_edges.join(affected, "src", "left_anti")
    return kept.unionByName(fresh_edges.join(affected, "src", "left_semi").select(*kept.columns))


def patch_rows(old: DataFrame, fresh: DataFrame, touched: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows after a patch of what belongs to one file each (tokens, symbols, edges of its symbols): the old ones of files
    not ``touched(path)``, the fresh ones of the others."""
    t = touched.select(F.col("path").alias(key)).distinct()
    return old.join(t, key, "left_anti").unionByName(fresh.join(t, key, "left_semi").select(*old.columns))


def patch_counts(old_counts: DataFrame, old: DataFrame, fresh: DataFrame, touched: DataFrame, term: str = "token", count: str = "df", key: str = "file_id") -> DataFrame:
    """Document frequencies after a patch: the old ones, less what touched files held, plus what they hold now; nothing else is read."""
    t = touched.select(F.col("path").alias(key)).distinct()
    change = lambda df, n: df.join(t, key, "left_semi").select(key, term).distinct().groupBy(term).agg((F.count(F.lit(1)) * n).alias("d"))
    delta = change(old, -1).unionByName(change(fresh, 1)).groupBy(term).agg(F.sum("d").alias("d"))
    both = old_counts.join(delta, term, "full").select(term, (F.coalesce(F.col(count), F.lit(0)) + F.coalesce("d", F.lit(0))).alias(count))
    return both.where(F.col(count) > 0)


def audit_sample(files: DataFrame, cursor: int, sample: int = K.AUDIT_SAMPLE) -> DataFrame:
    """The ``sample`` files from a cursor on, wrapping around, by the order of their ids.

    The place of a file is its rank among the files of its repository, behind those of the repositories before it. Only the
    repositories that the sample reaches are ranked, so the rest of the index is counted, not ordered.
    """
    per = files.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    n = per.agg(F.sum("n")).first()[0] or 0
    if not n:
        return files.select("file_id").limit(0)
    first = per.withColumn("before", F.sum("n").over(Window.orderBy("repo").rowsBetween(Window.unboundedPreceding, -1)))  # a row per repository
    start, size = cursor % n, min(sample, n)
    lo, hi = start, start + size
    first = first.withColumn("before", F.coalesce("before", F.lit(0)))
    reached = first.where(((F.col("before") < hi) & (F.col("before") + F.col("n") > lo)) | (F.col("before") + n < hi)).select("repo", "before")
    placed = files.select("repo", "file_id").join(reached, "repo").withColumn("at", F.col("before") + F.row_number().over(Window.partitionBy("repo").orderBy("file_id")) - 1)
    inside = (F.col("at") >= lo) & (F.col("at") < hi) | (F.col("at") + n < hi)
    return placed.where(inside).select("file_id")


def drifted(sample: DataFrame, files: DataFrame, live: DataFrame) -> DataFrame:
    """Sampled files whose fingerprint isn't that of the live file."""
    s = files.join(sample, "file_id", "left_semi").select(F.col("file_id").alias("path"), "mtime_ms", "size_bytes")
    return reconcile(s, live.join(s.select("path"), "path", "left_semi")).select("path")
