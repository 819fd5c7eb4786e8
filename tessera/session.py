"""Session helpers shared by every operator: shared checkpoint folder, table loading, key forms."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ensure_shared_dir(spark: SparkSession) -> None:
    """Point the context at the folder named in ``spark.checkpoint.dir``; a private one only where that is unset (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tessera-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through files every executor shares, so that a lost executor costs nothing."""
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: its archive goes to the executors, once per application.

    In local mode nothing is sent where the workers find the package anyway.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    near = os.getcwd() == root or root in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if not (sc.master.split("[")[0] == "local" and near):
        folder = tempfile.mkdtemp(prefix="tessera-")
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "tessera"), "zip", root, "tessera"))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; a missing file is an error of the caller, an empty file an empty DataFrame."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def key_form(c: Column) -> Column:
    """Key form of a path or id: back-slashes to ``/``, one leading ``./`` dropped. Null stays null."""
    slashed = F.translate(c, "\\", "/")
    return F.when(slashed.startswith("./"), F.substring(slashed, 3, 2147483647)).otherwise(slashed)


def current_rows(files: DataFrame, *cols: str) -> DataFrame:
    """The current row of each file: one with the greatest ``indexed_at`` (the latest received of equals).

    Rows with a null ``file_id`` name no file and give none; a null ``indexed_at`` is older than any other.
    """
    keep = [c for c in cols if c != "file_id"]
    picked = F.max_by(F.struct(*keep), F.struct("indexed_at", "received_at")).alias("_row")
    return files.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(picked).select("file_id", *[F.col(f"_row.{c}").alias(c) for c in keep])


def top_k(df: DataFrame, keys: list[str], order: list[Column | str], k: int, place: str = "place", ways: int = 16) -> DataFrame:
    """The first ``k`` rows of every key with their ``place``, in two steps: the first of each of ``ways`` shares of a key,
    then the first of those. A key with most of the rows is ranked by ``ways`` tasks, and one task gets ``ways * k`` rows of it."""
    share = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith(("map", "variant"))]), F.lit(ways))
    shared = df.withColumn("_share", share).withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_share").orderBy(*order))).where(F.col("_place") <= k)
    return shared.drop("_share", "_place").withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")).where(F.col(place) <= k)
