"""References to records that do not exist (dictionary-encoded compressed bitmaps).

Every key that a reference or a parent names gets an integer: a bucket by hash, then its rank in the bucket, so
no key range holds more than its share, whatever the keys look like. References become bitmaps per key range and
period, parents bitmaps per key range; reference AND-NOT parent is computed on the bitmaps of one range, and the
bits that survive are decoded to keys by the dictionary.

Rows are only shuffled after ``distinct`` on (key, table, field, period), so a key that holds a third of all
references moves once per partition; the way back to the references is salted by reference.

Defined cases: null keys are no references; a reference with a null period counts in the period ``null``; a parent
that arrives later counts; repeated rows count once; with no parents every reference is an orphan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType
from pyspark.sql.window import Window

from tessera.session import current_rows, cut, key_form

#: Keys of a range fit one bitmap of 32,768 bits of ``bitmap_construct_agg``.
RANGE_BITS = 32768
#: Ways a key's references are spread when they are looked up again.
SALTS = 16


def live_ids(files: DataFrame, symbols: DataFrame, shared: DataFrame) -> DataFrame:
    """``key`` of every live file and symbol."""
    live_files = current_rows(files, "deleted_at").where("deleted_at is null").select(F.col("file_id").alias("key"))
    live_symbols = symbols.where("deleted_at is null").select(F.col("symbol_id").alias("key"))
    return live_files.unionByName(live_symbols).unionByName(shared.select(F.explode(F.array("symbol_id", "file_id")).alias("key")))


def references(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every reference as ``(ref_table, ref_id, ref_field, period, space, key)``; ``space`` names the parents it looks in."""
    month = lambda c: F.date_format(c, "yyyy-MM")
    ends = edges.select(
        F.lit("symbol_edges").alias("ref_table"), F.col("edge_id").alias("ref_id"), month("seen_at").alias("period"),
        F.explode(F.array(
            F.struct(F.lit("src").alias("ref_field"), key_form(F.col("src")).alias("key")),
            F.struct(F.lit("dst").alias("ref_field"), F.when(F.coalesce(F.col("type").isin("extends", "implements"), F.lit(False)) & ~F.col("dst").contains("#") & ~F.translate("dst", "\\", "/").contains("/"), None).otherwise(key_form(F.col("dst"))).alias("key")),
        )).alias("r"),
    ).select("ref_table", "ref_id", "r.ref_field", "period", F.lit("id").alias("space"), "r.key")
    file_key = F.concat("repo", F.lit("/"), key_form(F.col("path")))
    paths = anchors.select(F.lit("anchors").alias("ref_table"), F.col("anchor_id").alias("ref_id"), F.lit("path").alias("ref_field"), month("verified_at").alias("period"), F.lit("file").alias("space"), file_key.alias("key"))
    hashes = anchors.where("hash <> 'missing'").select(F.lit("anchors").alias("ref_table"), F.col("anchor_id").alias("ref_id"), F.lit("hash").alias("ref_field"), month("verified_at").alias("period"), F.lit("version").alias("space"), version_key().alias("key"))
    return ends.unionByName(paths).unionByName(hashes).where("key is not null")


def version_key():
    """repo, path and hash as one key; null if one of them is."""
    return F.concat("repo", F.lit("/"), key_form(F.col("path")), F.lit("\x1f"), F.regexp_replace(F.lower("hash"), "^sha256:", ""))


def parents(files: DataFrame, symbols: DataFrame, shared: DataFrame, versions: DataFrame) -> DataFrame:
    """``(space, key)`` of everything that may be referred to."""
    live_files = current_rows(files, "deleted_at").where("deleted_at is null").select(F.lit("file").alias("space"), F.col("file_id").alias("key"))
    ids = live_ids(files, symbols, shared).select(F.lit("id").alias("space"), "key")
    known = versions.select(F.lit("version").alias("space"), version_key().alias("key"))
    return ids.unionByName(live_files).unionByName(known).where("key is not null")


def _and_not(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bits of reference AND-NOT parent, as positions in the range."""
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            ref = np.frombuffer(zlib.decompress(r.ref_bits), np.uint8)
            if r.parent_bits is not None:
                ref = ref & ~np.frombuffer(zlib.decompress(r.parent_bits), np.uint8)
            bits = np.flatnonzero(np.unpackbits(ref, bitorder="little"))
            rows.append(pd.DataFrame({"ref_table": r.ref_table, "ref_field": r.ref_field, "period": r.period, "range": r.range, "bit": bits.astype("int32")}))
        yield pd.concat(rows) if rows else pd.DataFrame({"ref_table": [], "ref_field": [], "period": [], "range": [], "bit": []})


def _pack(bits: str):
    """A bitmap compressed: keys are dense in their range, references are often sparse in theirs."""

    def pack(s: pd.Series) -> pd.Series:
        return s.map(lambda b: zlib.compress(bytes(b), 1))

    return F.pandas_udf(pack, BinaryType())(F.col(bits))


def _coded_key(df: DataFrame) -> DataFrame:
    """Keys of 128 bits (two independent 64-bit hashes of space and key) instead of strings: nothing longer is shuffled."""
    return df.withColumns({"k1": F.xxhash64("space", "key"), "k2": F.xxhash64(F.lit(1), "key", "space")}).drop("space", "key")


def dictionary(keys: DataFrame, buckets: int) -> DataFrame:
    """``range, bit`` of every key: a bucket by hash, then the rank in it. ``keys`` are distinct, so buckets are even."""
    ranked = keys.withColumn("bucket", F.pmod("k1", F.lit(buckets))).withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("k1", "k2")) - 1)
    return ranked.withColumns({"range": F.col("bucket") * 65536 + F.floor(F.col("rank") / RANGE_BITS), "bit": (F.col("rank") % RANGE_BITS).cast("int")}).drop("bucket", "rank")


def orphans(refs: DataFrame, parent_keys: DataFrame, n_rows: int) -> DataFrame:
    """References without a parent: ``ref_table, ref_id, ref_field, period``, distinct.

    The number of buckets follows ``n_rows``, the rows of the tables that references and parents come from, so that
    ranges stay full enough to be worth a bitmap and small enough for one task each. A key's uses are the periods of its table and
    field, a set that doesn't grow with its references.
    """
    refs, parent_keys = _coded_key(refs), _coded_key(parent_keys)
    use = F.struct("ref_table", "ref_field", "period")
    both = refs.select("k1", "k2", use.alias("use")).unionByName(parent_keys.select("k1", "k2", F.lit(None).cast("struct<ref_table:string,ref_field:string,period:string>").alias("use")))
    keys = both.groupBy("k1", "k2").agg(F.collect_set("use").alias("uses"), F.max(F.col("use").isNull()).alias("is_parent"))
    coded = cut(dictionary(keys, max(8, n_rows // RANGE_BITS + 1)))  # read three times
    ref_maps = coded.select("range", "bit", F.explode("uses").alias("u")).groupBy("range", "u.ref_table", "u.ref_field", "u.period").agg(F.bitmap_construct_agg("bit").alias("b")).withColumn("ref_bits", _pack("b")).drop("b")
    parent_maps = coded.where("is_parent").groupBy("range").agg(F.bitmap_construct_agg("bit").alias("b")).withColumn("parent_bits", _pack("b")).drop("b")
    # sides that grow with the tables are merged, never broadcast, however small they are
    left = ref_maps.join(parent_maps.hint("merge"), "range", "left").mapInPandas(_and_not, "ref_table string, ref_field string, period string, range bigint, bit int")
    decoded = left.join(coded.select("range", "bit", "k1", "k2").hint("merge"), ["range", "bit"]).select("ref_table", "ref_field", "k1", "k2").distinct()
    salted = decoded.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = ["ref_table", "ref_field", "k1", "k2", "salt"]
    spread = refs.withColumn("salt", F.pmod(F.xxhash64("ref_id"), F.lit(SALTS)).cast("int"))
    return spread.join(salted.hint("merge"), on, "left_semi").select("ref_table", "ref_id", "ref_field", "period").distinct()
