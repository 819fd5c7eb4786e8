"""Filling containers of fixed capacity with whole texts (Karmarkar-Karp multiway differencing).

Sizes are tokens of a public tokenizer. A text of more than the capacity is split: its full pieces fill a
container each, only the rest is an item. Items are dealt to blocks by a hash, a block holding about
``BLOCK_WINDOWS`` containers' worth of tokens whatever the table's size, so a block is one task's work and at
most part of one container per block is lost to dealing. Tiny items of a block are first combined to compounds of at most 1 /
``GRAIN`` of the capacity, so a block never holds more than some thousand parts. In a block the two partial partitions with the largest
imbalances are merged, large sums against small ones, until one partition is left; where its largest window
exceeds the capacity, the window count rises by what the excess needs and the block is partitioned anew.

Defined cases: null and empty texts have size 0 and lie in the first window of their block; a text of exactly the
capacity fills a window; repeated rows are items of their own if their ids differ; an empty table gives no window.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.encoding import TOKENIZERS, encoder, ship_vocabulary
from tessera.session import cut

#: Containers' worth of tokens in a block; what part of a container compounds of tiny items make up at most.
BLOCK_WINDOWS, GRAIN = 48, 64


def _sizes(folder: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64())], schema=schema)

    return run


def token_sizes(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id, n_tokens``; no text leaves its task."""
    ship_vocabulary(docs.sparkSession, folder)
    return docs.select("doc_id", "text").mapInArrow(_sizes(folder), "doc_id bigint, n_tokens bigint")


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``k`` windows of near-equal sums, by multiway differencing. Ties go by position."""
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [s], [i]))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, _, b, tb = heapq.heappop(heap)
        # sums descend, windows not there are 0: the largest of b go to those, the next largest to the smallest of a
        free = k - len(a)
        over = len(b) - free
        pairs = list(zip(a, ta, strict=True))
        if over <= 0:
            pairs += zip(b, tb, strict=True)
        else:
            pairs += zip(b[:free], tb[:free], strict=True)
            low = len(a) - over
            for j in range(over):
                x, tx = pairs[low + j]
                y, ty = b[len(b) - 1 - j], tb[len(b) - 1 - j]
                pairs[low + j] = (x + y, (tx, ty))
        pairs.sort(key=lambda p: -p[0])
        sums, trees = [p[0] for p in pairs], [p[1] for p in pairs]
        gap = sums[0] - (sums[-1] if len(sums) == k else 0)
        heapq.heappush(heap, (-gap, serial, sums, trees))
        serial += 1
    return [_leaves(t) for t in heap[0][3]] if heap else []


def _leaves(tree) -> list[int]:
    out, todo = [], [tree]
    while todo:
        t = todo.pop()
        if isinstance(t, tuple):
            todo += t
        else:
            out.append(t)
    return out


def combine(sizes: list[int], limit: int) -> list[list[int]]:
    """Groups of indices: items of more than half of ``limit`` alone, others together up to ``limit``, so all groups but one exceed its half."""
    out: list[list[int]] = []
    open_, room = [], limit
    for i, s in enumerate(sizes):
        if 2 * s > limit:
            out.append([i])
            continue
        if s > room:
            out.append(open_)
            open_, room = [], limit
        open_.append(i)
        room -= s
    return out + [open_] if open_ else out


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; the count starts at what the sum and the large items need."""
    if not sizes:
        return []
    groups = combine(sizes, capacity // GRAIN)
    if len(groups) < len(sizes):
        packed = pack_parts([sum(sizes[i] for i in g) for g in groups], capacity)
        return [[i for g in w for i in groups[g]] for w in packed]
    return pack_parts(sizes, capacity)


def pack_parts(sizes: list[int], capacity: int) -> list[list[int]]:
    """``pack`` of parts as they are."""
    half = sum(2 * s > capacity for s in sizes)
    k = max(1, -(-sum(sizes) // capacity), half)
    while True:
        windows = difference(sizes, k)
        excess = sum(max(0, sum(sizes[i] for i in w) - capacity) for w in windows)
        if not excess:
            return windows
        k += max(1, excess // capacity)


def _pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
    at = [0] * len(pdf)
    for w, members in enumerate(pack(pdf["n_tokens"].tolist(), int(pdf["capacity"].iat[0]))):
        for m in members:
            at[m] = w
    return pdf.assign(window=pd.Series(at, dtype="int32"))[["budget_id", "block", "window", "doc_id", "piece", "start_token", "n_tokens"]]


def windows(docs: DataFrame, budgets: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """``budget_id, window_id, doc_id, piece, start_token, n_tokens`` for every budget with a positive capacity.

    ``window_id`` is ``f``, document and piece for a full piece, else ``b``, block and window.
    """
    sizes = cut(token_sizes(docs, folder))
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]  # one number
    caps = [(r.budget_id, r.capacity_tokens) for r in budgets.where("capacity_tokens > 0").distinct().collect()]  # a handful of rows by definition
    if not caps:
        return sizes.sparkSession.createDataFrame([], "budget_id int, window_id string, doc_id bigint, piece int, start_token bigint, n_tokens bigint")
    plan = F.array(*[F.struct(F.lit(b).cast("int").alias("budget_id"), F.lit(c).cast("bigint").alias("capacity"), F.lit(max(1, total // (c * BLOCK_WINDOWS))).cast("bigint").alias("blocks")) for b, c in caps])
    dealt = sizes.select("doc_id", F.col("n_tokens").alias("size"), F.explode(plan).alias("p")).select("doc_id", "size", "p.*").withColumn("full", F.expr("if(size > capacity, size div capacity, 0)"))
    full = dealt.where("full > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))))
    whole = full.select("budget_id", F.concat_ws("-", F.lit("f"), "doc_id", "piece").alias("window_id"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"))
    items = dealt.where("full = 0 or size > full * capacity").select("budget_id", "capacity", F.pmod(F.xxhash64("doc_id"), "blocks").alias("block"), "doc_id", F.col("full").cast("int").alias("piece"), (F.col("full") * F.col("capacity")).alias("start_token"), (F.col("size") - F.col("full") * F.col("capacity")).alias("n_tokens"))
    # texts without tokens need no room and no partitioning: they lie in the first window of their block
    none = items.where("n_tokens = 0").select("budget_id", F.concat_ws("-", F.lit("b"), "block", F.lit("0")).alias("window_id"), "doc_id", "piece", "start_token", "n_tokens")
    packed = items.where("n_tokens > 0").groupBy("budget_id", "block").applyInPandas(_pack_block, "budget_id int, block bigint, window int, doc_id bigint, piece int, start_token bigint, n_tokens bigint")
    return whole.unionByName(none).unionByName(packed.select("budget_id", F.concat_ws("-", F.lit("b"), "block", "window").alias("window_id"), "doc_id", "piece", "start_token", "n_tokens"))


def fill(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per budget: windows, tokens and the share of the room that is used."""
    used = packed.groupBy("budget_id").agg(F.countDistinct("window_id").alias("n_windows"), F.sum("n_tokens").alias("n_tokens"))
    return used.join(budgets.select("budget_id", "capacity_tokens").distinct(), "budget_id").select("budget_id", "n_windows", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_windows") * F.col("capacity_tokens")), 6).alias("fill"))
