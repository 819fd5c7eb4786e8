"""Encoding of a corpus with a public byte-level BPE (content-defined chunk reuse).

A rolling hash over the last bytes of every place decides where texts are cut, hence equal passages give equal chunks wherever
they stand, in one line or many. A chunk that occurs more than once is encoded once, by the document that owns
its first occurrence; the other documents get its ids from there. Chunks that occur once are encoded in place.

Exactness: the pre-tokenizer never puts a non-blank and a following blank in one piece, so a cut between the two
(an *anchor*) changes no id; the hash chooses among anchors. A cut elsewhere (a run without a chosen anchor, longer than
``MAX_CHARS``) is repaired: the ids around the join are thrown away back to an anchor and on to the next one, the text between is
encoded anew, and the ids on both sides are kept if their bytes end and begin just there; else the text is widened by an anchor until they do.

Defined cases: null and empty texts give an empty list; strings of special tokens are ordinary text; repeated
documents are encoded once and come out as often as they stand in the table; an empty table gives no row.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut

#: Folder of the vocabulary files; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: One anchor in 2**CUT_BITS ends a chunk, judged by the rolling hash of the WINDOW bytes before it (a power of two).
CUT_BITS, WINDOW = 5, 32
#: Chunks are at least MIN_CHARS bytes long and cut by force after MAX_CHARS.
MIN_CHARS, MAX_CHARS = 64, 16384
#: Occurrences of a chunk that meet its mark, or its ids, in one task.
HOT = 20000

#: Fixed value: the pre-tokenizer pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Bytes that are blanks, and those that surely end a non-blank: ASCII, and others but for the last bytes of Unicode's blanks.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SOLID = ~_BLANK
_SOLID[[0x1C, 0x1D, 0x1E, 0x1F, *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
# The hash's value of each byte: any fixed table of well mixed numbers will do.
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) for b in range(256)], np.uint32)


@lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
    """The tokenizer of one Python worker, read once."""
    import tiktoken

    path = f"{folder}/{name}.tiktoken"
    if not os.path.exists(path):  # a worker without the folder has the file that ``ship_vocabulary`` sent
        from pyspark import SparkFiles

        path = SparkFiles.get(f"{name}.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ship_vocabulary(spark: SparkSession, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> None:
    """Send the vocabulary to the executors; done before, it costs nothing."""
    path = f"{folder}/{name}.tiktoken"
    if os.path.exists(path) and not spark.sparkContext.master.startswith("local"):
        spark.sparkContext.addFile(path)


@lru_cache(maxsize=4)
def token_lengths(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> list[int]:
    """Bytes of every id."""
    e = encoder(folder, name)
    return [len(b) for b in sorted(e.token_byte_values(), key=e.encode_single_token)]


def _rolling(data: np.ndarray) -> np.ndarray:
    """At every byte the rolling hash of the WINDOW bytes that end there: the sum of their values, each shifted by its distance."""
    h, span = _GEAR[data], 1
    while span < WINDOW:
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    return h


def _anchors(data: np.ndarray) -> np.ndarray:
    """Places in front of a blank that follows a non-blank."""
    return np.flatnonzero(_BLANK[data[1:]] & _SOLID[data[:-1]]) + 1


def cuts(data: bytes) -> list[int]:
    """Where a text is cut: anchors that the rolling hash chooses, and where there is none for too long, its last anchor or by force."""
    if len(data) < 2 * MIN_CHARS and len(data) <= MAX_CHARS:
        return []
    raw = np.frombuffer(data, np.uint8)
    anchors = _anchors(raw)
    chosen = anchors[_rolling(raw)[anchors - 1] >> np.uint32(32 - CUT_BITS) == 0].tolist()
    out, start = [], 0
    for at in [*chosen, len(data)]:
        while at - start > MAX_CHARS:
            stop = start + MAX_CHARS
            near = anchors[np.searchsorted(anchors, stop, "right") - 1] if len(anchors) else 0
            if near > start + MAX_CHARS // 2:
                stop = int(near)
            else:
                while stop > start + 1 and data[stop] & 0xC0 == 0x80:  # not inside a character
                    stop -= 1
            if data[stop] & 0xC0 == 0x80:  # a limit shorter than a character
                stop = start + 1
                while stop < len(data) and data[stop] & 0xC0 == 0x80:
                    stop += 1
            if stop >= at:
                break
            out.append(stop)
            start = stop
        if at - start >= MIN_CHARS and at < len(data):
            out.append(at)
            start = at
    return out


def _parts(data: bytes) -> list[bytes]:
    ends = [0, *cuts(data), len(data)]
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False) if a < b]


def chunks(text: str) -> list[str]:
    """Content-defined chunks of a text; together they are the text."""
    return [p.decode("utf-8", "surrogatepass") for p in _parts(text.encode("utf-8", "surrogatepass"))]


def anchored(left: bytes, right: bytes) -> bool:
    """Whether the join of two neighbours is an anchor, so that no repair is needed."""
    return not left or not right or bool(_SOLID[left[-1]] and _BLANK[right[0]])


def join_ids(parts: list[str], ids: list[list[int]], encode, lengths: list[int] | None = None) -> list[int]:
    """The ids of the joined parts, with the joins that aren't anchors repaired."""
    return _joined([p.encode("utf-8", "surrogatepass") for p in parts], ids, encode, lengths or token_lengths())


def _joined(parts: list[bytes], ids: list[list[int]], encode, lengths: list[int]) -> list[int]:
    out: list[int] = []
    left = b""  # the text behind the last place of ``out`` that no repair can reach
    for part, own in zip(parts, ids, strict=True):
        if anchored(left, part):
            out += own
            left = part
            continue
        at = _drop(out, left, lengths)
        ends = [int(a) for a in _anchors(np.frombuffer(part, np.uint8))] if len(part) > 1 else []
        kept, skip = _skip(own, ends, lengths)
        out += encode((left[at:] + part[:skip]).decode("utf-8", "surrogatepass"))
        out += own[kept:]
        left = part if skip < len(part) else left[at:] + part
    return out


def _drop(out: list[int], left: bytes, lengths: list[int]) -> int:
    """Take ids off the end until they end at an anchor of ``left``, at last at its begin; where that is."""
    anchors = set(_anchors(np.frombuffer(left, np.uint8)).tolist()) if len(left) > 1 else set()
    at = len(left)
    while at > 0:
        at -= lengths[out.pop()]
        if at in anchors:
            break
    return max(at, 0)


def _skip(ids: list[int], anchors: list[int], lengths: list[int]) -> tuple[int, int]:
    """(ids, bytes) of a part up to its first anchor at which an id begins; all of it where none does."""
    wanted, at = set(anchors), 0
    for n, i in enumerate(ids):
        if at in wanted:
            return n, at
        at += lengths[i]
    return len(ids), at


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)


_OCCURRENCES = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("ord", pa.int32()), ("chunk", pa.binary())])


def _chunk_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        rows = []
        for doc, tid, text in zip(batch.column("doc_id").to_pylist(), batch.column("tid").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            rows += [(doc, tid, n, digest(c)) for n, c in enumerate(_parts(text))]
        yield _batch(_OCCURRENCES, rows)


def _encode_owned(folder: str):
    schema = pa.schema([("chunk", pa.binary()), ("ways", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder).encode_ordinary
        for batch in batches:
            rows = []
            for text, owned in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("owned").to_pylist(), strict=True):
                parts = _parts(text)
                rows += [(o["chunk"], o["ways"], encode(parts[o["ord"]].decode("utf-8"))) for o in owned]
            yield _batch(schema, rows)

    return run


def _encode_rest(folder: str):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lengths = encoder(folder).encode_ordinary, token_lengths(folder)
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for text, given in zip(batch.column("text").to_pylist(), batch.column("given").to_pylist(), strict=True):
                if text and not given:
                    flat.extend(encode(text))
                elif text:
                    parts, have = _parts(text.encode("utf-8")), {g["ord"]: g["ids"] for g in given}
                    flat.extend(_joined(*_with_gaps(parts, have, encode), encode, lengths))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), ids], schema=schema)

    return run


def _with_gaps(parts: list[bytes], have: dict[int, list[int]], encode) -> tuple[list[bytes], list[list[int]]]:
    """Parts and their ids; neighbours without given ids become one part, encoded in one go."""
    texts: list[bytes] = []
    ids: list[list[int]] = []
    n = 0
    while n < len(parts):
        m = n + 1
        if n not in have:
            while m < len(parts) and m not in have:
                m += 1
        texts.append(b"".join(parts[n:m]))
        ids.append(have[n] if n in have else encode(texts[-1].decode("utf-8")))
        n = m
    return texts, ids


def encode_corpus(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id, ids`` of every row of ``doc_id, text``.

    Chunk hashes move first, the texts once (by document, so no key is hot; the exchange serves both uses), and
    of the ids only those of chunks that occur more than once. Occurrences of one chunk are spread over salts.
    """
    ship_vocabulary(docs.sparkSession, folder)
    texts = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("tid"), "text")
    seen = texts.where("length(text) > 0").mapInArrow(_chunk_hashes, "doc_id bigint, tid bigint, ord int, chunk binary")
    shared = seen.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "tid", "ord")).alias("owner")).where("n > 1")
    shared = cut(shared.select("chunk", (F.col("n") / HOT).cast("int").alias("ways"), "owner.*"))
    by_doc = texts.repartition("doc_id", "tid")
    owned = shared.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("ord", "chunk", "ways")).alias("owned"))
    encoded = by_doc.join(owned, ["doc_id", "tid"]).select("text", "owned").mapInArrow(_encode_owned(folder), "chunk binary, ways int, ids array<int>").dropDuplicates(["chunk"])
    spread = encoded.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("ways")))).drop("ways")
    # a chunk's mark goes out once per HOT occurrences; which mark an occurrence looks for must not depend on their number
    # yet, so hot chunks, few by definition, are marked in a join of their own, over as many salts as the hottest needs
    hot = shared.where("ways > 0")
    most = hot.agg(F.max("ways")).first()[0] or 0  # one number
    cold = seen.join(shared.where("ways = 0").select("chunk", "ways"), "chunk")
    if most:
        salted = hot.select("chunk", "ways", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("salt"))
        cold = cold.unionByName(seen.withColumn("salt", F.pmod(F.xxhash64("doc_id", "ord"), F.lit(most + 1)).cast("int")).join(salted, ["chunk", "salt"]).drop("salt"))
    uses = cold.select("doc_id", "tid", "ord", "chunk", F.pmod(F.xxhash64("ord", "doc_id"), F.col("ways") + 1).cast("int").alias("salt"))
    given = uses.join(spread, ["chunk", "salt"]).groupBy("doc_id", "tid").agg(F.collect_list(F.struct("ord", "ids")).alias("given"))
    return by_doc.join(given, ["doc_id", "tid"], "left").select("doc_id", "text", "given").mapInArrow(_encode_rest(folder), "doc_id bigint, ids array<int>")
