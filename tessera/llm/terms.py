"""Frequency of every distinct term of a collection (burst tries).

Every task counts its records' terms in a burst trie: terms hang in small containers, and a container that grows
beyond ``BURST`` terms bursts into one container per next character, so prefixes are as long as the data make them.
Containers leave the task as (prefix, terms, counters). Their weights, summed over tasks for every ancestor prefix,
give the routes: the shortest prefixes that hold at most ``ROUTE_TERMS`` terms. Subtrees under one route meet in one task
and are merged. A task that met few terms of a heavy prefix hasn't burst it: the terms of such a container are summed one by
one, and each takes the longer route that it lies under, so that a term has one route whichever task counted it. Terms under
no route are complete by then. A route that gets more than its weight that way is split by a hash of the terms.

A term that stands in a third of all records is one entry per task before anything is shuffled.

Defined cases: null and empty terms are none; a term repeated in a record counts as one record and as many
occurrences; a null count of an occurrence is 0; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import current_rows, cut

#: Terms of a container before it bursts; terms that meet in one merge, about.
BURST, ROUTE_TERMS = 1024, 50_000
#: A term is common in more than this share of the records that have any term of its field.
COMMON = 0.02


class BurstTrie:
    """Occurrence and record counters by term, in containers under adaptive prefixes."""

    __slots__ = ("children", "container", "end", "limit")

    def __init__(self, limit: int = BURST):
        self.children: dict[str, BurstTrie] | None = None
        self.container: dict[str, list[int]] = {}
        self.end: list[int] | None = None
        self.limit = limit

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, at = self, 0
        while node.children is not None:
            if at == len(term):
                node.end = [node.end[0] + occurrences, node.end[1] + records] if node.end else [occurrences, records]
                return
            child = node.children.get(term[at])
            if child is None:
                child = node.children[term[at]] = BurstTrie(self.limit)
            node, at = child, at + 1
        rest = term[at:]
        if (c := node.container.get(rest)) is not None:
            c[0] += occurrences
            c[1] += records
        else:
            node.container[rest] = [occurrences, records]
            if len(node.container) > node.limit:
                node._burst()

    def _burst(self) -> None:
        full, self.container, self.children = self.container, {}, {}
        for rest, (o, r) in full.items():
            self.add(rest, o, r)

    def containers(self, prefix: str = "") -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
        """(prefix, [(term, occurrences, records)]) of every container, whole terms."""
        todo = [(prefix, self)]
        while todo:
            at, node = todo.pop()
            entries = [(at + rest, o, r) for rest, (o, r) in node.container.items()]
            if node.end:
                entries.append((at, *node.end))
            if entries:
                yield at, entries
            if node.children:
                todo += [(at + c, child) for c, child in node.children.items()]


_CONTAINERS = pa.schema([("field", pa.string()), ("prefix", pa.string()), ("terms", pa.list_(pa.string())), ("occurrences", pa.list_(pa.int64())), ("records", pa.list_(pa.int64()))])
_CONTAINERS_DDL = "field string, prefix string, terms array<string>, occurrences array<bigint>, records array<bigint>"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tries: dict[str, BurstTrie] = {}
    for batch in batches:
        for field, terms, counts in zip(*(batch.column(c).to_pylist() for c in ("field", "terms", "counts")), strict=True):
            trie = tries.get(field) or tries.setdefault(field, BurstTrie())
            if len(terms) == 1:
                if terms[0]:
                    trie.add(terms[0], counts[0] or 0, 1)
                continue
            here: dict[str, int] = {}
            for t, n in zip(terms, counts, strict=True):
                if t:
                    here[t] = here.get(t, 0) + (n or 0)
            for t, n in here.items():
                trie.add(t, n, 1)
    for field, trie in tries.items():
        rows = [(field, p, *map(list, zip(*entries, strict=True))) for p, entries in trie.containers()]
        for at in range(0, len(rows), 256):
            cols = list(zip(*rows[at : at + 256], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _CONTAINERS, strict=True)], schema=_CONTAINERS)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers of a route with several parts, by a hash of their terms."""
    schema = pa.schema([*_CONTAINERS, ("route", pa.string()), ("part", pa.int32())])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            ways = r["ways"]
            entries = list(zip(r["terms"], r["occurrences"], r["records"], strict=True))
            parts: dict[int, list] = {}
            for e in entries:
                parts.setdefault(crc32(e[0].encode("utf-8", "surrogatepass")) % ways if ways > 1 else 0, []).append(e)
            out += [{"field": r["field"], "prefix": r["prefix"], "terms": [e[0] for e in es], "occurrences": [e[1] for e in es], "records": [e[2] for e in es], "route": r["route"], "part": p} for p, es in parts.items()]
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Matching subtrees of all tasks in one trie."""
    trie = BurstTrie()
    for terms, occurrences, records in zip(pdf["terms"], pdf["occurrences"], pdf["records"], strict=True):
        for t, o, r in zip(terms, occurrences, records, strict=True):
            trie.add(t, int(o), int(r))
    rows = [e for _, entries in trie.containers() for e in entries]
    return pd.DataFrame(rows, columns=["term", "n_occurrences", "n_records"]).assign(field=pdf["field"].iat[0])[["field", "term", "n_occurrences", "n_records"]]


def count_terms(records: DataFrame) -> DataFrame:
    """``field, term, n_occurrences, n_records`` of ``field, terms, counts``, one row per record and field."""
    tries = cut(records.where("size(terms) > 0").select("field", "terms", "counts").mapInArrow(_count, _CONTAINERS_DDL))
    prefixes = lambda c: F.transform(F.sequence(F.lit(0), F.length(c)), lambda n: F.substring(F.col(c), F.lit(1), n))
    sizes = tries.groupBy("field", "prefix").agg(F.sum(F.size("terms")).alias("n"))
    weights = sizes.select("field", F.explode(prefixes("prefix")).alias("route"), "n").groupBy("field", "route").agg(F.sum("n").alias("weight"))
    # the empty prefix leads to all containers of a field, so it is settled without a join: one weight per field
    whole = weights.where("route = ''").select("field", F.col("weight").alias("all_terms"))
    routed = sizes.select("field", "prefix", F.explode(F.slice(prefixes("prefix"), 2, F.greatest(F.lit(1), F.length("prefix")))).alias("route")).where("route <> ''").join(weights, ["field", "route"])
    routed = routed.unionByName(sizes.join(F.broadcast(whole), "field").select("field", "prefix", F.lit("").alias("route"), F.col("all_terms").alias("weight")))  # whole: a row per field
    best = F.min(F.when(F.col("weight") <= ROUTE_TERMS, F.struct(F.length("route").alias("length"), "route", "weight"))).alias("best")
    chosen = cut(routed.groupBy("field", "prefix").agg(best).select("field", "prefix", "best.route", "best.weight"))
    routes = chosen.where("route is not null").select("field", "route", "weight").distinct()

    # terms in containers of heavy prefixes: candidates are their own prefixes, as long as some route below that prefix is
    below = routes.select("field", F.explode(prefixes("route")).alias("prefix"), F.length("route").alias("length")).groupBy("field", "prefix").agg(F.collect_set("length").alias("lengths"))
    heavy = tries.join(chosen.where("route is null").select("field", "prefix"), ["field", "prefix"], "left_semi").join(below, ["field", "prefix"], "left")
    entry = heavy.select("field", "lengths", F.explode(F.arrays_zip("terms", "occurrences", "records")).alias("e"))
    loose = entry.groupBy("field", F.col("e.terms").alias("term")).agg(F.sum("e.occurrences").alias("o"), F.sum("e.records").alias("r"), F.array_distinct(F.flatten(F.collect_set("lengths"))).alias("lengths"))
    own = F.transform(F.filter("lengths", lambda n: n <= F.length("term")), lambda n: F.substring(F.col("term"), F.lit(1), n))
    met = loose.select("field", "term", "o", "r", F.explode_outer(own).alias("route")).join(routes.withColumn("met", F.col("route")), ["field", "route"], "left")
    single = cut(met.groupBy("field", "term").agg(F.first("o").alias("o"), F.first("r").alias("r"), F.max("met").alias("route")))

    more = single.where("route is not null").groupBy("field", "route").agg(F.count(F.lit(1)).alias("more"))
    ways = routes.join(more, ["field", "route"], "left").select("field", "route", F.ceil((F.col("weight") + F.coalesce("more", F.lit(0))) / ROUTE_TERMS).cast("int").alias("ways"))
    whole = tries.join(chosen.where("route is not null").select("field", "prefix", "route"), ["field", "prefix"])
    few = single.where("route is not null").select("field", F.col("route").alias("prefix"), F.array("term").alias("terms"), F.array("o").alias("occurrences"), F.array("r").alias("records"), "route")
    parts = whole.select(*few.columns).unionByName(few).join(ways, ["field", "route"]).mapInArrow(_split, _CONTAINERS_DDL + ", route string, part int")
    merged = parts.groupBy("field", "route", "part").applyInPandas(_merge, "field string, term string, n_occurrences bigint, n_records bigint")
    return merged.unionByName(single.where("route is null").select("field", "term", F.col("o").alias("n_occurrences"), F.col("r").alias("n_records")))


def index_records(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """The terms of the code index, one row per record: domain_map and exports of current files, names of symbols."""
    current = current_rows(files, "domain_map", "exports")
    counts = F.transform(F.map_values("domain_map"), lambda v: F.coalesce(v["filename"], F.lit(0)) + F.coalesce(v["path"], F.lit(0)) + F.coalesce(v["symbol"], F.lit(0)))
    domain = current.select(F.lit("domain_map").alias("field"), F.map_keys("domain_map").alias("terms"), counts.cast("array<bigint>").alias("counts"))
    exports = current.select(F.lit("exports").alias("field"), F.col("exports").alias("terms"), F.transform("exports", lambda _: F.lit(1).cast("bigint")).alias("counts"))
    names = symbols.where("symbol_id is not null").groupBy("symbol_id").agg(F.collect_set("name").alias("terms")).select(F.lit("name").alias("field"), "terms", F.transform("terms", lambda _: F.lit(1).cast("bigint")).alias("counts"))
    return domain.unionByName(exports).unionByName(names)


def marked_terms(records: DataFrame, common: float = COMMON) -> DataFrame:
    """Counted terms with ``mark``: rare (one record), common (more than ``common`` of the field's records) or null."""
    having = records.where(F.exists("terms", lambda t: t != "")).groupBy("field").agg(F.count(F.lit(1)).alias("total"))
    mark = F.when(F.col("n_records") == 1, "rare").when(F.col("n_records") > F.col("total") * common, "common")
    return count_terms(records).join(F.broadcast(having), "field").select("field", "term", "n_occurrences", "n_records", mark.alias("mark"))  # having: a row per field
