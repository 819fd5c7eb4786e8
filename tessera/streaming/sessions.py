"""Sessions of events, live and at rest: debouncing, seen sets, the capture trigger and search streaks.

Each operator has one definition for batches and streams. State machines run as a fold over a partition sorted by
session and order: a task reads its sessions as a stream of rows and holds one session's state, so a session of any
length needs no more memory than its state.

Defined cases: events without a session or time are dropped; ties in time go by the event's id; a gap equal to the
timeout begins a new session; empty streams give nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import fixed as K
from tessera.session import top_k

MAX_CLAIM = 30


def debounce(changes: DataFrame, key: str, time: str, item: str, quiet: str = f"{K.DEBOUNCE_MS} milliseconds") -> DataFrame:
    """(key, start, end, items): one batch per burst of changes, its items distinct. Works on streams behind a watermark."""
    return changes.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(F.session_window(time, quiet).alias("w"), F.col(key)).agg(F.array_sort(F.collect_set(item)).alias("items"), F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "items", "n")


def first_seen(events: DataFrame, keys: list[str], time: str, order: str, ttl_seconds: int = 86400) -> DataFrame:
    """Events whose key wasn't seen within the time to live before; every sighting renews it."""
    w = Window.partitionBy(*keys).orderBy(time, order)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = micros(F.col(time)) - micros(F.lag(time).over(w))
    return events.withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") > ttl_seconds * 1_000_000)).drop("gap")


def first_seen_stream(events: DataFrame, keys: list[str], time: str, ttl_seconds: int = 86400) -> DataFrame:
    """The stream's form: a key's state is its last sighting, which every sighting renews, and leaves with the watermark.

    Rows of a key come in the order of their time within a chunk of a batch; what is older than the watermark is dropped.
    """
    ttl = ttl_seconds * 1_000_000

    def run(key, chunks, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        for rows in chunks:
            rows = rows.sort_values(time, kind="stable")
            fresh = []
            for t in rows[time].astype("datetime64[us]").astype("int64"):
                fresh.append(last is None or t - last > ttl)
                last = t if last is None else max(last, t)
            yield rows[fresh]
        state.update((last,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (last + ttl) // 1000 + 1))

    known = events.where(F.col(time).isNotNull()).withWatermark(time, f"{ttl_seconds} seconds")
    return known.groupBy(*keys).applyInPandasWithState(run, events.schema, "last bigint", "append", "EventTimeTimeout")


# ---- capture trigger ----------------------------------------------------------------------------------


def new_state() -> dict[str, Any]:
    return {"stop": 0, "active": 0, "since": 0, "quiet": 0, "armed": False, "fires": 0, "files": {}}


def advance(s: dict[str, Any], delta: dict[str, dict[str, int]], fresh: set[str], drift: bool) -> dict | None:
    """One stop of a session: merges its evidence, scores what isn't captured, and decides whether to fire.

    Score: uncaptured files, two for each settled edit (three active stops old), and the stops since the last fire.
    Firing: a moved head (blocks) before the cap of 20 before a quiet stop while armed; a fire claims the 30 files
    worked on most and starts the clocks anew.
    """
    s["stop"] += 1
    added = edited = 0
    for rel, d in sorted(delta.items()):
        f = s["files"].get(rel)
        if f is None:
            f = s["files"][rel] = {"reads": 0, "edits": 0, "gs": 0, "last": 0, "edit_at": -1, "retouches": 0, "captured": False, "fresh": rel in fresh}
            added += 1
        elif f["last"] < s["stop"]:
            f["retouches"] += 1
        f["reads"] += d.get("reads", 0)
        f["gs"] += d.get("gs", 0)
        if d.get("edits", 0):
            f["edits"] += d["edits"]
            edited += 1
            f["fresh"] = f["captured"] = False
            f["edit_at"] = -2
        f["last"] = s["stop"]
    if added or edited:
        s["active"], s["quiet"] = s["active"] + 1, 0
    else:
        s["quiet"] += 1
    s["since"] += 1
    for f in s["files"].values():
        if f["edit_at"] == -2:
            f["edit_at"] = s["active"]
    todo = [(r, f) for r, f in s["files"].items() if not f["captured"] and not f["fresh"]]
    settled = sum(f["edits"] > 0 and f["edit_at"] >= 0 and s["active"] - f["edit_at"] >= K.TRIGGER_SETTLE for _, f in todo)
    score = len(todo) + 2 * settled + s["since"]
    if not s["armed"] and score >= K.TRIGGER_ARM and s["active"] >= 1 and todo:
        s["armed"] = True
    if drift and len(todo) >= 2:
        fire, mode = "head-drift", "block"
    elif score >= K.TRIGGER_CAP and len(todo) >= 2:
        fire, mode = "cap", "inject"
    elif s["armed"] and s["quiet"] >= K.TRIGGER_QUIET:
        fire, mode = "descent", "inject"
    else:
        return None
    claimed = sorted(todo, key=lambda x: (-x[1]["edits"], -x[1]["retouches"], -x[1]["reads"], x[0]))[:MAX_CLAIM]
    for _, f in claimed:
        f["captured"] = True
    s.update(armed=False, active=0, since=0, quiet=0, fires=s["fires"] + 1)
    return {"fire": fire, "mode": mode, "files": [r for r, _ in claimed], "score": score}


DECISIONS = "session string, stop int, fire string, mode string, files array<string>, score int"


def _decide(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    session, state = None, new_state()
    for pdf in rows:
        out = []
        for r in pdf.itertuples(index=False):
            if r.session != session:
                session, state = r.session, new_state()
            d = advance(state, json.loads(r.delta), set(json.loads(r.fresh)), bool(r.drift))
            if d:
                out.append((session, state["stop"], d["fire"], d["mode"], d["files"], d["score"]))
        yield pd.DataFrame(out, columns=["session", "stop", "fire", "mode", "files", "score"])


def capture_trigger(stops: DataFrame) -> DataFrame:
    """Decisions of ``stops(session, ord, delta, fresh, drift)``; delta and fresh are JSON."""
    s = stops.where("session is not null").select("session", "ord", "delta", "fresh", "drift")
    return s.repartition("session").sortWithinPartitions("session", "ord").select("session", "delta", "fresh", "drift").mapInPandas(_decide, DECISIONS)


def capture_trigger_stream(stops: DataFrame) -> DataFrame:
    """The same on a stream: one state per session across micro-batches, rows of a batch in their order."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        own = json.loads(state.get[0]) if state.exists else new_state()
        pdf = pd.concat(list(rows)).sort_values("ord")  # the rows of one session in one micro-batch, which its trigger bounds
        out = []
        for r in pdf.itertuples(index=False):
            d = advance(own, json.loads(r.delta), set(json.loads(r.fresh)), bool(r.drift))
            if d:
                out.append((key[0], own["stop"], d["fire"], d["mode"], d["files"], d["score"]))
        state.update((json.dumps(own),))
        yield pd.DataFrame(out, columns=["session", "stop", "fire", "mode", "files", "score"])

    return stops.groupBy("session").applyInPandasWithState(step, DECISIONS, "state string", "append", GroupStateTimeout.NoTimeout)


# ---- search behaviour ---------------------------------------------------------------------------------


def streaks(calls: DataFrame) -> DataFrame:
    """(session, seq, kind, finds_since_read, searches_since_other, nudge) of ``calls(session, seq, kind)``.

    kind is find, search, read or other. Counters start anew at a read or a slice (finds) and at anything that opens
    or finds files (searches). Nudges: the second find without a read, the third search in a row, and every twelfth call.
    """
    w = Window.partitionBy("session").orderBy("seq")
    reset_find = F.sum(F.col("kind").isin("read", "gs").cast("int")).over(w)
    reset_search = F.sum(F.col("kind").isin("read", "gs", "find").cast("int")).over(w)
    c = calls.withColumns({"rf": reset_find, "rs": reset_search, "total": F.row_number().over(w)})
    finds = F.sum((F.col("kind") == "find").cast("bigint")).over(Window.partitionBy("session", "rf").orderBy("seq"))
    searches = F.sum((F.col("kind") == "search").cast("bigint")).over(Window.partitionBy("session", "rs").orderBy("seq"))
    c = c.withColumns({"finds_since_read": finds, "searches_since_other": searches})
    nudge = F.when((F.col("kind") == "find") & (F.col("finds_since_read") == 2), "read").when((F.col("kind") == "search") & (F.col("searches_since_other") == 3), "find").when(F.col("total") % 12 == 0, "checkpoint")
    return c.select("session", "seq", "kind", "finds_since_read", "searches_since_other", nudge.alias("nudge"))


def slice_nudges(calls: DataFrame, cap: int = 3) -> DataFrame:
    """(session, seq, file): the call by which a session slices one file for the third time; once per file."""
    w = Window.partitionBy("session", "file").orderBy("seq")
    return calls.where("kind = 'gs' and file is not null").withColumn("n", F.row_number().over(w)).where(F.col("n") == cap).select("session", "seq", "file")


def empty_nudges(calls: DataFrame, cap: int = 2) -> DataFrame:
    """(session, seq): searches that found nothing, the first two of a session."""
    w = Window.partitionBy("session").orderBy("seq")
    return calls.where("kind in ('search', 'find') and is_empty").withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap).select("session", "seq")


def redundant_searches(calls: DataFrame, cap: int = 6) -> DataFrame:
    """(session, seq): searches that brought nothing new, the first six of a session: after a find, slice or notebook call, with a result, and
    all of their ``files`` were met by earlier calls of the session."""
    met = calls.select("session", "seq", F.explode(F.array_distinct("files")).alias("file")).where("file <> ''")
    first = met.groupBy("session", "file").agg(F.min("seq").alias("first"))
    old = met.join(first, ["session", "file"]).groupBy("session", "seq").agg(F.max("first").alias("newest")).where("newest < seq")
    aware = calls.where("kind in ('find', 'gs', 'kb')").groupBy("session").agg(F.min("seq").alias("aware"))
    hits = calls.where("kind = 'search' and not coalesce(is_empty, false)").select("session", "seq").join(old, ["session", "seq"], "left_semi").join(aware, "session").where("aware < seq")
    return top_k(hits.select("session", "seq"), ["session"], ["seq"], cap).select("session", "seq")


def repeat_guesses(calls: DataFrame) -> DataFrame:
    """(session, seq, file): slices of a file right after a slice of it that only gave its menu."""
    w = Window.partitionBy("session").orderBy("seq")
    c = calls.where("kind = 'gs'").withColumns({"pf": F.lag("file").over(w), "pm": F.lag("is_menu").over(w)})
    return c.where("pm and pf = file").select("session", "seq", "file")


def breaker(passes: DataFrame, limit: int = 3) -> DataFrame:
    """(keeper, ord, streak, stopped) of repair passes ``keeper, ord, n_fixed``: after three passes in a row that each fixed something, repairs stop for good."""
    w = Window.partitionBy("keeper").orderBy("ord")
    run = passes.withColumn("reset", F.sum((F.col("n_fixed") == 0).cast("int")).over(w))
    streak = run.withColumn("streak", F.sum((F.col("n_fixed") > 0).cast("int")).over(Window.partitionBy("keeper", "reset").orderBy("ord")))
    before = F.coalesce(F.max("streak").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return streak.select("keeper", "ord", "streak", (before >= limit).alias("stopped"))


def retry_delay(attempt: int, seconds: int = 60, most: int = 3) -> int | None:
    """Seconds to wait before a failed rebuild is tried again; None when it was tried often enough."""
    return seconds * attempt if attempt <= most else None
