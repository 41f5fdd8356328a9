"""File events: debounce with a hard cap, latest event while busy, reconciliation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QUIET_MS, CAP_MS = 2500, 5000
OUT = "path string, event string, first_ms long, last_ms long, n long"


def cut(times: list[int], events: list[str], quiet: int = QUIET_MS, cap: int = CAP_MS) -> list[tuple[str, int, int, int]]:
    """Bursts of one path's ordered events: a pause of ``quiet`` ends one, and so does an age of ``cap``."""
    out: list[tuple[str, int, int, int]] = []
    first = last = n = 0
    event = ""
    for t, e in zip(times, events):
        if n and (t - last >= quiet or t - first >= cap):
            out.append((event, first, last, n))
            n = 0
        if not n:
            first = t
        event, last, n = e, t, n + 1
    if n:
        out.append((event, first, last, n))
    return out


def debounce(events: DataFrame) -> DataFrame:
    """Bursts of ``events(path, event, ms)``, all at once: for batches of events that are complete.

    Pauses split a path's events into stretches first, by the event before alone. A stretch no longer than the cap is a
    burst; only longer ones are walked through, event by event, in an array of that stretch.
    """
    order = Window.partitionBy("path").orderBy("ms", "event")
    rows = events.select("path", "event", "ms").withColumn("_new", (F.col("ms") - F.lag("ms").over(order) >= QUIET_MS).cast("int"))
    rows = rows.withColumn("_s", F.sum(F.coalesce("_new", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("path", "_s").agg(F.max_by("event", F.struct("ms", "event")).alias("event"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.count("*").alias("n"))
    short = runs.filter(F.col("last_ms") - F.col("first_ms") < CAP_MS).select("path", "event", "first_ms", "last_ms", "n")
    long = runs.filter(F.col("last_ms") - F.col("first_ms") >= CAP_MS).select("path", "_s")
    e = rows.join(long, ["path", "_s"]).groupBy("path", "_s").agg(F.array_sort(F.collect_list(F.struct("ms", "event"))).alias("e"))
    # where bursts begin in the array: it grows once a burst, and bursts are slices of it
    start = F.struct(F.lit(0).alias("i"), F.lit(None).cast("bigint").alias("first"), F.array().cast("array<int>").alias("at"))

    def step(acc, x):
        new = acc["first"].isNull() | (x["ms"] - acc["first"] >= CAP_MS)
        return F.struct((acc["i"] + 1).alias("i"), F.when(new, x["ms"]).otherwise(acc["first"]).alias("first"), F.when(new, F.concat(acc["at"], F.array(acc["i"]))).otherwise(acc["at"]).alias("at"))

    at = e.withColumn("at", F.aggregate("e", start, step, lambda acc: acc["at"]))
    parts = F.transform("at", lambda x, i: F.slice("e", x + 1, F.coalesce(F.get("at", i + 1), F.size("e")) - x))
    last = lambda c: F.element_at("b", -1)[c]
    cuts = at.select("path", F.explode(parts).alias("b")).select("path", last("event").alias("event"), F.get("b", 0)["ms"].alias("first_ms"), last("ms").alias("last_ms"), F.size("b").cast("long").alias("n"))
    return short.unionByName(cuts)


def debounce_stream(events: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """The same over a stream ``events(path, event, ts)``: a burst leaves when the watermark passes its end."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, str]] = [tuple(x) for x in zip(*state.get)] if state.exists else []
        for pdf in parts:
            held += list(zip((pdf["ts"].astype("int64") // 10**6 if str(pdf["ts"].dtype).endswith("[ns]") else pdf["ts"].astype("datetime64[ms]").astype("int64")).tolist(), pdf["event"].tolist()))
        held.sort()
        bursts = cut([t for t, _ in held], [e for _, e in held])
        mark = state.getCurrentWatermarkMs()
        done = [b for b in bursts if b[2] + QUIET_MS <= mark]
        rest = held[sum(b[3] for b in done) :]
        if rest:
            state.update(([t for t, _ in rest], [e for _, e in rest]))
            state.setTimeoutTimestamp(max(mark + 1, rest[-1][0] + QUIET_MS))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], *b) for b in done], columns=["path", "event", "first_ms", "last_ms", "n"])

    return events.withWatermark("ts", delay).groupBy("path").applyInPandasWithState(run, OUT, "t array<bigint>, e array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def latest(events: DataFrame) -> DataFrame:
    """The last event of each path; of equal times the greater name."""
    return events.groupBy("path").agg(F.max(F.struct("ms", "event")).alias("m")).select("path", F.col("m.event").alias("event"), F.col("m.ms").alias("ms"))


def suppressed(events: DataFrame, writes: DataFrame, ttl_ms: int = 5000) -> DataFrame:
    """Events that don't follow one of our own writes of the path within ``ttl_ms``."""
    w = writes.select("path", F.col("ms").alias("_w"))
    return events.join(w, (events["path"] == w["path"]) & (events["ms"] >= w["_w"]) & (events["ms"] - w["_w"] < ttl_ms), "left_anti")


def retained(log: DataFrame, now_ms: int, hours: int = 24) -> DataFrame:
    return log.filter(F.col("timestamp") >= now_ms - hours * 3_600_000)


def quiet_nodes(nodes: DataFrame, now_ms: int, minutes: int = 60) -> DataFrame:
    """Nodes old enough for the normaliser's sweep."""
    return nodes.filter(F.col("file_mtime") < now_ms - minutes * 60_000)


def windowed(events: DataFrame, minutes: int = 10) -> DataFrame:
    """Counts and sums of ``events(ts, event_type, value)`` by tumbling window; the same plan serves a stream."""
    return events.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
