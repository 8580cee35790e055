"""Structured Streaming operators: change streams, log joins, gates, sessions and windows.

Every operator takes and returns streaming (or batch) DataFrames; sources and sinks stay with the caller.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RING, GATE_LIMIT, FULL_CALLS = 256, 3, 4


def watch_files(spark: SparkSession, path: str, schema, max_files: int = 1000) -> DataFrame:
    """New files of a folder as a stream; a micro-batch is the debounced change set."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run_changes(stream: DataFrame, apply, checkpoint: str, debounce: str | None = None):
    """Run ``apply(batch, epoch)`` on each micro-batch, one at a time; without ``debounce`` all that is there, then stop."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=debounce) if debounce else writer.trigger(availableNow=True)).start()


def windowed_counts(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by tumbling window; an addition of this engine."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions by user with an inactivity gap; an addition of this engine."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def attribute_stream(nudges: DataFrame, served: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Pairs of a nudge (user_id, ts) and the served events within the window after it: a stream-stream interval join."""
    n = nudges.withWatermark("ts", late).select("user_id", F.col("ts").alias("nudge_ts"))
    s = served.withWatermark("ts", late).select(F.col("user_id").alias("s_user"), F.col("ts").alias("served_ts"))
    return n.join(s, F.expr(f"user_id = s_user AND served_ts >= nudge_ts AND served_ts <= nudge_ts + INTERVAL {window}")).select("user_id", "nudge_ts", "served_ts")


def label_join(retrievals: DataFrame, labels: DataFrame, max_age: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Retrievals (request_id, ts) with the label that names them within max_age; unlabelled ones are kept once they are too old.

    A retrieval is consumed by the first label that names it; later ones for the same request are dropped.
    """
    r = retrievals.withWatermark("ts", late)
    m = labels.withWatermark("label_ts", late).dropDuplicatesWithinWatermark(["request_id"]).withColumnRenamed("request_id", "label_id")
    on = F.expr(f"request_id = label_id AND label_ts >= ts AND label_ts <= ts + INTERVAL {max_age}")
    return r.join(m, on, "leftOuter").drop("label_id")


#: A session's state is dropped after so long without events.
IDLE_MS = 24 * 3600 * 1000


def _stateful(rows: DataFrame, key: str, step, empty: tuple, output: str, state: str) -> DataFrame:
    """Run ``step(key, sorted events, state) -> (rows, state)`` on each key's events of a micro-batch in seq order.

    A batch's events of a key may come in several chunks, so they are put together before they are sorted; they are narrow rows,
    and the source bounds a batch. Idle keys lose their state after IDLE_MS.
    """
    names = [c.strip().split(" ")[0] for c in output.split(",")]

    def run(k, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        events = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out, new = step(k[0], events.itertuples(), held.get if held.exists else empty)
        held.update(new)
        held.setTimeoutDuration(IDLE_MS)
        if out:
            yield pd.DataFrame(out, columns=names)

    return rows.groupBy(key).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def pending_ring(events: DataFrame, size: int = RING) -> DataFrame:
    """Flush a pending retrieval when its label comes: (session, request_id, matched).

    events: session, seq, kind (retrieval or label), request_id. A session keeps its last ``size`` retrievals; older ones
    are evicted silently; a label without a pending retrieval is still written; a retrieval is consumed once.
    """

    def step(session, rows, state):
        pending, out = list(state[0]), []
        for r in rows:
            known = r.request_id in pending
            pending = [p for p in pending if p != r.request_id]
            if r.kind == "retrieval":
                pending = [*pending, r.request_id][-size:]
            else:
                out.append((session, r.request_id, known))
        return out, (pending,)

    return _stateful(events, "session", step, ([],), "session string, request_id string, matched boolean", "pending array<string>")


def search_gate(events: DataFrame, limit: int = GATE_LIMIT) -> DataFrame:
    """Block searches of a session until its first answer, ``limit`` times at most: (session, seq, blocked).

    events: session, seq, kind (search or answer).
    """

    def step(session, rows, state):
        (blocked, answered), out = state, []
        for r in rows:
            if r.kind == "answer":
                answered = True
                continue
            stop = not answered and blocked < limit
            blocked += stop
            out.append((session, r.seq, bool(stop)))
        return out, (blocked, answered)

    return _stateful(events, "session", step, (0, False), "session string, seq long, blocked boolean", "blocked int, answered boolean")


def session_compaction(calls: DataFrame, full: int = 6, after: int = FULL_CALLS) -> DataFrame:
    """Full bodies that each call of a session gets: ``full`` for the first calls, one afterwards: (session, seq, full_bodies)."""

    def step(session, rows, state):
        n, out = state[0], []
        for r in rows:
            n += 1
            out.append((session, r.seq, full if n <= after else 1))
        return out, (n,)

    return _stateful(calls, "session", step, (0,), "session string, seq long, full_bodies int", "n int")


class CursorCache:
    """The last ``size`` continuations of a server, by token; the one unused for longest goes first."""

    def __init__(self, size: int = 128):
        self.size, self._held = size, OrderedDict()

    def put(self, token: str, cursor) -> None:
        self._held[token] = cursor
        self._held.move_to_end(token)
        while len(self._held) > self.size:
            self._held.popitem(last=False)

    def get(self, token: str):
        if token in self._held:
            self._held.move_to_end(token)
        return self._held.get(token)


ROTATE_BYTES = 64 << 20


def rotate_log(spark: SparkSession, path: str, limit: int = ROTATE_BYTES) -> bool:
    """Move a log folder of ``limit`` bytes or more to ``path.1``, where it takes the place of the generation before it; whether it moved."""
    jvm = spark.sparkContext._jvm
    now, old = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".1")
    fs = now.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(now) or fs.getContentSummary(now).getLength() < limit:
        return False
    fs.delete(old, True)
    return fs.rename(now, old)


def expire_log(spark: SparkSession, path: str, before: str) -> int:
    """Delete the days (folders day=...) of a log that lie before a date; their number."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    days = [f.getPath() for f in fs.listStatus(root)] if fs.exists(root) else []
    doomed = [d for d in days if d.getName().startswith("day=") and d.getName()[4:] < before]
    for d in doomed:
        fs.delete(d, True)
    return len(doomed)


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Append events as JSON lines in a folder for each day, which is what rotation and retention work on."""
    return stream.withColumn("day", F.to_date("ts")).writeStream.format("json").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
