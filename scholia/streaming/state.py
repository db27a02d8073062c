"""Turns as a stream: per-concept state kept by Structured Streaming, and the trace log as an append-only sink.

`resumed_attempts` starts from saved sessions, and holds turns back until the watermark has passed them, so that turns which come late and
out of order get the numbers that they have in order of time; a turn later than the watermark is dropped. State that has had no turn
for a time is cleared. `attempts_stream` is the plain form: no saved state, order within a micro-batch only.
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.evaluate import all_positive
from ..session import setting, stored

OUTPUT = "session long, node long, id long, attempt long, second boolean, failed_attempts long"
SAVED = "session long, nodes array<struct<node: long, failed: long>>"
#: Times are kept in microseconds since then, a turn without one comes first; so many turns are an element of the state.
EPOCH, MICRO, FIRST, APPENDED = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc), dt.timedelta(microseconds=1), -(1 << 63), 1000
Attempt = Row("session", "node", "id", "attempt", "second", "failed_attempts")
#: What opening a trace file counts as, when files are dealt to tasks.
OPENED = "64k"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def attempts_stream(turns: DataFrame) -> DataFrame:
    """For every turn of the stream(session, node, ts, id, c, k, e) its attempt number and whether it is a second strike.

    The state of a session's node is its number of failures; turns of one micro-batch are taken in order of time.
    """
    rows = turns.withColumn("ok", all_positive(F.col("c"), F.col("k"), F.col("e"))).select("session", "node", "ts", "id", "ok")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failed = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values(["ts", "id"])
        miss = (~rows["ok"]).astype("int64")
        before = failed + miss.cumsum() - miss
        state.update((int(failed + miss.sum()),))
        yield pd.DataFrame({"session": rows["session"], "node": rows["node"], "id": rows["id"], "attempt": before + 1, "second": before >= 1, "failed_attempts": before + miss})

    return rows.groupBy("session", "node").applyInPandasWithState(step, OUTPUT, "failed long", "append", GroupStateTimeout.NoTimeout)


class Attempts(StatefulProcessor):
    """A session: the failures so far of its nodes, and the turns that wait for the watermark. A session's nodes are one key, as each key costs some calls of the state's server."""

    def __init__(self, idle: int):
        self.idle = idle  # milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failed = handle.getValueState("failed", "nodes array<struct<node: long, failed: long, until: long>>")
        self.waiting = handle.getListState("waiting", "ts array<long>, id array<long>, ok array<boolean>, node array<long>")  # some turns each, as each element is parsed with its schema

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:  # noqa: N802, N803
        first = {n["node"]: n["failed"] for n in reversed(initialState["nodes"])}  # of a node told twice the first counts
        self.failed.update(([(n, failed, 0) for n, failed in first.items()],))

    def nodes(self) -> dict[int, tuple[int, int]]:
        """Failures of each node, and when they are forgotten (0: never)."""
        held = self.failed.get()
        return {n: (failed, until) for n, failed, until in held[0]} if held else {}

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last = 0
        for some in batched(rows, APPENDED):
            turns = [(FIRST if r.ts is None else (r.ts - EPOCH) // MICRO, r.id, bool(r.ok), r.node) for r in some]
            self.waiting.appendValue(columns(turns))
            last = max(last, *(t[0] for t in turns))
        self.handle.registerTimer(last // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        held = self.nodes()
        nodes = dict(held)
        turns = sorted(turn for part in self.waiting.get() for turn in zip(*part))
        due, last = bisect_left(turns, (passed * 1000,)), 0
        for ts, turn, ok, node in turns[:due]:
            failed, until = nodes.get(node, (0, 0))
            if until and ts // 1000 >= until:
                failed = 0  # the state had been cleared by then
            yield Attempt(key[0], node, turn, failed + 1, failed >= 1, failed + (not ok))
            nodes[node] = failed + (not ok), ts // 1000 + self.idle
            last = max(last, nodes[node][1])
        if 0 < due < len(turns):
            self.waiting.put([columns(part) for part in batched(turns[due:], APPENDED)])
        elif due:
            self.waiting.clear()
        nodes = {n: (failed, until) for n, (failed, until) in nodes.items() if not until or until > passed}
        if nodes and nodes != held:
            self.failed.update(([(n, failed, until) for n, (failed, until) in nodes.items()],))
        elif not nodes and held:
            self.failed.clear()
        if last > passed:
            self.handle.registerTimer(last)

    def close(self) -> None:
        pass


def columns(turns: Iterable[tuple]) -> tuple[list, ...]:
    """The values of each field of the turns."""
    return tuple(map(list, zip(*turns)))


def read_sessions(lines: DataFrame) -> DataFrame:
    """session, node, failed of saved sessions, a JSON text each in `lines(value)`; of unreadable ones nothing, so that they start afresh."""
    saved = lines.select(F.from_json("value", SAVED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("s")).where("s.session is not null and s.nodes is not null")
    return saved.select("s.session", F.explode("s.nodes").alias("n")).select("session", "n.node", "n.failed").where("node is not null and failed is not null")


def resumed_attempts(turns: DataFrame, saved: DataFrame, late: str, idle_days: int = 365) -> DataFrame:
    """As `attempts_stream`, from saved(session, node, failed), for turns that are up to `late` out of order.

    The session needs the state store STORE.
    """
    rows = turns.withWatermark("ts", late).withColumn("ok", all_positive(F.col("c"), F.col("k"), F.col("e"))).select(F.col("session").cast("long").alias("session"), F.col("node").cast("long").alias("node"), "ts", "id", "ok")
    first = saved.groupBy("session").agg(F.collect_list(F.struct("node", "failed")).alias("nodes")).groupBy("session")
    return rows.groupBy("session").transformWithState(Attempts(idle_days * 86_400_000), OUTPUT, "append", "eventTime", initialState=first)


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs the stream over what there is now into Parquet at `path`, and reads that."""
    with setting(stream.sparkSession, "spark.sql.streaming.stateStore.providerClass", STORE):
        run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def turn_rates(turns: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Turns and failures of each window of event time, with a watermark."""
    ok = all_positive(F.col("c"), F.col("k"), F.col("e"))
    rows = turns.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("turns"), F.count_if(~ok).alias("failed"))
    return rows.select(F.col("window.start").alias("start"), "turns", "failed")


def trace_sink(events: DataFrame, path: str, checkpoint: str):
    """Writes trace events as JSON below one folder for each session, exactly once for each micro-batch.

    A session's events of a micro-batch are one file, by one task: the driver is told of as many files as there are sessions, however many tasks read them.
    """
    return events.repartition("session").writeStream.format("json").partitionBy("session").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def trace_totals(spark: SparkSession, path: str) -> DataFrame:
    """session, n, first, last and at (the newest) of the trace events below `path`.

    They are many files of a few KB. At Spark's estimate for opening a file, 4 MB, a task would read a handful; by theirs it reads some hundreds.
    """
    with setting(spark, "spark.sql.files.openCostInBytes", OPENED):
        read = spark.read.schema("id long, at string, session long").json(path)
        return stored(read.groupBy("session").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.max("at").alias("at")), "trace-totals")


def save_sessions(state: DataFrame, path: str) -> DataFrame:
    """Overwrites the saved state of all sessions with JSON lines, and reads it back."""
    state.write.mode("overwrite").json(path)
    return state.sparkSession.read.schema(state.schema).json(path)
