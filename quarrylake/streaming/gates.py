"""Admission, waiting and guards as streams: state by key that outlives batches, days and restarts, and decisions in order of time.

Rows of a key wait in its state until the watermark has passed them, and are then decided in order
of their time and id, whatever order they came in; a timer for the earliest of them calls for that.
So the decisions are those of a plain loop over the key's rows in order, over restarts from the
checkpoint too. Rows later than the watermark are dropped by Spark; how long rows wait for later ones is
the watermark's delay. State holds the waiting rows, the times of the window and a count for each
session; it lies in RocksDB, so that sessions needn't fit in memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrylake.operators.admission import WINDOW_SECONDS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "key string, id long, decision string, value double"
_DAY = 86_400


class Held:
    """A key's state while its rows are decided: times of the window, two numbers, counts of sessions read when asked for."""

    def __init__(self, times: list[float], numbers: tuple[int, int], read: Callable[[str], int]):
        self.times, self.numbers, self.counts, self._read = deque(times), numbers, {}, read

    def used(self, session: str) -> int:
        if session not in self.counts:
            self.counts[session] = self._read(session)
        return self.counts[session]

    def use(self, session: str) -> int:
        self.counts[session] = self.used(session) + 1
        return self.counts[session]


Rule = Callable[[Held, float, str, bool], tuple[str, float]]


def admission(per_minute: int, per_session: int) -> Rule:
    """allowed, rate or session, and the session's count: rows that are turned down take no room."""

    def decide(held: Held, at: float, session: str, flagged: bool) -> tuple[str, float]:
        while held.times and held.times[0] < at - WINDOW_SECONDS:
            held.times.popleft()
        if len(held.times) >= per_minute:
            return "rate", held.used(session)
        if held.used(session) >= per_session:
            return "session", held.used(session)
        held.times.append(at)
        return "allowed", held.use(session)

    return decide


def waiting(per_minute: int) -> Rule:
    """When a row starts: no more than ``per_minute`` start in a window, none is turned down."""

    def decide(held: Held, at: float, session: str, flagged: bool) -> tuple[str, float]:
        start = max(at, held.times[-1] if held.times else at)
        if len(held.times) == per_minute:
            start = max(start, held.times.popleft() + WINDOW_SECONDS)
        held.times.append(start)
        return "started", start

    return decide


def guards(session_cap: int, daily_budget: int) -> Rule:
    """session_cap, injection, daily_budget or allowed, in that order; a turn that reaches the budget counts for its day, one let in for its session, which outlives days."""

    def decide(held: Held, at: float, session: str, flagged: bool) -> tuple[str, float]:
        day, turns = held.numbers
        if day != at // _DAY:
            day, turns = int(at // _DAY), 0
        held.numbers = day, turns
        if held.used(session) >= session_cap:
            return "session_cap", held.used(session)
        if flagged:
            return "injection", held.used(session)
        held.numbers = day, turns + 1
        if turns + 1 > daily_budget:
            return "daily_budget", held.used(session)
        return "allowed", held.use(session)

    return decide


class _Gate(StatefulProcessor):
    def __init__(self, rule: Rule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "at double, id long, session string, flagged boolean")
        self.times = handle.getListState("times", "at double")
        self.numbers = handle.getValueState("numbers", "day long, turns long")
        self.counts = handle.getMapState("counts", "session string", "n long")

    def _call(self, at: float) -> None:
        self.handle.registerTimer(int(at * 1000) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names that Spark calls by
        first = None
        for some in rows:
            listed = [(float(r.at), int(r.id), str(r.session), bool(r.flagged)) for r in some.itertuples()]
            if listed:
                self.rows.appendList(listed)
                first = min(min(listed)[0], float("inf") if first is None else first)
        if first is not None:
            self._call(first)
        yield pd.DataFrame({"key": pd.Series(dtype=str), "id": pd.Series(dtype="int64"), "decision": pd.Series(dtype=str), "value": pd.Series(dtype="float64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        waiting_ = [tuple(r) for r in self.rows.get()]
        due = sorted(r for r in waiting_ if r[0] <= passed)
        if not due:
            return
        later = [r for r in waiting_ if r[0] > passed]
        read = lambda session: int(self.counts.getValue((session,))[0]) if self.counts.containsKey((session,)) else 0
        held = Held([r[0] for r in self.times.get()], tuple(self.numbers.get()) if self.numbers.exists() else (-1, 0), read)
        out = [(key[0], id_, *self.rule(held, at, session, flagged)) for at, id_, session, flagged in due]
        for state, values in ((self.times, [(t,) for t in held.times]), (self.rows, later)):
            if values:
                state.put(values)
            else:
                state.clear()
        self.numbers.update(held.numbers)
        for session, n in held.counts.items():
            self.counts.updateValue((session,), (n,))
        if later:
            self._call(min(later)[0])
        yield pd.DataFrame(out, columns=["key", "id", "decision", "value"]).astype({"value": "float64"})

    def close(self) -> None:
        pass


def decided(requests: DataFrame, rule: Rule, late: str = "1 minute") -> DataFrame:
    """(key, id, decision, value) of a stream (key, id, session, at: seconds, flagged).

    Rows without key, session or time are decided by nobody: filter them first.
    """
    whole = requests.dropna(subset=["key", "id", "session", "at"])
    rows = whole.select(F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), F.col("session").cast("string").alias("session"), F.col("at").cast("double").alias("at"), F.coalesce("flagged", F.lit(False)).alias("flagged"))
    timed = rows.withColumn("seen", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).withWatermark("seen", late)
    return timed.groupBy("key").transformWithStateInPandas(_Gate(rule), _OUT, "append", "eventTime")


def run(spark: SparkSession, folder: str, schema: str, state: str, result: str, rule: Rule, late: str = "1 minute", files: int | None = None) -> DataFrame:
    """Stream the Parquet files of a folder through ``decided`` until all are read; called again with the same ``state``, it goes on with new files."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
        if files:
            source = source.option("maxFilesPerTrigger", files)

        def keep(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{result}/epoch={epoch}")  # a batch that is tried again writes the same place

        stream = decided(source.parquet(folder), rule, late).writeStream.outputMode("append").option("checkpointLocation", state)
        stream.foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(_OUT).parquet(result)
