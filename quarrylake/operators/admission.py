"""Admission of requests by rate and budget: who is let in depends on who was before, so rejected requests take no room."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.operators.graph import stored

WINDOW_SECONDS = 60.0


def admit(requests: DataFrame, per_minute: int, per_session: int, service: str = "service", session: str = "session") -> DataFrame:
    """(request_id, decision, used) of requests (request_id, service, session, at: seconds): allowed, rate, or session.

    A request is turned down if its service let in ``per_minute`` requests in the 60 seconds before, or its session
    has used its budget there; only requests let in count. ``used`` is the session's count afterwards. Time order,
    then request_id. The rule itself is serial for one service: each service is one task's stream of rows, read batch by
    batch with the last minute's times and the sessions' counts as its only state. A null service, session or time is turned down.
    """
    schema = "request_id long, decision string, used int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, window, used = None, deque(), {}
        for batch in batches:
            out = []
            for request, name, who, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != held:
                    held, window, used = name, deque(), {}
                while window and window[0] < at - WINDOW_SECONDS:
                    window.popleft()
                n = used.get(who, 0)
                if len(window) >= per_minute:
                    out.append((request, "rate", n))
                elif n >= per_session:
                    out.append((request, "session", n))
                else:
                    window.append(at)
                    used[who] = n + 1
                    out.append((request, "allowed", n + 1))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int32()))], ["request_id", "decision", "used"])

    rows = requests.select(F.col("request_id").cast("long").alias("request_id"), F.col(service).cast("string").alias("s"), F.col(session).cast("string").alias("w"), F.col("at").cast("double").alias("at"))
    known = rows.dropna(subset=["s", "w", "at"])
    told = known.repartition("s").sortWithinPartitions("s", "at", "request_id").mapInArrow(run, schema)
    unknown = rows.filter(F.col("s").isNull() | F.col("w").isNull() | F.col("at").isNull()).select("request_id", F.lit("invalid").alias("decision"), F.lit(0).alias("used"))
    return told.unionByName(unknown)


def guarded(turns: DataFrame, session_cap: int, daily_budget: int, flagged: str = "flagged") -> DataFrame:
    """(turn_id, reason) of user turns (turn_id, session, at, flagged): null for a turn let in, else session_cap, injection or daily_budget.

    Guards run in that order. A turn that reaches the budget counts for its day, over it or not; only turns let in count for their
    session, which outlives days. Until a day's budget runs out, sessions don't touch each other: a turn is let in if it isn't
    flagged and fewer than ``session_cap`` before it in its session were. So a span of days is decided at once by windows over sessions, up to
    the first whose budget runs out; what that day has let in is then known, and the days after it are decided anew. A span is a day after one that ran out and twice
    the last where none did, so rows are read a bounded number of times, however many days run out; only counts of sessions go from span to span.
    Order is by time, then turn_id; rows without session or time get the reason invalid.
    """
    rows = turns.select(F.col("turn_id").cast("long").alias("turn_id"), F.to_date("at").alias("day"), F.col("session").cast("string").alias("w"), F.coalesce(F.col(flagged), F.lit(False)).alias("bad"), "at")
    done = [rows.filter(F.col("w").isNull() | F.col("at").isNull()).select("turn_id", F.lit("invalid").alias("reason"))]
    rest = stored(rows.dropna(subset=["w", "at"]).repartitionByRange("at", "turn_id"), "turns")  # a span reads few files
    days = [r["day"] for r in rest.select("day").distinct().orderBy("day").collect()]
    own = Window.partitionBy("w").orderBy("at", "turn_id")
    used, at, span = None, 0, 1
    while at < len(days):
        part = rest.filter(F.col("day").between(F.lit(days[at]), F.lit(days[min(at + span, len(days)) - 1])))
        part = part.withColumn("used", F.lit(0).cast("long")) if used is None else part.join(used, "w", "left").withColumn("used", F.coalesce("used", F.lit(0).cast("long")))
        # the clean turns before this one in its session, after those of spans that are done
        before = F.coalesce(F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        told = part.select("turn_id", "day", "w", "bad", "at", F.least(F.col("used") + before, F.lit(session_cap)).alias("count"))
        told = stored(told.withColumn("reason", F.when(F.col("count") >= session_cap, "session_cap").when(F.col("bad"), "injection")), "told")
        let_in = told.filter(F.col("reason").isNull())
        out = let_in.groupBy("day").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > daily_budget).agg(F.min("day").alias("day")).first()["day"]
        early = told
        if out is not None:
            of_day = F.col("day") == F.lit(out)
            last = let_in.filter(of_day).select("at", "turn_id").orderBy("at", "turn_id").limit(daily_budget).agg(F.max(F.struct("at", "turn_id")).alias("last")).first()["last"]
            after = F.lit(True) if last is None else (F.col("at") > F.lit(last["at"])) | ((F.col("at") == F.lit(last["at"])) & (F.col("turn_id") > last["turn_id"]))
            early = told.filter((F.col("day") < F.lit(out)) | (of_day & ~after))
            # nobody is let in after that, so a session stays at what its first turn there found
            spent = told.filter(of_day & after).withColumn("count", F.min("count").over(Window.partitionBy("w")))
            done.append(spent.select("turn_id", F.when(F.col("count") >= session_cap, "session_cap").when(F.col("bad"), "injection").otherwise("daily_budget").alias("reason")))
        done.append(early.select("turn_id", "reason"))
        at, span = (min(at + span, len(days)), 2 * span) if out is None else (days.index(out) + 1, 1)
        if at < len(days):
            more = early.filter(F.col("reason").isNull()).groupBy("w").agg(F.count(F.lit(1)).alias("used"))
            used = stored(more if used is None else used.unionByName(more).groupBy("w").agg(F.sum("used").alias("used")), "used")
    return reduce(DataFrame.unionByName, done)


def released(requests: DataFrame, per_minute: int, service: str = "service") -> DataFrame:
    """(request_id, at, wait): a limiter that makes requests wait, never turns them down: each starts when fewer than ``per_minute`` started in the 60 seconds before.

    In time order a request starts at the later of its own time, the start before it, and 60 seconds after the start ``per_minute`` before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, starts = None, deque(maxlen=per_minute)
        for batch in batches:
            out = []
            for request, name, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != held:
                    held, starts = name, deque(maxlen=per_minute)
                start = max(at, starts[-1] if starts else at, starts[0] + WINDOW_SECONDS if len(starts) == per_minute else at)
                starts.append(start)
                out.append((request, start, start - at))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.float64()))], ["request_id", "at", "wait"])

    rows = requests.select(F.col("request_id").cast("long").alias("request_id"), F.col(service).cast("string").alias("s"), F.col("at").cast("double").alias("at")).dropna()
    return rows.repartition("s").sortWithinPartitions("s", "at", "request_id").mapInArrow(run, "request_id long, at double, wait double")
