"""Gates as streams: the decisions of a plain loop, whatever the order of arrival, over restarts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarrylake.plans import sessions
from quarrylake.streaming import gates
from tests.test_operators import plain_admission, plain_guards

SCHEMA = "key string, id long, session string, at double, flagged boolean"
END = [("", -1, "end", 9e8, False)]


def plain_waits(rows, per_minute):
    starts, out = [], {}
    for id_, at in sorted(rows, key=lambda r: (r[1], r[0])):
        start = max(at, starts[-1] if starts else at, starts[-per_minute] + 60 if len(starts) >= per_minute else at)
        starts.append(start)
        out[id_] = start
    return out


def drained(spark, place, parts, rule, late="10 minutes"):
    """Each part is one run of the stream, started anew from the checkpoint."""
    out = None
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{place}/in/part{i}")
        out = gates.run(spark, f"{place}/in", SCHEMA, f"{place}/state", f"{place}/out", rule, late)
    return {(r["key"], r["id"]): (r["decision"], r["value"]) for r in out.collect() if r["key"]}


def shuffled(rows, size):
    """Rows of two parts, each in no order; the second may begin ten minutes before the first ends."""
    rows = sorted(rows, key=lambda r: r[3])
    rng = random.Random(1)
    cut = [rows[:size], rows[size:]]
    cut[0], cut[1] = cut[0] + cut[1][5:15:3], cut[1][:5] + [r for i, r in enumerate(cut[1][5:15]) if i % 3] + cut[1][15:]
    for part in cut:
        rng.shuffle(part)
    return [*cut, END]


@pytest.fixture
def place(tmp_path):
    return str(tmp_path)


def requests(n=400, span=1_800):
    rng = random.Random(8)
    return [(f"s{rng.randrange(2)}", i, f"u{rng.randrange(5)}", float(rng.randrange(span)), False) for i in range(n)]


def test_admission_stream(spark, place):
    rows = requests()
    got = drained(spark, place, shuffled(rows, 200), gates.admission(8, 25))
    want = plain_admission([(i, s, u, at) for s, i, u, at, _ in rows], 8, 25)
    assert {i: (d, int(v)) for (_, i), (d, v) in got.items()} == want
    assert {d for d, _ in want.values()} == {"allowed", "rate", "session"}


def test_waiting_stream(spark, place):
    rows = requests()
    got = drained(spark, place, shuffled(rows, 200), gates.waiting(6))
    for key in ("s0", "s1"):
        assert {i: v for (k, i), (_, v) in got.items() if k == key} == plain_waits([(i, at) for s, i, _, at, _ in rows if s == key], 6)


def test_guards_stream_outlives_days(spark, place):
    rng = random.Random(2)
    rows = [("site", i, f"u{rng.randrange(12)}", float(rng.randrange(4 * 86_400)), rng.random() < 0.2) for i in range(300)]
    got = drained(spark, place, shuffled(rows, 150), gates.guards(9, 20), "1 day")
    want = plain_guards([(i, u, at, f) for _, i, u, at, f in rows], 9, 20)
    assert {i: d for (_, i), (d, _) in got.items()} == {i: d or "allowed" for i, d in want.items()}
    assert set(want.values()) == {None, "session_cap", "injection", "daily_budget"}


def events_of(spark, small_dir, divide):
    return [(r["event_id"], r["event_type"], str(r["user_id"]), r["at"]) for r in spark.read.parquet(f"{small_dir}/events.parquet").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / divide).collect()]


def test_stream_of_events_equals_the_plain_rule(spark, small_dir):
    got = {r["request_id"]: (r["decision"], r["used"]) for r in sessions.stream_admission(spark, small_dir).collect()}
    assert got == plain_admission(events_of(spark, small_dir, 1e9), sessions.PER_MINUTE, sessions.SESSION_REQUESTS)


def test_guards_of_events_equal_the_plain_rule(spark, small_dir, monkeypatch):
    monkeypatch.setattr(sessions, "SESSION_CAP", 25)
    monkeypatch.setattr(sessions, "DAY_BUDGET", 27)
    got = {r["turn_id"]: r["reason"] for r in sessions.guard_decisions(spark, small_dir).collect()}
    want = plain_guards([(i, u, at, i % 11 == 0) for i, _, u, at in events_of(spark, small_dir, 1e6)], 25, 27)
    assert got == want and set(want.values()) == {None, "session_cap", "injection", "daily_budget"}
