"""Rates, budgets and sessions over events, conversation history, and their streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylake.operators.admission import guarded
from quarrylake.operators.graph import scratch
from quarrylake.plans.tables import table
from quarrylake.streaming import gates, rates

PER_DAY, PER_SESSION, GAP_SECONDS, LAST, TRIM_CHARS = 5, 3, 43_200, 4, 600
#: Turns that a session and a day let in; requests that a service lets in a minute, and one session of it.
SESSION_CAP, DAY_BUDGET, PER_MINUTE, SESSION_REQUESTS = 50, 320, 8, 12
_REQUESTS = "key string, id long, session string, at double, flagged boolean"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def sliding_60s_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the same user in the 60 seconds up to each event, edges included."""
    trailing = Window.partitionBy("user_id").orderBy("us").rangeBetween(-60_000_000, 0)
    return _events(spark, sf_dir).select("event_id", F.count(F.lit(1)).over(trailing).alias("n"))


def daily_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's number within its user's day, and whether it is over the budget; all events count."""
    nth = F.row_number().over(Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id"))
    return _events(spark, sf_dir).select("event_id", nth.alias("used"), (nth > PER_DAY).alias("over"))


def session_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions split by half a day of silence: events in each, and how many its budget allows."""
    own = Window.partitionBy("user_id").orderBy("us", "event_id")
    begins = F.coalesce((F.col("us") - F.lag("us").over(own) > GAP_SECONDS * 1_000_000).cast("int"), F.lit(1))
    rows = _events(spark, sf_dir).withColumn("begins", begins).withColumn("session", F.sum("begins").over(own))
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n")).withColumn("allowed", F.least("n", F.lit(PER_SESSION).cast("long")))


def stream_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in sliding windows, by a stream over the event files that ends when they are read."""
    return rates.sliding_counts(spark, sf_dir)


def guard_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as turns behind the guards, every eleventh flagged: sessions outlive days, days have a budget of all sessions."""
    turns = table(spark, sf_dir, "events").select(F.col("event_id").alias("turn_id"), F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 11 == 0).alias("flagged"))
    return guarded(turns, SESSION_CAP, DAY_BUDGET)


def stream_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests, a thousand times as dense, admitted by a stream in two runs; the second goes on from the checkpoint of the first."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e9
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("session"), at.alias("at"), F.lit(False).alias("flagged"))
    first, last = rows.agg(F.min("at"), F.max("at")).first()
    end = spark.createDataFrame([("", -1, "", (last or 0.0) + 1e6, False)], _REQUESTS)  # moves the watermark past all rows
    place = scratch(spark, "requests")
    half = ((first or 0.0) + (last or 0.0)) / 2
    for part, some in enumerate((rows.filter(F.col("at") <= half), rows.filter(F.col("at") > half).unionByName(end))):
        some.write.parquet(f"{place}/in/part{part}")
        found = gates.run(spark, f"{place}/in", _REQUESTS, f"{place}/state", f"{place}/out", gates.admission(PER_MINUTE, SESSION_REQUESTS))
    return found.filter("key <> ''").select(F.col("id").alias("request_id"), "decision", F.col("value").cast("int").alias("used"))


def history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four messages of each conversation."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", back.alias("back")).filter(F.col("back") <= LAST)


def prior_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each assistant message, the turn of the user's last message before it."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(before)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", asked.alias("asked")).filter("role = 'assistant'").drop("role")


def history_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest messages of each conversation that fit the budget of characters; the newest always stays."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("total", F.sum(F.length(F.coalesce("text", F.lit("")))).over(newest)).withColumn("back", F.row_number().over(newest))
    return rows.filter((F.col("total") <= TRIM_CHARS) | (F.col("back") == 1)).select("conv_id", "turn", "total")


QUERIES = {f.__name__: f for f in (sliding_60s_rate, daily_budget, session_budget, stream_sliding_counts, guard_decisions, stream_admission, history_last_n, prior_context, history_trim)}

ORACLES = {
    "sliding_60s_rate": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS n FROM events",
    "daily_budget": f"SELECT event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)::INTEGER AS used, used > {PER_DAY} AS over FROM events",
    "session_budget": f"""WITH b AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w > {GAP_SECONDS * 1_000_000})::INTEGER, 1) AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM b)
SELECT user_id, session, count(*) AS n, least(count(*), {PER_SESSION})::BIGINT AS allowed FROM s GROUP BY ALL""",
    "stream_sliding_counts": f"""WITH w AS (SELECT event_type, unnest([s, s - {rates.SLIDE}]) AS start FROM (SELECT event_type, (epoch_us(ts) // 1000000 // {rates.SLIDE}) * {rates.SLIDE} AS s FROM events))
SELECT event_type, start::BIGINT AS start, count(*) AS n FROM w GROUP BY ALL""",
    "history_last_n": f"SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::INTEGER AS back FROM conversations QUALIFY back <= {LAST}",
    "prior_context": "SELECT conv_id, turn, asked FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM conversations) WHERE role = 'assistant'",
    "history_trim": f"SELECT conv_id, turn, (sum(length(coalesce(text, ''))) OVER w)::BIGINT AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC) QUALIFY total <= {TRIM_CHARS} OR row_number() OVER w = 1",
}
