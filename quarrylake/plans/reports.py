"""Aggregated reports, gaps between tables, drift, run comparison, upserts and quality bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylake.operators import upsert as U
from quarrylake.operators.checks import drift
from quarrylake.plans.tables import table

#: The event types, in alphabetical order.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def data_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order."""
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no label covers."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no line item names."""
    return table(spark, sf_dir, "part").select("p_partkey").join(table(spark, sf_dir, "lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left_anti")


def source_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and labelled documents of each source, and how many lack a label."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count("has").alias("n_labelled")).withColumn("gap", F.col("n_docs") - F.col("n_labelled"))


def anchor_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three orders of each customer."""
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("pos", rank).filter("pos <= 3").select("o_custkey", "o_orderkey", "pos")


def first_non_null_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's earliest purchase value."""
    bought = table(spark, sf_dir, "events").filter("event_type = 'purchase' AND value IS NOT NULL")
    return bought.groupBy("user_id").agg(F.min_by("value", F.struct("ts", "event_id")).alias("first_value"))


def metric_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents longer than their language's mean by over two standard deviations."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n"))
    stats = docs.groupBy("lang").agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"))
    return docs.join(F.broadcast(stats), "lang").filter("n > mean + 2 * sd").select("doc_id", "lang")  # one row a language


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


_DAILY = "daily AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL)"


def baseline_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts that leave the median of up to five days before by over a fifth; no history passes."""
    rows = drift(_daily(spark, sf_dir), ["event_type"], ["day"], "n")
    return rows.select("event_type", F.col("day").cast("string").alias("day"), "n", "n_history", "drifted")


def noise_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of the daily counts of each event type, and how many days lie outside two standard deviations."""
    daily = _daily(spark, sf_dir)
    stats = daily.groupBy("event_type").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"))
    out = F.count(F.when(F.abs(F.col("n") - F.col("mean")) > 2 * F.col("sd"), 1)).alias("n_outside")
    return daily.join(F.broadcast(stats), "event_type").groupBy("event_type", "low", "high").agg(F.count(F.lit(1)).alias("n_days"), out)  # one row an event type


def pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled and good documents of each source."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return joined.groupBy("source").agg(F.count("quality").alias("n"), F.sum("quality").alias("passed")).withColumn("rate", F.col("passed") / F.col("n"))


def severity_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by failed documents, most first; one row a source reaches the ranking."""
    failed = pass_rates(spark, sf_dir).select("source", (F.col("n") - F.col("passed")).alias("failed"))
    return failed.withColumn("place", F.row_number().over(Window.orderBy(F.desc("failed"), "source")))


def paired_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired outcomes of two verdicts on the same documents: both, only the first, only the second, neither."""
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    return table(spark, sf_dir, "labels").agg(count(good & clean, "both_pass"), count(good & ~clean, "only_first"), count(~good & clean, "only_second"), count(~good & ~clean, "neither"))


def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs (orders of even and of odd key) over the customers: how each customer's count changed."""
    orders = table(spark, sf_dir, "orders")
    runs = [orders.filter(F.col("o_orderkey") % 2 == r).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias(f"n{r}")) for r in (0, 1)]
    outcome = F.when(F.col("n0").isNull(), "only_second").when(F.col("n1").isNull(), "only_first").when(F.col("n1") > F.col("n0"), "improved").when(F.col("n1") < F.col("n0"), "regressed").otherwise("same")
    return runs[0].join(runs[1], "k", "full_outer").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, different texts, labels and size of each source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("digest"), F.length("text").alias("size"))
    joined = docs.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return joined.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.countDistinct("digest").alias("n_texts"), F.count("toxic").alias("n_labelled"),
        F.coalesce(F.sum("toxic"), F.lit(0)).cast("long").alias("n_toxic"), F.sum("size").alias("n_chars"),
    )


def ledger_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by event types: counts."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.count(F.when(F.col("event_type") == t, 1)).alias(t) for t in EVENT_TYPES])


def ledger_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest event."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


def check_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and value, in steps of twenty."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.floor(F.col("value") / 20).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def breakdown_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by flag and status, by flag, and in all."""
    grouped = table(spark, sf_dir, "lineitem").groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus")
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    return out.select(F.coalesce("l_returnflag", F.lit("ALL")).alias("flag"), F.coalesce("l_linestatus", F.lit("ALL")).alias("status"), "n", "quantity")


def stratum_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and source, with subtotals; ``depth`` tells how many keys a row keeps."""
    out = table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return out.select("lang", "source", "n", F.when(F.col("g") == 0, 2).when(F.col("g") == 1, 1).otherwise(0).alias("depth"))


def catalog_distinct_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands and types of parts, each pair once."""
    return table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()


def first_document_per_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest document of each source (ties: the smaller id)."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("d"))).alias("m")).select("source", (-F.col("m.d")).alias("doc_id"), F.col("m.n_chars").alias("n_chars"))


def _order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with repeated keys: every tenth order twice, and new ones."""
    orders = table(spark, sf_dir, "orders").filter("o_orderkey % 10 = 0")
    step = lambda n, key, status: orders.select(key.alias("o_orderkey"), "o_custkey", F.lit(status).alias("o_orderstatus"), F.lit(n).alias("step"))
    return step(1, F.col("o_orderkey"), "X").unionByName(step(2, F.col("o_orderkey"), "Y")).unionByName(step(1, -F.col("o_orderkey") - 1, "N"))


def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.upsert(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), _order_changes(spark, sf_dir), ["o_orderkey"], "step")


def upsert_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with nulls: a null leaves the old value."""
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    batch = base.filter("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lit("renamed")).alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"), F.lit(1).alias("step"))
    return U.upsert(base, batch, ["c_custkey"], "step", coalesce=True)


def replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of two sources are replaced by one row each."""
    base = table(spark, sf_dir, "documents").select("source", "doc_id")
    batch = base.filter("source IN ('src0', 'src1')").groupBy("source").agg((-F.max("doc_id") - 1).alias("doc_id"))
    return U.replace_by_key(base, batch, ["source"])


def dq_rate_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of null or blank texts of each source, in bands: pass to 1 %, warn to 5 %, else fail."""
    bad = F.count(F.when(F.coalesce(F.trim("text") == "", F.lit(True)), 1))
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), bad.alias("n_bad"))
    return rows.withColumn("band", F.when(F.col("n_bad") <= 0.01 * F.col("n"), "pass").when(F.col("n_bad") <= 0.05 * F.col("n"), "warn").otherwise("fail"))


def dq_row_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether joining line items with their orders keeps each row just once."""
    lines, orders = table(spark, sf_dir, "lineitem").select("l_orderkey"), table(spark, sf_dir, "orders").select("o_orderkey")
    after = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).agg(F.count(F.lit(1)).alias("n_out"))
    return lines.agg(F.count(F.lit(1)).alias("n_in")).crossJoin(after).withColumn("kept", F.col("n_in") == F.col("n_out"))  # one row each


def interval_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that begin within 30 days of an earlier order of the customer: from the latest end so far, no pairs."""
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    earlier = Window.partitionBy("o_custkey").orderBy("start", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", start.alias("start"))
    return rows.withColumn("busy", F.max(F.col("start") + 30 * 86400).over(earlier)).filter("start < busy").select("o_custkey", "o_orderkey")


_NAMES = (
    "data_gaps missing_ids orphans source_gap anchor_first_n first_non_null_lookup metric_outliers baseline_drift noise_band pass_rates severity_ranking paired_compare run_diff corpus_report "
    "ledger_grid ledger_status check_histogram breakdown_grouping_sets stratum_rollup catalog_distinct_view first_document_per_section upsert_last_wins upsert_coalesce replace_by_key "
    "dq_rate_bands dq_row_preservation interval_conflicts"
)
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_PASS = "p AS (SELECT source, count(quality) AS n, sum(quality)::BIGINT AS passed FROM labels JOIN documents USING (doc_id) GROUP BY source)"
ORACLES = {
    "data_gaps": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "missing_ids": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "orphans": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)",
    "source_gap": "SELECT source, count(*) AS n_docs, count(l.doc_id) AS n_labelled, count(*) - count(l.doc_id) AS gap FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source",
    "anchor_first_n": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS pos FROM orders QUALIFY pos <= 3",
    "first_non_null_lookup": "SELECT user_id, value AS first_value FROM events WHERE event_type = 'purchase' AND value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "metric_outliers": "SELECT doc_id, lang FROM documents JOIN (SELECT lang, avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM documents GROUP BY lang) USING (lang) WHERE n_chars > m + 2 * s",
    "baseline_drift": f"""WITH {_DAILY}, b AS (SELECT *, median(n) OVER w AS base, count(n) OVER w AS n_history FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT event_type, day::VARCHAR AS day, n, n_history, coalesce(base <> 0 AND abs((n - base) / base) > 0.2::DOUBLE, false) AS drifted FROM b""",
    "noise_band": f"""WITH {_DAILY}, s AS (SELECT event_type, min(n) AS low, max(n) AS high, avg(n) AS m, stddev_pop(n) AS sd FROM daily GROUP BY event_type)
SELECT event_type, low, high, count(*) AS n_days, count(*) FILTER (abs(n - m) > 2 * sd) AS n_outside FROM daily JOIN s USING (event_type) GROUP BY ALL""",
    "pass_rates": f"WITH {_PASS} SELECT source, n, passed, passed / n AS rate FROM p",
    "severity_ranking": f"WITH {_PASS} SELECT source, n - passed AS failed, row_number() OVER (ORDER BY n - passed DESC, source)::INTEGER AS place FROM p",
    "paired_compare": "SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS both_pass, count(*) FILTER (quality = 1 AND toxic <> 0) AS only_first, count(*) FILTER (quality <> 1 AND toxic = 0) AS only_second, count(*) FILTER (quality <> 1 AND toxic <> 0) AS neither FROM labels",
    "run_diff": """WITH a AS (SELECT o_custkey AS k, count(*) AS n0 FROM orders WHERE o_orderkey % 2 = 0 GROUP BY k), b AS (SELECT o_custkey AS k, count(*) AS n1 FROM orders WHERE o_orderkey % 2 = 1 GROUP BY k)
SELECT CASE WHEN n0 IS NULL THEN 'only_second' WHEN n1 IS NULL THEN 'only_first' WHEN n1 > n0 THEN 'improved' WHEN n1 < n0 THEN 'regressed' ELSE 'same' END AS outcome, count(*) AS n FROM a FULL JOIN b USING (k) GROUP BY outcome""",
    "corpus_report": "SELECT source, count(*) AS n_docs, count(DISTINCT md5(text)) AS n_texts, count(toxic) AS n_labelled, coalesce(sum(toxic), 0)::BIGINT AS n_toxic, sum(length(text))::BIGINT AS n_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "ledger_grid": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in EVENT_TYPES) + " FROM events GROUP BY user_id",
    "ledger_status": "SELECT user_id, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "check_histogram": "SELECT event_type, floor(value / 20)::INTEGER AS bucket, count(*) AS n FROM events GROUP BY ALL",
    "breakdown_grouping_sets": "SELECT coalesce(l_returnflag, 'ALL') AS flag, coalesce(l_linestatus, 'ALL') AS status, count(*) AS n, sum(trunc(l_quantity)::BIGINT)::BIGINT AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "stratum_rollup": "SELECT lang, source, count(*) AS n, (2 - grouping(lang) - grouping(source))::INTEGER AS depth FROM documents GROUP BY ROLLUP (lang, source)",
    "catalog_distinct_view": "SELECT DISTINCT p_brand, p_type FROM part",
    "first_document_per_section": "SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1",
    "upsert_last_wins": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 'Y' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -o_orderkey - 1, o_custkey, 'N' FROM orders WHERE o_orderkey % 10 = 0",
    "upsert_coalesce": "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'renamed' ELSE c_name END AS c_name, c_mktsegment FROM customer",
    "replace_by_key": "SELECT source, doc_id FROM documents WHERE source NOT IN ('src0', 'src1') UNION ALL SELECT source, -max(doc_id) - 1 FROM documents WHERE source IN ('src0', 'src1') GROUP BY source",
    "dq_rate_bands": """WITH r AS (SELECT source, count(*) AS n, count(*) FILTER (coalesce(trim(text) = '', true)) AS n_bad FROM documents GROUP BY source)
SELECT *, CASE WHEN n_bad <= 0.01 * n THEN 'pass' WHEN n_bad <= 0.05 * n THEN 'warn' ELSE 'fail' END AS band FROM r""",
    "dq_row_preservation": "SELECT *, n_in = n_out AS kept FROM (SELECT (SELECT count(*) FROM lineitem) AS n_in, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS n_out)",
    "interval_conflicts": """SELECT o_custkey, o_orderkey FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM orders) WHERE o_orderdate < last + INTERVAL 30 DAY""",
}
