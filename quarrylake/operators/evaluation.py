"""Evaluation of runs: flips between epochs, paired comparison with an exact test, ledgers by precedence, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sign_test(less: Column, more: Column) -> Column:
    """Two-sided exact p of a sign test on ``less`` against ``more`` cases; null without any. Summed by logarithms, so large counts don't underflow."""
    m, n = F.least(less, more).cast("int"), (less + more).cast("double")
    zero = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"))

    def step(s: Column, k: Column) -> Column:
        log = F.when(k == 0, -n * F.log(F.lit(2.0))).otherwise(s["log"] + F.log((n - k + 1) / F.greatest(k, F.lit(1))))
        return F.struct(log.alias("log"), (s["sum"] + F.exp(log)).alias("sum"))

    half = F.aggregate(F.sequence(F.lit(0), m), zero, step, lambda s: s["sum"])
    return F.when(n > 0, F.least(F.lit(1.0), 2 * half))


def last_epochs(samples: DataFrame, keys: list[str], epoch: str, value: str) -> DataFrame:
    """(keys, value, n_epochs, flips): the last epoch's value, how many epochs there are, and whether they disagree. Null values are left out."""
    told = samples.filter(F.col(value).isNotNull())
    return told.groupBy(*keys).agg(F.max_by(value, epoch).alias(value), F.count(F.lit(1)).alias("n_epochs"), (F.min(value) != F.max(value)).alias("flips"))


def flip_rates(folded: DataFrame, by: str) -> DataFrame:
    """(by, n, flip_rate): share of keys with several epochs whose epochs disagree; null where there are none."""
    several = F.col("n_epochs") > 1
    return folded.groupBy(by).agg(F.count_if(several).alias("n"), F.avg(F.when(several, F.col("flips").cast("int"))).alias("flip_rate"))


def paired(now: DataFrame, before: DataFrame, key: str, by: str, value: str, band: DataFrame) -> DataFrame:
    """(by, n, improved, regressed, net, p_value, exceeds): keys that both runs judged; ``exceeds`` if the net share passes the flip rate."""
    both = now.select(key, by, F.col(value).alias("now")).join(before.select(key, by, F.col(value).alias("then")), [key, by])
    counted = both.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("now") & ~F.col("then")).alias("improved"), F.count_if(F.col("then") & ~F.col("now")).alias("regressed"))
    told = counted.join(band.select(by, "flip_rate"), by, "left").withColumn("net", F.col("improved") - F.col("regressed"))
    exceeds = ~F.coalesce(F.abs(F.col("net")) / F.col("n") <= F.col("flip_rate"), F.lit(False))
    return told.select(by, "n", "improved", "regressed", "net", sign_test(F.col("improved"), F.col("regressed")).alias("p_value"), exceeds.alias("exceeds"))


def cell(made: Column, failed_error: Column, failed_warn: Column, passed: Column) -> Column:
    """State of one stage of one document: missing, then error, warn, ok, unverified, the first that holds."""
    return F.when(~made, "missing").when(failed_error > 0, "error").when(failed_warn > 0, "warn").when(passed > 0, "ok").otherwise("unverified")


def row_state(cells: Column) -> Column:
    """State of a document by its stages' states."""
    holds = lambda s: F.array_contains(cells, s)
    return F.when(holds("missing"), "incomplete").when(holds("error"), "failed").when(holds("warn"), "warned").when(holds("unverified"), "unverified").otherwise("passed")


def summary(metrics: DataFrame, key: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """((metric, mean, low, high, deviation, n), (key, metric, value)): each metric's summary, and values over two sample deviations from the mean (of three values at least)."""
    long = metrics.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select(key, "m.*").filter("value IS NOT NULL")
    told = long.groupBy("metric").agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.stddev_samp("value").alias("deviation"), F.count(F.lit(1)).alias("n"))
    far = long.join(F.broadcast(told), "metric").filter("n >= 3 AND deviation > 0 AND abs(value - mean) > 2 * deviation").select(key, "metric", "value")  # a row a metric
    return told, far
