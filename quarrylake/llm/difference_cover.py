"""Suffix ranks of one long symbol table by difference-cover sorting, every step a Spark sort, join or grouping.

Triples at two thirds of the places are sorted by range and named by their order; where names repeat, the
string of names is ranked by recursion; the other suffixes are merged in by counting, in sorts of
them with each kind of sampled suffix. Nothing is gathered: a level moves each symbol some twenty
times. ``remove_repeats`` doesn't use it: README tells what it costs, and that no corpus fits the
bounds of disk and time that way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.common import bounded, materialize


def _shifted(rows: DataFrame, value: str, shifts: dict[str, int]) -> DataFrame:
    """(pos, name, value): ``value`` of place pos + shift under each name."""
    each = F.array(*[F.struct((F.col("pos") - k).alias("pos"), F.lit(name).alias("name"), F.col(value).cast("long").alias("value")) for name, k in shifts.items()])
    return rows.select(F.explode(each).alias("x")).select("x.*").filter("pos >= 0")


def _gather(parts: DataFrame, names: list[str]) -> DataFrame:
    """(pos, names): one row a place; what isn't there, past the end, is 0."""
    return parts.groupBy("pos").agg(*[F.coalesce(F.max(F.when(F.col("name") == n, F.col("value"))), F.lit(0)).alias(n) for n in names])


def _counted(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """(pos, zero, others, mine): how many rows with and without ``zero`` come before each in ``order``; sums over ranges, then within each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_zero = n_other = 0
        for batch in batches:
            zero = np.asarray(batch.column(1).cast(pa.int64()))
            a, b = np.cumsum(zero), np.cumsum(1 - zero)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_zero + a - zero), pa.array(n_other + b - (1 - zero))], ["pos", "zero", "part", "zeros", "others"])
            n_zero, n_other = n_zero + int(a[-1] if len(a) else 0), n_other + int(b[-1] if len(b) else 0)

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("pos", "zero", F.spark_partition_id().alias("part"))
    held = materialize(bounded(ranged).mapInArrow(run, "pos long, zero boolean, part int, zeros long, others long"), label)
    sums = {r["part"]: (r["z"], r["o"]) for r in held.groupBy("part").agg(F.count_if("zero").alias("z"), F.count_if(~F.col("zero")).alias("o")).collect()}  # one row a range
    offsets, z, o = [], 0, 0
    for part in sorted(sums):
        offsets.append((part, z, o))
        z, o = z + sums[part][0], o + sums[part][1]
    at = F.broadcast(rows.sparkSession.createDataFrame(offsets, "part int, z long, o long"))
    return held.join(at, "part").select("pos", "zero", (F.col("zeros") + F.col("z")).alias("zeros"), (F.col("others") + F.col("o")).alias("others"))


def suffix_ranks(symbols: DataFrame) -> DataFrame:
    """(pos, rank) from 0 of every suffix of (pos, sym): places 0 .. n - 1, each once, symbols from 1."""
    spark = symbols.sparkSession
    symbols = materialize(symbols.select(F.col("pos").cast("long"), F.col("sym").cast("long")), "symbols")
    n = symbols.count()
    if not n:
        return spark.createDataFrame([], "pos long, rank long")
    triples = _gather(_shifted(symbols, "sym", {"x": 0, "y": 1, "z": 2}).filter(f"pos % 3 != 0 AND pos < {n}"), ["x", "y", "z"])
    if n % 3 == 1:  # an empty suffix closes the first kind of sample
        triples = triples.unionByName(spark.createDataFrame([(n, 0, 0, 0)], "pos long, x long, y long, z long"))
    triples = materialize(triples, "triples")
    names = materialize(triples.select("x", "y", "z").distinct().orderBy("x", "y", "z").withColumn("name", F.monotonically_increasing_id() + 1), "names")
    named = materialize(triples.join(names, ["x", "y", "z"]).select("pos", "name"), "named")
    if names.count() < named.count():
        first = (n + 2) // 3
        place = F.when(F.col("pos") % 3 == 1, (F.col("pos") - 1) / 3).otherwise(first + (F.col("pos") - 2) / 3).cast("long")
        back = F.when(F.col("pos") < first, 3 * F.col("pos") + 1).otherwise(3 * (F.col("pos") - first) + 2)
        named = suffix_ranks(named.select(place.alias("pos"), F.col("name").alias("sym"))).select(back.alias("pos"), (F.col("rank") + 1).alias("name"))
    parts = _shifted(symbols, "sym", {"sym": 0, "sym1": 1}).unionByName(_shifted(named, "name", {"own": 0, "r1": 1, "r2": 2}))
    every = materialize(_gather(parts.filter(f"pos < {n}"), ["sym", "sym1", "own", "r1", "r2"]).withColumn("zero", F.col("pos") % 3 == 0), "suffixes")
    kind = F.col("pos") % 3
    one = _counted(every.filter(kind != 2), ["sym", "r1"], "by_one")
    two = _counted(every.filter(kind != 1), ["sym", "sym1", "r2"], "by_two")
    sampled = _counted(every.filter(kind != 0), ["own"], "by_own").select("pos", F.col("others").alias("before"))
    zero = one.filter("zero").select("pos", (F.col("zeros") + F.col("others")).alias("a")).join(two.filter("zero").select("pos", "others"), "pos").select("pos", (F.col("a") + F.col("others")).alias("rank"))
    rest = one.unionByName(two).filter("NOT zero").join(sampled, "pos").select("pos", (F.col("zeros") + F.col("before")).alias("rank"))
    return zero.unionByName(rest)
