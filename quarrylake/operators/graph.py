"""Scratch tables, and connected components by contraction."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; where that is unset, a temporary folder serves a session of one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/quarrylake-scratch"
    return f"{root.rstrip('/')}/quarrylake/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: lineage is cut and a lost executor costs a re-read. The files go with the driver's JVM."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of files that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Delete the files of ``stored`` frames before the JVM ends, once nothing is to be read from them."""
    for frame in frames:
        removed(frame.sparkSession, frame._stored_at)


def _ranked(node: str, turn: int) -> Column:
    return F.struct(F.xxhash64(F.lit(turn), F.col(node)).alias("rank"), F.col(node).alias("node"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) for every node of ``pairs`` (a, b); the component is its least node.

    A round ranks nodes by a hash with the round's seed; each takes the least-ranked of itself and its
    neighbours, and that one's choice; edges are rewritten and inner ones vanish. Ranks are random whatever
    the ids, so chains and stars too lose a fixed part of their nodes a round, as is to be expected of
    chance, and the rounds grow with the logarithm of the nodes.
    """
    rest = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    labels, turn = None, 0
    while not rest.isEmpty():
        turn += 1
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        choice = both.groupBy("a").agg(F.min(_ranked("b", turn)).alias("m")).select(F.col("a").alias("node"), F.least(_ranked("a", turn), "m")["node"].alias("to"))
        then = choice.select(F.col("node").alias("to"), F.col("to").alias("root"))
        step = stored(choice.join(then, "to").select("node", "root"), "step")
        a, b = step.toDF("a", "ra"), step.toDF("b", "rb")
        rest = stored(rest.join(a, "a").join(b, "b").filter("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        labels = step if labels is None else stored(labels.join(step.toDF("root", "now"), "root", "left").select("node", F.coalesce("now", "root").alias("root")), "labels")
    if labels is None:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    return labels.join(least, "root").select("node", F.least("least", "root").alias("component"))
