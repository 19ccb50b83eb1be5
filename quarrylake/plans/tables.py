"""Tables of a data folder, and query inputs that several plans share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_queries(embeddings: DataFrame) -> DataFrame:
    """The stated query set: every row whose vec_id 100 divides, with its label."""
    return embeddings.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")


def benchmark_queries(benchmark: DataFrame) -> DataFrame:
    """Every benchmark item is a lexical query."""
    return benchmark.select(F.col("item_id").alias("query_id"), "text")


#: DuckDB text of the same inputs, and of every row's rank for every query.
VECTOR_RANKED = """
ev AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
vs AS (SELECT q.vec_id AS query_id, q.label AS asked, e.vec_id, e.label, round(list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v))), 12) AS score
  FROM ev e JOIN ev q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM vs)"""
NORM = "trim(regexp_replace(translate(lower({0}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), '\\s+', ' ', 'g'))"
WORDS = "list_filter(string_split(" + NORM + ", ' '), lambda w: w <> '')"
