"""Ranked text search over an inverted index: weighted fields, block maxima, max-score traversal.

An index holds a row for each term and document: what the term adds to the document's score (BM25 over
fields of given weights), in whole billionths, so that sums are the same in every order; and, for each
term and block of documents, the most it adds there. A search takes the following steps.

1. Each query's rarest terms are summed first. The k-th best sum is a threshold that the k best
   documents reach at least.
2. Maxima of blocks, a row for some hundred documents, are summed for each query; blocks whose sum is under the
   threshold are left out.
3. Terms that together, by their maxima, stay under the threshold make no candidate: a query's
   candidates come from the postings of its other terms in the live blocks. Candidates that can't reach the threshold go.
4. What is left is completed by a join on document and term.

So a common term doesn't join every document to every query, and no document that could be among the
first k is left out: the result is that of scoring all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.functions.stems import search_terms, stem
from quarrylake.operators.graph import stored
from quarrylake.operators.retrieval import rank_by

#: Documents of a block, about; postings of a query's rarest terms that set its threshold, about.
BLOCK_DOCS, SEED_POSTINGS, UNIT = 128, 4_096, 1e9


@dataclass
class Index:
    """postings (term, block, doc_id, adds), maxima (term, block, most), terms (term, df, most); stored frames."""

    postings: DataFrame
    maxima: DataFrame
    terms: DataFrame
    stems: bool


def _terms(df: DataFrame, key: list[str | Column], text: Column, stems: bool) -> DataFrame:
    out = df.select(*key, F.explode(search_terms(text, stems)).alias("word"))
    return out.withColumn("word", stem(F.col("word"))) if stems else out


def build(docs: DataFrame, fields: dict[str, float], stems: bool = True, k1: float = 1.2, b: float = 0.75, id_: str = "doc_id") -> Index:
    """The index of a table's text columns, each with its weight; null texts are empty, ids are unique.

    A field's weight multiplies its counts and its length, before saturation and length normalisation.
    """
    rows = docs.select(F.col(id_).cast("long").alias("doc_id"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)])
    # texts move once, to their documents' tasks, in place of a row for each word; counts and lengths need no further shuffle
    some = lambda c, weight: F.transform(F.coalesce(search_terms(c, stems), F.array().cast("array<string>")), lambda w: F.struct(w.alias("word"), F.lit(float(weight)).alias("weight")))
    each = [some(F.col(f"f{i}"), weight) for i, weight in enumerate(fields.values())]
    words = rows.repartition("doc_id").select("doc_id", F.explode(F.concat(*each)).alias("w")).select("doc_id", "w.word", "w.weight")
    words = words.withColumn("word", stem(F.col("word"))) if stems else words
    tf = words.groupBy("doc_id", F.col("word").alias("term")).agg(F.sum("weight").alias("tf"))
    tf = stored(tf.withColumn("len", F.sum("tf").over(Window.partitionBy("doc_id"))), "tf")
    lengths = tf.groupBy("doc_id").agg(F.max("len").alias("len"))
    stats = rows.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(lengths.agg((F.sum("len")).alias("total"))))  # one row each
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = tf.join(df, "term").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    adds = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / (F.col("total") / F.col("n"))))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.lit(1))
    postings = stored(weighed.select("term", F.pmod(F.xxhash64("doc_id"), blocks).cast("int").alias("block"), "doc_id", F.round(adds * UNIT).cast("long").alias("adds")), "postings")
    maxima = stored(postings.groupBy("term", "block").agg(F.max("adds").alias("most"), F.count(F.lit(1)).alias("df")), "maxima")
    return Index(postings, maxima, stored(maxima.groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most")), "terms"), stems)


def candidates(index: Index, queries: DataFrame, k: int, seed_postings: int = SEED_POSTINGS) -> DataFrame:
    """(query_id, doc_id, score) of all documents that could be among a query's first k, scores whole."""
    asked = _terms(queries, ["query_id"], F.col("text"), index.stems).select("query_id", F.col("word").alias("term")).distinct()
    by_rarity = Window.partitionBy("query_id").orderBy("df", "term")
    asked = asked.join(index.terms, "term").withColumn("before", F.coalesce(F.sum("df").over(by_rarity.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    asked = stored(asked, "terms")
    # of the index, only the terms that are asked for move
    postings = index.postings.join(stored(asked.select("term").distinct(), "term"), "term", "left_semi")
    seeds = asked.filter(F.col("before") < seed_postings).select("query_id", "term")
    sums = seeds.join(postings, "term").groupBy("query_id", "doc_id").agg(F.sum("adds").alias("score"))
    kth = rank_by(sums, ["query_id"], [F.desc("score")], k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("threshold"))
    by_most = Window.partitionBy("query_id").orderBy("most", "term")
    asked = asked.join(kth, "query_id", "left").select("query_id", "term", "most", F.coalesce("threshold", F.lit(0)).alias("threshold"), F.sum("most").over(by_most).alias("upto"))
    # the terms whose maxima, smallest first, add up to less than the threshold
    asked = stored(asked.withColumn("weak", F.col("upto") < F.col("threshold")).drop("upto"), "asked")
    live = asked.join(index.maxima.select("term", "block", F.col("most").alias("here")), "term").groupBy("query_id", "block", "threshold").agg(F.sum("here").alias("bound"))
    live = live.filter(F.col("bound") >= F.col("threshold")).select("query_id", "block")
    rest = asked.groupBy("query_id").agg(F.sum(F.when(F.col("weak"), F.col("most")).otherwise(0)).alias("rest"))
    strong = asked.filter(~F.col("weak")).join(rest, "query_id").join(live, "query_id").select("query_id", "term", "block", "threshold", "rest")
    found = strong.join(postings, ["term", "block"]).groupBy("query_id", "doc_id", "threshold", "rest").agg(F.sum("adds").alias("score"))
    found = stored(found.filter(F.col("score") + F.col("rest") >= F.col("threshold")).select("query_id", "doc_id", "score"), "candidates")
    more = found.select("query_id", "doc_id").join(asked.filter("weak").select("query_id", "term"), "query_id").join(postings.select("term", "doc_id", "adds"), ["doc_id", "term"])
    return found.unionByName(more.select("query_id", "doc_id", F.col("adds").alias("score"))).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, rank, score) of each query (query_id, text): the k best, scores in billionths, ties to the smaller id."""
    return rank_by(candidates(index, queries, k), ["query_id"], [F.desc("score"), F.col("doc_id")], k).select("query_id", "doc_id", "rank", "score")
