"""Ranked retrieval: vector and lexical arms, fusion, cut-offs, caps and context order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.functions import text as T
from quarrylake.operators.names import fresh

#: Queries and rows that a task holds against each other, and decimals that scores are compared by.
QUERY_BLOCK, ROW_BLOCK, DIGITS = 4096, 16_384, 12


def rank_by(df: DataFrame, group: list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """Ranks from 1 within each group, cut at ``k``; the limit reaches below the shuffle."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return out if k is None else out.filter(F.col(name) <= k)


def vector_topk(rows: DataFrame, queries: DataFrame, k: int, id_: str = "vec_id", within: str | None = None, block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """(query_id, id, rank, score) by falling cosine, exact to ``DIGITS`` decimals; ties go to the smaller id.

    ``queries`` (query_id, q, and ``within`` where given) are dealt to blocks of about ``block``, rows to blocks of about
    ``row_block``; a pair of blocks is one task's work, which gives k rows a query, and these are ranked. Only three numbers come to the
    driver. A row is no candidate of the query of its own id, nor, with ``within``, of queries of another value.
    Rows without a vector, or with one of another length than the longest query, take no part; a zero vector scores 0.
    """
    known = queries.filter(F.col("q").isNotNull()).agg(F.max(F.size("q")), F.count(F.lit(1))).first()
    size, n_rows = known[0] or 0, rows.count()
    parts, row_parts = max(-(-known[1] // block), 1), max(-(-n_rows // row_block), 1)
    own = F.col(within).cast("string") if within else F.lit(None).cast("string")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = queries.filter(F.size("q") == size).select(F.col("query_id").cast("long").alias("id"), F.col("q").cast("array<double>").alias("v"), own.alias("own"))
    asked = asked.select(place("id", parts).alias("qb"), spread(row_parts).alias("rb"), "id", "v", "own")
    held = rows.filter(F.size("embedding") == size).select(F.col(id_).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), own.alias("own"))
    held = held.select(spread(parts).alias("qb"), place("id", row_parts).alias("rb"), "id", "v", "own")
    found = asked.groupBy("qb", "rb").cogroup(held.groupBy("qb", "rb")).applyInArrow(_nearest(k, size, within is not None), "query_id long, id long, score double")
    return rank_by(found, ["query_id"], [F.desc("score"), F.col("id")], k).select("query_id", F.col("id").alias(id_), "rank", "score")


def _units(cells: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    grid = np.array(cells.to_pylist(), np.float64).reshape(-1, size)
    length = np.sqrt((grid * grid).sum(axis=1))
    return grid / np.where(length > 0, length, 1.0)[:, None]


def _nearest(k: int, size: int, within: bool, piece: int = 2_048, at_once: int = 256):
    def nearest(asked: np.ndarray, grid: np.ndarray, own: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        best, ids = np.full((len(asked), 0), -np.inf), np.zeros((len(asked), 0), np.int64)
        for some, units, labels in parts:
            score = np.round(grid @ units.T, DIGITS) + 0.0
            score[asked[:, None] == some[None]] = -np.inf
            if within:
                score[own[:, None] != labels[None]] = -np.inf
            best, ids = np.hstack([best, score]), np.hstack([ids, np.broadcast_to(some, score.shape)])
            order = np.lexsort((ids, -best), axis=1)[:, :k]
            best, ids = np.take_along_axis(best, order, 1), np.take_along_axis(ids, order, 1)
        return best, ids

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        labels = lambda part: np.array(part["own"].to_pylist(), object)
        if queries.num_rows and rows.num_rows:
            parts = [(np.asarray(part["id"]), _units(part["v"], size), labels(part)) for part in (rows.slice(at, piece) for at in range(0, rows.num_rows, piece))]
            for at in range(0, queries.num_rows, at_once):  # scores of few queries at once
                some = queries.slice(at, at_once)
                asked = np.asarray(some["id"])
                best, ids = nearest(asked, _units(some["v"], size), labels(some), parts)
                q, place = np.nonzero(np.isfinite(best))
                found.append((asked[q], ids[q, place], best[q, place]))
        query_id, ids, score = map(np.concatenate, zip(*found, strict=True))
        return pa.table({"query_id": pa.array(query_id, pa.int64()), "id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})

    return run


def lexical_overlap_topk(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, rank, score): how many distinct query tokens a document has. Tokens meet by a join on their text."""
    terms = queries.select("query_id", F.explode(F.array_distinct(T.words(T.normalize_text(F.col("text"))))).alias("term"))
    own = docs.select("doc_id", F.explode(F.array_distinct(T.words(T.normalize_text(F.col("text"))))).alias("term"))
    scored = own.join(terms, "term").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("score"))
    return rank_by(scored, ["query_id"], [F.desc("score"), F.col("doc_id")], k).select("query_id", "doc_id", "rank", "score")


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, rank, score): Okapi BM25, any query term matching."""
    tokens = docs.select("doc_id", T.words(T.normalize_text(F.col("text"))).alias("t")).withColumn("len", F.size("t"))
    stats = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    terms = queries.select("query_id", F.explode(F.array_distinct(T.words(T.normalize_text(F.col("text"))))).alias("term"))
    wanted = terms.select("term").distinct()
    tf = tokens.select("doc_id", "len", F.explode("t").alias("term")).join(wanted, "term", "left_semi").groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = tf.join(df, "term").join(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    # whole billionths: their sum is the same in every order
    scored = weighed.select("doc_id", "term", F.round(weight * 1e9).cast("long").alias("w")).join(terms, "term").groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"))
    return rank_by(scored, ["query_id"], [F.desc("score"), F.col("doc_id")], k).select("query_id", "doc_id", "rank", "score")


def rrf(ranked: DataFrame, id_: str = "id", k: int | Column = 60, final_k: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal-rank fusion of (list_no, rank, id) rows, ranks from 1; null ids are left out; ``k`` may be a column of ``by``.

    Ties keep the order of first appearance (list, then rank).
    """
    parts = ranked.filter(F.col(id_).isNotNull()).groupBy(*by, id_).agg(
        F.sum(F.round(1e12 / (k + F.col("rank"))).cast("long")).alias("units"),
        F.min(F.struct("list_no", "rank")).alias("seen"),
        F.array_sort(F.collect_set("list_no")).alias("lists"),
    )
    out = rank_by(parts, list(by), [F.desc("units"), F.col("seen")], final_k, "fused_rank")
    return out.select(*by, id_, "fused_rank", (F.col("units") / 1e12).alias("rrf_score"), "lists")


def rrf_source(lists: Column, vector: int = 0, lexical: int = 1) -> Column:
    """vector, bm25 or both."""
    return F.when(F.array_contains(lists, vector) & F.array_contains(lists, lexical), "both").when(F.array_contains(lists, vector), "vector").otherwise("bm25")


def hybrid(vector: DataFrame, lexical: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Two ranked arms (by, id, rank) fused, with the arm each row came from."""
    arms = vector.select(*by, "id", "rank", F.lit(0).alias("list_no")).unionByName(lexical.select(*by, "id", "rank", F.lit(1).alias("list_no")))
    return rrf(arms, final_k=k, by=by).withColumn("rrf_source", rrf_source(F.col("lists"))).drop("lists")


def score_floor(ranked: DataFrame, by: list[str], threshold: float, least: int) -> DataFrame:
    """Rows that reach the threshold; where fewer than ``least`` do, the first ``least`` instead."""
    (over,) = fresh(ranked, "n_over")
    n = F.count(F.when(F.col("score") >= threshold, 1)).over(Window.partitionBy(*by))
    kept = F.when(F.col(over) >= least, F.col("score") >= threshold).otherwise(F.col("rank") <= least)
    return ranked.withColumn(over, n).filter(kept).drop(over)


def knee(ranked: DataFrame, by: list[str], floor: int = 2, gap: float = 0.15, fallback: float = 0.05) -> DataFrame:
    """Cut each list at its first gap over ``gap``, else at its largest over ``fallback``; keep ``floor`` at least."""
    g, cut = fresh(ranked, "gap_after", "cut_at")
    after = F.col("score") - F.lead("score").over(Window.partitionBy(*by).orderBy("rank"))
    gaps = ranked.withColumn(g, F.when(F.col("rank") >= floor, after))
    w = Window.partitionBy(*by)
    first = F.min(F.when(F.col(g) > gap, F.col("rank"))).over(w)
    widest = F.max(F.when(F.col(g) > fallback, F.struct(F.col(g).alias("gap"), (-F.col("rank")).alias("rank")))).over(w)
    return gaps.withColumn(cut, F.coalesce(first, -widest["rank"])).filter(F.col(cut).isNull() | (F.col("rank") <= F.col(cut))).drop(g, cut)


def cap_per_group(ranked: DataFrame, group: str, n: int, by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows of each group in order of rank; a null group is one group."""
    (nth,) = fresh(ranked, "nth")
    key = F.coalesce(F.col(group).cast("string"), F.lit(""))
    return ranked.withColumn(nth, F.row_number().over(Window.partitionBy(*(by or []), key).orderBy("rank"))).filter(F.col(nth) <= n).drop(nth)


def first_ranked(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """The best-ranked row of each key; nulls are one key."""
    (nth,) = fresh(ranked, "nth")
    return ranked.withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))).filter(F.col(nth) == 1).drop(nth)


def stratified(ranked: DataFrame, group: str, k: int, by: list[str]) -> DataFrame:
    """ceil(k / groups) rows of each group, groups in order of first appearance, then the first k, placed in ``pos``."""
    first, groups, nth = fresh(ranked, "first", "groups", "nth")
    w = Window.partitionBy(*by)
    seen = ranked.withColumn(first, F.min("rank").over(Window.partitionBy(*by, group))).withColumn(groups, F.size(F.collect_set(group).over(w)))
    some = seen.withColumn(nth, F.row_number().over(Window.partitionBy(*by, group).orderBy("rank"))).filter(F.col(nth) <= F.ceil(F.lit(k) / F.col(groups)))
    return some.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(first, "rank"))).filter(F.col("pos") <= k).drop(first, groups, nth)


def context_order(ranked: DataFrame, by: list[str]) -> DataFrame:
    """Places rank 1 first, 2 last and the others between, keeping the rank as citation number."""
    n = F.max("rank").over(Window.partitionBy(*by))
    key = F.when(F.col("rank") == 2, n + 1).otherwise(F.col("rank"))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(key)))
