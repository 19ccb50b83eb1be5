"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are put in buckets of like length (each bucket's lengths lie within ``RATIO`` of each other).
A first pass over the ``SEEDS`` longest vectors gives each query a score that its k-th best can't
fall below. For a bucket that score becomes a local cosine threshold: above 1 the bucket is left
out; where it is high, coordinates of the query's largest components bound what can qualify
(coordinate pruning); else only the bucket's vectors that are long enough do (length pruning). What
is left is verified with exact integer products. A large bucket is cut into cells by length, so that
cells drop out whole too, and a cell into blocks of bounded size; the queries that ask a cell are cut
into blocks of their own. Each pair of blocks returns k rows a query at most.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor do
those of another dimension than the smallest valid vec_id's, nor rows without a vec_id; rows that
repeat a vec_id are one candidate with the best of their scores (as a query, its least vector);
ties go to the smaller vec_id; fewer candidates than k give fewer rows. Components of any size are
multiplied exactly; a component or a score that 64 bits can't hold is an error, never a wrong score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.llm.common import materialize

RATIO, SLICES, SEEDS, QUERY_BLOCK, ROW_BLOCK, COORDINATE_FROM, FOCUS = 0.9, 16, 2048, 1024, 8192, 0.6, 4


def valid(embedding: str | Column) -> Column:
    """Whether a vector is there, has components, and all of them are finite."""
    v = F.col(embedding) if isinstance(embedding, str) else embedding
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ok, F.lit(False))


def same_dimension(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding) as long as the smallest vec_id's."""
    size = rows.agg(F.min_by(F.size("embedding"), "vec_id").alias("size")).first()["size"]
    return rows.filter(F.size("embedding") == (size or 0))


def quantise(embeddings: DataFrame, scale: int) -> DataFrame:
    """(vec_id, bucket, norm, vec): floor(scale * x) as 64-bit integers in ``vec``."""
    rows = same_dimension(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & valid("embedding")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            grid = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            whole = np.floor(scale * grid)
            if not (np.abs(whole) < 2.0**63).all():
                raise OverflowError("a scaled component doesn't fit into 64 bits")
            whole = whole.astype("<i8")
            norm = np.sqrt((whole.astype(np.float64) ** 2).sum(axis=1))
            bucket = np.where(norm > 0, np.ceil(np.log(np.maximum(norm, 1)) / -np.log(RATIO)), -1).astype(np.int32)
            within = np.where(norm > 0, SLICES * (np.log(np.maximum(norm, 1)) / -np.log(RATIO) - (bucket - 1)), 0)
            part = np.clip(np.ceil(within) - 1, 0, SLICES - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bucket), pa.array(part), pa.array(norm), pa.array([v.tobytes() for v in whole], pa.binary())], ["vec_id", "bucket", "slice", "norm", "vec"])

    return rows.mapInArrow(run, "vec_id long, bucket int, slice int, norm double, vec binary")


def cells(counts: dict[tuple[int, int], int], rows: int) -> list[tuple[int, int, int, int, float]]:
    """(bucket, slice, cell, blocks, longest): slices of like length joined until they hold ``rows`` rows."""
    out: list[tuple[int, int, int, int, float]] = []
    cell = 0
    for bucket in sorted({b for b, _ in counts}):
        held: list[tuple[int, int]] = []
        parts = sorted((s, n) for (b, s), n in counts.items() if b == bucket)
        for i, part in enumerate(parts):
            held.append(part)
            n = sum(x for _, x in held)
            if n >= rows or i + 1 == len(parts):
                longest = float(RATIO ** -(bucket - 1 + (held[-1][0] + 1) / SLICES)) if bucket >= 0 else 0.0
                out += [(bucket, s, cell, -(-n // rows), longest) for s, _ in held]
                cell, held = cell + 1, []
    return out


def _grid(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), "<i8").reshape(len(cells), -1) if cells else np.zeros((0, 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = max(abs(int(a.min())), int(a.max())) * max(abs(int(b.min())), int(b.max())) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T  # Python's integers
    if max(map(abs, exact.ravel())) >= 2**63:
        raise OverflowError("an inner product doesn't fit into 64 bits")
    return exact.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best (id, score) with another id than ``own``; of a repeated id, its best."""
    order = np.lexsort((ids, -scores))
    out: dict[int, int] = {}
    for i in order:
        if (x := int(ids[i])) != own and x not in out:
            out[x] = int(scores[i])
            if len(out) == k:
                break
    return list(out.items())


def retrieve(query: np.ndarray, q_norm: float, floor: float, grid: np.ndarray, norms: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Places in a bucket's block (longest first) that may reach ``floor``, by the bucket's own choice of pruning."""
    least = floor * (1 - 1e-9) - 1e-6
    if floor <= 0 or q_norm == 0:
        return np.arange(len(grid)) if floor <= 0 else np.zeros(0, np.int64)
    if q_norm * norms[0] < least:
        return np.zeros(0, np.int64)
    local = min(1.0, max(0.0, least / (q_norm * norms[0])))
    if local < COORDINATE_FROM:  # length pruning: lengths fall, so a prefix qualifies
        return np.arange(np.searchsorted(-norms, -least / q_norm, side="right"))
    unit = query / q_norm
    keep = q_norm * norms >= least
    for f in np.argsort(-np.abs(unit))[:FOCUS]:  # coordinate pruning: a unit vector at this cosine or more
        spread = np.sqrt(max(0.0, (1 - local * local) * (1 - unit[f] * unit[f]))) + 1e-9
        high = 1.0 if unit[f] >= local else local * unit[f] + spread
        low = -1.0 if unit[f] <= -local else local * unit[f] - spread
        keep &= (units[:, f] >= low) & (units[:, f] <= high)
    return np.flatnonzero(keep)


def top_products(embeddings: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best integer products of each row whose vec_id ``every`` divides."""
    spark = embeddings.sparkSession
    rows = materialize(quantise(embeddings, scale), "quantised")
    sizes = {(r["bucket"], r["slice"]): r["n"] for r in rows.groupBy("bucket", "slice").agg(F.count(F.lit(1)).alias("n")).collect()}  # bounded by the range of lengths
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("vec", "norm")).alias("q")).select(F.col("vec_id").alias("query_id"), "q.*")
    seeds = rows.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).select("vec_id", "vec").toArrow()
    seed_ids, seed_grid = np.array(seeds.column(0).to_pylist(), np.int64), _grid(seeds.column(1))
    sent = spark.sparkContext.broadcast((seed_ids, seed_grid))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, grid = sent.value
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for own, scores in zip(part.column(0).to_pylist(), products(_grid(part.column(1)), grid) if part.num_rows else [], strict=True):
                    found = best(scores, ids, own, k)
                    out.append(float(found[-1][1]) if len(found) == k else -1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], ["query_id", "vec", "norm", "floor"])

    floored = materialize(queries.mapInArrow(floors, "query_id long, vec binary, norm double, floor double"), "floors")
    # a cell's greatest length is known from its number, so whole cells drop out per query here
    shape = cells(sizes, ROW_BLOCK)
    known = sorted({(c, blocks, longest) for _, _, c, blocks, longest in shape})
    listed = F.array(*[F.struct(F.lit(c).alias("cell"), F.lit(n).alias("blocks"), F.lit(longest).alias("longest")) for c, n, longest in known]) if known else F.array().cast("array<struct<cell: int, blocks: int, longest: double>>")
    may = F.filter(listed, lambda c: (F.col("floor") <= 0) | (F.col("norm") * c["longest"] * (1 + 1e-9) + 1 >= F.col("floor")))
    asked = floored.select("query_id", "vec", "norm", "floor", F.explode(may).alias("c")).select("c.cell", "c.blocks", "query_id", "vec", "norm", "floor")
    visits = F.broadcast(materialize(asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("q_blocks")), "visits"))  # a row a cell
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = asked.join(visits, "cell").withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.col("q_blocks")).cast("int"))
    asked = asked.select("cell", every_one("blocks").alias("block"), "q_block", "query_id", "vec", "norm", "floor")
    placed = F.broadcast(spark.createDataFrame([x[:4] for x in shape], "bucket int, slice int, cell int, blocks int"))
    dealt = rows.join(placed, ["bucket", "slice"]).join(visits, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    keys = ["cell", "block", "q_block"]
    dealt = dealt.select("cell", "block", every_one("q_blocks").alias("q_block"), "vec_id", "vec", "norm")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            norms = np.asarray(right["norm"].combine_chunks())
            order = np.argsort(-norms, kind="stable")
            norms, ids, grid = norms[order], np.asarray(right["vec_id"].combine_chunks())[order], _grid(right["vec"])[order]
            units = grid / np.maximum(norms, 1e-300)[:, None]
            q_grid, q_norms, q_floors = _grid(left["vec"]), left["norm"].to_pylist(), left["floor"].to_pylist()
            for q, q_norm, floor, own in zip(q_grid, q_norms, q_floors, left["query_id"].to_pylist(), strict=True):
                at = retrieve(q, q_norm, floor, grid, norms, units)
                if len(at):
                    scores = products(q[None, :], grid[at])[0]
                    if floor > 0:
                        at, scores = at[scores >= floor], scores[scores >= floor]
                    out += [(own, x, s) for x, s in best(scores, ids[at], own, k)]
        return pa.table([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    found = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")
    each = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(every: int = 50, k: int = 5, scale: int = 256) -> str:
    """DuckDB SQL: all products of the stated queries with every other row."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}
"""
