"""Approximate nearest neighbours over balanced posting lists.

Centroids are fitted to a bounded sample by k-means that charges full clusters, and linked into a
graph that is searched in memory (best-first with a beam, many vectors at a time). Each vector goes
to the list of least distance and charge, and, where it lies near a boundary, to others whose distance
is within a ratio (set on the sample) and which no chosen centroid already stands in front of. A query
visits the lists whose centroids lie within a distance ratio of its nearest one; the ratio is set on the
sample so that the lists hold ``RECALL`` of true neighbours there (denser data only come nearer). All
of this is relative, so the unit of the vectors doesn't matter. Distances to the vectors of visited
lists are exact. Lists are dealt in blocks of bounded size, so a list of many equal vectors is spread,
and a list's queries are cut into blocks of their own, so its rows move only as often as its own
queries ask. Past ``MOST_LISTS`` lists, which bounds the broadcast, lists grow longer instead.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor
do those of another dimension than the smallest valid vec_id's, nor rows without a vec_id; rows that
repeat a vec_id are one candidate at the least of their distances (as a query, its least vector);
ties go to the smaller vec_id; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.llm.common import materialize
from quarrylake.llm.topk import same_dimension, valid

#: Sampled rows, rows a list aims at, most lists (which bounds the broadcast), links of a centroid.
SAMPLE, LIST_ROWS, MOST_LISTS, LINKS = 16_384, 512, 4096, 24
#: Share of vectors that lie near enough to a second list to be weighed for replication, lists a vector at most, recall aimed at on the sample.
BOUNDARY, COPIES, RECALL = 0.5, 8, 0.985
QUERY_BLOCK, ROW_BLOCK = 1024, 4096
#: Centroids whose distances or links a search looks up at once; queries whose products with a block are made at once.
STEP, PRODUCTS = 8_192, 256
#: Rows past the k nearest whose distances are computed too, for ties and repeated ids.
SPARE = 8


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


class Index:
    """Centroids, their graph, and the ratio that a query's lists stay within."""

    def __init__(self, sample: np.ndarray, lists: int, k: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centroids = self._fit(sample, min(lists, len(sample)), rng)
        n = len(self.centroids)
        near = np.argsort(_distances(self.centroids, self.centroids), axis=1, kind="stable")[:, 1 : LINKS + 1]
        self.links = [set(row.tolist()) for row in near]
        for i, row in enumerate(near):  # links both ways, and a ring so that every centroid is reached
            for j in row.tolist():
                self.links[j].add(i)
            self.links[i] |= {(i + 1) % n, (i - 1) % n} - {i}
        # ragged, as a centroid that is near to very many others has as many links
        self.ends = np.cumsum([0, *map(len, self.links)])
        self.graph = np.array([j for x in self.links for j in sorted(x)], np.int64)
        self.links = None
        self.entries = rng.permutation(n)[: min(n, 8)]
        self.ratio, self.beam, self.replicate, self.copies = np.inf, n, 1.0, 1.0
        self._calibrate(sample, k, rng)

    def _fit(self, x: np.ndarray, lists: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
        centre = x[rng.choice(len(x), lists, replace=False)].copy()
        charge, mean = np.zeros(lists), len(x) / lists
        for _ in range(rounds):
            own, near = np.empty(len(x), np.int64), np.empty(len(x))
            for at in range(0, len(x), 2048):
                d = _distances(x[at : at + 2048], centre)
                own[at : at + 2048] = (d + charge).argmin(1)
                near[at : at + 2048] = d.min(1)
            size = np.bincount(own, minlength=lists)
            total = np.zeros_like(centre)
            np.add.at(total, own, x)
            centre[size > 0] = total[size > 0] / size[size > 0, None]
            # a full list grows dearer, an empty one cheaper, in the data's own unit
            charge += 0.05 * near.mean() * np.clip(size / mean - 1, -1, 1)
            charge -= charge.min()
        self.charge = charge
        return centre

    def search(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of the ``want`` nearest that the graph search finds, nearest first.

        A step follows the links of all centroids of a vector's beam that it hasn't followed yet.
        """
        n = len(self.centroids)
        beam = min(n, max(want, 8))
        dist = np.full((len(x), n), np.inf)
        seen, done = np.zeros(dist.shape, bool), np.zeros(dist.shape, bool)
        fresh = np.zeros(dist.shape, bool)
        fresh[:, self.entries] = True
        live = np.arange(len(x))
        while len(live):
            owner, node = np.nonzero(fresh)
            for at in range(0, len(node), STEP):
                q, c = live[owner[at : at + STEP]], node[at : at + STEP]
                dist[q, c] = np.sqrt(((x[q] - self.centroids[c]) ** 2).sum(1))
            seen[live] |= fresh
            # where all are seen, links lead nowhere new
            live = live[~seen[live].all(1)]
            near = dist[live]
            todo = ~done[live] & np.isfinite(near) & (near <= np.partition(near, beam - 1, axis=1)[:, beam - 1 : beam])
            more = todo.any(1)
            live, todo = live[more], todo[more]
            done[live] |= todo
            fresh = self._linked(todo) & ~seen[live]
        near = np.sort(np.argpartition(dist, want - 1, axis=1)[:, :want], axis=1) if want < n else np.tile(np.arange(n), (len(x), 1))
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(dist, near, 1), axis=1, kind="stable"), 1)
        return near, np.take_along_axis(dist, near, 1)

    def _linked(self, nodes: np.ndarray) -> np.ndarray:
        """For each row of flags of centroids, flags of those that they have links to."""
        out = np.zeros(nodes.shape, bool)
        owner, node = np.nonzero(nodes)
        for at in range(0, len(node), STEP):
            first, n = self.ends[node[at : at + STEP]], np.diff(self.ends)[node[at : at + STEP]]
            place = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
            out[np.repeat(owner[at : at + STEP], n), self.graph[place]] = True
        return out

    def lists_of(self, x: np.ndarray) -> list[list[int]]:
        """Lists that take each vector: the nearest by distance and charge, and boundary ones, ``COPIES`` in all at most."""
        at, dist = self.search(x, COPIES)
        order = np.argsort(dist + self.charge[at], axis=1, kind="stable")
        at, dist = np.take_along_axis(at, order, 1), np.take_along_axis(dist, order, 1)
        out = []
        for row, d in zip(at, dist, strict=True):
            chosen = [int(row[0])]
            for j in range(1, len(row)):
                if d[j] <= self.replicate * d.min() and all(np.linalg.norm(self.centroids[row[j]] - self.centroids[c]) >= d[j] for c in chosen):
                    chosen.append(int(row[j]))
            out.append(chosen)
        return out

    def probes(self, x: np.ndarray) -> list[list[int]]:
        """Lists a query visits: all that the search finds within the distance ratio of its nearest, however many."""
        out: list[list[int]] = [[] for _ in x]
        todo, beam = np.arange(len(x)), self.beam
        while len(todo):
            at, dist = self.search(x[todo], beam)
            inside = dist <= self.ratio * dist[:, :1] + 1e-12
            full = inside.all(1) & (beam < len(self.centroids))
            for q, row, near in zip(todo[~full], at[~full], inside[~full], strict=True):
                out[q] = row[near].tolist()
            todo, beam = todo[full], min(2 * beam, len(self.centroids))
        return out

    def _calibrate(self, sample: np.ndarray, k: int, rng: np.random.Generator) -> None:
        if len(sample) < 2:
            return
        pick = rng.choice(len(sample), min(256, len(sample)), replace=False)
        # boundary: as far as the second list of every other vector is
        _, two = self.search(sample[pick], 2)
        self.replicate = max(1.0, float(np.quantile(two[:, -1] / np.maximum(two[:, 0], 1e-12), BOUNDARY)))
        d = _distances(sample[pick], sample)
        d[np.arange(len(pick)), pick] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
        to = _distances(sample[pick], self.centroids)
        met = np.unique(near)
        homes = dict(zip(met.tolist(), self.lists_of(sample[met]), strict=True))
        need = [min(to[q, homes[int(i)]]) / max(to[q].min(), 1e-12) for q, row in enumerate(near) for i in row]
        self.ratio = float(np.quantile(need, RECALL)) * (1 + 1e-9)
        self.copies = sum(map(len, homes.values())) / max(1, len(homes))
        self.beam = min(len(self.centroids), int(1.2 * (to <= self.ratio * to.min(1)[:, None]).sum(1).max()) + 1)


def _grid(column) -> np.ndarray:
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), "<f8").reshape(len(cells), -1) if cells else np.zeros((0, 0))


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec) of the vectors that take part; ``vec`` holds doubles."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = same_dimension(rows.filter(F.col("vec_id").isNotNull() & valid("embedding") & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                grid = np.asarray(batch.column(1).flatten(), dtype="<f8").reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in grid], pa.binary())], ["vec_id", "vec"])

    return rows.mapInArrow(run, "vec_id long, vec binary")


def fit(rows: DataFrame, k: int = 10) -> Index | None:
    """An index on about ``SAMPLE`` of ``rows``, chosen by a hash of the id; None without rows."""
    n = rows.count()
    if not n:
        return None
    part = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / n) + 1))
    sample = part.select("vec").toArrow()
    grid = _grid(sample.column(0)) if sample.num_rows else _grid(rows.limit(1).select("vec").toArrow().column(0))
    return Index(grid, max(1, min(MOST_LISTS, n // LIST_ROWS)), k)


def _with_lists(rows: DataFrame, sent, how: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = getattr(sent.value, how)(_grid(part.column(1)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lists, pa.list_(pa.int32()))], ["vec_id", "vec", "lists"])

    return rows.mapInArrow(run, "vec_id long, vec binary, lists array<int>").select("vec_id", "vec", F.explode("lists").alias("list"))


def nearest_of(asked: np.ndarray, owners: np.ndarray, grid: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of each query's k nearest rows under another id, exact, ties to the smaller id.

    Products of matrices choose the rows whose distances are computed: all that may be among the nearest ``k + SPARE`` by the
    products' largest error. Where ties, repeated ids or numbers too large to square leave too few, all distances are.
    """
    most = min(len(grid), k + SPARE)
    with np.errstate(over="ignore", invalid="ignore"):
        size = (asked * asked).sum(1)
        rough = (grid * grid).sum(1)[None] - 2 * asked @ grid.T + size[:, None]
        error = 4 * (grid.shape[1] + 4) * np.finfo(float).eps * ((grid * grid).sum(1).max() + size)
        bound = np.partition(rough, most - 1, axis=1)[:, most - 1] + error
        near = rough <= (bound + error)[:, None]
    near[~(np.isfinite(rough).all(1) & np.isfinite(error))] = True

    def told(near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, at = np.nonzero(near)
        d = np.concatenate([np.zeros(0), *(np.sqrt(((grid[at[i : i + STEP]] - asked[q[i : i + STEP]]) ** 2).sum(axis=1)) for i in range(0, len(q), STEP))])
        other = ids[at] != owners[q]
        q, x, d = q[other], ids[at[other]], d[other]
        # of an id that is repeated, the least distance
        order = np.lexsort((d, x, q))
        order = order[np.r_[True, (q[order][1:] != q[order][:-1]) | (x[order][1:] != x[order][:-1])][: len(order)]]
        order = order[np.lexsort((x[order], d[order], q[order]))]
        nth = np.arange(len(order)) - np.searchsorted(q[order], q[order])
        return q[order][nth < k], x[order][nth < k], d[order][nth < k]

    q, x, d = told(near)
    far = np.zeros(len(asked))
    np.maximum.at(far, q, d)
    whole = near.all(1) | (np.bincount(q, minlength=len(asked)) == k) & (far * far <= bound)
    if not whole.all():
        more = told(np.broadcast_to(~whole[:, None], near.shape))
        q, x, d = (np.concatenate([a[whole[q]], b]) for a, b in zip((q, x, d), more, strict=True))
    return owners[q], x, d


def nearest(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id ``every`` divides."""
    spark = embeddings.sparkSession
    # dealt evenly: a file may come as one partition, and searches cost more than rows
    tasks = 4 * spark.sparkContext.defaultParallelism
    rows = materialize(usable(embeddings).repartition(tasks), "vectors")
    sent = spark.sparkContext.broadcast(fit(rows, k))
    posted = materialize(_with_lists(rows, sent, "lists_of"), "posted")
    one = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec")).repartition(tasks)
    asked = materialize(_with_lists(one, sent, "probes"), "asked").withColumnsRenamed({"vec_id": "query_id"})
    # MOST_LISTS rows at most: blocks of a list's rows, and of the queries that ask it
    sizes = posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ROW_BLOCK).cast("int").alias("blocks"))
    visits = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("q_blocks"))
    shape = F.broadcast(materialize(sizes.join(visits, "list"), "shape"))
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = asked.join(shape, "list").withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.col("q_blocks")).cast("int"))
    asked = asked.select("list", every_one("blocks").alias("block"), "q_block", "query_id", "vec")
    dealt = posted.join(shape, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    keys = ["list", "block", "q_block"]
    dealt = dealt.select("list", "block", every_one("q_blocks").alias("q_block"), "vec_id", "vec")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            ids, grid, queries = np.asarray(right["vec_id"].combine_chunks()), _grid(right["vec"]), _grid(left["vec"])
            owners = np.asarray(left["query_id"].combine_chunks())
            out += [nearest_of(queries[at : at + PRODUCTS], owners[at : at + PRODUCTS], grid, ids, k) for at in range(0, len(queries), PRODUCTS)]
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    found = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    each = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
