"""Near-duplicate documents by SimHash fingerprints and covering locality-sensitive hashing.

Fingerprints are 64 majority votes over the XXH64 values of word shingles. Every pair of
fingerprints within the radius r must share a bucket: bit i gets a vector of r + 1 bits, and for
each non-zero vector v a table keeps the bits whose vector has an odd product with v. Any r
differing bits leave some v whose table keeps none of them, so all pairs within r agree there.

Equal fingerprints are one node from the start, so copies never meet as pairs. A bucket of more
than ``BLOCK`` fingerprints is cut into blocks, and each pair of blocks is compared by a task of its
own; a task gives a spanning forest of its links, never all of them.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; null ids
are linked and the component takes the least id that isn't null; repeated rows keep a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.llm.common import bounded, fresh, materialize
from quarrylake.llm.components import connected_components

RADIUS, SHINGLE, SEED, BLOCK = 3, 3, 42, 2048


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Fingerprint as a signed 64-bit integer."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
        digest = xxhash.xxh64_intdigest
        starts = [0, *[e + 1 for e in ends]]
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, hashed: bool = False) -> DataFrame:
    """(doc_id, fp) of every row, with the text's ``hash`` between them if asked; fp holds the 64 bits as a long."""
    names = ["doc_id", "hash"] if hashed else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([fingerprint(t.as_py()) for t in batch.column(len(names))], pa.int64())], [*names, "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text").select(*names, "text")
    return bounded(rows).mapInArrow(run, ", ".join(f"{n} long" for n in [*names, "fp"]))


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The covering masks: bit i has the vector i mod 2 ** (radius + 1), so each mask keeps half of the bits."""
    width = radius + 1
    return [sum(1 << i for i in range(bits) if ((i % (1 << width)) & v).bit_count() & 1) for v in range(1, 1 << width)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within the radius among distinct fingerprints of one bucket."""
    links, left = [], np.arange(len(fps))
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            x = front.pop()
            # as unsigned: of a signed number numpy counts the bits of its absolute value
            near = np.bitwise_count((fps[left] ^ fps[x]).view(np.uint64)) <= radius
            found = left[near]
            links += [(int(fps[x]), int(fps[y])) for y in found]
            front += found.tolist()
            left = left[~near]
    return links


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): links that join the same fingerprints as all pairs within ``radius`` do.

    ``distinct`` has each fingerprint once in ``fp``.
    """
    tables = F.array(*[F.struct(F.lit(k).alias("mask"), F.lit(_signed(m)).alias("bits")) for k, m in enumerate(masks(radius))])
    keyed = distinct.select("fp", F.explode(tables).alias("t")).select("fp", F.col("t.mask").alias("mask"), F.col("fp").bitwiseAND(F.col("t.bits")).alias("key"))
    shared = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = keyed.join(shared, ["mask", "key"])
    # blocks of a large bucket: each row goes once to every pair of blocks that has its own
    parts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(F.col("own"), j) * F.col("parts") + F.greatest(F.col("own"), j))
    dealt = met.withColumn("parts", parts).withColumn("own", own).select("mask", "key", "fp", F.explode(pairs).alias("pair"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        group = None
        out: list[tuple[int, int]] = []
        for batch in batches:
            table = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for mask, key, fp, pair in table:
                if (mask, key, pair) != group:
                    out += _forest(np.array(held, np.int64), radius)
                    held, group = [], (mask, key, pair)
                held.append(fp)
            yield _pairs(out)
            out = []
        yield _pairs(out + _forest(np.array(held, np.int64), radius))

    def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    # one bucket's pair of blocks holds at most about 2 * block rows: bounded in each task's memory
    grouped = dealt.repartition("mask", "key", "pair").sortWithinPartitions("mask", "key", "pair", "fp")
    return grouped.mapInArrow(run, "a long, b long")


def _linked(own: DataFrame, least: Column, radius: int) -> DataFrame:
    """(fp, least, root) of every fingerprint: ``least`` over its rows, and its component's root."""
    nodes = materialize(own.groupBy("fp").agg(least.alias("least")), "nodes")
    roots = connected_components(materialize(links(nodes.select("fp"), radius), "links"))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the least doc_id that links reach."""
    own = materialize(fingerprints(docs), "fingerprints")
    linked = _linked(own, F.min("doc_id"), radius)
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(linked.join(least, "root").select("fp", "component_id"), "classes")
    return own.join(classes, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: the one with its least doc_id, then text hash (of repeated rows, one).

    It is rows that stay or go, so an id on two texts can stay twice. Null ids come last. Rows with
    neither id nor text hold nothing to be a copy of, so they all stay.
    """
    nothing = F.col("doc_id").isNull() & F.col("text").isNull()
    rows = docs.filter(~nothing)
    own = materialize(fingerprints(rows, hashed=True), "fingerprints")
    linked = _linked(own, F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")), radius)
    id_, hash_, row = (fresh(docs, x) for x in ("first_id", "text_hash", "copy"))
    first = linked.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias(id_), F.col("least.hash").alias(f"{hash_}_"))
    keyed = rows.withColumn(hash_, F.xxhash64("text"))
    kept = keyed.join(first, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(hash_) == F.col(f"{hash_}_")), "left_semi")
    once = kept.withColumn(row, F.row_number().over(Window.partitionBy("doc_id", hash_).orderBy(hash_))).filter(F.col(row) == 1)
    return once.select(*docs.columns).unionByName(docs.filter(nothing))
