"""Placement of rows on shards by a permutation-filled lookup table.

Shards take turns claiming slots of a prime-sized table, each in its own preference order
(offset, offset + skip, offset + 2 skip, ... modulo the size), until no slot is free. A row's key
is hashed to a slot. The table has ``slots`` rows whatever the data's size, so it is broadcast and
each placement is one lookup; taking a shard away moves little but that shard's own keys.

Everything here is DataFrame and SQL functions. Defined cases: a null key is placed as the empty
text; repeated keys go to one shard by design (salt the key with a row id where a hot key must be
spread: ``place(..., salt=...)``); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime of at least 64 slots a shard keeps shards within a few per cent of each other.
SHARDS, SLOTS = 32, 2053


def _md5_int(text: Column, at: int) -> Column:
    """Eight hexadecimal digits of an MD5, from place ``at``, as a number: alike in any SQL engine."""
    return F.conv(F.substring(F.md5(text), at, 8), 16, 10).cast("long")


def lookup_table(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard): the filled table.

    Turn t belongs to shard t mod ``shards``, which claims the free slot it likes best: the least
    (slot - offset) / skip modulo the prime. The fold keeps the free slots and the claims in order.
    """
    name = F.concat(F.lit("shard-"), F.col("id").cast("string"))
    bits = F.array(*[F.lit(int(b)) for b in bin(slots - 2)[2:]])
    # the skip's inverse modulo the prime, by Fermat: skip ** (slots - 2), its bits folded
    inverse = F.aggregate(bits, F.lit(1).cast("long"), lambda acc, b: (acc * acc % slots) * F.when(b == 1, F.col("skip")).otherwise(F.lit(1)) % slots)
    shard = spark.range(0, shards, 1, 1).select("id", (_md5_int(name, 1) % slots).alias("offset"), (_md5_int(name, 9) % (slots - 1) + 1).alias("skip"))
    rows = shard.select("id", "offset", inverse.alias("inverse")).agg(F.sort_array(F.collect_list(F.struct("id", "offset", "inverse"))).alias("p"))
    # the repartition keeps the optimiser from computing the preferences anew inside the fold
    prefs = rows.select(F.col("p.offset").alias("offset"), F.col("p.inverse").alias("inverse")).repartition(1)
    filled = prefs.select(
        F.expr(
            f"aggregate(sequence(0, {slots - 1}), "
            f"named_struct('free', transform(sequence(0, {slots - 1}), s -> cast(s as bigint)), 'claims', cast(array() as array<bigint>)), "
            f"(acc, t) -> transform(array(array_min(transform(acc.free, s -> "
            f"pmod((s - offset[t % {shards}]) * inverse[t % {shards}], {slots}L) * {slots}L + s)) % {slots}L), "
            f"got -> named_struct('free', array_remove(acc.free, got), 'claims', concat(acc.claims, array(got))))[0], "
            f"acc -> acc.claims)"
        ).alias("claims")
    )
    return filled.select(F.posexplode("claims").alias("turn", "slot")).select("slot", (F.col("turn") % shards).cast("int").alias("shard"))


def place(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS, salt: str | None = None) -> DataFrame:
    """(key, slot, shard) of every row of ``df``; with ``salt``, that column is hashed along with the key."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    if salt:
        text = F.concat(text, F.lit("#"), F.coalesce(F.col(salt).cast("string"), F.lit("")))
    keyed = df.select(F.col(key).alias("key"), text.alias("text")).select("key", (_md5_int(F.col("text"), 1) % slots).alias("slot"))
    return keyed.join(F.broadcast(lookup_table(df.sparkSession, shards, slots)), "slot").select(F.col("key").alias(key), "slot", "shard")


def oracle(shards: int = SHARDS, slots: int = SLOTS) -> str:
    """DuckDB SQL for the placement of ``documents`` by doc_id: the same table, claimed turn by turn."""
    digits = "('0x' || substr(md5({0}), {1}, 8))::BIGINT"
    return f"""
WITH RECURSIVE shard AS (
  SELECT i AS shard, {digits.format("'shard-' || i", 1)} % {slots} AS first, {digits.format("'shard-' || i", 9)} % {slots - 1} + 1 AS skip FROM range({shards}) t(i)
), wish AS (
  SELECT shard, list((first + j * skip) % {slots} ORDER BY j) AS slots FROM shard, range({slots}) r(j) GROUP BY shard
), fill(turn, slot, taken) AS (
  SELECT 0::BIGINT, slots[1], [slots[1]] FROM wish WHERE shard = 0
  UNION ALL
  SELECT turn + 1, got, list_append(taken, got) FROM (
    SELECT f.turn, f.taken, list_filter(w.slots, lambda s: NOT list_contains(f.taken, s))[1] AS got
    FROM fill f JOIN wish w ON w.shard = (f.turn + 1) % {shards} WHERE f.turn + 1 < {slots})
)
SELECT d.doc_id, d.slot, (f.turn % {shards})::INTEGER AS shard
FROM (SELECT doc_id, {digits.format("coalesce(doc_id::VARCHAR, '')", 1)} % {slots} AS slot FROM documents) d JOIN fill f ON f.slot = d.slot
"""
