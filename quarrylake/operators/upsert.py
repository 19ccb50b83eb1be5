"""Upserts on plain tables: the rewritten table as a frame, to be written beside the old one and swapped in.

A batch may hold a key several times: its last row by ``order`` counts (ties: the greatest row). Each
takes one shuffle on the keys; rows of the base with a null key never match and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.operators.names import fresh


def last_rows(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, pre-aggregated before the shuffle; rows without a key are left out."""
    values = [c for c in batch.columns if c not in keys]
    known = batch.dropna(subset=keys)
    (last,) = fresh(batch, "last_row")
    # fields by place: a batch's column may have any name
    picked = known.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("f0"), *[F.col(c).alias(f"f{i + 1}") for i, c in enumerate(values)])).alias(last))
    return picked.select(*keys, *[F.col(last)[f"f{i + 1}"].alias(c) for i, c in enumerate(values)])


def upsert(base: DataFrame, batch: DataFrame, keys: list[str], order: str, coalesce: bool = False) -> DataFrame:
    """``base`` with the batch's last rows put in; with ``coalesce``, a null in the batch keeps the old value."""
    new = last_rows(batch, keys, order)
    put = dict(zip(base.columns, fresh(base, *[f"new_{c}" for c in base.columns]), strict=True))
    (is_new,) = fresh(base.select("*", *[F.lit(None).alias(n) for n in put.values()]), "is_new")
    both = base.join(new.select(*[F.col(c).alias(put[c]) for c in base.columns], F.lit(True).alias(is_new)), [F.col(k) == F.col(put[k]) for k in keys], "full_outer")
    out = []
    for c in base.columns:
        if c in keys:
            out.append(F.coalesce(c, put[c]).alias(c))
        elif coalesce:
            out.append(F.coalesce(put[c], c).alias(c))
        else:
            out.append(F.when(F.col(is_new), F.col(put[c])).otherwise(F.col(c)).alias(c))
    return both.select(*out)


def replace_by_key(base: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the keys that occur in ``batch`` go; the batch's rows take their place."""
    return base.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch)
