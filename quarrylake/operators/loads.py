"""Loads of catalogue tables from documents: what each natural key keeps of the rows that share it.

Every load pre-aggregates by its key before the shuffle and takes one shuffle on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], order: str, coalesced: list[str]) -> DataFrame:
    """One row a key: its first row's values, but of ``coalesced`` columns the last that isn't null. Rows with a null key are left out."""
    known = rows.dropna(subset=keys)
    values = [c for c in rows.columns if c not in (*keys, order)]
    firsts = [F.min_by(c, order).alias(c) if c not in coalesced else F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in values]
    return known.groupBy(*keys).agg(*firsts)


def last_wins(rows: DataFrame, keys: list[str], order: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """One row a key: its last row's values, but of ``kept`` columns the first's."""
    values = [c for c in rows.columns if c not in (*keys, order)]
    return rows.dropna(subset=keys).groupBy(*keys).agg(*[(F.min_by if c in kept else F.max_by)(c, order).alias(c) for c in values])


def with_id(rows: DataFrame, known: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """``rows`` with ``id_`` looked up by ``keys``, nulls equal; null where it isn't known. ``known`` has each key once."""
    right = known.select(*[F.col(k).alias(f"of_{k}") for k in keys], id_)
    on = [rows[k].eqNullSafe(right[f"of_{k}"]) for k in keys]
    return rows.join(right, on, "left").select(*rows.columns, id_)


def policies(rows: DataFrame, name: str, member: str) -> DataFrame:
    """(policy_id, name, members): policies by the digest of their trimmed, lower-cased name; the first name in order, members sorted."""
    key = F.sha2(F.lower(F.trim(name)), 256).alias("policy_id")
    return rows.groupBy(key).agg(F.min(name).alias("name"), F.array_sort(F.collect_set(member)).alias("members"))


def run_column(items: DataFrame, results: DataFrame, name: str, id_: str = "id") -> DataFrame:
    """``items`` with a run's results in a column of that name, put in or in place of the old one; items without a result get null."""
    new = results.select(F.col(id_), F.col("value").alias(name))
    return items.drop(name).join(new, id_, "left")


def structured(rows: DataFrame, key: str, arrays: dict[str, str]) -> dict[str, DataFrame]:
    """Child tables of nested rows: name to (key, ord, the element's text), one for each array column; blank elements go, ordinals stay those of the array."""
    out = {}
    for name, column in arrays.items():
        each = rows.select(key, F.posexplode(column).alias("ord", "text"))
        out[name] = each.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    return out


def merged_extracts(parts: DataFrame, key: str, order: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """One row a key from its pages: of scalars the first that is there (not null, not blank), of lists all items once, in order."""
    filled = lambda c: F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", F.col(order))
    firsts = [F.min_by(c, filled(c)).alias(c) for c in scalars]
    joined = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(c, F.array().cast("array<string>")).alias("v")))), lambda x: x["v"]))).alias(c) for c in lists]
    return parts.groupBy(key).agg(*firsts, *joined)


def numbered(items: DataFrame, question: str, order: str, empty: Column) -> DataFrame:
    """Items with an answer, the first of each question, numbered from 1 in ``order``.

    The number is a running count over cells of the order, so no task sorts all items.
    """
    kept = items.filter(~empty)
    first = kept.groupBy(question).agg(F.min(order).alias(order))
    once = kept.join(first, [question, order], "left_semi")
    cell = F.floor(F.col(order) / 4096)
    counts = once.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("cell", "before")  # a row for 4096 items
    own = F.row_number().over(Window.partitionBy("cell").orderBy(order))
    return once.withColumn("cell", cell).join(before, "cell").withColumn("number", F.col("before") + own).drop("cell", "before")
