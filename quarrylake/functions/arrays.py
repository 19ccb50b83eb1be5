"""Functions on arrays and nested values: vectors, tables as grids, folds over ordered items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``x``, with ``x`` worked out once however often it is read there."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where either is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def level_skips(levels: Column) -> Column:
    """How often a heading level goes down by more than one step from a level above zero."""
    pairs = F.arrays_zip(F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(0))).alias("a"), F.slice(levels, 2, F.greatest(F.size(levels), F.lit(1))).alias("b"))
    return F.size(F.filter(pairs, lambda p: (p["a"] > 0) & (p["b"] > p["a"] + 1)))


def normalize_levels(levels: Column, deepest: int = 6) -> Column:
    """Heading levels without skips: each heading's depth among the open ones, at most ``deepest``."""
    start = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, level: Column) -> Column:
        raw = F.greatest(level.cast("int"), F.lit(1))
        now = F.concat(F.filter(s["open"], lambda x: x < raw), F.array(raw))
        return F.struct(now.alias("open"), F.concat(s["out"], F.array(F.least(F.size(now), F.lit(deepest)).cast("int"))).alias("out"))

    return F.aggregate(levels, start, step, lambda s: s["out"])


def pack_parts(parts: Column, most: int) -> Column:
    """Greedy packing of texts in order: newline-joined groups of at most ``most`` characters, separators not counted."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"), F.lit(0).alias("n"))

    def step(s: Column, p: Column) -> Column:
        fits = s["cur"].isNotNull() & (s["n"] + F.length(p) <= most)
        return F.struct(
            F.when(fits | s["cur"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"]))).alias("done"),
            F.when(fits, F.concat_ws("\n", s["cur"], p)).otherwise(p).alias("cur"),
            F.when(fits, s["n"] + F.length(p)).otherwise(F.length(p)).alias("n"),
        )

    return F.aggregate(parts, start, step, lambda s: F.when(s["cur"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"]))))


def windows(c: Column, size: int, overlap: int) -> Column:
    """(ord, content) of fixed character windows with overlap; the last window ends with the text."""
    step = size - overlap
    n = F.length(c)
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda i: F.struct(i.alias("ord"), F.substring(c, i * step + 1, F.lit(size)).alias("content")))
