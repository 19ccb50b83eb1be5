"""Joins by place on a page: what lies inside what, what stands above, which value belongs to which label.

Rows meet by document and page, which bounds what meets; the geometry is a range predicate on top.
``top`` counts upward from the page's foot, as in the layout's own coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.functions import text as T
from quarrylake.functions.arrays import let

PAGE = ["doc_id", "page"]


def match_key(c: Column) -> Column:
    """Text without white space and dashes, in lower case."""
    return F.regexp_replace(F.lower(c), r"[\s‐-―-]+", "")


def inside(blocks: DataFrame, regions: DataFrame, slack: float = 2.0) -> DataFrame:
    """Rows of ``blocks`` (doc_id, page, x0, top, x1, bottom) whose centre lies in some region of their page, edges widened by ``slack``. Boxes with a null take no part."""
    box = regions.select(*PAGE, *[F.col(c).alias(f"of_{c}") for c in ("x0", "top", "x1", "bottom")]).dropna()
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    within = cx.between(F.col("of_x0") - slack, F.col("of_x1") + slack) & cy.between(F.col("of_bottom") - slack, F.col("of_top") + slack)
    on = [blocks[c] == box[c] for c in PAGE]
    return blocks.join(box, [*on, within], "left_semi")


def insertion_points(links: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page, link_id, at): the place a link's line goes to, after the nearest block above its centre (ties: the first), before all if none is above, after all if its centre is unknown.

    ``links``: doc_id, page, link_id, cy (from the page's head), height; ``blocks``: doc_id, page, ord, top.
    """
    met = links.join(blocks.select(*PAGE, "ord", "top"), PAGE)
    from_head = F.col("height") - F.col("top")
    above = F.when(from_head <= F.col("cy"), F.struct(from_head.alias("y"), (-F.col("ord")).alias("o")))
    known = F.col("cy").isNotNull() & F.col("height").isNotNull()
    at = F.when(~F.bool_or(known), F.max("ord") + 1).otherwise(F.coalesce(1 - F.max(above)["o"], F.min("ord")))
    return met.groupBy(*PAGE, "link_id").agg(at.alias("at"))


def label_values(lines: DataFrame, gap: float = 40.0, band: float = 6.0) -> DataFrame:
    """(doc_id, page, label, value): the nearest line at the right of each ``Label:`` line, in its band; of equal labels on a page the first that has one.

    ``lines``: doc_id, page, ord, x0, y, text.
    """
    label = lines.filter(F.col("text").endswith(":") & (F.length("text") >= 3)).select(*PAGE, F.col("ord").alias("l_ord"), F.col("x0").alias("lx"), F.col("y").alias("ly"), F.col("text").alias("label"))
    met = label.join(lines.select(*PAGE, "ord", "x0", "y", F.col("text").alias("value")), PAGE)
    met = met.filter((F.col("x0") > F.col("lx") + gap) & (F.abs(F.col("y") - F.col("ly")) <= band) & (F.col("value") != F.col("label")))
    each = met.groupBy(*PAGE, "label", "l_ord").agg(F.min_by("value", F.struct(F.col("x0") - F.col("lx"), "ord")).alias("value"))
    return each.groupBy(*PAGE, "label").agg(F.min_by("value", "l_ord").alias("value"))


def join_labels(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, page, ord, text, recovered): bare labels take their value in, where it stands as a block that isn't the next; that block goes.

    Of several blocks that hold the value the first counts; a block is taken once.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+$", "")
    rows = blocks.filter("kind = 'text'").select(*PAGE, "ord", text.alias("text"), match_key(text).alias("key"))
    wanted = rows.filter(F.col("text").endswith(":") & (F.length("text") >= 3)).join(pairs, [*PAGE], "inner").filter(F.col("text") == F.col("label"))
    wanted = wanted.select(*PAGE, F.col("ord").alias("at"), "value", match_key(F.col("value")).alias("key"))
    met = wanted.join(rows.select(*PAGE, "key", "ord"), [*PAGE, "key"]).filter("at != ord")
    met = met.withColumn("nth", F.row_number().over(Window.partitionBy(*PAGE, "at").orderBy("ord"))).filter("nth = 1 AND ord != at + 1")
    met = met.withColumn("turn", F.row_number().over(Window.partitionBy(*PAGE, "ord").orderBy("at"))).filter("turn = 1").select(*PAGE, "at", "value", "ord")
    out = blocks.join(met.select(*PAGE, "ord"), [*PAGE, "ord"], "left_anti").join(met.select(*PAGE, F.col("at").alias("ord"), "value"), [*PAGE, "ord"], "left")
    recovered = F.col("value").isNotNull()
    return out.select(*PAGE, "ord", F.when(recovered, F.concat(F.regexp_replace("text", r"\s+$", ""), F.lit(" "), "value")).otherwise(F.col("text")).alias("text"), recovered.alias("recovered"))


def row_tokens(row: Column) -> Column:
    """Content tokens of a row of cells."""
    return T.content_tokens(F.array_join(row, " "))


def tokens_match(x: Column, y: Column, least: float = 0.4) -> Column:
    """Whether rows of these distinct tokens are one: all of one are the other's, or enough are common; two rows without any are."""
    some = (F.size(x) > 0) & (F.size(y) > 0)
    common = lambda n: (n == F.size(x)) | (n == F.size(y)) | (n / (F.size(x) + F.size(y) - n) >= least)
    return F.when(some, (x == y) | let(F.size(F.array_intersect(x, y)), common)).otherwise((F.size(x) == 0) & (F.size(y) == 0))


def rows_match(a: Column, b: Column, least: float = 0.4) -> Column:
    """Whether two rows of cells are one, by their content tokens."""
    return let(F.struct(row_tokens(a).alias("x"), row_tokens(b).alias("y")), lambda t: tokens_match(t["x"], t["y"], least))


def page_lookup(headers: DataFrame) -> DataFrame:
    """(doc_id, key, page): the page of each header text in lower case, with and without its number; the last one counts. ``headers``: doc_id, ord, text, page."""
    key = F.lower(F.trim("text"))
    plain = F.regexp_replace(key, r"^\d+(?:\.\d+)*\s+", "")
    rows = headers.filter(F.col("page").isNotNull() & (key != "")).select("doc_id", "ord", "page", F.explode(F.array_distinct(F.array(key, plain))).alias("key"))
    return rows.groupBy("doc_id", "key").agg(F.max_by("page", "ord").alias("page"))
