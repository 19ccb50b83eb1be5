"""Tables that two parsers saw, merged; tables that a page break cut, spliced; blocks as one markdown text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.functions import tables as G
from quarrylake.functions import text as T
from quarrylake.functions.arrays import let
from quarrylake.operators.layout import row_tokens, tokens_match

#: Letters of a token that is worth a cell or a row.
LONG = 4
GRID = "array<array<string>>"


def _upgraded(row: Column, other: Column) -> Column:
    """(row, n): cells that aren't blank take the other's text where that holds all their tokens and a long one more."""

    def cell(mine: Column, theirs: Column) -> Column:
        x, y = (T.content_tokens(F.coalesce(c, F.lit(""))) for c in (mine, theirs))
        better = ~mine.eqNullSafe(theirs) & (F.trim(F.coalesce(mine, F.lit(""))) != "") & let(F.struct(x.alias("x"), y.alias("y")), lambda t: (F.size(F.array_except(t["x"], t["y"])) == 0) & F.exists(F.array_except(t["y"], t["x"]), lambda w: F.length(w) >= LONG))
        return let(better, lambda b: F.struct(F.when(b, theirs).otherwise(mine).alias("c"), b.cast("int").alias("n")))

    return let(F.zip_with(row, other, cell), lambda found: F.struct(found["c"].alias("row"), F.aggregate(found["n"], F.lit(0), lambda s, n: s + n).alias("n")))


def merged(grid: Column, other: Column) -> Column:
    """(grid, inserted, upgraded): a grid with the cells and rows that another parser's grid of the same table has and it lacks.

    The rows of both are walked in order. Rows that match are one, with its cells upgraded; a row of ``other`` that matches none to come and
    holds a long token that the grid lacks is put in; all rows of ``grid`` stay, in their order. Grids whose rows aren't all of one width, or
    that are empty or null, leave the grid as it is. A row's tokens are told once; only those of an upgraded row are told again.
    """
    none = F.array().cast(GRID)
    a, b = F.coalesce(grid, none), F.coalesce(other, none)
    width = F.coalesce(F.size(F.get(a, F.lit(0))), F.lit(0))
    even = (F.size(a) > 0) & (F.size(b) > 0) & (width > 0) & F.forall(a, lambda r: F.size(r) == width) & F.forall(b, lambda r: F.size(r) == width)
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), none.alias("grid"), none.alias("told"), F.lit(0).alias("inserted"), F.lit(0).alias("upgraded"))
    result = lambda g, inserted, upgraded: F.struct(g.alias("grid"), inserted.alias("inserted"), upgraded.alias("upgraded"))

    def walk(both: Column) -> Column:
        a, b, x, y, news = both["a"], both["b"], both["x"], both["y"], both["news"]

        def step(s: Column, _: Column) -> Column:
            d, p, q = F.get(a, s["i"]), F.get(b, s["j"]), F.get(y, s["j"])
            lacks = lambda among: F.get(news, s["j"]) & ~F.exists(among, lambda t: tokens_match(t, q))
            put = lambda i, j, row, told, inserted, upgraded: F.struct((s["i"] + i).alias("i"), (s["j"] + j).alias("j"), F.concat(s["grid"], F.array(row)).alias("grid"), F.concat(s["told"], F.array(told)).alias("told"), (s["inserted"] + inserted).alias("inserted"), (s["upgraded"] + upgraded).alias("upgraded"))
            mine, theirs = put(1, 0, d, F.get(x, s["i"]), 0, 0), put(0, 1, p, q, 1, 0)
            passed = F.struct(s["i"].alias("i"), (s["j"] + 1).alias("j"), s["grid"].alias("grid"), s["told"].alias("told"), s["inserted"].alias("inserted"), s["upgraded"].alias("upgraded"))
            same = put(1, 1, d, F.get(x, s["i"]), 0, 0)
            met = F.when(d == p, same).otherwise(let(_upgraded(d, p), lambda u: F.when(u["n"] > 0, put(1, 1, u["row"], row_tokens(u["row"]), 0, u["n"])).otherwise(same)))
            both_left = F.when(tokens_match(F.get(x, s["i"]), q), met).when(lacks(F.slice(x, s["i"] + 1, F.size(a))), theirs).otherwise(mine)
            tail = F.when(lacks(s["told"]), theirs).otherwise(passed)
            more_a, more_b = s["i"] < F.size(a), s["j"] < F.size(b)
            return F.when(more_a & more_b, both_left).when(more_a, mine).when(more_b, tail).otherwise(s)

        return F.aggregate(F.sequence(F.lit(1), F.size(a) + F.size(b)), start, step, lambda s: result(s["grid"], s["inserted"], s["upgraded"]))

    ready = F.struct(a.alias("a"), b.alias("b"), F.transform(a, row_tokens).alias("x"), F.transform(b, row_tokens).alias("y"))
    new = lambda r: F.transform(r["y"], lambda t: F.exists(F.array_except(t, F.flatten(r["x"])), lambda w: F.length(w) >= LONG))
    told = let(ready, lambda r: let(F.struct(*[r[k].alias(k) for k in ("a", "b", "x", "y")], new(r).alias("news")), walk))
    return F.when(even, told).otherwise(result(a, F.lit(0), F.lit(0)))


def _spliced(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, head, cont, new_rows, own): a row a block; cont tells continuations, own is the lines of the other blocks.

    Blocks are dealt by document once. A block and its tokens go on as rows of one frame, so that what was shown first is a window's and no join is needed.
    """
    lost = (F.col("kind") == "table") & (F.col("outcome") == "lost") & (F.coalesce(F.size("grid"), F.lit(0)) > 0)
    in_order = Window.partitionBy("doc_id").orderBy("ord")
    rows = blocks.select("doc_id", "ord", "kind", F.coalesce("rendered", F.lit("")).alias("rendered"), "grid", F.coalesce(lost, F.lit(False)).alias("lost"))
    runs = rows.withColumns({"place": F.row_number().over(in_order), "head": F.max(F.when(~F.col("lost"), F.col("ord"))).over(in_order)})
    of_run = Window.partitionBy("doc_id", "head").orderBy("ord")
    first = F.first(F.when((F.col("kind") == "table") & (F.col("rendered") != ""), F.col("grid"))).over(of_run)
    fits = F.min(F.when(F.col("lost"), G.continues(F.col("first"), F.col("grid")).cast("int")).otherwise(1)).over(of_run)
    told = runs.withColumn("first", first).withColumn("fits", fits).withColumn("cont", F.col("lost") & F.col("head").isNotNull() & (F.col("fits") == 1))
    told = told.withColumn("any", F.max("cont").over(Window.partitionBy("doc_id")))
    token = lambda t, nth: F.struct(t.alias("token"), nth.cast("int").alias("nth"))
    of_grid = F.flatten(F.transform("grid", lambda row, i: F.transform(row_tokens(row), lambda t: token(t, i))))
    shown = F.transform(T.content_tokens(F.col("rendered")), lambda t: token(t, F.lit(None)))
    tokens = F.when(F.col("cont"), of_grid).when(F.col("any") & ~F.col("lost"), shown)
    own = F.when((F.col("kind") == "table") & (F.col("rendered") == ""), F.array().cast("array<string>")).otherwise(F.array("rendered"))
    block = F.struct("ord", "head", "cont", F.when(F.col("cont"), F.col("grid")).alias("grid"), F.when(~F.col("cont"), own).alias("own"))
    none = token(F.lit(None).cast("string"), F.lit(None))
    each = told.select("doc_id", "place", "ord", "cont", block.alias("block"), F.explode(F.concat(F.array(none), F.coalesce(tokens, F.array().cast("array<struct<token:string,nth:int>>")))).alias("t"))
    each = each.select("doc_id", "place", "ord", "cont", "t.token", "t.nth", F.when(F.col("t.token").isNull(), F.col("block")).alias("block"))
    since = each.withColumn("since", F.min("ord").over(Window.partitionBy("doc_id", "token")))
    kept = since.filter(F.col("token").isNull() | F.col("cont") & (F.col("since") >= F.col("ord")))
    found = kept.groupBy("doc_id", "place").agg(F.first("block", ignorenulls=True).alias("block"), F.sort_array(F.collect_set("nth")).alias("nths"))
    new = F.transform("nths", lambda i: F.get(F.col("block.grid"), i))
    return found.select("doc_id", "block.ord", "block.head", "block.cont", F.when(F.col("block.cont"), new).alias("new_rows"), "block.own")


def continuations(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, head, new_rows) of lost tables that go on where the table before them stopped.

    ``blocks``: doc_id, ord, kind, rendered, grid, outcome. A lost table (kind table, outcome lost, with rows) continues the last block that isn't one,
    if that is a rendered table and all between are continuations too, of its width. Its new rows are those with a content token that nothing
    before it shows: no rendered block and no continuation.
    """
    return _spliced(blocks).filter("cont").select("doc_id", "ord", "head", "new_rows")


def data_row(row: Column) -> Column:
    """A row of cells as a bar row."""
    cell = lambda c: F.replace(F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return F.concat(F.lit("| "), F.array_join(F.transform(row, cell), " | "), F.lit(" |"))


def markdown(blocks: DataFrame) -> DataFrame:
    """(doc_id, text, n_joined, n_rows): blocks in order, a blank line after each; new rows of continuations stand right after their table. A document is one row, so it has to fit one.

    n_joined counts the continuations, n_rows their new rows.
    """
    cont = F.col("cont")
    lines = F.when(cont, F.transform("new_rows", data_row)).otherwise(F.concat(F.array(F.lit("")), F.col("own")))  # the blank line of the block before
    entry = F.struct(F.when(cont, F.col("head")).otherwise(F.col("ord")).alias("at"), "ord", lines.alias("lines"))
    whole = _spliced(blocks).groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("b"), F.count_if(cont).alias("n_joined"), F.coalesce(F.sum(F.when(cont, F.size("new_rows"))), F.lit(0)).cast("long").alias("n_rows"))
    text = F.substring(F.array_join(F.flatten(F.col("b.lines")), "\n"), 2, 2**31 - 1)
    return whole.select("doc_id", F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n")).alias("text"), "n_joined", "n_rows")
