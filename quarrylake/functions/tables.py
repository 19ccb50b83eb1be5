"""Bar tables in texts and grids of cells: rows, cells, damage, rendering, grading weights.

All are column expressions. A grid is an array of rows, a row an array of cells; a null or empty
grid has no rows. A null text counts as empty.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylake.functions import text as T
from quarrylake.functions.arrays import let

#: What a table's failed transcription leaves in its caption.
FAILURES = ("[table processing failed", "[image processing failed")
#: Words that tell a grading table.
GRADING = ("grad", "weight", "assessment", "evaluation")
#: Share of the grid's rows that a transcription has to have.
COMPLETE = 0.8


_BREAKS = "\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029"


def _one_break(c: Column) -> Column:
    """A text whose line breaks are all line feeds; few have others."""
    others = [F.contains(c, F.lit(x)) for x in "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"]
    return F.when(reduce(or_, others), F.regexp_replace(c, rf"\r\n|[{_BREAKS}]", "\n")).otherwise(c)


def _may_be_empty(gfm: Column) -> Column:
    """False only where no row can have an empty cell: no bars with nothing between, no bar before a tab, no bar alone."""
    return gfm.rlike(rf"\|[ \t]*\||\| *\t|(?:^|[{_BREAKS}])\s*\|\s*(?:$|[{_BREAKS}])")


def cells(row: Column) -> Column:
    """Trimmed cells of a bar row."""
    return F.split(F.regexp_replace(F.trim(row), r"^\|+\s*|\s*\|+$", ""), r"\s*\|\s*")


def is_rule(row: Column) -> Column:
    """Whether a row only parts header and body: cells of dashes and colons, with a dash in each that isn't blank."""
    return F.contains(row, F.lit("-")) & F.trim(row).rlike(r"^\|*\s*(?:(?:[:-]*-[:-]*)?\s*(?:\|\s*|$))+$")


def rows(gfm: Column) -> Column:
    """Rows of a bar table, without rules: lines that begin with a bar."""
    return F.filter(F.split(F.coalesce(gfm, F.lit("")), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda r: F.ltrim(r).startswith("|") & ~is_rule(r))


def grid_rows(grid: Column) -> Column:
    """Data rows of a grid: those with cells, all but the first; rows that would read as rules don't count."""
    held = F.filter(grid, lambda r: (F.size(r) > 0) & ~F.array_join(F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))), "|").rlike(r"^(?=.*-)(?:(?:[:-]*-[:-]*)?(?:\||$))+$"))
    return F.greatest(F.lit(0), F.coalesce(F.size(held), F.lit(0)) - 1)


def row_count(gfm: Column) -> Column:
    """Data rows: all but the header."""
    return F.greatest(F.lit(0), F.size(rows(gfm)) - 1)


def all_cells(gfm: Column) -> Column:
    """Cells row by row, header too."""
    return F.flatten(F.transform(rows(gfm), cells))


def empty_ratio(gfm: Column) -> Column:
    return F.when(_may_be_empty(gfm), let(all_cells(gfm), _ratio)).otherwise(F.lit(0.0))


def _ratio(found: Column) -> Column:
    return F.when(F.size(found) > 0, F.size(F.filter(found, lambda c: c == "")) / F.size(found)).otherwise(F.lit(0.0))


def empty_run(found: Column) -> Column:
    """Longest run of empty ones among cells."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("top"))

    def step(s: Column, c: Column) -> Column:
        run = F.when(c == "", s["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(s["top"], run).alias("top"))

    return F.aggregate(found, start, step, lambda s: s["top"])


def longest_empty(gfm: Column) -> Column:
    """``empty_run`` of a table's cells."""
    return F.when(_may_be_empty(gfm), empty_run(all_cells(gfm))).otherwise(F.lit(0))


def is_degenerate(gfm: Column, run: int = 8, ratio: float = 0.6, least: int = 6) -> Column:
    """A table of at least ``least`` cells with a long run of empty ones, or mostly empty."""
    damaged = let(all_cells(gfm), lambda found: (F.size(found) >= least) & ((empty_run(found) >= run) | (_ratio(found) > ratio)))
    return F.when(_may_be_empty(gfm), damaged).otherwise(F.lit(False))


def looks_like_table(c: Column) -> Column:
    """Two rows or more of two cells or more."""
    return F.size(F.filter(rows(c), lambda r: F.size(cells(r)) >= 2)) >= 2


def to_gfm(grid: Column) -> Column:
    """A grid as a bar table: its first row heads it, short rows are padded, bars in cells escaped; empty for no rows."""
    cell = lambda c: F.replace(F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    held = F.filter(F.coalesce(grid, F.array().cast("array<array<string>>")), lambda r: F.size(r) > 0)
    width = F.coalesce(F.array_max(F.transform(held, F.size)), F.lit(0))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    body = F.transform(held, lambda r: line(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r)))))
    rule = line(F.array_repeat(F.lit("---"), width))
    rest = F.slice(body, F.lit(2), F.greatest(F.size(body), F.lit(1)))
    return F.when(width > 0, F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), rest), "\n")).otherwise(F.lit(""))


def grid_text(grid: Column) -> Column:
    """Non-empty cells of a grid, space-joined."""
    return F.array_join(F.filter(F.flatten(F.coalesce(grid, F.array().cast("array<array<string>>"))), lambda c: F.coalesce(c, F.lit("")) != ""), " ")


def covered(gfm: Column, grid: Column) -> Column:
    """Whether every content token of the grid is in the table."""
    return F.size(F.array_except(T.content_tokens(grid_text(grid)), T.content_tokens(F.coalesce(gfm, F.lit(""))))) == 0


def truncated(gfm: Column, grid: Column) -> Column:
    """A sound table that has clearly fewer rows than its grid."""
    fewer = let(grid_rows(grid), lambda n: (n > 0) & (row_count(gfm) < n * COMPLETE))
    return (F.trim(F.coalesce(gfm, F.lit(""))) != "") & ~is_degenerate(gfm) & fewer


def judged(gfm: Column, grid: Column, partial: Column) -> Column:
    """(outcome, degenerate, truncated, n_rows) of a table, its rows and the grid's counted once.

    The outcome is which of its forms is kept: transcribed, grid_fallback, partial_kept or lost. The fuller form wins.
    """
    text = F.coalesce(gfm, F.lit(""))
    partial = F.trim(F.coalesce(partial, F.lit("")))

    def of(n: Column) -> Column:
        sound = F.when(n["bad"], F.lit(0)).otherwise(n["rows"])
        whole = (sound > 0) & ((n["grid"] == 0) | (sound >= n["grid"] * COMPLETE) & covered(text, grid))
        kept = (
            F.when(whole, "transcribed")
            .when(n["grid"] >= 1, "grid_fallback")
            .when(sound > 0, "transcribed")
            .when(looks_like_table(partial) & ~is_degenerate(partial), "partial_kept")
            .otherwise("lost")
        )
        short = (F.trim(text) != "") & ~n["bad"] & (n["grid"] > 0) & (n["rows"] < n["grid"] * COMPLETE)
        return F.struct(kept.alias("outcome"), n["bad"].alias("degenerate"), short.alias("truncated"), n["rows"].alias("n_rows"))

    return let(F.struct(row_count(text).alias("rows"), is_degenerate(text).alias("bad"), grid_rows(grid).alias("grid")), of)


def outcome(gfm: Column, grid: Column, partial: Column) -> Column:
    """Which of a table's forms is kept."""
    return judged(gfm, grid, partial)["outcome"]


def body(kept: Column, gfm: Column, grid: Column, partial: Column) -> Column:
    """The text of the form that is kept."""
    return F.when(kept == "transcribed", F.trim(gfm)).when(kept == "grid_fallback", to_gfm(grid)).when(kept == "partial_kept", F.trim(partial)).otherwise("")


def render(gfm: Column, grid: Column, partial: Column) -> Column:
    """(body, outcome) of the form that is kept."""
    return let(outcome(gfm, grid, partial), lambda kept: F.struct(body(kept, gfm, grid, partial).alias("body"), kept.alias("outcome")))


def continues(before: Column, grid: Column) -> Column:
    """Whether a grid goes on where the one before it stopped: both have rows, of one width."""
    width = lambda g: F.coalesce(F.size(F.get(g, F.lit(0))), F.lit(0))
    return F.coalesce((F.size(before) > 0) & (F.size(grid) > 0) & (width(before) > 0) & (width(before) == width(grid)), F.lit(False))


def tables(c: Column) -> Column:
    """Tables of a text: arrays of neighbouring lines that begin with a bar."""
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), none.alias("cur"))

    def step(s: Column, line: Column) -> Column:
        bar = F.trim(line).startswith("|")
        closed = F.when(~bar & (F.size(s["cur"]) > 0), F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"])
        return F.struct(closed.alias("done"), F.when(bar, F.concat(s["cur"], F.array(line))).otherwise(none).alias("cur"))

    return F.aggregate(T.lines(F.coalesce(c, F.lit(""))), start, step, lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]))


def row_percent(row: Column) -> Column:
    """The first percentage of a row; null if it has none."""
    return F.regexp_extract(row, r"(\d+(?:\.\d+)?)\s*%", 1).try_cast("double")


def weights(header: Column, content: Column, least: int = 3) -> Column:
    """Row weights of the table with most percentages, where the text is about grading and there are ``least`` rows; else empty.

    A row's weight is its first percentage; rules have no digit, so none. Lines that aren't a table's part the text into its tables.
    """
    about = F.lower(F.concat_ws(" ", header, content)).rlike("|".join(GRADING))
    lines = F.concat(F.lit("\n"), _one_break(F.coalesce(content, F.lit(""))))
    each = F.transform(F.split(lines, r"\n(?! *\|)[^\n]*"), lambda t: F.regexp_extract_all(t, F.lit(r"\n[^\n]*?([0-9]++(?:\.[0-9]++)?)[ \t]*+%[^\n]*"), F.lit(1)))
    best = F.aggregate(each, F.array().cast("array<string>"), lambda s, w: F.when(F.size(w) > F.size(s), w).otherwise(s))
    none = F.array().cast("array<double>")
    told = let(best, lambda b: F.when(F.size(b) >= least, F.transform(b, lambda w: w.cast("double"))).otherwise(none))
    return F.when(F.coalesce(about, F.lit(False)), told).otherwise(none)


def weight_sum(found: Column) -> Column:
    """Sum of row weights, to hundredths; null where there are none."""
    return F.when(F.size(found) > 0, F.round(F.aggregate(found, F.lit(0.0), lambda s, w: s + w), 2))


def failure_markers(c: Column) -> Column:
    """How many failed transcriptions left their mark in a text."""
    c = F.coalesce(c, F.lit(""))
    count = F.lit(0)
    for mark in FAILURES:
        count = count + (F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))) / F.lit(len(mark))
    return count.cast("int")
