"""A registry of quality checks: a predicate over a document's metrics, a severity, and whether a failure blocks.

Metrics are computed once a document, in one grouping; all checks of a family are then told from
that row, so a check costs no pass over the data of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.functions import arrays as A
from quarrylake.functions import markdown as M
from quarrylake.functions import tables as B
from quarrylake.functions import text as T


@dataclass(frozen=True)
class Check:
    """``passed`` and ``value`` are SQL over metric columns; both engines that run it read them alike."""

    name: str
    passed: str
    value: str
    severity: str = "WARN"
    blocking: bool = False


def evaluate(metrics: DataFrame, checks: list[Check], key: str = "doc_id") -> DataFrame:
    """(key, check_name, passed, value, severity, blocking): a row a document and check. A predicate on a null metric fails."""
    told = [
        F.struct(F.lit(c.name).alias("check_name"), F.coalesce(F.expr(c.passed), F.lit(False)).alias("passed"), F.expr(c.value).cast("double").alias("value"), F.lit(c.severity).alias("severity"), F.lit(c.blocking).alias("blocking"))
        for c in checks
    ]
    return metrics.select(key, F.explode(F.array(*told)).alias("c")).select(key, "c.*")


def alert(failed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(check_name, message): one message a check that failed, its documents in order; checks without failures give none."""
    line = F.concat(F.lit("- "), "check_name", F.lit(" ["), F.col(key).cast("string"), F.lit("]"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("line")))), lambda x: x["line"])
    return failed.groupBy("check_name").agg(F.concat(F.lit("failures:\n"), F.array_join(lines, "\n")).alias("message"))


def drift(series: DataFrame, by: list[str], order: list[str], value: str, most: float | Column = 0.2, runs: int = 5) -> DataFrame:
    """Adds base (the median of up to ``runs`` values before), n_history and drifted; no history or a zero median passes."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(-runs, -1)
    middle = lambda s: (F.get(s, ((F.size(s) - 1) / 2).cast("int")) + F.get(s, (F.size(s) / 2).cast("int"))) / 2
    rows = series.withColumn("base", A.let(F.array_sort(F.collect_list(value).over(before)), middle)).withColumn("n_history", F.count(value).over(before))
    return rows.withColumn("drifted", F.coalesce((F.col("base") != 0) & (F.abs((F.col(value) - F.col("base")) / F.col("base")) > most), F.lit(False)))


def describe_drift(value: Column, base: Column, n: Column, most: Column) -> Column:
    """One line on a drift result, the change in whole percent."""
    change = F.floor((value - base) / base * 100 + 0.5).cast("long")
    signed = F.concat(F.when(change >= 0, "+").otherwise(""), change.cast("string"))
    told = F.concat(value.cast("string"), F.lit(" vs baseline median "), base.cast("string"), F.lit(" ("), signed, F.lit("%, allowed "), F.round(most * 100).cast("int").cast("string"), F.lit("%, n="), n.cast("string"), F.lit(")"))
    return F.when(n == 0, F.concat(value.cast("string"), F.lit(" - no baseline yet (first run)"))).when(base == 0, F.concat(value.cast("string"), F.lit(" vs baseline 0 - delta undefined"))).otherwise(told)


def _missing(kept: Column, source: Column) -> Column:
    return F.size(F.array_except(source, kept))


def block_metrics(blocks: DataFrame) -> DataFrame:
    """One row a document of (doc_id, ord, page, kind, level, raw_level, text, x, y, caption, survives) blocks.

    ``x`` and ``y`` are a box's extents (0 where unknown), ``survives`` whether the text is kept. Rows
    are dealt by document once, for two windows (neighbours in order, sums of the page) and one grouping, whose
    lists hold a block's tokens and links once; all sets are made of these lists.
    """
    kind, text = F.col("kind"), F.coalesce("text", F.lit(""))
    written, heading, table = kind.isin("text", "heading"), kind == "heading", kind == "table"
    neighbours = blocks.withColumns({
        "area": F.abs(F.col("x") * F.col("y")), "levels": F.when(heading, F.struct("level", "raw_level")), "told": F.when(written, F.struct("page", "kind", F.trim(text).alias("text"))),
    }).withColumns({k: F.expr(f"{f} IGNORE NULLS OVER (PARTITION BY doc_id ORDER BY ord)") for k, f in (("above", "lag(levels)"), ("next", "lead(told)"))})
    of_page = Window.partitionBy("doc_id", "page").orderBy("ord")
    whole = of_page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = neighbours.withColumns({
        "nth": F.row_number().over(of_page), "page_chars": F.sum(F.when(written, F.length(text)).otherwise(0)).over(whole),
        "image": F.coalesce(F.max(F.when(kind == "image", F.col("area"))).over(whole), F.lit(0.0)), "unmeasured": F.coalesce(F.bool_or((kind == "image") & (F.col("area") == 0)).over(whole), F.lit(False)),
    })
    trimmed, answer = F.trim(text), F.col("next.text")
    label = (kind == "text") & trimmed.endswith(":") & F.length(trimmed).between(3, 35) & ~F.contains(trimmed, F.lit("\n")) & (F.size(F.split(trimmed, r"\s+")) <= 4)
    answered = F.coalesce((F.col("next.page") == F.col("page")) & (F.col("next.kind") == "text") & (answer != "") & ~answer.endswith(":"), F.lit(False))
    skip = lambda c: heading & (F.col(f"above.{c}") > 0) & (F.col(c) > F.col(f"above.{c}") + 1)
    rows = rows.withColumns({"label": label, "answered": answered, "found": M.links(text), "tokens": T.content_tokens(text)})
    block = F.struct("tokens", F.coalesce("survives", F.lit(False)).alias("survives"), F.coalesce(table, F.lit(False)).alias("table"))
    told = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.count_if(kind == "text").alias("n_text"), F.count_if(heading).alias("n_headings"), F.size(F.collect_set(F.when(heading, F.col("level")))).cast("long").alias("n_levels"),
        F.count_if(skip("level")).alias("n_skips"), F.count_if(skip("raw_level")).alias("n_raw_skips"), F.sum(T.replacement_chars(text)).alias("n_replacement"), F.sum(T.letter_drops(text)).alias("n_drops"), F.sum(T.ligature_damage(text)).alias("n_ligature"),
        F.count_if(heading & M.is_suspicious(text)).alias("n_suspicious"), F.count_if("label").alias("n_labels"), F.count_if(F.col("label") & ~F.col("answered")).alias("n_unanswered"),
        F.count_if((kind == "image") & (F.col("area") >= 50_000) & (F.trim(F.coalesce("caption", F.lit(""))) == "")).alias("n_content_images"), F.sum(F.length(text)).alias("n_chars"),
        F.count_if(F.col("nth") == 1).alias("n_pages"), F.count_if((F.col("nth") == 1) & (F.col("page_chars") < 50) & ((F.col("image") >= 50_000) | F.col("unmeasured"))).alias("n_ocr"),
        F.collect_list(F.when(F.size("found") > 0, F.col("found"))).alias("found"), F.collect_list(M.without_links(text)).alias("plain"), F.collect_list(F.when(F.size("tokens") > 0, block)).alias("blocks"),
    )
    flat = lambda among: F.array_distinct(F.flatten(among["tokens"]))
    tables = F.filter("blocks", lambda b: b["table"])
    told = told.withColumns({"found": F.flatten("found"), "tables": tables, "source": flat(F.col("blocks")), "kept": flat(F.filter("blocks", lambda b: b["survives"]))})
    told = told.withColumns({"in_tables": flat(F.col("tables")), "in_kept_tables": flat(F.filter("tables", lambda b: b["survives"])), "targets": F.transform("found", lambda x: M.link_value(x["target"]))})
    plain = F.array_join("plain", "\n")
    fabricated = F.when(F.size("targets") > 0, A.let(plain, lambda p: F.size(F.filter("targets", lambda t: (t != "") & F.contains(p, t))))).otherwise(0)
    gone = F.size(F.filter("tables", lambda b: (F.size(b["tokens"]) >= 3) & (2 * F.size(F.array_except(b["tokens"], F.col("kept"))) > F.size(b["tokens"]))))
    return told.withColumns({
        "n_garbled": F.size(F.filter("found", lambda x: M.is_garbled(x["label"]))).cast("long"), "n_gone_tables": gone,
        "n_links": F.size("targets"), "n_fabricated": fabricated, "n_tokens": F.size("source"), "n_lost_tokens": _missing(F.col("kept"), F.col("source")),
        "n_table_tokens": F.size("in_tables"), "n_lost_table_tokens": _missing(F.col("in_kept_tables"), F.col("in_tables")),
    }).drop("found", "targets", "plain", "blocks", "source", "kept", "in_tables", "in_kept_tables", "tables")


def chunk_metrics(chunks: DataFrame, oversized: int = 500) -> DataFrame:
    """One row a document of tagged chunks (doc_id, content, header, tokens, term, is_boilerplate, is_duplicate, match_source, images, model, code, instructor)."""
    body = F.coalesce("content", F.lit(""))
    hidden = F.col("is_boilerplate") & T.course_signal(body).isNotNull()
    each = F.count_if
    return chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), each(F.col("tokens") > oversized).alias("n_oversized"), each(M.header_only(body)).alias("n_header_only"), each(F.coalesce(F.col("header") == "", F.lit(True))).alias("n_no_header"),
        each(F.col("term").isNull() | F.col("content").isNull()).alias("n_invalid"), each((F.col("tokens") > oversized) | F.coalesce(F.col("header") == "", F.lit(True)) | T.has_table(body)).alias("n_flagged"),
        F.sum(M.bare_images(body)).alias("n_bare_images"), F.sum(T.replacement_chars(body)).alias("n_replacement"), F.sum(F.size(F.filter(M.links(body), lambda x: M.is_garbled(x["label"])))).alias("n_garbled"),
        each("is_boilerplate").alias("n_boilerplate"), each("is_duplicate").alias("n_duplicate"), F.sum("images").alias("n_images"), each(hidden).alias("n_overhidden"), each(hidden & (F.col("match_source") == "header_anchored")).alias("n_overhidden_header"),
        each(F.col("is_duplicate") & T.protected_signal(body).isNotNull()).alias("n_dup_overhidden"), each(F.col("model").isNull() | (F.col("model") != "model-a")).alias("n_no_model"), F.count("model").alias("n_embedded"),
        each((F.trim(F.coalesce("code", F.lit(""))) != "") | (F.trim(F.coalesce("instructor", F.lit(""))) != "")).alias("n_identified"),
    )


def markdown_metrics(docs: DataFrame) -> DataFrame:
    """One row of each (doc_id, markdown)."""
    c = F.coalesce("markdown", F.lit(""))
    levels = F.transform(M.headings(c), lambda h: h["level"])
    rows = docs.select("doc_id", c.alias("c"), levels.alias("levels"))
    return rows.select(
        "doc_id", F.floor(F.length("c") / 4).cast("long").alias("n_tokens"), F.octet_length("c").alias("n_bytes"), F.size("levels").alias("n_headers"), F.size(F.array_distinct("levels")).alias("n_levels"),
        A.level_skips(F.col("levels")).alias("n_skips"), T.replacement_chars(F.col("c")).alias("n_replacement"), T.letter_drops(F.col("c")).alias("n_drops"),
    )


def table_metrics(tables: DataFrame) -> DataFrame:
    """One row a document of (doc_id, gfm, grid, partial, confidence, caption, described) tables: outcomes and damage."""
    each = F.count_if
    rows = tables.withColumn("judged", B.judged(F.col("gfm"), F.col("grid"), F.col("partial")))
    rows = rows.withColumns({"kept": F.col("judged.outcome"), "bad": F.col("judged.degenerate"), "short": F.col("judged.truncated")})
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_tables"), *[each(F.col("kept") == k).alias(f"n_{k}") for k in ("transcribed", "grid_fallback", "partial_kept", "lost")],
        each("bad").alias("n_degenerate"), each("short").alias("n_truncated"), F.sum(B.failure_markers(F.col("caption"))).alias("n_failure_markers"),
        each(F.col("described") & (F.col("confidence") < 0.5)).alias("n_low"), each("described").alias("n_described"), each(F.col("described") & F.col("confidence").isNull()).alias("n_invalid"), each(~F.col("described")).alias("n_undescribed"),
        F.avg(F.when(F.col("described"), F.col("confidence"))).alias("mean_confidence"),
    )
