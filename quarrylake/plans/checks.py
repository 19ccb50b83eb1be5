"""Quality checks over blocks, chunks, markdown and tables of documents, by the registry in operators.checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.functions import markdown as M
from quarrylake.functions import tables as B
from quarrylake.functions.arrays import let
from quarrylake.operators import checks as C
from quarrylake.operators.checks import Check
from quarrylake.plans.tables import table
from quarrylake.plans.views import BLOCKS, CHUNKS, GRADES, MODAL, view

ERROR = {"severity": "ERROR", "blocking": True}
BLOCK_CHECKS = [
    Check("v6b_bronze_blocks_nonempty", "n_blocks > 0", "n_blocks", **ERROR),
    Check("v6b_bronze_blocks_has_text", "n_text >= 5", "n_text"),
    Check("v6b_bronze_blocks_no_replacement_chars", "n_replacement = 0", "n_replacement", **ERROR),
    Check("v6b_bronze_blocks_header_hierarchy_valid", "n_skips = 0", "n_skips"),
    Check("v6b_bronze_blocks_header_levels_normalized", "true", "n_raw_skips"),
    Check("v6b_bronze_blocks_min_headers", "n_headings >= 2 AND (n_pages <= 1 OR n_levels >= 2)", "n_headings"),
    Check("v6b_bronze_blocks_text_coverage", "100 * n_lost_tokens <= 5 * n_tokens", "n_lost_tokens"),
    Check("v6b_bronze_blocks_table_cell_capture", "10 * n_lost_table_tokens <= n_table_tokens", "n_lost_table_tokens"),
    Check("v6b_bronze_blocks_no_orphaned_labels", "n_unanswered = 0", "n_unanswered"),
    Check("v6b_bronze_blocks_no_fabricated_links", "n_fabricated = 0", "n_fabricated"),
    Check("v6b_bronze_blocks_suspicious_heading_rate", "100 * n_suspicious <= 15 * n_headings", "n_suspicious"),
    Check("v6b_bronze_blocks_no_content_image_lost", "n_content_images = 0", "n_content_images"),
    Check("v6b_bronze_blocks_no_ocr_failure_page", "n_ocr = 0", "n_ocr"),
    Check("v6b_bronze_blocks_low_ligature_damage", "n_ligature <= 2", "n_ligature"),
    Check("v6b_bronze_blocks_source_integrity", "n_pages > 0 AND n_chars >= 50 * n_pages", "n_chars"),
    Check("v6b_silver_chunk_view_text_coverage", "10 * n_lost_tokens <= n_tokens", "n_lost_tokens"),
    Check("v6b_silver_chunk_tables_survive_view", "n_gone_tables = 0", "n_gone_tables"),
    Check("v6b_silver_chunk_no_garbled_anchors", "n_garbled = 0", "n_garbled"),
]
CHUNK_CHECKS = [
    Check("v6b_silver_chunk_count_nonzero", "n > 0", "n", **ERROR),
    Check("v6b_silver_chunk_no_oversized", "n_oversized = 0", "n_oversized"),
    Check("v6b_silver_chunk_low_no_header_rate", "10 * n_no_header <= n", "n_no_header", **ERROR),
    Check("v6b_silver_chunk_no_header_only", "n_header_only = 0", "n_header_only"),
    Check("v6b_silver_chunk_schema_valid", "n_invalid = 0", "n_invalid", **ERROR),
    Check("v6b_silver_chunk_no_bare_image_markers", "n_bare_images = 0", "n_bare_images"),
    Check("v6b_silver_chunk_no_replacement_chars", "n_replacement = 0", "n_replacement"),
    Check("silver_image_recovery_no_hallucination", "n_bare_images <= n_images", "n_bare_images"),
    Check("v6b_silver_tag_chunk_count_preserved", "n = n_in", "n", **ERROR),
    Check("v6b_silver_tag_boilerplate_rate_in_band", "n > 0 AND 100 * n_boilerplate BETWEEN 35 * n AND 65 * n", "n_boilerplate"),
    Check("v6b_silver_tag_no_boilerplate_overhide", "n_overhidden = 0", "n_overhidden"),
    Check("v6b_silver_tag_no_duplicate_overhide", "n_dup_overhidden = 0", "n_dup_overhidden"),
    Check("v6b_silver_tag_duplicate_rate_in_band", "5 * n_duplicate <= n", "n_duplicate"),
    Check("v6b_silver_embed_count_matches_chunks", "n_embedded = n", "n_embedded", **ERROR),
    Check("v6b_silver_embed_model_field_present", "n_no_model = 0", "n_no_model", **ERROR),
    Check("v6b_silver_structured_not_degenerate", "n_identified = n", "n_identified"),
]
MARKDOWN_CHECKS = [
    Check("bronze_markdown_min_tokens", "n_tokens >= 800", "n_tokens", **ERROR),
    Check("bronze_markdown_min_headers", "n_headers >= 3", "n_headers"),
    Check("bronze_markdown_no_replacement_chars", "n_replacement = 0", "n_replacement"),
    Check("bronze_headers_sidecar_nonempty", "n_headers >= 1", "n_headers", **ERROR),
    Check("v6c_bronze_markdown_nonempty", "n_bytes >= 500", "n_bytes", **ERROR),
    Check("v6c_bronze_markdown_no_replacement_chars", "n_replacement = 0", "n_replacement", **ERROR),
    Check("v6c_bronze_markdown_no_letter_drops", "n_drops = 0", "n_drops", **ERROR),
    Check("v6c_bronze_markdown_min_headers", "n_headers >= 2", "n_headers", **ERROR),
    Check("v6c_bronze_sidecar_nonempty", "n_headers > 0", "n_headers", **ERROR),
    Check("v6c_bronze_sidecar_hierarchy_valid", "n_skips = 0", "n_skips", **ERROR),
]
TABLE_CHECKS = [
    Check("v6b_silver_modal_budget_not_exceeded", "n_undescribed = 0", "n_undescribed"),
    Check("v6b_silver_modal_result_schema_valid", "n_invalid = 0", "n_invalid", **ERROR),
    Check("v6b_silver_modal_no_table_lost", "n_lost = 0", "n_lost"),
    Check("v6b_silver_modal_no_degenerate_tables", "n_degenerate = 0", "n_degenerate"),
    Check("v6b_silver_modal_no_truncated_output", "n_truncated = 0", "n_truncated"),
    Check("v6b_silver_modal_no_failure_markers", "n_failure_markers = 0", "n_failure_markers"),
    Check("v6b_silver_modal_confidence_floor", "4 * n_low <= n_described", "n_low"),
]
#: Checks against a baseline: series value over metrics, and the drift allowed.
DRIFTS = [
    ("v6b_bronze_blocks_block_count_vs_baseline", "n_blocks", 0.2),
    ("v6b_bronze_blocks_heading_repair_vs_baseline", "n_raw_skips", 0.2),
    ("v6b_silver_chunk_total_vs_baseline", "n_text", 0.2),
    ("v6b_silver_chunk_flagged_rate_vs_baseline", "n_labels * 1000 div n_blocks", 0.2),
    ("v6b_silver_modal_quality_vs_baseline", "n_tokens * 100 div n_blocks", 0.15),
    ("v6c_bronze_markdown_token_count_vs_baseline", "n_chars div 4", 0.2),
    ("v6c_bronze_markdown_letter_drops_vs_baseline", "n_drops", 0.5),
    ("v6c_bronze_sidecar_header_count_vs_baseline", "n_headings", 0.2),
]


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.block_metrics(view(spark, sf_dir, BLOCKS))


def block_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checks of blocks rest on, and counts that no check reads."""
    return _blocks(spark, sf_dir).select("doc_id", *[F.col(c).cast("long").alias(c) for c in _BLOCK_COLUMNS])


def checks_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.evaluate(_blocks(spark, sf_dir), BLOCK_CHECKS)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_in"))
    return C.chunk_metrics(view(spark, sf_dir, CHUNKS)).join(before, "doc_id")


def checks_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.evaluate(_chunks(spark, sf_dir), CHUNK_CHECKS)


def checks_failed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message for each blocking check of chunks that failed."""
    return C.alert(checks_chunks(spark, sf_dir).filter("NOT passed AND blocking"))


def markdown_view(docs: DataFrame) -> DataFrame:
    """(doc_id, markdown): lines of one or two words are headings, of a level by their length."""
    words = lambda x: F.size(F.split(x, " "))
    line = lambda x: F.when(words(x) <= 2, F.concat(F.repeat(F.lit("#"), (1 + F.length(x) % 3).cast("int")), F.lit(" "), x)).otherwise(x)
    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n\n").alias("markdown"))


def checks_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.evaluate(C.markdown_metrics(markdown_view(table(spark, sf_dir, "documents"))), MARKDOWN_CHECKS)


def tables_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as text and as grid: n rows of two cells under a header."""
    cell = F.when(F.col("empty_cells"), "").otherwise("alpha")
    count = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.col(n), F.lit(1)).cast("int")), lambda i: i)
    row = lambda i: F.concat(F.lit("| "), cell, F.lit(" | "), cell, F.lit(" |"))
    lines = F.concat(F.array(F.lit("| name | value |"), F.lit("| --- | --- |")), F.transform(count("n_text"), row))
    grid = F.concat(F.array(F.array(F.lit("name"), F.lit("value"))), F.transform(count("n_grid"), lambda i: F.array(F.lit("alpha"), F.lit("alpha"))))
    return view(spark, sf_dir, MODAL).select(
        "doc_id", "ord", F.when(F.col("n_text") > 0, F.array_join(lines, "\n")).alias("gfm"), F.when(F.col("n_grid") > 0, grid).alias("grid"),
        F.when(F.col("partial"), F.lit("| a | b |\n| c | d |")).alias("partial"), "confidence", F.when(F.col("failed"), F.lit("[table processing failed: x]")).otherwise("a caption").alias("caption"), "described",
    )


def checks_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lost table makes a failure marker an error."""
    metrics = C.table_metrics(tables_view(spark, sf_dir))
    told = C.evaluate(metrics, TABLE_CHECKS).join(metrics.select("doc_id", "n_lost"), "doc_id")
    worse = (F.col("check_name") == "v6b_silver_modal_no_failure_markers") & (F.col("n_lost") > 0)
    return told.withColumn("severity", F.when(worse, "ERROR").otherwise(F.col("severity"))).drop("n_lost")


def table_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of each document's tables, share transcribed and mean confidence."""
    m = C.table_metrics(tables_view(spark, sf_dir))
    return m.select("doc_id", "n_tables", "n_transcribed", "n_grid_fallback", "n_partial_kept", "n_lost", "n_degenerate", "n_truncated", (F.col("n_transcribed") / F.col("n_tables")).alias("transcribed_share"), F.round("mean_confidence", 6).alias("mean_confidence"))


def table_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, empty cells and rendered form of each table."""
    gfm, kept = F.coalesce("gfm", F.lit("")), F.col("judged.outcome")
    told = tables_view(spark, sf_dir).withColumn("judged", B.judged(F.col("gfm"), F.col("grid"), F.col("partial")))
    return told.select(
        "doc_id", "ord", F.col("judged.n_rows").alias("n_rows"), B.empty_ratio(gfm).alias("empty_ratio"), B.longest_empty(gfm).alias("empty_run"), F.col("judged.degenerate").alias("degenerate"),
        B.looks_like_table(gfm).alias("tabular"), F.md5(B.to_gfm(F.col("grid"))).alias("grid_md5"), kept.alias("outcome"), F.md5(B.body(kept, F.col("gfm"), F.col("grid"), F.col("partial"))).alias("body_md5"),
    )


def grading_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grading tables of documents: weights, their sum, and whether it misses 100 by five or more."""
    rows = view(spark, sf_dir, GRADES)
    line = F.concat(F.lit("| item "), F.col("l_partkey").cast("string"), F.lit(" | "), F.col("weight").cast("string"), F.lit("% (5% each) |"))
    body = F.array_join(F.sort_array(F.collect_list(F.struct("ord", line.alias("line"))))["line"], "\n")
    found = B.weights(F.lit("Grading"), F.concat(F.lit("Weights below\n| item | weight |\n| --- | --- |\n"), body, F.lit("\nend")))
    told = let(found, lambda w: let(B.weight_sum(w), lambda total: F.struct(F.size(w).alias("n_rows"), total.alias("weight_sum"), (F.abs(total - 100) < 5).alias("passed"))))
    return rows.groupBy("doc_id").agg(told.alias("told")).filter("told.n_rows > 0").select("doc_id", "told.*")


def checks_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders are runs: each metric against the median of up to five runs before."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey", "o_orderdate")
    told = F.array(*[F.struct(F.lit(n).alias("check_name"), F.expr(v).cast("double").alias("value"), F.lit(d).alias("most")) for n, v, d in DRIFTS])
    series = _blocks(spark, sf_dir).join(runs, "doc_id").select("doc_id", "o_custkey", "o_orderdate", F.explode(told).alias("c")).select("doc_id", "o_custkey", "o_orderdate", "c.*")
    out = C.drift(series, ["o_custkey", "check_name"], ["o_orderdate", "doc_id"], "value", F.col("most"))
    return out.select("doc_id", "check_name", (~F.col("drifted")).alias("passed"), "value", "n_history", C.describe_drift(F.col("value").cast("long"), F.floor("base").cast("long"), F.col("n_history"), F.col("most")).alias("told"))


_BLOCK_COLUMNS = "n_blocks n_text n_headings n_levels n_pages n_skips n_raw_skips n_replacement n_drops n_ligature n_suspicious n_labels n_unanswered n_content_images n_ocr n_chars n_garbled n_links n_fabricated n_tokens n_lost_tokens n_table_tokens n_lost_table_tokens n_gone_tables".split()
QUERIES = {f.__name__: f for f in (block_metrics, checks_blocks, checks_chunks, checks_failed_messages, checks_markdown, checks_tables, table_outcomes, table_shapes, grading_weights, checks_drift)}


def _told(checks: list[Check]) -> str:
    """DuckDB text of ``evaluate`` over a table m."""
    each = ", ".join(f"{{'check_name': '{c.name}', 'passed': coalesce(({c.passed}), false), 'value': ({c.value})::DOUBLE, 'severity': '{c.severity}', 'blocking': {str(c.blocking).lower()}}}" for c in checks)
    return f"SELECT doc_id, c.check_name, c.passed, c.value, c.severity, c.blocking FROM (SELECT doc_id, unnest([{each}]) AS c FROM m)"


_LINK = M.LINK
_TOKENS = "list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9./:@_+#-]{3,}'), lambda t: regexp_replace(lower(t), '^[./:-]+|[./:-]+$', '', 'g')), lambda t: length(t) >= 4)"
_WORDS = "len(string_split_regex(trim(text), '\\s+'))"
_FIELD = M.FIELD.replace("'", "''")
_LABELS = f"regexp_extract_all(text, '{_LINK}', 1)"
_GARBLED = f"len(list_filter({_LABELS}, lambda l: NOT regexp_matches(l, '{M.AUTOLINK}') AND (regexp_matches(l, '[.!?]\\s+[a-z]') OR (regexp_matches(l, '^[a-z]') AND len(string_split_regex(l, '\\s+')) >= 4) OR length(l) - length(replace(l, '(', '')) <> length(l) - length(replace(l, ')', '')))))"
_COUNT = lambda c, n: f"count(*) FILTER ({c}) AS {n}"
_DROPS = r"len(regexp_extract_all(text, '\b(?:Colege|Sylabus|Meting|Aditional|Textbok|wil|fal|instaling)\b'))"
_FLAT = lambda x: f"list_distinct(flatten(list({x})))"
_BLOCK_M = rf"""v AS ({BLOCKS}),
h AS (SELECT doc_id, ord, level > lag(level) OVER w + 1 AS s, raw_level > lag(raw_level) OVER w + 1 AS rs FROM v WHERE kind = 'heading' WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
nx AS (SELECT doc_id, ord, lead(page) OVER w AS np, lead(kind) OVER w AS nk, trim(lead(text) OVER w) AS nt FROM v WHERE kind IN ('text', 'heading') WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
b AS (SELECT v.*, h.s, h.rs, kind = 'text' AND trim(text) LIKE '%:' AND length(trim(text)) BETWEEN 3 AND 35 AND {_WORDS} <= 4 AS label, coalesce(np = page AND nk = 'text' AND nt <> '' AND nt NOT LIKE '%:', false) AS answered FROM v LEFT JOIN h USING (doc_id, ord) LEFT JOIN nx USING (doc_id, ord)),
pg AS (SELECT doc_id, page, coalesce(sum(length(text)) FILTER (kind IN ('text', 'heading')), 0) AS chars, coalesce(max(abs(x * y)) FILTER (kind = 'image'), 0) AS im, coalesce(bool_or(x * y = 0) FILTER (kind = 'image'), false) AS un FROM v GROUP BY ALL),
p AS (SELECT doc_id, count(*) AS n_pages, count(*) FILTER (chars < 50 AND (im >= 50000 OR un)) AS n_ocr FROM pg GROUP BY doc_id),
a AS (SELECT doc_id, count(*) AS n_blocks, {_COUNT("kind = 'text'", "n_text")}, {_COUNT("kind = 'heading'", "n_headings")}, count(DISTINCT level) FILTER (kind = 'heading') AS n_levels, {_COUNT("s", "n_skips")}, {_COUNT("rs", "n_raw_skips")},
  sum(length(text) - length(replace(text, '�', ''))) AS n_replacement, sum({_DROPS}) AS n_drops, sum(CASE WHEN text LIKE 'the ofce%' THEN 4 ELSE 0 END) AS n_ligature,
  {_COUNT(f"kind = 'heading' AND trim(text) <> '' AND (regexp_matches(trim(text), '{_FIELD}') OR {_WORDS} > 12 OR regexp_matches(trim(text), '[.!?]$'))", "n_suspicious")}, {_COUNT("label", "n_labels")}, {_COUNT("label AND NOT answered", "n_unanswered")},
  {_COUNT("kind = 'image' AND abs(x * y) >= 50000 AND caption = ''", "n_content_images")}, sum(length(text)) AS n_chars, sum({_GARBLED}) AS n_garbled,
  flatten(list(list_transform(regexp_extract_all(text, '{_LINK}', 2), lambda t: regexp_replace(regexp_replace(t, '^(?:mailto:|https?://)', ''), '/+$', '')))) AS targets, string_agg(regexp_replace(text, '{_LINK}', ' ', 'g'), chr(10)) AS plain,
  {_FLAT(_TOKENS)} AS src, {_FLAT(f"CASE WHEN survives THEN {_TOKENS} ELSE [] END")} AS kept, {_FLAT(f"CASE WHEN kind = 'table' THEN {_TOKENS} ELSE [] END")} AS it, {_FLAT(f"CASE WHEN kind = 'table' AND survives THEN {_TOKENS} ELSE [] END")} AS ikt,
  list(list_distinct({_TOKENS})) FILTER (kind = 'table') AS tbs FROM b GROUP BY doc_id),
m AS (SELECT a.*, n_pages, n_ocr, len(targets) AS n_links, len(list_filter(targets, lambda t: t <> '' AND contains(plain, t))) AS n_fabricated, len(src) AS n_tokens, len(list_filter(src, lambda t: NOT list_contains(kept, t))) AS n_lost_tokens,
  len(it) AS n_table_tokens, len(list_filter(it, lambda t: NOT list_contains(ikt, t))) AS n_lost_table_tokens, coalesce(len(list_filter(tbs, lambda t: len(t) >= 3 AND 2 * len(list_filter(t, lambda y: NOT list_contains(kept, y))) > len(t))), 0) AS n_gone_tables
  FROM a JOIN p USING (doc_id))"""
_SIGNAL = r"(regexp_matches(content, '\b\d{1,3}(?:\.\d+)?\s*%') OR content LIKE 'due by March%')"
_CHUNK_M = f"""m AS (SELECT doc_id, count(*) AS n, count(*) AS n_in, {_COUNT("tokens > 500", "n_oversized")}, {_COUNT("content LIKE '#%'", "n_header_only")}, {_COUNT("header = ''", "n_no_header")}, {_COUNT("term IS NULL", "n_invalid")},
  sum(CASE WHEN content LIKE '%<!-- image -->%' THEN 1 ELSE 0 END) AS n_bare_images, 0 AS n_replacement, {_COUNT("is_boilerplate", "n_boilerplate")}, {_COUNT("is_duplicate", "n_duplicate")}, sum(images) AS n_images,
  {_COUNT(f"is_boilerplate AND {_SIGNAL}", "n_overhidden")}, {_COUNT(f"is_duplicate AND ({_SIGNAL} OR content LIKE '%http%')", "n_dup_overhidden")}, {_COUNT("model IS NULL", "n_no_model")}, count(model) AS n_embedded, {_COUNT("trim(code) <> '' OR trim(instructor) <> ''", "n_identified")}
  FROM ({CHUNKS}) GROUP BY doc_id)"""
_MD_M = rf"""d AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: CASE WHEN len(string_split(x, ' ')) <= 2 THEN repeat('#', 1 + length(x) % 3) || ' ' || x ELSE x END) AS l FROM documents),
e AS (SELECT doc_id, coalesce(array_to_string(l, chr(10) || chr(10)), '') AS md, list_transform(list_filter(coalesce(l, []), lambda x: regexp_matches(x, '^#{{1,6}}\s')), lambda x: length(regexp_extract(x, '^#+'))) AS lv FROM d),
m AS (SELECT doc_id, length(md) // 4 AS n_tokens, octet_length(encode(md)) AS n_bytes, len(lv) AS n_headers, len(list_distinct(lv)) AS n_levels, len(list_filter(range(2, len(lv) + 1), lambda i: lv[i] > lv[i - 1] + 1)) AS n_skips,
  length(md) - length(replace(md, '�', '')) AS n_replacement, len(regexp_extract_all(md, '\b(?:Colege|Sylabus|Meting|Aditional|Textbok|wil|fal|instaling)\b')) AS n_drops FROM e)"""
#: What the numbers of a table lead to: rows of empty cells are degenerate from six cells on, as the header's two are filled.
_TABLE_T = f"""t AS (SELECT *, n_text > 0 AND empty_cells AND (2 * n_text >= 8 OR 2 * n_text > 0.6 * (2 * n_text + 2) AND 2 * n_text + 2 >= 6) AS bad FROM ({MODAL})),
u AS (SELECT *, CASE WHEN n_text > 0 AND NOT bad AND (n_grid = 0 OR n_text >= 0.8 * n_grid AND NOT empty_cells) THEN 'transcribed' WHEN n_grid > 0 THEN 'grid_fallback' WHEN n_text > 0 AND NOT bad THEN 'transcribed' WHEN partial THEN 'partial_kept' ELSE 'lost' END AS kept,
  n_text > 0 AND NOT bad AND n_grid > 0 AND n_text < 0.8 * n_grid AS short FROM t)"""
_TABLE_M = f"""{_TABLE_T},
m AS (SELECT doc_id, count(*) AS n_tables, {_COUNT("kept = 'transcribed'", "n_transcribed")}, {_COUNT("kept = 'grid_fallback'", "n_grid_fallback")}, {_COUNT("kept = 'partial_kept'", "n_partial_kept")}, {_COUNT("kept = 'lost'", "n_lost")}, {_COUNT("bad", "n_degenerate")}, {_COUNT("short", "n_truncated")},
  {_COUNT("failed", "n_failure_markers")}, {_COUNT("described AND confidence < 0.5", "n_low")}, {_COUNT("described", "n_described")}, 0 AS n_invalid, {_COUNT("NOT described", "n_undescribed")}, avg(confidence) FILTER (described) AS mean_confidence FROM u GROUP BY doc_id)"""
_GRID = "'| name | value |' || chr(10) || '| --- | --- |'"
_SHAPE = "'| ' || c || ' | ' || c || ' |'"

ORACLES = {
    "block_metrics": f"WITH {_BLOCK_M} SELECT doc_id, {', '.join(f'{c}::BIGINT AS {c}' for c in _BLOCK_COLUMNS)} FROM m",
    "checks_blocks": f"WITH {_BLOCK_M} {_told(BLOCK_CHECKS)}",
    "checks_chunks": f"WITH {_CHUNK_M} {_told(CHUNK_CHECKS)}",
    "checks_failed_messages": f"WITH {_CHUNK_M}, t AS ({_told(CHUNK_CHECKS)}) SELECT check_name, 'failures:' || chr(10) || string_agg('- ' || check_name || ' [' || doc_id || ']', chr(10) ORDER BY doc_id) AS message FROM t WHERE NOT passed AND blocking GROUP BY check_name",
    "checks_markdown": f"WITH {_MD_M} {_told(MARKDOWN_CHECKS)}",
    "checks_tables": f"WITH {_TABLE_M}, ct AS ({_told(TABLE_CHECKS)}) SELECT doc_id, check_name, passed, value, CASE WHEN check_name = 'v6b_silver_modal_no_failure_markers' AND n_lost > 0 THEN 'ERROR' ELSE severity END AS severity, blocking FROM ct JOIN m USING (doc_id)",
    "table_outcomes": f"WITH {_TABLE_M} SELECT doc_id, n_tables, n_transcribed, n_grid_fallback, n_partial_kept, n_lost, n_degenerate, n_truncated, n_transcribed / n_tables AS transcribed_share, round(mean_confidence, 6) AS mean_confidence FROM m",
    "table_shapes": f"""WITH {_TABLE_T}, c AS (SELECT *, CASE WHEN empty_cells THEN '' ELSE 'alpha' END AS c FROM u),
s AS (SELECT *, CASE WHEN n_text > 0 THEN {_GRID} || repeat(chr(10) || {_SHAPE}, n_text::INTEGER) ELSE '' END AS gfm, CASE WHEN n_grid > 0 THEN {_GRID} || repeat(chr(10) || '| alpha | alpha |', n_grid::INTEGER) ELSE '' END AS grid FROM c)
SELECT doc_id, ord, n_text::INTEGER AS n_rows, CASE WHEN n_text > 0 AND empty_cells THEN (2 * n_text)::DOUBLE / (2 * n_text + 2) ELSE 0::DOUBLE END AS empty_ratio, CASE WHEN empty_cells THEN 2 * n_text ELSE 0 END::INTEGER AS empty_run, bad AS degenerate, n_text > 0 AS tabular, md5(grid) AS grid_md5, kept AS outcome,
  md5(CASE kept WHEN 'transcribed' THEN gfm WHEN 'grid_fallback' THEN grid WHEN 'partial_kept' THEN '| a | b |' || chr(10) || '| c | d |' ELSE '' END) AS body_md5 FROM s""",
    "grading_weights": f"SELECT doc_id, count(*)::INTEGER AS n_rows, sum(weight)::DOUBLE AS weight_sum, abs(sum(weight) - 100) < 5 AS passed FROM ({GRADES}) GROUP BY doc_id HAVING count(*) >= 3",
    "checks_drift": f"""WITH {_BLOCK_M}, r AS (SELECT doc_id, o_custkey, o_orderdate, unnest([{", ".join(f"{{'check_name': '{n}', 'value': ({v.replace(' div ', ' // ')})::DOUBLE, 'most': {d}::DOUBLE}}" for n, v, d in DRIFTS)}], recursive := true) FROM m JOIN orders ON doc_id = o_orderkey),
w AS (SELECT *, median(value) OVER x AS base, count(value) OVER x AS n_history FROM r WINDOW x AS (PARTITION BY o_custkey, check_name ORDER BY o_orderdate, doc_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, floor((value::BIGINT - floor(base)) / nullif(floor(base), 0) * 100 + 0.5)::BIGINT AS ch FROM w)
SELECT doc_id, check_name, NOT coalesce(base <> 0 AND abs((value - base) / base) > most, false) AS passed, value, n_history,
  CASE WHEN n_history = 0 THEN value::BIGINT || ' - no baseline yet (first run)' WHEN floor(base) = 0 THEN value::BIGINT || ' vs baseline 0 - delta undefined'
  ELSE value::BIGINT || ' vs baseline median ' || floor(base)::BIGINT || ' (' || CASE WHEN ch >= 0 THEN '+' ELSE '' END || ch || '%, allowed ' || round(most * 100)::INTEGER || '%, n=' || n_history || ')' END AS told FROM y""",
}
