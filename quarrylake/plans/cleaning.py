"""Clean-up, provenance and views of tagged chunks, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.functions import cleanup as K
from quarrylake.functions import courses
from quarrylake.functions import markdown as M
from quarrylake.functions import text as T
from quarrylake.operators import chunks as C
from quarrylake.operators import meetings
from quarrylake.plans.checks import markdown_view
from quarrylake.plans.scalars import _pick, _x
from quarrylake.plans.tables import table
from quarrylake.plans.views import BLOCKS, CHUNKS, MEETINGS, view

REGISTRY = {"university policies": "POLICY", "college of engineering": "MASTHEAD", "grading": "GRADING"}
SENTENCES = (r"The university views class attendance[^.]*\.", r"Please refer to Student Rule 7[^.]*\.")
_MD = _pick("'# Intro\nx\n## 2.1 University  Policies:\np\nq\n# Next\ny'", "'# Grading\nz'", "'no header\n# Grading\n# Kept\nw'")
_LINES = _pick("'# A\n\n# A\nx\n# A'", "'Credit Hours: 3\nx\nCredit Hours: 3'", "'a\n\n\n\nb\n<!-- image -->\n|  |'", "'# Course Syllabus\nx\n## course syllabus:\ny'")
_HEAD = _pick("'Notes:'", "'This material Is: Required'", "'1. The time'", "'9:35 -10:50 AM'", "'Room 2026'", "'All exams are closed'", "'An absence for illness'", "'Grading'")
_Q = _pick("'What is the grading policy?'", "'In CSCE 638, what is the policy?'", "'Which topics?'", "'THE EXAM: when is the exam?'")
_DATED = _pick("'on March 3, 2025 then'", "'due next Friday'", "'see 3/4/25'", "'on 2025-3-4'", "'T 10/6'", "'Lecture 12'", "'Homework #3 due'", "'Exam 3 is scheduled'", "'no date'")
CASES: list = [
    ("stripped", lambda: K.strip_sections(_x(_MD), REGISTRY)["text"], _pick("'# Intro' || chr(10) || 'x' || chr(10) || '# Next' || chr(10) || 'y'", "''", "'no header' || chr(10) || '# Kept' || chr(10) || 'w'")),
    ("n_stripped", lambda: K.strip_sections(_x(_MD), REGISTRY)["n"], _pick("1", "1", "1")),
    ("kind", lambda: K.header_class(_x(_pick("' University   Policies: '", "'6.1 GRADING'", "'Other'")), REGISTRY), _pick("'POLICY'", "'GRADING'", "NULL")),
    ("sentences", lambda: K.strip_sentences(_x("concat('A  b. The UNIVERSITY views class attendance as ', p_name, '. End')"), SENTENCES)["text"], "'A b. End'"),
    ("n_sentences", lambda: K.strip_sentences(_x("concat('please refer to Student Rule 7 now. ', p_name)"), SENTENCES)["n"], "1"),
    ("tidy", lambda: K.tidy_lines(_x(_LINES))["text"], _pick("'# A' || chr(10) || chr(10) || 'x' || chr(10) || '# A'", "'Credit Hours: 3' || chr(10) || 'x'", "'a' || chr(10) || chr(10) || chr(10) || 'b'", "'# Course Syllabus' || chr(10) || 'x' || chr(10) || 'y'")),
    ("n_tidied", lambda: K.tidy_lines(_x(_LINES))["n"], _pick("1", "1", "3", "1")),
    ("false_header", lambda: K.false_header(_x(_HEAD)), _pick("'exact_match'", "'prefix_match'", "'numbered_list_item'", "'time_string'", "'room_location'", "'policy_statement'", "'policy_statement'", "NULL")),
    ("transient", lambda: K.is_transient(_x(_DATED)), "p_partkey % 9 < 8"),
    ("one_course", lambda: K.is_one_course(_x(_pick("'a Discrepancy here'", "'one section vs another'", "'all fine'"))), "p_partkey % 3 < 2"),
    ("named", lambda: K.named_question(_x(_Q), _x(_pick("array('CSCE 1')", "array('CSCE 1', 'STAT 2')"))), "CASE p_partkey % 4 WHEN 0 THEN 'In CSCE 1, what is the grading policy?' WHEN 1 THEN 'In CSCE 638, what is the policy?' WHEN 2 THEN 'Which topics?' ELSE 'THE EXAM: when is the exam?' END"),
    ("themes", lambda: F.array_join(K.without_themes(_x("array(p_name, 'Academic Integrity now', 'ADA')"), ("academic integrity", "ada")), "|"), "p_name"),
]


def cleanup_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", *[make().alias(name) for name, make, _ in CASES])


def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the documents, which have no headings: each is one section, split at lines where it is too long only if something is above it."""
    found = C.chunk(table(spark, sf_dir, "documents"), C.semantic)
    return found.select("doc_id", "idx", F.md5("content").alias("digest"), "header_path", "token_count", F.array_join("flags", ",").alias("flags"))


def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size-capped chunks of the documents' markdown form."""
    return C.chunk(markdown_view(table(spark, sf_dir, "documents")), C.capped, text="markdown").select("doc_id", "idx", "header_path", "token_count", "has_table", "reason", F.md5("content").alias("digest"))


def overlap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equalised chunks with overlap."""
    return C.chunk(table(spark, sf_dir, "documents"), C.overlapped).select("doc_id", "idx", "token_count", F.md5("content").alias("digest"))


def fixed_token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows that end at white space."""
    return C.chunk(table(spark, sf_dir, "documents"), C.fixed).select("doc_id", "idx", "token_count", F.md5("content").alias("digest"))


def visible_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that search may see, in their canonical columns: neither boilerplate nor duplicate, a null flag keeps its row."""
    rows = view(spark, sf_dir, CHUNKS)
    shown = rows.filter(~F.col("is_boilerplate").eqNullSafe(True) & ~F.col("is_duplicate").eqNullSafe(True))
    return shown.select("doc_id", "idx", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("term", F.lit("?")).alias("term"), T.has_table(F.col("content")).alias("has_table"), F.coalesce("model", F.lit("none")).alias("model"), F.lit("v4").alias("version"))


def hidden_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that are hidden, why, and how they begin."""
    rows = view(spark, sf_dir, CHUNKS).withColumn("reason", courses.drop_reason(F.col("is_boilerplate"), F.col("is_duplicate")))
    return rows.filter("reason IS NOT NULL").select("doc_id", "idx", "reason", "header", F.substring(F.trim("content"), 1, 20).alias("preview"))


def processed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put together from the chunks that are kept, each behind its mark."""
    rows = view(spark, sf_dir, CHUNKS).filter(courses.drop_reason(F.col("is_boilerplate"), F.col("is_duplicate")).isNull())
    mark = F.concat(F.lit("<!-- chunk "), F.col("idx").cast("string"), F.lit(" | "), "header", F.lit(" | "), F.col("tokens").cast("string"), F.lit(" tok -->\n\n"), F.trim("content"))
    return rows.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", mark.alias("m")))), lambda x: x["m"]), "\n\n")).alias("digest"))


def anchor_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and shares of each document's chunks: kept, hidden, without a header, oversized, largest."""
    n = F.count(F.lit(1))
    bp, dup = F.count_if("is_boilerplate"), F.count_if(~F.col("is_boilerplate") & F.col("is_duplicate"))
    return view(spark, sf_dir, CHUNKS).groupBy("doc_id").agg(n.alias("n"), (n - bp - dup).alias("n_kept"), bp.alias("n_boilerplate"), dup.alias("n_duplicate"), F.count_if(F.col("header") == "").alias("n_no_header"), F.count_if(F.col("tokens") > 1500).alias("n_oversized"), F.max("tokens").alias("max_tokens"), (bp / n).alias("boilerplate_rate"))


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document from its first chunk, nulls defaulted."""
    rows = view(spark, sf_dir, CHUNKS)
    return rows.groupBy("doc_id").agg(F.min_by("content", "idx").alias("title"), F.coalesce(F.min_by(F.coalesce("term", F.lit("?")), "idx"), F.lit("?")).alias("term"))


def _key(c: Column) -> Column:
    return F.lower(T.collapse(F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), r"[*_`#]", "")))


def aligned_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunk of its document that holds each block's text, else its first 40 characters (of 12 at least): blocks meet the chunks of their document."""
    key = _key(F.when(F.col("kind").isin("text", "heading"), F.col("text")).otherwise(F.col("caption")))
    blocks = view(spark, sf_dir, BLOCKS).select("doc_id", "ord", key.alias("key")).filter("key != ''")
    held = view(spark, sf_dir, BLOCKS).filter("survives").select("doc_id", F.floor(F.col("ord") / 3).cast("int").alias("chunk"), F.struct("ord", "text").alias("part"))
    # a chunk is three blocks at most
    texts = held.groupBy("doc_id", "chunk").agg(_key(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["text"]), " ")).alias("content"))
    met = blocks.join(texts, "doc_id")
    head = F.substring("key", 1, 40)
    whole = F.min(F.when(F.contains("content", F.col("key")), F.col("chunk")))
    part = F.min(F.when((F.length(head) >= 12) & F.contains("content", head), F.col("chunk")))
    return met.groupBy("doc_id", "ord").agg(F.coalesce(whole, part).alias("chunk")).filter("chunk IS NOT NULL")


def sidecar_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of markdown documents with the page their layout tells (the first of equal texts); null where it tells none."""
    heads = markdown_view(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(M.headings(F.col("markdown"))).alias("ord", "h"))
    keyed = heads.select("doc_id", "ord", F.col("h.level").alias("level"), T.normalize_header(F.col("h.text")).alias("key"))
    layout = keyed.filter("ord % 3 <> 1 AND key <> ''").groupBy("doc_id", "key").agg(F.min("ord").alias("page"))
    return keyed.join(layout, ["doc_id", "key"], "left").select("doc_id", "ord", "level", "page")


def two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with the first row that each of two sources has for them."""
    rows = table(spark, sf_dir, "events").filter("event_type IN ('click', 'view')")
    first = lambda s: F.min(F.when(F.col("event_type") == s, F.col("event_id"))).alias(s)
    return rows.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(first("click"), first("view"))


def stage_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row an order from its stages' tables: order, lines, customer; what a stage lacks is null."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(lines, "o_orderkey", "left").join(customer, "o_custkey", "left")


def context_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of the documents that hold each benchmark item's beginning: distinct and sorted. Texts meet by their first three words."""
    gram = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, 3), " ")))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.substring(T.normalize_text(F.col("text")), 1, 100).alias("head")).filter(F.size(T.words(F.col("head"))) >= 4)
    items = items.select("item_id", "head", F.get(gram(T.words(F.col("head"))), F.lit(0)).alias("key"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", T.normalize_text(F.col("text")).alias("norm")).filter("norm IS NOT NULL")
    once = docs.select("doc_id", F.explode(F.array(T.words(F.col("norm")))).alias("w"))
    met = once.select("doc_id", F.explode(F.array_distinct(gram(F.col("w")))).alias("key")).join(items, "key").select("item_id", "head", "doc_id")
    found = met.join(docs, "doc_id").filter(F.contains(F.col("norm"), F.col("head")))
    return found.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))  # a set of sources


def used_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of sources that a seed used, marked, their text left out."""
    used = table(spark, sf_dir, "labels").filter("toxic = 1").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("source", F.lit(True).alias("used")).distinct()
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("size")).join(used, "source", "left")
    return rows.select("doc_id", F.coalesce("used", F.lit(False)).alias("used"), F.when(F.col("used"), 0).otherwise(F.col("size")).alias("size"))


def meeting_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of course information with the meeting days that lines around them tell."""
    return meetings.fill_days(view(spark, sf_dir, MEETINGS)).filter(F.col("filled").isNotNull())


QUERIES = {
    f.__name__: f
    for f in (
        meeting_days, cleanup_functions, section_chunks, markdown_chunks, overlap_chunks, fixed_token_chunks, visible_chunks, hidden_chunks, processed_documents, anchor_rates, document_rows, aligned_blocks, sidecar_headers, two_sources, stage_wide,
        context_courses, used_rows,
    )
}

_C = f"c AS ({CHUNKS})"
_KEY = "lower(trim(regexp_replace(regexp_replace({0}, '[*_`#]', '', 'g'), '\\s+', ' ', 'g')))"
_NORM_X = "trim(regexp_replace(translate(lower({0}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), '\\s+', ' ', 'g'))"
_DAYS = ", ".join(f"'{d}'" for d in meetings.DAYS)
_FRAME = "OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN {0} AND {1})"
_AROUND = _FRAME.format(f"{meetings.AROUND} PRECEDING", f"{meetings.AROUND} FOLLOWING")
ORACLES = {
    "meeting_days": f"""WITH v AS ({MEETINGS.replace(" div ", " // ")}), l AS (SELECT doc_id, idx, trim(line) AS t, lower(trim(line)) AS low FROM v),
x AS (SELECT *, (low LIKE 'meeting location:%online%') OR (regexp_matches(low, '^online(\\s+online)*$') AND length(t) < 40) AS onl, low LIKE 'start time:%' AND trim(substr(low, 12)) IN ('', 'n/a', 'na', 'none') AS untimed,
  regexp_extract(t, '{meetings.DAYS_TIME}', 1) AS d, regexp_matches(t, '{meetings.LABEL_AS_VALUE}') AS label FROM l),
y AS (SELECT *, CASE WHEN d IN ({_DAYS}) THEN d END AS days FROM x),
w AS (SELECT *, bool_or(onl) {_AROUND} AS o, bool_or(untimed) {_AROUND} AS u, arg_min(days, idx) FILTER (days IS NOT NULL AND NOT label) {_FRAME.format(f"{meetings.AROUND} PRECEDING", "CURRENT ROW")} AS before,
  arg_min(days, idx) FILTER (days IS NOT NULL) {_FRAME.format("1 FOLLOWING", f"{meetings.AROUND} FOLLOWING")} AS later FROM y),
f AS (SELECT *, coalesce(before, later) AS found, label OR t = 'Meeting Days:' AS empty FROM w)
SELECT doc_id, idx, 'Meeting Days:' || CASE WHEN o AND u THEN ' Asynchronous' WHEN found IS NOT NULL THEN ' ' || found ELSE '' END AS line, CASE WHEN o AND u THEN 'asynchronous' WHEN found IS NOT NULL THEN 'parsed' ELSE 'collision' END AS filled
FROM f WHERE empty AND (o AND u OR found IS NOT NULL OR label)""",
    "cleanup_functions": "SELECT p_partkey, " + ", ".join(f"{sql} AS {name}" for name, _, sql in CASES) + " FROM part",
    "section_chunks": r"""WITH d AS (SELECT doc_id, trim(text, chr(10) || ' ') AS t FROM documents WHERE text IS NOT NULL), e AS (SELECT *, round_even(length(t) / 4.0, 0)::INTEGER AS n FROM d)
SELECT doc_id, 0 AS idx, md5(t) AS digest, '' AS header_path, n AS token_count, CASE WHEN n > 500 THEN 'OVERSIZED,' ELSE '' END || CASE WHEN regexp_matches(t, '\|.*\|') THEN 'HAS_TABLE,' ELSE '' END || 'NO_HEADER' AS flags FROM e WHERE n >= 15""",
    "visible_chunks": rf"WITH {_C} SELECT doc_id, idx, content, coalesce(term, '?') AS term, regexp_matches(content, '\|.*\|') AS has_table, coalesce(model, 'none') AS model, 'v4' AS version FROM c WHERE NOT is_boilerplate AND NOT is_duplicate",
    "hidden_chunks": f"WITH {_C} SELECT doc_id, idx, CASE WHEN is_boilerplate THEN 'boilerplate' ELSE 'duplicate' END AS reason, header, left(trim(content), 20) AS preview FROM c WHERE is_boilerplate OR is_duplicate",
    "processed_documents": f"WITH {_C} SELECT doc_id, md5(string_agg('<!-- chunk ' || idx || ' | ' || header || ' | ' || tokens || ' tok -->' || chr(10) || chr(10) || trim(content), chr(10) || chr(10) ORDER BY idx)) AS digest FROM c WHERE NOT is_boilerplate AND NOT is_duplicate GROUP BY doc_id",
    "anchor_rates": f"WITH {_C} SELECT doc_id, count(*) AS n, count(*) FILTER (NOT is_boilerplate AND NOT is_duplicate) AS n_kept, count(*) FILTER (is_boilerplate) AS n_boilerplate, count(*) FILTER (is_duplicate AND NOT is_boilerplate) AS n_duplicate, count(*) FILTER (header = '') AS n_no_header, count(*) FILTER (tokens > 1500) AS n_oversized, max(tokens) AS max_tokens, count(*) FILTER (is_boilerplate) / count(*) AS boilerplate_rate FROM c GROUP BY doc_id",
    "document_rows": f"WITH {_C} SELECT doc_id, content AS title, coalesce(term, '?') AS term FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY idx) = 1",
    "aligned_blocks": f"""WITH v AS ({BLOCKS}), b AS (SELECT doc_id, ord, {_KEY.format("CASE WHEN kind IN ('text', 'heading') THEN text ELSE caption END")} AS key FROM v), t AS (SELECT doc_id, (ord // 3)::INTEGER AS chunk, {_KEY.format("string_agg(text, ' ' ORDER BY ord)")} AS content FROM v WHERE survives GROUP BY ALL),
m AS (SELECT doc_id, ord, coalesce(min(chunk) FILTER (contains(content, key)), min(chunk) FILTER (length(left(key, 40)) >= 12 AND contains(content, left(key, 40)))) AS chunk FROM b JOIN t USING (doc_id) WHERE key <> '' GROUP BY ALL) SELECT * FROM m WHERE chunk IS NOT NULL""",
    "sidecar_headers": f"""WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN len(string_split(x, ' ')) <= 2 THEN repeat('#', 1 + length(x) % 3) || ' ' || x ELSE x END), lambda x: regexp_matches(x, '^#{{1,6}}\\s')) AS l FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INTEGER AS ord, unnest(l) AS x FROM d), k AS (SELECT doc_id, ord, length(regexp_extract(x, '^#+'))::INTEGER AS level, {_NORM_X.format("x")} AS key FROM h), y AS (SELECT doc_id, key, min(ord) AS page FROM k WHERE ord % 3 <> 1 AND key <> '' GROUP BY ALL)
SELECT doc_id, ord, level, page FROM k LEFT JOIN y USING (doc_id, key)""",
    "two_sources": "SELECT user_id, ts::DATE::VARCHAR AS day, min(event_id) FILTER (event_type = 'click') AS click, min(event_id) FILTER (event_type = 'view') AS \"view\" FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL",
    "stage_wide": "WITH l AS (SELECT l_orderkey AS o_orderkey, count(*) AS n_lines, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM lineitem GROUP BY 1) SELECT o_orderkey, o_custkey, o_orderstatus, n_lines, quantity, c_mktsegment FROM orders LEFT JOIN l USING (o_orderkey) LEFT JOIN customer ON c_custkey = o_custkey",
    "context_courses": f"WITH b AS (SELECT item_id, left({_NORM_X.format('text')}, 100) AS head FROM benchmark), d AS (SELECT source, {_NORM_X.format('text')} AS norm FROM documents), f AS (SELECT DISTINCT item_id, source FROM b JOIN d ON contains(norm, head) WHERE len(list_filter(string_split(head, ' '), lambda w: w <> '')) >= 4) SELECT item_id, string_agg(source, ',' ORDER BY source) AS sources FROM f GROUP BY item_id",
    "used_rows": "WITH u AS (SELECT DISTINCT source FROM labels JOIN documents USING (doc_id) WHERE toxic = 1) SELECT doc_id, source IN (FROM u) AS used, CASE WHEN source IN (FROM u) THEN 0 ELSE length(text) END::INTEGER AS size FROM documents",
}
