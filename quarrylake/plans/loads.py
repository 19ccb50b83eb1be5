"""Loads of catalogue tables, run logs, file round trips, layout joins and admission, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.functions import courses as K
from quarrylake.functions import text as T
from quarrylake.operators import grids
from quarrylake.operators import layout as P
from quarrylake.operators import loads as L
from quarrylake.operators.admission import admit, released
from quarrylake.operators.graph import scratch
from quarrylake.plans.tables import table
from quarrylake.plans.views import LAYOUT, SECTIONS, TABLE_BLOCKS, TWO_GRIDS, view
from quarrylake.sources import files

PER_MINUTE, PER_SESSION = 30, 20


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SECTIONS)


def load_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first title of each course, the last prerequisites that are told."""
    return L.first_wins(_sections(spark, sf_dir).select("course", "seq", "title", "prerequisites"), ["course"], "seq", ["prerequisites"])


def load_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each course and type."""
    return L.last_wins(_sections(spark, sf_dir).select("course", "doc_type", "seq", "title", "crn"), ["course", "doc_type"], "seq")


def load_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each course and section, with the type it first had."""
    return L.last_wins(_sections(spark, sf_dir).select("course", "crn", "seq", "title", "doc_type"), ["course", "crn"], "seq", kept=("doc_type",))


def load_instructors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last address told of each name and department; an unknown department is one."""
    rows = _sections(spark, sf_dir).select(F.col("instructor"), F.coalesce("dept", F.lit(-1)).alias("dept"), "seq", "email")
    out = L.first_wins(rows, ["instructor", "dept"], "seq", ["email"])
    return out.select("instructor", F.when(F.col("dept") >= 0, F.col("dept")).alias("dept"), "email")


def load_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each section, with its instructor's key looked up by name and department, nulls equal."""
    rows = _sections(spark, sf_dir)
    known = rows.select("instructor", "dept").distinct().select("instructor", "dept", F.md5(F.concat_ws("|", "instructor", F.coalesce(F.col("dept").cast("string"), F.lit("?")))).alias("instructor_id"))
    return L.with_id(L.last_wins(rows.select("crn", "seq", "instructor", "dept", "title"), ["crn"], "seq"), known, ["instructor", "dept"], "instructor_id")


def load_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of each section, once each."""
    terms = K.topics(F.concat(F.lit("Topics:"), F.col("topics")))
    return _sections(spark, sf_dir).select("crn", F.explode(terms).alias("topic")).distinct()


def load_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies by the digest of their name, with their courses."""
    found = L.policies(_sections(spark, sf_dir), "policy", "course")
    return found.select("policy_id", F.size("members").alias("n_members"), F.array_min("members").alias("first_member"))


def load_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each load would write."""
    loads = {"courses": load_courses, "documents": load_documents, "chunks": load_chunks, "instructors": load_instructors, "sections": load_sections, "topics": load_topics, "policies": load_policies}
    out = None
    for name, load in loads.items():
        one = load(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("target"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def run_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with a column for each of two runs."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.length("text").alias("size"))
    results = lambda n: items.filter(F.col("item_id") % n == 0).select("item_id", (F.col("size") % n).alias("value"))
    return L.run_column(L.run_column(items, results(2), "run_a", "item_id"), results(3), "run_b", "item_id")


def structured_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child rows of nested section rows; blank elements go, ordinals stay."""
    nested = _sections(spark, sf_dir).select("seq", F.split("topics", ",").alias("a"), F.array("title", F.lit(" "), "prerequisites").alias("b"))
    parts = L.structured(nested, "seq", {"topics": "a", "notes": "b"})
    return parts["topics"].withColumn("child", F.lit("topics")).unionByName(parts["notes"].withColumn("child", F.lit("notes")))


def merged_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a course merged like pages of a document: first scalars that are there, all list items once in order."""
    parts = _sections(spark, sf_dir).select("course", "seq", "prerequisites", "email", F.split("topics", ",").alias("topics"))
    out = L.merged_extracts(parts, "course", "seq", ["prerequisites", "email"], ["topics"])
    return out.select("course", "prerequisites", "email", F.array_join("topics", "|").alias("topics"))


def numbered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation messages as questions: the first of each text that isn't empty, numbered."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.substring("text", 1, 12).alias("question"), "role")
    return L.numbered(rows, "question", "seq", T.is_empty_answer(F.col("question"))).select("seq", "question", F.col("number").cast("long").alias("number"))


def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files of chunks and scanned again: blank chunks go, places and file names stay."""
    place = scratch(spark, "chunk-files")
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("content")))
    files.write_chunks(table(spark, sf_dir, "documents").select(F.col("source").alias("stem"), "doc_id", lines.alias("chunks")), place)
    return files.chunks(spark, place).select("stem", "doc_id", "idx", F.md5("content").alias("digest"))


def structured_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON rows of events, some of them broken: those that parse, by type."""
    place = scratch(spark, "structured-files")
    broken = F.when(F.col("event_id") % 7 == 0, F.concat(F.substring("props", 1, 3), F.lit("oops"))).otherwise(F.col("props"))
    table(spark, sf_dir, "events").select(broken.alias("value")).write.text(place)
    return files.structured(spark, place, "k long").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step log written as CSV and read back: the latest version of each user, and how many there are."""
    place = scratch(spark, "step-log")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("stem"), F.concat(F.lit("v"), F.lpad((F.col("event_id") % 50).cast("string"), 3, "0")).alias("version"), F.col("event_id").alias("line"), "event_type")
    rows.write.option("header", True).csv(place)
    log = files.log(spark, place, "stem string, version string, line long, event_type string")
    every = files.versions(log, ["stem"], "version", "line")
    n = every.groupBy("stem").agg(F.count(F.lit(1)).alias("n_versions"))
    return files.latest(every, ["stem"], "version").join(n, "stem").select(F.col("stem").cast("long").alias("stem"), "version", "line", "event_type", "n_versions")


def layered_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders of logs, one file's latest row over both; of equal times the later folder's row."""
    places = [scratch(spark, "layer") for _ in range(2)]
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.to_date("ts").cast("string").alias("ts"), "event_id", "event_type")
    for i, place in enumerate(places):
        rows.filter(F.col("event_id") % 2 == i).write.option("header", True).csv(place)
    found = files.layered(spark, places, "file long, ts string, event_id long, event_type string", "file", "ts", "event_id")
    return found.select("file", "ts", "event_id", "layer")


def inside_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose centre lies in a table of their page."""
    rows = view(spark, sf_dir, LAYOUT)
    return P.inside(rows.filter("kind <> 'table'"), rows.filter("kind = 'table'")).select("doc_id", "ord")


def link_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each link's line belongs among the blocks of its page."""
    rows = view(spark, sf_dir, LAYOUT)
    links = rows.filter("kind = 'link'").select("doc_id", "page", F.col("ord").alias("link_id"), F.when(F.col("ord") % 4 > 0, F.col("y") * 3).alias("cy"), F.lit(520.0).alias("height"))
    return P.insertion_points(links, rows.filter("kind <> 'link'"))


def column_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at the right of each label."""
    return P.label_values(view(spark, sf_dir, LAYOUT))


def joined_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks after labels took their values in."""
    rows = view(spark, sf_dir, LAYOUT)
    return P.join_labels(rows, P.label_values(rows)).select("doc_id", "ord", "text", "recovered")


def header_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of headers, by their text with and without its number."""
    return P.page_lookup(view(spark, sf_dir, LAYOUT).select("doc_id", "ord", "page", F.concat((F.col("ord") % 3).cast("string"), F.lit(".1 "), "text").alias("text")))


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of their type's service and their user's session, a thousand times as dense."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e9
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("event_type").alias("service"), F.col("user_id").alias("session"), at.alias("at"))
    return admit(rows, PER_MINUTE, PER_SESSION)


def waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests behind a limiter that makes them wait."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e9)
    return released(table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("event_type").alias("service"), at.alias("at")), 5)


def budget_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that used four fifths of their budget or more."""
    used = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("used"))
    return used.withColumn("warn", F.col("used") >= 0.8 * PER_SESSION).select("user_id", "event_type", "used", F.greatest(PER_SESSION - F.col("used"), F.lit(0).cast("long")).alias("remaining"), "warn")


def merged_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of orders with the rows and cells that the second parser adds."""
    found = view(spark, sf_dir, TWO_GRIDS).withColumn("m", grids.merged(F.col("a"), F.col("b")))
    return found.select("doc_id", F.md5(F.array_join(F.flatten("m.grid"), "|")).alias("digest"), F.size("m.grid").alias("n_rows"), F.col("m.inserted").alias("inserted"), F.col("m.upgraded").alias("upgraded"))


def spliced_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as markdown, tables that went on after a page break in one piece."""
    return grids.markdown(view(spark, sf_dir, TABLE_BLOCKS)).select("doc_id", F.md5("text").alias("digest"), "n_joined", "n_rows")


QUERIES = {
    f.__name__: f
    for f in (
        load_courses, load_documents, load_chunks, load_instructors, load_sections, load_topics, load_policies, load_dry_run, run_columns, structured_rows, merged_extracts, numbered_items, chunk_files,
        structured_files, step_log, layered_logs, inside_tables, link_places, column_pairs, joined_labels, header_pages, admission, waiting, budget_warnings,
        merged_grids, spliced_markdown,
    )
}

_S = f"s AS ({SECTIONS})"
_TOP = "list_filter(list_transform(string_split(topics, ','), lambda t: trim(t)), lambda t: t <> '')"
_LOADS = {
    "load_courses": f"WITH {_S} SELECT course, arg_min(title, seq) AS title, arg_max(prerequisites, seq) FILTER (prerequisites IS NOT NULL) AS prerequisites FROM s GROUP BY course",
    "load_documents": f"WITH {_S} SELECT course, doc_type, title, crn FROM s QUALIFY row_number() OVER (PARTITION BY course, doc_type ORDER BY seq DESC) = 1",
    "load_chunks": f"WITH {_S} SELECT course, crn, arg_max(title, seq) AS title, arg_min(doc_type, seq) AS doc_type FROM s GROUP BY ALL",
    "load_instructors": f"WITH {_S} SELECT instructor, dept, arg_max(email, seq) FILTER (email IS NOT NULL) AS email FROM s GROUP BY ALL",
    "load_sections": f"WITH {_S} SELECT crn, instructor, dept, title, md5(instructor || '|' || coalesce(dept::VARCHAR, '?')) AS instructor_id FROM s QUALIFY row_number() OVER (PARTITION BY crn ORDER BY seq DESC) = 1",
    "load_topics": f"WITH {_S}, x AS (SELECT crn, unnest(list_filter({_TOP}, lambda t, i: NOT list_contains(list_transform({_TOP}[1:i - 1], lambda u: lower(u)), lower(t)))) AS topic FROM s) SELECT DISTINCT crn, topic FROM x",
    "load_policies": f"WITH {_S} SELECT sha256(lower(trim(policy))) AS policy_id, count(DISTINCT course)::INTEGER AS n_members, min(course) AS first_member FROM s GROUP BY 1",
}
_LAY = f"v AS ({LAYOUT})"
_PAIRS = "lb AS (SELECT doc_id, page, ord, x0, y, text FROM v WHERE text LIKE '%:'), lv AS (SELECT l.doc_id, l.page, l.text AS label, l.ord AS lo, arg_min(r.text, (r.x0 - l.x0) * 1000 + r.ord) AS value FROM lb l JOIN v r ON r.doc_id = l.doc_id AND r.page = l.page AND r.x0 > l.x0 + 40 AND abs(r.y - l.y) <= 6 AND r.text <> l.text GROUP BY ALL), pr AS (SELECT doc_id, page, label, arg_min(value, lo) AS value FROM lv GROUP BY ALL)"
ORACLES = {
    **_LOADS,
    "load_dry_run": " UNION ALL ".join(f"SELECT '{n.removeprefix('load_')}' AS target, count(*) AS n FROM ({q})" for n, q in _LOADS.items()),
    "run_columns": "SELECT item_id, length(text)::INTEGER AS size, CASE WHEN item_id % 2 = 0 THEN (length(text) % 2)::INTEGER END AS run_a, CASE WHEN item_id % 3 = 0 THEN (length(text) % 3)::INTEGER END AS run_b FROM benchmark",
    "structured_rows": f"WITH {_S}, a AS (SELECT seq, string_split(topics, ',') AS a, [title, ' ', prerequisites] AS b FROM s), x AS (SELECT seq, generate_subscripts(a, 1) AS i, unnest(a) AS text, 'topics' AS child FROM a UNION ALL SELECT seq, generate_subscripts(b, 1), unnest(b), 'notes' FROM a) SELECT seq, (i - 1)::INTEGER AS ord, text, child FROM x WHERE trim(coalesce(text, '')) <> ''",
    "merged_extracts": f"WITH {_S}, t AS (SELECT course, item, min(seq * 100 + i) AS pos FROM (SELECT course, seq, unnest(string_split(topics, ',')) AS item, generate_subscripts(string_split(topics, ','), 1) AS i FROM s) GROUP BY ALL), j AS (SELECT course, string_agg(item, '|' ORDER BY pos) AS topics FROM t GROUP BY course) SELECT course, arg_min(prerequisites, seq) FILTER (prerequisites IS NOT NULL) AS prerequisites, arg_min(email, seq) FILTER (email IS NOT NULL) AS email, any_value(j.topics) AS topics FROM s JOIN j USING (course) GROUP BY course",
    "numbered_items": "WITH c AS (SELECT conv_id * 1000 + turn AS seq, left(text, 12) AS question FROM conversations), f AS (SELECT question, min(seq) AS seq FROM c WHERE trim(coalesce(question, '')) <> '' GROUP BY question) SELECT seq, question, row_number() OVER (ORDER BY seq) AS number FROM f",
    "chunk_files": "SELECT source AS stem, doc_id, (i - 1)::INTEGER AS idx, md5(c) AS digest FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(c) <> ''",
    "structured_files": "SELECT TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE event_id % 7 <> 0 GROUP BY k",
    "step_log": "WITH e AS (SELECT user_id AS stem, 'v' || lpad((event_id % 50)::VARCHAR, 3, '0') AS version, event_id AS line, event_type FROM events), v AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY stem, version ORDER BY line DESC) = 1) SELECT stem, version, line, event_type, count(*) OVER (PARTITION BY stem) AS n_versions FROM v QUALIFY row_number() OVER (PARTITION BY stem ORDER BY version DESC) = 1",
    "layered_logs": "SELECT user_id AS file, ts::DATE::VARCHAR AS ts, event_id, (event_id % 2)::INTEGER AS layer FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE DESC, event_id % 2 DESC, event_id DESC) = 1",
    "inside_tables": f"WITH {_LAY} SELECT doc_id, ord FROM v b WHERE kind <> 'table' AND EXISTS (FROM v t WHERE t.kind = 'table' AND t.doc_id = b.doc_id AND t.page = b.page AND (b.x0 + b.x1) / 2 BETWEEN t.x0 - 2 AND t.x1 + 2 AND (b.top + b.bottom) / 2 BETWEEN t.bottom - 2 AND t.top + 2)",
    "link_places": f"""WITH {_LAY}, k AS (SELECT doc_id, page, ord AS link_id, CASE WHEN ord % 4 > 0 THEN y * 3 END AS cy FROM v WHERE kind = 'link'), m AS (SELECT k.*, v.ord, 520 - top AS h FROM k JOIN v ON v.kind <> 'link' AND v.doc_id = k.doc_id AND v.page = k.page)
SELECT doc_id, page, link_id, CASE WHEN any_value(cy) IS NULL THEN max(ord) + 1 ELSE coalesce(arg_max(ord, h * 1000 - ord) FILTER (h <= cy) + 1, min(ord)) END AS at FROM m GROUP BY ALL""",
    "column_pairs": f"WITH {_LAY}, {_PAIRS} SELECT doc_id, page, label, value FROM pr",
    "joined_labels": f"""WITH {_LAY}, {_PAIRS}, t AS (SELECT * FROM v WHERE kind = 'text'), w AS (SELECT t.doc_id, t.page, t.ord AS spot, pr.value, r.ord FROM t JOIN pr ON pr.doc_id = t.doc_id AND pr.page = t.page AND pr.label = t.text JOIN t r ON r.doc_id = t.doc_id AND r.page = t.page AND r.text = pr.value AND r.ord <> t.ord QUALIFY row_number() OVER (PARTITION BY t.doc_id, t.page, t.ord ORDER BY r.ord) = 1),
m AS (SELECT * FROM w WHERE ord <> spot + 1 QUALIFY row_number() OVER (PARTITION BY doc_id, page, ord ORDER BY spot) = 1)
SELECT v.doc_id, v.ord, CASE WHEN m.value IS NULL THEN v.text ELSE v.text || ' ' || m.value END AS text, m.value IS NOT NULL AS recovered FROM v LEFT JOIN m ON m.doc_id = v.doc_id AND m.page = v.page AND m.spot = v.ord WHERE NOT EXISTS (FROM m g WHERE g.doc_id = v.doc_id AND g.page = v.page AND g.ord = v.ord)""",
    "header_pages": f"WITH {_LAY}, x AS (SELECT doc_id, ord, page, unnest([(ord % 3) || '.1 ' || lower(text), lower(text)]) AS key FROM v) SELECT doc_id, key, arg_max(page, ord) AS page FROM x GROUP BY ALL",
    "budget_warnings": f"SELECT user_id, event_type, count(*) AS used, greatest({PER_SESSION} - count(*), 0) AS remaining, count(*) >= 0.8 * {PER_SESSION} AS warn FROM events GROUP BY ALL",
}
