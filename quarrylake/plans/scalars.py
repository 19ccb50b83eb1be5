"""Column functions over derived inputs: each row of ``part`` gives one input of each function.

A case is (name, the function over the input, DuckDB text of what it has to give).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.functions import arrays as A
from quarrylake.functions import courses as K
from quarrylake.functions import markdown as M
from quarrylake.functions import text as T
from quarrylake.functions import times
from quarrylake.functions import tables as B
from quarrylake.plans.tables import table

Case = tuple[str, Callable[[], Column], str]
#: Seasons of stems, which differ from those of terms.
STEM_SEASONS = {"11": "Spring", "21": "Summer I", "31": "Summer II", "41": "Fall", "01": "Spring", "02": "Summer", "03": "Fall"}


def _x(sql: str) -> Column:
    return F.expr(sql)


def _pick(*values: str) -> str:
    """SQL that gives the values in turn, by part."""
    return "CASE p_partkey % " + str(len(values)) + " " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_ID = _pick("concat('csce', p_partkey)", "concat('stat-', p_partkey)", "concat(' Math ', p_partkey)", "'no number'")
_STEM = _pick("concat('202541_csce_', p_partkey, '_600_62077')", "concat('202631_STAT_', p_partkey, '_601_1_HP')", "concat('9_', p_partkey)")
_TERM = _pick("'Fall 2025'", "'spring 2026'", "'Winter 2025'", "'Fall'")
_MEET = _pick("'MW 4:10PM - 5:25PM'", "'tr 9:35 am - 10:50 AM'", "'WEB ASYNC'", "'F 1:00PM - 12:00PM'", "'x S 12:00AM – 12:30AM y'")
_SUMMARY = _pick("concat('CSCE ', p_partkey, ' | Title\nTopics: a, B, b, introduction, c of\nTools: B, d\nSkills: x')", "concat('Head\n  Topics: x, , x')", "'no such line'")
_ERROR = _pick("'JSON parse error at 3'", "'SSL handshake'", "'getaddrinfo failed'", "'HTTP 429'", "'exhausted retries'", "'odd'")
_ANSWER = _pick("concat('as [Source 1, p.', p_partkey, '] and [Source 2] say')", "'see [Source 9] or [Source 3]'", "'none'")
_SIGNED = _pick("'a penalty of 20 % here'", "'due by March 3 at noon'", "'see https://x.example/a).'", "'nothing at all'", "'deadline next week 3'")
TEXT_CASES: list[Case] = [
    ("query", lambda: T.normalize_query(_x("concat(' What, is ', p_name, '?  Now! ')")), "'what is ' || p_name || ' now'"),
    ("has_table", lambda: T.has_table(_x(_pick("concat('| a', p_partkey, ' | b')", "'one | bar'", "'none'"))), "p_partkey % 3 = 0"),
    ("header", lambda: T.normalize_header(_x("concat('## ', p_name, ' (x):\n body')")), "p_name || ' x'"),
    ("replacements", lambda: T.replacement_chars(_x("concat('a', repeat('�', CAST(p_partkey % 4 AS INT)))")), "(p_partkey % 4)::INTEGER"),
    ("drops", lambda: T.letter_drops(_x(_pick("'the Sylabus wil fall'", "'all well'", "'Wil Colege'"))), "CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END"),
    ("damage", lambda: T.ligature_damage(_x(_pick("'Ofce of the ofcer, fnal'", "'office final'"))), "CASE p_partkey % 2 WHEN 0 THEN 3 ELSE 0 END"),
    ("signal", lambda: T.course_signal(_x(_SIGNED)), _pick("'percent:20 %'", "'due_date:due by March 3'", "NULL", "NULL", "NULL")),
    ("protected", lambda: T.protected_signal(_x(_SIGNED)), _pick("'percent:20 %'", "'due_date:due by March 3'", "'url:https://x.example/a'", "NULL", "NULL")),
    ("thinking", lambda: T.strip_thinking(_x("concat('<thinking>x\ny</thinking>\n ', p_name)")), "p_name"),
    ("spaces", lambda: T.squeeze_spaces(_x("concat(p_name, '   x', '  y')")), "p_name || ' x  y'"),
    ("urls", lambda: T.fix_broken_urls(_x(_pick("concat('at https://x.example/a b/c', p_partkey, ' end')", "'at https://x.example/a then prose'"))), _pick("concat('at https://x.example/ab/c', p_partkey, ' end')", "'at https://x.example/a then prose'")),
    ("caps", lambda: T.collapse_spaced_caps(_x(_pick("'T I T L E of A B'", "'A B C'", "'see X Y Z W now'"))), _pick("'TITLE of A B'", "'A B C'", "'see XYZW now'")),
    ("truncated", lambda: T.is_truncated(_x(_pick("'it ends with, '", "'a lot of\n'", "'From'", "'done.'", "''"))), "p_partkey % 5 < 3"),
    ("no_answer", lambda: T.is_empty_answer(_x(_pick("' '", "'(Out of scope) sorry'", "'no information on it'", "'No information about it'"))), "p_partkey % 4 <> 2"),
    ("boolean", lambda: T.coerce_bool(_x(_pick("' No '", "'0'", "'yes'", "''", "'FALSE'"))), "p_partkey % 5 = 2"),
    ("error", lambda: T.classify_error(_x(_ERROR)), _pick("'JSON_PARSE_ERROR'", "'SSL_ERROR'", "'DNS_ERROR'", "'RATE_LIMIT'", "'EXHAUSTED_RETRIES'", "'UNKNOWN_ERROR'")),
    ("json", lambda: T.sanitize_json(_x(r"concat('{\"a\": \"', chr(1), '\\d', p_partkey, '\"}')")), r"""'{"a": "\\d' || p_partkey || '"}'"""),
    ("body", lambda: T.json_body(_x("concat('```json\n{\"k\": ', p_partkey, '}\n```')")), "'{\"k\": ' || p_partkey || '}'"),
    ("item_id", lambda: T.stable_item_id(F.col("p_name")), "left(md5(p_name), 16)"),
    ("hash", lambda: T.content_hash(_x("concat(' ', upper(p_name), ' ')")), "sha256(p_name)"),
    ("tokens", lambda: T.token_floor(F.col("p_name")), "greatest(1, length(p_name) // 4)"),
    ("cut", lambda: T.truncate(_x("concat('One. ', p_name, ' two. three four five')"), 5)["text"], r"""(WITH a AS (SELECT left('One. ' || p_name || ' two. three four five', 20) AS h), b AS (SELECT h, length(h) - length(regexp_replace(h, '^.*\. ', '')) AS e FROM a)
   SELECT CASE WHEN ('One. ' || p_name || ' two. three four five').length() // 4 <= 5 THEN 'One. ' || p_name || ' two. three four five' ELSE rtrim(CASE WHEN e - 2 >= 10 THEN left(h, e) ELSE h END) || chr(10) || chr(10) || '*[Response truncated — output limit reached]*' END FROM b)"""),
    ("xml", lambda: T.escape_xml(_x("concat('<', p_name, '> & \"')")), "'&lt;' || p_name || '&gt; &amp; &quot;'"),
    ("generic", lambda: T.generic_reference(_x(_pick("'in This Course we'", "'in a course'"))), "p_partkey % 2 = 0"),
    ("marks", lambda: T.strip_heading_marks(_x("concat('## ', p_name, '\n# x')")), "p_name || chr(10) || 'x'"),
    ("cited", lambda: T.has_citation(_x(_ANSWER)), "p_partkey % 3 < 2"),
    ("noise", lambda: K.template_noise(_x(_pick("concat('Prerequisite/Corequisite(s): ', p_name, '\nNone\n\n\n\nend')", "concat('This material Is: Required\n', p_name)"))), _pick("concat(p_name, chr(10), chr(10), 'end')", "p_name")),
    ("policy", lambda: K.clean_policy(_x("concat(p_name, '''\n''x\"}')")), "p_name || chr(10) || chr(10) || 'x'"),
    ("garbled", lambda: F.size(F.filter(M.links(_x(_pick("'[keup work for an](https://x.example/a)'", "'[U.S. Office](https://x.example)'", "'[x (y](mailto:a@b.c)'", "'[course website](https://x.example)'"))), lambda x: M.is_garbled(x["label"]))), "(p_partkey % 4 IN (0, 2))::INTEGER"),
    ("bare_images", lambda: M.bare_images(_x("repeat('<!-- image --> x ', CAST(p_partkey % 3 AS INT))")), "(p_partkey % 3)::INTEGER"),
    ("failures", lambda: B.failure_markers(_x("repeat('[image processing failed: x] ', CAST(p_partkey % 3 AS INT))")), "(p_partkey % 3)::INTEGER"),
]
COURSE_CASES: list[Case] = [
    ("course", lambda: K.normalize_id(_x(_ID)), _pick("concat('CSCE ', p_partkey)", "concat('STAT ', p_partkey)", "concat('MATH ', p_partkey)", "'NO NUMBER'")),
    ("dept", lambda: K.department(_x(_ID)), _pick("concat('CSCE', p_partkey)", "concat('STAT-', p_partkey)", "'MATH'", "'NO'")),
    ("kind", lambda: K.course_type(_x("concat('ISEN ', 680 + p_partkey % 12)")), "CASE p_partkey % 12 WHEN 1 THEN 'seminar' WHEN 4 THEN 'internship' WHEN 9 THEN 'special_topics' WHEN 11 THEN 'research' ELSE 'course' END"),
    ("format", lambda: K.meeting_format(_x(_pick("'Online'", "'ROOM 3'", "NULL")), _x("p_type")), "CASE WHEN p_partkey % 3 = 0 THEN 'online' ELSE 'in-person' END"),
    ("stem", lambda: K.stem(_x(_pick("concat('a', p_partkey, '.json')", "concat('b', p_partkey, '.pdf')", "''"))), _pick("concat('a', p_partkey)", "concat('b', p_partkey, '.pdf')", "NULL")),
    ("stem_course", lambda: K.stem_course(_x(_STEM)), _pick("concat('CSCE-', p_partkey)", "concat('STAT-', p_partkey)", "NULL")),
    ("stem_dept", lambda: F.upper(F.get(F.split(_x(_STEM), "_"), F.lit(1))), _pick("'CSCE'", "'STAT'", "p_partkey::VARCHAR")),
    ("stem_id", lambda: K.stem_fields(_x(_STEM))["course_id"], _pick("concat('csce ', p_partkey)", "concat('STAT ', p_partkey)", "NULL")),
    ("stem_section_term", lambda: K.stem_fields(_x(_STEM))["term"], _pick("'Fall 2025'", "'?31 2026'", "NULL")),
    ("stem_term", lambda: times.stem_term(_x(_STEM), STEM_SEASONS), _pick("'Fall 2025'", "'Summer II 2026'", "''")),
    ("stem_source", lambda: K.source_of(_x(_STEM), _x(_pick("'simple_syllabus'", "'x'", "NULL"))), _pick("'simple_syllabus'", "'howdy_portal'", "'unknown'")),
    ("code", lambda: times.term_to_code(_x(_TERM)), _pick("'202541'", "'202611'", "NULL", "NULL")),
    ("fixed_code", lambda: K.fix_code(_x(_pick("concat(p_partkey, '')", "concat('STAT', p_partkey)", "concat('STAT ', p_partkey)", "''")), F.lit("202541_stat_1_2_3")), _pick("concat('STAT ', p_partkey)", "concat('STAT ', p_partkey)", "concat('STAT ', p_partkey)", "''")),
    ("room", lambda: K.location(_x(_pick("'online  ONLINE'", "'ROOM 1'"))), _pick("'Online'", "'ROOM 1'")),
    ("anchor", lambda: K.anchor(F.lit("CSCE 1"), F.lit("600"), F.lit("Fall 2025"), _x(_pick("concat('A > ', p_name)", "''", "p_name"))), "concat('CSCE 1 Section 600, Fall 2025 — ', CASE WHEN p_partkey % 3 = 1 THEN 'General' ELSE p_name END, ':')"),
    ("topics", lambda: F.array_join(K.topics(_x(_SUMMARY)), "|"), _pick("'a|B|introduction|c of'", "'x'", "''")),
    ("n_topics", lambda: K.n_topics(_x(_SUMMARY)), _pick("5", "2", "0")),
    ("tidy", lambda: K.tidy_summary(_x(_SUMMARY)), _pick("concat('CSCE ', p_partkey, ' | Title', chr(10), 'Topics: a, B, introduction, c of', chr(10), 'Tools: d')", "concat('Head', chr(10), '  Topics: x')", "'no such line'")),
    ("specific", lambda: K.drop_generic_topics(_x(_SUMMARY)), _pick("concat('CSCE ', p_partkey, ' | Title', chr(10), 'Topics: a, B, b, c of', chr(10), 'Tools: B, d', chr(10), 'Skills: x')", "concat('Head', chr(10), '  Topics: x, x')", "'no such line'")),
    ("headed", lambda: K.head_with_id(_x(_pick("'| Title\nrest'", "'CSCE 1 | Title'", "''")), F.lit("CSCE 1")), _pick("concat('CSCE 1 Title', chr(10), 'rest')", "'CSCE 1 | Title'", "''")),
    ("ids", lambda: F.array_join(K.summary_head(_x(_pick("concat('isen 689 / aero', p_partkey, ' | A Title | Fall')", "'isen 1'", "'isen 1 | '")))["ids"], "|"), _pick("concat('ISEN 689|AERO ', p_partkey)", "''", "'ISEN 1'")),
    ("title", lambda: K.summary_head(_x(_pick("concat('isen 689 | ', p_name, ' | Fall')", "'isen 1'", "'isen 1 | '")))["title"], _pick("p_name", "NULL", "NULL")),
    ("cache", lambda: K.cache_key(F.lit("p"), _x(_pick("array('B 2', 'A 1')", "NULL")), _x("concat('What, ', p_name, '?')")), "concat('p|', CASE WHEN p_partkey % 2 = 0 THEN '[''A 1'', ''B 2'']|' ELSE '' END, 'what ', p_name)"),
    ("retrieval", lambda: K.function_of(_x("p_partkey % 3"), _x("p_size % 2 = 0"), _x(_pick("NULL", "'x'"))), "CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'out_of_scope' WHEN p_partkey % 3 = 0 THEN 'semantic_general' WHEN p_size % 2 = 0 THEN 'recursive' ELSE 'hybrid_course' END"),
    ("mode", lambda: K.mode_of(_x("p_partkey % 3"), _x("p_size % 2 = 0")), "CASE WHEN p_partkey % 3 = 0 THEN 'semantic' WHEN p_size % 2 = 0 THEN 'hybrid' ELSE 'hybrid_course' END"),
    ("k", lambda: K.dynamic_k(_x(_pick("'semantic_general'", "'recursive'", "'hybrid_course'")), _x("CAST(p_size % 5 AS INT)"), _x("p_size % 2 = 0"))["retrieve_k"], "CASE WHEN p_partkey % 3 = 0 THEN 50 ELSE least(CASE WHEN p_size % 2 = 0 OR p_partkey % 3 = 2 THEN 40 ELSE 30 END * greatest(p_size % 5, 1), 100) END"),
    ("links", lambda: K.rewrite_citations(_x(_ANSWER), F.array(F.lit("a.pdf"), F.lit("b.json"), F.lit(None).cast("string"))),
     r"CASE p_partkey % 3 WHEN 0 THEN concat('as [\[S1, p.', p_partkey, '\]](/app/static/syllabi/a.pdf#page=', p_partkey, ') and [\[S2\]](/app/static/syllabi/b.pdf) say') WHEN 1 THEN 'see [Source 9] or \[S3\]' ELSE 'none' END"),
    ("repaired_ids", lambda: F.array_join(_repaired()["course_ids"], "|"), "CASE WHEN p_partkey % 2 = 0 THEN 'A 1' ELSE '' END"),
    ("repaired_queries", lambda: F.array_join(_repaired()["subqueries"], "|"), "CASE p_partkey % 3 WHEN 0 THEN 'q' || p_partkey || '|b|c|d' WHEN 1 THEN 'b|c|d|e' ELSE 'the question' END"),
    ("slug", lambda: K.slug(F.lit("Fall 2025 - College Station"), F.lit("CSCE"), _x("CAST(p_partkey AS STRING)"), F.lit("600"), F.lit("1")), "concat('Fall-2025-College-Station-CSCE-', p_partkey, '-600-(1)')"),
    ("flags", lambda: K.file_flags(_x("p_partkey * 100"), _x("p_size % 3"), _x("p_size % 2"), _x("p_size % 5 > 0")), "concat_ws(', ', CASE WHEN p_partkey * 100 > 10000 THEN 'MASSIVE_FILE' END, CASE WHEN p_partkey * 100 < 300 THEN 'TINY' END, CASE WHEN p_size % 3 = 0 THEN 'ZERO_HEADERS' END, CASE WHEN p_size % 2 > 0 THEN 'OVERSIZED(1)' END, CASE WHEN p_size % 5 = 0 THEN 'NO_ENRICHMENT' END)"),
    ("drop", lambda: K.drop_reason(_x("p_partkey % 3 = 0"), _x(_pick("true", "NULL"))), "CASE WHEN p_partkey % 3 = 0 THEN 'boilerplate' WHEN p_partkey % 2 = 0 THEN 'duplicate' END"),
    ("cutoff", lambda: F.array_join(F.transform(K.fix_failing_cutoff(_x("array(named_struct('grade', CASE WHEN p_partkey % 2 = 0 THEN 'B' ELSE 'S' END, 'min_percent', 80D), named_struct('grade', 'f ', 'min_percent', 59D))")), lambda c: c["min_percent"].cast("int").cast("string")), "|"), "CASE WHEN p_partkey % 2 = 0 THEN '80|0' ELSE '80|59' END"),
    ("f1", lambda: K.f1(_x("p_size / 50D"), _x("CASE WHEN p_size % 2 = 0 THEN 0D ELSE 0.5D END")), "CASE WHEN p_size % 2 = 0 THEN 0::DOUBLE ELSE 2 * (p_size / 50::DOUBLE) * 0.5::DOUBLE / (p_size / 50::DOUBLE + 0.5::DOUBLE) END"),
]


def _repaired() -> Column:
    ids = _x(_pick("array('a1', 'zz 9', 'A 1')", "array('zz9')"))
    subs = _x("CASE p_partkey % 3 WHEN 0 THEN array('B?', 'b', 'c', 'd', 'e') WHEN 1 THEN array('b', 'c', 'd', 'e', 'f') END")
    subs = F.transform(subs, lambda s: F.replace(s, F.lit("B?"), F.lit("b")))
    return K.repaired(ids, F.array(F.lit("A 1"), F.lit("C 3")), _x("CASE WHEN p_partkey % 3 = 0 THEN concat('q', p_partkey) END"), subs, F.lit("the question"), F.lit(True))


_STOP = "(CASE p_partkey % 5 WHEN 0 THEN 1045 WHEN 1 THEN 650 WHEN 4 THEN 30 END)"
TIME_CASES: list[Case] = [
    ("code", lambda: times.term_to_code(_x(_TERM)), _pick("'202541'", "'202611'", "NULL", "NULL")),
    ("term", lambda: times.code_to_term(_x(_pick("'202541'", "'202531'", "'2025'", "'abcdef'"))), _pick("'Fall 2025'", "'?31 2025'", "'2025'", "'abcdef'")),
    ("minutes", lambda: times.to_minutes(_x("concat(1 + p_partkey % 12, ':', lpad(CAST(p_partkey % 60 AS STRING), 2, '0'), CASE WHEN p_partkey % 2 = 0 THEN ' PM' ELSE 'am' END)")), "(((1 + p_partkey % 12) % 12 + CASE WHEN p_partkey % 2 = 0 THEN 12 ELSE 0 END) * 60 + p_partkey % 60)::INTEGER"),
    ("days", lambda: F.array_join(times.days(_x(_pick("'MWF'", "'trx'", "''"))), ""), _pick("'FMW'", "'RT'", "''")),
    ("start", lambda: times.meeting(_x(_MEET))["start"], _pick("970", "575", "NULL", "NULL", "0")),
    ("stop", lambda: times.meeting(_x(_MEET))["stop"], _STOP),
    ("conflict", lambda: times.conflicts(times.meeting(_x(_MEET)), times.meeting(F.lit("WR 10:00AM - 4:30PM"))), "p_partkey % 5 < 2"),
    ("area", lambda: F.abs((F.col("p_size") - 10) * (F.col("p_retailprice") - F.lit(900.0))), "abs((p_size - 10) * (p_retailprice - 900))"),
    ("levels", lambda: F.array_join(A.normalize_levels(_x("array(1, CAST(1 + p_partkey % 6 AS INT), CAST(1 + p_size % 6 AS INT))")), ","), "'1,' || CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 2 END || ',' || CASE WHEN p_size % 6 = 0 THEN 1 WHEN p_partkey % 6 = 0 OR p_size % 6 <= p_partkey % 6 THEN 2 ELSE 3 END"),
    ("packed", lambda: F.array_join(A.pack_parts(_x("array('aaaa', repeat('b', CAST(p_partkey % 7 + 1 AS INT)), 'cc')"), 8), "/"), "(WITH v AS (SELECT repeat('b', (p_partkey % 7 + 1)::INTEGER) AS b) SELECT 'aaaa' || CASE WHEN length(b) <= 4 THEN chr(10) ELSE '/' END || b || CASE WHEN length(b) <= 2 OR length(b) BETWEEN 5 AND 6 THEN chr(10) ELSE '/' END || 'cc' FROM v)"),
]


def _run(spark: SparkSession, sf_dir: str, cases: list[Case]) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", *[make().alias(name) for name, make, _ in cases])


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, TEXT_CASES)


def course_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, COURSE_CASES)


def time_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, TIME_CASES)


QUERIES = {f.__name__: f for f in (text_functions, course_functions, time_functions)}
ORACLES = {q: "SELECT p_partkey, " + ", ".join(f"{sql} AS {name}" for name, _, sql in cases) + " FROM part" for q, cases in (("text_functions", TEXT_CASES), ("course_functions", COURSE_CASES), ("time_functions", TIME_CASES))}
