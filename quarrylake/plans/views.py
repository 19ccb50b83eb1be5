"""Views that several plans share, as SQL that Spark and DuckDB both run.

The driver's tables hold neither layout nor tagged chunks, so these derive some from line items: an
order is a document, its lines are the blocks or chunks, and what they hold follows from their numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylake.plans.tables import table

_Q = "CAST(l_quantity AS BIGINT)"
_NTH = "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT)"  # line numbers repeat
#: Blocks of a page: kind, heading level, text, box, caption.
BLOCKS = f"""SELECT l_orderkey AS doc_id, {_NTH} AS ord, CAST(floor(l_linenumber / 3.0) AS INT) AS page,
 CASE WHEN l_partkey % 11 < 2 THEN 'heading' WHEN l_partkey % 11 = 2 THEN 'image' WHEN l_partkey % 11 = 3 THEN 'table' ELSE 'text' END AS kind,
 CAST(1 + {_Q} % 3 AS INT) AS level, CAST(1 + {_Q} % 6 AS INT) AS raw_level,
 CASE l_partkey % 13
  WHEN 0 THEN concat('Contact Number ', l_suppkey, ':')
  WHEN 1 THEN concat('see [part ', l_partkey, '](https://x.example/s', l_suppkey % 3, ')')
  WHEN 2 THEN concat('look at x.example/s', l_suppkey % 3, ' first')
  WHEN 3 THEN 'the ofce of signifcant fnal beneft'
  WHEN 4 THEN concat('undecoded � bytes of part ', l_partkey)
  WHEN 5 THEN 'it wil fal and rise'
  WHEN 6 THEN concat('Instructor: Jane Doe number ', l_suppkey)
  WHEN 7 THEN 'A sentence ends here.'
  WHEN 8 THEN concat('go [keup work for an office](https://x.example/w', l_suppkey % 7, ') now')
  WHEN 9 THEN 'go [see (rule](https://x.example/r) now'
  WHEN 10 THEN ''
  ELSE concat('Part number', l_partkey, ' from supplier', l_suppkey) END AS text,
 10.0 * {_Q} AS x, CASE WHEN l_suppkey % 5 = 0 THEN 0.0 ELSE 20.0 * {_Q} END AS y,
 CASE WHEN l_suppkey % 4 = 0 THEN 'a figure' ELSE '' END AS caption, l_suppkey % 10 <> 0 AS survives
FROM lineitem"""
#: Chunks of a document after tagging: flags, header, content.
CHUNKS = f"""SELECT l_orderkey AS doc_id, {_NTH} AS idx,
 CASE l_partkey % 9 WHEN 0 THEN '# Policies' WHEN 1 THEN concat('a penalty of ', {_Q}, '% applies') WHEN 2 THEN concat('due by March ', {_Q}) WHEN 3 THEN 'see https://x.example/a).'
  WHEN 4 THEN concat('figure <!-- image --> of part', l_partkey) WHEN 5 THEN 'go [keup work for an office](https://x.example/w) now' ELSE concat('text of part', l_partkey, ' and supplier', l_suppkey) END AS content,
 CASE WHEN l_suppkey % 20 = 0 THEN '' ELSE concat('Section ', l_returnflag) END AS header, 40 * {_Q} AS tokens,
 CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE l_returnflag END AS term, l_partkey % 2 = 0 AS is_boilerplate, l_partkey % 2 = 1 AND {_Q} % 9 = 0 AS is_duplicate,
 CASE WHEN l_suppkey % 3 = 0 THEN 'header_anchored' ELSE 'body_jaccard' END AS match_source, CASE WHEN l_partkey % 9 = 4 AND l_suppkey % 13 > 0 THEN 1 ELSE 0 END AS images, CASE WHEN l_partkey % 40 = 0 THEN NULL ELSE 'model-a' END AS model,
 CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE concat('C ', l_partkey) END AS code, CASE WHEN l_suppkey % 2 = 0 THEN ' ' ELSE concat('I ', l_suppkey) END AS instructor
FROM lineitem"""
#: Tables of a document as a model transcribed them: n_text rows against n_grid rows of the layout's grid.
MODAL = f"""SELECT l_orderkey AS doc_id, {_NTH} AS ord, l_partkey % 6 AS n_text, l_suppkey % 5 AS n_grid, l_discount * 10 AS confidence, l_partkey % 7 = 0 AS empty_cells,
 l_suppkey % 11 = 0 AS failed, {_Q} % 4 = 0 AS partial, l_partkey % 5 > 0 AS described
FROM lineitem"""
#: Rows of a grading table, and the weight each carries.
GRADES = f"SELECT l_orderkey AS doc_id, {_NTH} AS ord, l_partkey, {_Q} AS weight FROM lineitem"


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Rows of a view. Where it numbers an order's lines, these are dealt by order before anything is made of them, so that they move once and as numbers."""
    lines = table(spark, sf_dir, "lineitem")
    lines = lines.repartition("l_orderkey") if _NTH in sql else lines
    return spark.sql(sql.replace("FROM lineitem", "FROM {lineitem}"), lineitem=lines)


#: Blocks with their boxes, counted upward from the page's foot, and text that pairs labels with values.
LAYOUT = f"""SELECT l_orderkey AS doc_id, {_NTH} AS ord, CAST(floor(l_linenumber / 4.0) AS INT) AS page, CASE WHEN l_partkey % 5 = 0 THEN 'table' WHEN l_partkey % 5 = 1 THEN 'link' ELSE 'text' END AS kind,
 CASE WHEN l_partkey % 7 < 3 THEN concat('Label', l_suppkey % 2, ':') ELSE concat('Value ', l_suppkey % 3) END AS text, 20.0 * (l_suppkey % 10) AS x0, 10.0 * (l_partkey % 12) AS y,
 10.0 * {_Q} AS top, 20.0 * (l_suppkey % 10) + CASE WHEN l_partkey % 5 = 0 THEN 120.0 ELSE 30.0 END AS x1, 10.0 * {_Q} - CASE WHEN l_partkey % 5 = 0 THEN 150.0 ELSE 12.0 END AS bottom
FROM lineitem"""
#: Sections of a catalogue in the order they are read.
SECTIONS = f"""SELECT l_orderkey * 100 + {_NTH} AS seq, l_partkey AS course, l_suppkey AS crn, concat('title ', l_orderkey % 50) AS title, CASE WHEN l_tax > 0.04 THEN concat('pre ', {_Q}) END AS prerequisites,
 CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE CAST(l_suppkey % 4 AS INT) END AS dept, concat('name', l_partkey % 9) AS instructor, CASE WHEN l_discount > 0.05 THEN concat('m', l_orderkey) END AS email,
 CASE WHEN l_partkey % 2 = 0 THEN concat(' Policy ', l_partkey % 20) ELSE concat('policy ', l_partkey % 20, ' ') END AS policy, concat('t', l_returnflag, ', ,T', l_linestatus, ',x', l_partkey % 3) AS topics, l_returnflag AS doc_type
FROM lineitem"""

#: Tables of orders as two parsers saw them: the first lost every third row and the ends of some cells.
TWO_GRIDS = f"""SELECT doc_id, transform(filter(r, x -> x.n % 3 <> 0), x -> array(x.item, x.state)) AS a, transform(r, x -> array(x.item, concat(x.state, x.more))) AS b FROM (
 SELECT l_orderkey AS doc_id, array_sort(collect_list(named_struct('n', n, 'item', concat('part', l_partkey), 'state', concat('flag ', l_returnflag), 'more', CASE WHEN l_suppkey % 3 = 0 THEN concat(' delivered', l_suppkey) ELSE '' END))) AS r
 FROM (SELECT *, {_NTH} AS n FROM lineitem) GROUP BY l_orderkey)"""
#: Blocks of converted documents: texts, tables, and tables that a page break left without a body.
TABLE_BLOCKS = f"""SELECT doc_id, ord, kind, CASE WHEN outcome = 'lost' THEN NULL WHEN kind = 'text' THEN concat('about part', part) ELSE concat('| part', part, ' | head |') END AS rendered,
 CASE WHEN kind = 'table' THEN array(array(concat('part', part), concat('name', supp))) END AS grid, outcome
FROM (SELECT l_orderkey AS doc_id, {_NTH} AS ord, CASE WHEN l_suppkey % 4 = 0 THEN 'text' ELSE 'table' END AS kind, CASE WHEN l_suppkey % 4 = 0 THEN NULL WHEN l_partkey % 5 < 3 THEN 'lost' ELSE 'grid_fallback' END AS outcome, l_partkey % 9 AS part, l_suppkey % 7 AS supp FROM lineitem)"""
#: Lines of course information, many to a document.
MEETINGS = """SELECT l_orderkey div 40 AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey div 40 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS idx,
 CASE l_partkey % 31 WHEN 0 THEN 'Meeting Days:' WHEN 1 THEN ' Meeting Days: ' WHEN 2 THEN 'Meeting Days: Start Time: MWF 3:00PM' WHEN 3 THEN 'Start Time: N/A' WHEN 4 THEN 'Start Time: 9:35' WHEN 5 THEN 'Meeting Location: ONLINE'
 WHEN 6 THEN 'Online  ONLINE' WHEN 7 THEN 'Meeting Times: TR 9:35AM' WHEN 8 THEN 'Meeting Times: MTW 10:20' WHEN 9 THEN 'Meeting Days: MWF' ELSE concat('line ', l_suppkey) END AS line FROM lineitem"""
