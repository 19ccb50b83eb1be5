"""Chunks, links, pages, properties, passages in documents, and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylake.functions import arrays as A
from quarrylake.functions import text as T
from quarrylake.functions.cleanup import TRANSIENT
from quarrylake.operators import retrieval as R
from quarrylake.operators import traces
from quarrylake.plans.retrieval import _LEX, _vector
from quarrylake.plans.tables import NORM, VECTOR_RANKED, WORDS, benchmark_queries, table, vector_queries

SIZE, OVERLAP, K = 800, 100, 10


def explode_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents with their places."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line")).select("doc_id", "ord", F.md5("line").alias("digest"))


def fixed_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character windows with overlap; the last one ends with the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(A.windows(F.col("text"), SIZE, OVERLAP)).alias("w"))
    return docs.select("doc_id", F.col("w.ord").alias("ord"), F.md5("w.content").alias("digest"), F.length("w.content").alias("n"))


def citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations and percentages of each message."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", T.citations(F.col("text")).cast("long").alias("n_citations"), F.regexp_count("text", F.lit(r"[0-9]+%")).cast("long").alias("n_percent"))


def link_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor targets of every page, in order."""
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.links(F.col("html"))).alias("ord", "target"))


def page_url_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.url_slug(F.col("url")).alias("slug"))


def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.html_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text).alias("digest"), F.length(text).alias("n"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and the property k."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").try_cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


def heading_level_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of an order, by part, taken as heading levels: how often they go down by more than a step."""
    before = F.lag("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", before.alias("prev"))
    return rows.groupBy("l_orderkey").agg(F.count(F.when((F.col("prev") > 0) & (F.col("l_linenumber") > F.col("prev") + 1), 1)).alias("skips"))


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeatable eighth of the documents: those whose id's digest begins with 0 or 1."""
    return table(spark, sf_dir, "documents").select("doc_id").filter(F.md5(F.col("doc_id").cast("string")) < "2")


def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items of three or more words that stand whole in a document, after normalisation.

    An item meets a document by a hash of its first three words, so no pair is tried without them;
    the whole item is compared then.
    """
    # a gram is told by the hashes of its words; where a text ends there are two of fewer words, which meet no item
    after = lambda w, n: F.slice(w, n + 1, F.size(w))
    both = lambda a, b: F.xxhash64(a, b)
    gram = lambda w: F.zip_with(F.zip_with(w, after(w, 1), both), after(w, 2), both)

    def shaped(name: str, key: str) -> DataFrame:
        norm = table(spark, sf_dir, name).select(key, T.normalize_text(F.col("text")).alias("norm"))
        # the explodes keep the optimiser from splitting and hashing each text anew for every word of it
        split = norm.select(key, "norm", F.explode(F.array(T.words(F.col("norm")))).alias("words")).filter(F.size("words") >= 3)
        return split.select(key, "norm", F.explode(F.array(F.transform("words", lambda w: F.xxhash64(w)))).alias("w"))

    items = shaped("benchmark", "item_id").select("item_id", F.col("norm").alias("item"), F.get(gram(F.col("w")), F.lit(0)).alias("key"))
    docs = shaped("documents", "doc_id").select("doc_id", "norm", F.array_distinct(gram(F.col("w"))).alias("keys"))
    posted = docs.select("doc_id", F.explode("keys").alias("key"))
    met = posted.join(items, "key").select("item_id", "item", "doc_id")
    pairs = met.join(docs.select("doc_id", "norm"), "doc_id")
    return pairs.filter(F.contains(F.concat(F.lit(" "), "norm", F.lit(" ")), F.concat(F.lit(" "), "item", F.lit(" ")))).select("item_id", "doc_id")


def text_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different words of each benchmark item, and how many of them some document has."""
    words = lambda t, *keep: table(spark, sf_dir, t).select(*keep, F.explode(T.words(T.normalize_text(F.col("text")))).alias("word")).distinct()
    known = words("documents").withColumn("known", F.lit(1))
    return words("benchmark", "item_id").join(known, "word", "left").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_words"), F.count("known").alias("n_found"))


def ndcg_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking metrics at ten of each query; other rows of its label are relevant."""
    own = vector_queries(table(spark, sf_dir, "embeddings")).select("query_id", F.col("label").alias("asked"))
    found = _vector(spark, sf_dir, K).join(own, "query_id").withColumn("hit", (F.col("label") == F.col("asked")).cast("int"))
    relevant = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("asked")).agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    each = found.groupBy("query_id", "asked").agg(F.sum("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_hit"), F.sum(F.col("hit") / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(K), F.greatest("n_relevant", F.lit(1))).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    joined = each.join(relevant, "asked")
    recall = F.when(F.col("n_relevant") > 0, F.col("hits") / F.col("n_relevant")).otherwise(F.lit(0.0))
    return joined.select("query_id", (F.col("hits") / K).alias("precision"), recall.alias("recall"), F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("reciprocal_rank"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"))


def golden_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query, whether its golden row (the next vec_id, which is not the query) is among the first ten, hundred and thousand."""
    golden = F.col("query_id") + 1
    ranks = _vector(spark, sf_dir, 1000).groupBy("query_id").agg(F.min(F.when(F.col("vec_id") == golden, F.col("rank"))).alias("at"))
    return ranks.select("query_id", *[F.coalesce(F.col("at") <= k, F.lit(False)).alias(f"in_{k}") for k in (10, 100, 1000)])


def golden_passages_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at five of lexical search for benchmark items: documents that hold an item whole are what it should find; items that none holds are left out."""
    expected = containment_join(spark, sf_dir)
    found = R.lexical_overlap_topk(table(spark, sf_dir, "documents"), benchmark_queries(table(spark, sf_dir, "benchmark")), 5).select(F.col("query_id").alias("item_id"), "doc_id", F.lit(1).alias("hit"))
    each = expected.join(found, ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_expected"), F.count("hit").alias("n_found"))
    return each.select("item_id", "n_expected", "n_found", (F.col("n_found") / F.col("n_expected")).alias("recall"), (F.col("n_found") / F.col("n_expected") >= 0.8).alias("passed"))


def traceable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as test items over the documents: which can be traced to a text, and which name dates that pass."""
    text = F.coalesce("text", F.lit(""))
    kind = F.when(F.col("item_id") % 7 == 0, "multi_hop_abstract").otherwise("single_hop")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array(text, F.reverse(text)).alias("contexts"), kind.alias("kind"), text.alias("question"), F.substring(text, 1, 40).alias("answer"))
    return traces.validated(items, table(spark, sf_dir, "documents"))


def stable_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the one before it: whether the two are nearly one text, by longest blocks, with as many headers."""
    before = Window.partitionBy("conv_id").orderBy("turn")
    pairs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lag("text").over(before).alias("last")).filter(F.col("last").isNotNull())
    headers = lambda c: F.regexp_count(c, F.lit(r"(?m)^#{1,6}\s"))
    alike = traces.block_ratio(F.col("last"), F.col("text"), 0.1)
    return pairs.select("conv_id", "turn", F.round(alike, 6).alias("similarity"), (F.coalesce(alike > 0.9, F.lit(False)) & (headers("text") == headers("last"))).alias("stable"))


QUERIES = {f.__name__: f for f in (explode_ordinals, fixed_window_chunks, citation_counts, link_extraction, page_url_slug, html_main_text, json_props, heading_level_skips, hash_sample, containment_join, text_coverage, ndcg_precision_recall, golden_recall_at_k, golden_passages_recall, traceable_items, stable_turns)}

_HTML = "regexp_replace(html, '<!--.*?-->', ' ', 'gs')"
for _tag in ("script", "style", "nav", "footer", "header", "aside"):
    _HTML = f"regexp_replace({_HTML}, '<{_tag}[^>]*>.*?</{_tag}>', ' ', 'gs')"
_HTML = f"regexp_replace({_HTML}, '<[^>]*>', ' ', 'gs')"
for _entity, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_entity}', '{_char}')"
_HTML = f"trim(regexp_replace({_HTML}, '[ \\t\\r\\n]+', ' ', 'g'))"

ORACLES = {
    "explode_ordinals": "SELECT doc_id, (ord - 1)::INTEGER AS ord, md5(line) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents WHERE text IS NOT NULL)",
    "fixed_window_chunks": f"""WITH d AS (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= {SIZE} THEN 1 ELSE ceil((length(text) - {SIZE}) / {SIZE - OVERLAP})::BIGINT + 1 END)) AS ord FROM documents)
SELECT doc_id, ord::INTEGER AS ord, md5(substr(text, ord * {SIZE - OVERLAP} + 1, {SIZE})) AS digest, length(substr(text, ord * {SIZE - OVERLAP} + 1, {SIZE}))::INTEGER AS n FROM d""",
    "citation_counts": r"SELECT conv_id, turn, len(regexp_extract_all(text, '\[Source \d+'))::BIGINT AS n_citations, len(regexp_extract_all(text, '[0-9]+%'))::BIGINT AS n_percent FROM conversations",
    "link_extraction": """SELECT page_id, (ord - 1)::INTEGER AS ord, target FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS ord FROM pages)""",
    "page_url_slug": "SELECT page_id, trim(regexp_replace(lower(regexp_replace(url, '^[a-z]+://', '')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages",
    "html_main_text": f"SELECT page_id, md5(t) AS digest, length(t)::INTEGER AS n FROM (SELECT page_id, {_HTML} AS t FROM pages)",
    "json_props": "SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL",
    "heading_level_skips": "SELECT l_orderkey, count(*) FILTER (prev > 0 AND l_linenumber > prev + 1) AS skips FROM (SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS prev FROM lineitem) GROUP BY l_orderkey",
    "hash_sample": "SELECT doc_id FROM documents WHERE md5(doc_id::VARCHAR) < '2'",
    "containment_join": f"""WITH b AS (SELECT item_id, {NORM.format("text")} AS item FROM benchmark), d AS (SELECT doc_id, {NORM.format("text")} AS norm FROM documents)
SELECT item_id, doc_id FROM b JOIN d ON contains(' ' || norm || ' ', ' ' || item || ' ') WHERE len(string_split(item, ' ')) >= 3""",
    "text_coverage": f"""WITH k AS (SELECT DISTINCT unnest({WORDS.format("text")}) AS word FROM documents), b AS (SELECT DISTINCT item_id, unnest({WORDS.format("text")}) AS word FROM benchmark)
SELECT item_id, count(*) AS n_words, count(k.word) AS n_found FROM b LEFT JOIN k USING (word) GROUP BY item_id""",
    "ndcg_precision_recall": f"""WITH {VECTOR_RANKED}, f AS (SELECT query_id, asked, rank, (label = asked)::INTEGER AS hit FROM vr WHERE rank <= {K}), n AS (SELECT label AS asked, count(*) - 1 AS n FROM embeddings GROUP BY label),
e AS (SELECT query_id, asked, sum(hit) AS hits, min(rank) FILTER (hit = 1) AS first_hit, sum(hit / log2(rank + 1)) AS dcg FROM f GROUP BY ALL)
SELECT query_id, (hits / {K})::DOUBLE AS precision, (hits / n)::DOUBLE AS recall, coalesce(1 / first_hit, 0)::DOUBLE AS reciprocal_rank, round(dcg / list_sum(list_transform(range(1, least({K}, n) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM e JOIN n USING (asked)""",
    "golden_recall_at_k": f"""WITH {VECTOR_RANKED}, r AS (SELECT query_id, min(rank) FILTER (vec_id = query_id + 1) AS place FROM vr WHERE rank <= 1000 GROUP BY query_id)
SELECT query_id, coalesce(place <= 10, false) AS in_10, coalesce(place <= 100, false) AS in_100, coalesce(place <= 1000, false) AS in_1000 FROM r""",
    "traceable_items": f"""WITH i AS (SELECT item_id, coalesce(text, '') AS q, unnest([coalesce(text, ''), reverse(coalesce(text, ''))]) AS c FROM benchmark),
j AS (SELECT string_agg(coalesce(text, ''), chr(10) || chr(10)) AS whole FROM documents),
n AS (SELECT letter, count(*) AS n FROM (SELECT unnest(string_split(whole, '')) AS letter FROM j) GROUP BY letter),
o AS (SELECT item_id, c, letter, count(*) AS n FROM (SELECT item_id, c, unnest(string_split(left(c, {traces.COMPARED}), '')) AS letter FROM i) GROUP BY ALL),
r AS (SELECT item_id, c, 2.0 * sum(least(o.n, n.n)) / (any_value(length(left(c, {traces.COMPARED}))) + (SELECT sum(n) FROM n)) AS ratio FROM o JOIN n USING (letter) GROUP BY ALL),
s AS (SELECT item_id, substr(c, (s + 1)::INTEGER, {traces.WINDOW}) AS part FROM (SELECT item_id, regexp_replace(c, '^\\s+|\\s+$', '', 'g') AS c FROM i) t, unnest(range(0, greatest(1, length(c) - {traces.WINDOW}), {traces.STRIDE})) u(s) WHERE length(c) >= {traces.WINDOW}),
t AS (SELECT item_id FROM r WHERE ratio >= 0.3 UNION SELECT item_id FROM s SEMI JOIN documents d ON contains(d.text, s.part)),
b AS (SELECT item_id, coalesce(text, '') AS q FROM benchmark)
SELECT item_id, CASE WHEN item_id % 7 <> 0 AND item_id NOT IN (SELECT item_id FROM t) THEN 'untraced' WHEN {" OR ".join(f"regexp_matches(q, '{p}')" for p in TRANSIENT)} OR {" OR ".join(f"regexp_matches(left(q, 40), '{p}')" for p in TRANSIENT)} THEN 'transient' ELSE 'kept' END AS verdict FROM b""",
    "golden_passages_recall": f"""WITH {_LEX}, b AS (SELECT item_id, {NORM.format("text")} AS item FROM benchmark), d AS (SELECT doc_id, {NORM.format("text")} AS norm FROM documents),
x AS (SELECT item_id, doc_id FROM b JOIN d ON contains(' ' || norm || ' ', ' ' || item || ' ') WHERE len(string_split(item, ' ')) >= 3),
e AS (SELECT x.item_id, count(*) AS n_expected, count(lr.doc_id) AS n_found FROM x LEFT JOIN lr ON lr.query_id = x.item_id AND lr.doc_id = x.doc_id AND lr.rank <= 5 GROUP BY x.item_id)
SELECT item_id, n_expected, n_found, n_found / n_expected AS recall, n_found / n_expected >= 0.8 AS passed FROM e""",
}
