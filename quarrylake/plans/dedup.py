"""Duplicate and boilerplate queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.functions import text as T
from quarrylake.operators import dedup as D
from quarrylake.operators.graph import scratch
from quarrylake.operators.signatures import SignatureIndex
from quarrylake.operators.tagging import tag_near_copies
from quarrylake.plans.tables import NORM, WORDS, table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("source").alias("group"), F.posexplode(F.split("text", "\n")).alias("idx", "content"))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = T.normalize_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(norm).alias("digest"), F.length(norm).alias("n"), T.token_estimate(F.col("text")).alias("tokens"))


def content_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.content_tokens(F.col("text"))).alias("n_tokens"))


def word_ngrams_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word 5-grams by the number of documents that hold them, those of several documents."""
    return D.shared_grams(table(spark, sf_dir, "documents"), 5)


def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.exact_groups(table(spark, sf_dir, "documents"))


def jaccard_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different shingle sets at 0.8 or more, by their classes' least documents."""
    _, own = D.class_shingles(table(spark, sf_dir, "documents"))
    return D.jaccard_pairs(own, 0.8)


def shingle_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which class of equal shingle sets each document is of: the members that the pairs of classes stand for."""
    return D.class_shingles(table(spark, sf_dir, "documents"))[0]


def dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.near_duplicates(table(spark, sf_dir, "documents"), 0.8)


def cross_source_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document with a copy elsewhere, the least (source, doc_id) of its copies."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(T.normalize_text(F.col("text")), 256).alias("key"))
    groups = keyed.groupBy("key").agg(F.min(F.struct("source", "doc_id")).alias("c"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keyed.join(groups, "key").filter(F.struct("source", "doc_id") != F.col("c")).select("doc_id", F.col("c.doc_id").alias("canonical"))


def boilerplate_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.boilerplate_reference(_lines(spark, sf_dir))


def three_pass_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return D.tag_lines(lines, D.boilerplate_reference(lines))


def near_copy_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, tagged as near copies of boilerplate, of lines of their document, of lines of others."""
    lines = _lines(spark, sf_dir)
    return tag_near_copies(lines, D.boilerplate_reference(lines))


def minhash_lsh_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes at Jaccard 0.8 or more; ``shingle_classes`` tells their members."""
    _, own = D.class_shingles(table(spark, sf_dir, "documents"))
    return D.lsh_pairs(own.select("doc_id", "s"))


def signature_index_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in two batches, the lower ids first, through a stored signature index: the pairs of both batches are those of all."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    low, high = docs.agg(F.min("id"), F.max("id")).first()
    place = scratch(spark, "index")
    index = SignatureIndex(spark, f"signatures_{place[-12:]}", place, buckets=8)
    middle = ((low or 0) + (high or 0)) // 2
    pairs = [index.add(part, F.col("source")) for part in (docs.filter(F.col("id") <= middle), docs.filter(F.col("id") > middle))]
    index.drop()
    return pairs[0].unionByName(pairs[1])


def embedding_greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.greedy_similar(table(spark, sf_dir, "embeddings"), "label", 0.85)


QUERIES = {f.__name__: f for f in (normalize_text, content_tokens, word_ngrams_df, exact_dup_groups, jaccard_near_dups, shingle_classes, dup_components, cross_source_canonical, boilerplate_reference, three_pass_tagging, near_copy_tagging, minhash_lsh_pairs, signature_index_pairs, embedding_greedy_dedup)}

_N = NORM.format("text")
_FOLD = f"regexp_replace({_N}, 'ffi|ffl|ff|fi|fl|[ﬀ-ﬄ]', 'f', 'g')"
_SETS = f"""w AS (SELECT doc_id, list_filter(string_split({_FOLD}, ' '), lambda x: x <> '') AS t FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS g FROM w),
st AS (SELECT doc_id, md5(string_agg(g, chr(1) ORDER BY g)) AS k, count(*) AS n FROM sh GROUP BY doc_id),
cl AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id, n FROM st),
o AS (SELECT sh.doc_id, g, n FROM sh JOIN cl ON sh.doc_id = cl.doc_id AND cl.class_id = cl.doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*)::INTEGER AS common, any_value(x.n + y.n)::INTEGER AS s FROM o x JOIN o y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
j AS (SELECT a, b, common, s - common AS "union" FROM p WHERE common >= 0.8 * (s - common))"""
_LINES = f"l AS (SELECT doc_id, source AS grp, idx - 1 AS idx, content FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS idx FROM documents)), n AS (SELECT *, {NORM.format('content')} AS norm FROM l)"
_REF = "f AS (SELECT norm, count(DISTINCT doc_id) AS df, count(DISTINCT grp) AS dg, min(content) AS rep FROM n WHERE norm <> '' GROUP BY norm), r AS (SELECT 'bp_' || sha256(norm)[1:16] AS cluster_id, norm, df, dg, rep FROM f WHERE df >= 5 AND dg >= 3)"
ORACLES = {
    "normalize_text": f"SELECT doc_id, md5({_N}) AS digest, length({_N})::INTEGER AS n, round_even(length(text) / 4.0, 0)::BIGINT AS tokens FROM documents",
    "content_tokens": "SELECT doc_id, len(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9./:@_+#-]{3,}'), lambda t: regexp_replace(lower(t), '^[./:-]+|[./:-]+$', '', 'g')), lambda t: length(t) >= 4)))::INTEGER AS n_tokens FROM documents",
    "word_ngrams_df": f"WITH w AS (SELECT doc_id, {WORDS.format('text')} AS t FROM documents), g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) ELSE [] END) AS gram FROM w) SELECT gram, count(*) AS df FROM g GROUP BY gram HAVING count(*) > 1",
    "exact_dup_groups": f"SELECT 'bp_' || sha256({_N})[1:16] AS cluster_id, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY {_N} HAVING count(*) > 1",
    "jaccard_near_dups": f'WITH {_SETS} SELECT a, b, common, "union" FROM j',
    "minhash_lsh_pairs": f'WITH {_SETS} SELECT a, b, common, "union" FROM j',
    "signature_index_pairs": f'WITH {_SETS} SELECT a, b, common, "union" FROM j',
    "shingle_classes": f"WITH {_SETS} SELECT doc_id, class_id FROM cl",
    "dup_components": f"""WITH RECURSIVE {_SETS}, e AS (SELECT a, b FROM j UNION ALL SELECT b, a FROM j),
c(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, c.root FROM c JOIN e ON c.node = e.a),
m AS (SELECT node, min(root) AS component FROM c GROUP BY node), dg AS (SELECT a AS node, count(*) AS n FROM e GROUP BY a)
SELECT cl.doc_id, coalesce(m.component, cl.class_id) AS component_id, coalesce(dg.n, 0) AS n_links FROM cl LEFT JOIN m ON m.node = cl.class_id LEFT JOIN dg ON dg.node = cl.class_id""",
    "cross_source_canonical": f"WITH k AS (SELECT doc_id, source, {_N} AS key FROM documents), g AS (SELECT key, min({{'s': source, 'd': doc_id}}) AS c, count(*) AS n FROM k GROUP BY key HAVING count(*) > 1) SELECT doc_id, c.d AS canonical FROM k JOIN g USING (key) WHERE doc_id <> c.d",
    "boilerplate_reference": f"WITH {_LINES}, {_REF} SELECT cluster_id, norm AS normalized_text, df AS doc_frequency, dg AS distinct_groups, rep AS representative FROM r",
    "near_copy_tagging": rf"""WITH RECURSIVE {_LINES}, {_REF},
x AS (SELECT norm, md5(norm) AS key, list_filter(string_split(regexp_replace(norm, 'ffi|ffl|ff|fi|fl|[ﬀ-ﬄ]', 'f', 'g'), ' '), lambda w: w <> '') AS t FROM (SELECT DISTINCT norm FROM n WHERE norm <> '')),
sh AS (SELECT DISTINCT key, unnest(CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) ELSE [array_to_string(t, ' ')] END) AS g FROM x),
st AS (SELECT key, md5(string_agg(g, chr(1) ORDER BY g)) AS k, count(*) AS n FROM sh GROUP BY key), cl AS (SELECT key, min(key) OVER (PARTITION BY k) AS cls, n FROM st),
ow AS (SELECT sh.key, g, n FROM sh JOIN cl ON sh.key = cl.key AND cls = cl.key),
pp AS (SELECT p.key AS a, q.key AS b, count(*) AS c, any_value(p.n + q.n) AS s FROM ow p JOIN ow q ON p.g = q.g AND p.key < q.key GROUP BY ALL),
pr AS MATERIALIZED (SELECT a, b, c / (s - c) AS score FROM pp WHERE c >= 0.8 * (s - c) - 1e-9 UNION ALL SELECT b, a, c / (s - c) FROM pp WHERE c >= 0.8 * (s - c) - 1e-9),
kn AS (SELECT cluster_id, cls, md5(r.norm) AS key FROM r JOIN cl ON cl.key = md5(r.norm)),
bo AS (SELECT cls, cluster_id, 1.0::DOUBLE AS score FROM kn UNION ALL SELECT pr.a, cluster_id, pr.score FROM kn JOIN pr ON pr.b = kn.cls),
be AS (SELECT cls, cluster_id FROM bo QUALIFY row_number() OVER (PARTITION BY cls ORDER BY score DESC, cluster_id) = 1),
t AS MATERIALIZED (SELECT n.doc_id, n.idx::INTEGER AS idx, n.content, cl.cls, coalesce(kn.cluster_id, be.cluster_id) AS cluster_id FROM n LEFT JOIN cl ON n.norm <> '' AND cl.key = md5(n.norm) LEFT JOIN be ON be.cls = cl.cls LEFT JOIN kn ON kn.key = cl.key),
lv AS (SELECT * FROM t WHERE cls IS NOT NULL AND cluster_id IS NULL), dc AS (SELECT DISTINCT doc_id, cls FROM lv),
ed AS (SELECT p.doc_id, p.cls AS a, q.cls AS b FROM dc p JOIN pr ON pr.a = p.cls AND pr.score >= 0.92 JOIN dc q ON q.doc_id = p.doc_id AND q.cls = pr.b),
co(doc_id, cls, root) AS (SELECT doc_id, cls, cls FROM dc UNION SELECT ed.doc_id, ed.b, co.root FROM co JOIN ed ON ed.doc_id = co.doc_id AND ed.a = co.cls),
rt AS (SELECT doc_id, cls, min(root) AS root FROM co GROUP BY ALL),
wi AS (SELECT lv.*, first_value(idx) OVER (PARTITION BY doc_id, root ORDER BY length(content) DESC, idx) AS kept FROM lv JOIN rt USING (doc_id, cls)),
nb AS (SELECT a AS cls, b AS other FROM pr WHERE score >= 0.95 UNION SELECT cls, cls FROM cl), pl AS (SELECT cls AS other, doc_id AS d, idx AS i FROM t WHERE cls IS NOT NULL),
el AS (SELECT wi.doc_id, wi.idx, min({{'d': d, 'i': i}}) AS m FROM wi JOIN nb USING (cls) JOIN pl USING (other) WHERE d <> wi.doc_id GROUP BY ALL),
z AS (SELECT wi.doc_id, wi.idx, kept, idx <> kept AS dw, m, coalesce(idx = kept AND m < {{'d': wi.doc_id, 'i': wi.idx}} AND NOT regexp_matches(content, '\b\d{{1,3}}(?:\.\d+)?\s*%') AND NOT regexp_matches(content, '(?i)https?://\S+|\bwww\.\S+|\b(?:due|deadline|submitted by)\b'), false) AS da FROM wi LEFT JOIN el USING (doc_id, idx))
SELECT t.doc_id, t.idx, t.cluster_id IS NOT NULL AS is_boilerplate, t.cluster_id, CASE WHEN t.cluster_id IS NOT NULL THEN 'body' END AS match, coalesce(dw, false) AS dup_within, coalesce(da, false) AS dup_across,
  CASE WHEN dw THEN t.doc_id WHEN da THEN m.d END AS of_doc, CASE WHEN dw THEN kept WHEN da THEN m.i END AS of_idx FROM t LEFT JOIN z USING (doc_id, idx)""",
    "three_pass_tagging": rf"""WITH {_LINES}, {_REF},
s AS (SELECT *, CASE WHEN regexp_matches(content, '\b\d{{1,3}}(\.\d+)?\s?%') THEN 'percent' WHEN regexp_matches(content, '(?i)\b(due|deadline)\b[^\n]{{0,40}}\d') THEN 'due_date' END AS sig, regexp_matches(content, 'https?://[^\s)>\]]+') AS url FROM n),
t AS (SELECT s.doc_id, s.idx, s.norm, content, sig, url, cluster_id, cluster_id IS NOT NULL AND sig IS NULL AS bp FROM s LEFT JOIN r USING (norm)),
u AS (SELECT *, NOT bp AND norm <> '' AND row_number() OVER (PARTITION BY doc_id, CASE WHEN NOT bp AND norm <> '' THEN norm ELSE chr(1) || idx END ORDER BY length(content) DESC, idx) > 1 AS inner_dup FROM t),
o AS (SELECT norm, min({{'d': doc_id, 'i': idx}}) AS org FROM u WHERE NOT bp AND norm <> '' AND NOT inner_dup GROUP BY norm)
SELECT doc_id, idx::INTEGER AS idx, bp AS is_boilerplate, CASE WHEN bp THEN cluster_id END AS cluster_id, inner_dup AS dup_within,
  coalesce(NOT bp AND norm <> '' AND NOT inner_dup AND {{'d': doc_id, 'i': idx}} > org AND sig IS NULL AND NOT url, false) AS dup_across FROM u LEFT JOIN o USING (norm)""",
}
