"""Retrieval queries over embeddings, documents and benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.functions import stems
from quarrylake.operators import retrieval as R
from quarrylake.operators import search
from quarrylake.plans.tables import NORM, VECTOR_RANKED, WORDS, benchmark_queries, table, vector_queries

K = 20
SWEEP = (20, 40, 60, 80, 100)
#: Weights of a document's header and body.
HEADER, BODY = 1.0, 0.4


def _vector(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """(query_id, vec_id, rank, score, label) of the k rows nearest to each query of the stated set."""
    rows = table(spark, sf_dir, "embeddings")
    found = R.vector_topk(rows, vector_queries(rows), k)
    return found.join(rows.select("vec_id", "label"), "vec_id")


def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector(spark, sf_dir).select("query_id", "vec_id", "rank")


def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter is applied before ranking: only rows of the query's own label take part."""
    rows = table(spark, sf_dir, "embeddings")
    return R.vector_topk(rows, vector_queries(rows), 10, within="label").select("query_id", "vec_id", "rank")


def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lexical_overlap_topk(table(spark, sf_dir, "documents"), benchmark_queries(table(spark, sf_dir, "benchmark")), K)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.build(table(spark, sf_dir, "documents"), {"text": 1.0}, stems=False)
    return search.search(index, benchmark_queries(table(spark, sf_dir, "benchmark")), K).select("query_id", "doc_id", "rank")


def weighted_text_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text search with stems: a document's first sentence is its header, which counts two and a half times its body."""
    docs = table(spark, sf_dir, "documents")
    header = F.substring_index("text", ".", 1)
    parted = docs.select("doc_id", header.alias("header"), F.substring(F.col("text"), F.length(header) + 1, F.length("text")).alias("body"))
    index = search.build(parted, {"header": HEADER, "body": BODY})
    return search.search(index, benchmark_queries(table(spark, sf_dir, "benchmark")), K).select("query_id", "doc_id", "rank")


def hybrid_rrf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector and lexical arms of the queries that share an id, or have one arm alone, fused; ids of both arms are taken as one id space."""
    vector = _vector(spark, sf_dir).select("query_id", F.col("vec_id").alias("id"), "rank")
    lexical = lexical_topk(spark, sf_dir).select("query_id", F.col("doc_id").alias("id"), "rank")
    return R.hybrid(vector, lexical, 10)


def rrf_multi_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All label queries' lists fused into one ranking."""
    lists = _vector(spark, sf_dir, 200).select(F.col("vec_id").alias("id"), "rank", F.col("query_id").alias("list_no"))
    return R.rrf(lists, final_k=50).select("id", "fused_rank", "rrf_score", F.size("lists").alias("n_lists"))


def rrf_k_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fusion constant really takes each value of the sweep; each gives its own top ten. The lists are made once."""
    lists = _vector(spark, sf_dir, 200).select(F.col("vec_id").alias("id"), "rank", F.col("query_id").alias("list_no"), F.explode(F.array(*map(F.lit, SWEEP))).alias("k"))
    return R.rrf(lists, k=F.col("k"), final_k=10, by=("k",)).select("k", "id", "fused_rank")


def _billionths(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def knee_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.knee(_billionths(_vector(spark, sf_dir)), ["query_id"]).select("query_id", "vec_id", "rank")


def score_threshold_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.score_floor(_billionths(_vector(spark, sf_dir)), ["query_id"], 0.35, 2).select("query_id", "vec_id", "rank")


def cap_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cap_per_group(_vector(spark, sf_dir, 100), "label", 4, ["query_id"]).select("query_id", "label", "vec_id", "rank")


def dedup_first_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best rank of each row over all queries' lists."""
    lists = _vector(spark, sf_dir, 100).select("vec_id", "query_id", (F.col("rank").cast("long") * 1_000_000_000 + F.col("query_id")).alias("rank"))
    return R.first_ranked(lists, ["vec_id"])


def stratified_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stratified(_vector(spark, sf_dir, 100), "label", 25, ["query_id"]).select("query_id", "vec_id", "label", "rank", "pos")


def context_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.context_order(_vector(spark, sf_dir, 10), ["query_id"]).select("query_id", "vec_id", "rank", "place")


def source_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fused rows each arm gave, per query."""
    each = F.count_if
    return hybrid_rrf_topk(spark, sf_dir).groupBy("query_id").agg(
        each(F.col("rrf_source") == "vector").alias("vector_only"), each(F.col("rrf_source") == "bm25").alias("bm25_only"), each(F.col("rrf_source") == "both").alias("both"), F.count(F.lit(1)).alias("total")
    )


QUERIES = {f.__name__: f for f in (vector_topk_batch, vector_topk_filtered, lexical_topk, bm25_topk, weighted_text_topk, hybrid_rrf_topk, rrf_multi_list, rrf_k_sweep, knee_cut, score_threshold_floor, cap_per_group, dedup_first_ranked, stratified_select, context_reorder, source_tally)}

_LEX = f"""
lq AS (SELECT item_id AS query_id, text FROM benchmark),
lt AS (SELECT DISTINCT query_id, unnest({WORDS.format("text")}) AS term FROM lq),
dt AS (SELECT DISTINCT doc_id, unnest({WORDS.format("text")}) AS term FROM documents),
ls AS (SELECT query_id, doc_id, count(*) AS score FROM dt JOIN lt USING (term) GROUP BY ALL),
lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM ls)"""
_HYBRID = f"""WITH {VECTOR_RANKED}, {_LEX},
a AS (SELECT query_id, vec_id AS id, rank, 0 AS list_no FROM vr WHERE rank <= {K} UNION ALL SELECT query_id, doc_id, rank, 1 FROM lr WHERE rank <= {K}),
g AS (SELECT query_id, id, sum(round(1e12 / (60 + rank))::BIGINT) AS units, min(list_no * 1000000 + rank) AS seen, bool_or(list_no = 0) AS v, bool_or(list_no = 1) AS l FROM a GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY units DESC, seen)::INTEGER AS fused_rank FROM g),
h AS (SELECT query_id, id, fused_rank, units::DOUBLE / 1e12 AS rrf_score, CASE WHEN v AND l THEN 'both' WHEN v THEN 'vector' ELSE 'bm25' END AS rrf_source FROM r WHERE fused_rank <= 10)"""


def _fused(k: int, n: int) -> str:
    return f"""(SELECT id, n_lists, units, row_number() OVER (ORDER BY units DESC, seen)::INTEGER AS fused_rank FROM (
  SELECT vec_id AS id, count(DISTINCT query_id)::INTEGER AS n_lists, sum(round(1e12 / ({k} + rank))::BIGINT) AS units, min(query_id * 1000000 + rank) AS seen FROM vr WHERE rank <= 200 GROUP BY vec_id)
  QUALIFY fused_rank <= {n})"""


ORACLES = {
    "vector_topk_batch": f"WITH {VECTOR_RANKED} SELECT query_id, vec_id, rank FROM vr WHERE rank <= {K}",
    "vector_topk_filtered": f"WITH {VECTOR_RANKED} SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM vs WHERE label = asked QUALIFY rank <= 10",
    "lexical_topk": f"WITH {_LEX} SELECT query_id, doc_id, rank, score FROM lr WHERE rank <= {K}",
    "bm25_topk": f"""WITH lq AS (SELECT item_id AS query_id, text FROM benchmark),
lt AS (SELECT DISTINCT query_id, unnest({WORDS.format("text")}) AS term FROM lq),
d AS (SELECT doc_id, {WORDS.format("text")} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS al FROM d),
x AS (SELECT doc_id, len(t) AS ln, unnest(t) AS term FROM d),
tf AS (SELECT doc_id, ln, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM lt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT doc_id, term, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * tf.ln / al)) * 1e9)::BIGINT AS w FROM tf JOIN df USING (term), st),
s AS (SELECT query_id, doc_id, sum(w) AS score FROM w JOIN lt USING (term) GROUP BY ALL)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s QUALIFY rank <= {K}""",
    "weighted_text_topk": f"""WITH d AS (SELECT doc_id, text, split_part(text, '.', 1) AS header FROM documents),
x AS (SELECT doc_id, {HEADER}::DOUBLE AS w, unnest({stems.search_terms_sql("header", WORDS)}) AS word FROM d
  UNION ALL SELECT doc_id, {BODY}::DOUBLE, unnest({stems.search_terms_sql("substr(text, length(header) + 1)", WORDS)}) FROM d),
tf AS (SELECT doc_id, {stems.stem_sql("word")} AS term, sum(w) AS tf FROM x GROUP BY ALL),
ln AS (SELECT doc_id, sum(tf) AS ln FROM tf GROUP BY doc_id), st AS (SELECT (SELECT count(*) FROM documents) AS n, sum(ln) AS total FROM ln),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT doc_id, term, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * ln.ln / (total / n))) * 1e9)::BIGINT AS w FROM tf JOIN df USING (term) JOIN ln USING (doc_id), st),
lt AS (SELECT DISTINCT query_id, {stems.stem_sql("word")} AS term FROM (SELECT item_id AS query_id, unnest({stems.search_terms_sql("text", WORDS)}) AS word FROM benchmark)),
s AS (SELECT query_id, doc_id, sum(w) AS score FROM w JOIN lt USING (term) GROUP BY ALL)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s QUALIFY rank <= {K}""",
    "hybrid_rrf_topk": f"{_HYBRID} SELECT * FROM h",
    "source_tally": f"{_HYBRID} SELECT query_id, count(*) FILTER (rrf_source = 'vector') AS vector_only, count(*) FILTER (rrf_source = 'bm25') AS bm25_only, count(*) FILTER (rrf_source = 'both') AS both, count(*) AS total FROM h GROUP BY query_id",
    "rrf_multi_list": f"WITH {VECTOR_RANKED} SELECT id, fused_rank, units::DOUBLE / 1e12 AS rrf_score, n_lists FROM {_fused(60, 50)}",
    "rrf_k_sweep": f"WITH {VECTOR_RANKED} " + " UNION ALL ".join(f"SELECT {k} AS k, id, fused_rank FROM {_fused(k, 10)}" for k in SWEEP),
    "knee_cut": f"""WITH {VECTOR_RANKED}, t AS (SELECT query_id, vec_id, rank, round(score, 6) AS score FROM vr WHERE rank <= {K}),
g AS (SELECT *, CASE WHEN rank >= 2 THEN score - lead(score) OVER (PARTITION BY query_id ORDER BY rank) END AS g FROM t),
c AS (SELECT query_id, coalesce(min(rank) FILTER (g > 0.15), arg_max(rank, g * 1e9 - rank) FILTER (g > 0.05)) AS cut FROM g GROUP BY query_id)
SELECT query_id, vec_id, rank FROM g JOIN c USING (query_id) WHERE cut IS NULL OR rank <= cut""",
    "score_threshold_floor": f"""WITH {VECTOR_RANKED}, t AS (SELECT query_id, vec_id, rank, round(score, 6) AS score FROM vr WHERE rank <= {K}),
n AS (SELECT *, count(*) FILTER (score >= 0.35) OVER (PARTITION BY query_id) AS n FROM t)
SELECT query_id, vec_id, rank FROM n WHERE CASE WHEN n >= 2 THEN score >= 0.35 ELSE rank <= 2 END""",
    "cap_per_group": f"WITH {VECTOR_RANKED} SELECT query_id, label, vec_id, rank FROM vr WHERE rank <= 100 QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY rank) <= 4",
    "dedup_first_ranked": f"WITH {VECTOR_RANKED} SELECT vec_id, arg_min(query_id, rank::BIGINT * 1000000000 + query_id) AS query_id, min(rank::BIGINT * 1000000000 + query_id) AS rank FROM vr WHERE rank <= 100 GROUP BY vec_id",
    "stratified_select": f"""WITH {VECTOR_RANKED}, t AS (SELECT query_id, vec_id, label, rank FROM vr WHERE rank <= 100),
s AS (SELECT *, min(rank) OVER (PARTITION BY query_id, label) AS f, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS nth FROM t),
n AS (SELECT query_id, count(DISTINCT label) AS g FROM t GROUP BY query_id)
SELECT query_id, vec_id, label, rank, row_number() OVER (PARTITION BY query_id ORDER BY f, rank)::INTEGER AS pos FROM s JOIN n USING (query_id) WHERE nth <= ceil(25.0 / g) QUALIFY pos <= 25""",
    "context_reorder": f"""WITH {VECTOR_RANKED}, t AS (SELECT query_id, vec_id, rank, max(rank) OVER (PARTITION BY query_id) AS n FROM vr WHERE rank <= 10)
SELECT query_id, vec_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank = 2 THEN n + 1 ELSE rank END)::INTEGER AS place FROM t""",
}
