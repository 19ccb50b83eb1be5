"""Tags of chunks: near copies of known boilerplate, near copies within a document, near copies across documents.

One exact similarity join over the different texts serves all three: texts of one shingle set are a
class, and pairs of classes at Jaccard 0.8 or more are found by prefixes. No row is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.functions import text as T
from quarrylake.operators.dedup import class_shingles, jaccard_pairs, line_keys
from quarrylake.operators.graph import components, stored

#: Jaccard from which texts are boilerplate, copies within a document, copies across documents; of bodies under a known header.
BOILERPLATE, WITHIN, ACROSS, HEADER = 0.80, 0.92, 0.95, 0.12
HEADER_GROUPS = 4


def tag_near_copies(lines: DataFrame, reference: DataFrame) -> DataFrame:
    """(doc_id, idx, is_boilerplate, cluster_id, match, dup_within, dup_across, of_doc, of_idx) of every (doc_id, idx, content).

    A chunk is boilerplate if its normalised text is a reference text, or its shingles reach 0.80 of the
    most similar one's (ties: the smaller cluster), or else if its header is that of a text found in
    ``HEADER_GROUPS`` groups, bodies reach 0.12, and it has no signal of its course. The rest that isn't
    empty is compared: within a document components at 0.92 keep their longest content (ties: lowest idx);
    what stays, and has no protected signal, is a copy across documents if a text of another document at
    0.95 has a smaller (doc_id, idx). Blank chunks have no tag. A null content counts as blank.
    """
    # lines move as hashes, lengths and flags; each different text moves once, to be cut into shingles
    filled = lines.select("doc_id", "idx", F.coalesce("content", F.lit("")).alias("content"))
    rows = stored(line_keys(filled), "lines")
    texts = filled.select(T.normalize_text(F.col("content")).alias("text")).filter("text != ''").distinct()
    classes, own = class_shingles(texts.withColumn("key", F.unhex(F.md5("text"))), id_="key", threshold=BOILERPLATE, parities=64)  # (key, class_id)
    pairs = jaccard_pairs(own, BOILERPLATE, id_="key").select("a", "b", (F.col("common") / F.col("union")).alias("score"))
    pairs = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")), "pairs")

    known = reference.select("cluster_id", F.unhex(F.md5("normalized_text")).alias("key"), T.normalize_header(F.col("representative")).alias("header"), "doc_frequency", "distinct_groups")
    known = stored(known.join(classes, "key"), "known")
    near = known.select(F.col("class_id").alias("b"), "cluster_id").join(pairs, "b").select(F.col("a").alias("class_id"), "cluster_id", "score")
    body = known.select("class_id", "cluster_id", F.lit(1.0).alias("score")).unionByName(near)
    best = stored(body.groupBy("class_id").agg(F.min_by("cluster_id", F.struct(-F.col("score"), F.col("cluster_id"))).alias("near_cluster")), "best")
    exact = known.select("key", F.col("cluster_id").alias("exact_cluster"))
    told = classes.join(best, "class_id", "left").join(exact, "key", "left").select("key", "class_id", F.coalesce("exact_cluster", "near_cluster").alias("body"))
    tagged = _by_header(rows.join(told, "key", "left"), known, own)
    match = F.when(F.col("body").isNotNull(), "body").when(F.col("head").isNotNull(), "header")
    tagged = tagged.withColumns({"match": match, "cluster_id": F.coalesce("body", "head")}).withColumn("is_boilerplate", F.col("cluster_id").isNotNull())
    tagged = stored(tagged.select("doc_id", "idx", "chars", "guarded", "class_id", "match", "cluster_id", "is_boilerplate"), "tagged")

    live = tagged.filter(~F.col("is_boilerplate") & F.col("class_id").isNotNull())
    held = live.select("doc_id", "class_id").distinct()
    close = pairs.filter((F.col("score") >= WITHIN) & (F.col("a") < F.col("b")))
    inner = held.withColumnRenamed("class_id", "a").join(close, "a").join(held.withColumnRenamed("class_id", "b"), ["doc_id", "b"])
    node = lambda c: F.concat_ws(":", F.col("doc_id").cast("string"), F.hex(c))
    roots = components(inner.select(node("a").alias("a"), node("b").alias("b")))
    grouped = live.withColumn("node", node("class_id")).join(roots, "node", "left").withColumn("part", F.coalesce("component", "node"))
    first = Window.partitionBy("part").orderBy(F.desc("chars"), "idx")  # a component lies within one document
    grouped = grouped.withColumn("kept_idx", F.first("idx").over(first))
    within = stored(grouped.select("doc_id", "idx", "class_id", "guarded", "kept_idx", (F.col("idx") != F.col("kept_idx")).alias("dup")), "within")

    # of each class the least place, and the least in another document than that
    places = tagged.filter(F.col("class_id").isNotNull()).select("class_id", F.struct("doc_id", "idx").alias("at"))
    least = places.groupBy("class_id").agg(F.min("at").alias("m1"))
    other = places.join(least, "class_id").filter(F.col("at.doc_id") != F.col("m1.doc_id")).groupBy("class_id").agg(F.min("at").alias("m2"))
    seen = stored(least.join(other, "class_id", "left"), "places")
    around = pairs.filter(F.col("score") >= ACROSS).select(F.col("a").alias("class_id"), F.col("b").alias("to")).unionByName(classes.select("class_id", F.col("class_id").alias("to")).distinct())
    met = around.join(seen.withColumnRenamed("class_id", "to"), "to").select("class_id", F.explode(F.array("m1", "m2")).alias("at")).filter(F.col("at").isNotNull())
    m1 = met.groupBy("class_id").agg(F.min("at").alias("m1"))
    m2 = met.join(m1, "class_id").filter(F.col("at.doc_id") != F.col("m1.doc_id")).groupBy("class_id").agg(F.min("at").alias("m2"))
    found = within.join(m1, "class_id").join(m2, "class_id", "left").withColumn("elsewhere", F.when(F.col("m1.doc_id") != F.col("doc_id"), F.col("m1")).otherwise(F.col("m2")))
    across = ~F.col("dup") & ~F.col("guarded") & (F.col("elsewhere") < F.struct("doc_id", "idx"))
    copies = found.select("doc_id", "idx", F.col("dup").alias("dup_within"), F.coalesce(across, F.lit(False)).alias("dup_across"), "kept_idx", "elsewhere")
    out = tagged.select("doc_id", "idx", "is_boilerplate", "cluster_id", "match").join(copies, ["doc_id", "idx"], "left")
    of = F.when(F.col("dup_within"), F.struct("doc_id", F.col("kept_idx").alias("idx"))).when(F.col("dup_across"), F.col("elsewhere"))
    return out.select("doc_id", "idx", "is_boilerplate", "cluster_id", "match", F.coalesce("dup_within", F.lit(False)).alias("dup_within"), F.coalesce("dup_across", F.lit(False)).alias("dup_across"), of["doc_id"].alias("of_doc"), of["idx"].alias("of_idx"))


def _by_header(tagged: DataFrame, known: DataFrame, own: DataFrame) -> DataFrame:
    """Adds ``head``: the cluster whose header a chunk without a body match has, where the bodies are alike enough and nothing tells a course."""
    heads = known.filter((F.col("distinct_groups") >= HEADER_GROUPS) & (F.col("header") != ""))
    heads = heads.groupBy("header").agg(F.max_by(F.struct("cluster_id", "class_id"), F.struct("doc_frequency", "cluster_id")).alias("h"))
    heads = stored(heads.select(F.unhex(F.md5("header")).alias("header"), F.col("h.cluster_id").alias("cluster"), F.col("h.class_id").alias("of")), "heads")
    asks = F.col("body").isNull() & F.col("class_id").isNotNull() & ~F.col("course")
    tagged = stored(tagged.select("doc_id", "idx", "chars", "guarded", "class_id", "body", F.when(asks, F.coalesce("header", "key")).alias("header")), "headers")
    met = stored(tagged.filter(F.col("header").isNotNull()).select("class_id", "header").join(heads, "header").distinct(), "met")
    if met.isEmpty():  # no set moves for nothing
        return tagged.withColumn("head", F.lit(None).cast("string"))
    sets = own.select(F.col("key").alias("class_id"), "s")
    both = met.join(sets.withColumnRenamed("s", "s1"), "class_id").join(sets.select(F.col("class_id").alias("of"), F.col("s").alias("s2")), "of")
    alike = both.filter(T.jaccard(F.col("s1"), F.col("s2")) >= HEADER).select("class_id", "header", F.col("cluster").alias("head"))
    return tagged.join(alike, ["class_id", "header"], "left")
