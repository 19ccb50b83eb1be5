"""Text search over the inverted index, against scoring everything."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrylake.functions.stems import stem
from quarrylake.operators import search


def plain(docs, queries, k, weights, k1=1.2, b=0.75):
    tf = {d: Counter() for d, *_ in docs}
    for d, *texts in docs:
        for text, w in zip(texts, weights, strict=True):
            for word in (text or "").split():
                tf[d][word] += w
    n, total = len(docs), sum(sum(t.values()) for t in tf.values())
    df = Counter(w for t in tf.values() for w in t)
    out = []
    for q, text in queries:
        scores = Counter()
        for d, t in tf.items():
            length = sum(t.values())
            for w in set((text or "").split()) & set(t):
                scores[d] += round(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t[w] * (k1 + 1) / (t[w] + k1 * (1 - b + b * length / (total / n))) * 1e9)
        out += [(q, d, i, s) for i, (d, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return sorted(out)


def corpus(n=600):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights, k=3)), " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))) for i in range(n)]
    docs += [(n + i, docs[7][1], docs[7][2]) for i in range(30)] + [(n + 50, None, None), (n + 51, "", "w1")]
    queries = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 7)) + rng.choices(words, k=2))) for i in range(25)] + [(90, ""), (91, None), (92, "unknown"), (93, "w0"), (94, "w0 w1 w2 w299")]
    return docs, queries


@pytest.mark.parametrize(("block", "seeds"), [(8, 10), (128, 4_096), (16, 1)])
def test_search_equals_scoring_all(spark, monkeypatch, block, seeds):
    monkeypatch.setattr(search, "BLOCK_DOCS", block)
    docs, queries = corpus()
    index = search.build(spark.createDataFrame(docs, "doc_id long, header string, body string"), {"header": 1.0, "body": 0.5}, stems=False)
    asked = spark.createDataFrame(queries, "query_id long, text string")
    some = search.candidates(index, asked, 5, seeds)
    rows = search.rank_by(some, ["query_id"], [F.desc("score"), F.col("doc_id")], 5).collect()
    assert sorted((r["query_id"], r["doc_id"], r["rank"], r["score"]) for r in rows) == plain(docs, queries, 5, (1.0, 0.5))


def test_candidates_are_few(spark):
    docs, queries = corpus(3_000)
    index = search.build(spark.createDataFrame(docs, "doc_id long, header string, body string"), {"header": 1.0, "body": 0.5}, stems=False)
    asked = spark.createDataFrame([q for q in queries if q[0] == 94], "query_id long, text string")
    matching = len({d for d, *texts in docs if {"w0", "w1", "w2", "w299"} & set(" ".join(t or "" for t in texts).split())})
    assert search.candidates(index, asked, 5, 300).count() * 4 < matching


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, header string")
    index = search.build(docs, {"header": 1.0})
    assert search.search(index, spark.createDataFrame([(1, "a word")], "query_id long, text string"), 3).collect() == []


def test_stems(spark):
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "caress": "caress", "agreed": "agree", "feed": "feed", "plastered": "plaster", "motoring": "motor", "sing": "sing", "created": "create", "hopping": "hop", "happy": "happi", "sky": "sky", "sizing": "size", "troubled": "trouble"}
    rows = spark.createDataFrame([(w,) for w in pairs], "w string").select("w", stem(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in rows} == pairs
