"""Tracing of items to texts and similarity by longest blocks, against plain versions and the standard library."""

from __future__ import annotations

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quarrylake.operators import traces
from quarrylake.plans import texts as texts_plan


def letters(rng, n, of="abcdeé \n"):
    return "".join(rng.choices(of, k=n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    docs = [letters(rng, rng.randint(0, 400)) for _ in range(40)] + ["", None, "x" * 300, letters(rng, 3_000)]
    contexts = []
    for i in range(60):
        text = rng.choice([d for d in docs if d and len(d) > 120])
        at = rng.randrange(len(text) - 60)
        piece = text[at : at + rng.randint(40, 120)]
        contexts.append((i, rng.choice(["", "zz ", "   "]) + piece[: rng.randint(20, 120)] + rng.choice(["", " \n", "q" * 30])))
    return docs, [*contexts, (100, "x" * 50), (101, "x" * 301), (102, "y" * 50), (103, letters(rng, 600))]


def windows(context):
    clean = context.strip()
    return [w for s in range(0, max(1, len(clean) - 50), 25) if len(w := clean[s : s + 50]) >= 50]


@pytest.mark.parametrize("piece", [50_000, 70])
def test_verbatim_windows_equal_a_plain_search(spark, corpus, monkeypatch, piece):
    monkeypatch.setattr(traces, "_PIECE", piece)
    docs, contexts = corpus
    got = traces.verbatim(spark.createDataFrame(contexts, "id long, context string"), spark.createDataFrame([(d,) for d in docs], "text string"))
    want = {i for i, c in contexts if any(w in (d or "") for w in windows(c) for d in docs)}
    assert {r["id"] for r in got.collect()} == want and 5 < len(want) < len(contexts) - 5


def test_anchors_of_pieces_are_those_of_the_whole(monkeypatch):
    text = letters(random.Random(1), 2_000) + "z" * 500
    whole = list(traces._anchors(text))
    monkeypatch.setattr(traces, "_PIECE", 33)
    assert list(traces._anchors(text)) == whole
    assert list(traces._anchors(text[:49])) == []


def test_letter_ratio_equals_the_librarys_quick_ratio(spark, corpus):
    docs, contexts = corpus
    whole = "\n\n".join(d or "" for d in docs)
    frame = spark.createDataFrame(docs and [(d,) for d in docs], "text string")
    counts = traces.letter_counts(frame)
    assert {r["letter"]: r["n"] for r in counts.collect()} == dict(Counter(whole))
    got = {r["id"]: r["ratio"] for r in traces.letter_ratio(spark.createDataFrame(contexts, "id long, context string"), counts).collect()}
    want = {i: SequenceMatcher(None, c[:500], whole).quick_ratio() for i, c in contexts}
    assert all(abs(got.get(i, 0.0) - r) < 1e-12 for i, r in want.items())


def test_block_ratio_equals_the_library(spark):
    rng = random.Random(7)
    pairs = []
    for i in range(120):
        a = letters(rng, rng.randint(0, 300))
        b = list(a)
        for _ in range(rng.randint(0, 80)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abcxyz")) if rng.random() < 0.5 or not b else b.pop(rng.randrange(len(b)))
        pairs.append((i, a, "".join(b)))
    pairs += [(500, "", ""), (501, "a", ""), (502, None, "a"), (503, "ab" * 200, "ba" * 200)]
    frame = spark.createDataFrame(pairs, "id long, a string, b string")
    want = {i: None if a is None else SequenceMatcher(None, a, b).ratio() for i, a, b in pairs}
    assert {r["id"]: r["r"] for r in frame.select("id", traces.block_ratio(F.col("a"), F.col("b")).alias("r")).collect()} == want
    some = {r["id"]: r["r"] for r in frame.select("id", traces.block_ratio(F.col("a"), F.col("b"), 0.8).alias("r")).collect()}
    assert some == {i: r if r is not None and r >= 0.8 else None for i, r in want.items()}


def test_verdicts(spark):
    text = "the grading of this course rests on four papers, a talk and a final project of your own choice"
    items = [
        (1, [text[3:80]], "single_hop", "What counts?", "papers"), (2, ["nothing of that kind was ever written in any of these texts, by anyone at all"], "single_hop", "q", "a"),
        (3, ["made up"], "Multi_Hop_Abstract_X", "q", "a"), (4, [], "single_hop", "q", "a"), (5, None, "single_hop", "q", "a"), (6, [text[3:80]], None, "What is due by Friday, May 1?", None),
        (7, [None, " ", text], "x", None, "T 10/6"), (8, [None, " "], "x", None, None),
    ]
    frame = spark.createDataFrame(items, "item_id long, contexts array<string>, kind string, question string, answer string")
    got = {r["item_id"]: r["verdict"] for r in traces.validated(frame, spark.createDataFrame([(text,), ("other " * 400,)], "text string")).collect()}
    assert got == {1: "kept", 2: "untraced", 3: "kept", 4: "empty", 5: "empty", 6: "transient", 7: "transient", 8: "untraced"}
    none = spark.createDataFrame([], "text string")
    assert {r["verdict"] for r in traces.validated(frame.filter("item_id = 1"), none).collect()} == {"untraced"}


def test_stable_turns_equal_the_library(spark, small_dir):
    turns = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{small_dir}/conversations.parquet").collect()}
    rows = texts_plan.stable_turns(spark, small_dir).collect()
    assert rows and any(r["similarity"] is not None for r in rows)
    last = {}
    for conv, turn in sorted(turns):
        last[conv, turn] = last.get(conv)
        last[conv] = turns[conv, turn]
    for r in rows:
        ratio = SequenceMatcher(None, last[r["conv_id"], r["turn"]], turns[r["conv_id"], r["turn"]]).ratio()
        assert r["similarity"] == (round(ratio, 6) if ratio >= 0.1 else None)
