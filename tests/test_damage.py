"""Damage of bar tables against a plain reading, and what an index moves."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from quarrylake.functions import tables
from quarrylake.operators import search

BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def plain_cells(text):
    held = [r for r in re.split(BREAK, text) if r.lstrip(" ").startswith("|") and not ("-" in r and re.search(r"^\|*\s*(?:(?:[:-]*-[:-]*)?\s*(?:\|\s*|$))+$", r.strip(" "), re.A))]
    return [c for r in held for c in re.split(r"[ \t]*\|[ \t]*", re.sub(r"^\|+[ \t]*|[ \t]*\|+$", "", r.strip(" ")))]


def test_empty_cells_are_seen_wherever_they_stand(spark):
    rng = random.Random(4)
    pieces = ["|", "| ", " |", "a", "bb", " ", "\t", "\n", "\n| ", "|\n", "\r\n", "\x0b", "\x0c", "||", "| |", "|\t", "| --- |", " | "]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 14))) for _ in range(1500)] + ["|", "| |", "| a |\t", "| a |\n|", "", "| a | b |\n| c | d |"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    t = F.col("t")
    judged = tables.judged(t, F.lit(None).cast("array<array<string>>"), F.lit(None).cast("string"))
    got = {r["i"]: tuple(r)[1:] for r in frame.select("i", tables.empty_ratio(t), tables.longest_empty(t), tables.is_degenerate(t), judged["degenerate"]).collect()}
    for i, text in enumerate(texts):
        found = plain_cells(text)
        run = max([len(x) for x in "".join("e" if c == "" else " " for c in found).split()], default=0)
        ratio = found.count("") / len(found) if found else 0.0
        bad = len(found) >= 6 and (run >= 8 or ratio > 0.6)
        assert got[i] == (ratio, run, bad, bad), (text, found)
    assert sum(v[2] for v in got.values()) > 5


def test_an_index_moves_texts_once_and_not_their_words(spark, monkeypatch):
    plans = []
    held = search.stored
    monkeypatch.setattr(search, "stored", lambda df, label: (plans.append((label, df._jdf.queryExecution().executedPlan().toString())), held(df, label))[1])
    docs = spark.createDataFrame([(1, "a red fox", None), (2, None, "red"), (3, "", "")], "doc_id long, title string, body string")
    found = search.build(docs, {"title": 2.0, "body": 1.0}, stems=False)
    assert dict(plans)["tf"].count("Exchange hashpartitioning") == 1
    assert {(r["term"], r["doc_id"]) for r in found.postings.collect()} >= {("red", 1), ("red", 2), ("fox", 1)}
