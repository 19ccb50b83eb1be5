"""Steps whose work has to grow no faster than their input: what is told of a row is told once."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarrylake.functions import tables as B
from quarrylake.functions import text as T
from quarrylake.operators import dedup as D
from quarrylake.operators import admission, grids, retrieval
from quarrylake.plans import checks, dedup, loads, texts
from tests.test_operators import plain_guards


def told(frame, name):
    """How often an expression stands in a plan."""
    return frame._jdf.queryExecution().optimizedPlan().toString().count(name + "(")


def test_merged_grids_tell_the_tokens_of_a_row_once(spark):
    frame = spark.createDataFrame([(1, [["a"]], [["b"]])], f"id long, a {grids.GRID}, b {grids.GRID}")
    both = frame.withColumn("m", grids.merged(F.col("a"), F.col("b"))).select("id", F.size("m.grid"), F.md5(F.array_join(F.flatten("m.grid"), "|")), "m.inserted", "m.upgraded")
    assert told(both, "regexp_extract_all") <= 10


def plain_weights(text):
    """Percentages of the first table that has most."""
    best, cur = [], []
    for line in [*re.split("\r\n|[\n\r\x0b\u2028]", text), ""]:
        if line.lstrip(" ").startswith("|"):
            cur += [float(m[1]) for m in [re.search(r"([0-9]+(?:\.[0-9]+)?)\s*%", line)] if m]
        else:
            best, cur = max(best, cur, key=len), []
    return best if len(best) >= 3 else []


def test_weights_are_those_of_a_plain_walk(spark):
    rng = random.Random(3)
    pieces = ["| a | 10% |", "| b | 12.5 % (5% each) |", "  | 1.2.3% |", "| --- | --- |", "| none |", "text 5%", "", "|", "| 7%", "\t| 9% |", "| 5\t% | 6% |", "- | 4%"]
    cases = [(i, "".join(rng.choice(pieces) + rng.choice(["\n", "\n", "\n", "\r\n", "\r", "\x0b", "\u2028"]) for _ in range(rng.randint(0, 14)))) for i in range(400)]
    cases += [(900, ""), (901, "| 1% |\n| 2% |\r\n| 3% |"), (902, "\n\n| 1% |\n\n| 2% |\n| 3% |\n")]
    frame = spark.createDataFrame(cases, "id long, c string")
    got = {r["id"]: r["w"] for r in frame.select("id", B.weights(F.lit("Grading"), F.col("c")).alias("w")).collect()}
    assert got == {i: plain_weights(c) for i, c in cases} and sum(map(bool, got.values())) > 50
    assert frame.select(B.weights(F.lit("About"), F.lit(None).cast("string")).alias("w")).distinct().collect() == [([],)]


def test_grading_weights_tells_its_percentages_once(spark, small_dir):
    assert told(checks.grading_weights(spark, small_dir), "regexp_extract_all") == 1 and told(checks.grading_weights(spark, small_dir), "regexp_extract") == 0


def test_vector_search_holds_the_scores_of_few_queries_at_once():
    rng = np.random.default_rng(5)
    vectors = lambda n, first: pa.table({"id": np.arange(first, first + n), "v": pa.array(rng.standard_normal((n, 4)).tolist(), pa.list_(pa.float64())), "own": pa.nulls(n, pa.string())})
    queries, rows = vectors(1_500, 0), vectors(2_048, 1_400)
    tracemalloc.start()
    found = retrieval._nearest(3, 4, False)(queries, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # a matrix of all scores is 25 MB, and it takes several
    unit = lambda t: np.array([v / np.linalg.norm(v) for v in np.array(t["v"].to_pylist())])
    score = np.round(unit(queries) @ unit(rows).T, 12)
    score[np.arange(1_500)[:, None] == np.arange(1_400, 3_448)[None]] = -np.inf
    want = np.argsort(-score, axis=1, kind="stable")[:, :3] + 1_400
    assert sorted(zip(found["query_id"].to_pylist(), found["id"].to_pylist(), strict=True)) == sorted((q, int(i)) for q in range(1_500) for i in want[q])


def test_grams_of_texts_are_counted_by_hashes(spark, small_dir, monkeypatch):
    assert "hashpartitioning(gram" not in dedup.word_ngrams_df(spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(D, "BUCKETS", 3)
    monkeypatch.setattr(D, "HELD_GRAMS", 40)
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(120)]
    texts += [None, "", "a b c", "A, b!  c\nD e", "a b c d e", "a b c d e", "a b c d e " * 9, "\u00e9 \u00df x y z", "\u00c9 \u00df x y z"]
    frame = spark.createDataFrame([(i // 2 or None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    words = [re.sub(r"[,!]", "", t or "").lower().split() for t in texts]
    df = Counter(g for w in words for g in {" ".join(w[i : i + 5]) for i in range(len(w) - 4)})
    assert sorted(map(tuple, D.shared_grams(frame).collect())) == sorted((g, n) for g, n in df.items() if n > 1)
    assert D.shared_grams(frame.limit(0)).collect() == []


def test_passages_meet_by_hashes_of_words(spark, tmp_path):
    docs = [(1, "a b c d"), (2, "x, A  b\nC"), (3, "b c"), (4, None), (5, "a b d c"), (6, "a b c a b c"), (7, "ab c d e")]
    items = [(10, "a b c"), (11, "B c d!"), (12, "b c"), (13, ""), (14, None), (15, "a b c a"), (16, "b c d e"), (17, "ab c d e")]
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        spark.createDataFrame(rows, f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    found = texts.containment_join(spark, str(tmp_path))
    assert told(found, "array_join") == 0
    assert sorted(map(tuple, found.collect())) == [(10, 1), (10, 2), (10, 6), (11, 1), (15, 6), (17, 7)]


def moves(frame):
    """How often rows are dealt anew in a plan, and how often it joins."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning"), plan.count("Join ")


def test_blocks_are_dealt_once_and_told_once(spark, small_dir):
    for query in (checks.block_metrics, checks.checks_blocks):
        assert moves(query(spark, small_dir)) == (1, 0)
    plan = checks.block_metrics(spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"collect_list\(", plan.split("partial_")[0].split("ObjectHashAggregate(")[-1])) <= 3


def test_tokens_end_where_the_stripped_ones_did(spark):
    rng = random.Random(4)
    cases = ["".join(rng.choices("aBz09./:-@_+#é K", k=rng.randint(0, 14))) for _ in range(3_000)] + ["", None, "ab.....", "a..-bcde", "abc-", "abcd-/:.", "ab.c.. x", "----abcd"]
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id long, c string")
    got = {r["id"]: r["t"] for r in frame.select("id", T.content_tokens(F.col("c")).alias("t")).collect()}
    for i, c in enumerate(cases):
        raw = [t.lower().rstrip("./:-") for t in re.findall(r"[A-Za-z0-9][A-Za-z0-9./:@_+#-]{3,}", c or "")]
        assert (got[i] or []) == list(dict.fromkeys(t for t in raw if len(t) >= 4)), c
    assert told(frame.select(T.content_tokens(F.col("c"))), "rtrim") + told(frame.select(T.content_tokens(F.col("c"))), "filter") == 0


def test_damaged_words_are_counted_as_by_the_plain_pattern(spark):
    rng = random.Random(6)
    words = [*T.LETTER_DROPS, *T.LIGATURE_DAMAGE, "wilt", "office", "xfal", "ofcexy"]
    cases = [rng.choice([" ", ".", "_", "-"]).join(rng.choice([str.upper, str.lower, str])(rng.choice(words)) for _ in range(5)) for _ in range(400)]
    frame = spark.createDataFrame([(c,) for c in cases], "c string").select("c", T.letter_drops(F.col("c")).alias("n"), T.ligature_damage(F.col("c")).alias("m"))
    for r in frame.collect():
        plain = [len(re.findall(rf"\b(?:{'|'.join(w)})\b", r["c"], flags)) for w, flags in ((T.LETTER_DROPS, 0), (T.LIGATURE_DAMAGE, re.I))]
        assert [r["n"], r["m"]] == plain, r["c"]


def test_spliced_markdown_reads_its_blocks_once(spark, small_dir):
    assert moves(loads.spliced_markdown(spark, small_dir)) == (1, 0)
    rows = [(1, 0, "text", "", None, None), (1, 1, "table", "| a | b |", [["aaaa", "bbbb"]], "grid_fallback"), (1, 2, "table", None, [["aaaa", "bbbb"], ["cccc", None]], "lost"), (1, 2, "table", None, [["cccc", "dddd"]], "lost"), (2, 0, "table", None, None, None), (2, 0, "text", "x", None, None)]
    frame = spark.createDataFrame(rows, f"doc_id long, ord int, kind string, rendered string, grid {grids.GRID}, outcome string")
    got = {r["doc_id"]: r for r in grids.markdown(frame).collect()}
    assert got[1]["n_joined"] == 2 and got[2]["n_joined"] == 0 and got[2]["text"].strip() == "x"
    assert got[1]["text"].startswith("\n\n| a | b |\n| aaaa | bbbb |\n| cccc |  |\n") and got[1]["n_rows"] == 3


def test_guards_store_a_turn_a_bounded_number_of_times(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, f"u{rng.randrange(9)}", float(rng.randrange(86_400) + 86_400 * (i % 8)), rng.random() < 0.2) for i in range(320)]
    written, stored = [], admission.stored
    monkeypatch.setattr(admission, "stored", lambda df, label: written.append((label, stored(df, label))) or written[-1][1])
    frame = spark.createDataFrame(rows, "turn_id long, session string, s double, flagged boolean").withColumn("at", F.timestamp_seconds("s"))
    got = {r["turn_id"]: r["reason"] for r in admission.guarded(frame, 8, 12).collect()}
    assert got == plain_guards(rows, 8, 12) and set(got.values()) == {None, "session_cap", "injection", "daily_budget"}
    assert sum(frame.count() for label, frame in written if label in ("turns", "told")) <= 4 * len(rows)
