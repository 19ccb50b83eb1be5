"""Operators without SQL, and the edges of those with it, against plain versions on small tables."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylake.functions.cleanup import is_transient
from quarrylake.operators import admission, blocks, checks, dedup, graph, layout, loads, retrieval, tagging, upsert
from quarrylake.plans import loads as load_plans
from quarrylake.sources import files


def greedy(rows, threshold):
    kept = []
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        x = np.array(v, float)
        n = np.linalg.norm(x)
        if n == 0 or not any(h == g and m > 0 and float(x @ y) / (n * m) >= threshold for h, _, y, m in kept):
            kept.append((g, i, x, n))
    return sorted((g, i) for g, i, _, _ in kept)


@pytest.mark.parametrize("block", [7, 1024])
def test_greedy_deduplication_is_that_of_the_order(spark, block, monkeypatch):
    pairs = dedup.similar_pairs
    monkeypatch.setattr(dedup, "similar_pairs", lambda *a: pairs(*a, block=block))
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((9, 6))
    rows = [(f"g{i % 2}", i, (centres[rng.integers(9)] + 0.45 * rng.standard_normal(6)).tolist()) for i in range(90)]
    rows += [("g0", 90 + i, rows[4][2]) for i in range(5)] + [("g1", 99, [0.0] * 6)]
    frame = spark.createDataFrame(rows, "label string, vec_id long, embedding array<double>")
    got = sorted((r["label"], r["vec_id"]) for r in dedup.greedy_similar(frame, "label", 0.85).collect())
    assert got == greedy(rows, 0.85) and len(got) < 60
    assert dedup.greedy_similar(frame.limit(0), "label", 0.85).collect() == []


def test_banded_pairs_near_the_threshold_are_all_found(spark):
    rng = np.random.default_rng(5)
    sets = {}
    for k in range(40):
        base = rng.integers(0, 1 << 40, 60).tolist()
        common = 52 + k % 8  # Jaccard from under 0.77 to 0.97
        sets[2 * k], sets[2 * k + 1] = base, base[:common] + rng.integers(1 << 41, 1 << 42, 60 - common).tolist()
    want = sorted((a, b) for a, b in itertools.combinations(sorted(sets), 2) if len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]}))
    frame = spark.createDataFrame(list(sets.items()), "doc_id long, s array<long>")
    assert sorted((r["a"], r["b"]) for r in dedup.lsh_pairs(frame).collect()) == want and 15 < len(want) < 40


def test_vector_search_in_blocks_of_queries(spark):
    rng = np.random.default_rng(7)
    grid = rng.standard_normal((300, 5)).round(1)
    grid[10:20] = grid[0]
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(grid)] + [(900, None, 0), (901, [1.0], 0), (902, [0.0] * 5, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    queries = frame.filter("vec_id % 50 = 0 AND vec_id < 300").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    for within in (None, "label"):
        got = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieval.vector_topk(frame, queries, 6, within=within, block=2, row_block=7).collect()}
        for q in range(0, 300, 50):
            held = [(i, v) for i, v, c in rows if v and len(v) == 5 and i != q and (within is None or c == q % 3)]
            want = sorted(held, key=lambda x: (-round(float(unit(x[1]) @ unit(grid[q])), 12) + 0.0, x[0]))[:6]
            assert [got[q, r] for r in range(1, 7)] == [i for i, _ in want]
    assert retrieval.vector_topk(frame, queries.limit(0), 6).collect() == []


def plain_admission(rows, per_minute, per_session):
    out, windows, used = {}, {}, {}
    for request, service, session, at in sorted(rows, key=lambda r: (r[1], r[3], r[0])):
        window = [t for t in windows.get(service, []) if t >= at - 60]
        n = used.get((service, session), 0)
        if len(window) >= per_minute:
            out[request] = ("rate", n)
        elif n >= per_session:
            out[request] = ("session", n)
        else:
            window.append(at)
            used[service, session] = n + 1
            out[request] = ("allowed", n + 1)
        windows[service] = window
    return out


def test_admission_counts_only_what_it_lets_in(spark):
    rng = np.random.default_rng(9)
    rows = [(i, f"s{rng.integers(2)}", f"u{rng.integers(4)}", float(rng.integers(0, 900))) for i in range(700)]
    frame = spark.createDataFrame([*rows, (900, None, "u", 1.0), (901, "s", "u", None)], "request_id long, service string, session string, at double")
    got = {r["request_id"]: (r["decision"], r["used"]) for r in admission.admit(frame, 12, 40).collect()}
    assert got.pop(900) == got.pop(901) == ("invalid", 0)
    assert got == plain_admission(rows, 12, 40) and {d for d, _ in got.values()} == {"allowed", "rate", "session"}
    waits = sorted(admission.released(frame, 12).filter("request_id < 900").collect(), key=lambda r: r["at"])
    starts = {s: sorted(r["at"] for r in waits if rows[r["request_id"]][1] == s) for s in ("s0", "s1")}
    assert all(b - a >= 60 for times in starts.values() for a, b in zip(times, times[12:], strict=False)) and min(r["wait"] for r in waits) == 0


def test_admission_of_events_equals_the_plain_rule(spark, small_dir):
    rows = [(r["event_id"], r["event_type"], str(r["user_id"]), r["at"]) for r in spark.read.parquet(f"{small_dir}/events.parquet").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e9).collect()]
    got = {r["request_id"]: (r["decision"], r["used"]) for r in load_plans.admission(spark, small_dir).collect()}
    assert got == plain_admission(rows, load_plans.PER_MINUTE, load_plans.PER_SESSION)


def test_guards_run_in_order(spark):
    rows = [(1, "a", "2025-01-01 10:00:00", False), (2, "a", "2025-01-01 10:00:01", True), (3, "a", "2025-01-01 10:00:02", False), (4, "a", "2025-01-01 10:00:03", False), (5, "b", "2025-01-01 10:00:04", None), (6, "b", "2025-01-01 10:00:05", False), (7, "b", "2025-01-02 10:00:00", False)]
    frame = spark.createDataFrame(rows, "turn_id long, session string, at string, flagged boolean").withColumn("at", F.to_timestamp("at"))
    assert {r["turn_id"]: r["reason"] for r in admission.guarded(frame, 2, 3).collect()} == {1: None, 2: "injection", 3: None, 4: "session_cap", 5: None, 6: "daily_budget", 7: None}


def test_near_copy_tags_on_hand_made_lines(spark):
    policy = "students must keep to the rules of the house and tell their teacher at once about every absence they know of before it begins"
    other = policy.replace("absence", "illness")
    lines = [(d, 0, policy) for d in range(5)] + [(9, 0, other + "."), (9, 1, "short"), (9, 2, "Short!"), (9, 3, ""), (8, 0, None), (7, 0, "short"), (7, 1, "a penalty of 20 % for late work"), (9, 4, "a penalty of 20 % for late work")]
    frame = spark.createDataFrame(lines, "doc_id long, idx int, content string")
    groups = frame.select("doc_id", (F.col("doc_id") % 4).alias("group"), "content")
    rows = {(r["doc_id"], r["idx"]): r for r in tagging.tag_near_copies(frame, dedup.boilerplate_reference(groups)).collect()}
    assert len(rows) == len(lines) and all(rows[d, 0]["is_boilerplate"] and rows[d, 0]["match"] == "body" for d in range(5))
    assert not rows[9, 3]["is_boilerplate"] and not rows[8, 0]["dup_across"]
    assert rows[9, 1]["dup_within"] and rows[9, 1]["of_idx"] == 2  # the longer content stays
    assert rows[9, 2]["dup_across"] and rows[9, 2]["of_doc"] == 7 and not rows[7, 0]["dup_across"]
    assert not rows[9, 4]["dup_across"]  # its percentage protects it


def test_layout_joins_by_hand(spark):
    blocks = spark.createDataFrame([(1, 1, 0, 10.0, 20.0, 20.0, 10.0), (1, 1, 1, 500.0, 20.0, 510.0, 10.0), (1, 2, 2, 10.0, 20.0, 20.0, 10.0), (1, 1, 3, None, 20.0, 20.0, 10.0)], "doc_id int, page int, ord int, x0 double, top double, x1 double, bottom double")
    regions = spark.createDataFrame([(1, 1, 0.0, 100.0, 100.0, 0.0)], "doc_id int, page int, x0 double, top double, x1 double, bottom double")
    assert [r["ord"] for r in layout.inside(blocks, regions).collect()] == [0]
    a, b, c = (F.array(*map(F.lit, x)) for x in (["Midterm exam", "40%"], ["Midterm exam", ""], ["Other topic", "words"]))
    told = spark.range(1).select(layout.rows_match(a, b), layout.rows_match(a, c), layout.rows_match(F.array(F.lit("")), F.array(F.lit("a")))).first()
    assert list(told) == [True, False, True]


def test_checks_with_null_metrics_fail(spark):
    rows = spark.createDataFrame([(1, None), (2, 3)], "doc_id int, n int")
    told = {r["doc_id"]: (r["passed"], r["value"]) for r in checks.evaluate(rows, [checks.Check("some", "n > 2", "n")]).collect()}
    assert told == {1: (False, None), 2: (True, 3.0)}


def test_loads_with_nulls(spark):
    rows = spark.createDataFrame([("a", 1, None, "x"), ("a", 2, "p", "y"), ("a", 3, None, "z"), (None, 4, "q", "w")], "k string, seq int, v string, w string")
    assert [tuple(r) for r in loads.first_wins(rows, ["k"], "seq", ["v"]).collect()] == [("a", "p", "x")]
    assert [tuple(r) for r in loads.last_wins(rows, ["k"], "seq", kept=("w",)).collect()] == [("a", None, "x")]


def test_files_by_name_and_content(spark, tmp_path):
    for dept, name in (("CSCE", "202541_csce_605_600_62077.pdf"), ("STAT", "202541_stat_1.pdf"), ("STAT", "notes.txt")):
        (tmp_path / dept).mkdir(exist_ok=True)
        (tmp_path / dept / name).write_text("x")
    rows = sorted(tuple(r)[:6] for r in files.stems(spark, str(tmp_path)).collect())
    assert rows == [("202541_csce_605_600_62077", "CSCE", "202541", "605", "600", "62077"), ("202541_stat_1", "STAT", "202541", "1", None, None)]
    (tmp_path / "cat.md").write_text("# CSCE 605 Compilers\nCSCE 221 Data\nand CSCE 605 again, CSCE 700\nSTAT 601")
    assert sorted(r["course"] for r in files.catalogue_numbers(spark, str(tmp_path / "cat.md"), "CSCE").collect()) == ["CSCE 605"]
    for i, url in enumerate(("old", "new")):
        (tmp_path / f"m{i}.json").write_text(f'{{"a.pdf": {{"url": "{url}", "doc_id": "{i}"}}, "b{i}.pdf": {{"url": "u", "doc_id": "x"}}}}')
    found = sorted(tuple(r) for r in files.manifests(spark, [str(tmp_path / f"m{i}.json") for i in (0, 1)]).collect())
    assert found == [("a", "new", "1"), ("b0", "u", "x"), ("b1", "u", "x")]
    items = spark.createDataFrame([(1, " What? ", "x"), (2, " ", "y"), (3, None, "z")], "id int, question string, extra string")
    files.write_golden_set(items, str(tmp_path / "golden"), ["id", "question"])
    assert [tuple(r) for r in files.golden_set(spark, str(tmp_path / "golden"), ["question", "id"]).collect()] == [("What?", "1")]


def test_selections_of_metrics():
    assert blocks.resolve(None, ["n"]) == ["n"] and blocks.resolve(" ALL ", []) == sorted(blocks.METRICS) and blocks.resolve("n, mean,", []) == ["n", "mean"]
    with pytest.raises(ValueError, match="nothing"):
        blocks.resolve("n,nothing", [])


def test_helper_columns_never_clash(spark):
    ranked = spark.createDataFrame([(1, 1, 0.9, "a", 7), (1, 2, 0.8, "a", 8), (1, 3, 0.1, "b", 9)], "q int, rank int, score double, nth string, cut int")
    for name in ("n_over", "gap_after", "first", "groups"):
        ranked = ranked.withColumn(name, F.lit("x"))
    for out in (retrieval.knee(ranked, ["q"]), retrieval.score_floor(ranked, ["q"], 0.5, 1), retrieval.cap_per_group(ranked, "nth", 1, ["q"]), retrieval.first_ranked(ranked, ["q"]), retrieval.stratified(ranked, "nth", 2, ["q"]).drop("pos")):
        assert out.columns == ranked.columns and out.count() in (1, 2)
    base = spark.createDataFrame([(1, "a", "b", "c", "d")], "_k int, new__k string, _new string, last_row string, is_new string")
    batch = spark.createDataFrame([(1, "z", "y", "x", "w", 1), (2, "p", "q", "r", "s", 1)], "_k int, new__k string, _new string, last_row string, is_new string, step int")
    assert sorted(tuple(r) for r in upsert.upsert(base, batch, ["_k"], "step").collect()) == [(1, "z", "y", "x", "w"), (2, "p", "q", "r", "s")]


def plain_guards(rows, cap, budget):
    used, turns, out = {}, {}, {}
    for turn, session, at, flagged in sorted(rows, key=lambda r: (r[2], r[0])):
        day = at // 86_400
        if used.get(session, 0) >= cap:
            out[turn] = "session_cap"
        elif flagged:
            out[turn] = "injection"
        else:
            turns[day] = turns.get(day, 0) + 1
            out[turn] = "daily_budget" if turns[day] > budget else None
            if out[turn] is None:
                used[session] = used.get(session, 0) + 1
    return out


def guard_rows(n=500):
    rng = np.random.default_rng(4)
    return [(i, f"u{rng.integers(60)}", float(rng.integers(0, 6 * 86_400)), bool(rng.random() < 0.2)) for i in range(n)]


@pytest.mark.parametrize(("cap", "budget"), [(5, 40), (3, 1_000), (9, 0), (4, 15)])
def test_guards_outlive_days(spark, cap, budget):
    rows = guard_rows()
    frame = spark.createDataFrame([*rows, (900, None, 5.0, False)], "turn_id long, session string, at double, flagged boolean").withColumn("at", F.timestamp_seconds("at"))
    got = {r["turn_id"]: r["reason"] for r in admission.guarded(frame, cap, budget).collect()}
    assert got.pop(900) == "invalid"
    assert got == plain_guards(rows, cap, budget)


@pytest.mark.parametrize("shape", ["chain", "star", "alternating"])
def test_components_in_few_rounds(spark, monkeypatch, shape):
    n = 1_000
    path = list(range(n)) if shape != "alternating" else [x for i in range(n // 2) for x in (i, n - 1 - i)]
    edges = [(n - 1, i) for i in range(n - 1)] if shape == "star" else list(zip(path, path[1:], strict=False))
    rounds = []
    write = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, label: rounds.append(label) or write(df, label))
    named = [(f"n{a:04}", f"n{b:04}") for a, b in edges] + [("x2", "x1"), ("x1", "x1")]
    rows = graph.components(spark.createDataFrame(named, "a string, b string")).collect()
    assert {r["component"] for r in rows if r["node"].startswith("n")} == {"n0000"} and len(rows) == n + 2
    assert {(r["node"], r["component"]) for r in rows if r["node"].startswith("x")} == {("x1", "x1"), ("x2", "x1")}
    assert rounds.count("step") < 15


@pytest.mark.parametrize(
    ("text", "transient"),
    [
        ("What is due on Tuesday, February 24?", True), ("What must be handed in by Friday, May 1", True), ("on February 24", True), ("When is the exam on  March 3?", True), ("the February 24, 2026 lecture", True),
        ("what happens next week", True), ("T 10/6", True), ("see Lec. 12", True), ("Homework #3 due", True), ("In May students choose", False), ("the march on Rome in 1922", False), ("How is attendance graded?", False), (None, False),
    ],
)
def test_transient_dates(spark, text, transient):
    assert spark.createDataFrame([(text,)], "t string").select(is_transient(F.col("t")).alias("x")).first()["x"] is transient
