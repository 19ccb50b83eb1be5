"""Merged and spliced tables against plain loops."""

from __future__ import annotations

import hashlib
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from quarrylake.functions import text as T
from quarrylake.operators import grids
from quarrylake.plans import loads, views

WORDS = ["plots", "results", "final", "exam", "quiz", "team", "read", "note", "week", "lab", "is", "of", "a1b2", ""]


@pytest.fixture(scope="module")
def token_sets(spark):
    """The library's content tokens of any text made of WORDS, looked up plainly."""
    return tokens_of(spark, WORDS)


def tokens_of(spark, words):
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.content_tokens(F.col("w")).alias("t")).collect()
    known = {r["w"]: set(r["t"]) for r in rows}
    return lambda text: set().union(*(known[w] for w in text.replace("|", " ").replace("-", " ").split() if w in known), set())


def plain_match(tok, d, p):
    x, y = tok(" ".join(d)), tok(" ".join(p))
    if not x or not y:
        return not x and not y
    return x <= y or y <= x or len(x & y) / len(x | y) >= 0.4


def plain_merge(tok, a, b):
    if not a or not b or not a[0] or any(len(r) != len(a[0]) for r in [*a, *b]):
        return a or [], 0, 0
    known = set().union(*(tok(" ".join(r)) for r in a))
    dropped = lambda p: any(t not in known and len(t) >= 4 for t in tok(" ".join(p)))
    out, inserted, upgraded, i, j = [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and (j >= len(b) or plain_match(tok, a[i], b[j])):
            row = list(a[i])
            if j < len(b):
                for k, (c, o) in enumerate(zip(a[i], b[j], strict=True)):
                    if c.strip() and tok(c) < tok(o) and any(len(t) >= 4 for t in tok(o) - tok(c)):
                        row[k] = o
                        upgraded += 1
                j += 1
            out.append(row)
            i += 1
        elif dropped(b[j]) and not any(plain_match(tok, r, b[j]) for r in (a[i:] if i < len(a) else out)):
            out.append(b[j])
            inserted += 1
            j += 1
        elif i < len(a):
            out.append(a[i])
            i += 1
        else:
            j += 1
    return out, inserted, upgraded


def grid(rng, width):
    return [[" ".join(rng.choices(WORDS, k=rng.randint(0, 3))) for _ in range(width)] for _ in range(rng.randint(1, 5))]


def test_merged_grids_equal_a_plain_walk_and_only_add(spark, token_sets):
    rng = random.Random(5)
    cases = []
    for i in range(120):
        width = rng.randint(1, 3)
        a = grid(rng, width)
        b = [[c + rng.choice(["", " results", " final exam"]) for c in r] for r in a if rng.random() < 0.8] + grid(rng, width)
        cases.append((i, a, b[rng.randrange(2) :]))
    cases += [(900, [["a", "b"], ["c"]], [["x", "y"]]), (901, None, [["plots"]]), (902, [["plots"]], None), (903, [], []), (904, [["plots"]], [["exam", "quiz"]])]
    frame = spark.createDataFrame(cases, f"id long, a {grids.GRID}, b {grids.GRID}")
    got = {r["id"]: r["m"] for r in frame.select("id", grids.merged(F.col("a"), F.col("b")).alias("m")).collect()}
    for i, a, b in cases:
        assert (got[i]["grid"], got[i]["inserted"], got[i]["upgraded"]) == plain_merge(token_sets, a, b), (a, b)
        assert len(got[i]["grid"]) == len(a or []) + got[i]["inserted"]
    assert sum(m["inserted"] for m in got.values()) > 10 and sum(m["upgraded"] for m in got.values()) > 10


def plain_markdown(tok, blocks):
    lines, table = [], None
    for _, kind, rendered, cells, outcome in blocks:
        rendered = rendered or ""
        if kind == "table" and outcome == "lost" and cells:
            if table is not None and len(table[0][0]) == len(cells[0]) > 0:
                shown = tok("\n".join(lines))
                new = [r for r in cells if tok(" ".join(r)) - shown]
                for k, r in enumerate(new):
                    lines.insert(table[1] + 1 + k, "| " + " | ".join(c.strip() for c in r) + " |")
                table = table[0], table[1] + len(new)
                continue
        if rendered or kind != "table":
            lines.append(rendered)
        table = (cells, len(lines) - 1) if kind == "table" and rendered and cells and cells[0] else None
        lines.append("")
    return "\n".join(lines).rstrip() + "\n"


def test_markdown_splices_continued_tables(spark, token_sets):
    rng = random.Random(11)
    rows, want = [], {}
    for doc in range(60):
        blocks = []
        for at in range(rng.randint(1, 9)):
            kind = rng.choice(["table", "table", "text"])
            cells = grid(rng, rng.choice([1, 2, 2])) if kind == "table" else None
            outcome = rng.choice(["grid_fallback", "lost", "lost"]) if kind == "table" else None
            rendered = None if outcome == "lost" else " ".join(rng.choices(WORDS[:6], k=2)) if kind == "text" else "| " + " | ".join(cells[0]) + " |"
            blocks.append((at, kind, rendered, cells, outcome))
        want[doc] = plain_markdown(token_sets, blocks)
        rows += [(doc, *b) for b in blocks]
    frame = spark.createDataFrame(rows, f"doc_id long, ord int, kind string, rendered string, grid {grids.GRID}, outcome string")
    assert grids.continuations(frame).filter("size(new_rows) > 0").count() > 5
    got = {r["doc_id"]: r["text"] for r in grids.markdown(frame).collect()}
    assert got == want
    assert grids.markdown(frame.limit(0)).collect() == []


def test_queries_equal_the_plain_versions(spark, small_dir):
    pairs = views.view(spark, small_dir, views.TWO_GRIDS).collect()
    blocks = views.view(spark, small_dir, views.TABLE_BLOCKS).orderBy("doc_id", "ord").collect()
    texts = [c for r in pairs for g in (r["a"], r["b"]) for row in g for c in row] + [c for r in blocks for row in r["grid"] or [] for c in row] + [r["rendered"] or "" for r in blocks]
    tok = tokens_of(spark, sorted({w for t in texts for w in t.replace("|", " ").split()}))
    digest = lambda text: hashlib.md5(text.encode()).hexdigest()
    want = {}
    for r in pairs:
        out, inserted, upgraded = plain_merge(tok, r["a"], r["b"])
        want[r["doc_id"]] = digest("|".join(c for row in out for c in row)), len(out), inserted, upgraded
    got = {r["doc_id"]: (r["digest"], r["n_rows"], r["inserted"], r["upgraded"]) for r in loads.merged_grids(spark, small_dir).collect()}
    assert got == want and any(w[2] for w in want.values()) and any(w[3] for w in want.values())
    plain = {doc: digest(plain_markdown(tok, [(b["ord"], b["kind"], b["rendered"], b["grid"], b["outcome"]) for b in own])) for doc, own in groupby(blocks, key=lambda r: r["doc_id"])}
    rows = loads.spliced_markdown(spark, small_dir).collect()
    assert {r["doc_id"]: r["digest"] for r in rows} == plain and any(r["n_rows"] for r in rows)
