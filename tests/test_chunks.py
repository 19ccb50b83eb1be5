"""Chunkers on small documents whose chunks can be told by hand."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylake.operators import chunks as C
from tests.conftest import DATA


def block(n: int) -> str:
    return " ".join(["word"] * int(n * 0.8))


def test_sections_know_their_paths_and_ends():
    found = C.sections("intro\n# A\na\n### B\nb\n## C\n# D\nd")
    assert [(s.level, s.header, s.body, " > ".join(s.path), s.end) for s in found] == [(0, "", "intro", "", 5), (1, "A", "a", "A", 4), (3, "B", "b", "A > B", 3), (2, "C", "", "A > C", 4), (1, "D", "d", "D", 5)]


def test_capped_chunks_keep_to_the_cap():
    for md in ("\n\n".join(f"## Section {i}\n\n{block(40)}" for i in range(20)), f"## A\n\n{block(400)}\n\n## B\n\n{block(400)}"):
        assert all(c.size <= 600 for c in C.capped(md))
    small = C.capped("## A\n\nHello.\n\n## B\n\nWorld.")
    assert [(c.content, c.path, c.reason) for c in small] == [("## A\n\nHello.\n\n## B\n\nWorld.", "A", "merged")]
    big = C.capped(f"## Big\n\n{block(2000)}")
    assert len(big) > 1 and all(c.size <= 660 for c in big) and "long-paragraph-split" in {c.reason for c in big}
    assert C.capped("") == C.capped(" \n ") == []
    assert len(C.capped(f"{block(500)}\n\n{block(500)}")) == 2


def test_large_sections_are_opened():
    md = f"# Top\n\nown words\n\n## One\n\n{block(400)}\n\n## Two\n\n{block(400)}"
    assert [(c.path, c.reason) for c in C.capped(md)] == [("Top", "merged"), ("Top > Two", "section")]
    assert [c.path for c in C.semantic(md, over=300, drop_metadata=False)] == ["Top > One"] * 2 + ["Top > Two"] * 3  # the heading of a split section that follows another is a chunk


def test_semantic_chunks_stay_within_sections():
    md = f"## Late Policy\n\n{block(60)}\n\n## Own Rule\n\nten %\n\n## Own Rule\n\nmore"
    found = C.semantic(md)
    assert [(c.path, c.content) for c in found] == [("Late Policy", f"## Late Policy\n\n{block(60)}"), ("Own Rule", "## Own Rule\n\nten %\n\n## Own Rule\n\nmore")]
    assert found[0].flags == [] and C.semantic(block(40))[0].flags == ["NO_HEADER"]


def test_semantic_drops_only_headers_without_bodies_and_metadata():
    md = f"# CSCE 638 Syllabus\n\n## Campus Policies\n\n## 1.1 Course Information\n\n{block(30)}\n\n## Grading\n\n{block(30)}\n\n| a | b |"
    assert [c.path for c in C.semantic(md)] == ["CSCE 638 Syllabus > Grading"] and C.semantic(md)[0].flags == ["HAS_TABLE"]
    kept = C.semantic(md, drop_metadata=False)
    assert len(kept) == 1 and "Course Information" in kept[0].content
    assert [c.content for c in C.semantic(f"## A\n\nfew\n\n## B\n\n{block(30)}")] == [f"## A\n\nfew\n\n## B\n\n{block(30)}"]
    assert [(c.content, c.flags) for c in C.semantic("## A\n\nfew\n\n## B\n\nwords")] == [("## A\n\nfew\n\n## B\n\nwords", ["NO_HEADER"])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["# A", "## B", "### C", "word " * 30, "tiny", "", "| a | b |", "x" * 900, "One. Two. Three. " * 20]), max_size=14).map("\n".join))
def test_no_words_are_lost(md):
    words = sorted(w for w in md.replace("#", " ").split() if len(w) < 900)
    for how, kept in ((C.capped, {}), (C.fixed, {"overlap": 0, "size": 20, "most": 30})):
        found = sorted(w for c in how(md, **kept) for w in c.content.replace("#", " ").split() if len(w) < 900)
        if how is C.capped:
            assert found == words
        else:
            assert "".join(found).count("tiny") >= "".join(words).count("tiny")
    assert all(c.size <= 600 or "x" * 900 in c.content for c in C.capped(md))
    for c in C.semantic(md, drop_metadata=False):
        assert ("OVERSIZED" in c.flags) == (c.size > 500) and ("HAS_TABLE" in c.flags) == C.has_table(c.content)


def test_overlapped_chunks_begin_with_the_end_of_the_one_before():
    parts = [f"{i} {block(100)}" for i in range(12)]
    found = C.overlapped("# Head\n\n" + "\n\n".join(parts), size=400, overlap=100)
    assert len(found) == 4 and found[0].content.startswith("Head")
    for a, b in zip(found, found[1:], strict=False):
        assert b.content.split("\n\n")[0] == a.content.split("\n\n")[-1]
    assert C.overlapped(" ") == []


def test_fixed_windows_cut_at_spaces_and_overlap():
    found = C.fixed("abcd " * 400, size=100, overlap=25, most=150)
    assert all(len(c.content) <= 600 and not c.content.startswith("bcd") for c in found[:1]) and len(found) > 4
    assert [len(c.content) for c in C.fixed("x" * 1000, size=100, overlap=0, most=150)] == [600, 400]


@pytest.mark.parametrize("how", [C.capped, C.semantic, C.overlapped, C.fixed])
def test_chunk_rows(spark, how):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "# A\n\n" + block(100), "x"), (None, block(50), "x"), (3, "# A\n\n" + block(100), "x")], "doc_id long, text string, idx string")
    rows = C.chunk(docs, how).collect()
    assert sorted((r["doc_id"] or 0, r["idx"]) for r in rows) == [(0, 0), (3, 0), (3, 0)]
    assert C.chunk(docs.limit(0), how).collect() == []


def test_chunks_of_documents_hold_all_their_words(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    want = {r["doc_id"]: sorted((r["text"] or "").split()) for r in docs.collect()}
    got: dict[int, list[str]] = {}
    for r in C.chunk(docs, C.capped).collect():
        got.setdefault(r["doc_id"], []).extend(r["content"].split())
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
