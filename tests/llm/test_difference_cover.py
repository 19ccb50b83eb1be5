"""Distributed suffix ranks against a plain sort of suffixes."""

from __future__ import annotations

import pytest

from quarrylake.llm.difference_cover import suffix_ranks


@pytest.mark.parametrize("text", ["", "a", "ab", "mississippi", "abcabcabcabcabca"])
def test_ranks_are_those_of_sorted_suffixes(spark, text):
    frame = spark.createDataFrame([(i, ord(c)) for i, c in enumerate(text)], "pos long, sym long")
    want = {i: r for r, i in enumerate(sorted(range(len(text)), key=lambda i: text[i:]))}
    assert {r["pos"]: r["rank"] for r in suffix_ranks(frame).collect()} == want
