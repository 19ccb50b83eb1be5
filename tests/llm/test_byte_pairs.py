"""Byte-level pair encoding in higher-order functions, against the library that it has to equal."""

from __future__ import annotations

import base64
import hashlib
import random

import pytest
import tiktoken

from quarrylake.llm import byte_pairs, queries
from tests.llm.conftest import MESSY

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    ranks = byte_pairs.read_ranks(byte_pairs.ranks_path())
    return tiktoken.Encoding("tests", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def awkward() -> list[str]:
    rng = random.Random(5)
    letters = "aáeioußnrst тест日本語ทดสอบ👩‍👩‍👧 \t\n\r 　'-_=.,0129\0²½Ⅷ"
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(150)]
    texts += ["a" * 700, " " * 300 + "x", "= " * 40 + "=" * 333, "\n\n \n", "it's we'll I'D 've 's", "a\0b a", "a\0", "a\x01", "\x01\x01 \x01b", "\u0085x", "ǅǲ", "Ⅻ", "don''t"]
    return texts + ["".join(map(chr, range(at, at + 700))) for at in (1, 0x840, 0xA700, 0x10500, 0x11000, 0x1E000)]


def test_ids_and_bytes_equal_the_librarys(spark, library):
    texts = awkward()
    rows = byte_pairs.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert row["ids"] == library.encode_ordinary(texts[row["doc_id"]]), texts[row["doc_id"]][:80]
        assert bytes(row["decoded"]) == texts[row["doc_id"]].encode()


def test_the_table_of_words_bears_on_speed_alone(spark, documents, monkeypatch):
    part = documents.filter("doc_id < 40")
    with_table = {r["doc_id"]: r["ids"] for r in byte_pairs.encode(part).collect()}
    monkeypatch.setattr(byte_pairs, "LONGEST", 0)
    assert {r["doc_id"]: r["ids"] for r in byte_pairs.encode(part).collect()} == with_table


def test_query_over_the_table(spark, small_dir, documents, library):
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    rows = queries.op11_byte_bpe(spark, small_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_edges(messy, empty, library):
    rows = byte_pairs.round_trip(messy).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["ids"], bytes(r["decoded"])) for r in rows)) == sorted(
        ((d[0] is None, d[0] or 0, library.encode_ordinary(d[1] or ""), (d[1] or "").encode()) for d in MESSY)
    )
    assert byte_pairs.round_trip(empty).collect() == []


def test_the_overlaid_table_holds_every_pair_and_no_other():
    ranks = byte_pairs.read_ranks(byte_pairs.ranks_path())
    rows = byte_pairs.joins(ranks)
    starts, cells = byte_pairs.overlaid(rows)
    assert all(cells[starts[a] + b] == (a << byte_pairs.BITS) + rank for a, row in rows.items() for b, rank in row.items())
    assert sum(x is not None for x in cells) == sum(map(len, rows.values()))
    with pytest.raises(ValueError):
        byte_pairs.overlaid({1 << byte_pairs.BITS: {0: 1}})


def test_a_piece_that_no_pair_leads_to_is_a_word_alone(spark, tmp_path):
    pieces = [bytes([i]) for i in range(256)] + [b"abc", b"de", b" de"]
    (tmp_path / "ranks").write_bytes(b"\n".join(base64.b64encode(x) + b" %d" % i for i, x in enumerate(pieces)))
    own = tiktoken.Encoding("few", pat_str=public_tokenizers.PATTERN, mergeable_ranks={x: i for i, x in enumerate(pieces)}, special_tokens={})
    texts = ["abc", "abcabc abc", "de de", "dede", "é de"]
    rows = byte_pairs.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path / "ranks")).collect()
    assert [r["ids"] for r in sorted(rows)] == [own.encode_ordinary(x) for x in texts]
    assert [bytes(r["decoded"]).decode() for r in sorted(rows)] == texts
