"""Byte-level pair encoding and decoding with a file of ranks, in Spark's higher-order functions.

A text is cut by the pattern that belongs to the ranks. Each word is folded over its bytes: the state is an array of the
pieces' ids with an array that holds the rank of each piece joined to the next, and every step joins the leftmost pair of least
rank and ranks the two pairs beside it anew, until no pair has a rank. Which pair of ids joins to which is one literal: the rows
of the table of pairs, laid over each other so that no two fill one place, with an array of where each row starts. A word that is a
piece as a whole is that piece; pieces that the fold wouldn't reach are named beside it.

Words recur, so the distinct words of a bounded sample of documents are folded once, ahead, and held
in a second literal of at most ``SLOTS`` entries, one a slot; where two words fall into one slot, the
more frequent stays. Words outside it are folded where they stand. The sample and the slots bear on
speed alone: ids don't depend on them. Decoding looks each id's bytes up in hexadecimal and joins them.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to no bytes;
repeated and null doc_ids keep a row each; other columns are ignored. A word of n bytes takes up to
n steps over up to n pieces.
"""

from __future__ import annotations

import base64
import json
import re
from collections import defaultdict
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.common import materialize, release

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Slots of the word table; documents whose words fill it; longest word in it; bits of an id, and of a place in a word.
SLOTS, SAMPLE, LONGEST, BITS, PLACES = 1 << 17, 20_000, 48, 18, 26

# Code points that are letters (L) or numbers (N) since Unicode 14, as the JVM knows 13.
LATER_LETTERS = """
870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3
A7D5-A7DC A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC
105C0-105F3 10780-10785 10787-107B0 107B2-107BA 10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075
1123F-11240 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746 11AB0-11ABF 11BC0-11BE0 11F02 11F04-11F10
11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF 1AFF0-1AFF3 1AFF5-1AFFB
1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0
1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF
"""
LATER_NUMBERS = """
10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9
1E5F1-1E5FA
"""


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    """Piece to rank; the file is the driver's."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, filter(bytes.strip, lines))}


def java_pattern(pattern: str | None = None) -> str:
    """The pattern in Java's terms: classes by Unicode, letters and numbers that the JVM doesn't know yet added."""
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    later = lambda runs: re.sub(r"(\w+)|\s+", lambda m: rf"\x{{{m[1]}}}" if m[1] else "", runs)
    above = lambda runs: rf"[\x{{870}}-\x{{10FFFF}}&&[{later(runs)}]]"  # noqa: E731  most characters meet the first bound alone
    known = {r"\p{L}": r"\p{L}" + above(LATER_LETTERS), r"\p{N}": r"\p{N}" + above(LATER_NUMBERS)}
    widened = lambda part: re.sub(r"\\p\{[LN]\}", lambda m: known[m[0]], part)
    return "(?U)" + re.sub(r"\[[^\]]*\]|\\p\{[LN]\}", lambda m: widened(m[0]) if m[0][0] == "[" else f"[{widened(m[0])}]", pattern)


def _bind(value: Column, zero: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; ``zero`` is any value of the result's type."""
    return F.aggregate(F.array(value), zero, lambda _, bound: body(bound))


def _literal(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False, separators=(",", ":"))), kind)


def joins(ranks: dict[bytes, int]) -> dict[int, dict[int, int]]:
    """For each id, the ids that may follow it in a pair with a rank, with that rank."""
    out: dict[int, dict[int, int]] = defaultdict(dict)
    for piece, rank in ranks.items():
        for at in range(1, len(piece)):
            left, right = ranks.get(piece[:at]), ranks.get(piece[at:])
            if left is not None and right is not None:
                out[left][right] = rank
    return out


def overlaid(rows: dict[int, dict[int, int]], seed: int = 3) -> tuple[list[int | None], list[int | None]]:
    """(starts, cells): the rows of a sparse table in one array, the longest first, each where its entries meet empty cells; a cell tells its row."""
    if max([*rows, *(x for row in rows.values() for x in row.values())], default=0) >> BITS:
        raise ValueError(f"ids of more than {BITS} bits")
    wide = max((max(row) for row in rows.values()), default=0) + 1
    size = wide + 4 * sum(map(len, rows.values()))
    rng, taken = np.random.default_rng(seed), np.zeros(size, bool)
    starts: list[int | None] = [None] * (max(rows, default=-1) + 1)
    cells: list[int | None] = [None] * size
    for left in sorted(rows, key=lambda x: (-len(rows[x]), x)):
        row, after = rows[left], np.fromiter(rows[left], np.int64)
        while taken[after + (start := int(rng.integers(0, size - wide + 1)))].any():
            pass
        taken[after + start] = True
        starts[left] = start
        for right, rank in row.items():
            cells[start + right] = (left << BITS) + rank
    return starts, cells


def folded(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces that joining from single bytes on comes to; for pieces of the file, to tell which of them it doesn't reach."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, at = min((ranks.get(x + y, 1 << BITS), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << BITS:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def _bind_all(values: list[Column], zero: Column, body: Callable[..., Column]) -> Column:
    """``body`` of several values, each of them computed once."""
    return body() if not values else _bind(values[0], zero, lambda first: _bind_all(values[1:], zero, lambda *rest: body(first, *rest)))


def rank_table(ranks: dict[bytes, int]) -> list[Column]:
    """The literals that ``fold_word`` reads: id of each byte, starts, cells, and pieces that the fold doesn't reach, by their Latin-1 text."""
    starts, cells = overlaid(joins(ranks))
    alone = {piece.decode("latin-1"): rank for piece, rank in ranks.items() if len(folded(piece, ranks)) > 1}
    own = [ranks.get(bytes([i])) for i in range(256)]
    return [_literal(own, "array<int>"), _literal(starts, "array<int>"), _literal(cells, "array<bigint>"), _literal(alone, "map<string,int>")]


def fold_word(word: Column, own: Column, starts: Column, cells: Column, alone: Column) -> Column:
    """Ids (array<int>) of one word (binary, not empty); the others are the bound columns of ``rank_table``."""
    text = F.decode(word, "ISO-8859-1")  # a character a byte

    def rank(left: Column, right: Column) -> Column:
        """Rank of the pair; null, or more than an id's bits and within twice as many, where it has none."""
        cell = F.get(cells, F.get(starts, left) + right)
        return (cell - F.shiftleft(left.cast("bigint"), BITS)).bitwiseAND(F.lit((1 << 2 * BITS) - 1))

    def started(ids: Column) -> Column:
        return F.struct(ids.alias("p"), F.zip_with(ids, F.slice(ids, F.lit(2), F.size(ids)), rank).alias("r"))

    # flatten and a least number that holds its place: concat of arrays and array_position cost several times as much where lambdas are interpreted
    spliced = lambda x, before, new, after: F.flatten(F.array(F.slice(x, F.lit(1), before), new, F.slice(x, after, F.size(x))))

    def joined(state: Column, best: Column) -> Column:
        p, at, new = state["p"], best.bitwiseAND(F.lit((1 << PLACES) - 1)).cast("int"), F.shiftright(best, PLACES).cast("int")
        beside = F.array(rank(F.get(p, at - 1), new), rank(new, F.get(p, at + 2)))
        return F.struct(spliced(p, at, F.array(new), at + 3).alias("p"), spliced(state["r"], at - 1, beside, at + 3).alias("r"))

    def step(state: Column, _: Column) -> Column:
        best = F.array_min(F.transform(state["r"], lambda x, i: F.shiftleft(x, PLACES) + i))
        return _bind(best, state, lambda x: F.when(x < (1 << (BITS + PLACES)), joined(state, x)).otherwise(state))

    # nothing stands before the first piece, so a pair always has a left neighbour
    ids = F.concat(F.array(F.lit(None).cast("int")), F.transform(F.split(text, ""), lambda c: F.get(own, F.ascii(c))))
    empty = F.struct(_no_ids().alias("p"), F.array().cast("array<bigint>").alias("r"))
    begun = _bind(ids, empty, started)
    done = F.aggregate(F.array_repeat(F.lit(0), F.octet_length(word) - 1), begun, step, lambda s: F.slice(s["p"], F.lit(2), F.size(s["p"])))
    return F.coalesce(F.when(alone[text].isNotNull(), F.array(alone[text])), done)


def _no_ids() -> Column:
    return F.array().cast("array<int>")


def _slot(word: Column) -> Column:
    return F.hash(word).bitwiseAND(SLOTS - 1)


def word_table(docs: DataFrame, ranks: list[Column], pattern: str) -> list[Column]:
    """The literals of the words folded ahead: by slot, the words or nulls, and their ids.

    At most ``SLOTS`` words of at most ``LONGEST`` bytes, from about ``SAMPLE`` documents, reach the driver.
    """
    n = docs.filter(F.col("text").isNotNull()).count()
    part = docs.filter(F.col("text").isNotNull())
    if n > SAMPLE:
        part = part.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.crc32(F.col("text").cast("binary"))), F.lit(n)) < SAMPLE)
    words = part.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("word")).groupBy("word").count()
    words = words.filter((F.octet_length("word") <= LONGEST) & (F.octet_length("word") > 0))
    best = words.groupBy(_slot(F.col("word")).alias("slot")).agg(F.max_by(F.col("word").cast("binary"), F.struct("count", "word")).alias("raw"))
    best = materialize(best, "words")
    told = best.select("slot", F.col("raw").cast("string").alias("word"), _bind_all(ranks, _no_ids(), lambda *r: fold_word(F.col("raw"), *r)).alias("ids"))
    held: list[str | None] = [None] * SLOTS
    ids: list[list[int] | None] = [None] * SLOTS
    for row in told.toLocalIterator(prefetchPartitions=True):
        held[row["slot"]], ids[row["slot"]] = row["word"], row["ids"]
    release(best)
    return [_literal(held, "array<string>"), _literal(ids, "array<array<int>>")]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of every whole text, as array<int>."""
    ranks, cut = rank_table(read_ranks(path or ranks_path())), java_pattern(pattern)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = word_table(docs, ranks, cut)

    def of_words(words: Column, told: Column, *ranks: Column) -> Column:
        def ids(word: Column) -> Column:
            known = F.when(F.get(words, _slot(word)) == word, F.get(told, _slot(word)))
            return F.coalesce(known, _bind(word.cast("binary"), _no_ids(), lambda w: fold_word(w, *ranks)))

        return F.flatten(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(cut), F.lit(0)), ids))

    ids = _bind_all([*known, *ranks], _no_ids(), of_words)
    return docs.select("doc_id", ids.alias("ids"))


def _spelt(ids: Column, table: list[str | None]) -> Column:
    """The bytes that ``table`` has in hexadecimal for each of the ids, joined."""
    return _bind(_literal(table, "array<string>"), F.lit(b""), lambda t: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(t, i)), "")))


def decode(ids: Column, path: str | None = None) -> Column:
    """The bytes of an array of ids: binary pieces, concatenated."""
    ranks = read_ranks(path or ranks_path())
    pieces: list[str | None] = [None] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    return _spelt(ids, pieces)


def packed(ids: Column, path: str | None = None) -> Column:
    """Ids as little-endian unsigned 32-bit integers in one binary value."""
    return _spelt(ids, [i.to_bytes(4, "little").hex() for i in range(max(read_ranks(path or ranks_path()).values()) + 1)])


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): ids as array<int>, decoded as binary."""
    return encode(docs, path).select("doc_id", "ids", decode(F.col("ids"), path).alias("decoded"))
