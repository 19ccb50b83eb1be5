"""Phrases whose words stand together more often than apart: count-min sketches first, exact counts of what survives them.

1. Each task sketches its words, pairs and triples: ``ROWS`` rows of cells, each cell up to
   ``LEAST`` at most, two cells a byte, compressed. Sketches are merged cell by cell. A sum of counts that are cut at
   ``LEAST`` reaches ``LEAST`` just when the uncut one does, so a merged cell tells for certain that
   nothing in it is frequent enough; it can't lose a frequent phrase.
2. The cells that reach ``LEAST`` are bits, at most ``ROWS`` * 2**``WIDTH`` of them, which is the bound of
   what is broadcast. The second pass counts exactly, by words and not by hashes, what has its bits set
   and whose parts have theirs, and keeps what really is frequent. More text than the bits can tell
   apart only leaves more to count.
3. Candidates meet the counts of their parts, the lowest-scoring cut counts, pairs that a triple
   accounts for go, and each language's first phrases are ranked, salted first.

Scores are decimals: exact for counts under 10**14.

Defined cases: null text is empty; null lang is ``und``; a language without candidates has no rows;
equal scores fall to the smaller cut and then to the phrase; repeated rows count each; other columns
are ignored. An overlong word is a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.llm.common import bounded, materialize

LEAST, SHOWN, COVER = 10, 2_000, 50
#: Rows of a sketch; bits of a row's width, the same for every input, as each task sends its own; cells of a block; words of a part; phrases sketched at once; held before they are handed on.
ROWS, WIDTH, BLOCK, PART, AT_ONCE, HELD = 3, 26, 1 << 16, 200_000, 2_000_000, 2_000_000
#: Words that a task numbers; three numbers fit in one long integer.
_BITS = 21
_SALTS = 32
#: Bytes of a lower-cased text: ends of pieces become line ends, tabs become spaces.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)


class _Words(dict):
    """Numbers and hashes of a language's words, in one task."""

    def __init__(self, lang: str):
        super().__init__()
        self.seed = xxhash.xxh64_intdigest(lang.encode())
        self.texts: list[bytes] = []
        self.hashes = np.zeros(1 << 12, np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.texts)
        self.texts.append(word)
        if number == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(number, np.uint64)])
        self.hashes[number] = xxhash.xxh64_intdigest(word, self.seed)
        return number

    def restart(self) -> None:
        self.clear()
        self.texts.clear()


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    got = (left ^ (left >> np.uint64(29))) * np.uint64(_ODD[0]) + right
    return (got ^ (got >> np.uint64(32))) * np.uint64(_ODD[1])


class _Grams:
    """Words of pieces of one language, by number; where each size starts; which places are this part's own."""

    def __init__(self, words: _Words, pieces: list[list[bytes]], own: list[int]):
        lengths = [len(p) for p in pieces]
        n = sum(lengths)
        self.numbers = np.fromiter((number for p in pieces for number in map(words.__getitem__, p)), np.int64, n)
        of = np.repeat(np.arange(len(pieces)), lengths)
        inside = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.own = inside < np.repeat(own, lengths)
        pair = of[:-1] == of[1:]
        self.starts = [np.arange(n), np.flatnonzero(pair), np.flatnonzero(pair[:-1] & pair[1:])]
        h = words.hashes[self.numbers]
        two_at = np.zeros(n, np.uint64)
        two_at[self.starts[1]] = two = _mixed(h[self.starts[1]], h[self.starts[1] + 1])
        self.hashes = [_mixed(h, h), two, _mixed(two_at[self.starts[2]] ^ np.uint64(_ODD[2]), h[self.starts[2] + 2])]


def _parts(words: _Words, texts: list[bytes], most: int) -> Iterator[_Grams]:
    """Parts of about ``most`` words; a longer piece is cut, and a part then reads two words of the next."""
    pieces: list[list[bytes]] = []
    own: list[int] = []
    size = 0
    for text in texts:
        for piece in text.translate(_BYTES).split(b"\n"):
            found = [w for w in piece.split(b" ") if w]
            for at in range(0, len(found), most):
                pieces.append(found[at : at + most + 2])
                own.append(min(most, len(found) - at))
                size += own[-1]
                if size >= most:
                    yield _Grams(words, pieces, own)
                    pieces, own, size = [], [], 0
    if pieces:
        yield _Grams(words, pieces, own)


def _cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    return ((hashes * np.uint64(_ODD[row + 2])) >> np.uint64(64 - width)).astype(np.uint32)


def _by_lang(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        texts.setdefault(lang, []).append(text)
    return texts


def _sketched(width: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((ROWS, 1 << width), np.uint8)
        words: dict[str, _Words] = {}
        held: list[np.ndarray] = []

        def add() -> None:
            hashes = np.concatenate(held)
            held.clear()
            for row in range(ROWS):
                cells = np.sort(_cells(hashes, row, width))
                first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
                times = np.diff(first, append=len(cells))
                at = cells[first]
                sketch[row, at] = np.minimum(sketch[row, at] + np.minimum(times, least), least)

        for batch in batches:
            for lang, texts in _by_lang(batch).items():
                known = words.setdefault(lang, _Words(lang))
                for grams in _parts(known, texts, PART):
                    held += [h[grams.own[at]] for h, at in zip(grams.hashes, grams.starts, strict=True)]
                    if sum(map(len, held)) > AT_ONCE:
                        add()
                    if len(known) > 1 << _BITS - 3:  # hashes go by the word, so numbers may start anew
                        known.restart()
        if held:
            add()
        block = min(BLOCK, 1 << width)
        for row in range(ROWS):
            for at in range(0, 1 << width, block):
                part = sketch[row, at : at + block]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([at // block], pa.int32()), pa.array([pa.compress((part[::2] | part[1::2] << 4).tobytes(), "zstd", asbytes=True)], pa.binary())], ["row", "block", "cells"])

    return run


def _merged(width: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cells of many sketches, added; out come bits of those that reach ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                packed = np.frombuffer(pa.decompress(row["cells"], min(BLOCK, 1 << width) // 2, "zstd"), np.uint8)
                cells = np.stack([packed & 15, packed >> 4], 1).ravel()
                key = row["row"], row["block"]
                sums[key] = np.minimum(sums[key] + cells, least) if key in sums else cells
        for (row, block), cells in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([np.packbits(cells >= least, bitorder="little").tobytes()], pa.binary())], ["row", "block", "bits"])

    return run


def _counted(width: int, bits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, size, phrase, n) of parts of the documents, of what the bits let pass; size 0 counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [np.frombuffer(row, np.uint8) for row in bits.value]
        words: dict[str, _Words] = {}
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        totals: dict[str, int] = {}
        told = 0

        def passed(hashes: np.ndarray) -> np.ndarray:
            ok = np.ones(len(hashes), bool)
            for row in range(ROWS):
                cells = _cells(hashes, row, width)
                ok &= (table[row][cells >> np.uint32(3)] >> (cells & np.uint32(7)).astype(np.uint8) & 1).astype(bool)
            return ok

        def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, counts = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(counts, first)

        def waiting() -> int:
            return sum(len(keys) for parts in held.values() for keys, _ in parts)

        def out(lang: str) -> Iterator[pa.RecordBatch]:
            texts = words[lang].texts
            for size in (1, 2, 3):
                if not held.get((lang, size)):
                    continue
                keys, counts = joined(held.pop((lang, size)))
                for at in range(0, len(keys), 50_000):
                    part = keys[at : at + 50_000]
                    numbers = [(part >> _BITS * k & (1 << _BITS) - 1).tolist() for k in reversed(range(size))]
                    phrases = [b" ".join([texts[i] for i in who]) for who in zip(*numbers, strict=True)]
                    rows = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * rows, pa.string()), pa.array(np.full(rows, size, np.int32)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts[at : at + 50_000], pa.int64())], ["lang", "size", "phrase", "n"]
                    )

        for batch in batches:
            for lang, texts in _by_lang(batch).items():
                for grams in _parts(words.setdefault(lang, _Words(lang)), texts, PART):
                    totals[lang] = totals.get(lang, 0) + int(grams.own.sum())
                    alive = np.zeros((3, len(grams.numbers) + 2), bool)
                    for size in (1, 2, 3):
                        at = grams.starts[size - 1]
                        ok = passed(grams.hashes[size - 1])
                        if size > 1:
                            ok &= alive[size - 2, at] & alive[size - 2, at + 1]
                        alive[size - 1, at[ok]] = True
                        at = at[ok & grams.own[at]]
                        keys = grams.numbers[at]
                        for k in range(1, size):
                            keys = keys << _BITS | grams.numbers[at + k]
                        if len(keys):
                            held.setdefault((lang, size), []).append((keys, np.ones(len(keys), np.int64)))
                    if len(words[lang]) > 1 << _BITS - 1:
                        yield from out(lang)
                        words[lang].restart()
                        told = min(told, waiting())
                    if waiting() - told > HELD:  # so many since they were last summed
                        for key, parts in held.items():
                            held[key] = [joined(parts)]
                        if waiting() > HELD * 3 // 2:
                            for of in words:
                                yield from out(of)
                        told = waiting()
        for lang in words:
            yield from out(lang)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([0] * len(totals), pa.int32()), pa.array([""] * len(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], ["lang", "size", "phrase", "n"])

    return run


def frequent(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, size, phrase, n): exact counts of every word, pair and triple that occurs ``least`` times; size 0 has all words. ``least`` is at most 15."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    width = WIDTH
    sketches = bounded(rows).mapInArrow(_sketched(width, least), "row int, block int, cells binary")
    bits = sketches.repartition("row", "block").mapInArrow(_merged(width, least), "row int, block int, bits binary")
    block = min(BLOCK, 1 << width) // 8
    table = [bytearray((1 << width) // 8) for _ in range(ROWS)]
    for row in bits.toLocalIterator():
        table[row["row"]][row["block"] * block : (row["block"] + 1) * block] = row["bits"]
    shared = docs.sparkSession.sparkContext.broadcast([bytes(row) for row in table])
    parts = rows.mapInArrow(_counted(width, shared), "lang string, size int, phrase string, n long")
    counts = materialize(parts.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter((F.col("size") == 0) | (F.col("n") >= least)), "phrases")
    shared.unpersist()
    return counts.select("lang", "size", "phrase", "n")


def _score(a: str, left: str, right: str) -> Column:
    """floor(10**6 a a / (left right))."""
    whole = lambda c: F.col(c).cast("decimal(14,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (whole(a) * whole(a)), whole(left) * whole(right))


def mine(docs: DataFrame, least: int = LEAST, shown: int = SHOWN) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first phrases."""
    counts = frequent(docs, least)
    known = counts.filter("size > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("times"))

    def with_count(of: DataFrame, part: Column, name: str) -> DataFrame:
        return of.withColumn("part", part).join(known.withColumnRenamed("times", name), ["lang", "part"]).drop("part")

    word = lambda k: F.get(F.split("phrase", " "), k)
    both = lambda k: F.concat_ws(" ", word(k), word(k + 1))
    found = counts.select("lang", "phrase", "size", F.col("n").alias("a"))
    three = found.filter("size = 3")
    covers = three.select("lang", both(0).alias("phrase"), "a").unionByName(three.select("lang", both(1).alias("phrase"), "a")).groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    two = found.filter("size = 2").join(covers, ["lang", "phrase"], "left").filter((100 * F.coalesce("cover", F.lit(0))) < COVER * F.col("a"))
    two = with_count(with_count(two, word(0), "l"), word(1), "r").select("lang", "phrase", "a", "l", "r", _score("a", "l", "r").alias("score"))
    for part, name in ((word(0), "l1"), (both(1), "r1"), (both(0), "l2"), (word(2), "r2")):
        three = with_count(three, part, name)
    three = three.select("*", _score("a", "l1", "r1").alias("s1"), _score("a", "l2", "r2").alias("s2"))
    second = F.col("s2") < F.col("s1")
    pick = lambda stem: F.when(second, F.col(f"{stem}2")).otherwise(F.col(f"{stem}1"))
    three = three.select("lang", "phrase", "a", pick("l").alias("l"), pick("r").alias("r"), pick("s").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    scored = two.unionByName(three).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    first = scored.withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("at") <= shown)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= shown)
    totals = counts.filter("size = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = LEAST, shown: int = SHOWN) -> str:
    """DuckDB SQL for the same rows over ``documents``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, (VALUES (1), (2), (3)) s(size))),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS n FROM g GROUP BY ALL),
n AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND n >= {least}),
halves AS MATERIALIZED (SELECT *, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
cut AS (SELECT h.*, l.n AS l, r.n AS r, ((1000000::HUGEINT * h.a * h.a) // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM halves h JOIN f l ON l.lang = h.lang AND l.phrase = h.lp JOIN f r ON r.lang = h.lang AND r.phrase = h.rp),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
cover AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, array_to_string(ws[1:2], ' ') AS phrase FROM c WHERE size = 3 UNION ALL SELECT lang, a, array_to_string(ws[2:3], ' ') FROM c WHERE size = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN cover o ON o.lang = b.lang AND o.phrase = b.phrase AND b.size = 2 WHERE o.a IS NULL OR 100 * o.a < {COVER} * b.a)
SELECT k.lang, (row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase))::INTEGER AS rank, phrase, a, l, r, n.n, score
FROM kept k JOIN n USING (lang) QUALIFY rank <= {shown}
"""
