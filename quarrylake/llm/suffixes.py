"""Exact removal of repeated byte strings: difference-cover suffix sorting of blocks that are dealt by content.

A byte goes if some ``WINDOW``-byte string that covers it also starts earlier (smaller doc_id, or the
same document further left). Sorting every suffix of the corpus would move it many times over, so
the work is first dealt by content, which loses nothing: every window has an anchor, its leftmost
least-hashed k-gram, and equal windows have equal anchors. The windows of one anchor form a short
segment. Then

1. anchors whose k-gram occurs once are left out (a count with map-side sums, then a join);
2. equal segments of one k-gram collapse to the earliest, all others go whole;
3. k-grams with several different segments send these segments' bytes to one place, where blocks of
   about 150 kilobytes are suffix-sorted: triples at two thirds of the places are sorted and named, the
   names are sorted by recursion, the other suffixes are merged in,
   and neighbours in that order whose window-long prefixes are equal form a group; all but the
   earliest of a group go;
4. a k-gram with more than ``WIDE`` segments deals its windows out one by one, by their hash;
5. what goes is gathered per document and cut out of its text.

So repeats whose whole segments are equal (2), and those of very wide groups (4), are told by hashes
(64 bits of the k-gram with 64 of the segment; SHA-256 of the window) and never meet a suffix sort.
The method dealt to this operator sorts the suffixes of all of the corpus; ``difference_cover`` does
that with Spark sorts, and README gives its measured cost, which is far beyond the bounds.

Defined cases: a null text counts as empty; null ids come before all others; rows that repeat an id
and its text are one document and get the same result; rows of one id with different texts are
ordered by a hash of the text; texts shorter than a window lose nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.common import bounded, fresh, materialize, release

WINDOW, GRAM, WIDE, BLOCK_BYTES = 100, 32, 2_000, 150_000
_PIECE = 100_000  # windows hashed at once
_FIRST = -(1 << 63)
_PLACE = np.uint64((1 << 24) - 1)


class _Hasher:
    """Polynomial hashes of all substrings of a buffer, from prefix sums modulo 2 ** 64."""

    rng = np.random.default_rng(20240607)
    tables = rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    bases = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
    powers: dict[int, np.ndarray] = {}

    @classmethod
    def power(cls, base: int, n: int) -> np.ndarray:
        have = cls.powers.get(base)
        if have is None or len(have) < n:
            size = 1 << max(16, (n - 1).bit_length())
            have = np.ones(size, np.uint64)
            m = 1
            while m < size:
                have[m : 2 * m] = have[:m] * np.uint64(pow(base, m, 1 << 64))
                m *= 2
            cls.powers[base] = have
        return have[:n]

    def __init__(self, data: np.ndarray, hashes: int = 2):
        n = len(data)
        self.sums = []
        for table, base in zip(self.tables[:hashes], self.bases[:hashes], strict=True):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(table[data] * self.power(pow(base, -1, 1 << 64), n), out=sums[1:])
            self.sums.append((sums, self.power(base, n + 1)))

    def one(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        sums, power = self.sums[which]
        x = (sums[end] - sums[start]) * power[start]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))

    def both(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.one(start, end) ^ (self.one(start, end, 1) * np.uint64(0x94D049BB133111EB))


def anchors(texts: list[bytes], window: int = WINDOW, gram: int = GRAM, segments: bool = True) -> tuple[np.ndarray, ...]:
    """(text, place, first window, last window, k-gram hash, segment hash) of every anchor, as arrays; segment hashes are zero unless asked for."""
    found: list[list[np.ndarray]] = [[] for _ in range(6)]
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not held:
            return
        data = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
        hashes = _Hasher(data, 2 if segments else 1)
        place = np.arange(len(data) - gram + 1)
        least = (hashes.one(place, place + gram) & ~_PLACE) | place.astype(np.uint64)
        width, step = window - gram + 1, 1
        while step * 2 <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if width > step:
            least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
        lengths = np.array([len(x[2]) for x in held])
        begins = np.cumsum(lengths) - lengths
        inside = np.zeros(len(data) + 1, np.int32)
        inside[begins] += 1
        inside[begins + lengths - window + 1] -= 1
        starts = np.flatnonzero(np.cumsum(inside)[: len(least)])
        at = (least[starts] & _PLACE).astype(np.int64)
        # a new segment where the anchor changes, or the text does
        owner = np.searchsorted(begins, starts, side="right") - 1
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
        first, last = starts[new], starts[np.r_[new[1:], len(starts)] - 1]
        p, own = at[new], owner[new]
        shift = begins[own] - np.array([x[1] for x in held])[own]
        shape = ((p - first) * 256 + (last - first)).astype(np.uint64)
        seg = hashes.both(first, last + window) + shape * np.uint64(0x9E3779B97F4A7C15) if segments else np.zeros(len(p), np.uint64)
        for col, x in zip(found, (np.array([x[0] for x in held])[own], p - shift, first - shift, last - shift, hashes.one(p, p + gram), seg), strict=True):
            col.append(x)
        held.clear()
        size = 0

    for i, text in enumerate(texts):
        for offset in range(0, len(text) - window + 1, _PIECE):
            part = text[offset : offset + _PIECE + window - 1]
            if size + len(part) > 2 * _PIECE:
                flush()
            held.append((i, offset, part))
            size += len(part)
    flush()
    kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return tuple(np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(found, kinds, strict=True))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of ``text`` (whole numbers from 1) in the order of their suffixes: triples, names,
    recursion on the names where some are equal, merging of the remaining third."""
    n = len(text)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.zeros(n + 4, np.int64)
    t[:n] = text
    n0, n2 = (n + 2) // 3, n // 3
    ones, twos = 3 * np.arange(n0) + 1, 3 * np.arange(n2) + 2  # a place past the end closes the first list if need be
    sample = np.concatenate([ones, twos])
    base = int(t.max()) + 1
    key = (t[sample] * base + t[sample + 1]) * base + t[sample + 2]
    order = np.argsort(key)
    ranked = key[order]
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(np.r_[True, ranked[1:] != ranked[:-1]])
    if names.max() < len(sample):
        order = suffix_order(names)
        names[order] = np.arange(1, len(order) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    sample = sample[order]
    sample = sample[sample < n]
    zeros = 3 * np.arange(n0)
    top = int(rank.max()) + 1
    zero_key = t[zeros] * top + rank[zeros + 1]
    by = np.argsort(zero_key)
    zeros, zero_key = zeros[by], zero_key[by]
    one, two = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted(t[one] * top + rank[one + 1], zero_key)
    before += np.searchsorted((t[two] * base + t[two + 1]) * top + rank[two + 2], (t[zeros] * base + t[zeros + 1]) * top + rank[zeros + 2])
    out = np.empty(n, np.int64)
    spots = before + np.arange(n0)
    out[spots] = zeros
    free = np.ones(n, bool)
    free[spots] = False
    out[free] = sample
    return out


def repeated_windows(segments: list[bytes], age: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(segment, first, last + 1) of runs of windows that occur in an earlier place of ``segments``.

    ``age[i]`` orders the first window of segment i among all; its next window has the next number.
    """
    data = np.frombuffer(b"".join(segments), np.uint8)
    lengths = np.array([len(s) for s in segments])
    begins = np.cumsum(lengths) - lengths
    own = np.repeat(np.arange(len(segments)), lengths)
    within = np.arange(len(data)) - begins[own]
    whole = within <= lengths[own] - window
    order = suffix_order(data.astype(np.int64) + 1)
    order = order[whole[order]]
    if not len(order):
        return []
    views = np.lib.stride_tricks.sliding_window_view(data, window)
    same = np.zeros(len(order), bool)
    for at in range(1, len(order), 100_000):
        to = min(at + 100_000, len(order))
        same[at:to] = (views[order[at:to]] == views[order[at - 1 : to - 1]]).all(axis=1)
    heads = np.flatnonzero(~same)
    ages = age[own[order]] + within[order]
    oldest = np.repeat(np.minimum.reduceat(ages, heads), np.diff(np.r_[heads, len(order)]))
    gone = np.sort(order[ages != oldest])
    if not len(gone):
        return []
    cut = np.flatnonzero(np.r_[True, (gone[1:] != gone[:-1] + 1) | (own[gone[1:]] != own[gone[:-1]])])
    first, last = gone[cut], gone[np.r_[cut[1:], len(gone)] - 1]
    return list(zip(own[first].tolist(), within[first].tolist(), (within[last] + 1).tolist(), strict=True))


def _batch(columns: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _anchor_rows(base: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, seg, id, h, spot): spot packs the anchor's place and the distances back to its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                texts = [(x.as_py() or "").encode() for x in part.column(2)]
                own, place, first, last, key, seg = anchors(texts, window, gram)
                spot = (place << 16) | ((place - first) << 8) | (place - last)
                ids, hs = (np.asarray(part.column(i)) for i in (0, 1))
                yield _batch([key.view(np.int64), seg.view(np.int64), ids[own], hs[own], spot], [pa.int64()] * 5, ["key", "seg", "id", "h", "spot"])

    return bounded(base).mapInArrow(run, "key long, seg long, id long, h long, spot long")


def _segment_bytes(wanted: DataFrame, base: DataFrame, window: int) -> DataFrame:
    """(key, wide, id, h, first, bytes) of wanted segments; ``wanted`` has (id, h, spots) a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out: list[list] = [[], [], [], [], [], []]
                for doc, h, text, spots in zip(*(part.column(i) for i in range(4)), strict=True):
                    raw = (text.as_py() or "").encode()
                    for s in spots.as_py():
                        place, back, to = s["spot"] >> 16, s["spot"] >> 8 & 255, s["spot"] & 255
                        for col, x in zip(out, (s["key"], s["wide"], doc.as_py(), h.as_py(), place - back, raw[place - back : place - to + window]), strict=True):
                            col.append(x)
                yield _batch(out, [pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.binary()], ["key", "wide", "id", "h", "first", "bytes"])

    joined = base.join(wanted, ["id", "h"]).select("id", "h", "text", "spots")
    return bounded(joined).mapInArrow(run, "key long, wide boolean, id long, h long, first long, bytes binary")


def _sorted_runs(segments: DataFrame, window: int) -> DataFrame:
    """(id, h, first, last) of window runs that go, from suffix-sorted blocks of whole k-gram groups."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = []
        if rows:
            ids = np.array([r[1] for r in rows], np.int64)
            hs = np.array([r[2] for r in rows], np.int64)
            order = np.lexsort((hs, ids))
            rank = np.empty(len(rows), np.int64)
            rank[order] = np.cumsum(np.r_[0, (ids[order][1:] != ids[order][:-1]) | (hs[order][1:] != hs[order][:-1])])
            age = (rank << 40) + np.array([r[3] for r in rows], np.int64)
            found = [(rows[i][1], rows[i][2], rows[i][3] + a, rows[i][3] + b - 1) for i, a, b in repeated_windows([r[4] for r in rows], age, window)]
        return _batch([[x[i] for x in found] for i in range(4)], [pa.int64()] * 4, ["id", "h", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []  # whole groups
        group: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if group and group[0][0] != row[0]:
                    ready += group
                    group = []
                    if size >= BLOCK_BYTES:
                        yield solve(ready)
                        ready, size = [], 0
                group.append(row)
                size += len(row[4])
        yield solve(ready + group)

    return segments.select("key", "id", "h", "first", "bytes").repartition("key").sortWithinPartitions("key").mapInArrow(run, "id long, h long, first long, last long")


def _single_windows(segments: DataFrame, window: int) -> DataFrame:
    """The same for segments of very wide groups, each window by itself: all but the earliest of a hash go."""
    each = segments.select("id", "h", F.col("first"), "bytes", F.explode(F.sequence(F.lit(1), F.octet_length("bytes") - window + 1)).alias("i"))
    hashed = each.select("id", "h", (F.col("first") + F.col("i") - 1).alias("first"), F.sha2(F.substring("bytes", F.col("i"), F.lit(window)), 256).alias("key"))
    oldest = hashed.groupBy("key").agg(F.min(F.struct("id", "h", "first")).alias("oldest"))
    return hashed.join(oldest, "key").filter(F.struct("id", "h", "first") != F.col("oldest")).select("id", "h", "first", F.col("first").alias("last"))


def _tidy(df: DataFrame) -> None:
    """Let the shuffle files of finished steps go before the next step writes its own."""
    import gc

    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def _anchor_keys(base: DataFrame, window: int, gram: int) -> DataFrame:
    """(key) of every anchor: all that counting them needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                texts = [(x.as_py() or "").encode() for x in batch.slice(at, 400).column(0)]
                yield _batch([anchors(texts, window, gram, segments=False)[4].view(np.int64)], [pa.int64()], ["key"])

    return bounded(base.select("text")).mapInArrow(run, "key long")


def runs_to_remove(base: DataFrame, window: int = WINDOW, gram: int = GRAM, wide: int = WIDE) -> DataFrame:
    """(id, h, first, last): runs of windows of a document that occur earlier. ``base``: id, h, text."""
    rows = _anchor_rows(base, window, gram)
    often = materialize(_anchor_keys(base, window, gram).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "often")
    _tidy(base)
    met = materialize(rows.join(often, "key"), "met")
    release(often)
    _tidy(base)
    segments = met.groupBy("key", "seg").agg(F.min(F.struct("id", "h", "spot")).alias("oldest"), F.count(F.lit(1)).alias("n"))
    segments = materialize(segments, "segments")
    place, back, to = F.shiftrightunsigned("spot", 16), F.shiftrightunsigned("spot", 8).bitwiseAND(255), F.col("spot").bitwiseAND(255)
    later = met.join(segments.filter("n > 1").select("key", "seg", "oldest"), ["key", "seg"]).filter(F.struct("id", "h", "spot") != F.col("oldest"))
    copies = materialize(later.select("id", "h", (place - back).alias("first"), (place - to).alias("last")), "copies")
    release(met)
    several = segments.groupBy("key").agg(F.count(F.lit(1)).alias("width")).filter("width > 1")
    owners = segments.join(several, "key").select("key", "oldest.*", (F.col("width") > wide).alias("wide"))
    _tidy(base)
    wanted = owners.groupBy("id", "h").agg(F.collect_list(F.struct("key", "spot", "wide")).alias("spots"))
    met_bytes = materialize(_segment_bytes(wanted, base, window), "bytes")  # texts move once for both kinds of group
    release(segments)
    _tidy(base)
    out = copies.unionByName(materialize(_sorted_runs(met_bytes.filter("not wide"), window), "sorted"))
    very_wide = met_bytes.filter("wide")
    if not very_wide.isEmpty():
        out = out.unionByName(materialize(_single_windows(very_wide, window), "single"))
    release(met_bytes)
    _tidy(base)
    return out


def cut(raw: bytes, runs: list[tuple[int, int]], window: int = WINDOW) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed byte runs (start, end), and the bytes that stay."""
    spans: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if spans and first <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], last + window))
        else:
            spans.append((first, last + window))
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return spans, b"".join([*kept, raw[at:]])


def _base(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def cut_texts(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, wide: int = WIDE) -> DataFrame:
    """``docs`` with repeated byte strings cut out of ``text``; what is left of a character cut apart goes too.

    Documents of which nothing is left go; those that were null or empty before stay as they are.
    """
    id_, h, runs = (fresh(docs, x) for x in ("cut_id", "cut_h", "cut_runs"))
    gone = runs_to_remove(_base(docs), window, gram, wide).groupBy("id", "h").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    gone = gone.select(F.col("id").alias(id_), F.col("h").alias(h), F.transform("runs", lambda r: F.array(r["first"], r["last"])).alias(runs))
    keyed = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST))).withColumn(h, F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(gone, [id_, h], "left").select(*docs.columns, runs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(batch.num_columns - 1)
            part = batch.select(range(batch.num_columns - 1))
            if found.null_count < batch.num_rows:
                new, keep = [], []
                for text, r in zip(part.column(at), found, strict=True):
                    text, r = text.as_py(), r.as_py()
                    if r is not None and text is not None:
                        text = cut(text.encode(), [tuple(x) for x in r], window)[1].decode("utf-8", "ignore")
                        keep.append(bool(text))
                    else:
                        keep.append(True)
                    new.append(text)
                field = part.schema.field(at)
                part = part.set_column(at, field, pa.array(new, field.type)).filter(pa.array(keep, pa.bool_()))
            yield part

    return bounded(joined).mapInArrow(run, docs.schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, wide: int = WIDE) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: removed byte runs, and the remaining bytes."""
    base = _base(docs)
    gone = runs_to_remove(base, window, gram, wide).groupBy("id", "h").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    joined = base.join(gone, ["id", "h"], "left").select("id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                raws = [(x.as_py() or "").encode() for x in part.column(1)]
                cuts = [cut(raw, [(r["first"], r["last"]) for r in x.as_py() or ()], window) for raw, x in zip(raws, part.column(2), strict=True)]
                ids = [None if x == _FIRST else x for x in part.column(0).to_pylist()]
                spans = [[{"start": a, "end": b} for a, b in s] for s, _ in cuts]
                yield _batch([ids, [len(r) for r in raws], spans, [k for _, k in cuts]], [pa.int64(), pa.int64(), spans_type, pa.binary()], ["doc_id", "n_bytes", "spans", "kept"])

    return bounded(joined).mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def oracle(window: int = WINDOW) -> str:
    """DuckDB SQL for the digest rows over ``documents``: every window by its content, on hexadecimal text."""
    return f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
w AS (SELECT r, s, hash(substr(hx, (2 * s + 1)::INTEGER, {2 * window})) AS k FROM d, unnest(range((len(hx) // 2 - {window} + 1)::BIGINT)) t(s)),
gone AS (SELECT r, s FROM (SELECT r, s, row_number() OVER (PARTITION BY k ORDER BY r, s) AS n FROM w) WHERE n > 1),
head AS (SELECT r, s, sum(CASE WHEN s <= before + {window} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY s) AS g
  FROM (SELECT r, s, coalesce(lag(s) OVER (PARTITION BY r ORDER BY s), -1000000) AS before FROM gone)),
span AS (SELECT r, g, min(s) AS a, max(s) + {window} AS b FROM head GROUP BY r, g),
piece AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS prev FROM span),
cut AS (SELECT p.r, sum(p.b - p.a)::BIGINT AS n_removed, count(*) AS n_spans, max(p.b) AS tail,
  string_agg(substr(d.hx, (2 * p.prev + 1)::INTEGER, (2 * (p.a - p.prev))::INTEGER), '' ORDER BY p.a) AS hx FROM piece p JOIN d USING (r) GROUP BY p.r)
SELECT d.doc_id, (len(d.hx) // 2)::BIGINT AS n_bytes, coalesce(c.n_removed, 0)::BIGINT AS n_removed, coalesce(c.n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN c.r IS NULL THEN d.hx ELSE c.hx || substr(d.hx, (2 * c.tail + 1)::INTEGER) END)) AS kept_sha256
FROM d LEFT JOIN cut c USING (r)
"""
