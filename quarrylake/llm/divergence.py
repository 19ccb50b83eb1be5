"""How far the sources of a language differ: shares of every kept term, held against each other in two-dimensional tiles.

1. Each task counts the terms of its documents by language and source; sums of these follow.
2. A language keeps the terms that at least ``LEAST_DOCS`` of its documents hold. Kept terms are dealt
   to chunks of about ``CHUNK`` by their hash and numbered there; a group's counts in a chunk are packed
   into one row.
3. A language's groups are dealt to blocks of about ``BLOCK``. Two blocks make a tile; each row goes to
   every tile of its block. A task reads its tiles chunk by chunk, holds the counts of one chunk, and adds
   to the tile's matrix of differences. Terms that no group of a tile holds count by their number.
4. The terms in which a group exceeds its language are ranked from the same counts.

Shares are whole numbers: 1 + floor(10**9 (count + 5) / (N + 5 V)); decimals and long integers hold all
products, so the arithmetic is exact while N + 5 V stays under 10**18.

Defined cases: null text, lang or source counts as ''; a group whose documents hold no kept term has
shares of count zero; a language without kept terms has pairs of value 0 and no term rows; a language
with one source has no pairs; repeated rows count each; doc_id and other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.llm.common import bounded, materialize

LEAST_DOCS, TOP_TERMS, SMOOTH, SCALE = 30, 50, 5, 1_000_000_000
#: Groups of a block, terms of a chunk, tallies that a counting task holds before it hands them on.
BLOCK, CHUNK, HELD = 16, 4_096, 300_000
#: Bytes of a lower-cased text: letters and all that isn't ASCII stay, the rest parts terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def tallies(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of parts of the documents; a row without term tells of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                for at in range(0, len(n) + 1, 50_000):
                    terms = list(n)[at : at + 50_000]
                    rows = [None, *terms] if at == 0 else terms
                    counts = [[of[t] for t in rows] for of in (n, docs)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(rows), pa.string()), pa.array([source] * len(rows), pa.string()), pa.array(rows, pa.binary()).cast(pa.string()), *(pa.array(c, pa.int64()) for c in counts)],
                        ["lang", "source", "term", "n", "docs"],
                    )
            held.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                terms = text.translate(_TERM_BYTES).split()
                n.update(terms)
                docs.update(set(terms))
                size += len(n) - before
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    there = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(there("lang").alias("lang"), there("source").alias("source"), there("text").cast("binary").alias("text"))
    return bounded(rows).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of kept terms, one row of each term first; a row without term for each group."""
    by_term = Window.partitionBy("lang", "term")
    counts = tallies(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    known = counts.select(
        "lang", "source", "term", "n", F.sum("n").over(by_term).alias("lang_n"), F.sum("docs").over(by_term).alias("lang_docs"), (F.row_number().over(by_term.orderBy("source")) == 1).alias("first")
    )
    return known.filter(F.col("term").isNull() | (F.col("lang_docs") >= least_docs)).select("lang", "source", "term", "n", "lang_n", (F.col("first") & F.col("term").isNotNull()).alias("first"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 5) / (total + 5 terms)), exactly."""
    whole = lambda c: c.cast("decimal(18,0)")
    up = whole(n + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", up, whole(total + terms * SMOOTH)) + 1


def shares(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """The same for a matrix, a group a row."""
    down = (totals + SMOOTH * terms)[:, None]
    if counts.size and counts.max() >= (1 << 63) // SCALE - SMOOTH:
        return ((counts.astype(object) + SMOOTH) * SCALE // down.astype(object) + 1).astype(np.int64)
    return (counts + SMOOTH) * SCALE // down + 1


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by tile and chunk, those of a tile's groups (chunk -1) first."""
    tile, chunk, groups = None, -1, []
    rows: list[tuple] = []
    seen = 0

    def add() -> None:
        nonlocal seen
        if not rows:
            return
        size = rows[0][1]
        dense = np.zeros((len(groups), size), np.int64)
        for who, _, places, counts in rows:
            dense[number[who], places] = counts
        spread(shares(dense, totals, terms), 1)
        seen += size
        rows.clear()

    def spread(p: np.ndarray, times: int) -> None:
        for a in range(len(groups)):
            matrix[a] += np.abs(p - p[a]).sum(axis=1) * times

    def out() -> Iterator[pa.RecordBatch]:
        if tile is None:
            return
        add()
        if chunk < 0:
            ready()
        if terms > seen:
            spread(shares(np.zeros((len(groups), 1), np.int64), totals, terms), terms - seen)
        lang, i, j = tile
        pairs = [(a, b) for a in range(len(groups)) for b in range(len(groups)) if a != b and (i == j or groups[a][1] != groups[b][1])]
        for at in range(0, len(pairs), 50_000):
            part = pairs[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part), pa.string()), pa.array([groups[a][0] for a, _ in part], pa.string()), pa.array([groups[b][0] for _, b in part], pa.string()), pa.array([int(matrix[a, b]) for a, b in part], pa.int64())],
                ["lang", "source", "item", "value"],
            )

    def ready() -> None:
        nonlocal number, totals, matrix
        number = {g[0]: k for k, g in enumerate(groups)}
        totals = np.array([g[2] for g in groups], np.int64)
        matrix = np.zeros((len(groups), len(groups)), np.int64)

    number: dict[str, int] = {}
    totals, matrix, terms = np.zeros(0, np.int64), np.zeros((0, 0), np.int64), 0
    for batch in batches:
        for row in batch.to_pylist():
            at = row["lang"], row["i"], row["j"]
            if at != tile:
                yield from out()
                tile, chunk, groups, seen = at, -1, [], 0
            if row["chunk"] < 0:
                groups.append((row["source"], row["block"], row["total"]))
                terms = row["terms"]
                continue
            if chunk < 0:
                ready()
            if row["chunk"] != chunk:
                add()
                chunk = row["chunk"]
            rows.append((row["source"], row["size"], row["places"], row["counts"]))
    yield from out()


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources, terms in excess of the language."""
    counts = materialize(kept_counts(docs, least_docs), "terms")
    terms = counts.filter(F.col("term").isNotNull())
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = counts.groupBy("lang").agg(
        F.sum("n").alias("lang_total"),
        F.sum(F.col("first").cast("long")).alias("terms"),
        F.sum(F.col("term").isNull().cast("long")).alias("sources"),
    )
    groups = materialize(groups.join(langs, "lang"), "groups")

    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    above = terms.filter("n > 0").join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    excess = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)

    blocks = F.greatest(F.ceil(F.col("sources") / BLOCK), F.lit(1)).cast("int")
    placed = groups.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    chunks = F.greatest(F.ceil(F.col("terms") / CHUNK), F.lit(1)).cast("int")
    numbered = terms.filter("first").select("lang", "term").join(langs.select("lang", "terms"), "lang").select("lang", "term", F.pmod(F.xxhash64("term"), chunks).cast("int").alias("chunk"))
    by_chunk = Window.partitionBy("lang", "chunk")
    numbered = numbered.select("lang", "term", "chunk", (F.row_number().over(by_chunk.orderBy("term")) - 1).alias("place"), F.count("*").over(by_chunk).cast("int").alias("size"))
    packed = (
        terms.join(numbered, ["lang", "term"])
        .groupBy("lang", "source", "chunk", "size")
        .agg(F.collect_list(F.struct("place", "n")).alias("cells"))
        .select("lang", "source", "chunk", "size", F.col("cells.place").alias("places"), F.col("cells.n").alias("counts"))
    )
    no_cells = [F.lit(-1).alias("chunk"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("places"), F.array().cast("array<bigint>").alias("counts")]
    heads = groups.select("lang", "source", *no_cells)
    vectors = packed.unionByName(heads).join(placed, ["lang", "source"])
    dealt = vectors.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "chunk", "source", "block", "total", "terms", "size", "places", "counts")
    tiles = dealt.repartition("lang", "i", "j").sortWithinPartitions("lang", "i", "j", "chunk", "source")
    pairs = bounded(tiles).mapInArrow(_tiles, "lang string, source string, item string, value long")
    far = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return far.unionByName(excess)


def oracle(least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> str:
    """DuckDB SQL for the same rows over ``documents``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    share = lambda n, total: f"(1 + ({SCALE}::HUGEINT * ({n} + {SMOOTH})) // ({total} + {SMOOTH} * v.terms))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS found FROM documents),
t AS (SELECT id, lang, source, unnest(found) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= {least_docs}),
v AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, sum(n) AS total FROM f GROUP BY ALL),
p AS (SELECT f.lang, f.source, f.term, f.n, {share("f.n", "s.total")} AS p, {share("f.lang_n", "v.total")} AS q FROM f JOIN s USING (lang, source) JOIN v USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
above AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM far
UNION ALL
SELECT lang, source, 'term', item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM above QUALIFY rank <= {top_terms}
"""
