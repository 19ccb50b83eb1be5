"""Tracing of test items to a corpus: letters in common, verbatim windows, similarity of two texts by longest blocks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.functions.cleanup import is_transient

#: Letters of a window, letters between the starts of two, letters of its anchor; letters of a context that are compared.
WINDOW, STRIDE, ANCHOR, COMPARED = 50, 25, 16, 500
#: Kinds of items whose contexts are put together from several places, so that they are trusted.
TRUSTED = ("multi_hop_abstract", "course_discovery")
_PIECE = 50_000


def letter_counts(docs: DataFrame) -> DataFrame:
    """(letter, n) over all texts as they stand joined by blank lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(text)
                held["\n"] += 2
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["letter", "n"])

    counts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "letter string, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    return counts.select("letter", F.when(F.col("letter") == "\n", F.col("n") - 2).otherwise(F.col("n")).alias("n")).filter("n > 0")  # one blank line fewer than texts


def letter_ratio(contexts: DataFrame, letters: DataFrame) -> DataFrame:
    """(id, ratio): twice the letters that a context's beginning shares with the corpus over the letters of both; a bound from above of any matching of blocks."""
    start = F.substring("context", 1, COMPARED)
    own = contexts.select("id", F.length(start).alias("size"), F.explode(F.split(start, "")).alias("letter")).filter("letter <> ''").groupBy("id", "size", "letter").agg(F.count(F.lit(1)).alias("own"))
    total = letters.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))  # one row
    shared = own.join(letters, "letter").groupBy("id", "size").agg(F.sum(F.least("own", "n")).alias("shared")).join(F.broadcast(total))
    return shared.select("id", (2 * F.col("shared") / (F.col("size") + F.col("total"))).alias("ratio"))


def _anchors(text: str) -> Iterator[int]:
    """Places of the least-hashed ``ANCHOR`` letters of each window of a text, leftmost among equals, each once."""
    last = -1
    for at in range(0, max(len(text) - WINDOW + 1, 0), _PIECE):
        codes = np.frombuffer(text[at : at + _PIECE + WINDOW - 1].encode("utf-32-le"), np.uint32).astype(np.uint64)
        hashes = np.zeros(len(codes) - ANCHOR + 1, np.uint64)
        for k in range(ANCHOR):
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - ANCHOR + 1 + k]
        hashes ^= hashes >> np.uint64(31)
        hashes *= np.uint64(0xD6E8FEB86659FD93)
        span = WINDOW - ANCHOR + 1
        places = np.lib.stride_tricks.sliding_window_view(hashes, span).argmin(axis=1) + np.arange(len(hashes) - span + 1)
        for place in np.unique(places).tolist():
            if at + place > last:
                last = at + place
                yield last


def _anchored(texts: DataFrame, around: int) -> DataFrame:
    """(id, anchor, part) of (id, text): each anchor with the letters around it that a window with it may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, anchors, parts = [], [], []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for at in _anchors(text):
                    ids.append(id_)
                    anchors.append(text[at : at + ANCHOR])
                    parts.append(text[max(at - around, 0) : at + ANCHOR + around])
                    if len(ids) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(anchors), pa.array(parts)], ["id", "anchor", "part"])
                        ids, anchors, parts = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(anchors, pa.string()), pa.array(parts, pa.string())], ["id", "anchor", "part"])

    return texts.select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "id long, anchor string, part string")


def verbatim(contexts: DataFrame, docs: DataFrame) -> DataFrame:
    """(id) of contexts (id, context) one of whose windows stands verbatim in a text.

    A window is ``WINDOW`` letters from every ``STRIDE``-th place of the trimmed context. Each has one anchor, its least-hashed run of
    letters; a text that holds the window has the same anchor there. So windows and texts meet by a join on anchors, some one in seventeen
    places of a text, and what is around an anchor decides. Windows across two texts don't count.
    """
    trimmed = contexts.select("id", F.regexp_replace("context", r"(?U)^\s+|\s+$", "").alias("c")).filter(F.length("c") >= WINDOW)
    starts = F.sequence(F.lit(0), F.greatest(F.length("c") - WINDOW - 1, F.lit(0)), F.lit(STRIDE))
    windows = trimmed.select("id", F.explode(F.transform(starts, lambda s: F.substring(F.col("c"), s + 1, F.lit(WINDOW)))).alias("text"))
    asked = _anchored(windows, WINDOW - ANCHOR).select("id", "anchor", F.col("part").alias("window")).distinct()
    held = _anchored(docs.select(F.lit(0).alias("id"), "text"), WINDOW - ANCHOR).select("anchor", "part")
    return held.join(asked, "anchor").filter(F.contains("part", F.col("window"))).select("id").distinct()


def validated(items: DataFrame, docs: DataFrame, least_ratio: float = 0.3) -> DataFrame:
    """(item_id, verdict) of items (item_id, contexts, kind, question, answer): kept, empty, untraced or transient.

    An item needs a context; unless its kind is trusted, one of its contexts has to reach the ratio of letters or hold a verbatim window.
    Questions and answers with dates that pass go. ``item_id`` is unique; ``contexts`` is an array of strings, blank ones are passed over.
    """
    each = items.select("item_id", F.posexplode("contexts").alias("nth", "context")).filter(F.col("context").isNotNull() & (F.trim("context") != ""))
    each = each.select((F.xxhash64("item_id", "nth")).alias("id"), "item_id", "context")
    near = letter_ratio(each, letter_counts(docs)).filter(F.col("ratio") >= least_ratio).select("id")
    traced = near.unionByName(verbatim(each, docs)).distinct().join(each.select("id", "item_id"), "id").select("item_id", F.lit(True).alias("traced")).distinct()
    trusted = F.lit(False)
    for kind in TRUSTED:
        trusted = trusted | F.contains(F.lower(F.coalesce("kind", F.lit(""))), F.lit(kind))
    dated = is_transient(F.coalesce("question", F.lit(""))) | is_transient(F.coalesce("answer", F.lit("")))
    empty = F.coalesce(F.size("contexts"), F.lit(0)) <= 0
    verdict = F.when(empty, "empty").when(~trusted & F.col("traced").isNull(), "untraced").when(dated, "transient").otherwise("kept")
    return items.join(traced, "item_id", "left").select("item_id", verdict.alias("verdict"))


def _ratio(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    out = []
    for x, y, at in zip(a, b, least, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        match = SequenceMatcher(None, x, y)
        out.append(match.ratio() if match.quick_ratio() >= at else None)
    return pd.Series(out, dtype="float64")


def block_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """Ratcliff-Obershelp similarity of two texts by recursive longest blocks; null where it is sure to stay under ``least``, and for null texts.

    Lengths, then letters in common bound it from above, so that most unlike pairs cost no matching.
    """
    bound = F.when(F.length(a) + F.length(b) == 0, F.lit(1.0)).otherwise(2.0 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b)))
    enough = bound >= least
    # the texts of pairs that lengths settle aren't sent
    found = F.pandas_udf(_ratio, "double")(F.when(enough, a), F.when(enough, b), F.lit(least))
    return F.when(found >= least, found)
