"""Language identification by words first, then ever shorter character n-grams.

Known words score by their log frequency in each language. A word no language knows is cut into
character n-grams (its ends marked): the longest length of which some n-gram is known decides, at a
price for each step down. Frequencies are learnt from a bounded sample of labelled documents: every
item that occurs ``LEAST_COUNT`` times there is kept, so it is the sample alone that bounds what is
sent to the tasks. Every whole text is scored.

Defined cases: a null text, or one without letters, gets ``und`` and score 0, as does every text
where nothing could be learnt (no labelled rows); a null label isn't learnt from; repeated rows are
scored alike, each in its own row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.common import bounded, held_out

#: Labelled documents to learn from (by hash of the id, so in expectation), and how often an item has to occur in them.
SAMPLE_DOCUMENTS, LEAST_COUNT, LONGEST_GRAM = 20_000, 2, 4
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return _WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Log frequencies of words and n-grams, one column a language.

    Words are looked up in a dictionary, n-grams in sorted arrays, which hold many times as many in
    the same memory; a Python worker keeps one model.
    """

    def __init__(self, languages: list[str], tables: list[tuple[list[str], np.ndarray]], drop: float = 1.0):
        """``tables``: (items, a row of log frequencies each) of words first, then of n-grams by falling length; ``drop``: log price of a step down."""
        self.languages = languages
        self.words = {w: i for i, w in enumerate(tables[0][0])}
        self.matrix = np.asarray(tables[0][1], np.float32).reshape(len(tables[0][0]), len(languages))
        self.grams, self.gram_rows = [], []
        for step, (items, rows) in enumerate(tables[1:]):
            known = np.array(items, f"U{len(tables) - 1 - step}")
            order = np.argsort(known)
            self.grams.append(known[order])
            self.gram_rows.append(np.asarray(rows, np.float32).reshape(len(items), len(languages))[order])
        self.drop = drop

    def unseen(self, word: str) -> np.ndarray:
        for step, (known, rows) in enumerate(zip(self.grams, self.gram_rows, strict=True)):
            asked = np.array(grams(word, len(self.grams) - step), known.dtype)
            if len(known) and len(asked):
                at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                at = at[known[at] == asked]
                if len(at):
                    return rows[at].mean(axis=0, dtype=np.float64) - self.drop * (step + 1)
        return np.zeros(len(self.languages))

    def predict(self, text: str | None) -> tuple[str, float]:
        found = Counter(words(text)) if text else None
        if not found or not self.languages or not any(c.isalpha() for word in found for c in word):
            return UNDETERMINED, 0.0
        rows, counts, total = [], [], np.zeros(len(self.languages))
        at = self.words.get
        for word, n in found.items():
            if (i := at(word)) is not None:
                rows.append(i)
                counts.append(n)
            else:
                total = total + n * self._unseen(word)
        if rows:
            total = total + np.array(counts) @ self.matrix[rows]
        seen = found.total()
        # a long text is no surer than 20 words of the same mean
        weight = np.exp((total - total.max()) * (min(seen, 20) / seen))
        best = int(total.argmax())
        return self.languages[best], float(weight[best] / weight.sum())

    @property
    def _unseen(self):
        if "_cache" not in self.__dict__:
            self.__dict__["_cache"] = lru_cache(20_000)(self.unseen)
        return self.__dict__["_cache"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_cache"}


def sample_labelled(docs: DataFrame, label: str, limit: int) -> DataFrame:
    """Rows to learn from: labelled, not held out, about ``limit`` of them by a hash of the id."""
    rows = docs.filter(F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    n = rows.count()
    if n <= limit:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * limit / n))


def train(docs: DataFrame, limit: int = SAMPLE_DOCUMENTS, least: int = LEAST_COUNT) -> Model:
    """Learn from ``docs`` (doc_id, text, lang) what occurs ``least`` times; ids only decide which rows may be learnt from."""
    rows = sample_labelled(docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull()), "lang", limit)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, int], Counter] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, size), found in totals.items():
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([size] * n, pa.int32()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "size", "item", "n"])
            totals.clear()

        for batch in batches:
            by_lang: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by_lang.setdefault(lang, Counter()).update(words(text.as_py()))
            for lang, found in by_lang.items():
                for size in range(LONGEST_GRAM + 1):
                    own = totals.setdefault((lang, size), Counter())
                    held -= len(own)
                    for word, n in found.items():
                        for item in grams(word, size) if size else (word,):
                            own[item] += n
                    held += len(own)
            if held > 150_000:
                yield from flush()
                held = 0
        yield from flush()

    counted = bounded(rows.select("lang", "text")).mapInArrow(count, "lang string, size int, item string, n long").groupBy("lang", "size", "item").agg(F.sum("n").alias("n"))
    kept = counted.filter(F.col("n") >= least).toArrow()  # bounded by the sample of documents
    languages = sorted(set(kept["lang"].to_pylist()))
    column = {x: i for i, x in enumerate(languages)}
    tables = []
    for size in (0, *range(LONGEST_GRAM, 0, -1)):
        part = kept.filter(pc.equal(kept["size"], size))
        place: dict[str, int] = {}
        cells = [(place.setdefault(item, len(place)), column[lang], n) for lang, item, n in zip(part["lang"].to_pylist(), part["item"].to_pylist(), part["n"].to_pylist(), strict=True)]
        grid = np.full((len(place), len(languages)), 0.5)
        for row, col, n in cells:
            grid[row, col] += n
        tables.append((list(place), np.log(grid / grid.sum(axis=0)) if cells else grid))
    return Model(languages, tables)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from ``docs`` itself, then (doc_id, held_out, lang_pred, score) of every row."""
    return predict(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose language can't be told: ``und``, or a score under ``least``."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in found], pa.bool_()))

    return bounded(docs).mapInArrow(run, docs.schema)
