"""Quality by nearest-neighbour voting over latent-semantic vectors.

A bounded sample of labelled documents gives a term weighting and, by a truncated singular value
decomposition, a latent space; the sample's vectors and labels are broadcast. Every document of the
table is projected and compared with all of them in exact blocked cosine products; its score is the
mean label of the nearest ones, weighted by similarity. Terms are words and surface marks of the
whole text (what stands around the letters, case, repetition), hashed to a fixed number of slots.

Defined cases: a null text counts as empty and is scored like any other; where no label can be
learnt from, the score is 0.5; a null label isn't learnt from; repeated rows keep a row each.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.common import bounded, held_out

#: Labelled documents in the vote (in expectation: they are chosen by hash), slots, dimensions, voters.
LABELLED, SLOTS, DIMENSIONS, NEIGHBOURS, SHARPNESS = 3_000, 8_192, 64, 15, 8
THRESHOLD = 0.7
_MARKS = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights before idf) of a text's terms."""
    counts = Counter((text or "").split())
    total, found = counts.total(), Counter()
    marks: Counter = Counter()
    upper = 0
    for word, n in counts.items():
        found[word.lower()] += n
        shape = _MARKS.sub("a", word)
        marks["shape " + (shape if len(shape) < 8 else shape[:8])] += n
        upper += n * (len(word) > 1 and word.isupper())
    bags = {zlib.crc32(w.encode()) % SLOTS: 0.0 for w in found}
    for w, n in found.items():
        bags[zlib.crc32(w.encode()) % SLOTS] += 1 + math.log(n)
    length = math.sqrt(sum(v * v for v in bags.values())) or 1.0
    out = {k: v / length for k, v in bags.items()}
    # surface marks weigh as much as all words together, by their share of the text
    share = {m: n / total for m, n in marks.items()}
    share[f"upper {round(10 * upper / max(total, 1))}"] = 1.0
    share[f"distinct {round(10 * (len(counts) / max(total, 1)) ** 0.5)}"] = 1.0
    share[f"most {round(10 * max(counts.values(), default=0) / max(total, 1))}"] = 1.0
    share[f"size {min(12, total.bit_length())}"] = 0.5
    for m, v in share.items():
        slot = zlib.crc32(m.encode()) % SLOTS
        out[slot] = out.get(slot, 0.0) + v
    return np.fromiter(out, np.int64, len(out)), np.fromiter(out.values(), np.float32, len(out))


class Voters:
    """Term weights, latent basis, and the labelled vectors that vote."""

    def __init__(self, texts: list[str | None], labels: list[int], seed: int = 11):
        self.labels = np.array(labels, np.float32)
        grid = np.zeros((len(texts), SLOTS), np.float32)
        for i, text in enumerate(texts):
            slots, weights = terms(text)
            grid[i, slots] = weights
        seen = (grid > 0).sum(axis=0)
        self.idf = np.log((1 + len(texts)) / (1 + seen)).astype(np.float32) + 0.1
        grid *= self.idf
        grid /= np.maximum(np.linalg.norm(grid, axis=1, keepdims=True), 1e-9)
        # truncated SVD by subspace iteration
        rng = np.random.default_rng(seed)
        basis = rng.standard_normal((SLOTS, min(DIMENSIONS + 8, max(1, len(texts))))).astype(np.float32)
        for _ in range(4):
            basis, _ = np.linalg.qr(grid.T @ (grid @ basis))
        _, _, turn = np.linalg.svd(grid @ basis, full_matrices=False)
        self.basis = (basis @ turn.T[:, :DIMENSIONS]).astype(np.float32)
        self.vectors = self._unit(grid @ self.basis) if len(texts) else np.zeros((0, self.basis.shape[1]), np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def project(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.basis.shape[1]), np.float32)
        for i, text in enumerate(texts):
            slots, weights = terms(text)
            out[i] = (weights * self.idf[slots]) @ self.basis[slots]
        return self._unit(out)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        cosine = self.project(texts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6).astype(np.float64) ** SHARPNESS
        return np.clip((weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1), 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Voters:
    """Voters from about ``limit`` labelled documents that aren't held out, chosen by a hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    if n > limit:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("voter")), F.lit(1_000_000)) < int(1_000_000 * limit / n))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality")).orderBy("doc_id").collect()
    return Voters([r["text"] for r in rows], [r["quality"] for r in rows])


def score(docs: DataFrame, voters: Voters, block: int = 512) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sent.value.score(part.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, learnt from ``labels``."""
    found = score(docs, train(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
