"""Best-fit packing of tokenised documents into fixed-length sequences by linear grouping.

Token ids come from a public byte-level BPE file. Lengths are at most ``capacity``, so their
histogram is all the planner needs: it has at most ``capacity`` entries however many documents
there are. The plan is made on that histogram (round large lengths up within groups of equal
cardinality, solve the few-size configuration problem by column generation, put actual lengths in
place of the rounded ones, then best-fit what is left) and is applied to the pieces as a broadcast
range lookup on (length, rank among equal lengths).

Defined cases: a null text counts as empty (one piece that holds only the closing id); null and
repeated doc_ids keep one set of pieces per row; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.llm.common import bounded, materialize

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
#: Groups of the linear grouping scheme, and the shares of the capacity from which a length is large
#: that are tried; the plan with the fewest sequences is taken.
GROUPS, LARGE = 48, (1 / 2, 1 / 3, 1 / 4)
_SPECIAL = "<|endoftext|>"
_loaded: dict[str, _Encoder] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Encoder:
    """Text -> its ids as little-endian unsigned 32-bit bytes, as the tokenizer file gives them.

    The file's vocabulary is read as byte ranks, which a faster encoder of the same scheme takes; a
    text that spells out a special token goes to the tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        vocab = json.loads(self.whole.to_str())["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t != _SPECIAL}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids if _SPECIAL in text else self.fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


def _encoder(path: str) -> _Encoder:
    if path not in _loaded:
        _loaded[path] = _Encoder(path)
    return _loaded[path]


def tokenize_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of each document: doc_id, piece, start, length, ids_crc32.

    A document is its ids followed by ``end_id``. Only documents longer than ``capacity`` are cut;
    every piece but the first then has exactly ``capacity`` ids.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(tokenizer or tokenizer_path())
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(coder.encode(text.as_py() or "") + end)
                n, at, piece = len(ids) // 4, 0, 0
                size = n if n <= capacity else (n % capacity or capacity)
                while at < n:
                    for col, x in zip(out, (doc_id, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])), strict=True):
                        col.append(x)
                    at, piece, size = at + size, piece + 1, capacity
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, schema)


# ---------------------------------------------------------------------------------------------
# The plan, on the histogram of lengths.


def group_lengths(hist: dict[int, int], groups: int) -> list[tuple[int, int]]:
    """Linear grouping: (rounded length, number of documents), largest first.

    Documents in order of falling length are dealt to groups of equal cardinality; each group
    takes the length of its largest member.
    """
    total = sum(hist.values())
    each, out, size, room = -(-total // groups) if total else 1, [], 0, 0
    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            if not room:
                size, room = length, each
                out.append([size, 0])
            take = min(left, room)
            out[-1][1] += take
            room -= take
            left -= take
    merged: dict[int, int] = defaultdict(int)
    for size, n in out:
        merged[size] += n
    return sorted(merged.items(), reverse=True)


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[tuple[int, ...], float]]:
    """Fractional optimum of the few-size problem by column generation.

    Columns are configurations (copies of each size that fit one sequence). Each round prices all
    configurations at once with an integer knapsack over the capacity, then pivots the best one in.
    """
    m = len(sizes)
    basis = [tuple(capacity // s if i == j else 0 for j in range(m)) for i, s in enumerate(sizes)]
    inverse = np.diag([1.0 / b[i] for i, b in enumerate(basis)])
    amount = inverse @ np.array(demand, float)
    for step in range(rounds):
        price = inverse.sum(axis=0)
        best, last = _knapsack(sizes, price, capacity)
        if best[capacity] <= 1 + 1e-6:
            break
        column, c = [0] * m, capacity
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                column[last[c]] += 1
                c -= sizes[last[c]]
        move = inverse @ np.array(column, float)
        ratio = np.where(move > 1e-9, amount / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        amount = amount - ratio[out] * move
        amount[out] = ratio[out]
        pivot = inverse[out] / move[out]
        inverse = inverse - np.outer(move, pivot)
        inverse[out] = pivot
        basis[out] = tuple(column)
        if step % 50 == 49:
            inverse = np.linalg.inv(np.array(basis, float).T)
            amount = np.maximum(inverse @ np.array(demand, float), 0)
    return [(b, float(max(0.0, a))) for b, a in zip(basis, amount, strict=True)]


def _knapsack(sizes: list[int], price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best worth of every room up to the capacity, and the size placed last there (-1: none)."""
    worth = np.flatnonzero(price > 1e-12)
    size, value = np.array(sizes)[worth], price[worth]
    order = np.argsort(size, kind="stable")
    worth, size, value = worth[order], size[order], value[order]
    fits = np.searchsorted(size, np.arange(capacity + 1), side="right")
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            gain = best[c - size[:k]] + value[:k]
            i = gain.argmax()
            if gain[i] > best[c] + 1e-12:
                best[c], last[c] = gain[i], worth[i]
    return best, last


class _Runs:
    """Runs of like sequences: (how many, lengths placed), kept by the room they have left."""

    def __init__(self, capacity: int):
        self.by_room: dict[int, list[list]] = defaultdict(list)
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, bool)

    def add(self, n: int, lengths: tuple[int, ...]) -> None:
        if n:
            room = self.capacity - sum(lengths)
            self.by_room[room].append([n, lengths])
            self.count[room] = True

    def tightest(self, need: int) -> int:
        """Least room that takes ``need``, -1 if none does."""
        hits = np.flatnonzero(self.count[need:])
        return need + int(hits[0]) if len(hits) else -1

    def take(self, room: int, n: int) -> tuple[int, tuple[int, ...]]:
        runs = self.by_room[room]
        got = min(n, runs[-1][0])
        lengths = runs[-1][1]
        runs[-1][0] -= got
        if not runs[-1][0]:
            runs.pop()
            self.count[room] = bool(runs)
        return got, lengths


def plan(hist: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: tuple[float, ...] = LARGE) -> list[tuple[int, tuple[int, ...]]]:
    """Runs (number of sequences, lengths in each) that hold every length of ``hist`` exactly."""
    return min((_plan(hist, capacity, groups, x) for x in large), key=lambda runs: sum(n for n, _ in runs))


def _plan(hist: dict[int, int], capacity: int, groups: int, large: float) -> list[tuple[int, tuple[int, ...]]]:
    left = {k: n for k, n in hist.items() if n > 0}
    runs = _Runs(capacity)
    big = {k: n for k, n in left.items() if k > capacity * large}
    if full := big.pop(capacity, 0):
        runs.add(full, (capacity,))
        left[capacity] = 0
    grouped = group_lengths(big, groups)
    if grouped:
        sizes, demand = [s for s, _ in grouped], [n for _, n in grouped]
        # each group's actual lengths, largest first
        queues: list[list[list[int]]] = []
        pool = [[k, big[k]] for k in sorted(big, reverse=True)]
        for n in demand:
            queue = []
            while n:
                take = min(n, pool[0][1])
                queue.append([pool[0][0], take])
                pool[0][1] -= take
                n -= take
                if not pool[0][1]:
                    pool.pop(0)
            queues.append(queue)
        for column, amount in configurations(sizes, demand, capacity):
            n = int(amount + 1e-6)
            slots = [g for g, copies in enumerate(column) for _ in range(copies)]
            while n > 0 and slots:
                need = defaultdict(int)
                for g in slots:
                    need[g] += 1
                if any(sum(x for _, x in queues[g]) < k for g, k in need.items()):
                    break
                # a stretch of sequences in which every slot keeps one actual length
                step, lengths = n, []
                for g, copies in need.items():
                    if queues[g][0][1] >= copies:
                        step = min(step, queues[g][0][1] // copies)
                        lengths += [queues[g][0][0]] * copies
                    else:
                        step = 1
                        want = copies
                        for length, there in queues[g]:
                            lengths += [length] * min(want, there)
                            want -= min(want, there)
                            if not want:
                                break
                for length in lengths:
                    left[length] -= step
                for g, copies in need.items():
                    rest = copies * step
                    while rest:
                        take = min(rest, queues[g][0][1])
                        queues[g][0][1] -= take
                        rest -= take
                        if not queues[g][0][1]:
                            queues[g].pop(0)
                runs.add(step, tuple(lengths))
                n -= step
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            room = runs.tightest(length)
            if room < 0:
                copies = capacity // length
                runs.add(n // copies, (length,) * copies)
                if n % copies:
                    runs.add(1, (length,) * (n % copies))
                break
            got, lengths = runs.take(room, n)
            copies = min(room // length, n // got)
            runs.add(got, lengths + (length,) * copies)
            n -= got * copies
    return [(n, lengths) for room in sorted(runs.by_room) for n, lengths in runs.by_room[room]]


def placements(runs: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, offset) of every slot of every run."""
    seen: dict[int, int] = defaultdict(int)
    out, base = [], 0
    for n, lengths in runs:
        offset = 0
        for length in lengths:
            out.append((length, seen[length], seen[length] + n, base, offset))
            seen[length] += n
            offset += length
        base += n
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (a stored frame with a ``length`` of 1..capacity).

    Ranks among equal lengths are counted per cell of a length, so that a length that a third of
    all pieces share is spread; cells number at most about 20,000 + capacity at every input size,
    which bounds the broadcast of their first ranks. The placement table is bounded by the number
    of runs, which depends on ``capacity`` alone.
    """
    spark = pieces.sparkSession
    hist = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(hist.values())
    slots = placements(plan(hist, capacity))
    cell = max(200, total // 20_000)
    cells = {k: -(-n // cell) for k, n in hist.items()}
    spread = spark.createDataFrame([(k, n) for k, n in cells.items()], "length long, cells int")
    # which cell: by what the piece is, so a retried task deals the same way
    keyed = pieces.join(F.broadcast(spread), "length").withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("cells")).cast("int")).drop("cells")
    counts = keyed.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select("length", "cell", F.coalesce(before, F.lit(0)).alias("first"))
    order = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(order) - 1).join(F.broadcast(firsts), ["length", "cell"]).withColumn("rank", F.col("rank") + F.col("first"))
    by_length: dict[int, list[tuple]] = defaultdict(list)
    for length, lo, hi, base, offset in slots:
        by_length[length].append((lo, hi, base, offset))
    # one row per length: arrays in order of rank; a rank's slot is the last that begins by it
    rows = [(k, [x[0] for x in v], [x[2] - x[0] for x in v], [x[3] for x in v]) for k, v in by_length.items()]
    lookup = spark.createDataFrame(rows, "length long, los array<long>, shifts array<long>, offsets array<long>")
    placed = ranked.join(F.broadcast(lookup), "length")
    found = F.size(F.filter("los", lambda lo: lo <= F.col("rank")))
    return placed.withColumn("slot", found).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("rank") + F.element_at("shifts", F.col("slot"))).alias("sequence_id"),
        F.element_at("offsets", F.col("slot")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) and place every piece; see the module's text."""
    return pack(materialize(tokenize_pieces(docs, tokenizer, capacity), "pieces"), capacity)
