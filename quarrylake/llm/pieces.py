"""Exact encoding and decoding with a merge-type piece model, by backtracking.

The piece file is read for its vocabulary only. A text's spaces become the space mark, one more
mark goes in front, and the result is cut into units before each run of marks (no piece goes on
past the start of such a run; a vocabulary in which one does isn't cut). A unit is encoded from the
left: an Aho-Corasick automaton gives the pieces that start at each place, the longest is tried
first; a piece may follow another only if merging the two anew leaves them as they are; a place
from which nothing fits is marked in a bitfield and never tried again. Characters that no piece
has become bytes.

Defined cases: a null text counts as empty; an empty text is the begin and end ids alone; repeated
and null doc_ids keep a row each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.common import bounded

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Units and neighbouring pieces that a Python worker remembers, and the longest unit worth it.
CACHE_ENTRIES, CACHE_LENGTH = 400_000, 40
_loaded: dict[str, Codec] = {}


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """Encoder and decoder for one piece file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.surface: list[bytes] = []
        self.bytes_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.silent = set()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if i in self.bytes_of:
                self.surface.append(bytes([self.bytes_of[i]]))
            elif model.is_control(i):
                self.surface.append(b"")
                self.silent.add(i)
            elif model.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                self.surface.append(piece.replace(MARK, " ").encode())
                self.rank[piece], self.ids[piece] = -model.get_score(i), i
        self.letters = {c for p in self.ids for c in p}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        inner = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        line = "" if "\n" in self.letters else "\n"
        self.unit = re.compile(r"(?s).+" if inner else f"{MARK}+[^{MARK}{line}]*|[^{MARK}{line}]+" + (f"|{line}+" if line else ""))
        self.known: dict[str, bytes] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """Plain merging: always the pair whose joint piece ranks first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            rank, i = min((self.rank.get(parts[i] + parts[i + 1], np.inf), i) for i in range(len(parts) - 1))
            if rank == np.inf:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the two anew leaves just them."""
        got = self.fits.get((left, right))
        if got is None:
            if len(self.fits) > CACHE_ENTRIES:
                self.fits.clear()
            got = self.fits[left, right] = self.merge(left + right) == [left, right]
        return got

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text all of whose characters are known."""
        starts: list[list[int]] = [[] for _ in text]
        for last, size in self.automaton.iter(text):
            starts[last - size + 1].append(size)
        for sizes in starts:
            sizes.sort(reverse=True)
        failed = 0  # bit i: nothing that ends at i can go on
        taken: list[tuple[int, int]] = []  # (place, which of the sizes there)
        at, choice = 0, 0
        while at < len(text):
            left = None
            if taken:
                p, k = taken[-1]
                left = text[p : p + starts[p][k]]
            sizes = starts[at]
            while choice < len(sizes):
                end = at + sizes[choice]
                if not failed >> end & 1 and (left is None or self.compatible(left, text[at:end])):
                    break
                choice += 1
            if choice < len(sizes):
                taken.append((at, choice))
                at, choice = at + sizes[choice], 0
            elif taken:
                failed |= 1 << at
                at, choice = taken.pop()
                choice += 1
            else:
                raise ValueError(f"no merge order gives {text[:40]!r}")
        return [text[p : p + starts[p][k]] for p, k in taken]

    def unit_ids(self, unit: str) -> bytes:
        out: list[int] = []
        at = 0
        while at < len(unit):
            to = at
            while to < len(unit) and unit[to] in self.letters:
                to += 1
            if to > at:
                out += [self.ids[p] for p in self.backtrack(unit[at:to])]
            at = to
            while at < len(unit) and unit[at] not in self.letters:
                out += [self.byte_ids[b] for b in unit[at].encode()]
                at += 1
        got = np.array(out, "<u4").tobytes()
        if len(unit) <= CACHE_LENGTH:
            if len(self.known) > CACHE_ENTRIES:
                self.known.clear()
            self.known[unit] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        body = b""
        if text:
            known = self.known.get
            body = b"".join([known(u) or self.unit_ids(u) for u in self.unit.findall(MARK + text.replace(" ", MARK))])
        return np.array([self.begin], "<u4").tobytes() + body + np.array([self.end], "<u4").tobytes()

    def decode(self, raw: bytes) -> str:
        """Text of ids: marks become spaces, the first one goes, runs of byte pieces become characters."""
        ids = np.frombuffer(raw, "<u4").tolist()
        surface = self.surface
        first = next((i for i in ids if i not in self.silent), None)
        text = b"".join([surface[i] for i in ids])
        if first is not None and first not in self.bytes_of and text[:1] == b" ":
            text = text[1:]
        try:
            return text.decode()
        except UnicodeDecodeError:  # each byte that starts no character gives one replacement mark
            out, at = [], 0
            while at < len(text):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(text[at : at + size].decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            return "".join(out)


def codec(path: str | None = None) -> Codec:
    path = path or model_path()
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian unsigned 32-bit integers in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [c.encode(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([c.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, ids binary, decoded string")
