"""Chunkers: markdown documents to rows of chunks, by section, by section with a size cap, by overlap, by fixed windows.

A chunker reads one document's lines in order, which column expressions can't keep readable, so it
runs in Arrow batches, a document at a time; Spark deals the documents and nothing is gathered. A
null text counts as empty and gives no chunks; texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADING = re.compile(r"(#{1,6})\s+(.*)")
_NUMBER = re.compile(r"\d+(?:\.\d+)*\s+")
#: Headers whose sections hold only what is known of a course anyway, and the forms of its title.
METADATA_HEADERS = ("course information", "instructor details", "instructor information", "course details", "course prerequisites", "preferred contact method", "meeting times:", "socials")
TITLES = (r"[A-Z]{3,4}\s+\d{3}\s+(?:Syllabus|Course\s+Syllabus)$", r"Course\s+Syllabus:\s+[A-Z]{3,4}\s+\d{3}\b")


def tokens(text: str) -> int:
    """A quarter of the length, halves to even."""
    return round(len(text) / 4)


def has_table(text: str) -> bool:
    return re.search(r"\|.*\|", text) is not None


def is_metadata(header: str) -> bool:
    """Whether a section's header, numbered or not, is one of ``METADATA_HEADERS`` or a title."""
    header = header.strip()
    plain = _NUMBER.sub("", header, count=1) if _NUMBER.match(header) else header
    return plain.lower() in METADATA_HEADERS or any(re.match(t, x, re.IGNORECASE) for t in TITLES for x in (header, plain))


@dataclass
class Chunk:
    content: str
    path: str
    reason: str
    flags: list[str] = field(default_factory=list)

    @property
    def size(self) -> int:
        return tokens(self.content)


@dataclass
class Section:
    """A heading and what stands under it before the next; ``end`` is the first section that isn't inside it."""

    level: int
    header: str
    body: str = ""
    path: tuple[str, ...] = ()
    end: int = 0

    @property
    def own(self) -> str:
        return "\n\n".join(filter(None, (f"{'#' * self.level} {self.header}" if self.header else "", self.body)))


def sections(markdown: str) -> list[Section]:
    """Sections in order; the first has level 0 and holds what stands before any heading."""
    found, body = [Section(0, "")], []
    for line in markdown.splitlines():
        if mark := _HEADING.match(line):
            found[-1].body = "\n".join(body).strip()
            body = []
            found.append(Section(len(mark[1]), mark[2].strip()))
        else:
            body.append(line)
    found[-1].body = "\n".join(body).strip()
    inside: list[int] = []
    for i, s in enumerate(found):
        while inside and found[inside[-1]].level >= s.level:
            found[inside.pop()].end = i
        s.path = (*(found[j].header for j in inside if j), s.header) if i else ()
        inside.append(i)
    for i in inside:
        found[i].end = len(found)
    return found


def _text(found: list[Section], i: int) -> str:
    return "\n\n".join(filter(None, (s.own for s in found[i : found[i].end])))


def _children(found: list[Section], i: int) -> Iterator[int]:
    j = i + 1
    while j < found[i].end:
        yield j
        j = found[j].end


def _path(section: Section) -> str:
    return " > ".join(filter(None, section.path))


def paragraphs(text: str) -> list[str]:
    """Parts between blank lines; where that gives one, lines."""
    parts = [p.strip() for p in re.split(r"\n\n+", text) if p.strip()]
    return parts if len(parts) > 1 else [line.strip() for line in text.splitlines() if line.strip()]


def at_spaces(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` characters, cut at the last space that fits, else hard."""
    out, rest = [], text
    while len(rest) > most:
        at = rest.rfind(" ", 0, most)
        at = at if at > 0 else most
        out.append(rest[:at].strip())
        rest = rest[at:].strip()
    return out + ([rest.strip()] if rest.strip() else [])


def packed(parts: list[str], most: int) -> list[str]:
    """Parts joined line by line while their lengths sum up to ``most`` at most."""
    out: list[list[str]] = []
    size = most + 1
    for part in parts:
        if not out or size + len(part) > most:
            out.append([])
            size = 0
        out[-1].append(part)
        size += len(part)
    return ["\n".join(x) for x in out]


def split_long(text: str, most_tokens: int) -> list[str]:
    """A text in pieces: by lines, else by sentences, else at spaces."""
    most = 4 * most_tokens
    lines = [line for line in text.split("\n") if line.strip()]
    if len(lines) > 1:
        return [piece for block in packed(lines, most) for piece in (at_spaces(block, most) if len(block) > most else [block])]
    sentences = re.split(r"(?<=\. )(?=[A-Z])", text)
    return packed(sentences, most) if len(sentences) > 1 else at_spaces(text, most)


def capped(markdown: str, most: int = 600, least: int = 50) -> list[Chunk]:
    """One chunk a section that fits ``most`` tokens; larger ones by their sub-sections, else by paragraphs.

    A chunk under ``least`` joins the one before where both have one path, and the next one joins a
    chunk that is still under it, as long as ``most`` isn't passed.
    """
    out: list[Chunk] = []

    def put(text: str, path: str, reason: str) -> None:
        if text.strip():
            out.append(Chunk(text.strip(), path, reason))

    def by_paragraphs(text: str, path: str) -> None:
        held: list[str] = []
        size = 0
        for part in [*paragraphs(text), None]:
            n = tokens(part) if part is not None else 0
            if held and (part is None or n > most or size + n > most):
                put("\n\n".join(held), path, "paragraph-fallback")
                held, size = [], 0
            if part is not None and n > most:
                for piece in split_long(part, most):
                    put(piece, path, "long-paragraph-split")
            elif part is not None:
                held.append(part)
                size += n

    found = sections(markdown)
    if len(found) == 1 or tokens(found[0].body) > most:
        by_paragraphs(found[0].body, "")
    else:
        put(found[0].body, "", "section")
    todo = list(_children(found, 0))[::-1]
    while todo:
        i = todo.pop()
        path, text, inner = _path(found[i]), _text(found, i), list(_children(found, i))
        if tokens(text) <= most:
            put(text, path, "section")
        elif not inner:
            by_paragraphs(text, path)
        else:
            if found[i].body and tokens(found[i].own) > most:
                by_paragraphs(found[i].own, path)
            elif found[i].body:
                put(found[i].own, path, "sub-header")
            todo += inner[::-1]
    merged: list[Chunk] = []
    for chunk in out:
        last = merged[-1] if merged else None
        if last and last.size + chunk.size <= most and (last.size < least or chunk.size < least and last.path == chunk.path):
            merged[-1] = Chunk(f"{last.content}\n\n{chunk.content}", last.path, "merged")
        else:
            merged.append(chunk)
    return merged


def semantic(markdown: str, over: int = 500, least: int = 15, drop_metadata: bool = True) -> list[Chunk]:
    """One chunk a section; only sections over ``over`` tokens are opened, or split where nothing is inside.

    A section under ``least`` joins the chunk before it if that has the same path; where there is none
    before it at all, it waits for the next. Headers without a body anywhere below go, and sections
    that only hold metadata, if asked. Flags: OVERSIZED, HAS_TABLE, NO_HEADER.
    """
    out: list[Chunk] = []
    waiting: list[str] = []

    def flags(text: str, headed: bool) -> list[str]:
        return [f for f, on in (("OVERSIZED", tokens(text) > over), ("HAS_TABLE", has_table(text)), ("NO_HEADER", not headed)) if on]

    def glue(text: str) -> None:
        last = out[-1]
        last.content += "\n\n" + text
        last.flags = flags(last.content, bool(last.path))

    def put(text: str, section: Section) -> None:
        path = _path(section)
        if tokens(text) < least:
            if not out:
                waiting.append(text)
                return
            if out[-1].path == path:
                glue(text)
                return
        elif waiting:
            text = "\n\n".join([*waiting, text])
            waiting.clear()
        out.append(Chunk(text, path, "semantic", flags(text, bool(section.header))))

    found = sections(markdown)
    if tokens(found[0].body) >= max(least, 1):
        out.append(Chunk(found[0].body, "", "semantic", flags(found[0].body, False)))
    todo = list(_children(found, 0))[::-1]
    while todo:
        i = todo.pop()
        s, inner, text = found[i], list(_children(found, i)), _text(found, i)
        if drop_metadata and s.header and is_metadata(s.header):
            todo += inner[::-1]
        elif s.header and not any(x.body for x in found[i : s.end]):
            continue
        elif tokens(text) > over and tokens(text) >= least and inner:
            if tokens(s.own) > 0:
                put(s.own, s)
            todo += inner[::-1]
        elif tokens(text) > over and tokens(text) >= least:
            for piece in split_long(text, over):
                put(piece.strip(), s)
        else:
            put(text, s)
    if waiting and out:
        glue("\n\n".join(waiting))
    elif waiting:
        text = "\n\n".join(waiting)
        out.append(Chunk(text, "", "semantic", flags(text, False)))
    return out


def overlapped(text: str, size: int = 600, overlap: int = 100) -> list[Chunk]:
    """Paragraphs in groups of like size, each led by the last paragraphs of the group before, about ``overlap`` tokens."""
    parts = paragraphs("\n".join(m[2] if (m := _HEADING.match(line)) else line for line in text.splitlines()))
    total = sum(map(tokens, parts))
    if not total:
        return []
    n = math.ceil(total / size)
    groups: list[list[str]] = [[]]
    held = 0
    for part in parts:
        groups[-1].append(part)
        held += tokens(part)
        if len(groups) < n and held >= total / n:
            groups.append([])
            held = 0
    out = []
    for before, group in zip([[], *groups], groups, strict=False):
        if group:
            tail: list[str] = []
            for part in reversed(before):
                if tail and sum(map(tokens, tail)) + tokens(part) > overlap:
                    break
                tail.insert(0, part)
            out.append(Chunk("\n\n".join([*tail, *group]), "", "overlap"))
    return out


def fixed(text: str, size: int = 400, overlap: int = 50, most: int = 600) -> list[Chunk]:
    """Windows of ``size`` tokens, stretched to the next paragraph, line or space within ``most``; the next begins ``overlap`` before."""
    text = text.strip()
    out, at = [], 0
    while at < len(text):
        to = at + 4 * size
        if to >= len(text):
            out.append(text[at:].strip())
            break
        stop = min(at + 4 * most, len(text))
        to = next((p + len(sep) for sep in ("\n\n", "\n", " ") if (p := text.find(sep, to, stop)) >= 0), stop)
        out.append(text[at:to].strip())
        at = max(to - 4 * overlap, at + 1)
    return [Chunk(x, "", "fixed") for x in out if x]


CHUNKS = "idx int, content string, header_path string, token_count int, has_table boolean, flags array<string>, reason string"


def chunk(docs: DataFrame, how: Callable[..., list[Chunk]], text: str = "text", id_: str = "doc_id", **settings) -> DataFrame:
    """(id, idx, content, header_path, token_count, has_table, flags, reason) of every chunk that ``how`` cuts ``text`` into."""
    kind = dict(docs.dtypes)[id_]
    types = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                cut = [how(x.as_py() or "", **settings) for x in part.column(1)]
                rows = [(i, c.content, c.path, c.size, has_table(c.content), c.flags, c.reason) for doc in cut for i, c in enumerate(doc)]
                ids = part.column(0).take(pa.array([k for k, doc in enumerate(cut) for _ in doc], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[j] for r in rows], t) for j, t in enumerate(types))], [id_, *(c.split()[0] for c in CHUNKS.split(", "))])

    return docs.select(F.col(id_), F.col(text)).mapInArrow(run, f"{id_} {kind}, {CHUNKS}")
