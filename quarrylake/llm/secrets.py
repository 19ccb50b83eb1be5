"""Secret scans: three base patterns, and a character convolutional network over other candidates.

The network reads a candidate and what surrounds it, character by character. It is trained here, in
numpy, on labelled findings: what the base patterns find in a bounded sample of documents against
look-alikes from the same documents, with generated secrets and look-alikes of known forms beside
them. Its outputs are calibrated on findings kept from training, and the threshold is the highest
that still recalls ``RECALL`` of those secrets there that are candidates. Every candidate of every whole
text is judged, over its whole length in overlapping pieces: the surest piece counts. Base findings
always stay.

Defined cases: a null text counts as empty and has no spans; repeated and null doc_ids keep a row
each; places are code points, ends exclusive; an empty table trains on generated findings alone.
"""

from __future__ import annotations

import heapq
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.common import bounded

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Further candidates: long runs of key characters, also such that other marks join, with a digit and a letter among them,
_RUN = re.compile(r"[A-Za-z0-9+/_=-]+(?:[.~!@#$%^&*?]+[A-Za-z0-9+/_=-]+)*")
#: and values next to a credential word, of any characters, shorter and without digits too.
_WORD = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credential|auth(?:orization)?|bearer|login|pin|key)s?"
_VALUES = (
    re.compile(_WORD + r"""["']?\x20*[:=]+>?\x20*["']?([^\s"'<>]{4,})""", re.ASCII | re.IGNORECASE),
    re.compile(r"(?<![A-Za-z])" + _WORD + r"""\x20+(?:(?:is|was)\x20+)?["']?([^\s"'<>:=]{6,})""", re.ASCII | re.IGNORECASE),
)
LEAST_RUN, STEP = 16, 16
#: Documents sampled for labelled findings, findings of each class used, window, filters, aims.
SAMPLE, FINDINGS, BEFORE, INSIDE, AFTER, WIDTH, FILTERS, EPOCHS, RECALL = 4_000, 1_500, 24, 48, 16, 5, 24, 8, 0.97
#: Of a sampled document: base findings and long words learnt from, and the length up to which they are.
SPANS_EACH, WORDS_EACH, LONGEST = 4, 2, 1_000
_LENGTH = BEFORE + INSIDE + AFTER
_PLAIN = "0 \n" + string.punctuation
_CODE = np.full(128, 27 + len(_PLAIN), np.int64)
for _i, _c in enumerate(string.ascii_lowercase):
    _CODE[ord(_c)] = _CODE[ord(_c.upper())] = 1 + _i
for _c in string.digits:
    _CODE[ord(_c)] = 27
for _i, _c in enumerate(_PLAIN[1:]):
    _CODE[ord(_c)] = 28 + _i
CHANNELS = 27 + len(_PLAIN) + 1 + 2  # the characters, then upper case, then inside the candidate

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base patterns, by start, then kind as listed."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Runs and values next to credential words, what base findings leave of them, by start; those that overlap are one."""
    found = [(m.start(), m.end()) for m in _RUN.finditer(text) if m.end() - m.start() >= LEAST_RUN and _mixed(m[0])]
    found += [(m.start(1), m.start(1) + len(m[1].rstrip(".,;:)]}"))) for p in _VALUES for m in p.finditer(text)]
    whole: list[list[int]] = []
    for a, b in sorted(found):
        if whole and a < whole[-1][1]:
            whole[-1][1] = max(b, whole[-1][1])
        elif b > a:
            whole.append([a, b])
    out = []
    for a, b in whole:
        inner = sorted((x, y) for x, y, _ in taken if x < b and a < y)
        if not inner:
            out.append((a, b))
        for x, y in [*inner, (b, b)] if inner else []:
            if x - a >= LEAST_RUN and _mixed(text[a:x]):
                out.append((a, x))
            a = max(a, y)
    return out


def _mixed(run: str) -> bool:
    return any(c.isdigit() for c in run) and any(c.isalpha() for c in run)


def pieces(item: tuple[str, int, int]) -> list[tuple[str, int, int]]:
    """Overlapping pieces of at most ``INSIDE`` characters that cover the whole item."""
    text, start, end = item
    if end - start <= INSIDE:
        return [item]
    return [(text, a, a + INSIDE) for a in [*range(start, end - INSIDE, STEP), end - INSIDE]]


def windows(items: list[tuple[str, int, int]]) -> np.ndarray:
    """(piece, place, channel) zeros and ones for the network."""
    out = np.zeros((len(items), _LENGTH + WIDTH - 1, CHANNELS), np.float32)
    pad = WIDTH // 2
    for row, (text, start, end) in zip(out, items, strict=True):
        stop = min(end, start + INSIDE)
        for piece, at in ((text[max(0, start - BEFORE) : start], BEFORE - min(BEFORE, start)), (text[start:stop], BEFORE), (text[end : end + AFTER], BEFORE + INSIDE)):
            if piece:
                points = np.frombuffer(piece.encode("utf-32-le"), "<u4")
                codes = np.where(points < 128, _CODE[np.minimum(points, 127)], CHANNELS - 3)
                places = pad + at + np.arange(len(codes))
                row[places, codes] = 1
                row[places, CHANNELS - 2] = (points >= 65) & (points <= 90)
        row[pad + BEFORE : pad + BEFORE + stop - start, CHANNELS - 1] = 1
    return out


class Network:
    """One convolution, greatest response inside and outside the candidate, a logistic output."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.kernel = (rng.standard_normal((WIDTH * CHANNELS, FILTERS)) * 0.1).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.out = (rng.standard_normal(2 * FILTERS) * 0.1).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.scale, self.offset, self.threshold = 1.0, 0.0, 0.5

    @staticmethod
    def _columns(x: np.ndarray) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)  # item, place, channel, tap
        return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(len(x), _LENGTH, WIDTH * CHANNELS)

    def _pool(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        cols = self._columns(x)
        act = np.maximum(cols @ self.kernel + self.shift, 0)
        inside = x[:, WIDTH // 2 : WIDTH // 2 + _LENGTH, CHANNELS - 1:] > 0
        a, b = np.where(inside, act, -1), np.where(inside, -1, act)
        at = np.concatenate([a.argmax(1), b.argmax(1)], axis=1)
        top = np.maximum(np.concatenate([a.max(1), b.max(1)], axis=1), 0)
        return cols, at, top

    def piece_logits(self, parts: list[tuple[str, int, int]]) -> np.ndarray:
        out = [np.zeros(0, np.float32)]
        for i in range(0, len(parts), 256):
            out.append(self._pool(windows(parts[i : i + 256]))[2] @ self.out + self.bias)
        return np.concatenate(out)

    def logits(self, items: list[tuple[str, int, int]]) -> np.ndarray:
        """Of each item, that of its surest piece."""
        cut = [pieces(i) for i in items]
        if not cut:
            return np.zeros(0, np.float32)
        return np.maximum.reduceat(self.piece_logits([p for c in cut for p in c]), np.cumsum([0, *map(len, cut[:-1])]))

    def probability(self, items: list[tuple[str, int, int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(items) + self.offset, -30, 30)))

    def fit(self, items: list[tuple[str, int, int]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 6) -> None:
        """Every piece of a look-alike is one; of a secret in several pieces, the surest so far is the secret."""
        rng = np.random.default_rng(seed)
        cut = [pieces(i) for i in items]
        long = [k for k, c in enumerate(cut) if labels[k] > 0 and len(c) > 1]
        fixed = [(p, labels[k]) for k, c in enumerate(cut) if labels[k] == 0 or len(c) == 1 for p in c]
        params = [self.kernel, self.shift, self.out, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for epoch in range(epochs):
            sure = [self.piece_logits(cut[k]) for k in long] if epoch else []
            rows = fixed + [(cut[k][int(x.argmax())], 1.0) for k, x in zip(long, sure, strict=False)]
            order = rng.permutation(len(rows))
            for i in range(0, len(order), 128):
                pick = order[i : i + 128]
                cols, at, top = self._pool(windows([rows[j][0] for j in pick]))
                p = 1 / (1 + np.exp(-np.clip(top @ self.out + self.bias, -30, 30)))
                err = (p - np.array([rows[j][1] for j in pick])).astype(np.float32) / len(pick)
                back = err[:, None] * self.out * (top > 0)
                g_kernel = np.zeros_like(self.kernel)
                for f in range(FILTERS):
                    for half in (0, FILTERS):
                        g_kernel[:, f] += back[:, half + f] @ cols[np.arange(len(pick)), at[:, half + f]]
                grads = [g_kernel + 1e-4 * self.kernel, back[:, :FILTERS].sum(0) + back[:, FILTERS:].sum(0), err @ top, err.sum(keepdims=True)]
                step += 1
                for k, (w, g) in enumerate(zip(params, grads, strict=True)):  # Adam
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    w -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)

    def calibrate(self, items: list[tuple[str, int, int]], labels: np.ndarray, recall: float = RECALL) -> None:
        """Scale and offset by logistic regression on kept findings; then the recall-constrained threshold."""
        x = self.logits(items).astype(np.float64)
        a, b = 1.0, 0.0
        smooth = np.where(labels > 0, 1 - 1 / (len(labels) + 2), 1 / (len(labels) + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            w = p * (1 - p) + 1e-6
            grad = np.array([((p - smooth) * x).sum() + 1e-3 * a, (p - smooth).sum()])
            step = np.linalg.solve(np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]]), grad)
            a, b = a - 0.5 * step[0], b - 0.5 * step[1]
        self.scale, self.offset = a, b
        secrets = [i for i, y in zip(items, labels, strict=True) if y > 0]
        # what the network is asked about: base findings stay anyhow and would make the recall look better than it is
        asked = [c for c in map(as_asked, secrets) if c]
        found = np.sort(self.probability(asked or secrets))[::-1]
        if len(found):
            self.threshold = float(found[min(len(found) - 1, int(np.ceil(recall * len(found))) - 1)])


class _Maker:
    """Draws of made-up secrets and look-alikes, each form by its name."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def draw(self, chars: str, low: int, high: int | None = None) -> str:
        return "".join(self.rng.choice(chars) for _ in range(self.rng.randint(low, high or low)))

    def word(self) -> str:
        return "".join(self.rng.choice(("an", "er", "the", "ion", "ou", "re", "men", "tra", "ver", "sta", "le", "qui", "ba", "si", "con", "lo")) for _ in range(self.rng.randint(1, 4)))

    def path(self) -> str:
        return "/" + "/".join(self.word() for _ in range(self.rng.randint(3, 16))) + "/"

    def name(self) -> str:
        return self.rng.choice(["password", "pass", "pwd", "secret", "token", "credential", "auth", "login", "api_key", "private_key", "key"])

    def to(self) -> str:
        return self.rng.choice(["=", ": ", " = ", ":", '="'])

    def key(self) -> str:
        mark = self.rng.choice(["ghp_", "sk_live_", "AIza", "", self.draw(string.ascii_lowercase, 2, 5) + self.rng.choice("_-")])
        return mark + self.draw(_ALNUM, 24, 40)

    def secret(self, form: str) -> tuple[str, str]:
        """(lead, body) of a secret of a form."""
        r, d = self.rng, self.draw
        alnum, hexa, marks = _ALNUM, "0123456789abcdef", "!@#$%^&*?.~"
        match form:
            case "prefixed":
                return "", d(string.ascii_letters, 2, 6) + r.choice(["_", "-", "_live_", "_test_", "-v1-", ""]) + d(alnum, 20, 44)
            case "repository":
                return "", "ghp_" + d(alnum, 36)
            case "chat":
                return "", "xoxb-" + d(string.digits, 12) + "-" + d(alnum, 24)
            case "payment":
                return "", "sk_live_" + d(alnum, 24)
            case "maps":
                return "", "AIza" + d(alnum + "_-", 35)
            case "bearer":
                return "Bearer ", f"eyJ{d(alnum, 20)}-{d(alnum, 30)}" if r.random() < 0.5 else f"eyJ{d(alnum, 20)}.eyJ{d(alnum, 40)}.{d(alnum + '_-', 43)}"
            case "base64":
                return r.choice(["aws_secret ", "key ", ""]), d(alnum + "+/", 40, 88) + r.choice(["", "=", "=="])
            case "named":
                return self.name() + self.to(), d(alnum, 6, 40)
            case "hexadecimal":
                return r.choice(["key ", "", ""]), d(hexa, 20, 31)
            case "upper_hexadecimal":
                return r.choice(["key ", "", "id "]), d(hexa.upper(), 20, 64)
            case "base32":
                return r.choice(["otp ", ""]), d("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 26, 52)
            case "behind_path":
                return "", self.path() + self.key()
            case "behind_filler":
                return "", r.choice("=-_") * r.randint(30, 90) + self.key()
            case "inside_path":
                return "", self.path() + self.key() + "/" + self.word() + "/" + self.word()
            case "long":
                return "key ", d(alnum + "+/", 60, 160)
            case "letters":
                return self.name() + self.to(), d(r.choice([string.ascii_letters, string.ascii_lowercase]), 8, 30)
            case "split":
                return self.name() + self.to(), d(alnum, 3, 8) + d(marks, 1, 2) + d(alnum, 3, 8)
            case "told":
                return self.name() + r.choice([" ", " is "]), d(alnum + marks, 8, 15) + d(alnum, 1)
        raise ValueError(form)

    def other(self) -> tuple[str, str]:
        """(lead, body) of something that only looks like one."""
        r, d, w = self.rng, self.draw, self.word
        hexa, digits = "0123456789abcdef", string.digits
        return r.choice((
            lambda: ("", f"{d(hexa, 8)}-{d(hexa, 4)}-4{d(hexa, 3)}-a{d(hexa, 3)}-{d(hexa, 12)}"), lambda: ("", f"{w()}-{w()}-{w()}-{w()}-{r.randint(1, 2030)}"), lambda: ("see ", f"/{w()}/{w()}/{w()}/page{r.randint(1, 99)}"),
            lambda: ("on ", f"20{d(digits, 2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}T{r.randint(10, 23)}-{r.randint(10, 59)}Z-{w()}"), lambda: ("", f"{w()}_{w()}_{w()}_{w()}_v{r.randint(1, 20)}"),
            lambda: ("ISBN ", f"978-{d(digits, 1)}-{d(digits, 4)}-{d(digits, 4)}-X"), lambda: ("", w() + w() + w() + w() + w() + str(r.randint(1, 9))), lambda: ("", "=" * r.randint(8, 20) + w() + str(r.randint(1, 9)) + "-" * 12),
            lambda: ("", self.path() + f"page{r.randint(1, 99)}"), lambda: ("", self.path() + w() + str(r.randint(1, 9)) + self.path() + w()), lambda: ("", r.choice("=-_") * r.randint(30, 90) + w() + str(r.randint(1, 99))),
            lambda: ("", "-".join(w() for _ in range(r.randint(8, 20))) + f"-{r.randint(1, 2030)}"), lambda: ("", f"{w()}.{r.randint(1, 99)}@{w()}{r.randint(1, 9)}.{w()}.com"),
            lambda: ("https:", f"//www.{w()}{w()}.com{self.path()}{w()}?id={r.randint(1, 9999)}"), lambda: ("", ".".join(w() for _ in range(r.randint(4, 8))) + f".{r.randint(1, 99)}"),
            lambda: (self.name() + r.choice([" ", " is ", " was "]), w() + w() + w()), lambda: (self.name() + " ", r.choice(["required", "missing", "management", "expired", "rotation", "changed", "reset,then"])),
            lambda: ("", w().title() + w() + "!!" + w() + "..." + w() + str(r.randint(1, 99))), lambda: ("", f"{w().upper()}_{w().upper()}_{w().upper()}_{w().upper()}{r.randint(1, 99)}"), lambda: ("no ", d(digits, 4) + "-" + d(digits, 4) + "-" + w().upper() + d(digits, 8)),
        ))()


_ALNUM = string.ascii_letters + string.digits
FORMS = ("prefixed", "repository", "chat", "payment", "maps", "bearer", "base64", "named", "hexadecimal", "upper_hexadecimal", "base32", "behind_path", "behind_filler", "inside_path", "long", "letters", "split", "told")


def generated(n: int, seed: int = 3, forms: tuple[str, ...] = FORMS) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of made-up secrets of ``forms``, and as many look-alikes."""
    maker = _Maker(seed)
    rng, out = maker.rng, []
    for i in range(n):
        label = i % 2
        lead, body = maker.secret(rng.choice(forms)) if label else maker.other()
        text = " ".join(maker.word() for _ in range(rng.randint(0, 6))) + " " + lead + body
        out.append((text + rng.choice(["", " ", ".", '"']) + " ".join(["", *(maker.word() for _ in range(rng.randint(0, 4)))]), len(text) - len(body), len(text), label))
    return out


def as_asked(item: tuple[str, int, int]) -> tuple[str, int, int] | None:
    """The candidate that a finding lies in, if it lies in one."""
    text, start, end = item
    return next(((text, a, b) for a, b in candidates(text, base_spans(text)) if a <= start and end <= b), None)


def labelled_findings(docs: DataFrame, sample: int = SAMPLE, findings: int = FINDINGS) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) from about ``sample`` documents: base findings, and long words that are none.

    A sampled document gives its first ``SPANS_EACH`` base findings and its ``WORDS_EACH`` longest words; a finding over
    ``LONGEST`` characters is left out. A word that has the shape of a candidate may be a secret that no base pattern
    knows, so it is taken for neither.
    """
    n = docs.count()
    part = docs.select("text").filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text", F.lit("findings")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(n, 1)) + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell in batch.column(0):
                text = cell.as_py()
                spans = base_spans(text)
                seen = [(a, b, 1) for a, b, _ in spans[:SPANS_EACH] if b - a <= LONGEST]
                long_words = heapq.nlargest(WORDS_EACH, ((len(m[0]), m.start(), m.end()) for m in re.finditer(r"\S+", text) if len(m[0]) <= LONGEST))
                unsure = [*spans, *((a, b, "model") for a, b in candidates(text, spans))]
                seen += [(a, b, 0) for _, a, b in long_words if not any(x < b and a < y for x, y, _ in unsure)]
                out += [(text[max(0, a - BEFORE) : b + AFTER], min(a, BEFORE), min(a, BEFORE) + b - a, y) for a, b, y in seen]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32()))], ["text", "start", "stop", "label"])

    seen = bounded(part).mapInArrow(run, "text string, start int, stop int, label int").distinct()
    rows = [r for y in (0, 1) for r in seen.filter(F.col("label") == y).orderBy(F.xxhash64("text", "start"), "text", "start").limit(findings).collect()]
    return [(r["text"], r["start"], r["stop"], r["label"]) for r in rows]


def train(docs: DataFrame, forms: tuple[str, ...] = FORMS) -> Network:
    """A calibrated network from ``docs``'s labelled findings and generated ones of ``forms``."""
    found = labelled_findings(docs) + generated(4 * FINDINGS, forms=forms)
    order = np.random.default_rng(4).permutation(len(found))
    items, labels = [found[i][:3] for i in order], np.array([found[i][3] for i in order], np.float32)
    cut = len(items) * 3 // 4
    net = Network()
    net.fit(items[:cut], labels[:cut])
    net.calibrate(items[cut:], labels[cut:])
    return net


def find(texts: list[str], net: Network) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, kind, score) of each text's findings, in order; base findings have score 1."""
    bases = [base_spans(t) for t in texts]
    asked = [(i, a, b) for i, (t, s) in enumerate(zip(texts, bases, strict=True)) for a, b in candidates(t, s)]
    sure = net.probability([(texts[i], a, b) for i, a, b in asked]) if asked else []
    out = [[(a, b, k, 1.0) for a, b, k in s] for s in bases]
    for (i, a, b), p in zip(asked, sure, strict=True):
        if p >= net.threshold:
            out[i].append((a, b, "model", float(p)))
    return [sorted(s, key=lambda x: (x[0], KINDS.index(x[2]), x[1])) for s in out]


SPANS = "array<struct<kind: string, start: int, stop: int, score: double>>"


def scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """(doc_id, spans) of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(net or train(docs))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = find([t.as_py() or "" for t in part.column(1)], sent.value)
                rows = [[{"kind": k, "start": a, "stop": b, "score": p} for a, b, k, p in s] for s in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding replaced by ``mark``; rows and texts without findings stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))
    at = docs.columns.index("text")

    def clean(text: str, spans: list[tuple]) -> str:
        parts, to = [], 0
        for a, b, *_ in spans:
            if a >= to:
                parts += [text[to:a], mark]
            to = max(to, b)
        return "".join([*parts, text[to:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                texts = part.column(at).to_pylist()
                found = find([t or "" for t in texts], sent.value)
                new = [clean(t, s) if s else t for t, s in zip(texts, found, strict=True)]
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    return bounded(docs).mapInArrow(run, docs.schema)
