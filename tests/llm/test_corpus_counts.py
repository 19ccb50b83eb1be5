"""Source divergence and phrase mining, against plain versions and their SQL."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quarrylake.llm import divergence, phrases, queries
from tests.llm.conftest import MESSY


def lowered(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def duck_rows(sql: str, docs_dir: str) -> list[tuple]:
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{docs_dir}/documents.parquet')")
    return con.execute(sql).fetchall()


# ---------------------------------------------------------------------------------------------
# divergence


def plain_divergence(docs: list[tuple], least: int, top: int) -> list[tuple]:
    """docs: (lang, source, text)."""
    count, within, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        count[lang, source].update(terms)
        within[lang].update(set(terms))
        groups.add((lang, source))
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in within[lang].items() if n >= least}
        sources = sorted(s for x, s in groups if x == lang)
        total = {s: sum(n for t, n in count[lang, s].items() if t in kept) for s in sources}
        own = Counter()
        for s in sources:
            own.update({t: n for t, n in count[lang, s].items() if t in kept})
        share = lambda n, big_n: 1 + 10**9 * (n + 5) // (big_n + 5 * len(kept))  # noqa: B023, E731
        p = {s: {t: share(count[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(own[t], sum(own.values())) for t in kept}
        for s in sources:
            far = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, v, i) for i, (v, o) in enumerate(sorted(far, key=lambda x: (-x[0], x[1].encode())), 1)]
            above = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "term", t, v, i) for i, (v, t) in enumerate(sorted(above, key=lambda x: (-x[0], x[1].encode()))[:top], 1)]
    return sorted(out)


def test_divergence_equals_its_sql(spark, sf_dir):
    found = queries.op12_divergence(spark, sf_dir)
    assert sorted(map(tuple, found.collect())) == sorted(duck_rows(divergence.oracle(), sf_dir))


@pytest.mark.parametrize(("block", "chunk"), [(2, 7), (16, 4096)])
def test_divergence_in_small_tiles_and_chunks(spark, documents, monkeypatch, block, chunk):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    docs = [tuple(r) for r in documents.select("lang", "source", "text").collect()]
    docs += [("xx", f"s{i % 3}", "alpha beta " * i) for i in range(7)] + [("yy", "one", "nothing here"), ("yy", "two", ""), ("yy", None, None), (None, "a", "Ünï ünï ÉA")]
    frame = spark.createDataFrame(docs, "lang string, source string, text string")
    assert sorted(map(tuple, divergence.audit(frame, 5, 9).collect())) == plain_divergence(docs, 5, 9)


def test_divergence_edges(messy, empty):
    docs = [(d[2], d[3], d[1]) for d in MESSY]
    assert sorted(map(tuple, divergence.audit(messy, 2).collect())) == plain_divergence(docs, 2, 50)
    assert divergence.audit(empty).collect() == []
    assert divergence.audit(empty).columns == ["lang", "source", "part", "item", "value", "rank"]


def test_shares_past_64_bits():
    counts, totals = np.array([[10**11, 3]], np.int64), np.array([10**12], np.int64)
    assert divergence.shares(counts, totals, 2).tolist() == [[1 + 10**9 * (n + 5) // (10**12 + 10) for n in (10**11, 3)]]


# ---------------------------------------------------------------------------------------------
# phrases


def plain_phrases(docs: list[tuple], least: int, shown: int) -> list[tuple]:
    """docs: (lang, text)."""
    f = defaultdict(Counter)
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                f[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, of in f.items():
        n = sum(c for w, c in of.items() if len(w) == 1)
        cands = {w: c for w, c in of.items() if len(w) > 1 and c >= least}
        rows, cover = [], Counter()
        for w, a in cands.items():
            for inner in (w[:2], w[1:]) if len(w) == 3 else ():
                cover[inner] = max(cover[inner], a)
        for w, a in cands.items():
            if len(w) == 2 and cover[w] and 100 * cover[w] >= 50 * a:
                continue
            score, k = min((10**6 * a * a // (of[w[:k]] * of[w[k:]]), k) for k in range(1, len(w)))
            rows.append((-score, -a, " ".join(w).encode(), of[w[:k]], of[w[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:shown], 1)]
    return sorted(out)


def test_phrases_equal_their_sql(spark, sf_dir):
    found = queries.op13_phrases(spark, sf_dir)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == sorted(duck_rows(phrases.oracle(), sf_dir))


@pytest.mark.parametrize("setting", [{}, {"PART": 5, "AT_ONCE": 50, "HELD": 40}, {"WIDTH": 4}, {"_BITS": 6, "PART": 7}])
def test_phrases_in_small_parts_and_narrow_sketches(spark, documents, monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(phrases, name, value)
    docs = [tuple(r) for r in documents.filter("doc_id < 30").select("lang", "text").collect()]
    docs += [(None, "New York city; new york CITY\tnew  york\nnew york"), ("en", None), ("en", ""), ("en", "a a a a a a a a a a a a a a a")]
    frame = spark.createDataFrame(docs, "lang string, text string")
    assert sorted(map(tuple, phrases.mine(frame, 3, 60).collect())) == plain_phrases(docs, 3, 60)


def test_phrases_edges(messy, empty):
    docs = [(d[2], d[1]) for d in MESSY]
    assert sorted(map(tuple, phrases.mine(messy, 2, 100).collect())) == plain_phrases(docs, 2, 100)
    assert phrases.mine(empty).collect() == []


def test_most_phrases_just_under_the_threshold_stay_out_of_the_second_pass():
    """Cells and different phrases of about half a GB of text, both by 1,024 less: the rare ones aren't to fill the cells."""
    width, rare, near = phrases.WIDTH - 10, (1 << 27) >> 10, 2_000
    words = [f"rare{i}" for i in range(rare)] + [f"near{i}" for i in range(near)] * 9 + ["often"] * 10
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["\n".join(words).encode()], pa.binary())], ["lang", "text"])
    cells = [bytearray((1 << width) // 8) for _ in range(phrases.ROWS)]
    block = min(phrases.BLOCK, 1 << width) // 8
    for part in phrases._merged(width, 10)(phrases._sketched(width, 10)(iter([batch]))):
        for row in part.to_pylist():
            cells[row["row"]][row["block"] * block : (row["block"] + 1) * block] = row["bits"]
    bits = type("Shared", (), {"value": [bytes(row) for row in cells]})
    counted = {r["phrase"]: r["n"] for part in phrases._counted(width, bits)(iter([batch])) for r in part.to_pylist()}
    assert counted["often"] == 10 and counted[""] == len(words)
    assert sum(p.startswith("near") for p in counted) < 0.8 * near
