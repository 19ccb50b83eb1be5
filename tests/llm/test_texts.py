"""Language ID, secret scans, quality votes and piece encoding, against plain versions and held-out rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylake.llm import language, pieces, quality, queries, secrets
from tests.llm.conftest import MESSY


def is_held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


# ---------------------------------------------------------------------------------------------
# language ID


def test_language_of_held_out_rows(spark, sf_dir):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op1_language_id(spark, sf_dir).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == is_held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    asked = [r for r in rows if r["held_out"] and truth[r["doc_id"]] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in asked) / len(asked) > 0.97


def test_language_never_learns_from_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    swapped = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit("xx")).otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, language.identify(d).collect())) for d in (docs, swapped))
    assert a == b


def test_language_edges(messy, empty):
    rows = language.identify(messy).collect()
    assert len(rows) == len(MESSY)
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (0, 1, 2, 3))
    assert by_id[4]["lang_pred"] == by_id[6]["lang_pred"] == "en"
    assert language.identify(empty).collect() == []
    assert {r["lang_pred"] for r in language.identify(messy.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.keep_identified(messy).columns == messy.columns


def test_language_backs_off_to_shorter_grams():
    none = ([], np.zeros((0, 2)))
    tables = [(["hund"], [[0.0, -9.0]]), none, (["und"], [[-1.0, -5.0]]), none, (["q"], [[-5.0, -1.0]])]
    model = language.Model(["de", "en"], tables)
    assert model.predict("Hund")[0] == "de"
    assert model.predict("rund")[0] == "de"  # no word, no 4-gram, a known 3-gram
    assert model.predict("q")[0] == "en"  # only the single letter is known
    assert model.predict("7 _ ²") == ("und", 0.0)


# ---------------------------------------------------------------------------------------------
# secret scans

PLAIN = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
}


def plain_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), k) for k, (p, ok) in PLAIN.items() for m in re.finditer(p, text, re.ASCII) if ok(m)]
    return sorted(found, key=lambda x: (x[0], list(PLAIN).index(x[2])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWd", "token", "apikey", "api_key", "secret", '"', "'", " ", "=", ":", "AKIA", "ABCDEFGH1234", "deadbeef", "0123456789abcdef", "é", "ſ", "K", "\n", "xyz.-_"]), max_size=14).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert secrets.base_spans(text) == plain_spans(text)


def test_secret_query_over_documents(spark, small_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    rows = queries.op2_secrets(spark, small_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_spans(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, _, k in want) for x in PLAIN]
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_network_recall_and_precision_on_unseen_forms_of_known_kinds(spark, small_dir):
    net = secrets.train(spark.read.parquet(f"{small_dir}/documents.parquet"))
    fresh = secrets.generated(600, seed=99)
    sure = net.probability([x[:3] for x in fresh]) >= net.threshold
    labels = np.array([x[3] for x in fresh]) > 0
    assert (sure & labels).sum() / labels.sum() > 0.9
    assert (sure & labels).sum() / sure.sum() > 0.9


def test_candidates_take_in_values_next_to_credential_words_and_what_base_findings_leave():
    def asked(text):
        return [text[a:b] for a, b in secrets.candidates(text, secrets.base_spans(text))]

    assert asked("pwd: kQzrWvXm now") == ["kQzrWvXm"]  # letters alone, short
    assert asked("the passphrase is horse%Battery!staple") == ["horse%Battery!staple"]
    assert asked("password: p@ss!w0rd9") == ["p@ss!w0rd9"]
    assert asked("see aB3dE6gH.9kLmN2pQ end") == ["aB3dE6gH.9kLmN2pQ"]
    assert asked("qWertyuiop1234567/" + "0a" * 16 + "/Zxcvbnm7654321qwe") == ["qWertyuiop1234567/", "/Zxcvbnm7654321qwe"]
    assert asked("a monkey sat here, plain words alone") == []


def test_pieces_cover_every_place_of_a_candidate():
    for n in (1, 47, 48, 49, 64, 65, 200, 1001):
        cut = secrets.pieces(("x" * (n + 9), 5, 5 + n))
        assert {i for _, a, b in cut for i in range(a, b)} == set(range(5, 5 + n))
        assert all(b - a <= secrets.INSIDE for _, a, b in cut)


def test_candidate_shaped_words_are_not_taken_for_look_alikes(spark):
    word = "Zx9Kq2Lm7Vt4Bn8Rw3Yp"
    found = secrets.labelled_findings(spark.createDataFrame([(1, f"some words around {word} here extraordinarily")], "doc_id long, text string"))
    assert all(word not in t[a:b] for t, a, b, _ in found) and any(t[a:b] == "extraordinarily" and y == 0 for t, a, b, y in found)


def test_network_reads_candidates_to_their_end(spark, small_dir):
    net = secrets.train(spark.read.parquet(f"{small_dir}/documents.parquet"))
    rng = random.Random(12)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda: "ghp_" + "".join(rng.choice(alnum) for _ in range(36))
    behind = [f"see {'/river/stone/lamp' * rng.randint(4, 9)}/{key()} end" for _ in range(60)]
    plain = [f"see {'/river/stone/lamp' * rng.randint(4, 9)}/page{i} end" for i in range(60)]
    hits = [sum(any(k == "model" for _, _, k, _ in s) for s in secrets.find(t, net)) for t in (behind, plain)]
    assert hits[0] >= 54 and hits[1] <= 6


#: Forms that a network which never saw them still recalls; README tells the figures of all.
@pytest.mark.parametrize("form", ["prefixed", "base64", "inside_path"])
def test_secrets_of_a_form_left_out_of_training(form):
    learnt = secrets.generated(4_000, forms=tuple(f for f in secrets.FORMS if f != form))
    net = secrets.Network()
    items, labels = [x[:3] for x in learnt], np.array([x[3] for x in learnt], np.float32)
    net.fit(items[:3000], labels[:3000], epochs=4)
    net.calibrate(items[3000:], labels[3000:])
    asked = [c for c in (secrets.as_asked(x[:3]) for x in secrets.generated(600, seed=97, forms=(form,)) if x[3]) if c]
    assert (net.probability(asked) >= net.threshold).mean() >= 0.9


def test_secret_edges(messy, empty):
    rows = secrets.scan(messy).collect()
    assert len(rows) == len(MESSY)
    kinds = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in rows if r["doc_id"] is not None}
    assert kinds[1] == kinds[0] == [] and "access" in kinds[8]
    clean = secrets.redact(messy)
    assert clean.columns == messy.columns and clean.count() == len(MESSY)
    assert clean.filter(F.contains("text", F.lit("abcdefgh1234")) | F.contains("text", F.lit("AKIAABC"))).count() == 0
    assert secrets.scan(empty).collect() == [] and secrets.redact(empty).collect() == []


# ---------------------------------------------------------------------------------------------
# quality


def test_quality_of_held_out_rows(spark, sf_dir):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op7_quality(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r["held_out"] == is_held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    asked = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    good, bad = [s for s, y in asked if y], [s for s, y in asked if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9


def test_quality_vote_is_the_exact_nearest_neighbour_vote():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(12)) for _ in range(60)]
    voters = quality.Voters(texts[:40], [i % 2 for i in range(40)])
    got = voters.score(texts[40:])
    for text, score in zip(texts[40:], got, strict=True):
        cosine = (voters.project([text]) @ voters.vectors.T)[0]
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        weight = np.maximum(cosine[near], 1e-6).astype(float) ** quality.SHARPNESS
        assert score == pytest.approx((weight * voters.labels[near]).sum() / weight.sum(), abs=1e-4)


def test_quality_edges(spark, messy, empty):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, None), (None, 1, 0), (9, None, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(messy, labels).collect()
    assert len(rows) == len(MESSY) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.classify(messy, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty, labels).collect() == []


# ---------------------------------------------------------------------------------------------
# piece encoding


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def expected(library, text: str) -> tuple[list[int], str]:
    ids = library.encode(text, add_bos=True, add_eos=True)
    return ids, library.decode(ids)


@settings(max_examples=400, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["a", "the", " ", "  ", "▁", "\n", "\t", "é", "ing", "日本", "🙂", "\x00", "0", "==", "ﷺ", "É", " ", "<s>", "</s>", "<unk>", "<0x41>", "un", "break", "able"]), max_size=20).map("".join)))
def test_pieces_equal_the_library(library, text):
    codec = pieces.codec()
    ids, decoded = expected(library, text)
    raw = codec.encode(text)
    assert np.frombuffer(raw, "<u4").tolist() == ids
    assert codec.decode(raw) == decoded


def test_piece_query_over_documents(spark, small_dir, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    rows = queries.op10_sentencepiece(spark, small_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, decoded = expected(library, texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_piece_edges(messy, empty, library):
    rows = pieces.round_trip(messy).collect()
    want = sorted((expected(library, m[1] or "")[0] for m in MESSY))
    assert sorted(np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in rows) == want
    assert pieces.round_trip(empty).collect() == []


def test_language_scores_equal_a_plain_scorer(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = [r for r in docs.collect() if r["text"] is not None]
    counts: dict[tuple[str, int], dict[str, int]] = {}
    for r in rows:
        if r["lang"] is not None and not is_held_out(r["doc_id"]):
            for word in re.findall(r"[^\W\d_]+", r["text"].lower()):
                for n in range(5):
                    for item in ([word] if n == 0 else [f"<{word}>"[i : i + n] for i in range(len(word) + 3 - n)]):
                        held = counts.setdefault((r["lang"], n), {})
                        held[item] = held.get(item, 0) + 1
    langs = sorted({lang for lang, _ in counts})
    known = [{x for lang in langs if (held := counts[lang, n]) for x in held if held[x] >= language.LEAST_COUNT} for n in range(5)]
    grid = [{x: [c if (c := counts[lang, n].get(x, 0)) >= language.LEAST_COUNT else 0 for lang in langs] for x in known[n]} for n in range(5)]
    total = [np.array([[c + 0.5 for c in v] for v in grid[n].values()]).sum(axis=0) for n in range(5)]
    logs = [{x: np.log((np.array(v) + 0.5) / total[n]) for x, v in grid[n].items()} for n in range(5)]

    def plain(text: str) -> str:
        score = np.zeros(len(langs))
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            if word in logs[0]:
                score += logs[0][word]
                continue
            for n in (4, 3, 2, 1):
                found = [logs[n][g] for i in range(len(word) + 3 - n) if (g := f"<{word}>"[i : i + n]) in logs[n]]
                if found:
                    score += np.mean(found, axis=0) - (5 - n)
                    break
        return langs[int(score.argmax())]

    model = language.train(docs)
    assert model.languages == langs
    asked = [r["text"] for r in rows if any(c.isalpha() for c in r["text"])]
    assert [model.predict(t)[0] for t in asked] == [plain(t) for t in asked]
