"""Nearest neighbours, exact top-k and sharding, against brute force."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from quarrylake.llm import ann, queries, sharding, topk
from tests.conftest import rows_of

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string, vec string, list string, bucket string"


def row(vec_id, embedding):
    return (vec_id, embedding, None, "x", "x", "x", "x", "x")


AWKWARD = [row(0, [1.0, 2.0, 0.5]), row(100, [1.0, 2.0, 0.5]), row(100, [9.0, 9.0, 9.0]), row(200, [0.0, 0.0, 0.0]), row(300, None), row(400, [1.0, None, 2.0]), row(500, [NAN, 1.0, 1.0]), row(600, [INF, 1.0, 1.0]), row(700, []), row(800, [1.0, 2.0]), row(None, [1.0, 1.0, 1.0])]
AWKWARD += [row(i, [1.0, 2.0, 0.5]) for i in range(1, 40)] + [row(i, [float(i % 7) - 3, float(i % 5) - 2.5, 0.25]) for i in range(41, 99)]


@pytest.fixture
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


def usable(zero: bool) -> list[tuple[int, np.ndarray]]:
    rows = [(r[0], np.array(r[1], float)) for r in AWKWARD if r[0] is not None and r[1] is not None and len(r[1]) == 3 and None not in r[1]]
    return [(i, v) for i, v in rows if np.isfinite(v).all() and (zero or v.any())]


def brute(rows, every, k, score, as_query, best):
    """{query: [(vec_id, score)]}; a repeated id is one candidate at its best score."""
    ids, grid = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for q in sorted({i for i in ids.tolist() if i % every == 0}):
        mine = as_query([v for i, v in rows if i == q])
        got: dict[int, float] = {}
        for i, s in zip(ids.tolist(), score(grid, mine).tolist(), strict=True):
            if i != q:
                got[i] = best(got.get(i, s), s)
        out[q] = sorted(got.items(), key=lambda x: ((x[1] if best is min else -x[1]), x[0]))[:k]
    return out


def grouped(rows) -> dict:
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def distance(grid, q):
    return np.sqrt(((grid - q) ** 2).sum(axis=1))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_neighbours_found(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r["embedding"] is not None and None not in r["embedding"]]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    want = brute(rows, 100, 10, distance, lambda v: v[0], min)
    got = grouped(queries.op3_ann(spark, sf_dir).collect())
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = sum(len({x for x, _ in got[q]} & {x for x, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    exact = dict(rows)
    assert all(s == pytest.approx(float(np.linalg.norm(exact[q] - exact[x])), rel=1e-12) for q, v in got.items() for x, s in v)


def test_neighbour_edges(awkward):
    got = grouped(ann.nearest(awkward).collect())
    want = brute(usable(zero=False), 100, 10, distance, lambda v: min(v, key=lambda x: x.astype("<f8").tobytes()), min)
    assert set(got) == set(want)
    assert [x for x, _ in got[0]] == [x for x, _ in want[0]]
    assert ann.nearest(awkward.limit(0)).collect() == []


@pytest.mark.parametrize("unit", [0.001, 1.0, 100.0])
def test_recall_over_many_lists_in_any_unit(spark, monkeypatch, unit):
    for name, value in (("LIST_ROWS", 128), ("QUERY_BLOCK", 16), ("ROW_BLOCK", 96)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 16)) * 2
    grid = (centres[rng.integers(0, 40, 8000)] + rng.standard_normal((8000, 16))) * unit
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(grid)], "vec_id long, embedding array<double>")
    index = ann.fit(ann.usable(frame))
    assert len(index.centroids) == 62 and 1.05 < index.copies <= ann.COPIES
    homes = np.bincount([x[0] for x in index.lists_of(grid)], minlength=62)
    assert homes.max() < 3 * homes.mean()
    want = brute([(i, v) for i, v in enumerate(grid)], 100, 10, distance, lambda v: v[0], min)
    got = grouped(ann.nearest(frame).collect())
    hits = sum(len({x for x, _ in got[q]} & {x for x, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits / sum(map(len, want.values())) >= 0.9


def test_queries_visit_every_list_within_the_ratio():
    rng = np.random.default_rng(9)
    index = ann.Index(rng.standard_normal((3000, 8)), 120, 10)
    index.beam = 1  # too narrow a search is widened
    asked = rng.standard_normal((50, 8))
    d = ann._distances(asked, index.centroids)
    inside = [set(np.flatnonzero(x <= index.ratio * x.min())) for x in d]
    found = [set(x) for x in index.probes(asked)]
    assert sum(len(a & b) for a, b in zip(found, inside, strict=True)) / sum(map(len, inside)) > 0.9


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(5)
    index = ann.Index(rng.standard_normal((3000, 8)), 120, 10)
    asked = rng.standard_normal((200, 8))
    at, dist = index.search(asked, 8)
    exact = ann._distances(asked, index.centroids)
    assert np.mean([len(set(a.tolist()) & set(np.argsort(d)[:8].tolist())) / 8 for a, d in zip(at, exact, strict=True)]) > 0.9
    lists = index.lists_of(asked)
    assert any(len(x) > 1 for x in lists) and all(len(set(x)) == len(x) for x in lists)


def test_a_centroid_near_to_all_costs_no_room_nor_steps(monkeypatch):
    rng = np.random.default_rng(11)
    shell = rng.standard_normal((600, 32))
    shell /= np.linalg.norm(shell, axis=1)[:, None]
    index = ann.Index(np.concatenate([np.zeros((1, 32)), shell]), 601, 10)
    assert np.diff(index.ends).max() > 500 and len(index.graph) <= 601 * (2 * ann.LINKS + 2)
    steps, linked = [], index._linked
    monkeypatch.setattr(index, "_linked", lambda nodes: steps.append(1) or linked(nodes))
    at, dist = index.search(shell[:50] * 1.1, 601)
    assert len(steps) <= 10  # a step for each centroid of the beam before
    assert (np.sort(at, axis=1) == np.arange(601)).all() and (np.diff(dist, axis=1) >= 0).all()


@pytest.mark.parametrize("kind", ["plain", "ties", "repeated ids", "one point", "huge"])
def test_rows_chosen_by_products_are_the_nearest(kind):
    rng = np.random.default_rng(12)
    for n, m, dim, k in zip(rng.integers(1, 80, 20), rng.integers(1, 40, 20), rng.integers(1, 6, 20), rng.integers(1, 12, 20), strict=True):
        grid = rng.integers(-2, 3, (n, dim)).astype(float) if kind == "ties" else rng.standard_normal((n, dim))
        grid = {"one point": np.repeat(grid[:1], n, 0) * 1e6, "huge": grid * 1e160}.get(kind, grid)
        ids, owners = rng.integers(0, n if kind == "repeated ids" else 10**6, n), rng.permutation(1000)[:m]
        asked = grid[rng.integers(0, n, m)]
        owners[0] = ids[0]
        with np.errstate(over="ignore"):
            rows = zip(*(x.tolist() for x in ann.nearest_of(asked, owners, grid, ids, int(k))), strict=True)
            want = set()
            for own, q in zip(owners.tolist(), asked, strict=True):
                got: dict[int, float] = {}
                for x, d in zip(ids.tolist(), distance(grid, q).tolist(), strict=True):
                    if x != own:
                        got[x] = min(d, got.get(x, d))
                want |= {(own, *x) for x in sorted(got.items(), key=lambda x: (x[1], x[0]))[:k]}
        assert set(rows) == want


def floored(v):
    return np.floor(256 * np.asarray(v, float)).astype(np.int64)


@pytest.mark.parametrize("seeds", [8, topk.SEEDS])
def test_products_equal_brute_force(spark, monkeypatch, seeds):
    monkeypatch.setattr(topk, "SEEDS", seeds)  # few seeds: weak first scores, so pruning has work to do
    rng = np.random.default_rng(6)
    grid = rng.standard_normal((1500, 12)) * np.exp(rng.standard_normal(1500))[:, None]
    rows = [(i, grid[i].astype(np.float32)) for i in range(1500)]
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")
    want = brute([(i, floored(v)) for i, v in rows], 50, 5, lambda g, q: g @ q, lambda v: v[0], max)
    assert grouped(topk.top_products(frame).collect()) == want


def test_products_in_small_blocks_and_cells(spark, monkeypatch):
    for name, value in (("SEEDS", 4), ("QUERY_BLOCK", 7), ("ROW_BLOCK", 50)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(16)
    grid = rng.standard_normal((900, 6)) * np.exp(rng.standard_normal(900))[:, None]
    grid[300:600] = grid[300]  # a third of all rows in one cell
    rows = [(i, grid[i]) for i in range(900)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    want = brute([(i, floored(v)) for i, v in rows], 50, 5, lambda g, q: g @ q, lambda v: v[0], max)
    assert grouped(topk.top_products(frame).collect()) == want


def test_products_are_exact_or_an_error(spark):
    big = np.array([[2**31, 1], [2**31, 3]], np.int64)
    assert topk.products(big, big).tolist() == [[2**62 + 1, 2**62 + 3], [2**62 + 3, 2**62 + 9]]
    with pytest.raises(OverflowError):
        topk.products(big * 4, big * 4)
    far = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_products(far).collect()


def test_product_edges(awkward):
    got = grouped(topk.top_products(awkward).collect())
    want = brute([(i, floored(v)) for i, v in usable(zero=True)], 50, 5, lambda g, q: g @ q, lambda v: min(v, key=lambda x: x.astype("<i8").tobytes()), max)
    assert got == want
    assert topk.top_products(awkward.limit(0)).collect() == []


def test_table_is_filled_by_turns_in_order_of_preference(spark):
    import hashlib

    shards, slots = 5, 31
    digits = lambda text, at: int(hashlib.md5(text.encode()).hexdigest()[at : at + 8], 16)
    taken: dict[int, int] = {}
    while len(taken) < slots:
        for s in range(shards):
            first, skip = digits(f"shard-{s}", 0) % slots, digits(f"shard-{s}", 8) % (slots - 1) + 1
            if len(taken) < slots:
                taken[next(x for j in range(slots) if (x := (first + j * skip) % slots) not in taken)] = s
    assert {r["slot"]: r["shard"] for r in sharding.lookup_table(spark, shards, slots).collect()} == taken


def test_sharding_matches_its_sql(spark, small_dir, duck):
    frame = queries.op4_sharding(spark, small_dir)
    found = duck.execute(sharding.oracle())
    assert rows_of(frame.columns, frame.collect()) == rows_of([c[0] for c in found.description], found.fetchall())


def test_sharding_edges(messy, empty):
    rows = sharding.place(messy).collect()
    assert len(rows) == messy.count() and all(0 <= r["shard"] < sharding.SHARDS for r in rows)
    assert sharding.place(messy, salt="text").filter("doc_id = 4").select("shard").distinct().count() == 1
    assert sharding.place(empty).collect() == []


def test_oracles_run_on_duckdb(small_dir):
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{small_dir}/{name}.parquet')")
    for name, sql in queries.ORACLES.items():
        assert con.execute(sql).fetchall(), name
