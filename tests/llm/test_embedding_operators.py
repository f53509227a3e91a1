"""Embedding operators against brute force."""

import numpy as np
import pytest

from fleetlake.llm import embedding_dedup, neighbours

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 16)).astype(np.float32)
    near = base[rng.integers(0, 300, 150)] + 0.05 * rng.standard_normal((150, 16)).astype(np.float32)
    same = np.repeat(base[:3], 30, axis=0)
    x = np.concatenate((base, near, same, 3 * base[5:8]))
    rows = [(int(i), v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(9000, None, 0), (9001, [0.0] * 16, 0), (9002, [NAN] + [1.0] * 15, 0), (9003, [INF] + [1.0] * 15, 0), (9004, [None] + [1.0] * 15, 0), (9020, [1.0, 2.0], 0), (9040, [], 0)]
    return rows, odd


def brute_links(rows, threshold):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    c = (x @ x.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None]
    link = c >= threshold
    np.fill_diagonal(link, False)
    label = np.arange(len(ids))
    while True:
        new = np.minimum(label, np.array([label[m].min() if m.any() else len(ids) for m in link]))
        if (new == label).all():
            break
        label = new
    return {int(ids[k]): (int(link[k].sum()), int(ids[label[k]])) for k in range(len(ids))}


@pytest.mark.parametrize("tile", [6144, 40])
def test_links_equal_brute_force(spark, vectors, tile, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rows, odd = vectors
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df).collect()}
    want = brute_links(rows, 0.95)
    assert sum(n for n, _ in want.values()) > 500
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()} | {i: (0, i, True) for i, *_ in odd}


def test_links_of_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_vectors(df).count() == 0
    df = spark.createDataFrame([(1, None, 0)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in embedding_dedup.near_vectors(df).collect()] == [(1, 0, 1, True)]


def brute_nearest(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in order]
    return out


@pytest.mark.parametrize("cell", [4096, 60])
def test_neighbours_recall_and_order(spark, vectors, cell, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", cell)
    rows, odd = vectors
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute_nearest(rows, 20)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.95
    x = {r[0]: np.array(r[1], dtype=np.float64) for r in rows}
    for q, found in got.items():
        assert len(found) == 20 and q not in {i for i, _ in found} and len({i for i, _ in found}) == 20
        assert all(abs(s - float(x[i] @ x[q])) < 1e-9 for i, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))


def test_neighbours_of_few(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert neighbours.nearest(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (2, [0.0, 1.0], 0)], schema)
    assert [tuple(r) for r in neighbours.nearest(df).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 0.0)]


def test_recall_on_tables(spark, sf_dir):
    path = sf_dir.replace("0.001", "0.1")
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute_nearest(rows, 20)
    got = {}
    for r in neighbours.query(spark, path).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(got[q] & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    links = brute_links(rows, 0.95)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.query(spark, path).collect()}
    assert found == links


def test_tiny_and_huge_vectors_link_like_others(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 40)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((60, 16))
    near = base + 0.02 * rng.standard_normal((60, 16))
    size = rng.choice([1e-310, 1e-200, 1.0, 1e200, 1e307], (120, 1))
    plain = np.concatenate((base, near))
    rows = [(k, (v * s).tolist(), 0) for k, (v, s) in enumerate(zip(plain, size[:, 0]))]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == brute_links([(k, v.tolist()) for k, v in enumerate(plain)], 0.95)
    assert sum(n for n, _ in got.values()) >= 120
