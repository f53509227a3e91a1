"""Merkle manifest, decontamination and whitening against brute force, and their defined results for odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from test_text_operators import LONG, ODD

from fleetlake.llm import decontaminate, merkle, whitening

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def brute_leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(leaves):
    """Levels of a tree, and each leaf's siblings level by level as (digest, stands left)."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([H(*x[k : k + 2]) for k in range(0, len(x), 2)])
    paths = []
    for k in range(len(leaves)):
        path = []
        for x in levels[:-1]:
            path.append((x[k ^ 1], k % 2 == 1) if k ^ 1 < len(x) else None)
            k //= 2
        paths.append(path)
    return levels[-1][0] if leaves else None, paths


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    order = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r))) for g in langs}
    subs = {g: brute_tree([brute_leaf(r) for r in order[g]]) for g in langs}
    root, above = brute_tree([subs[g][0] for g in langs])
    out = []
    for g, up in zip(langs, above):
        for r, path in zip(order[g], subs[g][1]):
            path = path + up
            bad = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            at = brute_leaf((*r[:3], r[3] + 1, r[4]) if bad else r)
            for step in path:
                at = H(at) if step is None else H(step[0], at) if step[1] else H(at, step[0])
            out.append((r[0], brute_leaf(r), subs[g][0], root, H(*(s[0] for s in path if s)), at, at == root))
    return sorted(out, key=str)


def got_manifest(spark, rows, monkeypatch=None):
    docs = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(merkle, "table", lambda *_: docs)
    return sorted(map(tuple, merkle.query(spark, "").collect()), key=str)


@pytest.mark.parametrize("few, piece", [(256, 4096), (0, 3)])  # the second joins all levels, and deals copies out
def test_manifest_equals_brute_force(spark, monkeypatch, few, piece):
    monkeypatch.setattr(merkle, "FEW", few)
    monkeypatch.setattr(merkle, "PIECE", piece)
    rnd = random.Random(few)
    rows = [(k * 3 % 701, rnd.choice(["x", None]), "big", rnd.choice([None, k, 2**63 - 1]), rnd.choice([None, "", "é 中文 \U0001f600", "a" * k])) for k in range(700)]
    rows += [(5, "x", "big", 7, "same")] * 11 + [(None, "x", "big", 7, "no id")] * 2 + [(5, "x", "big", 8, "other")]
    rows += [(1, "x", None, 3, "abc"), (2, "x", "", 3, "abc"), (3, "x", "é", 3, "abc"), (4, "x", "z", 3, "abc"), (4, "x", "Z", None, "word " * 50_000)]
    assert got_manifest(spark, rows, monkeypatch) == brute_manifest(rows)


def test_manifest_of_few(spark, monkeypatch):
    assert got_manifest(spark, [], monkeypatch) == []
    for rows in ([(7, "x", "en", 3, "abc")], [(7, "x", "en", 3, "abc")] * 2, [(7, "x", "en", 3, "abc"), (8, None, None, None, None)]):
        assert got_manifest(spark, rows, monkeypatch) == brute_manifest(rows)
    assert got_manifest(spark, [(7, "x", "en", 3, "abc")], monkeypatch)[0][4] == H()


def test_manifest_sql_knows_the_same(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*merkle.FIELDS).collect()]
    want = brute_manifest(rows)
    assert sorted(con.execute(merkle.SQL).fetchall(), key=str) == want == sorted(map(tuple, merkle.query(spark, sf_dir).collect()), key=str)
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_leaks(docs, items, span=10):
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        if item is not None and n:
            for k in range(len(w) - n + 1):
                grams[tuple(w[k : k + n])].add(str(item))
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[g]
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def leaks():
    rnd = random.Random(9)
    some = lambda n: [rnd.choice(["alpha", "BETA", "gamma9", "naïve", "中文", "Δ", "x1"]) for _ in range(n)]
    items = [(k, " ".join(some(rnd.choice((3, 9, 10, 11, 40))))) for k in range(60)] + [(60, "one"), (61, ""), (62, None), (None, "no id of the item is here at all so it counts nothing"), (5, "second text of item five with more than ten words in it"), (7, "x" * 3_000_000), (8, "-- !! ..")]
    docs = []
    for k in range(80):
        w = some(rnd.choice((0, 2, 30, 300)))
        for _ in range(rnd.randrange(3)):
            own = words(rnd.choice(items)[1])
            a = rnd.randrange(len(own) + 1)
            w[rnd.randrange(len(w) + 1) : 0] = own[a : a + rnd.randrange(40)]
        docs.append((k, rnd.choice([" ", ", ", "\n--"]).join(w).upper() if k % 3 else "\x00\u0080 " + "!".join(w)))
    docs += [(100, None), (100, ""), (101, "x" * 3_000_000), (101, "y" + "x" * 3_000_000), (102, ("second text of item five with more than ten words in it ") * 40_000), (None, "One"), (None, "One")]
    docs += [(200 + k, r[1]) for k, r in enumerate(ODD)]
    return docs, items


@pytest.mark.parametrize("bound", [decontaminate.SET_BYTES, 0])
def test_leaks_equal_brute_force(spark, leaks, bound):
    docs, items = leaks
    frame = spark.createDataFrame([(*r, "a", 1) for r in docs], "doc_id long, text string, found string, _row int").repartition(3)
    got = decontaminate.scan(frame, spark.createDataFrame(items, "item_id long, text string"), set_bytes=bound, name="leak")
    rows = got.collect()
    assert got.columns == ["doc_id", "text", "found", "_row", "leak"]
    assert sorted(((r["doc_id"], r["leak"]["n_words"], r["leak"]["n_hit"], r["leak"]["items"]) for r in rows), key=str) == brute_leaks(docs, items)
    for r in rows:  # spans are runs of hit words
        data = (r["text"] or "").encode()
        parts = [data[s["start"] : s["stop"]].decode() for s in r["leak"]["spans"]]
        assert sum(len(words(p)) for p in parts) == r["leak"]["n_hit"]


def test_removal_takes_spans_or_documents(spark, leaks):
    docs, items = leaks
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["text"]): r["found"] for r in decontaminate.scan(frame, bench).collect()}
    for bound in (decontaminate.SET_BYTES, 0):
        left = decontaminate.remove(frame, bench, set_bytes=bound)
        assert left.columns == frame.columns and left.count() == len(docs)
        want = []
        for (d, text) in docs:
            data, at, kept = (text or "").encode(), 0, b""
            for s in found[d, text]["spans"]:
                kept, at = kept + data[at : s["start"]], s["stop"]
            want.append((d, None if text is None else (kept + data[at:]).decode()))
        assert sorted(map(tuple, left.collect()), key=str) == sorted(want, key=str)
    whole = decontaminate.remove(frame, bench, by="documents", least=5).collect()
    assert sorted((r["doc_id"] for r in whole), key=str) == sorted((d for d, t in docs if found[d, t]["n_hit"] < 5), key=str)
    with pytest.raises(ValueError):
        decontaminate.remove(frame, bench, by="words")


def test_leaks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, LONG)], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    for bound in (decontaminate.SET_BYTES, -1):
        assert [tuple(r["found"]) for r in decontaminate.scan(docs, items, set_bytes=bound).collect()] == [(8, 0, [], [])]
        assert decontaminate.scan(docs.limit(0), items, set_bytes=bound).count() == 0


def test_leaks_of_the_tables(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in brute_leaks(docs, items)]
    assert sorted(map(tuple, decontaminate.query(spark, sf_dir).collect()), key=str) == sorted(want, key=str) and any(r[-1] for r in want)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 150])
def test_divide_and_conquer_finds_eigenvectors(n):
    rng = np.random.default_rng(n)
    turn = np.linalg.qr(rng.standard_normal((n, n)))[0]
    few = rng.standard_normal((n, max(1, n // 3)))
    for a in (np.cov(rng.standard_normal((3 * n + 2, n)).T).reshape(n, n), turn @ np.diag(np.repeat([1.0, 2, 2, 5, 5, 5], n)[:n]) @ turn.T, turn @ np.diag(10.0 ** -np.linspace(0, 14, n)) @ turn.T, 3 * np.eye(n), np.zeros((n, n)), few @ few.T, np.diag(np.arange(n) % 4 + 1.0)):
        a = (a + a.T) / 2
        values, vectors = whitening.eigen(a)
        want, size = np.linalg.eigvalsh(a)[::-1], max(1e-300, np.abs(a).max())
        assert np.abs(values - want).max() <= 1e-12 * size and np.all(np.diff(values) <= 0)
        assert np.linalg.norm(a @ vectors - vectors * values) <= 1e-11 * size and np.linalg.norm(vectors.T @ vectors - np.eye(n)) <= 1e-12 * n


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    e = rng.choice([-1, 1], 40) * 10.0 ** rng.uniform(-9, 0, 40)
    assert np.abs(whitening.polar(q @ np.diag(e) @ q.T) - q @ np.diag(np.sign(e)) @ q.T).max() < 1e-6


def brute_whitening(rows, most=16):
    x = {k: [int(np.floor(64 * float(c))) + 1_000_000 for c in v] for k, (_, v) in enumerate(rows)}
    fit = np.array(sorted({tuple(v) for v in x.values()}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    y = np.array((n * fit - s) / n, dtype=np.float64)
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    k = min(most, int((e > len(e) * 2.3e-16 * e[0]).sum()))
    out = []
    for at, (vec_id, _) in enumerate(rows):
        d = [n * c - t for c, t in zip(x[at], s)]
        w = (np.array([float(c) / n for c in d]) @ q[:, :k]) / np.sqrt(e[:k])
        out += [(vec_id, j + 1, n, sum(c * c for c in d), abs(w[j]), e[j] / np.trace(v)) for j in range(k)]
    return out


def got_whitening(spark, rows, monkeypatch, kind="double"):
    frame = spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding array<{kind}>, x string")
    monkeypatch.setattr(whitening, "table", lambda *_: frame)
    return whitening.query(spark, "").collect()


@pytest.mark.parametrize("scale", [0.1, 3.0, 1e6])
def test_whitening_equals_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(whitening, "ROWS", 64)
    rng = np.random.default_rng(4)
    x = scale * rng.standard_normal((300, 20)) * np.linspace(1, 3, 20)
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, x[:40], x[:1]]))] + [(None, x[5].tolist()), (7, x[6].tolist()), (900, [0.0] * 20)]
    odd = [(901, None), (902, [float("nan")] + [0.0] * 19), (903, [float("-inf")] + [0.0] * 19), (904, [None] + [0.0] * 19), (905, [1.0]), (906, []), (907, [1e300] + [0.0] * 19)]
    got, want = got_whitening(spark, rows + odd, monkeypatch), brute_whitening(rows)
    key = lambda r: (str(r[0]), r[1], r[4])
    plain = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in got), key=key)
    for g, w in zip(plain, sorted(want, key=key), strict=True):
        assert g[:3] == w[:3] and g[3] == (w[3] if w[3] < 1 << 63 else None)
        assert abs(g[4] - w[4]) < 1e-8 and abs(g[5] / w[5] - 1) < 1e-9
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    signs = defaultdict(set)  # a component has one sign for all rows
    for r in got:
        if r["vec_id"] in (0, 300):  # equal vectors
            signs[r["component"]].add(r["whitened"])
    assert all(len(v) == 1 for v in signs.values())


def test_whitening_of_few(spark, monkeypatch):
    assert got_whitening(spark, [], monkeypatch) == [] and got_whitening(spark, [(1, None)], monkeypatch) == []
    assert got_whitening(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])], monkeypatch) == []  # one different vector has no spread
    for rows in ([(1, [1.0, 2.0]), (2, [3.0, 2.5])], [(1, [1.0, 0.0, 5.0]), (2, [2.0, 0.0, 5.0]), (3, [4.0, 0.0, 5.0])]):
        got = got_whitening(spark, rows, monkeypatch, "float")
        assert [(r["component"], r["n"]) for r in got] == [(1, len(rows))] * len(rows)
        assert all(abs(abs(r["whitened"]) - w[4]) < 1e-9 and r["deviation"] == w[3] for r, w in zip(sorted(got, key=lambda r: r["vec_id"]), brute_whitening(rows)))


def test_moments_are_exact(spark):
    big = [[2**40 + k, -(2**41) + 7 * k * k] for k in range(50)]
    frame = spark.createDataFrame([(v,) for v in big], "x array<long>").repartition(5)
    got = whitening.summed(frame, 2, lambda col: whitening.products(whitening.whole(col)), "decimal(38,0)")
    assert got.tolist() == [[sum(r[i] * r[j] for r in big) for j in range(2)] for i in range(2)]
