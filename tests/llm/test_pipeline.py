"""The corpus pipeline against brute-force versions of its stages; wide SimHash groups."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from test_text_operators import ODD, SCHEMA, brute_lines
from tokenizers import Tokenizer

import corpus_pipeline
from fleetlake.llm import bpe, mixing, simhash, toxicity


def brute_groups(texts, distance=simhash.WIDE_DISTANCE):
    """Least id reachable by pairs that agree in an anchor and differ in at most ``distance`` bits."""
    made = {d: simhash.text_sketch(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and (made[a][1] == made[b][1]).any() and np.bitwise_count(made[a][0] ^ made[b][0]).sum() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in texts}


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def exact_groups(texts, least=0.8):
    """Least id reachable by pairs whose sets of five-word shingles have a similarity of ``least`` or more."""
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in texts}


@pytest.fixture(scope="module")
def prose():
    """Texts of 300 words, each with copies in which some words are replaced; (doc_id, text)."""
    rnd, rows = random.Random(5), []
    for base in range(40):
        words = [f"w{rnd.randrange(3000)}" for _ in range(300)]
        rows.append((base * 10, " ".join(words)))
        for k in range(1, 6):
            other = list(words)
            for i in rnd.sample(range(300), 2 * k):
                other[i] = f"x{rnd.randrange(3000)}"
            rows.append((base * 10 + k, " ".join(other)))
    return rows


@pytest.mark.parametrize("chunk", [4096, 4])
def test_wide_groups_equal_brute_force(spark, prose, chunk):
    rows = [*prose, *((100_000 + r[0], r[1]) for r in ODD if r[0] != 4), (200_000, None), (200_001, prose[0][1])]
    groups = simhash.wide_groups(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk)
    assert {r["doc_id"]: r["component_id"] for r in groups.collect()} == brute_groups(dict(rows))


def test_wide_groups_reach_near_copies_and_leave_others(spark, prose):
    got = {r["doc_id"]: r["component_id"] for r in simhash.wide_groups(spark.createDataFrame(prose, "doc_id long, text string")).collect()}
    sets = {d: shingles(t) for d, t in prose}
    near = [(a, b) for a in sets for b in range(a + 1, a - a % 10 + 6) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    assert len(near) > 60
    assert sum(got[a] == got[b] for a, b in near) / len(near) > 0.97
    assert all(got[d] // 10 == d // 10 for d in got)


def test_wide_groups_of_odd_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.wide_groups(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    rows = [(None, "no id", "a", "x"), (7, "no id", "a", "x"), (7, "no id", "a", "x"), (8, "NO  id", "a", "x")]
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 7]


def test_pipeline_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    frame, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(frame, labels)
    clean = [r for r in docs if model.score(r[1]) < 0.5]
    source = {r[0]: r[3] for r in clean}
    texts = {d: text for d, _, _, text in brute_lines(clean)}
    groups = exact_groups(texts)
    kept = [(d, texts[d], source[d]) for d in sorted(texts) if groups[d] == d]
    assert len(docs) > len(clean) > len(kept) > len(docs) / 2
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", kept)
    tokenizer = Tokenizer.from_file(bpe.default_path())
    want = Counter()
    for doc_id, size, _, _, taken in db.execute(mixing.SQL).fetchall():
        ids = tokenizer.encode(texts[doc_id], add_special_tokens=False).ids
        want[doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += taken // size if size else 0
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == +want and max(got.values()) == 2


def test_stages_take_odd_rows(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    odd = spark.createDataFrame([(r[0], r[1], "en", r[2], None) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (odd.select(*names), odd.select(*names).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf_dir)
            assert name == "BPE encoding" or out.columns == names
            out.collect()


def test_texts_of_all_shingle_counts():
    by_words = defaultdict(list)
    for n in (0, 1, 4, 5, 6, 70_000):
        words, anchors = simhash.text_sketch(" ".join(f"w{k}" for k in range(n)))
        assert words.shape == (simhash.WIDE,) and anchors.shape == (simhash.ANCHORS,)
        by_words[words.tobytes()].append(n)
    assert len(by_words) == 6


def test_run_leaves_one_table_behind(spark, sf_dir):
    import os

    from fleetlake.llm.common import shared_dir

    before = set(os.listdir(shared_dir(spark)))
    out = corpus_pipeline.run(spark, sf_dir)
    left = {f for f in os.listdir(shared_dir(spark)) if f not in before}
    assert len(left) == 1 and out.count() > 0
