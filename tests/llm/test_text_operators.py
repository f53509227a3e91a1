"""Text operators against brute force, and their defined results for odd rows."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from fleetlake.llm import bpe, license_scan, line_dedup, mixing, quality, sharding, simhash, toxicity

LONG = "a line of words that is long enough"
ODD = [
    (1, None, "a", "x"), (2, "", None, "y"), (3, " \t\n", "b", "x"), (4, "one", "a", None), (4, "one", "a", None),
    (5, f"{LONG}\nshort\n{LONG.upper()} \t", "a", "x"), (6, f"  {LONG}\nother", "b", "x"), (7, LONG + "\r", "b", "x"), (8, "word " * 30_000, "c", "x"),
    (9, "The Quick brown fox jumps over the lazy dog again and again", "c", "z"), (10, "the quick Brown fox jumps over the lazy dog again and again", "c", "z"),
    (11, "é 中文 \U0001f600 naïve <|endoftext|> ΑΣ", None, None), (12, LONG, "a", "x"),
]
SCHEMA = "doc_id long, text string, source string, score string"  # score: a name that operators use themselves


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def strip_key(line):
    key = line.strip("\x20\x09\x0a\x0b\x0c\x0d")
    return re.sub("[A-Z]", lambda m: m[0].lower(), key)


def brute_lines(rows, min_docs=3):
    docs = {}
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(k := strip_key(line)) >= 20:
                docs.setdefault(k, set()).add(d)
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(k := strip_key(x)) < 20 or len(docs[k]) < min_docs or max(docs[k]) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("bound", [32 << 20, 0])
def test_line_dedup_equals_brute_force(spark, sf_dir, odd, bound):
    got = line_dedup.dedup_lines(odd, broadcast_bytes=bound)
    assert got.columns == [*odd.columns, "n_lines", "n_dropped"]
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == brute_lines(ODD)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = brute_lines(rows)
    assert sum(r[2] for r in want) > 0
    got = line_dedup.dedup_lines(docs, broadcast_bytes=bound)
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == want


def test_line_dedup_empty_and_null_ids(spark, empty):
    assert line_dedup.dedup_lines(empty).count() == 0
    rows = [(None, LONG, "a", "x"), (1, LONG, "a", "x"), (2, LONG, "a", "x"), (3, LONG, "a", "x")]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {None: 1, 1: 1, 2: 1, 3: 0}


def test_perfect_hash_is_minimal():
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64))
    index = line_dedup.PerfectHash.build(keys)
    assert sorted(index.place(keys).tolist()) == list(range(len(keys)))


def brute_fingerprint(text, n=3):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    if not runs:
        return 0
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark, sf_dir, odd):
    for frame in (odd.dropDuplicates(["doc_id"]), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = {r["doc_id"]: r["text"] for r in frame.select("doc_id", "text").collect()}
        fps = {d: brute_fingerprint(t) for d, t in rows.items()}
        got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(frame).collect()}
        want = brute_components(fps, 2)
        assert got == {d: (fps[d], want[d]) for d in rows}


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_pigeonring_loses_no_link(spark, distance):
    import random

    rnd = random.Random(distance)
    fps = set()
    for _ in range(60):
        x = rnd.getrandbits(64)
        fps.add(x)
        for _ in range(4):
            y = x
            for b in rnd.sample(range(64), rnd.randint(1, distance + 1)):
                y ^= 1 << b
            fps.add(y)
            x = y if rnd.random() < 0.5 else x
    fps = dict(enumerate(sorted(fps)))
    signed = [(v - (1 << 64) if v >> 63 else v, k) for k, v in fps.items()]
    classes = spark.createDataFrame(signed, "fp long, id long")
    from fleetlake.llm.common import connected_components

    for chunk in (4096, 4):  # the second splits keys into pairs of chunks
        found = {r["node"]: r["component"] for r in connected_components(simhash.fingerprint_links(classes, distance, chunk)).collect()}
        assert {k: found.get(k, k) for k in fps} == brute_components(fps, distance)


def test_simhash_stage_and_empty(odd, empty):
    assert simhash.near_duplicates(empty).count() == 0
    kept = [r["doc_id"] for r in simhash.keep_one(odd).collect()]
    assert sorted(kept) == [1, 4, 5, 6, 8, 9, 11]  # 2, 3: no words like 1; 7 shares 4 of 5 shingles with 6; 10 like 9; 12 like 7


def test_bpe_equals_the_library(spark, sf_dir, odd, empty):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.default_path())
    assert bpe.encode(empty, bpe.default_path()).count() == 0
    for frame in (odd, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        want = []
        for r in frame.select("doc_id", "text").collect():
            ids = own.encode(r["text"] or "", add_special_tokens=False).ids
            data = b"".join(i.to_bytes(4, "little") for i in ids)
            want.append((r["doc_id"], len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert sorted(map(tuple, bpe.digest(bpe.encode(frame, bpe.default_path())).collect())) == sorted(want)


def test_bpe_words_of_few_letters():
    import random

    from tokenizers import Tokenizer

    own, lib, rnd = bpe.WordBPE(bpe.default_path()), Tokenizer.from_file(bpe.default_path()), random.Random(3)
    texts = ["".join(rnd.choice("aaabehinorstu ") for _ in range(rnd.randint(1, 60))) for _ in range(2000)] + ["ab" * 2000]
    for text, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text).tolist() == e.ids


def test_min_cost_flow_moves_the_fewest_bytes():
    for old, n in (([100, 0, 50, 7], 3), ([9, 9, 9], 6), ([1000, 1, 1, 1], 4), ([0, 0], 2), ([5], 3)):
        flow = sharding.transfers(old, n)
        total = sum(old)
        capacity = [total * (j + 1) // n - total * j // n for j in range(n)]
        assert [sum(r) for r in flow] == old
        assert all(sum(r[j] for r in flow) == capacity[j] for j in range(n))
        moved = sum(x for i, r in enumerate(flow) for j, x in enumerate(r) if i != j)
        assert moved == total - sum(min(o, capacity[i]) for i, o in enumerate(old) if i < n)
    flow = sharding.min_cost_flow([2, 2], [2, 2], [[1.0, 2.0], [1.0, 5.0]])
    assert flow == [[0, 2], [2, 0]]  # the first source gives way


def test_reshard_writes_every_row_once(spark, sf_dir, odd, empty, tmp_path):
    layout = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3))
    for k, frame in enumerate((odd, spark.read.parquet(f"{sf_dir}/documents.parquet"))):
        out, flow = sharding.reshard(frame, layout, 3, 5, str(tmp_path / f"t{k}"))
        rows = out.select(*frame.columns).collect()
        assert sorted(map(str, rows)) == sorted(map(str, frame.collect()))
        by = {}
        for r in out.select("shard", "slot", sharding.size_of(F.col("text")).alias("size")).collect():
            by.setdefault(r["shard"], []).append((r["slot"], r["size"]))
        assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in by.values())
        sizes = [sum(s for _, s in v) for v in by.values()]
        biggest = max(s for v in by.values() for _, s in v)
        assert max(sizes) - sum(sizes) / 5 <= 3 * biggest
    assert sharding.reshard(empty, layout, 3, 5, str(tmp_path / "none"))[0].count() == 0


def test_reshard_leaves_other_shards_alone(spark, tmp_path):
    docs = spark.createDataFrame([(k, "x" * 92) for k in range(30)], "doc_id long, text string")
    layout = F.when(F.col("doc_id") < 10, 0).when(F.col("doc_id") < 20, 1).otherwise(2)
    out, flow = sharding.reshard(docs, layout, 3, 3, str(tmp_path / "same"), everything=False)
    assert flow == [[1000, 0, 0], [0, 1000, 0], [0, 0, 1000]] and out.count() == 0
    layout = F.when(F.col("doc_id") < 10, 0).when(F.col("doc_id") < 24, 1).otherwise(2)
    out, _ = sharding.reshard(docs, layout, 3, 3, str(tmp_path / "some"), everything=False)
    assert sorted(r["shard"] for r in out.select("shard").distinct().collect()) == [1, 2]


def test_mixing_targets_and_bounds(spark, sf_dir, odd, empty):
    assert mixing.copies(mixing.sized(empty)).count() == 0
    for frame in (odd, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = mixing.copies(mixing.sized(frame)).collect()
        assert len(rows) == frame.count()
        total = sum(r["size"] for r in rows)
        target = {r["source"]: r["target"] for r in rows}
        size = {r["source"]: r["source_size"] for r in rows}
        assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * max(1, total)
        assert all(0 <= r["copies"] <= 2 for r in rows)
        weight = dict(zip(sorted(size, key=lambda s: (s is None, s)), (3, 1, 2) * len(size)))
        open_ = {s: target[s] / weight[s] for s in size if target[s] < 2 * size[s] - 1e-9}
        assert max(open_.values(), default=0) - min(open_.values(), default=0) < 1e-6 * max(1, total)
        assert all(target[s] <= 2 * size[s] + 1e-9 for s in size)
        level = max(open_.values(), default=0)
        assert all(weight[s] * level >= 2 * size[s] - 1e-6 for s in size if s not in open_)
        for s in size:
            own = [r for r in rows if r["source"] == s]
            taken = sum(r["copies"] * r["size"] for r in own)
            assert abs(taken - target[s]) <= max((r["size"] for r in own), default=0)


def test_mix_repeats_rows(odd):
    plan = {}
    for r in mixing.copies(mixing.sized(odd)).collect():
        plan[r["doc_id"]] = max(plan.get(r["doc_id"], 0), r["copies"])
    got = mixing.mix(odd)
    assert got.columns == odd.columns
    count = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert count == {d: n * (2 if d == 4 else 1) for d, n in plan.items() if n}


INSULTS = ("idiot", "moron", "zwork")


def labelled(spark, n=600):
    import random

    rnd = random.Random(7)
    plain = [a + b for a in ("an", "the", "on", "re", "lo") for b in ("sa", "ti", "mo", "be", "ran")]
    docs, labels = [], []
    for k in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 80))]
        toxic = rnd.random() < 0.25
        group = rnd.choice(["muslim", "christian", "jewish"]) if rnd.random() < (0.6 if toxic else 0.1) else None
        if group:  # mentions of one group lean toxic in the labels: the bias to be undone
            words.insert(0, "muslim" if toxic else group)
        if toxic:
            words.insert(rnd.randrange(len(words)), rnd.choice(INSULTS))
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_and_swaps(spark, odd, empty):
    docs, labels = labelled(spark)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.predict(docs, labels).select("doc_id", "predicted", toxicity.held_out().alias("h")).collect()
    held = [r for r in rows if r["h"]]
    assert {r["doc_id"] for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    gap = {}
    for penalty in (0.0, 20.0):
        model = toxicity.train(docs, labels, penalty=penalty)
        s = [model.logit(f"{g} ansa reti loran") for g in ("muslim", "christian", "jewish")]
        gap[penalty] = max(s) - min(s)
        assert model.score("you idiot ansa reti") > 0.5
    assert gap[20.0] < 0.3 * gap[0.0]
    assert toxicity.score(empty.drop("score"), model).count() == 0
    scored = toxicity.score(odd.drop("score"), model).collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)


def test_toxicity_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd, none)
    assert model.score("x") < 1e-6 and model.score(None) < 1e-6


def test_toxicity_held_out_on_tables(spark, sf_dir):
    # Some labels of junk texts follow from words that were overwritten: no text score reaches all.
    path = sf_dir.replace("0.001", "0.1")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = [r for r in toxicity.query(spark, path).collect() if r["held_out"] and r["doc_id"] in labels]
    hit = sum(r["predicted"] and labels[r["doc_id"]] for r in rows)
    assert hit / sum(labels[r["doc_id"]] for r in rows) > 0.9
    assert hit / sum(r["predicted"] for r in rows) > 0.9


def test_license_scan_equals_brute_force(spark, sf_dir, odd, empty):
    assert license_scan.scan(empty).count() == 0 and license_scan.scan(odd).count() == 0

    def brute(text):
        words, found = license_scan.tokens(text), {}
        runs = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
        for name, template in license_scan.TEMPLATES:
            t = license_scan.tokens(template)
            own = {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))}
            if len(own & runs) / len(own) >= 0.8:
                found[name] = max(found.get(name, 0), len(own & runs) / len(own))
        return found

    path = sf_dir.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    more = [(10_000 + k, "start of text " * k + t + " and its end", None, None) for k, (_, t) in enumerate(license_scan.TEMPLATES)]
    more.append((20_000, license_scan.TEMPLATES[2][1].replace("charge", "cost"), None, None))
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, SCHEMA).select("doc_id", "text"))
    got = {}
    for r in license_scan.scan(frame).collect():
        assert 0 <= r["first_word"] <= r["last_word"]
        got.setdefault(r["doc_id"], {})[r["license"]] = r["containment"]
    want = {r["doc_id"]: w for r in frame.collect() if (w := brute(r["text"]))}
    assert len(want) > 30 and got == want


def test_quality_shrinks_sparse_sites(spark, sf_dir, odd, empty):
    path = sf_dir.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in quality.query(spark, path).collect() if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in rows) / len(rows) > 0.9
    assert quality.classify(empty, labels, F.col("source"), F.col("score")).count() == 0
    assert quality.classify(odd, labels, F.col("source"), F.col("score")).count() == len(ODD)
    # One bad page on a new host moves its rate less than fifty on an old one.
    own = [(k, "a good text, with words.", "old", "p") for k in range(50)] + [(50, "a good text, with words.", "new", "p")] + [(k, "a good text, with words.", f"h{k % 7}", "p") for k in range(51, 400)]
    known = spark.createDataFrame([(k, 0 if k <= 50 else 1) for k in range(400)], "doc_id long, quality int")
    site = {r["host"]: r["site_rate"] for r in quality.classify(spark.createDataFrame(own, SCHEMA), known, F.col("source"), F.col("score")).collect()}
    assert site["old"] < site["new"] < site["h1"]
