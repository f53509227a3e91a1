"""Bounds of samples, gradients, posteriors, inclusion frequencies, groups of equal texts, clashing column names."""

import glob
import os
import zlib
from collections import Counter, defaultdict
from math import exp, fsum, log

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import LONG, ODD, SCHEMA

import corpus_pipeline
from fleetlake.llm import line_dedup, linear, mixing, quality, sharding, simhash, toxicity
from fleetlake.llm.common import labelled_sample


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    rows = [(sorted(rng.choice(12, 5, replace=False).tolist()), rng.standard_normal(5).tolist()) for _ in range(30)]
    x, pairs = linear.Sparse(rows, 12), linear.Sparse(rows[:7], 12)
    y, weight, w, b = rng.integers(0, 2, 30).astype(float), rng.random(30), rng.standard_normal(12), 0.3

    def value(w, b):
        return linear.objective(x, y, weight, pairs, 3.0, 0.01, w, b)[0]

    _, grad, grad_b = linear.objective(x, y, weight, pairs, 3.0, 0.01, w, b)
    step = 1e-6
    for k in range(12):
        e = step * np.eye(12)[k]
        assert abs((value(w + e, b) - value(w - e, b)) / (2 * step) - grad[k]) < 1e-5
    assert abs((value(w, b + step) - value(w, b - step)) / (2 * step) - grad_b) < 1e-5
    best, at = linear.fit(x, y, weight, pairs, 3.0, 0.01)
    scaled = weight / weight.sum()
    least = linear.objective(x, y, scaled, pairs, 3.0, 0.01, best, at)[0]
    assert all(least <= linear.objective(x, y, scaled, pairs, 3.0, 0.01, best + 0.05 * rng.standard_normal(12), at)[0] for _ in range(50))


def test_sample_holds_its_bound(spark):
    rows = [(k % 83, f"text {k}") for k in range(3000)] + [(1, "text 1")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(k, k % 2) for k in range(83)], "doc_id long, y int")
    for bound in (50, 200, 10_000):
        got, again = (sorted(map(tuple, labelled_sample(docs, known, bound).collect())) for _ in range(2))
        assert got == again and len(got) == len({t for t, *_ in got}) and len(got) == min(bound, 3000)
        assert all(w == 1 + 40 * (t == "text 1") and y == int(t.split()[1]) % 83 % 2 for t, y, w in got)


def test_toxicity_query_equals_brute_force(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    weight = dict(zip(model.vocabulary, model.weights))
    want = []
    for r in docs.select("doc_id", "text").collect():
        found = {f for w in set(toxicity.words(r["text"])) for f in [w, *("^" + w[:k] for k in range(3, 7) if len(w) >= k)]}
        s = 1 / (1 + exp(-(model.bias + fsum(weight[f] for f in found if f in weight))))
        want.append((r["doc_id"], zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0, round(s, 12), int(s >= 0.5)))
    assert sorted((r["doc_id"], r["held_out"], round(r["score"], 12), r["predicted"]) for r in toxicity.query(spark, sf_dir).collect()) == sorted(want)


def test_swaps_act_on_the_tables(spark, sf_dir):
    path = sf_dir.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    spread = {}
    for penalty in (0.0, toxicity.PENALTY):
        model = toxicity.train(docs, labels, penalty=penalty)
        spread[penalty] = max(max(s) - min(s) for s in ([model.logit(t) for t in f] for f in toxicity.IDENTITY))
    assert spread[0.0] > 0.3 and spread[toxicity.PENALTY] < 0.03


def test_quality_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.col("source").alias("a"), F.col("lang").alias("b"))
    docs = docs.unionByName(spark.createDataFrame([(r[0], r[1], r[2], r[3]) for r in ODD] + [(None, LONG, None, None), (3, "again", "x", "y"), (3, "again", "x", "y")], "doc_id long, text string, a string, b string"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").unionByName(spark.createDataFrame([(3, 0), (3, 1), (5, None)], "doc_id long, quality int"))
    rows = quality.classify(docs, labels, F.col("a"), F.col("b")).collect()
    known = {}
    for r in labels.collect():
        if r["quality"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            known[r["doc_id"]] = max(known.get(r["doc_id"], 0), r["quality"])
    sample = [known[r["doc_id"]] for r in {(r["doc_id"], r["text"]): r for r in docs.collect() if r["doc_id"] in known}.values()]
    times = Counter((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in known)
    prior = sum(known[d] * n for (d, _), n in times.items()) / sum(times.values())
    assert len(sample) > 20
    odds = log(prior / (1 - prior))
    good = [float(known[r["doc_id"]]) if r["doc_id"] in known else 1 / (1 + exp(-(r["evidence"] + odds))) for r in rows]
    hosts, paths = defaultdict(list), defaultdict(list)
    for r, g in zip(rows, good):
        hosts[r["host"]].append(g)
        paths[r["host"], r["path"]].append(g)
    rate = fsum(good) / len(good)

    def strength(groups):
        big = [(len(g), fsum(g) / len(g), up) for g, up in groups if len(g) >= 2]
        spread, noise, most = fsum(n * (x - up) ** 2 for n, x, up in big), fsum(up * (1 - up) for _, _, up in big), fsum(n * up * (1 - up) for n, _, up in big)
        return min(1e4, max(1.0, 1 / max(1e-4, (spread - noise) / max(1e-12, most - noise)) - 1))

    k_host = strength([(g, rate) for g in hosts.values()])
    up = {h: (fsum(g) + k_host * rate) / (len(g) + k_host) for h, g in hosts.items()}
    k_path = strength([(g, up[h]) for (h, _), g in paths.items()])
    for r, g in zip(rows, good):
        own, site = hosts[r["host"]], paths[r["host"], r["path"]]
        host_rate = (fsum(own) - g + k_host * rate) / (len(own) - 1 + k_host)
        site_rate = (fsum(site) - g + k_path * host_rate) / (len(site) - 1 + k_path)
        assert abs(r["site_rate"] - site_rate) < 1e-9
        safe = min(1 - 1e-6, max(1e-6, site_rate))
        assert abs(r["score"] - 1 / (1 + exp(-(log(safe / (1 - safe)) + r["evidence"])))) < 1e-9 and r["predicted"] == (r["score"] >= 0.5)


def test_inclusion_follows_the_weights(spark):
    sizes = [1, 1, 4, 4, 9, 9, 16, 25, 36, 49, 64, 81, 100, 100, 144, 400]
    rows = [(s * 100 + k, f"s{s:03}", n) for s in range(300) for k, n in enumerate(sizes)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long")
    seen, p = Counter(), {}
    for seed in ("", "other"):
        for r in mixing.copies(frame, weights=(1,), share=0.4, seed=seed).collect():
            assert 0 <= r["copies"] <= 1
            seen[r["doc_id"] % 100] += r["copies"]
            p[r["doc_id"] % 100] = r["p"]
    assert abs(sum(p[k] * n for k, n in enumerate(sizes)) - 0.4 * sum(sizes)) < 1e-6  # calibrated to the target
    assert len({round(x, 6) for x in p.values()}) > 8
    for k in p:  # a fixed size makes the frequencies differ a little from p
        assert abs(seen[k] / 600 - p[k]) < 0.09, (k, seen[k] / 600, p[k])


def test_certain_copies_of_large_documents(spark):
    rows = [(k, "a", 1) for k in range(300)] + [(1000, "a", 10_000), (1001, "a", 9_000)]
    got = {r["doc_id"]: (r["p"], r["copies"]) for r in mixing.copies(spark.createDataFrame(rows, "doc_id long, source string, size long"), weights=(1,), share=0.99).collect()}
    assert got[1000] == got[1001] == (1.0, 1)
    assert sum(got[k][1] for k in range(300)) in (106, 107, 108)  # 0.99 * 19,300 - 19,000 = 107 of the 300 words


def test_equal_texts_stay_together(spark, tmp_path):
    rows = [(k, f"text {k // 4} " + "x" * (k // 4 % 50)) for k in range(4000)] + [(10_000 + k, "the same in a third of all rows") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out, _ = sharding.rewrite(docs, sharding.old_layout(4), 4, 6, str(tmp_path / "a"))
    got = out.collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(rows)
    at, sizes, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in got:
        at[r["text"]].add(r["shard"])
        sizes[r["shard"]] += len(r["text"]) + 8
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for t, s in at.items() if not t.startswith("the same")) and len(at["the same in a third of all rows"]) > 1
    assert max(sizes.values()) < 1.05 * min(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(Counter(os.path.dirname(f) for f in glob.glob(f"{tmp_path}/a/*/*.parquet")).values()) <= sharding.LEAST_FILES


def test_rewrite_leaves_other_shards_where_they_are(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"{k:04}" + "x" * 88) for k in range(30)], "doc_id long, text string")
    layout = F.when(F.col("doc_id") < 10, 0).when(F.col("doc_id") < 24, 1).otherwise(2)
    out, _ = sharding.rewrite(docs, layout, 3, 3, str(tmp_path / "b"))
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(30)) and Counter(r["shard"] for r in rows) == {0: 10, 1: 10, 2: 10}
    assert sorted(os.listdir(tmp_path / "b"))[-2:] == ["shard=1", "shard=2"] and not os.path.exists(tmp_path / "b" / "shard=0")


def test_rows_without_ids_link_others(spark):
    fps = {1: 0b0, None: 0b11, 5: 0b1111, 9: 0b111111111111}
    rows = [(d, v) for d, v in fps.items()]
    classes = spark.createDataFrame([(v, v) for _, v in rows], "fp long, id long")
    from fleetlake.llm.common import connected_components

    found = {r["node"]: r["component"] for r in connected_components(simhash.fingerprint_links(classes)).collect()}
    assert found == {0b0: 0, 0b11: 0, 0b1111: 0}
    words = [f"w{k}" for k in range(40)]
    texts = [(None, " ".join(words)), (7, " ".join(words)), (None, "alone here and there")]
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, 7), (7, 7), (None, None)], key=str)


@pytest.mark.parametrize("bound", [32 << 20, 0])
def test_line_dedup_of_null_and_repeated_ids(spark, bound):
    other = "another line that many documents hold"
    rows = [(None, f"{LONG}\nown {k}") for k in range(5)] + [(2**60 + 1, f"{LONG}\n{other}")] * 3 + [(2**60 + 3, f"{other}\n{LONG}"), (4, other), (5, LONG)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_bytes=bound).collect()
    want = [(None, f"own {k}") for k in range(5)] + [(2**60 + 1, "")] * 3 + [(2**60 + 3, f"{other}\n{LONG}"), (4, ""), (5, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)


CLASH = ("score", "predicted", "n_lines", "n_dropped", "_id", "_copies", "_k", "_s", "shard", "slot", "old_shard", "block", "h", "size", "file", "_own", "_th", "_gone", "p", "component_id", "fp", "id")


def test_stages_take_clashing_names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASH})
    plain, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), docs
    for name, stage in corpus_pipeline.STAGES:
        out, plain = stage(spark, out, sf_dir), stage(spark, plain, sf_dir)
        assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted(r["doc_id"] for r in plain.select("doc_id").collect())
        if name != "BPE encoding":
            assert out.columns == docs.columns
            assert out.where(" OR ".join(f"`{c}` <> concat('{c}', doc_id)" for c in CLASH)).isEmpty()


def test_operators_replace_columns_of_their_names(spark, sf_dir, tmp_path):
    odd = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("own") for c in CLASH})
    model = toxicity.Model(["one"], [1.0], 0.0)
    assert dict(toxicity.score(odd, model).dtypes)["score"] == "double"
    assert dict(line_dedup.dedup_lines(odd).dtypes)["n_lines"] == "bigint"
    out, _ = sharding.reshard(odd, F.lit(0), 1, 2, str(tmp_path / "c"))
    assert dict(out.dtypes)["slot"] == "bigint" and out.count() == len(ODD) and out.where("block = 'own'").count() == len(ODD)
    assert mixing.mix(odd).columns == odd.columns
    assert quality.classify(odd, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("source"), F.col("size")).count() == len(ODD)


def test_edited_license_bodies_are_found(spark):
    import random

    from fleetlake.llm import license_scan as ls

    rnd, rows, want = random.Random(3), [], {}
    bodies = [(n, t) for n, t in ls.TEMPLATES if len(t.split()) > 60]
    for k in range(200):
        name, text = bodies[k % len(bodies)]
        words = text.split()
        for _ in range(len(words) // 60):
            words[rnd.randrange(len(words))] = f"edit{rnd.randrange(99)}"
        rows.append((k, " ".join(["some", "prose"] * rnd.randrange(60) + words + ["more", "of", "it"] * rnd.randrange(40))))
        want[k] = name
    got = ls.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r["doc_id"], r["license"]) for r in got if r["part_of"] is None}
    assert sum((k, n) in found for k, n in want.items()) > 190
    # One body within another is marked; a body of two clauses is not taken for one of three.
    two, three = (next(t for n, t in ls.TEMPLATES if n == f"BSD-{c}-Clause" and len(t) > 200) for c in (2, 3))
    rows = ls.scan(spark.createDataFrame([(2, two), (3, three)], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["license"]) for r in rows if r["part_of"] is None} == {(2, "BSD-2-Clause"), (3, "BSD-3-Clause")}


@pytest.mark.parametrize("n", [1, 63, 64, 65, 70, 1000, 10_000])
def test_shapes_read_whole_tokens(n):
    assert quality.shape("b" * n) == "a" and quality.shape("b" * n + "!!!") == "a!!" and quality.shape("b" * n + "9" * n + "C") == "a0A"
    made = quality.Features()
    assert made.of("x " + "b" * n + "!!!") != made.of("x " + "b" * n) and made.token("b" * n) == made.token("b" * n)


def test_placement_equals_brute_force_and_moves_alone_are_written(spark, tmp_path):
    n_old, n_new, seed = 4, 6, 9
    rnd = np.random.default_rng(seed)
    texts = ["w" * int(n) for n in rnd.integers(0, 400, 3000)] + ["copy " * 9] * 400 + ["twin"] * 300
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    layout = F.pmod(F.xxhash64("text", F.lit(9)), F.lit(n_old)).cast("int")
    plan = sharding.Plan(docs, layout, n_old, n_new)
    # By hand: groups into blocks, blocks in line, the flow's intervals, each old shard's own first.
    rows = docs.select(layout.alias("old"), sharding.group_of(F.col("text")).alias("h"), "doc_id", sharding.size_of(F.col("text")).alias("size"), F.xxhash64("doc_id", F.lit(5)).alias("k")).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r["old"], r["h"]].append(r)
    sizes = [sum(r["size"] for r in rows if r["old"] == i) for i in range(n_old)]
    flow = sharding.transfers(sizes, n_new)
    assert plan.flow == flow
    limit, blocks = max(1, sum(sizes) // (n_new * sharding.SPLIT)), defaultdict(lambda: [0, 0])
    for (old, h), own in groups.items():
        large = sum(r["size"] for r in own) > limit and len(own) > 1
        for r in own:
            block = blocks[old, (r["k"] if large else h) % plan.n_blocks]
            block[0] += r["size"]
            block[1] += 1
    want, moved, start = {}, 0, Counter()
    for old in range(n_old):
        at = 0
        for (o, b), (size, n) in sorted(blocks.items()):
            if o != old:
                continue
            middle, end = at + size / 2, 0
            at += size
            for j in [old, *(j for j in range(n_new) if j != old)]:
                end += flow[old][j]
                if flow[old][j] and (middle <= end or end == sizes[old]):
                    want[old, b] = (j, n)
                    break
            moved += size if want[old, b][0] != old else 0
    assert {(r["old"], r["block"]): (r["shard"], r["n"]) for r in plan.blocks.collect()} == want
    out, _ = sharding.relocate(docs, layout, n_old, n_new, str(tmp_path / "moved"))
    held = spark.read.parquet(str(tmp_path / "moved"))
    assert held.agg(F.sum(sharding.size_of(F.col("text")))).first()[0] == moved < 0.6 * sum(sizes)
    assert held.where("shard = old_shard").count() == 0
    got = out.collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(enumerate(texts))
    for r in got:
        start[r["shard"]] += 1
    for shard, n in start.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))


def test_affected_files_are_rewritten_and_the_others_stay(spark, tmp_path):
    n_old, n_new = 4, 6
    rnd = np.random.default_rng(9)
    texts = ["w" * int(n) for n in rnd.integers(0, 400, 3000)] + ["copy " * 9] * 400 + ["twin"] * 300 + [None]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    old = sharding.lay_out(docs, F.pmod(F.xxhash64("text", F.lit(9)), F.lit(n_old)), n_old, str(tmp_path / "old"), n_new)
    files = {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_path}/old/*/*.parquet")}
    was = {r["doc_id"]: (r["old_shard"], r["f"]) for r in old.select("doc_id", "old_shard", F.col("_metadata.file_path").alias("f")).collect()}
    assert len(was) == len(texts) and len(files) == n_old * sharding.OLD_FILES
    out, flow = sharding.rewrite_files(old, n_old, n_new, str(tmp_path / "new"))
    got = out.collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in got) == sorted((k, t or "") for k, t in enumerate(texts))
    size = lambda r: len(r["text"] or "") + 8
    # Written is each file that loses a row, whole, and no other one.
    affected = {was[r["doc_id"]][1] for r in got if r["shard"] != r["old_shard"]}
    written = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "new")).collect()}
    assert written == {k for k, (_, f) in was.items() if f in affected} and 0 < len(affected) < len(files)
    assert {r["doc_id"]: r["old_shard"] for r in got} == {k: o for k, (o, _) in was.items()}
    moved, total = sum(size(r) for r in got if r["shard"] != r["old_shard"]), sum(map(size, got))
    assert abs(moved - sum(flow[i][j] for i in range(n_old) for j in range(n_new) if i != j)) < 0.02 * total
    assert sum(size(r) for r in got if r["doc_id"] in written) < moved + 1.5 * total / sharding.OLD_FILES
    assert files == {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_path}/old/*/*.parquet")}
    sizes = Counter()
    for shard in range(n_new):
        own = [r for r in got if r["shard"] == shard]
        sizes[shard] = sum(map(size, own))
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert max(sizes.values()) < 1.05 * min(sizes.values())
    empty = sharding.lay_out(docs.where("false"), F.lit(0), n_old, str(tmp_path / "none"))
    assert sharding.rewrite_files(empty, n_old, n_new, str(tmp_path / "still none"))[0].count() == 0
