"""The pipeline's near-copy stage against brute force over the shingle sets."""

import random
from collections import Counter

import numpy as np
import pytest
from test_pipeline import shingles
from test_text_operators import brute_lines

import corpus_pipeline
from fleetlake.llm import simhash, toxicity


def exact_groups(texts, least=0.8):
    """Least id reachable by pairs of similarity ``least`` or more."""
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
def edited():
    """Texts of 8 to 300 words with copies from very near to well below 0.8, edited in chains too."""
    rnd, texts = random.Random(11), {}
    for base in range(60):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice((8, 9, 20, 60, 300)))]
        texts[base * 10] = " ".join(words)
        for k in range(1, 6):
            for _ in range(max(1, len(words) // 60)):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(3000)}"
            texts[base * 10 + k] = " ".join(words)
        texts[base * 10 + 6] = " ".join(words) + " more"
    return texts


@pytest.mark.parametrize("held", [simhash.HELD, 500])
def test_links_are_those_of_the_shingle_sets(spark, edited, held):
    frame = spark.createDataFrame(list(edited.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame, held=held).collect()}
    want = exact_groups(edited)
    assert got == want
    assert 60 < len(set(want.values())) < len(want)


def test_stage_keeps_what_is_no_near_copy(spark, sf_dir):
    words = [f"w{k}" for k in range(100)]
    other = words[:30] + ["x", *words[31:60], "y", *words[61:]]  # 86 shingles of 106 remain: 0.81
    far = [*other[:20], "z", *other[21:]]  # 81 of 111 against the first: 0.73; 91 of 101 against the second
    lone = [*words[:20], "z", *words[21:40], "z", *words[41:80], "z", *words[81:]]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(far)), (4, " ".join(lone)), (5, "a b c d e f g h"), (6, "a b c d e f g h i")]
    texts = dict(rows)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()}
    assert kept == {d for d, c in exact_groups(texts).items() if c == d} == {1, 4, 5}


def test_repeated_ids_with_other_texts(spark):
    rows = [(7, "a b c d e f g h"), (7, "some words that stand nowhere else at all"), (9, "a b c d e f g h i"), (10, None), (11, " ")]
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(7, 7), (7, 7), (9, 7), (10, 10), (11, 10)]


def test_three_stages_equal_exact_brute_force(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    clean = [r for r in rows if model.score(r[1]) < 0.5]
    texts = {d: text for d, _, _, text in brute_lines(clean)}
    want = {d: c for d, c in exact_groups(texts).items() if d == c}
    out = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, out, sf_dir)
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == Counter(want.keys())
    assert len(want) < len(texts)


@pytest.mark.parametrize("chunk, held", [(4, 500), (4096, 3000), (3, simhash.HELD)])
def test_crowded_anchors_and_groups_lose_no_link(spark, chunk, held):
    rnd, texts = random.Random(4), {}
    base = [f"w{rnd.randrange(900)}" for _ in range(120)]
    for k in range(60):  # near copies of one text, some of them edited on in chains that leave it
        words = list(base)
        for _ in range(2):
            words[rnd.randrange(120)] = f"x{k}"
        texts[k] = " ".join(words)
    for k in range(60, 90):
        words = texts[rnd.randrange(k)].split()
        for _ in range(4):
            words[rnd.randrange(120)] = f"y{k}"
        texts[k] = " ".join(words)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame, chunk=chunk, held=held).collect()}
    want = exact_groups(texts)
    assert got == want and len(set(want.values())) > 1


def brute_keep(rows):
    """(doc_id, text) rows that stay: nodes are different (doc_id, text) pairs, of each component one with the least doc_id."""
    nodes = sorted({r for r in rows if r[0] is not None}, key=str)
    groups = exact_groups({k: text for k, (_, text) in enumerate(nodes)})
    parts = {}
    for k, (d, text) in enumerate(nodes):
        parts.setdefault(groups[k], []).append((d, text))
    return [{r for r in part if r[0] == min(d for d, _ in part)} for part in parts.values()]


@pytest.mark.parametrize("held", [simhash.HELD, 300])
def test_repeated_ids_lose_no_text(spark, edited, held):
    near, other = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(40))
    rows = [(3, near), (5, near + " end"), (5, other), (5, other.upper()), (5, other), (None, other), (None, other), (6, None), (6, "")]
    rnd = random.Random(3)
    rows += [(100 + rnd.randrange(40), t) for t in edited.values()]  # ids that stand over texts of different groups
    given = rows if held == simhash.HELD else rows[::-1]
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(spark.createDataFrame(given, "doc_id long, text string"), held=held).collect()]
    assert kept.count((None, other)) == 2
    left, want = [k for k in kept if k[0] is not None], brute_keep(rows)
    assert len(left) == len(want) and all(sum(k in part for k in left) == 1 for part in want)
    assert (3, near) in left and any(k[0] == 5 and k[1].lower() == other for k in left)


def test_frequent_passages_cost_no_pairs(spark):
    rnd = random.Random(8)
    shared = [f"s{k}" for k in range(140)]
    texts = {k: " ".join(shared + [f"u{k}x{j}" for j in range(30)]) for k in range(300)}  # similarity 0.69
    for k in range(300, 330):  # near copies of some of them
        words = texts[rnd.randrange(300)].split()
        words[rnd.randrange(170)] = f"z{k}"
        texts[k] = " ".join(words)
    sets = {d: np.sort(simhash.shingle_set(t)) for d, t in texts.items()}
    rows = spark.createDataFrame([(0, d, len(s), bytearray(s.tobytes())) for d, s in sets.items()], "component long, id long, n long, own binary")
    parts = {r["id"]: r["part"] for r in simhash._refined(rows, 0.8).collect()}
    want = exact_groups(texts)
    size = Counter(want.values())
    assert all(parts[d] == parts[c] for d, c in want.items() if size[c] > 1)  # no link is parted
    compared = sum(n * (n - 1) // 2 for n in Counter(parts.values()).values())
    assert compared < 200  # of 54,285 pairs of the group
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), held=2000).collect()}
    assert got == want


def test_prefixes_part_no_pair_of_just_enough(spark):
    # Sets of 4 to 40 shingles at exactly or just below 0.8.
    rnd, rows, sets = random.Random(2), [], {}
    for k in range(150):
        n = rnd.choice((4, 5, 9, 10, 20, 40))
        base = rnd.sample(range(1, 400), n)
        for j in range(3):
            own = set(base)
            for _ in range(rnd.choice((0, 1, n // 10, n // 9))):
                own.remove(rnd.choice(sorted(own)))
                own.add(rnd.randrange(1, 400)) if rnd.random() < 0.5 else None
            sets[k * 3 + j] = own
            rows.append((k % 2, k * 3 + j, len(own), bytearray(np.array(sorted(own), np.uint64).tobytes())))
    parts = {r["id"]: r["part"] for r in simhash._refined(spark.createDataFrame(rows, "component long, id long, n long, own binary"), 0.8).collect()}
    pairs = [(a, b) for a in sets for b in sets if a < b and a // 3 % 2 == b // 3 % 2 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) > 100 and all(parts[a] == parts[b] for a, b in pairs)
