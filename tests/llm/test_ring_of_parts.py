"""The pigeonring over parts of the shingles, which finds the candidates of the pipeline's near-duplicate stage."""

import numpy as np
import pytest

from fleetlake.llm import simhash


def meet(a, b, least=0.8):
    """Whether two sets share a key under which their tails pass the budgets."""
    (ka, ta), (kb, tb) = (simhash.ring_rows(np.sort(x), least) for x in (a, b))
    _, i, j = np.intersect1d(ka, kb, return_indices=True)
    tails = np.concatenate([ta[i], tb[j]])
    return bool(len(i)) and bool(simhash._tails_near(tails)(np.arange(len(i)), np.arange(len(i)) + len(i)).any())


def pair(rnd, common, x, y):
    """Two sets with ``common`` shingles in both, and x and y of their own."""
    h = rnd.integers(0, 1 << 63, common + x + y, np.uint64) << np.uint64(1) | np.uint64(1)
    return h[: common + x], np.concatenate([h[:common], h[common + x :]])


@pytest.mark.parametrize("least", [0.5, 0.8, 0.95])
def test_no_pair_of_enough_similarity_is_missed(least):
    rnd = np.random.default_rng(3)
    for n in [*range(1, 70), *rnd.integers(70, 900, 150).tolist(), 5000]:
        for _ in range(4):
            common = int(np.ceil(least * n - 1e-9))  # as few as the union of n allows
            x = int(rnd.integers(0, n - common + 1))
            assert meet(*pair(rnd, common, x, n - common - x), least), (n, common, x)


def test_budgets_of_longer_chains_part_what_shares_a_key():
    rnd, shared, passed = np.random.default_rng(4), 0, 0
    for _ in range(200):
        a, b = pair(rnd, 100, 200, 200)  # a similarity of 0.2
        (ka, _), (kb, _) = simhash.ring_rows(np.sort(a), 0.8), simhash.ring_rows(np.sort(b), 0.8)
        shared += bool(len(np.intersect1d(ka, kb)))
        passed += meet(a, b)
    assert shared > 150 and passed < shared / 2


def test_near_copies_without_a_common_anchor_are_linked(spark):
    """Four of five shingles in common, and none of the anchors that brought candidates together before."""
    found = []
    for k in range(30_000):
        words = [f"v{k}x{i}" for i in range(9)]
        a, b = " ".join(words), " ".join(words[:8])
        (fa, aa), (fb, ab) = simhash.text_sketch(a), simhash.text_sketch(b)
        if not (aa == ab).any() and np.bitwise_count(fa ^ fb).sum() <= simhash.CANDIDATE_DISTANCE:
            found.append((a, b))
            if len(found) == 3:
                break
    assert len(found) == 3
    rows = [(10 * i + j, t) for i, two in enumerate(found) for j, t in enumerate(two)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d // 10 * 10 for d, _ in rows}


def test_long_texts_and_crowded_keys(spark):
    """Keys of many texts are tied in the task that makes them, and no link across tasks is lost."""
    base = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join(base[:-1] + [f"x{k}"])) for k in range(120)]  # one group, equal but for a word
    rows += [(1000 + k, " ".join(f"y{k}z{i}" for i in range(80))) for k in range(60)]
    long = [f"long{i}" for i in range(40_000)]
    rows += [(5000, " ".join(long)), (5001, " ".join([*long[:-100], *(f"end{i}" for i in range(100))]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for chunk in (4096, 32, 1):
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame, chunk=chunk).collect()}
        assert got == {d: 0 if d < 1000 else 5000 if d == 5001 else d for d, _ in rows}
