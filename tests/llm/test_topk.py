import numpy as np

from strideflow.llm.topk import top_k


TOP = 2**63 - 2


def brute(rows, k=5, every=50):
    held = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in held:
        if q % every == 0:
            found = sorted((-max(-TOP, min(TOP, sum(x * y for x, y in zip(a, b)))), i) for i, b in held if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows):
    return sorted(tuple(r) for r in top_k(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string").repartition(4)).collect())


def test_random_and_ties(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(size=8).tolist()) for i in range(1500)]
    rows += [(2000 + i, [0.25] * 8) for i in range(600)]  # one vector many times
    rows += [(3001, None), (3002, []), (3003, [None] * 8), (3004, [float("nan")] * 8), (3005, [float("inf")] * 8), (None, [1.0] * 8), (3006, [0.0] * 8), (3007, [9.0])]
    assert run(spark, rows) == brute(rows)


def test_few_rows(spark):
    for rows in ([], [(50, [1.0])], [(50, [1.0]), (1, [2.0])], [(0, [-1.0, 2.0]), (50, [1.0, 1.0]), (3, [-5.0, -5.0])], [(1, [1.0])]):
        assert run(spark, rows) == brute(rows)


def test_large_finite_components(spark):
    """Vectors beyond the index's numbers are compared exactly, as queries and as candidates."""
    rng = np.random.default_rng(6)
    rows = [(int(i), rng.normal(size=6).tolist()) for i in range(400)]
    rows += [(500 + i, (rng.normal(size=6) * 10.0 ** rng.integers(4, 9)).tolist()) for i in range(60)]
    rows += [(600, [100000.0, 1.0]), (601, [1e30] * 6), (602, [-1e30] * 6), (650, [3e38, -3e38]), (651, [1e15, 1e15 + 2])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(50, [1.0, 2.0]), (1, [100000.0, 1.0]), (2, [3.0, 3.0])]) == [(50, 1, 1, 256 * 25600000 + 512 * 256), (50, 2, 2, 256 * 768 + 512 * 768)]
    assert run(spark, rows[-5:]) == brute(rows[-5:])


def test_clusters(spark):
    """Far clusters, most of which the bounds leave out."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 8)) * 40
    rows = [(int(i), (centres[i % 12] + rng.normal(size=8)).tolist()) for i in range(2400)]
    assert run(spark, rows) == brute(rows)
