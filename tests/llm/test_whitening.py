import numpy as np
import pytest

from strideflow.llm.queries import QUERIES
from strideflow.llm.whitening import characteristic_polynomial, null_space, polynomial_modulo, primes_below, quantised, root, roots_above, sums, whiten
from llm_cases import SMALL

KIND = "vec_id long, embedding array<float>, n long, deviation string, whitened string, y string, k long"


@pytest.fixture
def vectors(spark):
    def make(rows, parts=3):
        return spark.createDataFrame([(i, v, 1, "x", "x", "x", 0) for i, v in rows], KIND).repartition(parts)

    return make


def plain(rows):
    """Whitening by numpy, up to signs."""
    y = np.floor(64 * np.array(rows, float))
    centred = y - y.mean(0)
    values, u = np.linalg.eigh(centred.T @ centred / len(y))
    values, u = values[::-1], u[:, ::-1]
    return y, values, centred @ u / np.sqrt(np.maximum(values, 1e-300))


def test_query_against_numpy(spark, small):
    source = small("embeddings").orderBy("vec_id").toPandas()
    y, values, z = plain(source["embedding"].tolist())
    got = QUERIES["op13_whitening"](spark, SMALL).orderBy("vec_id", "component").toPandas()
    assert len(got) == 32 * len(y) and got["vec_id"].iloc[::32].tolist() == source["vec_id"].tolist()
    assert np.allclose(np.abs(got["whitened"].to_numpy().reshape(-1, 32)), np.abs(z[:, :32]), atol=1e-9)
    # a component has one sign for all rows
    turned = got["whitened"].to_numpy().reshape(-1, 32) * z[:, :32]
    assert all((column[np.abs(column) > 1e-9] > 0).all() or (column[np.abs(column) > 1e-9] < 0).all() for column in turned.T)
    assert np.allclose(got["explained"][:32], values[:32] / values.sum(), rtol=1e-12)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    far = ((len(y) * y - y.sum(0)) ** 2).sum(1).astype(np.int64)
    assert got["deviation"].iloc[::32].tolist() == far.tolist() and (got["n"] == len(y)).all()


def test_null_and_odd_vectors_are_left_out(vectors):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 1.0]), (None, [0.5]), (3, [3.0, 1.0])]
    odd = [(4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [-float("inf")])]
    got = whiten(vectors(rows + odd)).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3, None} and len(got) == 10 and {r["n"] for r in got} == {5}
    y, values, z = plain([[1, 0], [0, 2], [3, 1], [0.5, 0], [3, 1]])
    at = {r["component"]: abs(r["whitened"]) for r in got if r["vec_id"] is None}
    assert np.allclose([at[1], at[2]], np.abs(z[3]))


def test_equal_variances_and_variance_zero(vectors):
    # two directions of equal variance, one without any
    rows = [(i, [float(x), float(y), 7.0]) for i, (x, y) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])]
    got = whiten(vectors(rows)).collect()
    assert {r["component"] for r in got} == {1, 2} and got[0]["identity_error"] < 1e-12
    assert all(abs(r["explained"] - 0.5) < 1e-15 for r in got)
    z = np.zeros((4, 2))
    for r in got:
        z[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.allclose(z.T @ z / 4, np.eye(2))


def test_nothing_to_whiten(vectors):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, [])], [(1, None)]):
        assert whiten(vectors(rows)).collect() == []


def test_largest_floats(vectors):
    got = whiten(vectors([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 3.0])])).collect()
    assert len(got) == 6 and all(np.isfinite(r["whitened"]) for r in got) and got[0]["identity_error"] < 1e-6
    assert {r["deviation"] for r in got if r["vec_id"] == 1} == {9 * (1 << 120) + 1 * (64 * 3 - 6 * 64) ** 2}


def test_sums_are_exact(vectors):
    rows = [(i, [float(i), float(-i) * 3, 1e16]) for i in range(50)]
    table = quantised(vectors(rows))
    n, first, total = sums(table, 3)
    y = np.array([r["y"] for r in table.collect()], object)
    assert n == 50 and first == y.sum(0).tolist() and (total == y.T @ y).all()


def test_polynomial_roots_and_null_space(spark):
    draw = np.random.default_rng(5)
    for d in (1, 2, 3, 9):
        x = draw.integers(-9, 9, (d + 2, d))
        m = (x.T @ x).astype(object)
        c = characteristic_polynomial(spark, m)
        assert np.allclose(np.array(c, float), np.poly(m.astype(float))[::-1], rtol=1e-9, atol=1e-6) and c[-1] == 1
        values = np.linalg.eigvalsh(m.astype(float))[::-1]
        for k in range(1, roots_above(c, 0) + 1):
            value, bits, before, size = root(c, k, int(np.trace(m)))
            assert (before, size) == (k - 1, 1) and abs(value / 2**bits - values[k - 1]) <= 1e-9 * values[0]
            v = null_space(m.tolist(), value, bits, 1)[0]
            assert np.abs(m.astype(float) @ v - values[k - 1] * v).max() < 1e-9 * values[0]


def test_repeated_roots():
    # diag(5, 5, 5, 2, 0): (x - 5)^3 (x - 2) x
    c = [int(round(v)) for v in np.poly([5, 5, 5, 2, 0])[::-1]]
    assert [roots_above(c, t) for t in (-1, 0, 1, 2, 4, 5)] == [5, 4, 4, 3, 3, 0]
    assert [root(c, k, 17)[2:] for k in (1, 2, 3, 4)] == [(0, 3)] * 3 + [(3, 1)]
    basis = null_space(np.diag([5, 5, 5, 2, 0]).tolist(), *root(c, 1, 17)[:2], 3)
    assert np.allclose(basis @ basis.T, np.eye(3)) and np.allclose(basis[:, 3:], 0)


def test_hessenberg_needs_other_pivots():
    # zero below the diagonal at the first place, and whole columns of zeros
    for m in ([[1, 2, 3], [0, 4, 5], [6, 7, 8]], [[2, 0, 0], [0, 3, 0], [0, 0, 4]], [[0, 0, 1, 0], [0, 0, 0, 0], [1, 0, 0, 2], [0, 0, 2, 0]]):
        p = primes_below(1 << 31, 1)[0]
        want = [int(round(v)) % p for v in np.poly(np.array(m, float))[::-1]]
        assert polynomial_modulo(np.array(m, np.int64), p).tolist() == want
