import math

import numpy as np
import pytest


def plain(rows, most=16):
    """Covariance of the distinct integer vectors by numpy; {vec_id: (deviation, |whitened|)} and the shares."""
    good = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in good})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    a = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(a.T @ a / n)
    order = np.argsort(-values)[:most]
    order = [k for k in order if values[k] > 1e-9 * values.max()]
    out = [(i, sum((n * x[j] - sums[j]) ** 2 for j in range(d)),
            np.abs((np.array(x) - np.array(sums) / n) @ vectors[:, order] / np.sqrt(values[order]))) for i, x in good]
    return n, out, values[order] / values.sum()


def collected(frame):
    rows = {}
    for r in frame.collect():
        rows.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    return rows


def test_whitening(spark):
    from landtally.llm.whitening import whitened
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 24)) * np.linspace(0.2, 2, 24) + 0.3
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900 + k, x[k % 3].tolist()) for k in range(90)]
    bad = [(2000, None), (2001, [None] * 24), (2002, [float("nan")] + [0.0] * 23), (2003, [float("-inf")] * 24), (2004, []), (2005, [0.5]), (2006, [1e300] * 24)]
    table = spark.createDataFrame([(*r, "n", 3) for r in rows + bad], "vec_id long, embedding array<double>, n string, component int").repartition(5)
    n, want, shares = plain(rows)
    got = collected(whitened(table))
    assert len(got) == len(rows)
    for i, deviation, z in want:
        parts = got[i, deviation]
        assert sorted(parts) == list(range(1, 17)) and parts[1].n == n and parts[1].identity_error < 1e-9
        np.testing.assert_allclose([abs(parts[k].whitened) for k in range(1, 17)], z, rtol=1e-8, atol=1e-9)
        np.testing.assert_allclose([parts[k].explained for k in range(1, 17)], shares, rtol=1e-10)


def test_low_rank_equal_variances_and_empty(spark):
    from landtally.llm.whitening import whitened
    # Two equal variances, one dimension constant and one a copy of another.
    rows = [(k, [float(a), float(b), 5.0, float(a)]) for k, (a, b) in enumerate([(2, 0), (-2, 0), (0, 2), (0, -2), (1, 1), (-1, -1), (1, -1), (-1, 1)])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitened(table).collect()
    assert {r.component for r in got} == {1, 2} and got[0].identity_error < 1e-12
    square = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0]), (None, [0.0, -1.0])], table.schema)
    got = whitened(square).collect()
    assert len(got) == 8 and got[0].identity_error < 1e-12 and {r.explained for r in got} == {0.5} and None in {r.vec_id for r in got}
    assert whitened(table.limit(0)).count() == 0
    assert whitened(spark.createDataFrame([(1, [0.3, 0.4]), (2, [0.3, 0.4])], table.schema)).count() == 0


def test_large_numbers_stay_exact(spark):
    from landtally.llm.whitening import scatter, usable
    rng = np.random.default_rng(5)
    rows = [(k, (rng.standard_normal(3) * 2.0 ** 40).tolist()) for k in range(40)]
    n, sums, m = scatter(usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).select("x").distinct())
    y = [[math.floor(64 * c) for c in v] for _, v in rows]
    assert n == 40 and sums == [sum(v[j] for v in y) for j in range(3)]
    assert m == [[40 * sum(v[i] * v[j] for v in y) - sums[i] * sums[j] for j in range(3)] for i in range(3)]


@pytest.mark.parametrize("values", [[5, 3, 3, 3, 0, 0], [10**12, 10**12 + 1, 1, 1, 7], [4]])
def test_polynomial_and_roots(spark, values):
    """A symmetric matrix with known integer roots: a diagonal one, mixed by an integer change of signs and places."""
    from landtally.llm.whitening import null_vectors, polynomial, roots
    m = np.diag(np.array(values, object))
    if len(values) > 3:  # a block with roots 1 and 5 in place of two diagonal entries keeps the others
        m[0, 0], m[1, 1], m[0, 1], m[1, 0] = values[0] + 1, values[0] + 1, 1, 1
        values = [values[0], values[0] + 2, *values[2:]]
    poly = polynomial(spark, m.tolist())
    want = [1]
    for v in values:
        want = [a - v * b for a, b in zip([0, *want], [*want, 0])]
    assert poly == want
    got = roots(poly, 16)
    positive = sorted((v for v in values if v), reverse=True)
    assert len(got) == len(positive) and all(a < v << bits <= a + 1 for (a, bits), v in zip(got, positive))
    top = max(values)
    v = null_vectors(m.tolist(), *got[0], values.count(top))
    np.testing.assert_allclose(v @ v.T, np.eye(len(v)), atol=1e-15)
    np.testing.assert_allclose(m.astype(float) @ v.T, top * v.T, rtol=1e-13, atol=1e-13 * top)
