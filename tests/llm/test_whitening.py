import numpy as np
import pytest

from voxlake.llm import whitening as white

SCHEMA = "vec_id long, embedding array<float>, label int, component string, row int"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(5)


def _rows(n=300, size=12, seed=1):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(n, size)) * np.linspace(3, 0.01, size) + rnd.normal(size=size) * 5
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base @ rnd.normal(size=(size, size)) * 0.2)]


def _whole(vectors):
    return np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000


def _check(out, rows, k=8):
    x = _whole([v for _, v in rows])
    n, size = x.shape
    total = x.sum(axis=0)
    mean = total / n
    variance = (x - mean).T @ (x - mean) / n
    values, vectors = np.linalg.eigh(variance)
    values, vectors = values[::-1], vectors[:, ::-1]
    ranks = min(k, int((values > values[0] * size * 1e-15).sum()))
    deviation = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(r, total, strict=True)) for r in x]
    assert len(out) == n * ranks
    for c in range(1, ranks + 1):
        own = sorted((r for r in out if r["component"] == c), key=lambda r: (r["vec_id"] is None, r["vec_id"], r["whitened"]))
        want = (x - mean) @ vectors[:, c - 1] / np.sqrt(values[c - 1])
        order = sorted(range(n), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
        got = np.array([r["whitened"] for r in own])
        want = want[order]
        sign = np.sign(got @ want)
        assert np.allclose(got, sign * want, atol=1e-7)
        assert [r["deviation"] for r in own] == [deviation[i] for i in order]
        assert all(abs(r["explained"] - values[c - 1] / np.trace(variance)) <= 1e-9 and r["n"] == n for r in own)
    assert {r["identity_error"] for r in out} == {out[0]["identity_error"]} and out[0]["identity_error"] < 1e-9


def test_equals_plain_eigenvectors(spark):
    rows = _rows()
    out = white.whitening(_frame(spark, rows))
    assert ", ".join(f"{n} {t.replace('bigint', 'long')}" for n, t in out.dtypes) == white.RESULT
    _check(out.collect(), rows)


def test_odd_vectors_are_dropped(spark):
    rows = _rows(60, 5)
    odd = [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0, 4.0]), (903, [1.0, float("nan"), 2.0, 3.0, 4.0]),
           (904, [float("inf")] + [1.0] * 4), (905, [1.0] * 7), (906, [-float("inf")] * 5)]
    copies = rows + [(1000 + i, rows[3][1]) for i in range(40)] + [(None, rows[4][1])]
    _check(white.whitening(_frame(spark, copies + odd)).collect(), copies)


def test_fewer_components_than_asked_for(spark):
    rows = [(i, [a, 2 * a, b, a + b]) for i, (a, b) in enumerate((x / 8, y / 8) for x in range(9) for y in range(5))]
    out = white.whitening(_frame(spark, rows)).collect()
    # rounding down leaves 2 a and a + b exact here, so the rank is 2
    assert {r["component"] for r in out} == {1, 2}
    _check(out, rows)
    assert {r["component"] for r in white.whitening(_frame(spark, _rows(50, 6)), components=3).collect()} == {1, 2, 3}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(i, [3.0, 4.0]) for i in range(9)], [(1, None)], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    out = white.whitening(_frame(spark, rows))
    assert out.count() == 0 and out.columns[0] == "vec_id"


def test_deviations_are_exact_beyond_a_long():
    x = np.array([[1 << 40, -(1 << 40)], [5, 6]])
    n, total = 1 << 30, [7, 1 << 60]
    want = [sum((n * int(v) - t) ** 2 for v, t in zip(r, total, strict=True)) for r in x]
    assert white.deviations(x, n, total) == [None if w >= 1 << 63 else w for w in want]
    assert white.deviations(x[1:], 1000, [3, 1]) == [sum((1000 * int(v) - t) ** 2 for v, t in zip(x[1], (3, 1), strict=True))]


def test_factor_and_rotations():
    rnd = np.random.default_rng(5)
    for size, rank in ((1, 1), (2, 2), (7, 7), (30, 11), (64, 64)):
        half = rnd.normal(size=(size, rank)) * np.logspace(0, -6, rank)
        matrix = half @ half.T
        factor, order = white.pivoted_cholesky(matrix)
        assert np.allclose(factor @ factor.T, matrix[np.ix_(order, order)], atol=1e-12 * matrix.max())
        assert factor.shape[1] <= rank or size == rank
        assert np.allclose(np.triu(factor, 1), 0)
        values, vectors = white.eigenpairs(matrix)
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-9)
        assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:len(values)], rtol=1e-6, atol=1e-12 * values[0])
    assert white.eigenpairs(np.zeros((3, 3)))[0].size == 0
    pairs = [(int(a), int(b)) for x, y in white._rounds(7) for a, b in zip(x, y, strict=True)]
    assert sorted(pairs) == [(a, b) for a in range(7) for b in range(a + 1, 7)]
