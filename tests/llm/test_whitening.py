import math

import numpy as np
import pytest

from factloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, n string, component string, whitened string, data string"


def brute(rows, components=4):
    """{(vec_id, component): (n, deviation, whitened up to sign, explained)} by a full eigendecomposition."""
    held = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    grid = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in held}
    fit = np.array(sorted(set(map(tuple, grid.values()))), object)
    n, sums = len(fit), fit.sum(axis=0)
    x = fit.astype(float) - np.array([s / n for s in sums])
    values, basis = np.linalg.eigh(x.T @ x / n)
    values, basis = values[::-1], basis[:, ::-1]
    out = {}
    for i, v in grid.items():
        far = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        for k in range(min(components, len(values))):
            w = (np.array(v, float) - np.array([s / n for s in sums])) @ basis[:, k] / math.sqrt(values[k])
            out[i, k + 1] = (n, far, w, values[k] / values.sum())
    return out


def vectors(rnd, rows, dim):
    lift = np.linspace(3, 0.5, dim)
    return [(i, [float(c) for c in v]) for i, v in enumerate((rnd.standard_normal((rows, dim)) * lift).astype(np.float32))]


def result(stored, spark, rows, files=3, **options):
    df = stored(spark.createDataFrame([(i, v, *["x"] * 5) for i, v in rows], SCHEMA), files)
    made = whitening.fitted(df, "embedding", 4, **options)
    return made, whitening.whitened(df, "vec_id", "embedding", made).collect()


@pytest.mark.parametrize("options", [{}, {"block": 6, "degree": 8}])
def test_as_a_full_decomposition(spark, stored, options):
    rows = vectors(np.random.default_rng(3), 700, 40)
    rows += [(1000, None), (1001, rows[0][1][:-1] + [None]), (1002, [math.nan] * 40), (1003, [math.inf] + [0.0] * 39), (1004, [-0.0] * 40), (1005, [0.0] * 40)]
    rows += [(2000 + i, rows[5][1]) for i in range(400)]  # a third are copies
    made, got = result(stored, spark, rows, **options)
    want = brute(rows)
    assert sorted((r.vec_id, r.component) for r in got) == sorted(want)
    signs = {}
    for r in got:
        n, far, w, explained = want[r.vec_id, r.component]
        sign = signs.setdefault(r.component, math.copysign(1, w * r.whitened))  # the same for all rows
        assert (r.n, r.deviation) == (n, far)
        assert r.whitened == pytest.approx(sign * w, abs=1e-8) and r.explained == pytest.approx(explained, rel=1e-10)
        assert r.identity_error < 1e-8 and r.residual <= whitening.RESIDUAL
    assert made.n == 701


def test_a_null_key_and_repeated_keys(spark, stored):
    rows = vectors(np.random.default_rng(4), 20, 3) + [(None, [1.0, 2.0, 3.0]), (0, [4.0, 0.0, 0.0])]
    made, got = result(stored, spark, rows)
    assert len(made.values) == 3 and made.n == 22
    assert sum(r.vec_id is None for r in got) == 3 and sum(r.vec_id == 0 for r in got) == 6


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]])
def test_nothing_to_fit(spark, stored, rows):
    made, got = result(stored, spark, rows, 1)
    assert made is None and got == []


def test_flat_directions_have_no_row(spark, stored):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(a), float(a), float(b), 1.0]) for i, (a, b) in enumerate(rnd.integers(-9, 9, (60, 2)))]
    made, got = result(stored, spark, rows)
    assert len(made.values) == 2 and {r.component for r in got} == {1, 2} and made.identity_error < 1e-9


def test_lengths_must_agree(spark, stored):
    with pytest.raises(ValueError, match="entries"):
        result(stored, spark, [(1, [1.0, 2.0]), (2, [1.0])])


def test_large_entries(spark, stored):
    rows = [(i, [v, float(i)]) for i, v in enumerate([3e38, -3e38, 1e10, -1e10, 2.0])]
    made, got = result(stored, spark, rows, 1)
    assert made.n == 5 and all(r.deviation is None for r in got if r.vec_id < 2)
    far = whitening.deviations(np.array([[1 << 40, 0], [1, 2]]), 3, [6, 6])
    assert far == [None, 9] and whitening.deviations(np.array([[1 << 29, 0]]), 3, [6, 6]) == [(3 * (1 << 29) - 6) ** 2 + 36]


@pytest.mark.parametrize("spectrum", [np.ones(50), np.linspace(1.001, 1, 200), np.r_[5, 5, 5, np.full(60, 1.0)], np.r_[1e6, 1e-3, np.zeros(70)], 0.9 ** np.arange(150), np.r_[np.ones(100) + 1e-9 * np.arange(100)]])
def test_certified_on_any_spectrum(spectrum):
    d = len(spectrum)
    turn = np.linalg.qr(np.random.default_rng(6).standard_normal((d, d)))[0]
    matrix = (turn * spectrum) @ turn.T
    values, vectors_, residuals = whitening.leading(lambda q: matrix @ q, d, 4)
    want = np.sort(spectrum)[::-1][:4]
    assert np.allclose(values, want, rtol=1e-11, atol=1e-13 * want[0])
    assert np.allclose(vectors_.T @ vectors_, np.eye(4), atol=1e-12)
    assert np.linalg.norm(matrix @ vectors_ - vectors_ * values, axis=0).max() < 1e-11 * want[0]


def test_sums_of_many_tasks(spark, stored):
    rows = vectors(np.random.default_rng(7), 300, 5)
    df = stored(spark.createDataFrame([(i, v, *["x"] * 5) for i, v in rows], SCHEMA), 4)
    blocks = whitening.distinct_grid(df, "embedding", 256.0).repartition(100)
    for tasks in (None, 3, 100):
        (n, sums, squares), _ = whitening.added_up(blocks, whitening._exact, tasks)
        grid = np.floor(np.array([v for _, v in rows], float) * 256).astype(np.int64)
        assert (n, sums.tolist(), squares.tolist()) == (300, grid.sum(axis=0).tolist(), (grid ** 2).sum(axis=0).tolist())


def test_the_query(spark):
    from factloom.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want, signs = brute(rows), {}
    got = QUERIES["op13_whitening"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(want)
    for r in got:
        n, far, w, explained = want[r.vec_id, r.component]
        sign = signs.setdefault(r.component, math.copysign(1, w * r.whitened))
        assert (r.n, r.deviation) == (n, far) and r.whitened == pytest.approx(sign * w, abs=1e-9)
        assert r.explained == pytest.approx(explained, rel=1e-12) and r.identity_error < 1e-9
