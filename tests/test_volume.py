"""Volume queries and operators against NumPy restatements."""
import numpy as np

from rayframe.operators import prior, regularise, volume


def cube(rows, shape):
    out = np.full(shape, np.nan)
    for *at, v in rows:
        out[tuple(at)] = v
    return out


def long(spark, x):
    rows, cols, slices = x.shape
    i = np.arange(x.size)
    return spark.createDataFrame(list(zip((i // slices).tolist(), (i % slices).tolist(), x.ravel().tolist())), "pix int, slice int, value double")


def test_stitch_has_the_known_rows(spark):
    want = [[0, 1, 2, 52, 102, 103, 104, 105], [5, 6, 7, 57.5, 108, 109, 110, 111], [10, 11, 12, 63, 114, 115, 116, 117], [15, 16, 17, 68.5, 120, 121, 122, 123]]
    assert np.allclose(cube([tuple(r) for r in volume.QUERIES["stitch_blend"](spark, "").collect()], (4, 8)), want)
    a = spark.range(20).selectExpr("cast(id div 5 AS int) AS j", "cast(id % 5 AS int) AS k", "cast(id AS double) AS value")
    b = spark.range(24).selectExpr("cast(id div 6 AS int) AS j", "cast(id % 6 AS int) AS k", "100D + id AS value")
    got = cube([tuple(r) for r in regularise.stitch([a, b], [5, 6], "k", ["j"], 3).collect()], (4, 8))
    assert np.allclose(got, want)


def test_gradient_and_loss(spark):
    x = np.random.default_rng(3).random((5, 6, 4))
    sigma, q, g, loss = 0.25, 1.2, 0, 0
    for axis in range(3):
        n = x.shape[axis]
        loss += sum(_rho(np.diff(x, axis=axis), sigma, q).ravel()) / 6
        for step in (1, -1):
            near = np.take(x, np.clip(np.arange(n) + step, 0, n - 1), axis)
            g = g + _influence(x - near, sigma, q) / 6
    rows = prior.gradient_and_hessian(long(spark, x), 6, sigma).collect()
    assert np.allclose(cube([(r.pix, r.slice, r.gradient) for r in rows], (30, 4)).reshape(x.shape), g, atol=1e-6)
    assert abs(prior.loss(long(spark, x), 6, sigma).first()[0] - loss) < 1e-6


def _rho(d, sigma, q):
    d = np.maximum(abs(d), sigma * 1e-9)
    return d**2 / (2 * sigma**2) / (1 + (d / sigma) ** (2 - q))


def _influence(d, sigma, q, h=1e-6):
    return np.where(d == 0, 0, (_rho(d + h, sigma, q) - _rho(d - h, sigma, q)) / (2 * h))


def test_median(spark):
    r, c, s = np.indices((12, 12, 6))
    x = np.pad((r * 7 + c * 13 + s * 29) % 17 / 17, 1, mode="edge")
    want = np.median(np.lib.stride_tricks.sliding_window_view(x, (3, 3, 3)).reshape(12, 12, 6, 27), -1)
    assert np.allclose(cube([tuple(r)[:4] for r in volume.QUERIES["median3d"](spark, "").collect()], want.shape), want, atol=1e-6)
