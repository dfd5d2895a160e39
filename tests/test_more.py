"""Denoising, spectra, view choice, scanner vectors: against NumPy restatements."""
import math

import numpy as np
from pyspark.sql import functions as F

from rayframe import geometry
from rayframe.operators import denoise, phantoms, project, spectral, vectors, views


def volume(spark, x):
    i, n = np.arange(x.size), x.shape[2]
    return spark.createDataFrame(list(zip((i // n).tolist(), (i % n).tolist(), x.ravel().tolist())), "pix int, slice int, value double")


def cube(df, shape, value="value"):
    out = np.zeros((shape[0] * shape[1], shape[2]))
    for r in df.collect():
        out[r.pix, r.slice] = r[value]
    return out.reshape(shape)


def test_noise_and_denoising(spark):
    x = np.zeros((14, 14, 12))
    x[4:10, 4:10, 3:9] = 1.0
    y = x + 0.1 * np.random.default_rng(2).normal(size=x.shape)
    v = volume(spark, y)
    vals = np.stack([y] + [np.roll(y, 1, a) for a in range(3)])
    inside = y >= min(0.05 * abs(y).mean(), y.max())
    sigma = vals.std(0)[inside].mean()
    sigma = vals.std(0)[y >= min(0.05 * abs(y).mean() + sigma, y.max())].mean()
    assert abs(denoise.noise_std(v, x.shape) - sigma) < 1e-9
    got = cube(denoise.denoise(v, x.shape, 0.1, band=5, around=2), x.shape)
    assert np.sqrt(((got - x) ** 2).mean()) < 0.6 * np.sqrt(((y - x) ** 2).mean())


def test_median(spark):
    x = np.random.default_rng(7).random((6, 5, 9))
    w = np.lib.stride_tricks.sliding_window_view(np.pad(x, 1, mode="edge"), (3, 3, 3)).reshape(*x.shape, 27)
    got = denoise.median(volume(spark, x), x.shape, 4)
    assert np.allclose(cube(got, x.shape, "median"), np.median(w, -1)) and np.allclose(cube(got, x.shape, "hi"), w.max(-1))


def test_spectra(spark):
    r = np.random.default_rng(4)
    w, h = r.random((60, 3)), r.random((3, 20)) + 0.1 * np.eye(3, 20)
    v = w @ h
    df = spark.createDataFrame([(p, b, float(v[p, b])) for p in range(60) for b in range(20)], "point long, band int, value double")
    assert np.allclose(spectral.gram(df, 20), v.T @ v)
    noisy = df.withColumn("value", F.col("value") + F.lit(1e-4) * F.randn(1))
    assert spectral.dimension(noisy, 20, 1) == 3
    out = np.zeros_like(v)
    for x in spectral.smooth(df, 20, 3).collect():
        out[x.point, x.band] = x.value
    assert np.sqrt(((out - v) ** 2).mean()) < 0.03 * v.std()


def test_view_choice(spark):
    m = geometry.Parallel((8, 3, 16), [math.pi * i / 8 for i in range(8)], {"recon_shape": (12, 12, 3), "delta_voxel": 1.0})
    ref = phantoms.cube(spark, m.params["recon_shape"])
    rows, products = views.basis(spark, m, ref, 0.5)
    a = np.zeros((8, 144 * 3))
    for x in rows.collect():
        a[x.view, x.pix * 3 + x.slice] = x.value
    r = views.matrix(views.gram(rows), 8)
    assert np.allclose(r, a @ a.T) and np.allclose(np.diag(r), 1, atol=1e-6)
    gamma = np.array([x.gamma for x in products.orderBy("view").collect()])
    own, loss = views.choose(r, gamma, 3, 1.0)
    import itertools

    assert abs(loss - min(views._loss(r, gamma, list(c)) for c in itertools.combinations(range(8), 3))) < 0.05 and len(own) == 3
    assert sorted(views.by_priority(own, r, gamma)) == sorted(own)


def test_scanner_vectors(spark):
    axis, normal, along, source, corner = (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (1.0, 0.0, 0.0), (0.0, 0.0, -100.0), (-7.9, -6.3, 100.0)
    assert np.allclose(vectors.distances(axis, normal, along, source, corner), (200, 100, 2, 0))
    assert np.allclose(vectors.offsets(axis, normal, along, source, corner, 0.2, 0.2, 80, 64, 2.0), (0, 0))
    x = np.zeros((6, 40, 36))
    x[:, 9:31, 7:29] = 2.5
    s = spark.createDataFrame([(i, j, k, float(x[i, j, k])) for i in range(6) for j in range(40) for k in range(36)], "view int, det_row int, channel int, value double")
    assert vectors.blank_margins(s, 6, 40, 36, 4) == (5, 5, 3, 3)
    y, required, optional = vectors.auto_crop(s, {"sinogram_shape": (6, 40, 36)}, {"det_row_offset": 0.0}, 4)
    assert required["sinogram_shape"] == (6, 30, 30) and optional["det_row_offset"] == 0.0 and y.count() == 6 * 30 * 30
    assert project.at_pixels(volume(spark, np.ones((2, 2, 2))), spark.range(1).select(F.col("id").cast("int").alias("pix"))).count() == 2


def test_small_rules(spark):
    from rayframe.operators import hardening

    c = hardening.linearisation(0.4, 0.2, 0.5)
    t = np.arange(0, 30.25, 0.25)
    seen = 0.5 * t + np.log(1.4 / (1 + 0.4 * np.exp(0.3 * t)))
    df = spark.createDataFrame([(float(v),) for v in seen], "value double")
    got = [r[0] for r in hardening.linearised(df, 0.4, 0.2, 0.5, 30.25).collect()]
    assert np.abs(np.array(got) - (0.4 * 0.2 + 0.5) / 1.4 * t).max() < 0.05 and np.allclose(got, np.polyval(c, seen))
    p = spark.createDataFrame([(0, 1.0, 0.0, 5.0), (1, 3.0, 0.0, 9.0)], "view int, x double, y double, z double")
    assert sorted(tuple(r) for r in vectors.translations(p).collect()) == [(0, 1.0, 0.0, 2.0), (1, -1.0, 0.0, -2.0)]
    blank = spark.createDataFrame([(i, j, 0.1 if (i, j) == (4, 4) else 1.0) for i in range(9) for j in range(9)], "det_row int, channel int, value double")
    w = {(r.det_row, r.channel): r.value for r in vectors.shadow_weights(blank, 1, buffer=2).collect()}
    assert all(w[i, j] == (0.0 if abs(i - 4) + abs(j - 4) <= 2 else 1.0) for i in range(9) for j in range(9))
    noisy, clean = spectral.simulate(spark, [[0.1, 0.2], [0.3, 0.1], [0.05, 0.4]], 1, 12, 16, 10_000.0)
    a = noisy.join(clean.withColumnRenamed("value", "w"), ["point", "band"]).agg(F.avg(F.abs(F.col("value") - F.col("w"))), F.max("w")).first()
    assert a[0] < 0.05 and a[1] > 0.3
