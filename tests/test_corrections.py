"""Scan corrections, thresholds, hardening and stripes against NumPy restatements."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rayframe import geometry
from rayframe.operators import hardening, lines, masks, regularise, scans


def cells(spark, x):
    v, r, c = x.shape
    return spark.createDataFrame([(i, j, k, None if np.isnan(x[i, j, k]) else float(x[i, j, k])) for i in range(v) for j in range(r) for k in range(c)], "view int, det_row int, channel int, value double")


def array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.view, r.det_row, r.channel] = np.nan if r.value is None else r.value
    return out


def filled(x, passes=3):
    for _ in range(passes):
        p = np.pad(x, [(0, 0), (1, 1), (1, 1)], constant_values=np.nan)
        w = np.lib.stride_tricks.sliding_window_view(p, (3, 3), (1, 2)).reshape(*x.shape, 9)
        n = np.isfinite(w).sum(-1)
        x = np.where(np.isnan(x) & (n > 0), np.where(np.isfinite(w), w, 0).sum(-1) / np.maximum(n, 1), x)
    return np.nan_to_num(x)


def test_transmission_and_fill(spark):
    r = np.random.default_rng(314)
    obj, blank, dark = r.uniform(0.2, 0.9, (5, 9, 8)), r.uniform(0.9, 1.1, (2, 9, 8)), r.uniform(0, 0.05, (1, 9, 8))
    obj[3, 5, 7], blank[:, 0, 0] = dark[0, 5, 7], dark[0, 0, 0]
    bad = [(2, 3), (8, 0), *((i, j) for i in range(3, 6) for j in range(2, 5))]
    with np.errstate(divide="ignore", invalid="ignore"):
        want = -np.log(abs(obj - dark.mean(0)) / abs(blank.mean(0) - dark.mean(0)))
    want[~np.isfinite(want)] = np.nan
    for i, j in bad:
        want[:, i, j] = np.nan
    defects = spark.createDataFrame(bad, "det_row int, channel int")
    got = scans.sino_transmission(cells(spark, obj), cells(spark, blank), cells(spark, dark), defects)
    assert np.allclose(array(got, want.shape), filled(want))
    one = scans.fill_pass(cells(spark, want))
    assert np.allclose(np.nan_to_num(array(one, want.shape)), filled(want, 1))
    z = np.where(want < 0.3, np.nan, want)
    assert np.allclose(array(scans.fill_zingers(cells(spark, want), 0.3), want.shape), filled(z))


def test_coarser_grid_and_its_defects(spark):
    r = np.random.default_rng(1)
    x = [r.random((n, 7, 9)) for n in (3, 2, 1)]
    bad = [(0, 0), (0, 1), (1, 0), (1, 1), (4, 5)]
    obj, blank, dark, defects = scans.downsample_scans(*(cells(spark, a) for a in x), 7, 9, (2, 2), spark.createDataFrame(bad, "det_row int, channel int"))
    for got, a in zip((obj, blank, dark), x):
        a = a.copy()
        for i, j in bad:
            a[:, i, j] = np.nan
        with np.testing.suppress_warnings() as w:
            w.filter(RuntimeWarning)
            want = np.nanmean(a[:, :6, :8].reshape(len(a), 3, 2, 4, 2), (2, 4))
        assert np.allclose(array(got, want.shape), want, equal_nan=True)
    assert [tuple(t) for t in defects.collect()] == [(0, 0)]


def test_support_and_regularisation(spark):
    x = np.random.default_rng(2).normal(0, 0.02, (24, 6, 30))
    x[:, 1:5, 8:22] += 2.0
    t = regularise.support_threshold(cells(spark, x))
    assert 0.4 < t < 0.6
    m = geometry.Parallel((24, 6, 30), [math.pi * i / 24 for i in range(24)])
    s = regularise.regularise(m, cells(spark, x))
    small = x[::1][: 24 : 24 // 20]
    inside = small >= t
    assert abs(s["sigma_y"] - 10**-1.5 * math.sqrt((small[inside] ** 2).mean())) < 1e-3
    assert abs(s["sigma_x"] - 0.4 * abs(small[inside]).mean() / 30) < 1e-3
    with pytest.raises(ValueError):
        regularise.otsu(spark.createDataFrame([(1.0,)] * 3, "value double"))


def test_otsu_is_the_best_split(spark):
    r = np.random.default_rng(5)
    z = np.concatenate([r.normal(m, 0.3, n) for m, n in ((0, 300), (2, 200), (5, 80))])
    counts, edges = regularise.histogram(spark.createDataFrame([(float(k),) for k in z], "value double"), 24)
    assert np.array_equal(counts, np.histogram(z, 24)[0])
    x = np.arange(24)

    def spread(cuts):
        return sum((n := counts[a:b]) @ (x[a:b] - (n @ x[a:b]) / max(n.sum(), 1)) ** 2 for a, b in zip((0, *cuts), (*cuts, 24)))

    best = min(((i, j) for i in range(1, 23) for j in range(i + 1, 24)), key=spread)
    assert abs(spread(regularise.otsu_splits(counts, 3)) - spread(best)) < 1e-9


def test_segmentation_of_nested_boxes(spark):
    x = np.zeros((20, 20, 12))
    x[4:16, 4:16, 3:9], x[7:13, 7:13, 4:8], x[9:11, 9:11, 5:7] = 0.4, 3.0, 7.0
    i = np.arange(x.size)
    v = spark.createDataFrame(list(zip((i // 12).tolist(), (i % 12).tolist(), x.ravel().tolist())), "pix int, slice int, value double")
    seg, scales = regularise.segment(v, x.shape, 2)
    got = {r["class"]: r.n for r in seg.groupBy("class").agg(F.count("*").alias("n")).collect()}
    assert got[3] == 8 and got[2] == 6 * 6 * 4 - 8 and np.allclose(scales, [0.4, 3.0, 7.0], atol=1e-6)


def test_stripes(spark):
    v, row, ch = 48, 2, 40
    x = 1 + 0.3 * np.sin(np.arange(ch) / 6)[None, None] + 0.2 * np.cos(np.arange(v) / 8)[:, None, None] + np.zeros((v, row, ch))
    b = x.copy()
    b[:, :, 13] *= 1.6
    b[10:34, :, 27] *= 0.6
    b[:, :, 33] = 0.05
    got = array(lines.remove_all(cells(spark, b), 3, 11, 5), b.shape)
    assert np.abs(got - x).mean() < 0.5 * np.abs(b - x).mean()
    assert np.allclose(lines.median_along(np.arange(5.0), 3, 0), [0, 1, 2, 3, 4]) and lines.mean_along(np.arange(6.0), 3, 0)[0] == 1 / 3


def test_hardening_curves(spark):
    p = np.linspace(0, 4, 200)
    theta = np.array([0.5, -0.7, -1.0, 0.2])
    y = hardening.curve_values(p, theta)
    df = spark.createDataFrame(list(zip(p.tolist(), y.tolist())), "p double, y double")
    assert np.allclose([r[0] for r in df.select(hardening.curve(F.col("p"), theta)).collect()], y)
    assert np.abs(hardening.curve_values(p, hardening.fit_curve(df, 4)) - y).max() < 1e-2
    c, domain = hardening.fit_inverse(theta, 0.0, float(y[-1]) * 0.9, 8)
    slope = hardening.curve_values(1e-6, theta)[0] / 1e-6
    ok = y <= domain[1]
    got = np.array([r[0] for r in df.select(hardening.inverse(F.col("y"), c, domain)).collect()])
    assert np.abs(got - p * slope)[ok].max() < 1e-2
    assert hardening.exponents(2, 2) == [(0, 1), (1, 0), (0, 2), (1, 1), (2, 0)]


def test_quadratic_program():
    r = np.random.default_rng(1)
    for _ in range(20):
        a, q, g, u = r.normal(size=(6, 4)), r.normal(size=4), r.normal(size=(3, 4)), r.random(3)
        p = a.T @ a + 0.1 * np.eye(4)
        x = hardening.solve_qp(p, q, g, u)
        on = np.abs(g @ x - u) < 1e-6
        y = np.linalg.lstsq(g[on].T, -(p @ x + q), rcond=None)[0] if on.any() else np.zeros(0)
        assert (g @ x <= u + 1e-6).all() and (y > -1e-6).all() and np.allclose(p @ x + q + g[on].T @ y, 0, atol=1e-6)


def test_metal_fit_recovers_a_model(spark):
    r = np.random.default_rng(3)
    p, m = r.random(400), np.where(r.random(400) < 0.4, r.random(400), 0.0)
    y = 2.0 * p - 0.6 * p * m + 1.5 * m + 0.3 * m**2
    df = spark.createDataFrame([(i, 0, 0, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(p, m, y))], "view int, det_row int, channel int, p double, m1 double, y double")
    powers = [(1, 0), (1, 1), (0, 1), (0, 2)]
    assert np.allclose(hardening.fit_metal(df, powers, 1, beta=1e-9), [2.0, -0.6, 1.5, 0.3], atol=1e-3)
    got = np.array([r.plastic for r in hardening.correct_metal(df, [2.0, -0.6, 1.5, 0.3], powers, 1, 1.0).orderBy("view").collect()])
    assert np.allclose(got, p, atol=1e-9)


def test_masks(spark):
    n = masks.partition(spark, (16, 16, 1), 5, seed=3).groupBy("subset").count().collect()
    assert len({r["count"] for r in n}) == 1 and len(n) == 5
    assert masks.partition_sequence([2, 4], 4) == [2, 4, 4, 4] and masks.shard_ranges(7, 3) == [(0, 3), (3, 5), (5, 7)]
    with pytest.raises(ValueError):
        masks.ror(spark, (4, 4), True, 1, 0.5)


def test_moves(spark):
    x = np.zeros((1, 24, 30))
    r, c = np.indices((24, 30))
    x[0] = np.exp(-((r - 12) ** 2 / 18 + (c - 14) ** 2 / 30)) + 0.5 * np.exp(-((r - 7) ** 2 / 8 + (c - 20) ** 2 / 10))
    whole = spark.createDataFrame([(0, 2.0, -3.0)], "view int, d_row double, d_channel double")
    assert np.allclose(array(scans.shift(cells(spark, x), 24, 30, whole), x.shape)[0, 2:, :27], x[0, :22, 3:])
    half = spark.createDataFrame([(0, 0.5, -0.5)], "view int, d_row double, d_channel double")
    got = scans.view_offsets(scans.shift_padded(cells(spark, x), 24, 30, half), cells(spark, x)).first()
    assert abs(got.d_row + 0.5) < 0.1 and abs(got.d_channel - 0.5) < 0.1
    assert np.allclose(array(scans.rotate(cells(spark, x), 24, 30, 0.0), x.shape), x)


def test_wavelet_bands(spark):
    r = np.random.default_rng(6)
    for n in (16, 17, 5):
        x = r.random((n, 12))
        for axis in (0, 1):
            assert np.allclose(lines.joined(*lines.split(x, axis), axis)[:n, :12], x)
    smooth = np.sin(np.arange(64) / 9)[:, None] * np.cos(np.arange(48) / 7)[None]
    striped = smooth + 0.3 * (np.arange(48) % 11 == 5)[None]
    got = array(lines.remove_bands(cells(spark, striped[:, None, :]), 2.0), (64, 1, 48))[:, 0]
    lift = lambda x, c: (x[:, c] - (x[:, c - 1] + x[:, c + 1]) / 2).mean()
    assert all(abs(lift(got, c) - lift(smooth, c)) < 0.1 for c in (5, 16, 27, 38)) and lift(striped, 16) > 0.25


def test_fill_beside_missing_cells(spark):
    at = {(0, 0, 0): 1.0, (0, 0, 3): 7.0, (0, 1, 1): None, (0, 2, 2): 4.0, (0, 5, 1): None, (0, 3, 1): 9.0, (1, 1, 2): 5.0}
    got = scans.fill_pass(spark.createDataFrame([(*k, v) for k, v in at.items()], "view int, det_row int, channel int, value double")).collect()
    assert {(x.view, x.det_row, x.channel): x.value for x in got} == at | {(0, 1, 1): 2.5}


def test_small_stripes_beside_missing_cells(spark):
    at = {(0, 0): 3.0, (1, 0): 1.0, (2, 0): 2.0, (0, 1): 10.0, (2, 1): 12.0, (1, 2): 5.0}
    got = lines.remove_small(spark.createDataFrame([(v, 0, c, x) for (v, c), x in at.items()], "view int, det_row int, channel int, value double"), 3, 4).collect()
    # Ranks of the channels: (1, 2, 3), (10, 12), (5), none; the edge channel counts twice at the left.
    want = {(1, 0): 1.0, (2, 0): 2.0, (0, 0): 3.0, (0, 1): 5.0, (2, 1): 7.0, (1, 2): 7.5}
    assert {(x.view, x.channel): x.value for x in got} == want
