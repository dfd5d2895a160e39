"""Denoising of a volume under the prior alone, noise estimates, and the 27-point median.

The volume is worked on in bands of slices with a few more on either side, each a task.
"""
import math

from pyspark.sql import functions as F

from rayframe.operators import masks, recon


def strided(volume, cols, rows_step=1, cols_step=1, slices_step=1):
    """Every n-th row, column and slice, counted from 0 again: (row, col, slice, value)."""
    r, c = F.floor(F.col("pix") / cols), F.col("pix") % cols
    x = volume.where((r % rows_step == 0) & (c % cols_step == 0) & (F.col("slice") % slices_step == 0))
    return x.select(F.floor(r / rows_step).cast("int").alias("row"), F.floor(c / cols_step).cast("int").alias("col"), F.floor(F.col("slice") / slices_step).cast("int").alias("slice"), "value")


def support(grid, sigma):
    """grid with `inside`: values of a twentieth of the mean absolute value and sigma, or the greatest."""
    mean, top = grid.agg(F.avg(F.abs("value")), F.max("value")).first()
    return grid.withColumn("inside", F.col("value") >= min(0.05 * mean + sigma, top))


def local_std(grid, shape):
    """Mean over the support of the deviation among a voxel and its three neighbours behind (the first's is the last)."""
    axes, x = ("row", "col", "slice"), grid
    for a, n in zip(axes, shape):
        moved = grid.select(*(((F.col(k) + 1) % n).cast("int").alias(k) if k == a else F.col(k) for k in axes), F.col("value").alias(f"_{a}"))
        x = x.join(moved, list(axes))
    four = F.array("value", *(f"_{a}" for a in axes))
    mean = F.aggregate(four, F.lit(0.0), lambda s, v: s + v) / 4
    var = F.aggregate(F.transform(four, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda s, v: s + v) / 4
    return x.where("inside").agg(F.avg(F.sqrt(var))).first()[0]


def noise_std(volume, shape, most=5_000_000):
    """Two rounds of the estimate on a sample of about `most` voxels at a stride."""
    n = math.prod(shape)
    step = max(1, round((n / min(most, n)) ** (1 / 3)))
    grid, small = strided(volume, shape[1], step, step, step), tuple(-(-k // step) for k in shape)
    sigma = local_std(support(grid, 0.0), small)
    return local_std(support(grid, sigma), small)


def _banded(volume, shape, band, around, kernel, schema, names):
    """kernel(x (pixels, slices), first own, past the last own) -> arrays of the own slices, for each band."""
    cuts = masks.bands(shape[2], band)
    n = len(cuts)
    rows = []
    for i, (lo, hi) in enumerate(cuts):
        rows.append((i, lo, hi, max(0, lo - around), min(shape[2], hi + around)))
    table = volume.sparkSession.createDataFrame(rows, "band int, lo int, hi int, first int, past int")
    size = -(-shape[2] // n)
    near = F.sequence(F.greatest(F.lit(0), F.floor((F.col("slice") - around) / size).cast("int") - 1), F.least(F.lit(n - 1), F.floor((F.col("slice") + around) / max(1, size - 1)).cast("int") + 1))
    x = volume.select("pix", "slice", "value", F.explode(near).alias("band")).join(F.broadcast(table), "band").where("slice >= first AND slice < past")

    def run(_, t):
        import numpy as np
        import pyarrow as pa

        first, past, lo, hi = (int(t.column(c)[0].as_py()) for c in ("first", "past", "lo", "hi"))
        y = np.zeros((shape[0] * shape[1], past - first))
        y[t.column("pix").to_numpy(), t.column("slice").to_numpy() - first] = t.column("value").to_numpy()
        out = kernel(y, lo - first, hi - first)
        pix, sl = np.repeat(np.arange(len(y)), hi - lo), np.tile(np.arange(lo, hi), len(y))
        return pa.table({"pix": pa.array(pix, pa.int32()), "slice": pa.array(sl, pa.int32())} | {k: v.ravel() for k, v in zip(names, out)})

    return x.groupBy("band").applyInArrow(run, schema)


class _Same:
    """The projector that leaves a volume as it is."""

    def __init__(self, n):
        self.n = n

    def forward(self, pix, values):
        import numpy as np

        out = np.zeros((self.n, values.shape[1]))
        out[pix] = values
        return out

    def back(self, pix, y, power=1):
        return y[pix]


def denoise(volume, shape, sigma_noise=None, sharpness=1.0, iterations=15, stop_pct=0.2, subsets=8, band=32, around=4, init=None):
    """(pix, slice, value): the volume nearest to `volume` under the prior; sigma_noise is estimated if not given."""
    sigma = noise_std(volume, shape) if sigma_noise is None else sigma_noise
    p = {"sigma_y": sigma, "sigma_x": 0.2 * 2**sharpness * sigma, "p": 2.0, "q": 1.2, "T": 1.0, "qggmrf_nbr_wts": (1.0, 1.0, 1.0), "max_alpha": 1.5, "positivity_flag": False}

    def kernel(y, lo, hi):
        import numpy as np

        x, _, _ = recon.descend(y, np.ones_like(y), y.copy(), _Same(len(y)), np.arange(len(y)), shape, p, [subsets] * iterations, stop_pct)
        return [x[:, lo:hi]]

    return _banded(volume, shape, band, around, kernel, "pix int, slice int, value double", ["value"])


def median(volume, shape, band=32):
    """(pix, slice, median, lo, hi) of the 27 voxels around each; beyond an edge the edge voxel counts again."""

    def kernel(y, lo, hi):
        import numpy as np

        x = np.pad(y.reshape(shape[0], shape[1], -1), 1, mode="edge")
        w = np.lib.stride_tricks.sliding_window_view(x, (3, 3, 3)).reshape(len(y), y.shape[1], 27)[:, lo:hi]
        return np.median(w, -1), w.min(-1), w.max(-1)

    return _banded(volume, shape, band, 1, kernel, "pix int, slice int, median double, lo double, hi double", ["median", "lo", "hi"])
