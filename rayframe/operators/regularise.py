"""Losses, line search sums, object support and automatic regularisation."""
import math
import warnings

from pyspark.sql import functions as F

CELL = ["view", "det_row", "channel"]


def stride(views, most=20):
    return max(views // max(1, min(most, views)), 1)


def subsample_views(sino, views, most=20):
    """Every n-th view, so that about `most` are left; views are counted from 0 again."""
    n = stride(views, most)
    return sino.where(F.col("view") % n == 0).withColumn("view", F.floor(F.col("view") / n).cast("int"))


def histogram(values, bins, valid=None):
    """(counts, edges) of column `value` between its least and greatest; the last bin is closed. Rows where `valid` (a Column) fails don't count."""
    import numpy as np

    x = values.where(F.col("value").isNotNull())
    x = x if valid is None else x.where(valid)
    lo, hi = x.agg(F.min("value"), F.max("value")).first()
    if lo is None:
        raise ValueError("there is no value to count")
    edges = np.linspace(lo, hi if hi > lo else lo + 1, bins + 1) if hi > lo else np.linspace(lo - 0.5, lo + 0.5, bins + 1)
    lo, hi = edges[0], edges[-1]
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("value") - float(lo)) * (bins / float(hi - lo))))).cast("int")
    counts = np.zeros(bins, "i8")
    for r in x.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")).collect():
        counts[r.bin] = r.n
    return counts, edges


def background_bounds(sino):
    """(left, right) of the histogram's peak nearest 0, out to a tenth of its height."""
    import numpy as np

    n, edges = histogram(sino, 400)
    mid = (edges[:-1] + edges[1:]) / 2
    peaks = [i for i in range(399) if n[i] > n[i + 1] and (i == 0 or n[i] >= n[i - 1])]
    top = min(peaks, key=lambda i: abs(mid[i])) if peaks else int(np.argmin(abs(mid)))
    left = right = top
    while left > 0 and n[left] > 0.1 * n[top]:
        left -= 1
    while right < 399 and n[right] > 0.1 * n[top]:
        right += 1
    return float(mid[left]), float(mid[right])


def support_threshold(sino):
    """The value from which a cell counts as the object; None where the background can't be told."""
    left, right = background_bounds(sino)
    cut = right + (right - left)
    top = sino.agg(F.max("value")).first()[0]
    if top <= 0 or top < cut:
        warnings.warn("the sinogram's background can't be told" if top > 0 else "the sinogram has no positive value")
        return None
    return 0.25 * sino.where(F.col("value") >= cut).agg(F.median("value")).first()[0]


def indicator(sino):
    """sino with `inside`: whether a cell belongs to the object."""
    t = support_threshold(sino)
    return sino.withColumn("inside", F.lit(True) if t is None else F.col("value") >= t)


def zinger_threshold(sino, views, ratio=0.1, most=20):
    small = indicator(subsample_views(sino, views, most))
    return -ratio * math.sqrt(small.where("inside").agg(F.avg(F.col("value") * F.col("value"))).first()[0])


def edge_share(sino_inside, channels):
    """Share of (view, row) lines whose first or last channel belongs to the object."""
    edge = F.max(F.when(F.col("channel").isin(0, channels - 1), F.col("inside")).otherwise(False))
    return sino_inside.groupBy("view", "det_row").agg(edge.alias("e")).agg(F.avg(F.col("e").cast("double"))).first()[0]


def path_length(model):
    """A typical ray's length through the object."""
    rows, cols, _ = model.params["recon_shape"]
    if model.kind == "translation":
        return 0.5 * rows * model.dv_row
    return min(2 * rows * cols / (rows + cols) * model.dv, model.sinogram_shape[2] * model.params["delta_det_channel"] / model.magnification())


def recon_std(model, sino_inside):
    return sino_inside.where("inside").agg(F.avg(F.abs("value"))).first()[0] / path_length(model)


def sigma_y(model, sino_inside, weights=None):
    x = sino_inside.where("inside")
    w = F.lit(1.0)
    if weights is not None:
        x, w = x.join(weights.withColumnRenamed("value", "_w"), CELL), F.col("_w")
    rms = math.sqrt(x.agg(F.avg(w * F.col("value") * F.col("value"))).first()[0])
    return 10 ** (-model.params["snr_db"] / 20) * rms * math.sqrt(model.dv / (model.params["delta_det_channel"] / model.magnification()))


def regularise(model, sino, weights=None):
    """Sets sigma_y, sigma_x and sigma_prox from the sinogram if that is on; returns them."""
    if model.params["auto_regularize_flag"]:
        views = model.sinogram_shape[0]
        small = indicator(subsample_views(sino, views))
        if edge_share(small, model.sinogram_shape[2]) > 0.02 and not small.where("NOT inside").isEmpty():
            warnings.warn("the object reaches the detector's edge channels")
        spread = 0.2 * 2 ** model.params["sharpness"] * recon_std(model, small)
        y = sigma_y(model, small, None if weights is None else subsample_views(weights, views))
        model.set(no_warning=True, auto_regularize_flag=True, sigma_y=y, sigma_x=spread, sigma_prox=spread)
    return dict(zip(("sigma_y", "sigma_x", "sigma_prox"), model.get(["sigma_y", "sigma_x", "sigma_prox"])))


# Weights and sums ------------------------------------------------------------------
def weights(sino, kind):
    """Column of inverse variances by a noise model."""
    y = F.col("value")
    kinds = {"unweighted": F.lit(1.0), "transmission": F.exp(-y), "transmission_root": F.exp(-y / 2), "emission": 1.0 / (F.abs(y) + 0.1)}
    if kind not in kinds:
        raise ValueError(f"{kind} is none of {sorted(kinds)}")
    return sino.withColumn("value", kinds[kind])


def huber_weights(errors, t=1.0, delta=1.0, epsilon=1e-6):
    """(…, value): 1 for errors (columns value and weight) within t deviations, less beyond; two sums set the scale, so rows stay where they are."""
    if not 0 <= delta <= 1:
        raise ValueError("delta is from 0 to 1")
    std = 1.0 / F.greatest(F.sqrt("weight"), F.lit(epsilon))
    e2, s2 = errors.agg(F.sum(F.col("value") * F.col("value")), F.sum(std * std)).first()
    z = F.abs(F.col("value") / (std * (math.sqrt(e2) / (math.sqrt(s2) + epsilon))))
    return errors.withColumn("value", F.when(z <= t, 1.0).otherwise(delta * t / (z + epsilon))).drop("weight")


def forward_loss(errors, sigma=1.0, normalised=True):
    """One row, `loss`, of errors with a `weight` column (1 if there is none)."""
    w = F.col("weight") if "weight" in errors.columns else F.lit(1.0)
    total = F.sum(F.col("value") * F.col("value") * w)
    return errors.agg((F.sqrt(total / (F.avg(w) * F.count("*"))) / sigma if normalised else total / (2 * sigma**2)).alias("loss"))


def iteration_stats(errors, volume, sigma=1.0):
    """One row: loss, recon_l1 (sum of absolute voxels), rmse of the errors."""
    rmse = errors.agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rmse"))
    return forward_loss(errors, sigma).crossJoin(volume.agg(F.sum(F.abs("value")).alias("recon_l1"))).crossJoin(rmse)


def line_search_sums(errors, change, constant=1.0):
    """One row: linear and quadratic sums of a change of the sinogram against weighted errors (columns value, weight)."""
    x = errors.join(change.withColumnRenamed("value", "_d"), CELL)
    return x.agg((constant * F.sum(F.col("weight") * F.col("value") * F.col("_d"))).alias("linear"), (constant * F.sum(F.col("weight") * F.col("_d") * F.col("_d"))).alias("quadratic"))


def scaling_factor(pairs):
    """One row, `scale`: the multiple of column v that comes nearest column t."""
    return pairs.agg((F.sum(F.col("v") * F.col("t")) / (F.sum(F.col("v") * F.col("v")) + 1e-8)).alias("scale"))


# Thresholds ------------------------------------------------------------------------
def otsu_splits(counts, classes):
    """Bins at which classes begin, so that the spread within them is least: dynamic programming over prefix moments."""
    import numpy as np

    n = len(counts)
    if not 2 <= classes <= n:
        raise ValueError("two classes at least, and no more than bins")
    x = (np.arange(n) - (n - 1) / 2) / max((n - 1) / 2, 1)
    m = [np.r_[0, np.cumsum(np.asarray(counts, float) * x**k)] for k in range(3)]
    d0, d1, d2 = (v[None] - v[:, None] for v in m)
    with np.errstate(divide="ignore", invalid="ignore"):
        cost = np.maximum(d2 - np.where(d0 > 0, d1**2 / d0, 0.0), 0.0)
    cost[~np.triu(np.ones_like(cost, bool), 1)] = np.inf
    best, came = cost[0], []
    for _ in range(classes - 1):
        total = best[:, None] + cost
        came.append(total.argmin(0))
        best = total.min(0)
    out, at = [], n
    for c in reversed(came):
        at = int(c[at])
        out.append(at)
    return out[::-1]


def otsu(values, classes=2, bins=1024, valid=None):
    """Thresholds between classes of column `value`."""
    counts, edges = histogram(values, bins, valid)
    if edges[-1] <= edges[0] or (counts > 0).sum() < 2:
        raise ValueError("one value has no classes")
    return [float(edges[b]) for b in otsu_splits(counts, classes)]


def segment(volume, recon_shape, metals, radial_margin=None, top_margin=None, bottom_margin=None):
    """(volume with `class`: 0 nothing, 1 plastic, 2… metals; [scale of each class]): classes by Otsu inside a cylinder."""
    from rayframe.operators.masks import cylinder

    if metals <= 0:
        raise ValueError("one metal at least")
    rows, cols, slices = recon_shape
    margin = lambda given, n: max(2, min(10, n // 25)) if given is None else given
    x = cylinder(volume, recon_shape, margin(radial_margin, min(rows, cols)), margin(top_margin, slices), margin(bottom_margin, slices))
    cuts = otsu(x, metals + 2)
    cls = F.lit(0)
    for i, c in enumerate(cuts):
        cls = F.when(F.col("value") > c, i + 1).otherwise(cls)
    x = x.withColumn("class", cls)
    sums = {r["class"]: r for r in x.groupBy("class").agg(F.sum("value").alias("s"), F.count("*").alias("n")).collect()}
    return x, [sums[k].s / (sums[k].n + 1e-8) if k in sums else 0.0 for k in range(1, metals + 2)]


def stitch(parts, sizes, axis, keys, overlap, ramp=None):
    """Arrays one after the other along `axis`, laid over each other by `overlap` and blended by a ramp in the middle of that."""
    ramp = overlap // 2 if ramp is None else ramp
    ramp = min(ramp, overlap)
    ramp -= (overlap - ramp) % 2
    ramp = max(ramp, overlap % 2)
    pad = (overlap - ramp) // 2
    rise = lambda k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (k - pad + 1) / float(ramp + 1)))
    out, start = None, 0
    for i, (p, n) in enumerate(zip(parts, sizes)):
        if n < overlap:
            raise ValueError("a part is shorter than the overlap")
        k, w = F.col(axis), F.lit(1.0)
        if i:
            w = w * F.when(k < overlap, rise(k)).otherwise(1.0)
        if i < len(parts) - 1:
            w = w * F.when(k >= n - overlap, 1.0 - rise(k - (n - overlap))).otherwise(1.0)
        x = p.select(*keys, (k + start).alias(axis), (F.col("value") * w).alias("value"))
        out, start = x if out is None else out.unionByName(x), start + n - overlap
    return out.groupBy(*keys, axis).agg(F.sum("value").alias("value"))
