"""Iterative reconstruction: subsets of pixels descend in turn on data fit plus prior.

Two ways with one rule a step. `recon` is relational: state (volume, errors) lies in
checkpointed tables, each subset is projected by joins, for any geometry and any size;
few subsets a pass keep the number of jobs small. `recon_slabs` is for parallel beams,
whose slices are independent in the projector: bands of slices, each with `half_overlap`
more on either side for the prior, are reconstructed whole in Arrow kernels, side by side,
and only their own slices are kept.
"""
import math

from pyspark.sql import functions as F

from rayframe.operators import filters, masks, prior, project, regularise

CELL, VOXEL = ["view", "det_row", "channel"], ["pix", "slice"]
EPS = 1.1920928955078125e-07


def check(sino, weights=None):
    """Raises ValueError for values that are missing or no numbers, and for weights that are negative or all 0."""
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    if not sino.where(bad).isEmpty():
        raise ValueError("the sinogram has values that are no numbers")
    if weights is not None:
        r = weights.agg(F.max((bad | (F.col("value") < 0)).cast("int")), F.max("value")).first()
        if r[0] or not r[1] > 0:
            raise ValueError("weights are numbers, none negative and not all 0")


def initial_state(spark, model, sino, weights=None, init=None):
    """(volume, errors): direct reconstruction scaled to the sinogram, a number or a given volume as it is; errors (…, value, weight) are y - A x."""
    scale = init is None
    if init is None:
        init = filters.recon_direct(spark, model, sino)
    elif isinstance(init, (int, float)):
        init = project.constant_volume(spark, model, init)
    f = project.forward_project(spark, model, init).withColumnRenamed("value", "_f")
    w = sino.withColumn("weight", F.lit(1.0)) if weights is None else sino.join(weights.withColumnRenamed("value", "weight"), CELL)
    x, k = w.join(f, CELL), 1.0
    if scale:
        ff, fy = x.agg(F.sum(F.col("weight") * F.col("_f") * F.col("_f")), F.sum(F.col("weight") * F.col("_f") * F.col("value"))).first()
        k = fy / ff if ff and ff > 0 else 1.0
    return init.withColumn("value", F.col("value") * k), x.select(*CELL, (F.col("value") - F.col("_f") * k).alias("value"), "weight")


def direction(model, volume, errors, hessian, pix, prox_input=None):
    """(pix, slice, value, g, h, d) at the pixels: the prior's gradient and Hessian and the step that the diagonal gives."""
    p, cols = model.params, model.params["recon_shape"][1]
    fm = 1.0 / p["sigma_y"] ** 2
    if prox_input is None:
        x = prior.gradient_and_hessian(volume, cols, p["sigma_x"], p["p"], p["q"], p["T"], p["qggmrf_nbr_wts"])
    else:
        x = prior.prox_gradient(volume, prox_input, p["sigma_prox"]).withColumn("hessian", F.lit(1.0 / p["sigma_prox"] ** 2))
    b = project.back(model, errors.select(*CELL, (F.col("value") * F.col("weight")).alias("value")), pix).withColumnRenamed("value", "_b")
    x = x.join(pix, "pix", "left_semi").join(b, VOXEL, "left").join(hessian.withColumnRenamed("value", "_h"), VOXEL)
    g, h = -fm * F.coalesce("_b", F.lit(0.0)) + F.col("gradient"), fm * F.col("_h") + F.col("hessian")
    if model.kind == "cone" and model.damping:
        damped = damped_direction(x.select(*VOXEL, "value", "gradient", "hessian", g.alias("g"), h.alias("h")), damping_profile(model, *model.damping))
        return damped.select(*VOXEL, "value", F.col("gradient").alias("g"), F.col("hessian").alias("h"), "d")
    return x.select(*VOXEL, "value", F.col("gradient").alias("g"), F.col("hessian").alias("h"), F.coalesce(F.try_divide(-g, h), F.lit(0.0)).alias("d"))


def step(model, volume, errors, hessian, pix, keep, prox_input=None):
    """(volume, errors, alpha, sum of absolute changes) after one subset; `keep` writes a table and gives it back."""
    p = model.params
    fm = 1.0 / p["sigma_y"] ** 2
    d = keep(direction(model, volume, errors, hessian, pix, prox_input))
    change = keep(project.forward(model, d.select(*VOXEL, F.col("d").alias("value"))))
    line, quad = regularise.line_search_sums(errors, change, fm).first()
    gd, hd = d.agg(F.sum(F.col("g") * F.col("d")), F.sum(F.col("h") * F.col("d") * F.col("d"))).first()
    alpha = min(max(((line or 0.0) - gd) / ((quad or 0.0) + hd + EPS), EPS), p["max_alpha"])
    if p["positivity_flag"]:
        d = keep(d.withColumn("d", F.greatest(-F.col("value") / (alpha + EPS), F.col("d"))))
        change = keep(project.forward(model, d.select(*VOXEL, F.col("d").alias("value"))))
    moved = d.select(*VOXEL, (F.col("d") * alpha).alias("_d"))
    volume = volume.join(moved, VOXEL, "left").select(*VOXEL, (F.col("value") + F.coalesce("_d", F.lit(0.0))).alias("value"))
    errors = errors.join(change.withColumnRenamed("value", "_c"), CELL, "left").select(*CELL, (F.col("value") - alpha * F.coalesce("_c", F.lit(0.0))).alias("value"), "weight")
    return keep(volume), keep(errors), alpha, moved.agg(F.sum(F.abs("_d"))).first()[0]


def recon(spark, model, sino, weights=None, init=None, iterations=15, stop_pct=0.2, subsets=(2, 4), prox_input=None, keep=None):
    """(volume, traces): `subsets` are the numbers of subsets of the first passes, the last goes on; `keep` defaults to reliable checkpoints."""
    keep = keep or (lambda df: df.checkpoint())
    model.verify()
    check(sino, weights)
    regularise.regularise(model, sino, weights)
    shape, mask = model.params["recon_shape"], model.params["use_ror_mask"]
    volume, errors = (keep(x) for x in initial_state(spark, model, sino, weights, init))
    hessian = keep(project.hessian_diagonal(spark, model, weights))
    traces = []
    for i, n in enumerate(masks.partition_sequence(subsets, iterations)):
        part, changed, alphas = keep(masks.partition(spark, shape, n, mask, i)), 0.0, []
        for k in range(n):
            volume, errors, alpha, c = step(model, volume, errors, hessian, part.where(F.col("subset") == k).select("pix"), keep, prox_input)
            changed += c
            alphas.append(alpha)
        s = regularise.iteration_stats(errors, volume, model.params["sigma_y"]).first()
        pct = 100 * changed / s.recon_l1 if s.recon_l1 else math.nan
        traces.append({"iteration": i, "subsets": n, "fm_rmse": s.loss, "alpha": sum(alphas) / n, "change_pct": pct})
        if pct < stop_pct:
            break
    return volume, traces


def prox_map(spark, model, prox_input, sino, sigma_prox=None, **how):
    """Proximal map of the data fit: recon with a pull to `prox_input`; sigma_prox comes back afterwards."""
    regularise.regularise(model, sino, how.get("weights"))
    before, flag = model.params["sigma_prox"], model.params["auto_regularize_flag"]
    model.params["auto_regularize_flag"] = False
    if sigma_prox is not None:
        model.params["sigma_prox"] = sigma_prox
    try:
        return recon(spark, model, sino, prox_input=prox_input, **how)
    finally:
        model.params["sigma_prox"], model.params["auto_regularize_flag"] = before, flag


def recon_simple_parallel(spark, sino, shape, angles, weights=None, sharpness=1.0, iterations=15):
    from rayframe.geometry import Parallel

    return recon(spark, Parallel(shape, angles, {"sharpness": sharpness}), sino, weights, iterations=iterations)


def recon_simple_cone(spark, sino, shape, angles, source_detector_dist, source_iso_dist, weights=None, sharpness=1.0, iterations=15):
    from rayframe.geometry import make

    return recon(spark, make("cone", shape, angles, source_detector_dist, source_iso_dist, sharpness=sharpness), sino, weights, iterations=iterations)


# Bands of slices --------------------------------------------------------------------
def _matrix(views, p, shape, channels, radius, pix):
    """(pixel index, view * channels + channel, a) of the taps of a parallel beam."""
    import numpy as np

    rows, cols = shape[:2]
    dv, dvr, ddc = p["delta_voxel"], p["voxel_row_aspect"] * p["delta_voxel"], p["delta_det_channel"]
    x, y = (pix % cols - (cols - 1) / 2) * dv, (pix // cols - (rows - 1) / 2) * dvr
    of, cell, a = [], [], []
    for v, (angle,) in enumerate(views):
        c, s = np.cos(angle), np.sin(angle)
        n = (c * x - s * y + p["det_channel_offset"]) / ddc + (channels - 1) / 2
        foot = max(abs(c) * dv, abs(s) * dvr)
        for o in range(-radius, radius + 1):
            at = np.rint(n).astype("i8") + o
            w = np.clip((foot / ddc + 1) / 2 - np.abs(n - at), 0, min(1, foot / ddc)) * dv * dvr / foot
            ok = (w > 0) & (at >= 0) & (at < channels)
            of.append(np.flatnonzero(ok)), cell.append(v * channels + at[ok]), a.append(w[ok])
    return tuple(map(np.concatenate, (of, cell, a)))


class _Beam:
    """The taps sorted by cell and by pixel, so that sums are over runs."""

    def __init__(self, of, cell, a, pixels, cells):
        import numpy as np

        self.shape = pixels, cells
        by = np.argsort(of, kind="stable")
        self.cell, self.a = cell[by], a[by]
        self.starts = np.searchsorted(of[by], np.arange(pixels + 1))

    def _taps(self, pix):
        import numpy as np

        n = self.starts[pix + 1] - self.starts[pix]
        at = np.repeat(self.starts[pix] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(np.arange(len(pix)), n), self.cell[at], self.a[at]

    def forward(self, pix, values):
        """Sums by cell of values (pixels, slices)."""
        import numpy as np

        of, cell, a = self._taps(pix)
        return np.stack([np.bincount(cell, a * values[of, s], self.shape[1]) for s in range(values.shape[1])], 1)

    def back(self, pix, y, power=1):
        import numpy as np

        of, cell, a = self._taps(pix)
        return np.stack([np.bincount(of, a**power * y[cell, s], len(pix)) for s in range(y.shape[1])], 1)


def _prior_terms(x, rows, cols, pix, p):
    """Gradient and Hessian of the prior at pixels of x (pixels, slices)."""
    import numpy as np

    b, sx, g, h = prior.neighbour_weights(p["qggmrf_nbr_wts"]), p["sigma_x"], 0.0, 0.0
    r, c = pix // cols, pix % cols
    own = x[pix]
    near = [x[np.clip(r + d, 0, rows - 1) * cols + c] for d in (1, -1)] + [x[r * cols + np.clip(c + d, 0, cols - 1)] for d in (1, -1)]
    near += [np.concatenate([own[:, 1:], own[:, -1:]], 1), np.concatenate([own[:, :1], own[:, :-1]], 1)]
    for w, y in zip(b, near):
        d = own - y
        a = np.maximum(np.abs(d), p["T"] * sx * EPS)
        t = (a / (p["T"] * sx)) ** (p["q"] - p["p"])
        k = 2 * w * a ** (p["p"] - 2) / (2 * sx ** p["p"]) * t * (p["q"] / p["p"] + t) / (1 + t) ** 2
        g, h = g + k * d, h + k
    return g, h


def descend(y, w, x, beam, inside, shape, p, plan, stop_pct):
    """(x, e, traces): passes over random subsets of the pixels `inside`; y, w (cells, slices), x (pixels, slices)."""
    import numpy as np

    rng, fm = np.random.default_rng(0), 1 / p["sigma_y"] ** 2
    rows, cols = shape[:2]
    e, traces = y - beam.forward(inside, x[inside]), []
    hessian = np.zeros_like(x)
    hessian[inside] = beam.back(inside, w, 2)
    for n in plan:
        changed, subsets = 0.0, np.array_split(rng.permutation(inside), n)
        for pix in subsets:
            pix = np.sort(pix)
            g, h = _prior_terms(x, rows, cols, pix, p)
            hf = fm * hessian[pix]
            d = -(-fm * beam.back(pix, w * e) + g) / (hf + h)
            ad = beam.forward(pix, d)
            alpha = (fm * (w * e * ad).sum() - (g * d).sum()) / (fm * (w * ad * ad).sum() + (h * d * d).sum() + EPS)
            alpha = min(max(alpha, EPS), p["max_alpha"])
            if p["positivity_flag"]:
                d = np.maximum(-x[pix] / (alpha + EPS), d)
                ad = beam.forward(pix, d)
            x[pix] += alpha * d
            e -= alpha * ad
            changed += alpha * np.abs(d).sum()
        total = np.abs(x).sum()
        traces.append((float(np.sqrt((w * e * e).sum() / (w.mean() * e.size)) / p["sigma_y"]), float(100 * changed / total) if total else math.nan))
        if traces[-1][1] < stop_pct:
            break
    return x, e, traces


def recon_slabs(spark, model, sino, weights=None, init=None, iterations=15, stop_pct=0.2, band=16, half_overlap=3):
    """(pix, slice, value) of a parallel scan, band by band."""
    model.verify()
    check(sino, weights)
    regularise.regularise(model, sino, weights)
    views, n, channels = model.sinogram_shape
    shape, p, radius, angles = model.params["recon_shape"], dict(model.params), model.radii()[0], list(model.views)
    plan = [p["granularity"][g] for g in masks.partition_sequence(p["partition_sequence"], iterations)]
    inside = sorted(r.pix for r in project.pixels(spark, model).collect())  # a slice's pixels, as every kernel needs them
    init = filters.recon_direct(spark, model, sino) if init is None else init
    cuts = masks.bands(n, band)
    slabs = spark.createDataFrame([(i, lo, hi, max(0, lo - half_overlap), min(n, hi + half_overlap)) for i, (lo, hi) in enumerate(cuts)], "band int, lo int, hi int, first int, past int")
    cells = sino if weights is None else sino.join(weights.withColumnRenamed("value", "weight"), CELL)
    cells = cells.select(F.lit(0).alias("kind"), (F.col("view") * channels + F.col("channel")).alias("at"), F.col("det_row").alias("slice"), F.col("value").cast("double").alias("value"), F.lit(1.0).alias("weight") if weights is None else "weight")
    rows = cells.unionByName(init.select(F.lit(1).alias("kind"), F.col("pix").alias("at"), "slice", "value", F.lit(1.0).alias("weight")))
    near = F.sequence(F.greatest(F.lit(0), F.floor((F.col("slice") - half_overlap) / band) - 1), F.least(F.lit(len(cuts) - 1), F.floor((F.col("slice") + half_overlap) / band) + 1))
    rows = rows.withColumn("band", F.explode(F.transform(near, lambda b: b.cast("int")))).join(F.broadcast(slabs), "band").where("slice >= first AND slice < past")

    def run(_, t):
        import numpy as np
        import pyarrow as pa

        col = {c: t.column(c).to_numpy() for c in t.column_names}
        first, past, lo, hi = (int(col[c][0]) for c in ("first", "past", "lo", "hi"))
        pix = np.array(inside)
        beam = _Beam(*_matrix(angles, p, shape, channels, radius, np.arange(shape[0] * shape[1])), shape[0] * shape[1], views * channels)
        y, w, x = np.zeros((views * channels, past - first)), np.ones((views * channels, past - first)), np.zeros((shape[0] * shape[1], past - first))
        s, k = col["slice"] - first, col["kind"] == 0
        y[col["at"][k], s[k]], w[col["at"][k], s[k]], x[col["at"][~k], s[~k]] = col["value"][k], col["weight"][k], col["value"][~k]
        f = beam.forward(pix, x[pix])
        if (w * f * f).sum() > 0:
            x *= (w * f * y).sum() / (w * f * f).sum()
        x, _, _ = descend(y, w, x, beam, pix, shape, p, plan, stop_pct)
        own = x[:, lo - first : hi - first]
        return pa.table({"pix": pa.array(np.repeat(np.arange(len(x)), hi - lo), pa.int32()), "slice": pa.array(np.tile(np.arange(lo, hi), len(x)), pa.int32()), "value": own.ravel()})

    return rows.groupBy("band").applyInArrow(run, "pix int, slice int, value double")


# Metal, and slice-wise damping ---------------------------------------------------------
def metal_weights(spark, model, sino, volume=None, threshold=None, beta=1.0, gamma=3.0):
    """exp(-(y / beta) * (1 + gamma * metal)): metal are cells that a volume's voxels over a threshold fall on, or that Otsu finds in the sinogram."""
    if beta <= 0 or gamma < 0:
        raise ValueError("beta is over 0 and gamma not under")
    if volume is None:
        metal, x = F.col("value") > regularise.otsu(sino, 3)[-1], sino
    else:
        cut = regularise.otsu(volume, 3)[-1] if threshold is None else threshold
        mask = volume.withColumn("value", (F.col("value") > cut).cast("double"))
        x = sino.join(project.forward_project(spark, model, mask).withColumnRenamed("value", "_m"), CELL)
        metal = F.col("_m") > 0
    return x.select(*CELL, F.exp(-(F.col("value") / beta) * (1 + gamma * metal.cast("double"))).alias("value"))


def recon_plastic_metal(spark, model, sino, weights=None, passes=3, metals=1, order=3, alpha=1.0, beta=0.002, gamma=0.1, rounds=10, **how):
    """(volume, traces): a sinogram corrected for hardening by what the last reconstruction shows, and reconstructed again, `passes` times."""
    from rayframe.operators.hardening import correct_plastic_metal

    if metals < 0:
        raise ValueError("metals are counted from 0")
    if metals == 0:
        return recon(spark, model, sino, weights, **how)
    volume, traces = filters.recon_direct(spark, model, sino).checkpoint(), []
    for _ in range(passes):
        better = correct_plastic_metal(spark, model, sino, volume, metals, order, alpha, beta, gamma, rounds).checkpoint()
        volume, own = recon(spark, model, better, weights, volume, **how)
        traces.append(own)
    return volume, traces


def damping_profile(model, a, b, p, c):
    """One factor a slice: from `a` at the source's plane to `c` far from it, averaged over the views of a helical scan."""
    n, z = model.params["recon_shape"][2], model.params["recon_slice_offset"]
    across = model.params["recon_shape"][0] * model.dv
    out = []
    for k in range(n):
        t = [across * abs((k - (n - 1) / 2) * model.dv_slice + z - v[1]) / (model.params["source_iso_dist"] * model.dv_slice) for v in model.views]
        t = t if len({v[1] for v in model.views}) > 1 else t[:1]
        out.append(sum((c * x**p + a * b**p) / (x**p + b**p) for x in t) / len(t))
    return out


def damped_direction(steps, profile):
    """steps (pix, slice, g, h) with d = -(g - (1 - s) * mean) / h, mean a slice's mean of g weighted by 1 / h and s its factor."""
    spark = steps.sparkSession
    means = steps.groupBy("slice").agg((F.sum(F.col("g") / F.col("h")) / F.sum(1.0 / F.col("h"))).alias("_mean"))
    factors = spark.createDataFrame([(k, float(s)) for k, s in enumerate(profile)], "slice int, _s double")
    x = steps.join(means.join(factors, "slice"), "slice")
    return x.withColumn("d", -(F.col("g") - (1.0 - F.col("_s")) * F.col("_mean")) / F.col("h")).drop("_mean", "_s")
