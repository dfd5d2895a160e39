"""Forward and back projection as joins on computed taps.

Relations: volume (pix, slice, value), sino (view, det_row, channel, value). The matrix is
never stored: `channel_taps` and `row_taps` compute its factors from the model, and both
directions join the same taps, so one is the exact adjoint of the other. A pixel meets the
views by an array of their parameters (bounded by the number of views), not by a cross
join. For a parallel beam rows are slices and only channel taps are needed.
"""
import math

from pyspark.sql import functions as F


def pixels(spark, model, mask=None):
    """(pix): the pixels that projectors may change: the mask's, by default the model's."""
    from rayframe.operators.masks import ror

    return ror(spark, model.params["recon_shape"], model.params["use_ror_mask"] if mask is None else mask).where("inside").select("pix")


def with_views(model, rows, views=None):
    """rows, each with all views (or the given ones) as (view, p0, p1, p2)."""
    every = [(i, *v, *(0.0,) * (3 - len(v))) for i, v in enumerate(model.views)]
    every = every if views is None else [every[i] for i in views]
    cols = [F.lit([type(c)(x) for x in col]) for c, col in zip((0, 0.0, 0.0, 0.0), zip(*every))]
    x = rows.withColumn("_v", F.explode(F.arrays_zip(*(c.alias(n) for c, n in zip(cols, ("view", "p0", "p1", "p2"))))))
    return x.select(*rows.columns, F.col("_v.view").cast("int").alias("view"), "_v.p0", "_v.p1", "_v.p2")


def channel_taps(model, pix, views=None):
    """(view, pix, channel, a) and, for beams with rows of their own, mag, depth and the view's parameters."""
    n, r = model.sinogram_shape[2], model.radii()[0]
    x = with_views(model, pix.select(F.col("pix").cast("int").alias("pix")), views)
    h = model.horizontal()
    x = x.select("view", "pix", "p0", "p1", "p2", *(c.alias(k) for k, c in h.items()))
    x = x.withColumn("_o", F.explode(F.sequence(F.lit(-r), F.lit(r)))).withColumn("channel", F.col("_o") + F.rint("n_p").cast("int"))
    a = F.greatest(F.lit(0.0), F.least((F.col("width") + 1) / 2 - F.abs(F.col("n_p") - F.col("channel")), F.least(F.lit(1.0), F.col("width")))) * F.col("scale")
    return x.where((F.col("channel") >= 0) & (F.col("channel") < n)).withColumn("a", a).where("a > 0").select("view", "pix", "channel", "a", "mag", "depth", "p0", "p1", "p2")


def row_taps(model, rows):
    """rows with mag, depth, the view's parameters and slice, as (…, det_row, b): the detector rows a voxel falls on."""
    n, r = model.sinogram_shape[1], model.radii()[0]
    v = model.vertical()
    x = rows.select("*", *(c.alias(k) for k, c in v.items()))
    x = x.withColumn("_o", F.explode(F.sequence(F.lit(-r), F.lit(r)))).withColumn("det_row", F.col("_o") + F.rint("m_p").cast("int"))
    return x.where((F.col("det_row") >= 0) & (F.col("det_row") < n)).withColumn("b", _row_tap()).where("b > 0").drop("m_p", "w_row", "factor", "_o")


def _row_tap():
    """b of a detector row, from m_p, w_row and factor."""
    return F.greatest(F.lit(0.0), F.least((F.col("w_row") + 1) / 2 - F.abs(F.col("m_p") - F.col("det_row")), F.least(F.lit(1.0), F.col("w_row")))) * F.col("factor")


def slice_taps(model, rows):
    """rows (view, pix, det_row, …) as (…, slice, b): the taps of `row_taps` from the other side, the voxels that fall on a detector row."""
    last, v, h = model.params["recon_shape"][2] - 1, model.vertical(), model.horizontal()
    views = [(*p, *(0.0,) * (3 - len(p))) for p in model.views]
    x = rows.select("*", *(F.lit([p[i] for p in views])[F.col("view")].alias(f"p{i}") for i in range(3)))
    # Never NULL and without a filter of their own, as the planner would carry such a filter down to every cell and tap and compute all this there.
    x = x.select("*", *(F.coalesce(h[k], F.lit(math.nan)).alias(k) for k in ("mag", "depth")))
    # m_p is linear in the slice, so its values at slices 0 and 1 say which slices come near; the taps themselves are computed slice by slice.
    x = x.withColumn("slice", F.lit(0)).withColumn("_m", v["m_p"]).withColumn("_half", (v["w_row"] + 1) / 2 + 1e-6)
    x = x.withColumn("slice", F.lit(1)).withColumn("_step", v["m_p"] - F.col("_m")).drop("slice")
    ends = [(F.col("det_row") + side * F.col("_half") - F.col("_m")) / F.col("_step") for side in (-1, 1)]
    level = F.abs("_step") < 1e-9
    x = x.withColumn("_lo", F.when(level, 0).otherwise(F.ceil(F.greatest(F.lit(0.0), F.least(F.lit(last + 1.0), F.least(*ends))))).cast("int"))
    x = x.withColumn("_hi", F.when(level, last).otherwise(F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(float(last)), F.greatest(*ends))))).cast("int"))
    x = x.withColumn("slice", F.explode(F.when(F.col("_lo") <= F.col("_hi"), F.sequence("_lo", "_hi")).otherwise(F.array().cast("array<int>"))))
    x = x.select(*rows.columns, "slice", *(c.alias(k) for k, c in v.items()))
    return x.where(F.abs(F.col("det_row") - F.rint("m_p")) <= model.radii()[0]).withColumn("b", _row_tap()).where("b > 0").drop("m_p", "w_row", "factor")


def _slices(model):
    return F.explode(F.sequence(F.lit(0), F.lit(model.params["recon_shape"][2] - 1)))


def _view_pixels(model, pix, views=None):
    """(view, pix, mag, depth, p0, p1, p2): what row taps need of a view and a pixel."""
    h = model.horizontal()
    x = with_views(model, pix.select(F.col("pix").cast("int").alias("pix")), views)
    return x.select("view", "pix", h["mag"].alias("mag"), h["depth"].alias("depth"), "p0", "p1", "p2")


def forward(model, volume, views=None):
    """A x: (view, det_row, channel, value) of the cells that some voxel of `volume` falls on."""
    pix = volume.select("pix").distinct()
    taps = channel_taps(model, pix, views)
    if model.vertical() is None:
        x = volume.join(taps.select("view", "pix", "channel", "a"), "pix")
        return x.groupBy("view", F.col("slice").cast("int").alias("det_row"), "channel").agg(F.sum(F.col("a") * F.col("value")).alias("value"))
    columns = row_taps(model, volume.join(_view_pixels(model, pix, views), "pix"))
    columns = columns.groupBy("view", "pix", "det_row").agg(F.sum(F.col("b") * F.col("value")).alias("value"))
    x = columns.join(taps.select("view", "pix", "channel", "a"), ["view", "pix"])
    return x.groupBy("view", "det_row", "channel").agg(F.sum(F.col("a") * F.col("value")).alias("value"))


def back(model, sino, pix, power=1, by_view=False):
    """A' y at the pixels of `pix`: (pix, slice, value); each factor of a tap to `power`; by_view keeps the views apart."""
    keys = (["view"] if by_view else []) + ["pix", "slice"]
    taps = channel_taps(model, pix)
    a = F.col("a") if power == 1 else F.pow("a", F.lit(float(power)))
    if model.vertical() is None:
        x = sino.join(taps.select("view", "pix", "channel", "a"), ["view", "channel"]).withColumn("slice", F.col("det_row"))
        return x.groupBy(*keys).agg(F.sum(a * F.col("value")).alias("value"))
    x = _dealt(model, sino).join(taps.select("view", "pix", "channel", "a"), ["view", "channel"])
    x = x.groupBy("deal", "view", "pix", "det_row").agg(F.sum(a * F.col("value")).alias("value"))
    b = F.col("b") if power == 1 else F.pow("b", F.lit(float(power)))
    return slice_taps(model, x).groupBy(*keys).agg(F.sum(b * F.col("value")).alias("value"))


# Detector rows in a band, and sums over channels that a task holds.
BAND, HELD = 16, 250_000


def _dealt(model, sino):
    """sino's cells on the detector with `deal`, a band of rows (of some of the views): a task has whole deals, so it sums over channels without another exchange, and what it gives to a voxel is nearly summed."""
    n_views, n, _ = model.sinogram_shape
    rows, cols, _ = model.params["recon_shape"]
    bands, tasks = -(-n // BAND), min(10_000, -(-n_views * n * rows * cols // HELD))
    apart = min(n_views, -(-4 * tasks // bands))
    row = F.coalesce(F.col("det_row").cast("int"), F.lit(-1))
    deal = F.coalesce((F.floor(row / BAND) * apart + F.col("view") % apart).cast("int"), F.lit(-1))
    first = F.floor(F.col("id") / apart) * BAND
    known = sino.sparkSession.range(bands * apart).select(F.col("id").cast("int").alias("deal"), first.alias("_first"), F.least(first + BAND, F.lit(n)).alias("_end"))
    # Both are dealt out alike, so that the merge moves nothing; only columns of cells and of deals are moved, never voxels.
    x = sino.select("view", row.alias("det_row"), "channel", "value", deal.alias("deal")).repartition(tasks, "deal")
    x = x.join(known.repartition(tasks, "deal").hint("merge"), "deal")
    return x.where((F.col("det_row") >= F.col("_first")) & (F.col("det_row") < F.col("_end"))).drop("_first", "_end")


def grid(spark, model, pix=None):
    """(pix, slice) of the whole volume or of some pixels."""
    rows, cols, _ = model.params["recon_shape"]
    base = spark.range(rows * cols).select(F.col("id").cast("int").alias("pix")) if pix is None else pix.select("pix")
    return base.select("pix", _slices(model).alias("slice"))


def sino_grid(spark, model, value=1.0):
    """A sinogram of one value."""
    views, rows, channels = model.sinogram_shape
    i = F.col("id")
    return spark.range(views * rows * channels).select(F.floor(i / (rows * channels)).cast("int").alias("view"), F.floor(i / channels % rows).cast("int").alias("det_row"), (i % channels).cast("int").alias("channel"), F.lit(float(value)).alias("value"))


def constant_volume(spark, model, value):
    return grid(spark, model).withColumn("value", F.lit(float(value)))


def at_pixels(volume, pix):
    """The voxel columns of some pixels."""
    return volume.join(pix.select("pix").distinct(), "pix", "left_semi")


def forward_project(spark, model, volume):
    """A x over the whole sinogram, from the voxels inside the model's mask; cells no voxel falls on are 0."""
    model.verify()
    y = forward(model, at_pixels(volume, pixels(spark, model)))
    return _dense(sino_grid(spark, model, 0.0).drop("value"), y, ["view", "det_row", "channel"])


def back_project(spark, model, sino, power=1):
    """A' y over the whole volume; 0 outside the model's mask."""
    model.verify()
    return _dense(grid(spark, model), back(model, sino, pixels(spark, model), power), ["pix", "slice"])


def _dense(cells, values, keys):
    return cells.join(values, keys, "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def hessian_diagonal(spark, model, weights=None, pix=None):
    """(pix, slice, value): the diagonal of A' W A; weights 1 where none are given."""
    pix = pixels(spark, model) if pix is None else pix
    return _dense(grid(spark, model, pix), back(model, sino_grid(spark, model) if weights is None else weights, pix, 2), ["pix", "slice"])


def per_view_back(model, sino, pix):
    """(view, pix, slice, value): each view's own back projection."""
    return back(model, sino, pix, by_view=True)
