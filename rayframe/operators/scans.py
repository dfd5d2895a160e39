"""From scans to sinograms: reference means, transmission, invalid cells, cuts, shifts.

Scans and sinograms are (view, det_row, channel, value); NULL marks an invalid cell.
"""
from pyspark.sql import Window
from pyspark.sql import functions as F

CELL = ["view", "det_row", "channel"]


def finite(value):
    """value, NULL where it is NaN or infinite."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def normalised(value, top=None):
    """Counts as a share of their type's greatest value (`top`); others as they are."""
    return value.cast("double") if top is None else value.cast("double") / float(top)


def mean_scan(scan):
    """(det_row, channel, value): the mean over a reference scan's views."""
    return scan.groupBy("det_row", "channel").agg(F.avg("value").alias("value"))


def transmission(obj, blank, dark):
    """Column -ln(|obj - dark| / |blank - dark|); NULL where the ratio is not above 0 or no number."""
    ratio = F.try_divide(F.abs(obj - dark), F.abs(blank - dark))
    return F.when(ratio > 0, -F.ln(ratio))


def sino_transmission(obj, blank, dark, defects=None, passes=3):
    """A sinogram from an object scan and its references; defects are (det_row, channel)."""
    refs = mean_scan(blank).withColumnRenamed("value", "_b").join(mean_scan(dark).withColumnRenamed("value", "_d"), ["det_row", "channel"])
    x = obj.join(refs, ["det_row", "channel"]).select(*CELL, transmission(F.col("value"), F.col("_b"), F.col("_d")).alias("value"))
    return fill(mark(x, defects), passes)


def mark(sino, cells, value=None):
    """sino with a value (NULL by default) in the listed (det_row, channel) cells of every view."""
    if cells is None:
        return sino
    listed = cells.select("det_row", "channel").distinct().withColumn("_hit", F.lit(True))
    return sino.join(listed, ["det_row", "channel"], "left").select(*CELL, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col("value")).alias("value"))


def _box(sino, value, name):
    """sino with the sum of `value` over each 3 x 3 box of a view, 0 beyond the edges; whole grids."""
    down = Window.partitionBy("view", "channel").orderBy("det_row").rowsBetween(-1, 1)
    along = Window.partitionBy("view", "det_row").orderBy("channel").rowsBetween(-1, 1)
    return sino.withColumn(name, F.sum(value).over(down)).withColumn(name, F.sum(name).over(along))


def box_sum(sino):
    return _box(sino, F.coalesce("value", F.lit(0.0)), "box").select(*CELL, F.col("box").alias("value"))


def fill_pass(sino):
    """NULL cells become the mean of their 3 x 3 box's other cells, where there is one; cells may be missing."""
    holes = sino.where("value is null").select(*CELL).distinct()
    step = lambda: F.explode(F.array(*map(F.lit, (-1, 0, 1))))
    near = holes.withColumn("_r", step()).select("*", step().alias("_c"))
    near = near.select(*(F.col(k).alias(f"_{k}") for k in CELL), "view", (F.col("det_row") + F.col("_r")).alias("det_row"), (F.col("channel") + F.col("_c")).alias("channel"))
    means = near.join(sino.where("value is not null"), CELL).groupBy(*(F.col(f"_{k}").alias(k) for k in CELL)).agg(F.avg("value").alias("_m"))
    return sino.join(means, CELL, "left").select(*CELL, F.coalesce("value", "_m").alias("value"))


def fill(sino, passes=3):
    """NULL cells filled from the rim inwards, a cell's width a pass; what is left becomes 0.

    Views are independent: each is filled as one small array in an Arrow kernel, so the
    passes cost one exchange and not two windows each.
    """

    def run(_, table):
        import numpy as np
        import pyarrow as pa

        v, r, c = (table.column(k).to_numpy() for k in CELL)
        x = table.column("value").to_numpy(zero_copy_only=False).astype("f8")
        r0, c0 = r.min(), c.min()
        grid = np.full((r.max() - r0 + 3, c.max() - c0 + 3), np.nan)
        at = r - r0 + 1, c - c0 + 1
        grid[at] = np.where(np.isfinite(x), x, np.nan)
        for _ in range(passes):
            ok = np.isfinite(grid)
            if ok[at].all():
                break
            value, number = np.where(ok, grid, 0.0), ok.astype("f8")
            for a in (0, 1):
                value, number = (sum(np.roll(y, s, a) for s in (-1, 0, 1)) for y in (value, number))
            new = np.full_like(grid, np.nan)
            new[at] = np.where(number[at] > 0, value[at] / np.maximum(number[at], 1), np.nan)
            grid = np.where(ok, grid, new)
        out = np.nan_to_num(grid[at], nan=0.0)
        return pa.table({"view": pa.array(v, pa.int32()), "det_row": pa.array(r, pa.int32()), "channel": pa.array(c, pa.int32()), "value": out})

    x = sino.select(*(F.col(k).cast("int").alias(k) for k in CELL), F.col("value").cast("double").alias("value"))
    return x.groupBy("view").applyInArrow(run, "view int, det_row int, channel int, value double")


def interpolate_defects(sino, defects=None, passes=3):
    """Defects and cells that are no numbers, filled."""
    return fill(mark(sino.withColumn("value", finite(F.col("value"))), defects), passes)


def fill_zingers(sino, threshold, passes=3):
    """Cells under a threshold and those that are no numbers, filled."""
    value = finite(F.col("value"))
    return fill(sino.withColumn("value", F.when(value >= float(threshold), value)), passes)


def correct_zingers(sino, views, ratio=0.1, passes=3, most_views=20):
    from rayframe.operators.regularise import zinger_threshold

    return fill_zingers(sino, zinger_threshold(sino, views, ratio, most_views), passes)


# Cuts and blocks -------------------------------------------------------------------
def crop(scan, rows, channels, top=0, bottom=0, sides=0):
    """A scan's inner cells, counted from 0 again."""
    if min(top, bottom, sides) < 0 or top + bottom >= rows or 2 * sides >= channels:
        raise ValueError("the cut leaves no detector")
    inner = (F.col("det_row") >= top) & (F.col("det_row") < rows - bottom) & (F.col("channel") >= sides) & (F.col("channel") < channels - sides)
    return scan.where(inner).withColumn("det_row", F.col("det_row") - top).withColumn("channel", F.col("channel") - sides)


def crop_scans(obj, blank, dark, rows, channels, top=0, bottom=0, sides=0, defects=None):
    """The three scans and the list of defects after a cut."""
    return tuple(x if x is None else crop(x, rows, channels, top, bottom, sides) for x in (obj, blank, dark, defects))


def downsample(scan, rows, channels, factor, defects=None):
    """Means of blocks of cells that are no defects; cells that make no whole block are left out; NULL for a block without a value."""
    f, g = factor
    if min(f, g) < 1:
        raise ValueError("a factor is 1 at least")
    x = mark(scan, defects).where((F.col("det_row") < rows // f * f) & (F.col("channel") < channels // g * g))
    keys = F.floor(F.col("det_row") / f).cast("int").alias("det_row"), F.floor(F.col("channel") / g).cast("int").alias("channel")
    return x.groupBy("view", *keys).agg(F.avg("value").alias("value"))


def downsample_scans(obj, blank, dark, rows, channels, factor, defects=None):
    """The three scans on the coarser grid, and its defects: blocks of the blank scan without a value."""
    small = [downsample(x, rows, channels, factor, defects) for x in (obj, blank, dark)]
    return (*small, small[1].where("value IS NULL").select("det_row", "channel").distinct())


def scan_to_sino(obj, blank, dark, rows, channels, defects=None, factor=(1, 1), rotation=0.0):
    """Coarser grid, transmission, rotation, as one plan."""
    if factor != (1, 1):
        obj, blank, dark, defects = downsample_scans(obj, blank, dark, rows, channels, factor, defects)
        rows, channels = rows // factor[0], channels // factor[1]
    sino = sino_transmission(obj, blank, dark, defects)
    return rotate(sino, rows, channels, rotation) if rotation else sino


# Moves -----------------------------------------------------------------------------
def _sample(sino, rows, channels, src_row, src_channel):
    """Bilinear samples of each view at (src_row, src_channel), Columns of a cell and its view; 0 outside.

    A cell gathers from four others: it is sent to them by an equi-join on view and cell.
    """
    cells = sino.select(*CELL, src_row.alias("_r"), src_channel.alias("_c"))
    cells = cells.where((F.col("_r") >= 0) & (F.col("_r") <= rows - 1) & (F.col("_c") >= 0) & (F.col("_c") <= channels - 1))
    corner = lambda name, up: (F.ceil(name) if up else F.floor(name)).cast("int")
    weight = lambda name, up: F.col(name) - F.floor(name) if up else 1.0 - (F.col(name) - F.floor(name))
    four = F.array(*(F.struct(corner("_r", i).alias("r"), corner("_c", j).alias("c"), (weight("_r", i) * weight("_c", j)).alias("w")) for i in (0, 1) for j in (0, 1)))
    x = cells.select(*CELL, F.explode(four).alias("t")).where("t.w > 0").select(*CELL, F.col("t.r").alias("_sr"), F.col("t.c").alias("_sc"), F.col("t.w").alias("_w"))
    src = sino.select("view", F.col("det_row").alias("_sr"), F.col("channel").alias("_sc"), F.col("value").alias("_v"))
    out = x.join(src, ["view", "_sr", "_sc"]).groupBy(*CELL).agg(F.sum(F.col("_w") * F.col("_v")).alias("value"))
    return sino.select(*CELL).join(out, CELL, "left").select(*CELL, F.coalesce("value", F.lit(0.0)).alias("value"))


def rotate(sino, rows, channels, angle):
    """Every view turned about the detector's centre."""
    import math

    c, s, r0, c0 = math.cos(angle), math.sin(angle), (rows - 1) / 2, (channels - 1) / 2
    i, j = F.col("det_row"), F.col("channel")
    return _sample(sino, rows, channels, c * i + s * j + (r0 - (c * r0 + s * c0)), -s * i + c * j + (c0 - (-s * r0 + c * c0)))


def shift(sino, rows, channels, shifts):
    """Every view moved by its (view, d_row, d_channel)."""
    x = sino.join(F.broadcast(shifts) if shifts.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1" else shifts, "view")
    return _sample(x, rows, channels, F.col("det_row") - F.col("d_row"), F.col("channel") - F.col("d_channel"))


def shift_padded(sino, rows, channels, shifts):
    """The same with the edge cells repeated outward, so that no zeros come in."""
    x = sino.join(shifts, "view")
    row = F.greatest(F.lit(0.0), F.least(F.lit(float(rows - 1)), F.col("det_row") - F.col("d_row")))
    channel = F.greatest(F.lit(0.0), F.least(F.lit(float(channels - 1)), F.col("channel") - F.col("d_channel")))
    return _sample(x, rows, channels, row, channel)


# Offsets ---------------------------------------------------------------------------
def background_offsets(sino, channels, edge=9):
    """(view, offset): the median of the medians of the left, right and top edge strips."""
    strips = [F.col("channel") < edge, F.col("channel") >= channels - edge, F.col("det_row") < edge]
    m = sino.groupBy("view").agg(*(F.median(F.when(s, F.col("value"))).alias(f"m{i}") for i, s in enumerate(strips)))
    middle = F.array_sort(F.array("m0", "m1", "m2"))[1]
    return m.select("view", middle.alias("offset"))


def correct_background(sino, channels, edge=9, option="global"):
    """The sinogram less its background: the tenth percentile of the views' offsets, or each view's own; None leaves it as it is."""
    if option is None:
        return sino
    if option not in ("global", "per_view"):
        raise ValueError("option is None, 'global' or 'per_view'")
    offsets = background_offsets(sino, channels, max(1, edge))
    if option == "per_view":
        return sino.join(offsets, "view").select(*CELL, (F.col("value") - F.col("offset")).alias("value"))
    return sino.withColumn("value", F.col("value") - F.lit(offsets.agg(F.percentile("offset", F.lit(0.1))).first()[0]))


def remove_offset(sino):
    """Each detector row's mean over channels made its least over the views."""
    mean = F.avg("value").over(Window.partitionBy("view", "det_row"))
    x = sino.withColumn("_m", mean)
    return x.select(*CELL, (F.col("value") - F.col("_m") + F.min("_m").over(Window.partitionBy("det_row"))).alias("value"))


def gaussian(sigma):
    """Taps of a Gaussian over three (four for wide ones) deviations, as image libraries size it for floats."""
    import math

    n = (round(sigma * 8 + 1) | 1) // 2
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-n, n + 1)]
    return [x / sum(w) for x in w]


def high_pass(sino, sigma_row=3.0, sigma_channel=15.0, less_mean=True):
    """Each view less its mean and less its Gaussian blur, edges mirrored with the edge cell."""
    kernels = gaussian(sigma_row), gaussian(sigma_channel)

    def run(_, table):
        import numpy as np
        import pyarrow as pa

        v, r, c = (table.column(k).to_numpy() for k in CELL)
        x = np.zeros((r.max() + 1, c.max() + 1))
        x[r, c] = table.column("value").to_numpy()
        y = x - x.mean() if less_mean else x
        low = y
        for axis, k in enumerate(kernels):
            n = len(k) // 2
            padded = np.pad(low, [(n, n) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
            low = sum(w * np.take(padded, np.arange(i, i + x.shape[axis]), axis) for i, w in enumerate(k))
        return pa.table({"view": v, "det_row": r, "channel": c, "value": (y - low)[r, c]})

    x = sino.select(*(F.col(k).cast("int").alias(k) for k in CELL), F.col("value").cast("double").alias("value"))
    return x.groupBy("view").applyInArrow(run, "view int, det_row int, channel int, value double")


def view_offsets(sino, model_sino, rounds=50, tolerance=1e-6):
    """(view, d_row, d_channel): the shift that best lays each view on the model's, by Gauss-Newton steps on the correlation of high-passed views.

    A view moved by its shift (`shift`) lies on the model's.
    """
    x = high_pass(sino).withColumnRenamed("value", "y").join(high_pass(model_sino), CELL)

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        r, c = table.column("det_row").to_numpy(), table.column("channel").to_numpy()
        image, target = np.zeros((2, r.max() + 1, c.max() + 1))
        image[r, c], target[r, c] = table.column("y").to_numpy(), table.column("value").to_numpy()
        move = np.zeros(2)
        rows, cols = np.indices(image.shape)
        gr, gc = np.gradient(image)

        def sample(y):
            i, j = rows + move[0], cols + move[1]
            ok = (i >= 0) & (i <= image.shape[0] - 1) & (j >= 0) & (j <= image.shape[1] - 1)
            i, j = np.clip(i, 0, image.shape[0] - 1), np.clip(j, 0, image.shape[1] - 1)
            a, b = np.floor(i).astype(int), np.floor(j).astype(int)
            a1, b1, fa, fb = np.minimum(a + 1, image.shape[0] - 1), np.minimum(b + 1, image.shape[1] - 1), i - a, j - b
            return (1 - fa) * ((1 - fb) * y[a, b] + fb * y[a, b1]) + fa * ((1 - fb) * y[a1, b] + fb * y[a1, b1]), ok

        for _ in range(rounds):
            (w, ok), (wr, _), (wc, _) = sample(image), sample(gr), sample(gc)
            if ok.sum() < 4:
                break
            t = target[ok] - target[ok].mean()
            w = w[ok] - w[ok].mean()
            g = np.c_[wr[ok], wc[ok]]
            g = g - g.mean(0)
            h = g.T @ g
            if not np.linalg.det(h) > 1e-12 * max(1e-30, np.trace(h)) ** 2:
                break
            solve = np.linalg.solve(h, np.c_[g.T @ w, g.T @ t])
            # The gain that makes the correlation greatest along the step.
            up, down = w @ w - (g.T @ w) @ solve[:, 0], t @ w - (g.T @ t) @ solve[:, 0]
            gain = up / down if down > 0 else 1.0
            step = np.linalg.solve(h, g.T @ (gain * t - w))
            move += step
            if np.abs(step).max() < tolerance:
                break
        return pa.table({"view": pa.array([key[0].as_py()], pa.int32()), "d_row": [-move[0]], "d_channel": [-move[1]]})

    return x.groupBy("view").applyInArrow(run, "view int, d_row double, d_channel double")


def align(spark, model, sino, volume):
    """The views moved onto the projections of a reconstruction."""
    from rayframe.operators import project

    rows, channels = model.sinogram_shape[1:]
    return shift(sino, rows, channels, view_offsets(sino, project.forward_project(spark, model, volume)))
