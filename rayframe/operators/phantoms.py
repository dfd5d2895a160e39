"""Test volumes, made from ranges of voxel ids: (pix, slice, value)."""
from pyspark.sql import Window
from pyspark.sql import functions as F

# x0, y0, z0, semi-axes a, b, c, rotation in degrees, intensity of the nine ellipsoids of the low-contrast head.
ELLIPSOIDS = [
    (0.0, 0.0, 0.0, 0.69, 0.92, 0.9, 0.0, 1.0), (0.0, 0.0184, 0.0, 0.6624, 0.874, 0.88, 0.0, -0.8),
    (0.22, 0.0, 0.0, 0.41, 0.16, 0.21, 108.0, -0.2), (-0.22, 0.0, 0.0, 0.31, 0.11, 0.22, 72.0, -0.2),
    (0.0, 0.35, 0.0, 0.21, 0.25, 0.5, 0.0, 0.1), (0.0, 0.1, 0.0, 0.046, 0.046, 0.046, 0.0, 0.1),
    (0.0, -0.1, 0.0, 0.046, 0.046, 0.046, 0.0, 0.1), (-0.08, -0.605, 0.0, 0.046, 0.023, 0.02, 0.0, 0.1),
    (0.0, -0.605, 0.0, 0.023, 0.023, 0.02, 0.0, 0.1),
]
# The same for the classic head: x0, y0, z0, a, b, c, rotation in degrees, intensity.
CLASSIC = [
    (0.0, 0.0, 0.0, 0.69, 0.92, 0.9, 0.0, 2.0), (0.0, 0.0, 0.0, 0.6624, 0.874, 0.88, 0.0, -0.98),
    (-0.22, 0.0, -0.25, 0.41, 0.16, 0.21, 108.0, -0.02), (0.22, 0.0, -0.25, 0.31, 0.11, 0.22, 72.0, -0.02),
    (0.0, 0.35, -0.25, 0.21, 0.25, 0.5, 0.0, 0.02), (0.0, 0.1, -0.25, 0.046, 0.046, 0.046, 0.0, 0.02),
    (-0.08, -0.65, -0.25, 0.046, 0.023, 0.02, 0.0, 0.01), (0.06, -0.65, -0.25, 0.046, 0.023, 0.02, 90.0, 0.01),
    (0.06, -0.105, 0.625, 0.056, 0.04, 0.1, 90.0, 0.02), (0.0, 0.1, 0.625, 0.056, 0.056, 0.1, 0.0, -0.02),
]


def voxels(spark, shape):
    """(pix, row, col, slice) of all voxels."""
    rows, cols, slices = shape
    i = F.col("id")
    pix = F.floor(i / slices)
    return spark.range(rows * cols * slices).select(pix.cast("int").alias("pix"), F.floor(pix / cols).cast("int").alias("row"), (pix % cols).cast("int").alias("col"), (i % slices).cast("int").alias("slice"))


def _axis(index, n):
    """From -1 to 1 over n points."""
    return F.col(index) * (2.0 / (n - 1)) - 1.0


def inside_ellipsoid(x, y, z, x0, y0, z0, a, b, c, degrees=0.0):
    """Column: in an ellipsoid that is turned about z."""
    turn = F.radians(F.lit(float(degrees)))
    dx, dy = x - x0, y - y0
    u, v = F.cos(turn) * dx + F.sin(turn) * dy, F.cos(turn) * dy - F.sin(turn) * dx
    return F.pow(u / a, 2) + F.pow(v / b, 2) + F.pow((z - z0) / c, 2) <= 1.0


def inside_turned_ellipsoid(x, y, z, x0, y0, z0, a, b, c, alpha=0.0, beta=0.0, gamma=0.0):
    """Column: in an ellipsoid turned about z by gamma, then y by beta, then x by alpha (radians)."""
    import numpy as np

    def about(axis, angle):
        m, (i, j) = np.eye(3), [k for k in range(3) if k != axis]
        m[i, i] = m[j, j] = np.cos(-angle)
        m[i, j], m[j, i] = (-np.sin(-angle), np.sin(-angle)) if axis != 1 else (np.sin(-angle), -np.sin(-angle))
        return m

    r = about(0, alpha) @ about(1, beta) @ about(2, gamma)
    d = (x - x0, y - y0, z - z0)
    parts = [F.pow(sum((d[j] * float(r[i, j]) for j in (1, 2)), d[0] * float(r[i, 0])) / s, 2) for i, s in enumerate((a, b, c))]
    return parts[0] + parts[1] + parts[2] <= 1.0


def add_ellipsoid(volume, shape, *ellipsoid, intensity=1.0):
    """volume with `intensity` added inside an ellipsoid of coordinates -1 to 1."""
    rows, cols, slices = shape
    row, col = F.floor(F.col("pix") / cols), F.col("pix") % cols
    x, y, z = row * (2.0 / (rows - 1)) - 1, col * (2.0 / (cols - 1)) - 1, F.col("slice") * (2.0 / (slices - 1)) - 1
    return volume.withColumn("value", F.col("value") + F.when(inside_ellipsoid(x, y, z, *ellipsoid), float(intensity)).otherwise(0.0))


def attenuation_scale(shape, target):
    """Factor by which the head's longest path attenuates by `target`."""
    return target / max(s * n for s, n in zip(ELLIPSOIDS[0][3:6], shape)) / 0.28


def head(spark, shape, target=None, slices=None):
    """The low-contrast head; of a (first, past the last) range of slices if given."""
    g = voxels(spark, shape)
    g = g if slices is None else g.where((F.col("slice") >= slices[0]) & (F.col("slice") < slices[1]))
    x, y, z = _axis("row", shape[0]), _axis("col", shape[1]), _axis("slice", shape[2])
    k = 1.0 if target is None else attenuation_scale(shape, target)
    value = F.lit(0.0)
    for *e, v in ELLIPSOIDS:
        value = value + F.when(inside_ellipsoid(x, y, z, *e), v).otherwise(0.0)
    return g.select("pix", "slice", (value * k).alias("value"))


def classic_head(spark, shape):
    """The classic head: x along columns, y down the rows from 1 to -1."""
    import math

    g = voxels(spark, shape)
    x, y, z = _axis("col", shape[1]), -_axis("row", shape[0]), _axis("slice", shape[2])
    value = F.lit(0.0)
    for *e, angle, v in CLASSIC:
        value = value + F.when(inside_turned_ellipsoid(x, y, z, *e, gamma=math.radians(angle)), v).otherwise(0.0)
    return g.select("pix", "slice", value.alias("value"))


def cube(spark, shape):
    """A quarter-size cube that moves along the columns with the slice."""
    rows, cols, slices = shape
    h, w = rows // 4, cols // 4
    first = (cols - w) // 2 + F.floor(F.col("slice") * w / slices)
    at = (F.col("row") >= (rows - h) // 2) & (F.col("row") < (rows + h) // 2) & (F.col("col") >= first) & (F.col("col") < first + (cols + w) // 2 - (cols - w) // 2)
    return voxels(spark, shape).select("pix", "slice", F.when(at, 1.0 / max(h, w)).otherwise(0.0).alias("value"))


def dots(spark, shape, fill=0.05, seed=42):
    """As many ones in each central row, at places in a seeded order."""
    rows, cols, slices = shape
    n, pad = int(cols * slices * fill), rows // 6
    g = voxels(spark, shape)
    order = Window.partitionBy("row").orderBy(F.xxhash64("pix", "slice", F.lit(seed)), "pix", "slice")
    central = (F.col("row") >= pad) & (F.col("row") < rows - pad)
    return g.withColumn("k", F.row_number().over(order)).select("pix", "slice", F.when(central & (F.col("k") <= n), 1.0).otherwise(0.0).alias("value"))


def translation_phantom(spark, shape, option="dots", fill=0.05):
    if option != "dots":
        raise ValueError("dots is the only phantom for translation scans")
    return dots(spark, shape, fill)


def demo(spark, kind="parallel", views=64, rows=96, channels=128, thing="shepp-logan", elevation_degrees=20.0, pitch=None, z_range=None, translations=(7, 7, 22.0, 22.0), target=None, **params):
    """(phantom, sinogram, model) of an example scan."""
    import math

    from rayframe import geometry
    from rayframe.operators import project

    if kind == "translation":
        sid = min(rows, channels) / 2
        v = geometry.translation_vectors(*translations)
        model = geometry.make(kind, (len(v), rows, channels), translations=v, source_detector_dist=sid, source_iso_dist=sid, **params)
    elif kind == "multiaxis_parallel":
        v = [(math.pi * i / views, math.radians(elevation_degrees)) for i in range(views)]
        model = geometry.make(kind, (views, rows, channels), v, **params)
    elif kind == "parallel":
        model = geometry.make(kind, (views, rows, channels), [math.pi * i / views for i in range(views)], **params)
    else:
        sdd, shifts, turn = 4.0 * channels, None, 2 * math.pi / views
        if pitch is not None:
            shifts = [z_range * (i / (views - 1) - 0.5) for i in range(views)]
            turn *= z_range / (pitch * rows / 2) if z_range else 1.0
        model = geometry.make(kind, (views, rows, channels), [-math.pi + turn * i for i in range(views)], sdd, sdd / 2, shifts, **params)
    shape = model.params["recon_shape"]
    first, last = geometry.helical_slices(model, pitch) if pitch is not None else (0, shape[2])
    inner = (*shape[:2], last - first)
    if kind == "translation":
        volume = dots(spark, inner)
    else:
        volume = cube(spark, inner) if thing == "cube" else head(spark, inner, target)
    volume = volume.withColumn("slice", F.col("slice") + first)
    volume = project._dense(project.grid(spark, model), volume, ["pix", "slice"])
    return volume, project.forward_project(spark, model, volume), model
