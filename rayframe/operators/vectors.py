"""Scanner vectors to parameters, and crops found in data."""
import math


def _dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def _cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def unit(v):
    n = math.sqrt(_dot(v, v))
    return tuple(x / n for x in v)


def onto(u, v):
    """u's projection on v."""
    k = _dot(u, v) / _dot(v, v)
    return tuple(k * x for x in v)


def _less(a, b):
    return tuple(x - y for x, y in zip(a, b))


def rotation(axis, normal, along, up):
    """Tilt of the axis against the detector's columns."""
    a = unit(_less(axis, onto(axis, normal)))
    return -math.atan(_dot(a, along) / _dot(a, up))


def distances(axis, normal, along, source, corner):
    """(source to detector, source to axis, magnification, tilt)."""
    n = unit(normal)
    sid = math.sqrt(_dot(*[onto(tuple(-x for x in source), n)] * 2))
    sdd = math.sqrt(_dot(*[onto(_less(corner, source), n)] * 2))
    return sdd, sid, sdd / sid, rotation(axis, n, along, _cross(n, along))


def offsets(axis, normal, along, source, corner, pitch_channel, pitch_row, channels, rows, magnification):
    """(channel offset, row offset) of the detector against the ray through the axis."""
    n, h = unit(normal), unit(along)
    v, ray = _cross(n, h), _less(corner, source)
    d = [a - b + (rows - 1) / 2 * pitch_row * c + (channels - 1) / 2 * pitch_channel * e for a, b, c, e in zip(ray, onto(ray, n), v, h)]
    return -_dot(d, h) + _dot(source, _cross(n, unit(axis))) * magnification, -_dot(d, v)


def blank_margins(sino, views, rows, channels, buffer=20, most=20):
    """(top, bottom, left, right) cells outside the object in all views, less a buffer."""
    from pyspark.sql import functions as F

    from rayframe.operators.regularise import indicator, subsample_views

    x = indicator(subsample_views(sino, views, most)).where("inside")
    a, b, c, d = x.agg(F.min("det_row"), F.max("det_row"), F.min("channel"), F.max("channel")).first()
    if a is None:
        return 0, 0, 0, 0
    return tuple(max(0, w - buffer) for w in (a, rows - 1 - b, c, channels - 1 - d))


def auto_crop(sino, required, optional, buffer=20):
    """(sinogram, required, optional) without blank margins."""
    from pyspark.sql import functions as F

    from rayframe.geometry import detector_crop

    views, rows, channels = required["sinogram_shape"]
    t, b, l, r = blank_margins(sino, views, rows, channels, buffer)
    x = sino.where((F.col("det_row") >= t) & (F.col("det_row") < rows - b) & (F.col("channel") >= l) & (F.col("channel") < channels - r))
    x = x.withColumn("det_row", F.col("det_row") - t).withColumn("channel", F.col("channel") - l)
    return (x, *detector_crop(required, optional, t, b, l, r))


def translations(positions):
    """(view, t_x, t_y, t_z): how far each of the object's places (x, y, z) lies from the middle of all."""
    from pyspark.sql import functions as F

    r = positions.agg(*(((F.max(c) + F.min(c)) / 2).alias(c) for c in "xyz")).first()
    return positions.select("view", *((F.lit(float(r[c])) - F.col(c)).alias(f"t_{c}") for c in "xyz"))


def shadow_weights(blank, views, share=0.6, buffer=20):
    """(view, det_row, channel, value): 0 where the blank scan is dark, and near there (in steps along rows and channels); else 1. Dark cells are few, and each marks a diamond."""
    from pyspark.sql import functions as F

    middle = blank.agg(F.median("value")).first()[0]
    dark = blank.where(F.col("value") < share * middle)
    steps = F.explode(F.sequence(F.lit(-buffer), F.lit(buffer)))
    near = dark.select("det_row", "channel", steps.alias("_a")).withColumn("_b", F.explode(F.sequence(F.abs("_a") - buffer, buffer - F.abs("_a"))))
    near = near.select((F.col("det_row") + F.col("_a")).alias("det_row"), (F.col("channel") + F.col("_b")).alias("channel"), F.lit(0.0).alias("_z")).distinct()
    flat = blank.select("det_row", "channel").join(near, ["det_row", "channel"], "left").select("det_row", "channel", F.coalesce("_z", F.lit(1.0)).alias("value"))
    return flat.withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(views - 1)))).select("view", "det_row", "channel", "value")
