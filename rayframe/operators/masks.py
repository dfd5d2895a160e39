"""Masks, pixel sets and their partitions."""
from pyspark.sql import functions as F


def _grid(spark, recon_shape):
    rows, cols = recon_shape[:2]
    i = F.col("id")
    return spark.range(rows * cols).select(i.cast("int").alias("pix"), F.floor(i / cols).cast("int").alias("row"), (i % cols).cast("int").alias("col"))


def ror(spark, recon_shape, mask=True, crop_pixels=0, crop_fraction=0.0):
    """(pix, row, col, inside): the ellipse that fits the pixel grid, less a crop; all pixels for False; else a DataFrame (row, col, inside) of 0 and 1."""
    if crop_pixels and crop_fraction or (mask is not True and (crop_pixels or crop_fraction)):
        raise ValueError("give one crop, and only with the standard mask")
    g = _grid(spark, recon_shape)
    if mask is False:
        return g.withColumn("inside", F.lit(True))
    if mask is not True:
        own = mask.select("row", "col", F.col("inside").cast("int").alias("_in"))
        if not own.where("_in IS NULL OR _in NOT IN (0, 1)").isEmpty() or own.count() != recon_shape[0] * recon_shape[1]:
            raise ValueError("a mask has 0 or 1 for every pixel")
        return g.join(own, ["row", "col"]).select("pix", "row", "col", (F.col("_in") == 1).alias("inside"))
    centre = [(n - 1) / 2 for n in recon_shape[:2]]
    radius = [c - max(int(c * crop_fraction), crop_pixels, 0) for c in centre]
    r2 = F.pow((F.col("col") - centre[1]) / radius[1], 2) + F.pow((F.col("row") - centre[0]) / radius[0], 2)
    return g.withColumn("inside", r2 <= 1.0)


def full_indices(spark, recon_shape, mask=True):
    """(pix) inside the mask."""
    return ror(spark, recon_shape, mask).where("inside").select("pix")


def cylinder(volume, recon_shape, radial_margin=0, top_margin=0, bottom_margin=0):
    """volume with 0 outside a cylinder and in margins of slices."""
    rows, cols, slices = recon_shape
    row, col = F.floor(F.col("pix") / cols), F.col("pix") % cols
    centre = (rows - 1) / 2, (cols - 1) / 2
    inside = F.pow(row - centre[0], 2) + F.pow(col - centre[1], 2) <= float((max(centre) - radial_margin) ** 2)
    return volume.withColumn("value", F.when(inside & (F.col("slice") >= top_margin) & (F.col("slice") < slices - bottom_margin), F.col("value")).otherwise(0.0))


def _order(seed):
    """A seeded order of pixels that any engine can repeat: multiplication modulo a power of two."""
    return (F.col("pix").cast("long") * 2654435761 + F.lit(seed).cast("long") * 40503) % 4294967296


def partition(spark, recon_shape, subsets, mask=True, seed=0):
    """(pix, subset): subsets of equal size in a seeded order; the last is filled up with pixels of the others.

    Ranks come by hash ranges, without moving all pixels to one task: counts of a fixed
    number of ranges are summed first, then rows are ranked inside theirs.
    """
    from pyspark.sql import Window

    inside = full_indices(spark, recon_shape, mask).withColumn("h", _order(seed))
    n = inside.count()
    subsets = min(subsets, n)
    if subsets == 1:
        return inside.select("pix", F.lit(0).alias("subset"))
    size = -(-n // subsets)
    ranges = 64
    x = inside.withColumn("part", F.floor(F.col("h") * ranges / 4294967296).cast("int"))
    counts = {r.part: r.n for r in x.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, at = [], 0
    for i in range(ranges):
        before.append(at)
        at += counts.get(i, 0)
    rank = F.element_at(F.lit(before), F.col("part") + 1) + F.row_number().over(Window.partitionBy("part").orderBy("h", "pix")) - 1
    x = x.withColumn("rank", rank)
    # The first pixels of the order stand in the other subsets and fill up the last.
    extra = x.where(F.col("rank") < subsets * size - n).select("pix", F.lit(subsets - 1).alias("subset"))
    return x.select("pix", F.least(F.floor(F.col("rank") / size), F.lit(subsets - 1)).cast("int").alias("subset")).unionByName(extra)


def partitions(spark, recon_shape, granularity, mask=True):
    """One partition for each number of subsets: (granularity, pix, subset)."""
    out = None
    for g, n in enumerate(granularity):
        p = partition(spark, recon_shape, n, mask, g).select(F.lit(g).alias("granularity"), "pix", "subset")
        out = p if out is None else out.unionByName(p)
    return out


def partition_sequence(sequence, iterations):
    """The sequence, cut or continued with its last entry."""
    sequence = list(sequence)
    return (sequence + [sequence[-1]] * max(0, iterations - len(sequence)))[:iterations]


def bands(extent, size):
    """Near-equal (first, past the last) bands of at most `size`."""
    n = -(-extent // size)
    return shard_ranges(extent, n)


def shard_ranges(extent, parts):
    """(first, past the last) of contiguous parts, the longer ones first."""
    base, more = divmod(extent, parts)
    out, at = [], 0
    for i in range(parts):
        out.append((at, at + base + (i < more)))
        at = out[-1][1]
    return out
