"""Queries on generated volumes; those with an operator of their own run it, and the SQL is the oracle's.

Grids are fixed in size, so the joins of small series below have a bound. Stencils use
LAG and LEAD along one axis at a time; a missing neighbour is the voxel itself.
"""
from pyspark.sql import functions as F

from rayframe import geometry
from rayframe.operators import masks, phantoms, prior, regularise
from rayframe.operators.dialect import SPARK, queries

# x0, y0, z0, semi-axes a, b, c, rotation in degrees, intensity of the nine ellipsoids.
ELLIPSOIDS = """(0e0, 0e0, 0e0, 0.69e0, 0.92e0, 0.9e0, 0e0, 1e0), (0e0, 0.0184e0, 0e0, 0.6624e0, 0.874e0, 0.88e0, 0e0, -0.8e0),
 (0.22e0, 0e0, 0e0, 0.41e0, 0.16e0, 0.21e0, 108e0, -0.2e0), (-0.22e0, 0e0, 0e0, 0.31e0, 0.11e0, 0.22e0, 72e0, -0.2e0),
 (0e0, 0.35e0, 0e0, 0.21e0, 0.25e0, 0.5e0, 0e0, 0.1e0), (0e0, 0.1e0, 0e0, 0.046e0, 0.046e0, 0.046e0, 0e0, 0.1e0),
 (0e0, -0.1e0, 0e0, 0.046e0, 0.046e0, 0.046e0, 0e0, 0.1e0), (-0.08e0, -0.605e0, 0e0, 0.046e0, 0.023e0, 0.02e0, 0e0, 0.1e0),
 (0e0, -0.605e0, 0e0, 0.023e0, 0.023e0, 0.02e0, 0e0, 0.1e0)"""

_VOL = """WITH vol AS (SELECT CAST(a.id AS INT) AS r, CAST(b.id AS INT) AS c, CAST(d.id AS INT) AS s,
 ((a.id * 7 + b.id * 13 + d.id * 29) % 17) / 17e0 AS x FROM {series:12} a CROSS JOIN {series:12} b CROSS JOIN {series:6} d) """
_EPS = "1.1920928955078125e-7"
# Differences to the six neighbours; p = 2, q = 1.2, T = 1, sigma_x = 0.25, equal weights.
_NEAR = """, near AS (SELECT r, c, s, x, x - coalesce(lead(x) OVER (PARTITION BY c, s ORDER BY r), x) AS d1, x - coalesce(lag(x) OVER (PARTITION BY c, s ORDER BY r), x) AS d2,
 x - coalesce(lead(x) OVER (PARTITION BY r, s ORDER BY c), x) AS d3, x - coalesce(lag(x) OVER (PARTITION BY r, s ORDER BY c), x) AS d4,
 x - coalesce(lead(x) OVER (PARTITION BY r, c ORDER BY s), x) AS d5, x - coalesce(lag(x) OVER (PARTITION BY r, c ORDER BY s), x) AS d6 FROM vol) """


def _power(d):
    return f"power(greatest(abs({d}), 0.25e0 * {_EPS}) / 0.25e0, -0.8e0)"


def _twice_b_tilde(d):
    return f"(({_power(d)}) * (0.6e0 + {_power(d)}) / power(1e0 + {_power(d)}, 2) / power(0.25e0, 2) / 6e0)"


def _rho(d):
    return f"(power(greatest(abs({d}), 0.25e0 * {_EPS}), 2) / (2e0 * power(0.25e0, 2)) * {_power(d)} / (1e0 + {_power(d)}) / 6e0)"


_D = [f"d{i}" for i in range(1, 7)]
_BOX = "OVER (PARTITION BY c, s ORDER BY r ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
_CUBE = """, k AS (SELECT a.id - 1 AS i, b.id - 1 AS j, d.id - 1 AS l FROM {series:3} a CROSS JOIN {series:3} b CROSS JOIN {series:3} d),
 moved AS (SELECT v.r, v.c, v.s, greatest(0, least(11, v.r + k.i)) AS r2, greatest(0, least(11, v.c + k.j)) AS c2, greatest(0, least(5, v.s + k.l)) AS s2 FROM vol v CROSS JOIN k),
 n AS (SELECT m.r, m.c, m.s, v.x FROM moved m JOIN vol v ON v.r = m.r2 AND v.c = m.c2 AND v.s = m.s2) """

_BODIES = {
    "qggmrf_loss": _VOL + _NEAR + "SELECT round(sum(" + " + ".join(f"CASE WHEN {last} THEN 0e0 ELSE {_rho(d)} END" for d, last in (("d1", "r = 11"), ("d3", "c = 11"), ("d5", "s = 5"))) + "), 6) AS loss FROM near",
    "prox_gradient": _VOL + "SELECT r, c, s, round((x - ((r + c + s) % 5) / 5e0) / power(0.5e0, 2), 6) + 0e0 AS g FROM vol",
    "box_sum_3x3": _VOL + f", one AS (SELECT r, c, s, sum(x) {_BOX} AS y FROM vol) SELECT r, c, s, round(sum(y) OVER (PARTITION BY r, s ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS v FROM one",
    "median3d": _VOL + _CUBE + "SELECT r, c, s, round({median}, 6) AS med, round(min(x), 6) AS lo, round(max(x), 6) AS hi FROM n GROUP BY r, c, s",
    "image_ell1": _VOL + "SELECT round(sum(abs(x - 0.5e0)), 6) AS v FROM vol",
    "volume_difference": _VOL + ", w AS (SELECT r, c, s, ((r + c * 3 + s) % 5) / 5e0 AS y FROM vol) SELECT s, round(sqrt(avg((x - y) * (x - y))), 6) AS rmse, round(max(abs(x - y)), 6) AS worst FROM vol JOIN w USING (r, c, s) GROUP BY s",
    "roi_stats": _VOL + "SELECT s, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS lo, round(max(x), 6) AS hi FROM vol WHERE (r - 5) * (r - 5) + (c - 6) * (c - 6) <= 16 GROUP BY s",
    "data_range": _VOL + "SELECT round(min(x), 6) AS lo, round(max(x), 6) AS hi FROM vol",
    "ror_mask": _VOL + "SELECT r, c, power((c - 5.5e0) / 5.5e0, 2) + power((r - 5.5e0) / 5.5e0, 2) <= 1 AS inside FROM vol WHERE s = 0",
    "full_indices": _VOL + "SELECT r * 12 + c AS pix FROM vol WHERE s = 0 AND power((c - 5.5e0) / 5.5e0, 2) + power((r - 5.5e0) / 5.5e0, 2) <= 1",
    "argmin_3d": _VOL + "SELECT r, c, s, round(x, 6) AS v FROM vol ORDER BY x, r, c, s LIMIT 1",
    "scaling_factor": _VOL + "SELECT round(sum(x * ((r + c) % 3)) / (sum(x * x) + 1e-8), 6) AS k FROM vol",
    "segment_masks": _VOL + "SELECT r, c, s, CASE WHEN x <= 0.3e0 THEN 0 WHEN x <= 0.7e0 THEN 1 ELSE 2 END AS class FROM vol",
    "partition_sequence": "SELECT CAST(id AS INT) AS i, CASE id WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 6 ELSE 7 END AS granularity FROM {series:10}",
    "phantom_cube": "SELECT CAST(a.id AS INT) AS r, CAST(b.id AS INT) AS c, CAST(d.id AS INT) AS s, CASE WHEN a.id >= 6 AND a.id < 10 AND b.id >= 6 + floor(d.id * 4 / 8e0) AND b.id < 10 + floor(d.id * 4 / 8e0) THEN 0.25e0 ELSE 0e0 END AS v FROM {series:16} a CROSS JOIN {series:16} b CROSS JOIN {series:8} d",
    "phantom_shepp_logan": "WITH e(x0, y0, z0, a, b, c, t, v) AS (VALUES " + ELLIPSOIDS + """), g AS (SELECT a.id AS r, b.id AS c, d.id AS s, 2e0 * a.id / 15 - 1 AS x, 2e0 * b.id / 15 - 1 AS y, 2e0 * d.id / 7 - 1 AS z
 FROM {series:16} a CROSS JOIN {series:16} b CROSS JOIN {series:8} d),
 n AS (SELECT r, g.c AS col, s, e.v, cos(radians(t)) * (x - x0) + sin(radians(t)) * (y - y0) AS xr, cos(radians(t)) * (y - y0) - sin(radians(t)) * (x - x0) AS yr, z - z0 AS zr, a, b, e.c AS h FROM g CROSS JOIN e)
 SELECT CAST(r AS INT) AS r, CAST(col AS INT) AS c, CAST(s AS INT) AS s, round(sum(CASE WHEN power(xr / a, 2) + power(yr / b, 2) + power(zr / h, 2) <= 1 THEN v ELSE 0e0 END), 6) + 0e0 AS v FROM n GROUP BY 1, 2, 3""",
    "translation_grid": "SELECT CAST(z.id * 4 + x.id AS INT) AS view, (x.id - 1.5e0) * 3e0 AS tx, 0e0 AS ty, (z.id - 1.5e0) * 2e0 AS tz FROM {series:4} z CROSS JOIN {series:4} x",
    "support_radius": "SELECT CASE id WHEN 0 THEN greatest(0.5e0 * 12 * 1.5e0, 0.5e0 * 16 * 1e0) ELSE round(sqrt(power(0.5e0 * 12 * 1.5e0, 2) + power(0.5e0 * 16 * 1e0, 2)), 6) END AS radius, id = 0 AS masked FROM {series:2}",
    "stitch_blend": """WITH a AS (SELECT j.id AS j, k.id AS k, j.id * 5e0 + k.id AS v FROM {series:4} j CROSS JOIN {series:5} k),
 b AS (SELECT j.id AS j, k.id + 2 AS k, 100e0 + j.id * 6 + k.id AS v FROM {series:4} j CROSS JOIN {series:6} k),
 w AS (SELECT j, k, v, greatest(0e0, least(1e0, (4 - k) / 2e0)) AS w FROM a UNION ALL SELECT j, k, v, 1 - greatest(0e0, least(1e0, (4 - k) / 2e0)) FROM b)
 SELECT CAST(j AS INT) AS j, CAST(k AS INT) AS k, round(sum(v * w), 6) AS v FROM w GROUP BY 1, 2""",
}
QUERIES, SQL = queries(_BODIES)


def _vol(spark):
    """The generated volume as (pix, slice, value)."""
    return spark.sql((_VOL + "SELECT r * 12 + c AS pix, s AS slice, x AS value FROM vol").format(**SPARK))


def _rcs(df, cols=12, name="v", value="value", digits=6):
    r, c = F.floor(F.col("pix") / cols).cast("int").alias("r"), (F.col("pix") % cols).cast("int").alias("c")
    return df.select(r, c, F.col("slice").cast("int").alias("s"), (F.round(value, digits) + 0.0).alias(name))


def _stitched(spark, d):
    a = spark.range(20).selectExpr("cast(id div 5 AS int) AS j", "cast(id % 5 AS int) AS k", "cast(id AS double) AS value")
    b = spark.range(24).selectExpr("cast(id div 6 AS int) AS j", "cast(id % 6 AS int) AS k", "100D + id AS value")
    return regularise.stitch([a, b], [5, 6], "k", ["j"], 3).select("j", F.col("k").cast("int").alias("k"), F.round("value", 6).alias("v"))


def _target(spark):
    return _vol(spark).withColumn("value", (F.floor(F.col("pix") / 12) + F.col("pix") % 12 + F.col("slice")) % 5 / 5.0)


QUERIES |= {
    "qggmrf_loss": lambda spark, d: prior.loss(_vol(spark), 12, 0.25).select(F.round("loss", 6).alias("loss")),
    "prox_gradient": lambda spark, d: _rcs(prior.prox_gradient(_vol(spark), _target(spark), 0.5), name="g", value="gradient"),
    "ror_mask": lambda spark, d: masks.ror(spark, (12, 12, 6)).select(F.col("row").alias("r"), F.col("col").alias("c"), "inside"),
    "full_indices": lambda spark, d: masks.full_indices(spark, (12, 12, 6)),
    "partition_sequence": lambda spark, d: spark.createDataFrame(list(enumerate(masks.partition_sequence((2, 4, 6, 7), 10))), "i int, granularity int"),
    "phantom_cube": lambda spark, d: _rcs(phantoms.cube(spark, (16, 16, 8)), 16),
    "phantom_shepp_logan": lambda spark, d: _rcs(phantoms.head(spark, (16, 16, 8)), 16),
    "translation_grid": lambda spark, d: geometry.translation_grid(spark, 4, 4, 3.0, 2.0).select("view", F.col("t_x").alias("tx"), F.col("t_y").alias("ty"), F.col("t_z").alias("tz")),
    "support_radius": lambda spark, d: spark.createDataFrame([(round(geometry.support_radius((12, 16), 1.5, 1.0, m), 6), m) for m in (True, False)], "radius double, masked boolean"),
    "stitch_blend": _stitched,
    "scaling_factor": lambda spark, d: regularise.scaling_factor(_vol(spark).select(F.col("value").alias("v"), ((F.floor(F.col("pix") / 12) + F.col("pix") % 12) % 3).cast("double").alias("t"))).select(F.round("scale", 6).alias("k")),
    "argmin_3d": lambda spark, d: _vol(spark).agg(F.min(F.struct("value", "pix", "slice")).alias("m")).select(F.floor(F.col("m.pix") / 12).cast("int").alias("r"), (F.col("m.pix") % 12).cast("int").alias("c"), F.col("m.slice").alias("s"), F.round("m.value", 6).alias("v")),
}
