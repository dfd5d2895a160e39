"""Scanner queries over arrays bound to `lineitem`; Spark runs the operators, the oracle has SQL of its own.

The volume has 16 x 16 pixels and a slice for each 1024 order keys, the sinogram a
detector row for each; both grow with the table.
"""
import math

from pyspark.sql import functions as F

from rayframe import geometry
from rayframe.operators import denoise, filters, hardening, lines, masks, prior, project, recon, regularise, scans, spectral, views
from rayframe.sources.tables import table

SIZE, CHANNELS, VIEWS = 16, 20, 6
_VOLUME = f"SELECT CAST((l_partkey * 7 + l_suppkey * 13 + l_linenumber * 29) % {SIZE * SIZE} AS INT) AS pix, CAST(floor(l_orderkey / 1024.0) AS INT) AS slice, avg(l_extendedprice) / 50000 AS value FROM lineitem GROUP BY 1, 2"
_SINO = f"SELECT CAST(l_partkey % {VIEWS} AS INT) AS view, CAST(floor(l_orderkey / 1024.0) AS INT) AS det_row, CAST((l_suppkey * 3 + l_linenumber) % {CHANNELS} AS INT) AS channel, avg(l_extendedprice) / 50000 AS value FROM lineitem GROUP BY 1, 2, 3"
_N = "(SELECT CAST(max(slice) + 1 AS INT) AS n FROM vol)"


def volume(spark, d):
    table(spark, d, "lineitem")
    return spark.sql(_VOLUME)


def sino(spark, d):
    table(spark, d, "lineitem")
    return spark.sql(_SINO)


def _slices(spark, d):
    return table(spark, d, "lineitem").agg(F.max(F.floor(F.col("l_orderkey") / 1024))).first()[0] + 1


# The scanners, as models and as SQL: per view p0, p1, p2; h has n_p, width, scale, mag, depth; v has m_p, w_row, factor.
_ANGLE = "acos(-1e0) * v / 6"
_TURN = "cos(p0) * x - sin(p0) * y AS xr, sin(p0) * x + cos(p0) * y AS yr"
_FOOT = "greatest(abs(cos({a})), abs(sin({a})))"
SCANNERS = {
    "parallel": dict(p=(_ANGLE, "0e0", "0e0"), turn=_TURN, h="xr + 9.5e0 AS n_p, f AS width, 1e0 / f AS scale, 1e0 AS mag, 0e0 AS depth", foot=_FOOT.format(a="p0"), r=1),
    "cone": dict(p=(_ANGLE + " * 2", "0e0", "0e0"), turn=_TURN, h="u + 9.5e0 AS n_p, mag * f / cos(th) AS width, 1e0 / f AS scale, mag, yr AS depth", mag="1e0 / (0.5e0 - yr / 80e0)", u="mag * xr", th="atan2(u, 80e0)", foot=_FOOT.format(a="p0 - th"), z="slice - (n - 1) / 2e0 - p1", r=2),
    "curved": dict(p=(_ANGLE + " * 2", "0e0", "0e0"), turn=_TURN, h="u + 9.5e0 AS n_p, mag * f AS width, 1e0 / f AS scale, mag, yr AS depth", mag="1e0 / (0.5e0 - yr / 80e0)", th="atan2(xr, 40e0 - yr)", u="80e0 * atan2(xr, 40e0 - yr)", foot=_FOOT.format(a="p0 - th"), z="slice - (n - 1) / 2e0 - p1", r=2),
    "helical": dict(p=(_ANGLE + " * 2", "v - 2.5e0", "0e0"), turn=_TURN, h="u + 9.5e0 AS n_p, mag * f / cos(th) AS width, 1e0 / f AS scale, mag, yr AS depth", mag="1e0 / (0.5e0 - yr / 80e0)", u="mag * xr", th="atan2(u, 80e0)", foot=_FOOT.format(a="p0 - th"), z="slice - (n - 1) / 2e0 - p1", r=2),
    "translation": dict(p=("(v % 3 - 1e0) * 3e0", "0e0", "(floor(v / 3) - 0.5e0) * 2e0"), turn="x - p0 AS xr, y - p1 AS yr", h="u + 9.5e0 AS n_p, mag AS width, 1e0 / cos(th) AS scale, mag, yr AS depth", mag="1e0 / (0.5e0 - yr / 80e0)", u="mag * xr", th="atan2(u, 80e0)", foot="1e0", z="slice - (n - 1) / 2e0 - p2", r=2),
    "multiaxis": dict(p=(_ANGLE, "(v - 2.5e0) / 8e0", "0e0"), turn=_TURN, h="xr + 9.5e0 AS n_p, f AS width, 1e0 / f AS scale, 1e0 AS mag, yr AS depth", foot=_FOOT.format(a="p0"), z="slice - (n - 1) / 2e0", r=1),
}


def model(kind, n):
    shape, params = (VIEWS, n, CHANNELS), {"recon_shape": (SIZE, SIZE, n), "delta_voxel": 1.0}
    angles = [math.pi * i / VIEWS for i in range(VIEWS)]
    if kind == "parallel":
        return geometry.Parallel(shape, angles, params)
    if kind == "multiaxis":
        return geometry.MultiAxis(shape, [(a, (i - 2.5) / 8) for i, a in enumerate(angles)], params)
    params |= {"source_detector_dist": 80.0, "source_iso_dist": 40.0}
    if kind == "translation":
        return geometry.Translation(shape, geometry.translation_vectors(3, 2, 3.0, 2.0), params)
    return geometry.Cone(shape, [(2 * a, i - 2.5 if kind == "helical" else 0.0) for i, a in enumerate(angles)], params | {"use_curved_detector": kind == "curved"})


def _ctes(kind):
    """SQL of the taps: ht (view, pix, channel, a) and, with rows of their own, vt (view, pix, slice, det_row, b)."""
    g = SCANNERS[kind]
    series = lambda n: f"(SELECT range AS id FROM range({n}))"
    p = ", ".join(f"{e} AS p{i}" for i, e in enumerate(g["p"]))
    out = f"""vol AS ({_VOLUME}), sino AS ({_SINO}), nn AS (SELECT CAST(max(slice) + 1 AS INT) AS n FROM vol),
 vw AS (SELECT CAST(v AS INT) AS view, {p} FROM (SELECT id AS v FROM {series(VIEWS)})),
 vp0 AS (SELECT view, p0, p1, p2, CAST(id AS INT) AS pix, id % {SIZE} - {(SIZE - 1) / 2}e0 AS x, floor(id / {SIZE}) - {(SIZE - 1) / 2}e0 AS y FROM vw CROSS JOIN {series(SIZE * SIZE)}),
 vp1 AS (SELECT *, {g["turn"]} FROM vp0), vp2 AS (SELECT *, {g.get("mag", "1e0")} AS mag FROM vp1), vp3 AS (SELECT *, {g.get("u", "xr")} AS u FROM vp2),
 vp4 AS (SELECT *, {g.get("th", "0e0")} AS th FROM vp3), vp5 AS (SELECT *, {g["foot"]} AS f FROM vp4), h AS (SELECT view, pix, p0, p1, p2, {g["h"]} FROM vp5),
 ht0 AS (SELECT view, pix, n_p, width, scale, CAST(round_even(n_p, 0) AS INT) + CAST(k.id AS INT) - {g["r"]} AS channel FROM h CROSS JOIN {series(2 * g["r"] + 1)} k),
 ht AS (SELECT view, pix, channel, greatest(0e0, least((width + 1) / 2 - abs(n_p - channel), least(1e0, width))) * scale AS a FROM ht0 WHERE channel BETWEEN 0 AND {CHANNELS - 1})"""
    if kind == "parallel":
        return out
    if kind == "multiaxis":
        v = "z * cos(p1) + depth * sin(p1) + (n - 1) / 2e0 AS m_p, greatest(abs(cos(p1)), abs(sin(p1)) * abs(sin(p0)), abs(sin(p1)) * abs(cos(p0))) AS w_row, 1e0 / greatest(abs(cos(p1)), abs(sin(p1)) * abs(sin(p0)), abs(sin(p1)) * abs(cos(p0))) AS factor"
    else:
        v = "mag * z + (n - 1) / 2e0 AS m_p, mag AS w_row, 1e0 / cos(atan2(mag * z, 80e0)) AS factor"
    return out + f""", vt0 AS (SELECT h.*, n, CAST(s.id AS INT) AS slice FROM h CROSS JOIN nn CROSS JOIN (SELECT range AS id FROM range(10000)) s WHERE s.id < n),
 vt1 AS (SELECT *, {g["z"]} AS z FROM vt0), vt2 AS (SELECT view, pix, slice, n, {v} FROM vt1),
 vt3 AS (SELECT *, CAST(round_even(m_p, 0) AS INT) + CAST(k.id AS INT) - {g["r"]} AS det_row FROM vt2 CROSS JOIN {series(2 * g["r"] + 1)} k),
 vt AS (SELECT view, pix, slice, det_row, greatest(0e0, least((w_row + 1) / 2 - abs(m_p - det_row), least(1e0, w_row))) * factor AS b FROM vt3 WHERE det_row >= 0 AND det_row < n)"""


_ROUND = "round(sum({0}), 5) + 0e0 AS v"
_FORWARD = {
    True: "SELECT view, slice AS det_row, channel, " + _ROUND.format("a * value") + " FROM vol JOIN ht USING (pix) WHERE a > 0 GROUP BY view, slice, channel",
    False: "SELECT view, det_row, channel, " + _ROUND.format("a * w") + " FROM (SELECT view, pix, det_row, sum(b * value) AS w FROM vol JOIN vt USING (pix, slice) WHERE b > 0 GROUP BY 1, 2, 3) JOIN ht USING (view, pix) WHERE a > 0 GROUP BY 1, 2, 3",
}


def _back(parallel, value="value", source="sino", power=""):
    if parallel:
        return f"SELECT pix, det_row AS slice, {_ROUND.format(f'a{power} * {value}')} FROM {source} JOIN ht USING (view, channel) WHERE a > 0 GROUP BY 1, 2"
    return f"SELECT pix, slice, {_ROUND.format(f'b{power} * w')} FROM (SELECT view, pix, det_row, sum(a{power} * {value}) AS w FROM {source} JOIN ht USING (view, channel) WHERE a > 0 GROUP BY 1, 2, 3) JOIN vt USING (view, pix, det_row) WHERE b > 0 GROUP BY 1, 2"


_RAMP = "CASE WHEN a.channel = b.channel THEN 0.25e0 WHEN abs(a.channel - b.channel) % 2 = 0 THEN 0e0 ELSE -1 / power(acos(-1e0) * (a.channel - b.channel), 2) END"


def _filtered(scale, weight="1e0"):
    return f", q AS (SELECT a.view, a.det_row, a.channel, sum(b.value * ({weight}) * {_RAMP}) * {scale} * acos(-1e0) / {VIEWS} AS value FROM sino a JOIN sino b ON a.view = b.view AND a.det_row = b.det_row CROSS JOIN nn GROUP BY 1, 2, 3)"


_ELLIPSE = f"power((pix % {SIZE} - 7.5e0) / 7.5e0, 2) + power((floor(pix / {SIZE}) - 7.5e0) / 7.5e0, 2) <= 1"
_COSINE = "80e0 / sqrt(6400e0 + power(b.channel - 9.5e0, 2) + power(b.det_row - (n - 1) / 2e0, 2))"


def _r(df, *keys, name="v", digits=5):
    return df.select(*keys, (F.round("value", digits) + 0.0).alias(name))


def _pix(spark, n=SIZE * SIZE):
    return spark.range(n).select(F.col("id").cast("int").alias("pix"))


def _run(kind, what):
    def query(spark, d):
        m = model(kind, _slices(spark, d))
        if what == "taps":
            return project.channel_taps(m, _pix(spark)).where("a > 1e-6").select("view", "pix", "channel", (F.round("a", 5) + 0.0).alias("a"))
        if what == "forward":
            return _r(project.forward(m, volume(spark, d)), "view", "det_row", "channel")
        if what == "back":
            return _r(project.back(m, sino(spark, d), _pix(spark)), "pix", "slice")
        if what == "hessian":
            ones = sino(spark, d).withColumn("value", F.lit(1.0))
            return _r(project.back(m, ones, _pix(spark), 2), "pix", "slice")
        x = project.back(m, filters.recon_filter(m, sino(spark, d)), project.pixels(spark, m))
        return _r(filters.helical_z_weight(spark, m, x) if kind == "helical" else x, "pix", "slice", digits=4)

    return query


QUERIES, SQL = {}, {}
for _kind in SCANNERS:
    _flat = _kind == "parallel"
    _with = f"WITH {_ctes(_kind)} "
    _texts = {"taps": "SELECT view, pix, channel, round(a, 5) + 0e0 AS a FROM ht WHERE a > 1e-6", "forward": _FORWARD[_flat], "back": _back(_flat), "hessian": _back(_flat, "1e0", power=" * a" if _flat else "").replace("b * w", "b * b * w").replace("sum(a * 1e0)", "sum(a * a)")}
    for _what, _text in _texts.items():
        QUERIES[f"{_kind}_{_what}"], SQL[f"{_kind}_{_what}"] = _run(_kind, _what), _with + _text
    _name = f"{'fbp' if _kind in ('parallel', 'multiaxis') else 'fdk'}_{_kind}"
    _weight = "1e0" if _kind in ("parallel", "multiaxis") else _COSINE
    _scale = "1e0" if _kind in ("parallel", "multiaxis") else "0.5e0"
    _body = f"SELECT pix, slice, v FROM ({_back(_flat, source='q')}) WHERE {_ELLIPSE}".replace("5) + 0e0", "4) + 0e0")
    if _kind == "helical":
        _seen = "(SELECT s.slice, count(*) AS c FROM (SELECT DISTINCT slice FROM vol) s CROSS JOIN nn CROSS JOIN vw WHERE abs(s.slice - (n - 1) / 2e0 - p1) <= n / 4e0 GROUP BY 1)"
        _body = f"SELECT x.pix, x.slice, round(x.v0 * coalesce({VIEWS}e0 / c, 0e0), 4) + 0e0 AS v FROM (SELECT pix, slice, v AS v0 FROM ({_back(_flat, source='q').replace('round(sum(b * w), 5) + 0e0', 'sum(b * w)')}) WHERE {_ELLIPSE}) x LEFT JOIN {_seen} k ON x.slice = k.slice"
    QUERIES[_name], SQL[_name] = _run(_kind, "direct"), _with + _filtered(_scale, _weight) + _body


# One step of the reconstruction's rule, all pixels at once, from x = vol and y = sino.
def vcd_step(spark, d):
    m = model("parallel", _slices(spark, d))
    m.set(no_warning=True, sigma_x=0.25, sigma_y=0.5, auto_regularize_flag=False, use_ror_mask=False)
    x = volume(spark, d)
    e = sino(spark, d).join(project.forward(m, x).withColumnRenamed("value", "_f"), recon.CELL).select(*recon.CELL, (F.col("value") - F.col("_f")).alias("value"), F.lit(1.0).alias("weight"))
    keep = lambda df: df.checkpoint()
    from rayframe.sources.arrays import shared_folder

    shared_folder(spark)
    new, _, _, _ = recon.step(m, keep(x), keep(e), keep(project.hessian_diagonal(spark, m)), _pix(spark), keep)
    return _r(new, "pix", "slice", digits=4)


_EPS = "1.1920928955078125e-7"


def _neighbours(weight=1 / 6, sigma=0.25):
    d = [f"d{i}" for i in range(6)]
    a = [f"power(greatest(abs({x}), {sigma}e0 * {_EPS}) / {sigma}e0, -0.8e0)" for x in d]
    k = [f"({t} * (0.6e0 + {t}) / power(1e0 + {t}, 2) / power({sigma}e0, 2) / 6e0)" for t in a]
    return " + ".join(f"{c} * {x}" for c, x in zip(k, d)), " + ".join(k)


_G, _H = _neighbours()
_NEAR = f"""g AS (SELECT *, floor(pix / {SIZE}) AS r, pix % {SIZE} AS c FROM vol), near AS (SELECT pix, slice, value,
 value - coalesce(lag(value) OVER (PARTITION BY c, slice ORDER BY r), value) AS d0, value - coalesce(lead(value) OVER (PARTITION BY c, slice ORDER BY r), value) AS d1,
 value - coalesce(lag(value) OVER (PARTITION BY r, slice ORDER BY c), value) AS d2, value - coalesce(lead(value) OVER (PARTITION BY r, slice ORDER BY c), value) AS d3,
 value - coalesce(lag(value) OVER (PARTITION BY pix ORDER BY slice), value) AS d4, value - coalesce(lead(value) OVER (PARTITION BY pix ORDER BY slice), value) AS d5 FROM g)"""
QUERIES["vcd_step"] = vcd_step
SQL["vcd_step"] = f"""WITH {_ctes("parallel")}, {_NEAR}, pg AS (SELECT pix, slice, value, {_G} AS g, {_H} AS h FROM near),
 y AS (SELECT view, slice AS det_row, channel, sum(a * value) AS f FROM vol JOIN ht USING (pix) GROUP BY 1, 2, 3),
 e AS (SELECT view, det_row, channel, value - f AS e FROM sino JOIN y USING (view, det_row, channel)),
 bp AS (SELECT pix, det_row AS slice, sum(a * e) AS b FROM e JOIN ht USING (view, channel) GROUP BY 1, 2),
 hs AS (SELECT pix, sum(a * a) AS s FROM ht GROUP BY 1),
 dd AS (SELECT pix, slice, value, g, h + 4e0 * s AS h2, h, (4e0 * b - g) / (4e0 * s + h) AS d, s FROM pg JOIN bp USING (pix, slice) JOIN hs USING (pix)),
 ad AS (SELECT view, slice AS det_row, channel, sum(a * d) AS c FROM dd JOIN ht USING (pix) GROUP BY 1, 2, 3),
 q1 AS (SELECT 4e0 * sum(e * c) AS l, 4e0 * sum(c * c) AS q FROM e JOIN ad USING (view, det_row, channel)), q2 AS (SELECT sum(g * d) AS l2, sum(h * d * d) AS q2 FROM dd),
 al AS (SELECT least(1.5e0, greatest({_EPS}, (l - l2) / (q + q2 + {_EPS}))) AS alpha FROM q1 CROSS JOIN q2)
 SELECT pix, slice, round(value + alpha * d, 4) + 0e0 AS v FROM dd CROSS JOIN al"""


def _prior(f):
    return lambda spark, d: f(volume(spark, d))


_GH = lambda x: prior.gradient_and_hessian(x, SIZE, 0.25)
QUERIES |= {
    "prior_gradient": _prior(lambda x: _GH(x).select("pix", "slice", (F.round("gradient", 5) + 0.0).alias("v"))),
    "prior_hessian": _prior(lambda x: _GH(x).select("pix", "slice", (F.round("hessian", 3) + 0.0).alias("v"))),
    "neighbour_difference": _prior(lambda x: _r(prior.max_neighbour_difference(x, SIZE), "pix", "slice")),
    "cylinder": lambda spark, d: _r(masks.cylinder(volume(spark, d), (SIZE, SIZE, _slices(spark, d)), 2, 1, 1), "pix", "slice"),
    "pixel_subsets": lambda spark, d: masks.partition(spark, (SIZE, SIZE, 1), 4).groupBy("subset").agg(F.count("*").alias("n"), F.min("pix").alias("least")),
    "background_per_view": lambda spark, d: _r(scans.correct_background(sino(spark, d), CHANNELS, 3, "per_view"), "view", "det_row", "channel"),
    "background_global": lambda spark, d: _r(scans.correct_background(sino(spark, d), CHANNELS, 3), "view", "det_row", "channel"),
    "downsample_blocks": lambda spark, d: _r(scans.downsample(sino(spark, d), _slices(spark, d), CHANNELS, (2, 3), spark.range(4).selectExpr("cast(0 AS int) AS det_row", "cast(id AS int) AS channel")), "view", "det_row", "channel"),
    "crop_cells": lambda spark, d: _r(scans.crop(sino(spark, d), _slices(spark, d), CHANNELS, 1, 1, 2), "view", "det_row", "channel"),
    "rotate_views": lambda spark, d: _r(scans.rotate(sino(spark, d), _slices(spark, d), CHANNELS, 0.25), "view", "det_row", "channel"),
    "stepped_views": lambda spark, d: _r(regularise.subsample_views(sino(spark, d), VIEWS, 2), "view", "det_row", "channel"),
    "weighted_loss": lambda spark, d: regularise.forward_loss(sino(spark, d).withColumn("weight", F.exp(-F.col("value"))).withColumn("value", F.col("value") - 0.76), 0.5).select(F.round("loss", 5).alias("loss")),
    "pass_stats": lambda spark, d: regularise.iteration_stats(sino(spark, d).withColumn("value", F.col("value") - 0.76), volume(spark, d)).select(*(F.round(c, 4).alias(c) for c in ("loss", "recon_l1", "rmse"))),
    "robust_weights": lambda spark, d: _r(regularise.huber_weights(sino(spark, d).select("view", "det_row", "channel", (F.col("value") - 0.76).alias("value"), F.exp(-F.col("value")).alias("weight")), 1.0, 0.7), "view", "det_row", "channel"),
}
_S = f"WITH vol AS ({_VOLUME}), sino AS ({_SINO}), nn AS {_N} "
_MED = "SELECT view, median(CASE WHEN channel < 3 THEN value END) AS a, median(CASE WHEN channel >= 17 THEN value END) AS b, median(CASE WHEN det_row < 3 THEN value END) AS c FROM sino GROUP BY view"
_OFF = f", off AS (SELECT view, a + b + c - greatest(a, b, c) - least(a, b, c) AS o FROM ({_MED}))"
_ROT = "cos(0.25e0) * i + sin(0.25e0) * j + (n - 1) / 2e0 - (cos(0.25e0) * (n - 1) / 2e0 + sin(0.25e0) * 9.5e0) AS sr, -sin(0.25e0) * i + cos(0.25e0) * j + 9.5e0 - (-sin(0.25e0) * (n - 1) / 2e0 + cos(0.25e0) * 9.5e0) AS sc"
SQL |= {
    "prior_gradient": _S + f", {_NEAR} SELECT pix, slice, round({_G}, 5) + 0e0 AS v FROM near",
    "prior_hessian": _S + f", {_NEAR} SELECT pix, slice, round({_H}, 3) + 0e0 AS v FROM near",
    "neighbour_difference": _S + f", {_NEAR} SELECT pix, slice, round(greatest(abs(d0), abs(d1), abs(d2), abs(d3)), 5) + 0e0 AS v FROM near",
    "cylinder": _S + f"SELECT pix, slice, round(CASE WHEN power(floor(pix / {SIZE}) - 7.5e0, 2) + power(pix % {SIZE} - 7.5e0, 2) <= 30.25e0 AND slice >= 1 AND slice < n - 1 THEN value ELSE 0e0 END, 5) + 0e0 AS v FROM vol CROSS JOIN nn",
    "pixel_subsets": f"WITH p AS (SELECT range AS pix FROM range(256)), o AS (SELECT pix, row_number() OVER (ORDER BY (pix * 2654435761) % 4294967296, pix) - 1 AS k FROM p WHERE {_ELLIPSE}), c AS (SELECT count(*) AS n, CAST(ceil(count(*) / 4.0) AS INT) AS s FROM o), a AS (SELECT pix, least(CAST(floor(k / s) AS INT), 3) AS subset FROM o CROSS JOIN c UNION ALL SELECT pix, 3 FROM o CROSS JOIN c WHERE k < 4 * s - n) SELECT CAST(subset AS INT) AS subset, count(*) AS n, CAST(min(pix) AS INT) AS least FROM a GROUP BY 1",
    "background_per_view": _S + _OFF + " SELECT view, det_row, channel, round(value - o, 5) + 0e0 AS v FROM sino JOIN off USING (view)",
    "background_global": _S + _OFF + " SELECT view, det_row, channel, round(value - (SELECT quantile_cont(o, 0.1) FROM off), 5) + 0e0 AS v FROM sino",
    "downsample_blocks": _S + f"SELECT view, CAST(floor(det_row / 2) AS INT) AS det_row, CAST(floor(channel / 3) AS INT) AS channel, round(avg(CASE WHEN det_row = 0 AND channel < 4 THEN NULL ELSE value END), 5) + 0e0 AS v FROM sino CROSS JOIN nn WHERE det_row < n - n % 2 AND channel < 18 GROUP BY 1, 2, 3",
    "crop_cells": _S + "SELECT view, det_row - 1 AS det_row, channel - 2 AS channel, round(value, 5) + 0e0 AS v FROM sino CROSS JOIN nn WHERE det_row >= 1 AND det_row < n - 1 AND channel BETWEEN 2 AND 17",
    "rotate_views": _S + f", c AS (SELECT view, det_row, channel, {_ROT}, n FROM (SELECT view, det_row, channel, det_row AS i, channel AS j, n FROM sino CROSS JOIN nn)), k AS (SELECT * FROM c WHERE sr >= 0 AND sr <= n - 1 AND sc >= 0 AND sc <= 19), t AS (SELECT k.view, k.det_row, k.channel, sum(s.value * (1 - abs(k.sr - s.det_row)) * (1 - abs(k.sc - s.channel))) AS v FROM k JOIN sino s ON s.view = k.view AND abs(k.sr - s.det_row) < 1 AND abs(k.sc - s.channel) < 1 GROUP BY 1, 2, 3) SELECT view, det_row, channel, round(coalesce(v, 0e0), 5) + 0e0 AS v FROM sino LEFT JOIN t USING (view, det_row, channel)",
    "stepped_views": _S + "SELECT CAST(view / 3 AS INT) AS view, det_row, channel, round(value, 5) + 0e0 AS v FROM sino WHERE view % 3 = 0",
    "weighted_loss": _S + "SELECT round(sqrt(sum(exp(-value) * power(value - 0.76e0, 2)) / (avg(exp(-value)) * count(*))) / 0.5e0, 5) AS loss FROM sino",
    "pass_stats": _S + "SELECT round((SELECT sqrt(avg(power(value - 0.76e0, 2))) FROM sino), 4) AS loss, round((SELECT sum(abs(value)) FROM vol), 4) AS recon_l1, round((SELECT sqrt(avg(power(value - 0.76e0, 2))) FROM sino), 4) AS rmse",
    "robust_weights": _S + ", z AS (SELECT view, det_row, channel, value - 0.76e0 AS e, 1e0 / sqrt(exp(-value)) AS s FROM sino), k AS (SELECT sqrt(sum(e * e)) / (sqrt(sum(s * s)) + 1e-6) AS k FROM z) SELECT view, det_row, channel, round(CASE WHEN abs(e / (s * k)) <= 1 THEN 1e0 ELSE 0.7e0 / (abs(e / (s * k)) + 1e-6) END, 5) + 0e0 AS v FROM z CROSS JOIN k",
}


# Corrections, sums and choices ------------------------------------------------------
def _holes(spark, d):
    return sino(spark, d).withColumn("value", F.when((F.col("view") + F.col("det_row") * 3 + F.col("channel")) % 7 != 0, F.col("value")))


def _metal(spark, d):
    v, c = F.col("value"), F.col("channel")
    return sino(spark, d).select("view", "det_row", "channel", v.alias("p"), (v * (c % 3)).alias("m1"), (v + 1.0).alias("y"))


def _metal_sums(spark, d):
    p, q = hardening.normal_equations(_metal(spark, d), [(1, 0), (1, 1), (0, 1), (0, 2)], 1)
    return spark.createDataFrame([(i, j, round(float(p[i, j]), 4)) for i in range(4) for j in range(4)] + [(i, -1, round(float(q[i]), 4)) for i in range(4)], "i int, j int, v double")


def _splits(spark, d):
    counts, _ = regularise.histogram(sino(spark, d), 16)
    return spark.createDataFrame([tuple(regularise.otsu_splits(counts, 3))], "first int, second int")


def _shifts(spark):
    return spark.range(VIEWS).selectExpr("cast(id AS int) AS view", "id * 0.25D - 0.5D AS d_row", "0.75D - id * 0.5D AS d_channel")


def _gram(rows, digits=4):
    return rows.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), (F.round("value", digits) + 0.0).alias("v"))


def _spectra(spark, d):
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("point"), F.posexplode("embedding").alias("band", "value")).withColumn("value", F.col("value").cast("double"))
    return x.where("band < 16")


def _spectral_gram(spark, d):
    g = spectral.gram(_spectra(spark, d), 16)
    return spark.createDataFrame([(i, j, round(float(g[i, j]), 4) + 0.0) for i in range(16) for j in range(16)], "i int, j int, v double")


_CELL = ("view", "det_row", "channel")
QUERIES |= {
    "reference_means": lambda spark, d: _r(scans.mean_scan(sino(spark, d)), "det_row", "channel"),
    "fill_cells": lambda spark, d: _r(scans.fill_pass(_holes(spark, d)), *_CELL),
    "fill_zingers": lambda spark, d: _r(scans.fill_zingers(_holes(spark, d), 0.0, 1), *_CELL),
    "shift_views": lambda spark, d: _r(scans.shift(sino(spark, d), _slices(spark, d), CHANNELS, _shifts(spark)), *_CELL),
    "hardening_curve": lambda spark, d: _r(sino(spark, d).withColumn("value", hardening.curve(F.col("value"), [0.5, -0.7, -1.0])), *_CELL),
    "hardening_inverse": lambda spark, d: _r(sino(spark, d).withColumn("value", hardening.inverse(F.col("value"), [0.5, 0.3, 0.1], (0.0, 3.0))), *_CELL),
    "metal_sums": _metal_sums,
    "otsu_splits": _splits,
    "small_stripes": lambda spark, d: _r(lines.remove_small(sino(spark, d), 3, CHANNELS), *_CELL),
    "row_ramp": lambda spark, d: _r(filters.filter_rows(sino(spark, d), CHANNELS), *_CELL),
    "helical_weights": lambda spark, d: filters.helical_weights(spark, model("helical", _slices(spark, d))).select("slice", F.round("weight", 5).alias("v")),
    "views_apart": lambda spark, d: _r(project.per_view_back(model("parallel", _slices(spark, d)), sino(spark, d), _pix(spark).where("pix % 5 = 0")), "view", "pix", "slice"),
    "view_gram": lambda spark, d: _gram(views.gram(sino(spark, d), "view", ("det_row", "channel"))),
    "strided_voxels": lambda spark, d: denoise.strided(volume(spark, d), SIZE, 2, 3, 4).select("row", "col", "slice", F.round("value", 5).alias("v")),
    "noise_support": lambda spark, d: denoise.support(volume(spark, d), 0.01).groupBy("inside").agg(F.count("*").alias("n")),
    "volume_medians": lambda spark, d: denoise.median(project._dense(project.grid(spark, model("parallel", _slices(spark, d))), volume(spark, d), ["pix", "slice"]), (SIZE, SIZE, _slices(spark, d)), 4).select("pix", "slice", *(F.round(c, 5).alias(c) for c in ("median", "lo", "hi"))),
    "spectral_gram": _spectral_gram,
    "spectra_expanded": lambda spark, d: spectral.expand(_spectra(spark, d).where("band < 2").select("point", F.col("band").cast("int").alias("component"), F.col("value").alias("weight")), [[1.0, 0.5, 0.25], [0.0, 2.0, -1.0]]).select("point", "band", (F.round("value", 5) + 0.0).alias("v")),
}
_M = [("p", 1), ("p * m1", 2), ("m1", 1), ("m1 * m1", 2)]
_PQ = ", ".join(f"sum(({a}) * ({b})) AS h{i}_{j}" for i, (a, _) in enumerate(_M) for j, (b, _) in enumerate(_M)) + ", " + ", ".join(f"sum(({a}) * y) AS y{i}" for i, (a, _) in enumerate(_M))
_TRACE = " + ".join(f"h{i}_{i}" for i in range(4))
_WITHIN = lambda c: f"coalesce(sum(CASE WHEN {c} THEN n * bin * bin END) - power(sum(CASE WHEN {c} THEN n * bin END), 2) / nullif(sum(CASE WHEN {c} THEN n END), 0), 0e0)"
_HOLES = "sino0 AS (SELECT view, det_row, channel, CASE WHEN (view + det_row * 3 + channel) % 7 <> 0 THEN value END AS value FROM sino)"
_NEAR9 = "SELECT a.view, a.det_row, a.channel, a.value, avg(b.value) AS m FROM sino0 a JOIN sino0 b ON a.view = b.view AND abs(a.det_row - b.det_row) <= 1 AND abs(a.channel - b.channel) <= 1 GROUP BY 1, 2, 3, 4"
_BANDS = "(SELECT vec_id AS point, CAST(unnest(range(64)) AS INT) AS band, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
SQL |= {
    "reference_means": _S + "SELECT det_row, channel, round(avg(value), 5) + 0e0 AS v FROM sino GROUP BY 1, 2",
    "fill_cells": _S + f", {_HOLES} SELECT view, det_row, channel, round(coalesce(value, m), 5) + 0e0 AS v FROM ({_NEAR9})",
    "fill_zingers": _S + f", {_HOLES} SELECT view, det_row, channel, round(coalesce(value, m, 0e0), 5) + 0e0 AS v FROM ({_NEAR9})",
    "shift_views": _S + ", c AS (SELECT view, det_row, channel, det_row - (view * 0.25e0 - 0.5e0) AS sr, channel - (0.75e0 - view * 0.5e0) AS sc, n FROM sino CROSS JOIN nn), k AS (SELECT * FROM c WHERE sr >= 0 AND sr <= n - 1 AND sc >= 0 AND sc <= 19), t AS (SELECT k.view, k.det_row, k.channel, sum(s.value * (1 - abs(k.sr - s.det_row)) * (1 - abs(k.sc - s.channel))) AS v FROM k JOIN sino s ON s.view = k.view AND abs(k.sr - s.det_row) < 1 AND abs(k.sc - s.channel) < 1 GROUP BY 1, 2, 3) SELECT view, det_row, channel, round(coalesce(v, 0e0), 5) + 0e0 AS v FROM sino LEFT JOIN t USING (view, det_row, channel)",
    "hardening_curve": _S + "SELECT view, det_row, channel, round(ln(exp(-0.7e0) + exp(-1e0)) - ln(exp(-0.7e0 - 0.5e0 * value) + exp(-1e0 - value)), 5) + 0e0 AS v FROM sino",
    "hardening_inverse": _S + "SELECT view, det_row, channel, round(0.5e0 + 0.3e0 * t + 0.1e0 * (2 * t * t - 1), 5) + 0e0 AS v FROM (SELECT view, det_row, channel, 2 * value / 3e0 - 1 AS t FROM sino)",
    "metal_sums": _S + f", m AS (SELECT value AS p, value * (channel % 3) AS m1, value + 1 AS y FROM sino), s AS (SELECT {_PQ} FROM m) "
    + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(h{i}_{j}{f' + 2e-3 * ({_TRACE}) / 10e0 * {1 + _M[i][1]}' if i == j else ''}, 4) + 0e0 AS v FROM s" for i in range(4) for j in range(4))
    + "".join(f" UNION ALL SELECT {i}, -1, round(-y{i}, 4) + 0e0 FROM s" for i in range(4)),
    "otsu_splits": _S + f", b AS (SELECT CAST(least(15, floor((value - lo) / ((hi - lo) / 16))) AS INT) AS bin, count(*) AS n FROM sino CROSS JOIN (SELECT min(value) AS lo, max(value) AS hi FROM sino) GROUP BY 1), k AS (SELECT a.range AS i, c.range AS j FROM range(1, 16) a JOIN range(1, 16) c ON c.range > a.range), w AS (SELECT i, j, {_WITHIN('bin < i')} + {_WITHIN('bin >= i AND bin < j')} + {_WITHIN('bin >= j')} AS x FROM k CROSS JOIN b GROUP BY 1, 2) SELECT CAST(i AS INT) AS first, CAST(j AS INT) AS second FROM w ORDER BY round(x, 6), i, j LIMIT 1",
    "small_stripes": _S + ", r AS (SELECT *, row_number() OVER (PARTITION BY det_row, channel ORDER BY value, view) AS k FROM sino) SELECT a.view, a.det_row, a.channel, round(median(b.value), 5) + 0e0 AS v FROM r a CROSS JOIN (VALUES (-1), (0), (1)) o(d) JOIN r b ON a.det_row = b.det_row AND a.k = b.k AND b.channel = least(19, greatest(0, a.channel + d)) GROUP BY 1, 2, 3",
    "row_ramp": _S + f"SELECT a.view, a.det_row, a.channel, round(sum(b.value * {_RAMP}), 5) + 0e0 AS v FROM sino a JOIN sino b ON a.view = b.view AND a.det_row = b.det_row GROUP BY 1, 2, 3",
    "helical_weights": _S + f", vw AS (SELECT range - 2.5e0 AS p1 FROM range({VIEWS})) SELECT s.slice, round(CASE WHEN count(CASE WHEN abs(s.slice - (n - 1) / 2e0 - p1) <= n / 4e0 THEN 1 END) = 0 THEN 0e0 ELSE {VIEWS}e0 / count(CASE WHEN abs(s.slice - (n - 1) / 2e0 - p1) <= n / 4e0 THEN 1 END) END, 5) AS v FROM (SELECT DISTINCT slice FROM vol) s CROSS JOIN nn CROSS JOIN vw GROUP BY s.slice, n",
    "views_apart": f"WITH {_ctes('parallel')} SELECT view, pix, det_row AS slice, round(sum(a * value), 5) + 0e0 AS v FROM sino JOIN ht USING (view, channel) WHERE a > 0 AND pix % 5 = 0 GROUP BY 1, 2, 3",
    "view_gram": _S + "SELECT a.view AS i, b.view AS j, round(sum(a.value * b.value), 4) + 0e0 AS v FROM sino a JOIN sino b ON a.det_row = b.det_row AND a.channel = b.channel AND a.view <= b.view GROUP BY 1, 2",
    "strided_voxels": _S + f"SELECT CAST(floor(pix / {SIZE}) / 2 AS INT) AS row, CAST((pix % {SIZE}) / 3 AS INT) AS col, CAST(slice / 4 AS INT) AS slice, round(value, 5) AS v FROM vol WHERE floor(pix / {SIZE}) % 2 = 0 AND (pix % {SIZE}) % 3 = 0 AND slice % 4 = 0",
    "noise_support": _S + "SELECT value >= t AS inside, count(*) AS n FROM vol CROSS JOIN (SELECT least(0.05e0 * avg(abs(value)) + 0.01e0, max(value)) AS t FROM vol) GROUP BY 1",
    "volume_medians": _S + f", g AS (SELECT CAST(p.range AS INT) AS pix, CAST(s.slice AS INT) AS slice, coalesce(value, 0e0) AS value FROM range({SIZE * SIZE}) p CROSS JOIN (SELECT DISTINCT slice FROM vol) s LEFT JOIN vol ON vol.pix = p.range AND vol.slice = s.slice), k(d) AS (VALUES (-1), (0), (1)) SELECT a.pix, a.slice, round(median(b.value), 5) AS median, round(min(b.value), 5) AS lo, round(max(b.value), 5) AS hi FROM g a CROSS JOIN nn CROSS JOIN k x CROSS JOIN k y CROSS JOIN k z JOIN g b ON b.pix = least({SIZE - 1}, greatest(0, a.pix // {SIZE} + x.d)) * {SIZE} + least({SIZE - 1}, greatest(0, a.pix % {SIZE} + y.d)) AND b.slice = least(n - 1, greatest(0, a.slice + z.d)) GROUP BY 1, 2",
    "spectral_gram": f"WITH e AS (SELECT * FROM {_BANDS} WHERE band < 16) SELECT a.band AS i, b.band AS j, round(sum(a.value * b.value), 4) + 0e0 AS v FROM e a JOIN e b USING (point) GROUP BY 1, 2",
    "spectra_expanded": f"WITH e AS (SELECT * FROM {_BANDS} WHERE band < 2) SELECT point, CAST(b.band AS INT) AS band, round(sum(value * h), 5) + 0e0 AS v FROM e JOIN (VALUES (0, 0, 1e0), (0, 1, 0.5e0), (0, 2, 0.25e0), (1, 0, 0e0), (1, 1, 2e0), (1, 2, -1e0)) b(c, band, h) ON e.band = b.c GROUP BY 1, 2",
}
