"""Projectors, direct and iterative reconstruction: adjointness, known limits, convergence."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rayframe import geometry
from rayframe.operators import filters, masks, phantoms, project, recon
from rayframe.plans.scanner import QUERIES, SCANNERS, model
from rayframe.sources import arrays


def dot(a, b, keys):
    return a.join(b.withColumnRenamed("value", "w"), keys).agg(F.sum(F.col("value") * F.col("w"))).first()[0] or 0.0


def noise(df, keys, seed):
    return df.withColumn("value", (F.xxhash64(*keys, F.lit(seed)) % 1000) / 1000.0)


@pytest.mark.parametrize("kind", SCANNERS)
def test_adjoint(spark, kind):
    m = model(kind, 5)
    x = noise(project.constant_volume(spark, m, 0), ["pix", "slice"], 1)
    y = noise(project.sino_grid(spark, m), ["view", "det_row", "channel"], 2)
    a = dot(project.forward(m, x), y, ["view", "det_row", "channel"])
    b = dot(x, project.back(m, y, x.select("pix").distinct()), ["pix", "slice"])
    assert abs(a - b) <= 1e-9 * abs(a) and abs(a) > 0


def test_no_elevation_is_parallel(spark):
    n, angles = 4, [math.pi * i / 5 for i in range(5)]
    p = {"recon_shape": (8, 8, n), "delta_voxel": 1.0}
    a, b = geometry.Parallel((5, n, 12), angles, p), geometry.MultiAxis((5, n, 12), [(t, 0.0) for t in angles], p)
    x = noise(project.constant_volume(spark, a, 0), ["pix", "slice"], 3)
    keys = ["view", "det_row", "channel"]
    d = project.forward(a, x).join(project.forward(b, x).withColumnRenamed("value", "w"), keys, "full").agg(F.max(F.abs(F.coalesce("value", F.lit(0.0)) - F.coalesce("w", F.lit(0.0))))).first()[0]
    assert d < 1e-9


def _flat_object(spark, views=48, size=16, slices=3):
    m = geometry.Parallel((views, slices, 24), [math.pi * i / views for i in range(views)], {"recon_shape": (size, size, slices), "delta_voxel": 1.0})
    x = masks.cylinder(project.constant_volume(spark, m, 1.0), m.params["recon_shape"], 3)
    return m, x, project.forward_project(spark, m, x)


def test_filtered_back_projection_gives_the_object(spark):
    m, x, y = _flat_object(spark)
    r = filters.recon_fbp(spark, m, y).withColumnRenamed("value", "r").join(x, ["pix", "slice"])
    inner = F.pow(F.floor(F.col("pix") / 16) - 7.5, 2) + F.pow(F.col("pix") % 16 - 7.5, 2) < 9
    assert abs(r.where(inner).agg(F.avg("r")).first()[0] - 1) < 0.03


def test_iterations_converge_and_slabs_agree(spark):
    m, x, y = _flat_object(spark, views=16, size=12, slices=4)
    arrays.shared_folder(spark)
    got, traces = recon.recon(spark, m, y, iterations=3, subsets=(2,), stop_pct=0.0)
    assert traces[-1]["fm_rmse"] < traces[0]["fm_rmse"]
    miss = lambda z: math.sqrt(z.join(x.withColumnRenamed("value", "w"), ["pix", "slice"]).agg(F.avg(F.pow(F.col("value") - F.col("w"), 2))).first()[0])
    assert miss(got) < 0.25
    m.params["granularity"], m.params["partition_sequence"] = (2, 4, 8), (0, 1, 2)
    slabs = recon.recon_slabs(spark, m, y, iterations=10, stop_pct=0.0, band=2, half_overlap=2)
    assert slabs.count() == 12 * 12 * 4 and miss(slabs) < 0.15


def test_round_trip_of_a_reconstruction(spark, tmp_path):
    m = model("helical", 3)
    x = phantoms.cube(spark, m.params["recon_shape"])
    arrays.save_recon(str(tmp_path / "r"), x, m, [{"iteration": 0}], "note")
    y, n, traces, notes = arrays.load_recon(spark, str(tmp_path / "r"))
    assert sorted(map(tuple, y.collect())) == sorted(map(tuple, x.collect()))
    assert (n.kind, n.views, n.params["recon_shape"], traces, notes) == (m.kind, m.views, m.params["recon_shape"], [{"iteration": 0}], "note")
    assert arrays.names(spark, str(tmp_path / "r")) == ["volume"]


def test_parameters():
    m = geometry.make("cone", (4, 6, 8), [0.0, 1.0, 2.0, 3.0], 40.0, 20.0)
    assert m.params["recon_shape"] == (8, 8, 6) and m.params["delta_voxel"] == 0.5
    with pytest.raises(NameError):
        m.set(nothing=1)
    with pytest.warns(UserWarning):
        assert not m.set(sigma_x=2.0).params["auto_regularize_flag"]
    assert m.set(sharpness=0.0).params["auto_regularize_flag"]
    assert m.copy(rows=10).sinogram_shape == (4, 10, 8) and m.scale_recon_shape(1.5) == (4, 0, 0)
    assert geometry.config_crop(40, 36, 1.5, -0.5, 0.8, 1.2, top=3, bottom=5, sides=2) == (32, 32, 2.3, -0.5)
    assert geometry.build(*m.all_params()).params == m.params
    assert np.allclose(geometry.to_alu(3.0, "mm", "cm"), 0.3)


def test_phantoms(spark):
    assert abs(phantoms.attenuation_scale((10, 10, 10), 2.8) - 2.8 / 9.2 / 0.28) < 1e-12
    assert phantoms.dots(spark, (12, 6, 5), 0.2).agg(F.sum("value")).first()[0] == 8 * 6
    top = phantoms.head(spark, (17, 17, 9)).agg(F.max("value"), F.min("value")).first()
    assert abs(top[0] - 1) < 1e-9 and abs(top[1]) < 1e-9
    assert phantoms.classic_head(spark, (17, 17, 9)).agg(F.max("value")).first()[0] == 2.0
    x, y, m = phantoms.demo(spark, "cone", 6, 8, 10, "cube")
    assert x.count() == math.prod(m.params["recon_shape"]) and y.count() == 6 * 8 * 10


def test_damped_direction_and_metal_weights(spark):
    m = model("cone", 3)
    s = recon.damping_profile(m, 0.2, 1.0, 2.0, 1.0)
    assert len(s) == 3 and abs(s[1] - 0.2) < 1e-9 and s[0] == s[2] > 0.2
    rows = [(p, k, float(p - k), 1.0 + p) for p in range(4) for k in range(3)]
    got = {(r.pix, r.slice): r.d for r in recon.damped_direction(spark.createDataFrame(rows, "pix int, slice int, g double, h double"), s).collect()}
    for k in range(3):
        g, h = np.array([[r[2], r[3]] for r in rows if r[1] == k]).T
        want = -(g - (1 - s[k]) * (g / h).sum() / (1 / h).sum()) / h
        assert np.allclose([got[p, k] for p in range(4)], want)
    y = noise(project.sino_grid(spark, m), ["view", "det_row", "channel"], 5)
    v = project.constant_volume(spark, m, 0.0).withColumn("value", F.when((F.col("pix") == 120) & (F.col("slice") == 1), 9.0).otherwise(0.1))
    w = recon.metal_weights(spark, m, y, v, 1.0).join(y.withColumnRenamed("value", "y"), recon.CELL).collect()
    assert {round(-math.log(r.value) / r.y, 6) for r in w if abs(r.y) > 0.01} == {1.0, 4.0}


def test_cone_iterations_converge(spark):
    arrays.shared_folder(spark)
    m = geometry.make("cone", (10, 6, 12), [2 * math.pi * i / 10 for i in range(10)], 48.0, 24.0)
    x = masks.cylinder(project.constant_volume(spark, m, 1.0), m.params["recon_shape"], 2)
    got, traces = recon.recon(spark, m, project.forward_project(spark, m, x), iterations=2, subsets=(2,), stop_pct=0.0)
    assert traces[1]["fm_rmse"] < traces[0]["fm_rmse"] and got.count() == math.prod(m.params["recon_shape"])


def test_filter_gives_the_cells_that_came_in(spark):
    r = np.random.default_rng(7)
    x = r.random((2, 9))
    x[0, [1, 8]] = x[1, 4] = 0
    rows = [(0, k, c, None if (k, c) == (1, 4) else float(x[k, c])) for k in range(2) for c in range(9) if k or c not in (1, 8)]
    got = {(y.det_row, y.channel): y.value for y in filters.filter_rows(spark.createDataFrame(rows, "view int, det_row int, channel int, value double"), 9).collect()}
    taps = filters.ramp(9)
    assert got.keys() == {(k, c) for _, k, c, _ in rows}
    assert all(abs(v - sum(x[k, j] * taps[8 + c - j] for j in range(9))) < 1e-12 for (k, c), v in got.items())


def test_back_projection_sends_no_grid_to_the_driver(spark):
    m = model("cone", 8000)
    y = spark.createDataFrame([(0, 4000, 9, 1.0)], "view int, det_row int, channel int, value double")
    plan = project.back(m, y, spark.range(256).selectExpr("cast(id AS int) AS pix"))._jdf.queryExecution().executedPlan().toString()
    assert not any("det_row" in line for line in plan.splitlines() if "BroadcastExchange" in line or "BroadcastHashJoin" in line and "slice" in line)
    assert "SortMergeJoin" in plan


def test_back_projection_moves_cells_but_no_grid(spark):
    m = model("cone", 8000)
    y = spark.createDataFrame([(0, 4000, 9, 1.0)], "view int, det_row int, channel int, value double")
    plan = project.back(m, y, spark.range(256).selectExpr("cast(id AS int) AS pix"))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if " Exchange hashpartitioning" in line]
    assert len(moved) == 3 and not any("det_row" in line for line in moved)


def test_slice_taps_are_the_row_taps(spark):
    for m in (model("helical", 5), geometry.MultiAxis((3, 5, 9), [(0.0, -0.3), (0.4, math.pi / 2), (1.0, 2.0)], {"recon_shape": (4, 4, 6), "delta_voxel": 1.0})):
        pix = spark.range(16).selectExpr("cast(id AS int) AS pix")
        cells = pix.crossJoin(spark.range(m.sinogram_shape[0]).selectExpr("cast(id AS int) AS view")).crossJoin(spark.range(5).selectExpr("cast(id AS int) AS det_row"))
        keys = ["view", "pix", "slice", "det_row"]
        got, want = ({tuple(r[:4]): r[4] for r in x.select(*keys, "b").collect()} for x in (project.slice_taps(m, cells), project.row_taps(m, project._view_pixels(m, pix).withColumn("slice", project._slices(m)))))
        assert got.keys() == want.keys() and len(got) > 100 and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_cells_off_the_detector_take_no_part(spark):
    m, pix = model("cone", 5), spark.range(256).selectExpr("cast(id AS int) AS pix")
    y = noise(project.sino_grid(spark, m), ["view", "det_row", "channel"], 4)
    off = spark.createDataFrame([(0, 5, 9, 1.0), (0, -1, 9, 1.0), (6, 2, 9, 1.0), (0, 2, 20, 1.0), (None, 2, 9, 1.0), (0, None, 9, 1.0), (-1, 20, 9, 1.0)], "view int, det_row int, channel int, value double")
    a, b = ({(r.pix, r.slice): r.value for r in project.back(m, x, pix).collect()} for x in (y, y.unionByName(off)))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


@pytest.mark.parametrize("name", ["curved_hessian", "fbp_multiaxis", "fdk_curved", "fdk_helical", "fdk_translation", "helical_back", "helical_hessian", "multiaxis_back", "translation_back", "curved_back", "fdk_cone", "multiaxis_hessian"])
def test_query_with_many_slices_sends_no_taps_of_slices_to_the_driver(spark, tmp_path, name):
    spark.createDataFrame([(8000 * 1024, 1, 2, 3, 5e4)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "BroadcastHashJoin" in line or "NestedLoop" in line or "Cartesian" in line]
    assert sent and not any("det_row" in line or "Join [" not in line for line in sent)
