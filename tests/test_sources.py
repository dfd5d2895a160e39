import numpy as np

from rayframe import functions
from rayframe.sources import arrays, files
from rayframe.streaming import SCAN, sino_stream, write_views


def test_images_and_tags(spark, tmp_path):
    r = np.random.default_rng(1)
    x = r.integers(0, 65535, (4, 5, 7)).astype("u2")
    for i, y in enumerate(x):
        (tmp_path / f"a_{i:03}.tif").write_bytes(files.encode_tiff(y))
    out = np.zeros((2, 5, 7))
    for t in files.tiff_stack(spark, str(tmp_path), 1, None, 2).collect():
        out[t.view, t.det_row, t.channel] = t.value
    assert np.allclose(out, x[1::2] / 65535)
    f = r.normal(size=(3, 2)).astype("f4")
    assert np.array_equal(files.decode_tiff(files.encode_tiff(f)), f)
    (tmp_path / "c.txt").write_text("<Scan><source>\n<mm>10 20</mm></source><detector><mm>5</mm></detector></Scan>")
    t = files.tagged(spark, str(tmp_path / "c.txt"))
    assert files.tag_value(t, "mm", "detector") == "5" and files.tag_value(t, "mm") == "10 20"


def test_views_as_they_come(spark, tmp_path):
    one = spark.createDataFrame([(0, 0, c, 0.5) for c in range(3)], SCAN)
    one.write.parquet(str(tmp_path / "in"))
    blank, dark = (one.selectExpr("view", "det_row", "channel", f"{v}D AS value") for v in (1.0, 0.0))
    q = write_views(sino_stream(spark, str(tmp_path / "in"), blank, dark), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert np.allclose([r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()], [np.log(2)] * 3)


def test_arrays_keep_metadata(spark, tmp_path):
    x = spark.createDataFrame([(0, 0, 0, 1.5)], SCAN)
    arrays.save_preprocessing(str(tmp_path / "p"), x, {"sinogram_shape": [1, 1, 1]}, {"delta_det_row": 0.5})
    y, required, optional = arrays.load_preprocessing(spark, str(tmp_path / "p"))
    assert list(map(tuple, y.collect())) == [(0, 0, 0, 1.5)] and required["sinogram_shape"] == [1, 1, 1] and optional == {"delta_det_row": 0.5}
    assert set(functions.__all__) <= set(dir(functions))
