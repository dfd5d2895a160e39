"""Hyperspectral data as a product of few weights a point and few spectra.

Data are (point, band, value). Points stay on the executors: each task holds some points'
weights, and only sums of the size components x bands come to the driver each round.
"""
from pyspark.sql import functions as F


def _points(data, bands):
    """(point, v: its spectrum as an array of `bands` values)."""
    x = data.groupBy("point").agg(F.map_from_entries(F.collect_list(F.struct(F.col("band").cast("int"), F.col("value").cast("double")))).alias("m"))
    return x.select("point", F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0.0))).alias("v"))


def gram(data, bands):
    """bands x bands sums of products over the points, by partial sums of tasks."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        total = np.zeros((bands, bands))
        for b in batches:
            v = np.asarray(b.column(0).flatten()).reshape(-1, bands)
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["g"])

    parts = _points(data, bands).select("v").mapInArrow(run, "g array<double>").select(F.posexplode("g").alias("i", "x"))
    out = np.zeros(bands * bands)
    for r in parts.groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r.i] = r.x
    return out.reshape(bands, bands)


def dimension(data, bands, safety=2, window=(25.0, 75.0), threshold=1.5):
    """Number of components: singular values that stand over a log-linear fit of the noise's, times `safety`."""
    import numpy as np

    s = np.sqrt(np.maximum(np.linalg.eigvalsh(gram(data, bands))[::-1], 1e-300))
    a, b = (int(len(s) * w / 100) for w in window)
    x = np.arange(len(s))
    slope, level = np.polyfit(x[a:b], np.log(s[a:b]), 1)
    return max(1, int(safety * np.sum(s > threshold * np.exp(level + slope * x))))


def _weights_of(v, basis, rounds=200):
    """Non-negative weights of spectra v on a basis, by multiplicative steps."""
    import numpy as np

    g, c = basis @ basis.T, v @ basis.T
    w = np.maximum(c, 0) / np.maximum(np.diag(g), 1e-12) / len(basis) + 1e-9
    for _ in range(rounds):
        w *= np.maximum(c, 1e-12) / np.maximum(w @ g, 1e-12)
    return w


def compress(data, bands, components, rounds=100, seed=0, basis=None):
    """((point, component, weight), basis): non-negative factors of least square error."""
    import numpy as np

    points = _points(data, bands)
    if basis is None:
        basis = np.random.default_rng(seed).random((components, bands)) + 0.1
        for _ in range(rounds):

            def run(batches, basis=basis):
                import pyarrow as pa

                ww, wv = np.zeros((len(basis),) * 2), np.zeros(basis.shape)
                for b in batches:
                    v = np.maximum(np.asarray(b.column(0).flatten()).reshape(-1, bands), 0)
                    w = _weights_of(v, basis, 20)
                    ww, wv = ww + w.T @ w, wv + w.T @ v
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([ww.ravel(), wv.ravel()]).tolist()], pa.list_(pa.float64()))], ["g"])

            n = len(basis)
            total = np.zeros(n * n + n * bands)
            for r in points.select("v").mapInArrow(run, "g array<double>").select(F.posexplode("g").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
                total[r.i] = r.x
            ww, wv, before = total[: n * n].reshape(n, n), total[n * n :].reshape(n, bands), basis
            basis = basis.copy()
            for k in range(n):
                basis[k] = np.maximum(basis[k] + (wv[k] - ww[k] @ basis) / max(ww[k, k], 1e-12), 1e-12)
            scale = np.linalg.norm(basis, axis=1, keepdims=True)
            basis = basis / np.maximum(scale, 1e-12)
            if np.abs(basis - before).max() < 1e-8:
                break

    def last(batches):
        import pyarrow as pa

        for b in batches:
            w = _weights_of(np.maximum(np.asarray(b.column(1).flatten()).reshape(-1, bands), 0), basis)
            n = w.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(np.tile(np.arange(n), len(w)).astype("i4")), pa.array(w.ravel())], ["point", "component", "weight"])

    return points.select(F.col("point").cast("long").alias("point"), "v").mapInArrow(last, "point long, component int, weight double"), basis


def expand(weights, basis, bands=None, transmission=False):
    """(point, band, value): weights times spectra, of some bands if given; exp(-value) for transmission data."""
    spark = weights.sparkSession
    rows = [(k, b, float(basis[k][b])) for k in range(len(basis)) for b in (range(len(basis[0])) if bands is None else bands)]
    x = weights.join(F.broadcast(spark.createDataFrame(rows, "component int, band int, h double")), "component")
    x = x.groupBy("point", "band").agg(F.sum(F.col("weight") * F.col("h")).alias("value"))
    return x.withColumn("value", F.exp(-F.col("value"))) if transmission else x


def smooth(data, bands, components, **how):
    """Data without what few components can't hold."""
    return expand(*compress(data, bands, components, **how))


def simulate(spark, spectra, angles=1, rows=64, cols=64, dose=300.0, density=(0.2, 0.2, 1.0), seed=0):
    """((point, band, value) with counting noise, the same without): three rods of three materials, one below the other."""
    import math

    if len(spectra) != 3 or rows < 3 or cols < 2 or dose <= 0 or min(min(s) for s in spectra) < 0:
        raise ValueError("three spectra, none negative, three rows, two columns and a dose over 0")
    high, wide = rows // 3, cols // 2
    i = F.col("id")
    r, c = F.floor(i / cols) % rows, i % cols
    at = (c - wide // 2).cast("double")
    # The rods' depth along a row of `wide` columns.
    place = -(wide // 2) + at * ((wide // 2) * 2 / max(1, wide - 1) if wide % 2 == 0 else (wide - 1) / max(1, wide - 1))
    depth = 20 * F.sqrt(F.greatest(F.lit(0.0), F.lit(float((wide // 2) ** 2)) - place * place)) / wide
    inside = (at >= 0) & (at < wide)
    rod = F.when(r < high, 0).when((r >= 2 * high), 1).otherwise(2)
    x = spark.range(angles * rows * cols).select(i.alias("point"), rod.alias("m"), F.when(inside, depth).otherwise(0.0).alias("d"))
    table = F.lit([[float(d * v) for v in s] for d, s in zip(density, spectra)])
    x = x.select("point", F.posexplode(F.transform(F.element_at(table, F.col("m") + 1), lambda a: a * F.col("d"))).alias("band", "value"))
    # Sums of many counts are near normal; few ones come from the logarithms of uniform numbers.
    normal = lambda mean, s: F.greatest(F.lit(0.0), F.rint(mean + F.sqrt(mean) * F.randn(seed + s)))
    ratio = normal(dose * F.exp(-F.col("value")), 1) / F.greatest(F.lit(1.0), normal(F.lit(float(dose)), 2))
    return x.withColumn("value", -F.ln(F.greatest(F.lit(1e-8), ratio))), x
