"""The q-generalised Gaussian Markov prior on the six nearest voxels, and the proximal term.

A neighbour is found by windows along one axis, each partitioned by the other two, so no
window spans the volume; beyond an edge the voxel is its own neighbour.
"""
from pyspark.sql import Window
from pyspark.sql import functions as F

EPS = 1.1920928955078125e-07  # float32's step at 1, the least difference in units of T * sigma_x


def neighbour_weights(weights=(1.0, 1.0, 1.0)):
    """(row, row, column, column, slice, slice) weights that sum to 1."""
    both = [w for w in weights for _ in range(2)]
    return [w / sum(both) for w in both]


def _parts(delta, sigma_x, p, q, t):
    a = F.greatest(F.abs(delta), F.lit(t * sigma_x * EPS))
    return a, F.pow(a / (t * sigma_x), F.lit(q - p))


def b_tilde(delta, sigma_x, p=2.0, q=1.2, t=1.0):
    """Half of rho'(delta) / delta."""
    a, r = _parts(delta, sigma_x, p, q, t)
    return F.pow(a, F.lit(p - 2.0)) / (2 * sigma_x**p) * r * (q / p + r) / F.pow(1 + r, F.lit(2.0))


def rho(delta, sigma_x, p=2.0, q=1.2, t=1.0):
    a, r = _parts(delta, sigma_x, p, q, t)
    return F.pow(a, F.lit(p)) / (p * sigma_x**p) * r / (1 + r)


def two_b_tilde(delta, b, sigma_x, p=2.0, q=1.2, t=1.0):
    return 2 * b * b_tilde(delta, sigma_x, p, q, t)


def differences(volume, cols):
    """volume (pix, slice, value) with the differences d0 to d5 to the row, column and slice neighbours, behind and before; 0 at edges."""
    x = volume.withColumn("_r", F.floor(F.col("pix") / cols).cast("int")).withColumn("_c", (F.col("pix") % cols).cast("int"))
    axes = (("_r", ("_c", "slice")), ("_c", ("_r", "slice")), ("slice", ("pix",)))
    for i, (axis, rest) in enumerate(axes):
        w = Window.partitionBy(*rest).orderBy(axis)
        for j, f in enumerate((F.lag, F.lead)):
            x = x.withColumn(f"d{2 * i + j}", F.col("value") - F.coalesce(f("value").over(w), F.col("value")))
    return x.drop("_r", "_c")


def gradient_and_hessian(volume, cols, sigma_x, p=2.0, q=1.2, t=1.0, weights=(1.0, 1.0, 1.0)):
    """(pix, slice, value, gradient, hessian) of the prior's surrogate."""
    b, x = neighbour_weights(weights), differences(volume, cols)
    c = [two_b_tilde(F.col(f"d{i}"), b[i], sigma_x, p, q, t) for i in range(6)]
    return x.select("pix", "slice", "value", sum((c[i] * F.col(f"d{i}") for i in range(1, 6)), c[0] * F.col("d0")).alias("gradient"), sum(c[1:], c[0]).alias("hessian"))


def loss(volume, cols, sigma_x, p=2.0, q=1.2, t=1.0, weights=(1.0, 1.0, 1.0)):
    """One row, `loss`: each pair of neighbours once."""
    b, x = neighbour_weights(weights), differences(volume, cols)
    # rho at an edge is that of no difference and counts for no pair: only differences to a neighbour behind are summed.
    has = (F.floor(F.col("pix") / cols) > 0, F.col("pix") % cols > 0, F.col("slice") > 0)
    terms = [F.when(has[i], b[2 * i] * rho(F.col(f"d{2 * i}"), sigma_x, p, q, t)).otherwise(0.0) for i in range(3)]
    return x.agg(F.sum(terms[0] + terms[1] + terms[2]).alias("loss"))


def prox_gradient(volume, prox_input, sigma_prox):
    """(pix, slice, value, gradient): pull towards `prox_input`."""
    x = volume.join(prox_input.withColumnRenamed("value", "_v"), ["pix", "slice"])
    return x.select("pix", "slice", "value", ((F.col("value") - F.col("_v")) / sigma_prox**2).alias("gradient"))


def max_neighbour_difference(volume, cols):
    """(pix, slice, value): greatest absolute difference to the four neighbours in a slice."""
    d = differences(volume, cols)
    return d.select("pix", "slice", F.greatest(*(F.abs(F.col(f"d{i}")) for i in range(4))).alias("value"))
