"""Choice of views: Gram matrix of the views' filtered back projections, and a subset of least loss.

The matrix has a row a view and is gathered on the driver; the basis functions stay rows.
"""
from pyspark.sql import functions as F


def normalised(x, eps=1e-12, by=()):
    """x with value over its norm (of each group)."""
    norms = x.groupBy(*by).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_n"))
    y = x.join(norms, list(by)) if by else x.crossJoin(norms)
    return y.withColumn("value", F.col("value") / (F.col("_n") + eps)).drop("_n")


def sampled_pixels(spark, shape, share, seed=0, mask=True):
    """A share of the mask's pixels, first in a seeded order."""
    from rayframe.operators.masks import _order, full_indices

    if not 0 < share <= 1:
        raise ValueError("the share is over 0 and 1 at most")
    pix = full_indices(spark, shape, mask)
    return pix.orderBy(_order(seed), "pix").limit(int(pix.count() * share)).select("pix")


def basis(spark, model, reference, share=0.002, seed=0):
    """((view, pix, slice, value) of norm 1 a view, (view, gamma)): each view's filtered back projection of the reference, and its product with it."""
    from rayframe.operators import filters, project

    pix = sampled_pixels(spark, model.params["recon_shape"], share, seed, model.params["use_ror_mask"])
    sino = filters.recon_filter(model, project.forward_project(spark, model, reference))
    own = normalised(project.per_view_back(model, sino, pix), by=["view"])
    ref = normalised(project.at_pixels(reference, pix))
    return own, own.join(ref.withColumnRenamed("value", "_r"), ["pix", "slice"]).groupBy("view").agg(F.sum(F.col("value") * F.col("_r")).alias("gamma"))


def gram(rows, key="view", at=("pix", "slice")):
    """(i, j, value), i <= j: products of all pairs of rows; all values of one place meet, at most one a view."""
    x = rows.groupBy(*at).agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col("value").alias("v"))).alias("a"))
    pairs = F.flatten(F.transform("a", lambda p: F.transform(F.filter("a", lambda q: q.k >= p.k), lambda q: F.struct(p.k.alias("i"), q.k.alias("j"), (p.v * q.v).alias("x")))))
    return x.select(F.explode(pairs).alias("t")).groupBy("t.i", "t.j").agg(F.sum("t.x").alias("value"))


def matrix(pairs, n):
    import numpy as np

    out = np.zeros((n, n))
    for r in pairs.collect():
        out[r.i, r.j] = out[r.j, r.i] = r.value
    return out


def loss(r, gamma):
    """1 - gamma' r^-1 gamma."""
    import numpy as np

    g = np.asarray(gamma, float).ravel()
    return float(1 - g @ np.linalg.solve(r, g))


def _loss(r, gamma, views):
    return loss(r[views][:, views], gamma[views])


def choose(r, gamma, k, share=0.5, before=(), least=30, rounds=100, seed=0):
    """(views, loss): exchanges one view after the other for a better of some random candidates."""
    import numpy as np

    rng, before = np.random.default_rng(seed), list(before)
    free = np.setdiff1d(np.arange(len(r)), before)
    if k <= 0:
        raise ValueError("one view at least")
    if len(free) <= k:
        return free, _loss(r, gamma, free)
    tries = min(max(int(share * (len(free) - k)), least), len(free) - k)
    own = list(free[np.linspace(0, len(free), k, endpoint=False).astype(int)])
    best = _loss(r, gamma, before + own)
    for _ in range(rounds):
        last = list(own)
        for j in range(k):
            for c in rng.permutation(np.setdiff1d(free, own))[:tries]:
                new = own[:j] + [c] + own[j + 1 :]
                if c not in own and (v := _loss(r, gamma, before + new)) < best:
                    best, own = v, new
        if own == last:
            break
    return np.sort(own), best


def by_priority(views, r, gamma, before=()):
    """The views, the one whose loss would cost most first."""
    views, out = list(views), []
    while len(views) > 1:
        i = min(range(len(views)), key=lambda i: _loss(r, gamma, list(before) + views[:i] + views[i + 1 :]))
        out.append(views.pop(i))
    return (out + views)[::-1]


def best_views(spark, model, reference, k, share=0.002, search=0.5, before=(), seed=0):
    """(views, loss) for a scan of the reference."""
    import numpy as np

    rows, products = basis(spark, model, reference, share, seed)
    n, gamma = model.sinogram_shape[0], np.zeros(model.sinogram_shape[0])
    for r in products.collect():
        gamma[r.view] = r.gamma
    return choose(matrix(gram(rows), n), gamma, k, search, before, seed=seed)
