"""Beam hardening: curves, their fits on the driver (few parameters), and sums for metal corrections."""
from pyspark.sql import functions as F


def polynomial(value, alpha):
    """Column: sum of alpha[k] * value ** (k + 1)."""
    out = F.lit(0.0)
    for a in reversed(alpha):
        out = (out + F.lit(float(a))) * value
    return out


def evaluate(value, coefficients):
    """Column: a polynomial, highest power first."""
    out = F.lit(0.0)
    for c in coefficients:
        out = out * value + float(c)
    return out


def curve(path, params, from_zero=True):
    """Column: -ln of the sum over i of exp(theta_i - i * theta_0 * path), less its value at 0 if `from_zero`; the largest exponent is taken out first."""
    rate, rest = float(params[0]), [float(x) for x in params[1:]]
    if not rest:
        raise ValueError("a rate and one weight at least")
    terms = [F.lit(t) - i * rate * path for i, t in enumerate(rest, 1)]
    top = F.greatest(*terms) if len(terms) > 1 else terms[0]
    total = sum((F.exp(t - top) for t in terms[1:]), F.exp(terms[0] - top))
    y = -(top + F.ln(total))
    return y - curve(F.lit(0.0), params, False) if from_zero else y


def curve_values(path, params, from_zero=True):
    """The same for a NumPy array."""
    import numpy as np

    e = np.asarray(params[1:])[:, None] - np.arange(1, len(params))[:, None] * params[0] * np.atleast_1d(path)[None]
    y = -np.logaddexp.reduce(e, 0)
    return y - curve_values(0.0, params, False) if from_zero else y


def fit_curve(pairs, n=5, from_zero=True, bound=200_000):
    """Parameters of the curve through columns p and y, by damped Gauss-Newton steps on at most `bound` pairs of a fixed order."""
    import numpy as np

    if n < 2:
        raise ValueError("two parameters at least")
    ok = pairs.where("p > 1e-6 AND y > 1e-6 AND NOT isnan(p) AND NOT isnan(y) AND p < 1e300 AND y < 1e300")
    rows = ok.select("p", "y").orderBy(F.xxhash64("p", "y"), "p", "y").limit(bound).collect()
    if not rows:
        raise ValueError("no pair can be fitted")
    p, y = np.array(rows).T
    theta = np.r_[1.0, np.zeros(n - 1)]
    miss = lambda t: curve_values(p, t, from_zero) - y
    r, damp = miss(theta), 1e-3
    for _ in range(20 * n):
        j = np.stack([(miss(theta + h) - miss(theta - h)) / 2e-6 for h in 1e-6 * np.eye(n)], 1)
        a, g = j.T @ j, j.T @ r
        new = theta - np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-12), g)
        s = miss(new)
        if s @ s < r @ r:
            done = r @ r - s @ s <= 1e-9 * (r @ r)
            theta, r, damp = new, s, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return theta


def fit_inverse(params, lo=0.0, hi=5.0, degree=10, samples=2000, from_zero=True):
    """(Chebyshev coefficients, (lo, hi)): the linear projection of a hardened one, scaled by the curve's slope at 0."""
    import numpy as np

    if not hi > lo or degree < 1 or samples <= degree:
        raise ValueError("lo < hi, a degree of 1 at least and more samples than that")
    slope = float((curve_values(1e-6, params, from_zero) - curve_values(0.0, params, from_zero))[0] / 1e-6)
    top = max(1.0, abs(hi) + 1)
    for _ in range(64):
        if curve_values(top, params, from_zero)[0] >= hi:
            break
        top *= 2
    else:
        raise ValueError("the curve doesn't reach hi")
    p = np.linspace(0, top, 4 * samples)
    y, first = np.unique(curve_values(p, params, from_zero), return_index=True)
    if len(y) <= degree:
        raise ValueError("the curve has no inverse")
    at = np.linspace(lo, hi, samples)
    x = np.interp(at, y, p[first]) * slope
    return np.polynomial.chebyshev.chebfit(2 * (at - lo) / (hi - lo) - 1, x, degree), (lo, hi)


def inverse(value, coefficients, domain, clip=False):
    """Column: the Chebyshev series at a hardened projection (Clenshaw's sums)."""
    lo, hi = map(float, domain)
    y = F.greatest(F.lit(lo), F.least(F.lit(hi), value)) if clip else value
    t = 2.0 * (y - lo) / (hi - lo) - 1.0
    b1, b2 = F.lit(0.0), F.lit(0.0)
    for c in reversed(list(coefficients)[1:]):
        b1, b2 = 2.0 * t * b1 - b2 + float(c), b1
    return t * b1 - b2 + float(coefficients[0])


def exponents(metals, order):
    """Exponent tuples of the metals with a degree from 1 to `order`, by degree."""
    import itertools

    return sorted((t for t in itertools.product(range(order + 1), repeat=metals) if 0 < sum(t) <= order), key=sum)


def monomial(powers):
    """Column p^e0 * m1^e1 * … of columns p, m1, m2, …."""
    out = F.lit(1.0)
    for name, e in zip(["p", *(f"m{i}" for i in range(1, len(powers)))], powers):
        out = out * (F.pow(F.col(name), F.lit(float(e))) if e else F.lit(1.0))
    return out


def normal_equations(sinos, powers, crosses, alpha=1.0, beta=0.002):
    """(P, q) of the fit of y by monomials of p, m1, …: all sums in one aggregate."""
    import numpy as np

    k, cols = len(powers), [monomial(t) for t in powers]
    sums = [F.sum(cols[i] * cols[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(c * F.col("y")).alias(f"y{i}") for i, c in enumerate(cols)]
    r = sinos.agg(*sums).first()
    h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    w = np.diag(1 + np.array([float(sum(t)) for t in powers]) ** alpha)
    return h + beta * np.trace(h) / np.trace(w) * w, -np.array([r[f"y{i}"] for i in range(k)])


def solve_qp(p, q, a=None, u=None):
    """The least of x'Px/2 + q'x under a x <= u, by the dual's coordinates; None where they don't settle."""
    import numpy as np

    if a is None or not len(a):
        return np.linalg.solve(p, -q)
    inv = np.linalg.inv(p)
    g, d, y = a @ inv @ a.T, a @ inv @ q + u, np.zeros(len(u))
    for _ in range(20_000):
        before = y.copy()
        for i in range(len(y)):
            y[i] = max(0.0, y[i] - (g[i] @ y + d[i]) / max(g[i, i], 1e-300))
        if np.abs(y - before).max() <= 1e-12 * (1 + np.abs(y).max()):
            break
    x = -inv @ (q + a.T @ y)
    return x if np.isfinite(x).all() and (a @ x <= u + 1e-6 * (1 + np.abs(u))).all() else None


def least_cell(df, value, keys=("view", "det_row", "channel")):
    """(value, keys …) of the least value, the first cell of several."""
    r = df.agg(F.min(F.struct(value.alias("x"), *keys)).alias("m")).first().m
    return None if r is None else tuple(r)


def fit_metal(sinos, powers, crosses, alpha=1.0, beta=0.002, rounds=10, tolerance=-1e-5, floor=1e-6):
    """Coefficients of the hardening model; each round adds the cells that break its signs most as constraints."""
    import numpy as np

    p, q = normal_equations(sinos, powers, crosses, alpha, beta)
    first = 1 + crosses
    slopes = [(0, *t[1:]) for t in powers[:first]]
    metals = len(powers[0]) - 1
    theta, rows, limits, seen = solve_qp(p, q), [], [], set()
    for _ in range(rounds):
        sp = sum((float(c) * monomial(t) for c, t in zip(theta, slopes)), F.lit(0.0))
        sm = F.col("y") - sum((float(c) * monomial(t) for c, t in zip(theta[first:], powers[first:])), F.lit(0.0))
        metal = F.greatest(*(F.col(f"m{i + 1}") for i in range(metals))) if metals > 1 else F.col("m1")
        low = least_cell(sinos, sp), least_cell(sinos.where(metal > floor), sm)
        if all(x is None or x[0] >= tolerance for x in low):
            break
        for kind, x in enumerate(low):
            if x is None or x[0] >= tolerance or (kind, x[1:]) in seen:
                continue
            seen.add((kind, x[1:]))
            cell = sinos.where((F.col("view") == x[1]) & (F.col("det_row") == x[2]) & (F.col("channel") == x[3]))
            r = cell.select(*(monomial(t) for t in (slopes if kind == 0 else powers[first:])), "y").first()
            rows.append(np.r_[-np.array(r[:-1]), np.zeros(len(powers) - first)] if kind == 0 else np.r_[np.zeros(first), np.array(r[:-1])])
            limits.append(0.0 if kind == 0 else max(r[-1], 0.0))
        new = solve_qp(p, q, np.array(rows), np.array(limits)) if rows else None
        if new is None:
            break
        theta = new
    return theta


def correct_metal(sinos, theta, powers, crosses, scale, gamma=0.1):
    """sinos with `plastic`: what the plastic alone would give, were there no hardening."""
    first = 1 + crosses
    sp = sum((float(c) * monomial((0, *t[1:])) for c, t in zip(theta, powers[:first])), F.lit(0.0))
    ym = F.greatest(F.lit(0.0), F.col("y") - sum((float(c) * monomial(t) for c, t in zip(theta[first:], powers[first:])), F.lit(0.0)))
    low = gamma * sinos.agg(F.avg(sp)).first()[0]
    return sinos.withColumn("plastic", scale * ym / F.greatest(sp, F.lit(float(low))))


def correct_plastic_metal(spark, model, sino, volume, metals=1, order=3, alpha=1.0, beta=0.002, gamma=0.1, rounds=10, margins=(None, None, None)):
    """A sinogram as if rays were of one energy: plastic and metals told apart in a reconstruction, projected, the hardening fitted and taken back."""
    from rayframe.operators import project, regularise

    keys = ["view", "det_row", "channel"]
    seg, scales = regularise.segment(volume, model.params["recon_shape"], metals, *margins)
    powers = [(1,) + (0,) * metals] + [(1, *t) for t in exponents(metals, order - 1)] + [(0, *t) for t in exponents(metals, order)]
    crosses = len(exponents(metals, order - 1))
    x = sino.withColumnRenamed("value", "y")
    for k in range(metals + 1):
        part = seg.withColumn("value", F.when(F.col("class") == k + 1, F.lit(scales[0]) if k == 0 else F.col("value")).otherwise(0.0))
        x = x.join(project.forward_project(spark, model, part).withColumnRenamed("value", "p" if k == 0 else f"m{k}"), keys)
    x = x.checkpoint()
    tops = x.agg(*(F.max(F.abs(c)).alias(c) for c in x.columns if c not in (*keys, "y"))).first().asDict()
    if any(not v or v <= 0 for v in tops.values()):
        raise ValueError("a class of the segmentation is empty")
    x = x.select(*keys, "y", *((F.col(c) / v).alias(c) for c, v in tops.items()))
    theta = fit_metal(x, powers, crosses, alpha, beta, rounds)
    x = correct_metal(x, theta, powers, crosses, tops["p"], gamma)
    alone = F.col("p") != 0
    for k in range(metals):
        alone = alone & (F.col(f"m{k + 1}") == 0)
    pair = x.where(alone).select(F.col("y").alias("t"), F.col("plastic").alias("v"))
    scale = regularise.scaling_factor(pair).first().scale or 0.0
    total = scale * F.col("plastic") + sum((F.col(f"m{k + 1}") * tops[f"m{k + 1}"] for k in range(metals)), F.lit(0.0))
    return x.select(*keys, total.alias("value"))


def linearisation(alpha, density1, density2, order=8, thickest=30.25, step=0.25):
    """Coefficients, highest power first, that make the projection through two mixed materials linear in thickness."""
    import numpy as np

    t = np.arange(0, thickest, step)
    seen = density2 * t + np.log((1 + alpha) / (1 + alpha * np.exp((density2 - density1) * t)))
    mean = (alpha * density1 + density2) / (1 + alpha)
    return np.polyfit(np.r_[0, seen], np.r_[0, mean * t], order)


def linearised(sino, alpha, density1, density2, thickest):
    """sino after that polynomial."""
    return sino.withColumn("value", evaluate(F.col("value"), linearisation(alpha, density1, density2, thickest=thickest)))
