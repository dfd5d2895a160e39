"""Queries on the measurement array: Spark runs the operators, the SQL is the oracle's."""
from pyspark.sql import functions as F

from rayframe.operators import hardening, regularise, scans
from rayframe.sources.tables import SINO, run

_BODIES = {
    "weights_unweighted": "SELECT view, det_row, channel, 1.0e0 AS w FROM s",
    "weights_transmission": "SELECT view, det_row, channel, round(exp(-value), 6) AS w FROM s",
    "weights_transmission_root": "SELECT view, det_row, channel, round(exp(-value / 2), 6) AS w FROM s",
    "weights_emission": "SELECT view, det_row, channel, round(1.0e0 / (abs(value) + 1.0e-1), 6) AS w FROM s",
    "transmission": "SELECT view, det_row, channel, round(t, 6) + 0e0 AS t FROM t0",
    "defect_fill": "SELECT view, det_row, channel, round(t, 6) + 0e0 AS t FROM t3",
    "bh_polynomial": "SELECT view, det_row, channel, round(value * (1e0 + value * (0.2e0 + value * 0.05e0)), 6) AS v FROM s",
    "remove_sino_offset": "SELECT view, det_row, channel, round(value - m + min(m) OVER (PARTITION BY det_row), 6) + 0e0 AS v FROM (SELECT view, det_row, channel, value, avg(value) OVER (PARTITION BY view, det_row) AS m FROM s) x",
    "sino_histogram": "SELECT bin, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(least(7, floor((value - lo) / ((hi - lo) / 8))) AS INT) AS bin FROM s CROSS JOIN (SELECT min(value) AS lo, max(value) AS hi FROM s) m) x GROUP BY bin",
    "line_search_terms": "SELECT round(sum(w * e * d), 6) AS lin, round(sum(w * d * d), 6) AS quad FROM (SELECT exp(-value) AS w, value - 0.76e0 AS e, (view + channel) % 3 - 1e0 AS d FROM s) x",
}
# A scan made of the array: blank 1, dark 0.01; cells that hold no count and listed defects are NULL, then three fill passes and 0.
_SCAN = "t0 AS (SELECT view, det_row, channel, CASE WHEN det_row = 2 AND channel IN (3, 4, 5) THEN NULL WHEN abs(exp(-value) - 1e-2) > 0 THEN -ln(abs(exp(-value) - 1e-2) / 0.99e0) END AS t FROM s)"


def _fill(i):
    box = "OVER (PARTITION BY view, {0} ORDER BY {1} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
    down, along = box.format("channel", "det_row"), box.format("det_row", "channel")
    return (
        f"b{i} AS (SELECT view, det_row, channel, t, sum(coalesce(t, 0e0)) {down} AS v, sum(CASE WHEN t IS NULL THEN 0e0 ELSE 1e0 END) {down} AS n FROM t{i}), "
        f"t{i + 1} AS (SELECT view, det_row, channel, coalesce(t, sum(v) {along} / nullif(sum(n) {along}, 0e0){', 0e0' if i == 2 else ''}) AS t FROM b{i})"
    )


_HEADS = {"transmission": _SCAN, "defect_fill": ", ".join([_SCAN, *map(_fill, range(3))])}
SQL = {k: f"WITH s AS ({SINO}){', ' + _HEADS[k] if k in _HEADS else ''} {v}" for k, v in _BODIES.items()}
CELL = ["view", "det_row", "channel"]


def _sino(spark, d):
    return run(spark, d, SINO)


def _out(df, name="v"):
    return df.select(*CELL, (F.round("value", 6) + 0.0).alias(name))


def _weights(kind):
    return lambda spark, d: _out(regularise.weights(_sino(spark, d), kind), "w")


def _scan(spark, d):
    """The array as a scan: blank 1, dark 0.01, listed defects."""
    y = scans.transmission(F.exp(-F.col("value")), F.lit(1.0), F.lit(0.01))
    return scans.mark(_sino(spark, d).withColumn("value", y), spark.createDataFrame([(2, c) for c in (3, 4, 5)], "det_row int, channel int"))


def _histogram(spark, d):
    counts, _ = regularise.histogram(_sino(spark, d), 8)
    return spark.createDataFrame([(i, int(n)) for i, n in enumerate(counts) if n], "bin int, n long")


def _line(spark, d):
    s = _sino(spark, d)
    errors = s.select(*CELL, (F.col("value") - 0.76).alias("value"), F.exp(-F.col("value")).alias("weight"))
    change = s.select(*CELL, ((F.col("view") + F.col("channel")) % 3 - 1.0).alias("value"))
    return regularise.line_search_sums(errors, change).select(F.round("linear", 6).alias("lin"), F.round("quadratic", 6).alias("quad"))


QUERIES = {
    "weights_unweighted": _weights("unweighted"),
    "weights_transmission": _weights("transmission"),
    "weights_transmission_root": _weights("transmission_root"),
    "weights_emission": _weights("emission"),
    "transmission": lambda spark, d: _out(_scan(spark, d), "t"),
    "defect_fill": lambda spark, d: _out(scans.fill(_scan(spark, d)), "t"),
    "bh_polynomial": lambda spark, d: _out(_sino(spark, d).withColumn("value", hardening.polynomial(F.col("value"), [1.0, 0.2, 0.05]))),
    "remove_sino_offset": lambda spark, d: _out(scans.remove_offset(_sino(spark, d))),
    "sino_histogram": _histogram,
    "line_search_terms": _line,
}
