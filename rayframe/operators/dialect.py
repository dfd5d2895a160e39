"""One SQL text for both engines; only the words below differ. {median} is that of x."""


class _Series:
    """{series:n}: a relation with the ids 0 to n - 1."""

    def __init__(self, form):
        self.form = form

    def __format__(self, n):
        return self.form % n


SPARK = {"series": _Series("range(%s)"), "median": "percentile(x, 0.5e0)"}
DUCK = {"series": _Series("(SELECT range AS id FROM range(%s))"), "median": "quantile_cont(x, 0.5e0)"}


def queries(bodies, head=""):
    """(QUERIES, SQL) of bodies that read no table."""
    text = lambda b, words: (head + b).format(**words)
    sql = {k: text(b, DUCK) for k, b in bodies.items()}
    return {k: (lambda spark, sf_dir, q=text(b, SPARK): spark.sql(q)) for k, b in bodies.items()}, sql
