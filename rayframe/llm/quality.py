"""Quality: regularised quadratic discriminant over transformed document statistics.

Class covariances shrink towards the pooled one and its diagonal; a score is the
logistic of the difference of Mahalanobis log densities from cached Cholesky factors,
scaled by a fitted temperature. Fitted on at most SAMPLE labelled rows; with fewer than
two classes every score is the known class's share (0.5 without labels). Null counts
as empty text. A score of 0.5 counts as 1, and of equally good temperatures the least
stands. Rows are judged one by one, so repeated rows and null ids change nothing.
"""
from rayframe.llm.common import held_out, sample_labelled, small_batches

SAMPLE, SHRINK, RIDGE = 4000, 0.3, 1e-3


def statistics(text):
    """Transformed statistics of one whole text."""
    import math
    import re

    import numpy as np

    words = text.split()
    nw, nc = max(1, len(words)), max(1, len(text))
    lens = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    letters = sum(map(len, re.findall(r"[^\W\d_]+", text)))
    upper = len(re.findall(r"[A-ZÀ-Þ]", text))
    digits, spaces, lines = len(re.findall(r"\d", text)), sum(map(len, re.findall(r"\s+", text))), text.split("\n")
    logit = lambda x: math.log((x + 1e-3) / (1 - x + 1e-3))
    _, c = np.unique(np.frombuffer(text.encode("utf-32-le", "replace"), "u4"), return_counts=True)
    p = c / max(1, c.sum())
    return [
        math.log1p(len(words)), lens.mean(), math.log1p(lens.std()), logit(letters / nc), logit(upper / max(1, letters)), logit(digits / nc),
        logit(max(0, nc - letters - digits - spaces) / nc), math.log((len(set(words)) + 1) / (nw + 1)), logit(len(set(lines)) / len(lines)),
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0, logit(sum(text.count(x) for x in ".!?") / nc), logit(sum(w[-1] in "!#$%&*|<>@^~" for w in words) / nw), math.log1p(nw / len(lines)),
    ]


class Discriminant:
    def __init__(self, x, y):
        import numpy as np

        self.prior = float(np.mean(y)) if len(y) else 0.5
        self.parts = None
        if len(set(y)) < 2:
            return
        y = np.array(y)
        self.mid, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mid) / self.scale
        own = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
        pooled = sum(c * np.mean(y == k) for k, c in enumerate(own))
        self.parts = []
        for k in (0, 1):
            c = (1 - SHRINK) * own[k] + SHRINK * (pooled + np.diag(np.diag(pooled))) / 2 + RIDGE * np.eye(x.shape[1])
            chol = np.linalg.cholesky(c)
            self.parts.append((x[y == k].mean(0), np.linalg.inv(chol), 2 * np.log(np.diag(chol)).sum()))
        raw = self._raw(x)
        loss = lambda t: np.logaddexp(0, -np.where(y == 1, raw, -raw) / t).sum()
        self.t = float(min(np.geomspace(0.5, 50, 40), key=loss))

    def _raw(self, x):
        import math

        d = [-(((x - m) @ inv.T) ** 2).sum(1) / 2 - ld / 2 for m, inv, ld in self.parts]
        return d[1] - d[0] + math.log(self.prior / (1 - self.prior))

    def scores(self, x):
        import numpy as np

        if self.parts is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._raw((x - self.mid) / self.scale) / self.t, -500, 500)))


def train(docs, labels, bound=SAMPLE):
    import numpy as np

    s = sample_labelled(docs.where(~held_out(3, 1)), labels, "quality", bound)
    return Discriminant(np.array([statistics(t or "") for t in s.text]), list(s.y))


def score(docs, model):
    """doc_id, held_out, score, predicted of each whole text."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            x = np.array([statistics(t or "") for t in pdf.text])
            p = model.scores(x) if len(x) else []
            yield pd.DataFrame({"doc_id": pdf.doc_id, "held_out": pdf.held_out, "score": p, "predicted": np.array(p) >= 0.5}).astype({"predicted": int})

    small_batches(docs.sparkSession)
    return docs.select("doc_id", held_out(3, 1).alias("held_out"), "text").mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")
