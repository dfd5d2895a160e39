"""Language ID: multinomial logistic regression on hashed TF-IDF character n-grams,
trained by follow-the-regularised-leader with elastic-net penalties, then calibrated
with one temperature.

Fitted on at most SAMPLE rows with a lang and a letter. `und` with score 0 for null
texts and texts without a letter, or where no row could be learned from. Of languages with
equal scores the first in order stands, of equally good temperatures the least. Rows are
judged one by one, so repeated rows, null ids and extra columns change nothing.
"""
from pyspark.sql import functions as F

from rayframe.llm.common import held_out, sample, small_batches

SAMPLE, BITS, EPOCHS = 3000, 16, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3


def counts(text):
    """(buckets, counts) of the 1- to 3-grams of code points, lower case, runs of non-letters as one space."""
    import numpy as np
    import regex

    t = regex.sub(r"[^\p{L}\p{M}]+", " ", f" {text.lower()} ")
    c = np.frombuffer(t.encode("utf-32-le", "replace"), "u4").astype("u8")
    grams, h = [], np.zeros(len(c), "u8")
    for n in range(1, 4):
        h = (h[: len(c) - n + 1] if n > 1 else h) * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(n)
        grams.append(((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS))
    return np.unique(np.concatenate(grams).astype("i8"), return_counts=True)


def has_letter(text):
    import regex

    return text is not None and regex.search(r"\p{L}", text) is not None


def tfidf(text, idf):
    import numpy as np

    ids, n = counts(text)
    x = np.log1p(n) * idf[ids]
    return ids, x / (np.linalg.norm(x) or 1)


def fit(texts, langs):
    """(names, weights, idf, temperature); every tenth row only calibrates."""
    import numpy as np

    names = sorted(set(langs))
    if not names:
        return names, None, None, 1.0
    df = np.zeros(1 << BITS)
    for t in texts:
        df[counts(t)[0]] += 1
    idf = np.log((1 + len(texts)) / (1 + df)) + 1
    rows, y = [tfidf(t, idf) for t in texts], [names.index(x) for x in langs]
    z, n = np.zeros((1 << BITS, len(names))), np.zeros((1 << BITS, len(names)))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    def soft(s):
        e = np.exp(s - s.max())
        return e / e.sum()

    train = [i for i in range(len(rows)) if i % 10 or len(rows) < 50]
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(train):
            ids, x = rows[i]
            w = weights(z[ids], n[ids])
            p = soft(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            z[ids] += g - (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / ALPHA * w
            n[ids] += g * g
    w = weights(z, n)
    scores = [rows[i][1] @ w[rows[i][0]] for i in range(0, len(rows), 10)]
    loss = lambda t: -sum(np.log(soft(s / t)[y[10 * k]] + 1e-12) for k, s in enumerate(scores))
    return names, w, idf, float(min(np.geomspace(0.05, 10, 60), key=loss))


def predict(docs, model, prefix=""):
    """Columns of docs but text, with lang_pred and score; a prefix keeps these from clashing."""
    names, w, idf, temperature = model

    def run(batches):
        import numpy as np

        for pdf in batches:
            pred, score = [], []
            for t in pdf.text:
                if not names or not has_letter(t):
                    pred.append("und"), score.append(0.0)
                    continue
                ids, x = tfidf(t, idf)
                s = x @ w[ids] / temperature
                p = np.exp(s - s.max())
                p /= p.sum()
                pred.append(names[int(p.argmax())]), score.append(float(p.max()))
            pdf = pdf.drop(columns="text")
            pdf[prefix + "lang_pred"], pdf[prefix + "score"] = pred, score
            yield pdf

    small_batches(docs.sparkSession)
    return docs.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text") + f", `{prefix}lang_pred` string, `{prefix}score` double")


def train(docs, bound=SAMPLE):
    """Model from the rows that are not held out."""
    known = docs.where(~held_out(5, 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    s = sample(known, bound, "text", "lang")
    return fit(list(s.text), list(s.lang))


def identify(docs):
    """doc_id, held_out, lang_pred, score of each whole text."""
    return predict(docs.select("doc_id", held_out(5, 0).alias("held_out"), "text"), train(docs))
