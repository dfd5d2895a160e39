import numpy as np

from rayframe.llm import langid, quality, toxicity


def test_langid_held_out(tables):
    docs = tables("documents")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got) > 0


def test_langid_edges(odd):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (0, 1, 2, 4))
    assert langid.identify(odd.where("false")).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.where("lang is null")).collect()} == {"und"}


def test_quality_held_out(tables):
    got = quality.score(tables("documents"), quality.train(tables("documents"), tables("labels"))).join(tables("labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.9 * len(got) > 0


def test_quality_edges(odd, tables):
    model = quality.train(tables("documents"), tables("labels"))
    got = quality.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    none = quality.train(odd, tables("labels").where("false"))
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}


def test_toxicity_held_out(tables):
    got = toxicity.score(tables("documents"), toxicity.train(tables("documents"), tables("labels"))).join(tables("labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.85 * len(got) > 0
    assert sum(r.predicted for r in got if not r.toxic) <= 0.05 * len(got)


def test_toxicity_edges(odd, tables):
    model = toxicity.train(tables("documents"), tables("labels"))
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in toxicity.score(odd, toxicity.train(odd, tables("labels").where("false"))).collect()} == {0.0}


def _stems(copies=1, seed=3):
    """Made-up texts; toxic ones hold a stem with ever new endings, ordinary ones seldom."""
    import random

    r = random.Random(seed)
    made = lambda n: "".join(r.choice("abdefgiklmnoprstu") for _ in range(n))
    texts, labels = [], []
    for i in range(400):
        y = int(i % 8 < 2)
        w = ["common"] + [made(r.randint(3, 9)) for _ in range(120)]
        for _ in range(4 if y else r.random() < 0.03):
            w[r.randrange(1, 120)] = "zwäxuq" + made(r.randint(2, 5))
        texts.append(" ".join(w))
        labels.append(y)
    return texts, labels


def test_toxicity_stems():
    texts, labels = _stems()
    model = toxicity.Model(texts, labels)
    fresh, y = _stems(seed=4)
    got = model.scores(fresh) >= 0.3
    assert sum(p for p, t in zip(got, y) if t) >= 0.95 * sum(y)
    assert sum(p for p, t in zip(got, y) if not t) <= 0.02 * len(y)


def test_toxicity_copies():
    """Texts that share one word, of whatever hash, are no copies; texts with few changes are."""
    words = [f"w{i}" for i in range(4000)]
    apart = [set(words[i * 50 : i * 50 + 50]) | {"common", "and", "the"} for i in range(60)]
    assert toxicity.copies(apart) == list(range(60))
    near = apart[0] - {"w1"} | {"new"}
    assert toxicity.copies([*apart, near, apart[7]])[60:] == [0, 7]


def test_language_scores_same_as_plain_sums(tables):
    """The scores of a fitted model, recomputed gram by gram with dicts."""
    import math
    import re

    from rayframe.llm import langid

    docs = tables("documents").where("lang is not null").limit(300).toPandas()
    names, w, idf, temperature = langid.fit(list(docs.text), list(docs.lang))
    for text in docs.text[:20]:
        t = re.sub(r"[^\w]+|[\d_]+", " ", f" {text.lower()} ")
        t = re.sub(" +", " ", t)
        n = {}
        for size in (1, 2, 3):
            for i in range(len(t) - size + 1):
                h = 0
                for k, c in enumerate(t[i : i + size], 1):
                    h = (h * 0x9E3779B97F4A7C15 + ord(c) + k) % 2**64
                h = ((h ^ h >> 31) * 0xBF58476D1CE4E5B9) % 2**64 >> 64 - langid.BITS
                n[h] = n.get(h, 0) + 1
        ids, x = langid.tfidf(text, idf)
        if dict(zip(ids.tolist(), langid.counts(text)[1].tolist())) != n:
            continue  # marks and letters of other scripts are told apart by the operator only
        y = {h: math.log1p(c) * idf[h] for h, c in n.items()}
        norm = math.sqrt(sum(v * v for v in y.values()))
        want = [sum(v / norm * w[h][k] for h, v in y.items()) for k in range(len(names))]
        assert np.allclose(x @ w[ids], want)


def test_quality_scores_same_as_log_densities():
    from rayframe.llm.quality import RIDGE, SHRINK, Discriminant

    r = np.random.default_rng(3)
    x = np.r_[r.normal(0, 1, (80, 4)), r.normal(0.7, 2, (50, 4))]
    y = np.r_[np.zeros(80, int), np.ones(50, int)]
    m = Discriminant(x, list(y))
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = own[0] * 80 / 130 + own[1] * 50 / 130
    density = []
    for k in (0, 1):
        c = (1 - SHRINK) * own[k] + SHRINK * (pooled + np.diag(np.diag(pooled))) / 2 + RIDGE * np.eye(4)
        d = z - z[y == k].mean(0)
        density.append(-np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) / 2 - np.linalg.slogdet(c)[1] / 2)
    odds = (density[1] - density[0] + np.log(50 / 80)) / m.t
    assert np.allclose(m.scores(x), 1 / (1 + np.exp(-odds)))
