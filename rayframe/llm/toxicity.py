"""Toxicity by compression distance: one zstandard dictionary per class, window lengths
and a calibrated threshold.

A window is a piece of one word, as four bytes a code point: each start of it of 3 to
LONGEST letters, and the whole word between marks, so a stem with changing endings is one
window. At that width a match of one short piece outweighs the frame's fixed bytes. Both
dictionaries end with the same ordinary windows; the toxic one also holds windows that
more toxic documents hold, or hold densely, than chance would give. Gains under a cut chosen on the sample count as
none, and a word gains what its best window does. A document's figures are its largest
gain, its count of gaining words (more than three tell no more) and their share of all
words, turned into a probability by a logistic fit on the labelled sample (at most SAMPLE
rows; odd rows choose the dictionary, all rows calibrate). Copies in the sample count once.
Null and empty texts have no window and score as such. Without both labels every score
is the known share (0 without labels). A score of 0.3 counts as toxic, and of equally good
cuts the least stands. Rows are judged one by one, so repeated rows and null ids change
nothing.
"""
import string

from rayframe.llm.common import held_out, sample_labelled, small_batches

SAMPLE, WORDS_EACH, CACHE, LONGEST = 4000, 400, 300_000, 8
PERMUTATIONS, ALIKE = 16, 0.7
# A document holds a piece densely if it has it twice and once in so many words.
DENSE = 250
MARKS = string.punctuation + "\u00a1\u00bf\u00ab\u00bb\u201c\u201d\u201e\u2018\u2019\u2026"


def window(piece):
    return f"<<{piece}".encode("utf-32-le", "replace")


def windows(text):
    return [w for w in (w.strip(MARKS) for w in text.lower().split()) if w]


def pieces(word):
    """The starts of a word and, marked, the whole of it."""
    return [word[:k] for k in range(3, min(len(word), LONGEST) + 1)] + [word + ">>"]


def copies(sets):
    """The number of the first of its copies for each word set: MinHash bands propose, Jaccard decides."""
    import zlib

    import numpy as np

    r = np.random.default_rng(5)
    by = r.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
    firsts, bands = list(range(len(sets))), {}
    for i, words in enumerate(sets):
        h = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in words], dtype=np.uint64) + np.uint64(1)
        least = ((h[:, None] * by) >> np.uint64(20)).min(0).tolist() if len(h) else [0] * PERMUTATIONS
        keys, tried = [(b, least[b], least[b + 1]) for b in range(0, PERMUTATIONS, 2)], set()
        for j in (j for k in keys for j in bands.get(k, ())):
            if j not in tried:
                tried.add(j)
                if len(words & sets[j]) >= ALIKE * len(words | sets[j]):
                    firsts[i] = j
                    break
        if firsts[i] == i:
            for k in keys:
                bands.setdefault(k, []).append(i)
    return firsts


class Model:
    def __init__(self, texts, labels):
        import math
        import zlib
        from collections import Counter

        import numpy as np

        self.share = float(np.mean(labels)) if len(labels) else 0.0
        self.dicts = None
        if len(set(labels)) < 2:
            return
        df, n = [[Counter(), Counter()] for _ in range(2)], [0, 0]
        picked = [i for i in range(len(texts)) if i % 2 or len(labels) < 40]
        counted, alike = [Counter(windows(texts[i])) for i in picked], Counter()
        seen = [set(c) for c in counted]
        # Copies of a class count as one document.
        firsts = [None] * len(picked)
        for y in (0, 1):
            own = [k for k, i in enumerate(picked) if labels[i] == y]
            for k, f in zip(own, copies([seen[k] for k in own])):
                firsts[k] = own[f]
        alike.update(firsts)
        for k, i in enumerate(picked):
            share, held = 1 / alike[firsts[k]], Counter()
            n[labels[i]] += share
            for w, c in counted[k].items():
                for x in pieces(w):
                    held[x] += c
            least = max(2, counted[k].total() / DENSE)
            for x, c in held.items():
                df[0][labels[i]][x] += share
                if c >= least:
                    df[1][labels[i]][x] += share
        p = n[1] / (n[0] + n[1])
        # Bits against chance, kept above what the best of all pieces frequent enough to reach it would.
        proof, most = {}, []
        for ordinary, told in df:
            for w, k in told.items():
                a = ordinary[w]
                most.append(-(k + a) * math.log(p))
                if k > p * (k + a):
                    got = k * math.log(k / ((k + a) * p)) + (a and a * math.log(a / ((k + a) * (1 - p))))
                    proof[w] = max(proof.get(w, 0), got)
        most = np.sort(most)
        least_proof = next((t for t in np.arange(3, 40, 0.1) if t >= math.log(1 + len(most) - np.searchsorted(most, t)) + 3), 40)
        toxic = []
        # The longest of equally telling pieces stands, and none beside its own start or continuation.
        for w in sorted((w for w in proof if proof[w] > least_proof), key=lambda w: (-round(proof[w], 6), w.endswith(">>"), -len(w), w)):
            if len(toxic) < WORDS_EACH and not any(w.startswith(x) or x.startswith(w) for x in toxic):
                toxic.append(w)
        common = sorted(df[0][0].items(), key=lambda x: (-x[1], x[0]))[: WORDS_EACH + 20 * len(toxic)]
        ordinary = [w for w, _ in common if not any(w.startswith(x) for x in toxic)][:WORDS_EACH]
        base = b"".join(map(window, ordinary))
        self.dicts = (base, base + b"".join(map(window, toxic)))
        self.sure = toxic or [""]
        self.sizes, self.whole = sorted({len(w) for w in toxic if not w.endswith(">>")}), any(w.endswith(">>") for w in toxic)
        self._open()
        y, gains = np.array(labels), [self._gains(t) for t in texts]
        self.cut, self.mid, self.scale, self.w, _ = min((self._fit(gains, y, c) for c in np.arange(0.4, 1.01, 0.1).round(1)), key=lambda f: f[-1])

    def _fit(self, gains, y, cut):
        """cut, centre, scale and weights of a logistic fit, and its loss."""
        import numpy as np

        x = np.array([self._figures(*g, cut) for g in gains])
        mid, scale = x.mean(0), x.std(0) + 1e-9
        x, w = np.c_[(x - mid) / scale, np.ones(len(x))], np.zeros(x.shape[1] + 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ w))
            h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(w))
            w = w - np.linalg.solve(h, x.T @ (p - y) + 0.1 * w)
        return cut, mid, scale, w, float(-np.log(np.where(y == 1, p, 1 - p) + 1e-9).sum())

    def _open(self):
        import zstandard as z

        params = z.ZstdCompressionParameters.from_level(9, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, window_log=17)
        self.coders = [z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params) for d in self.dicts]
        self.gains, self.floor = {}, max(len(self.coders[1].compress(window(w))) for w in self.sure)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("coders", "gains", "floor")}

    def gain(self, word):
        """Bytes the toxic dictionary saves over the ordinary one on the best window, as a share of all that could be saved."""
        got = [self._saved(word[:k]) for k in self.sizes if k <= len(word)]
        return max(got + [self._saved(word + ">>")] if self.whole else got, default=0)

    def _saved(self, piece):
        got = self.gains.get(piece)
        if got is None:
            if len(self.gains) > CACHE:
                self.gains.clear()
            b = window(piece)
            a, c = (len(x.compress(b)) for x in self.coders)
            got = self.gains[piece] = min(1, max(0, a - c) / max(1, a - self.floor))
        return got

    def _gains(self, text):
        """The gains above 0 of a text's words, and how many words it has."""
        ws = windows(text)
        return [x for x in map(self.gain, ws) if x], len(ws)

    def _figures(self, gains, count, cut):
        g = [x for x in gains if x >= cut]
        return [max(g, default=0), min(3, len(g)) ** 0.5, min(0.02, len(g) / max(1, count)) ** 0.5]

    def figures(self, text):
        return self._figures(*self._gains(text), self.cut)

    def scores(self, texts):
        import numpy as np

        if self.dicts is None:
            return np.full(len(texts), self.share)
        if not hasattr(self, "coders"):
            self._open()
        x = np.array([self.figures(t) for t in texts]).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(np.c_[(x - self.mid) / self.scale, np.ones(len(x))] @ self.w, -500, 500)))


def train(docs, labels, bound=SAMPLE):
    s = sample_labelled(docs.where(~held_out(4, 2)), labels, "toxic", bound)
    return Model([t or "" for t in s.text], list(s.y))


def score(docs, model):
    """doc_id, held_out, score, predicted of each whole text."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            p = model.scores([t or "" for t in pdf.text])
            yield pd.DataFrame({"doc_id": pdf.doc_id, "held_out": pdf.held_out, "score": p, "predicted": (p >= 0.3).astype(int)})

    small_batches(docs.sparkSession)
    return docs.select("doc_id", held_out(4, 2).alias("held_out"), "text").mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")
