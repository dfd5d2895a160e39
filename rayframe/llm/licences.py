"""Licence scans: a trained paragraph classifier confirmed by template comparison.

Word 1- to 3-grams, hashed, feed a multinomial logistic regression over licence families
and `none`; it learns from sentences that a small grammar makes around each template
and from paragraphs (20 * SAMPLE at most, by hash) of at most SAMPLE ordinary documents. A family stands only if its
probability reaches a cut that a PASSED share of held-back ordinary paragraphs stay under, and a template
of the family shares enough words in order with the paragraph; the rest are `unknown`
where the classifier sees a licence, else none. Paragraphs are lines; null, empty and
blank ones have no licence. A line is judged as a whole and by each stretch of it that
a template resembles or that surrounds a licence word, so a notice in a long line is not
outvoted; a line can hold several families. Rows are judged one by one, so repeated rows
and null ids change nothing; of equally likely families the first in order stands. Without such a stretch no verdict is possible.
"""
import bisect
import re

from rayframe.llm.common import sample, small_batches

SAMPLE, BITS, EPOCHS, OVERLAP, AROUND, PASSED = 400, 15, 6, 0.6, 8, 0.999
# Families and their common short notices.
TEMPLATES = {
    "apache": ["licensed under the apache license version 2.0", "released under the apache license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted", "released under the bsd license"],
    "cc": ["this work is licensed under a creative commons attribution license", "licensed under cc by 4.0", "licensed under cc by nc 4.0"],
    "gpl": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "licensed under the gnu general public license version 3"],
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software", "released under the mit license"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license", "released under the mpl license"],
    "proprietary": ["all rights reserved no part of this work may be reproduced without permission", "all rights reserved"],
}
WORD = re.compile(r"\w[\w.]*\w|\w")
HINT = {"license", "licence", "licensed", "copyright", "permission", "redistribution", "rights"}


def words(text):
    return WORD.findall(text.lower())


def _pairs():
    """The templates, as (family, number, words), of each word pair."""
    out = {}
    for family, notices in TEMPLATES.items():
        for k, notice in enumerate(notices):
            t = words(notice)
            for pair in zip(t, t[1:]):
                out.setdefault(pair, set()).add((family, k, len(t)))
    return out


PAIRS = _pairs()


def features(ws):
    import zlib

    return sorted({zlib.crc32(" ".join(ws[i : i + n]).encode("utf-8", "replace")) & ((1 << BITS) - 1) for n in (1, 2, 3) for i in range(len(ws) - n + 1)})


def likeness(template, ws):
    """Share of the template's word pairs in the paragraph."""
    t = words(template)
    have = set(zip(ws, ws[1:]))
    return sum(p in have for p in zip(t, t[1:])) / max(1, len(t) - 1)


def stretches(ws):
    """(start, end) of stretches that hold enough word pairs of one template."""
    at, out = {}, []
    for i, pair in enumerate(zip(ws, ws[1:])):
        for t in PAIRS.get(pair, ()):
            at.setdefault(t, []).append((i, pair))
    for t, found in at.items():
        need, reach = OVERLAP * (t[2] - 1), 1.5 * t[2] + 2
        if len({pair for _, pair in found}) < need:
            continue
        for a, (first, _) in enumerate(found):
            have, last = set(), first
            for i, pair in found[a:]:
                if i - first > reach:
                    break
                if pair not in have:
                    have.add(pair)
                    last = i
            if len(have) >= need:
                out.append((first, last + 2))
    return sorted(set(out))


class Model:
    def __init__(self, ordinary):
        import random

        import numpy as np

        r = random.Random(5)
        self.names, rows = ["none", *sorted(TEMPLATES)], []
        kept = [w for w in map(words, ordinary) if w and not HINT & set(w)] or [["text"]]
        for k, family in enumerate(self.names[1:], 1):
            for t in TEMPLATES[family]:
                for _ in range(40):
                    other, ws = r.choice(kept), words(t)
                    ws = [w for w in ws if r.random() > 0.05]
                    rows.append((features(other[: r.randint(0, 6)] + ws + other[: r.randint(0, 6)]), k))
        # Long lines also as they are looked at round a licence word.
        cuts = [(w, r.randrange(len(w))) for w in kept if len(w) > 2 * AROUND + 1]
        plain = [(features(w), 0) for w in kept + [w[max(0, i - AROUND) : i + AROUND + 1] for w, i in cuts]]
        rows += plain[::2]
        self.w = np.zeros((1 << BITS, len(self.names)))
        g2 = np.full_like(self.w, 1e-3)
        for _ in range(EPOCHS):
            r.shuffle(rows)
            for f, k in rows:
                p = self._soft(f)
                p[k] -= 1
                d = p / len(f) ** 0.5
                g2[f] += d * d
                self.w[f] -= 0.3 * d / np.sqrt(g2[f])
        held_back = [1 - self._soft(f)[0] for f, _ in plain[1::2]]
        self.cut = max(0.5, float(np.quantile(held_back, PASSED))) if held_back else 0.5

    def _soft(self, f):
        import numpy as np

        s = self.w[f].sum(0) / max(1, len(f)) ** 0.5
        e = np.exp(s - s.max())
        return e / e.sum()

    def _judge(self, ws):
        """(family or unknown or None, probability of any licence) of some words taken as one."""
        p = self._soft(features(ws))
        best = self.names[1 + int(p[1:].argmax())]
        if max(likeness(t, ws) for t in TEMPLATES[best]) >= OVERLAP and p[1:].sum() >= self.cut:
            return best, float(1 - p[0])
        return ("unknown" if p[1:].sum() >= self.cut and HINT & set(ws) else None), float(1 - p[0])

    def families(self, paragraph):
        """{family or unknown: greatest probability of any licence} of a paragraph's stretches."""
        ws = words(paragraph)
        whole, hints = (0, len(ws)), [i for i, w in enumerate(ws) if w in HINT]
        near = stretches(ws)
        if not hints and not near:
            return {}
        out, covered, unsure = {}, [], 0.0
        for a, b in [whole, *(x for x in near if x != whole)]:
            name, p = self._judge(ws[a:b])
            if name == "unknown":
                unsure = max(unsure, p)
            elif name:
                out[name] = max(out.get(name, 0), p)
                covered.append((a, b))
        # A hint in or next to a confirmed notice belongs to it; where only the line as a whole is confirmed, all do.
        covered = [c for c in covered if c != whole] or covered
        end, k = -1 - AROUND, 0
        for i in hints:
            while k < len(covered) and covered[k][0] - AROUND <= i:
                end = max(end, covered[k][1])
                k += 1
            if i < end + AROUND:
                continue
            name, p = self._judge(ws[max(0, i - AROUND) : i + AROUND + 1])
            if name:
                out[name] = max(out.get(name, 0), p)
        if unsure and not out:
            out["unknown"] = unsure
        return out

    def family(self, paragraph):
        """(the likeliest family or unknown or None, probability of any licence)."""
        got = self.families(paragraph)
        return max(got.items(), key=lambda x: (x[0] != "unknown", x[1], x[0]), default=(None, 0.0))


def train(docs, bound=SAMPLE):
    s = sample(docs.where("length(text) > 0"), bound, "text")
    import zlib

    paragraphs = sorted((p for t in s.text for p in t.split("\n")), key=lambda p: (zlib.crc32(p.encode("utf-8", "replace")), p))
    return Model(paragraphs[: 20 * bound])


def scan(docs, model):
    """doc_id, families (distinct, sorted), n_paragraphs with a licence, of each whole text."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for d, t in zip(pdf.doc_id, pdf.text):
                hits = [f for f in map(model.families, (t or "").split("\n")) if f]
                rows.append((d, sorted(set().union(*hits)), len(hits)))
            yield pd.DataFrame(rows, columns=["doc_id", "families", "n_paragraphs"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, families array<string>, n_paragraphs int")
