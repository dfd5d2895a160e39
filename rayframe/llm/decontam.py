"""Benchmark decontamination: pigeonhole edit matching.

Texts and items are lower-cased and trimmed, with every run of white space as one space.
An item of m code points may differ by e = floor(m * RATE) edits. It is split
into e + 1 pieces; a passage within e edits holds one of them unchanged, so an
Aho-Corasick automaton over all pieces finds every candidate place. Before the whole
window is judged, the hit climbs a binary tree over the pieces: if q pieces hold at most
q - 1 edits, so does one half for its own count, so a true passage has a piece whose
ancestors of q pieces all lie within q - 1 edits of the text there; other hits end early.
The first step is split by pigeonholes again: a part of what stands beside the piece must
be in the text near it unchanged.
Myers' bit-parallel distance judges each step and the whole window. Items go to executors in blocks of
BLOCK_CHARS at most, each a pass over all rows, so what is sent has a fixed bound.
Null or empty texts and items match nothing; items of equal text all match. Items under
SHORT code points match only as they are and between word bounds.
"""
from rayframe.llm.common import small_batches

RATE, BLOCK_CHARS, SHORT = 0.1, 4_000_000, 40


def norm(text):
    return " ".join((text or "").lower().split())


def least_distance(pattern, text):
    """(least edits of pattern against any part of text, its end) by Myers' bit vectors."""
    m, full = len(pattern), (1 << len(pattern)) - 1
    peq = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score, best, top = full, 0, m, (m, 0), 1 << (m - 1)
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += bool(ph & top) - bool(mh & top)
        if score < best[0]:
            best = (score, j + 1)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
    return best


def budget(item):
    """Edits that an item may have."""
    return int(len(item) * RATE) if len(item) >= SHORT else 0


def bounded(text, start, end):
    """Whether text[start:end] begins and ends at word bounds."""
    apart = lambda i: i <= 0 or i >= len(text) or not (text[i - 1].isalnum() and text[i].isalnum())
    return apart(start) and apart(end)


def ancestors(n, p):
    """Spans (lo, hi) of pieces above leaf p of a binary tree over n leaves, smallest first, without the root."""
    lo, hi, out = 0, n, []
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if p < mid else (mid, hi)
        out.append((lo, hi))
    return out[-2::-1]


def beside(text, a, b, lo, hi, most):
    """Parts of text[lo:a] + text[b:hi], at least one of which stays whole under `most` edits, if they can be told."""
    sides = [(x, y) for x, y in ((lo, a), (b, hi)) if x < y]
    if len(sides) != 1 or sides[0][1] - sides[0][0] <= most:
        return [""]
    x, n = sides[0][0], sides[0][1] - sides[0][0]
    return [text[x + n * i // (most + 1) : x + n * (i + 1) // (most + 1)] for i in range(most + 1)]


class Matcher:
    """items: (item_id, normalised text) pairs."""

    def __init__(self, items):
        import ahocorasick

        self.items, pieces = items, {}
        for k, (_, text) in enumerate(items):
            m = len(text)
            e = budget(text)
            cuts = [m * i // (e + 1) for i in range(e + 2)]
            for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                climb = [(cuts[lo], cuts[hi], hi - lo - 1) for lo, hi in ancestors(e + 1, p)]
                parts = beside(text, a, b, *climb[0]) if climb else [""]
                pieces.setdefault(text[a:b], []).append((k, a, climb, parts))
        self.automaton = ahocorasick.Automaton()
        for p, places in pieces.items():
            self.automaton.add_word(p, (len(p), places))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text):
        """item_id -> (edits, end in the normalised text), the best place of each."""
        text, found, spans = norm(text), {}, {}
        if not self.items or not text:
            return found
        for end, (size, places) in self.automaton.iter(text):
            for k, a, climb, parts in places:
                s, item = end + 1 - size - a, self.items[k][1]
                e = budget(item)
                if len(item) < SHORT:
                    # The piece is the whole item.
                    if self.items[k][0] not in found and bounded(text, s, end + 1):
                        found[self.items[k][0]] = (0, end + 1)
                    continue
                if k in spans and abs(s - spans[k][-1]) <= e:
                    spans[k].append(s)  # joins a place that will be judged anyhow
                    continue
                if climb:
                    lo, hi, most = climb[0]
                    near = text[max(0, s + lo - most) : s + hi + most]
                    if not any(x in near for x in parts):
                        continue
                for lo, hi, most in climb:
                    if least_distance(item[lo:hi], text[max(0, s + lo - most) : s + hi + most])[0] > most:
                        break
                else:
                    spans.setdefault(k, []).append(s)
        for k, starts in spans.items():
            item_id, item = self.items[k]
            e = budget(item)
            lo = hi = None
            for s in [*sorted(starts), None]:
                if s is not None and hi is not None and s - e <= hi:
                    hi = s + len(item) + e
                    continue
                if hi is not None:
                    d, end = least_distance(item, text[max(0, lo) : hi])
                    if d <= e and (item_id not in found or d < found[item_id][0]):
                        found[item_id] = (d, max(0, lo) + end)
                if s is not None:
                    lo, hi = s - e, s + len(item) + e
        return found


def _blocks(benchmark):
    block, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        t = norm(r.text).strip()
        if not t:
            continue
        if block and size + len(t) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r.item_id, t))
        size += len(t)
    if block:
        yield block


def leaks(docs, benchmark):
    """doc_id, item_id, edits, end of every item found in every whole text."""
    spark, out = docs.sparkSession, None
    small_batches(spark)
    schema = "doc_id long, item_id long, edits int, end long"
    for block in _blocks(benchmark):

        def run(batches, sent=spark.sparkContext.broadcast(block)):
            import pandas as pd

            m = Matcher(sent.value)
            for pdf in batches:
                rows = [(d, i, *x) for d, t in zip(pdf.doc_id, pdf.text) for i, x in m.find(t).items()]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "edits", "end"])

        part = docs.select("doc_id", "text").mapInPandas(run, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs, benchmark):
    """Rows of docs whose text holds no item; the text decides, so rows with a null or repeated doc_id are judged like others."""
    spark, names = docs.sparkSession, docs.columns
    small_batches(spark)
    for block in _blocks(benchmark):

        def run(batches, sent=spark.sparkContext.broadcast(block)):
            import pyarrow as pa

            m, at = Matcher(sent.value), names.index("text")
            for b in batches:
                keep = [not m.find(t) for t in b.column(at).to_pylist()]
                yield b.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
