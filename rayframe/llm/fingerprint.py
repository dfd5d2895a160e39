"""Document fingerprints: Lempel-Ziv (78) phrase sets under minimum-hash signatures.

A text is parsed into phrases (longest known phrase plus one code point); the set of
phrase hashes gives SIZE minima, and likeness is the share of equal minima. The edited
text shares the parse of its first three quarters, so a row costs one and a quarter
parses. Texts come in doc_id order by one range exchange on the id alone; each task
emits its first and last row besides, and only those few are paired across tasks. Null
counts as empty; two empty texts are alike (1), an empty and a non-empty text are not
(0). Rows with one doc_id follow in order of their text. A single row is its own next
document.
"""
from pyspark.sql import functions as F

from rayframe.llm.common import ready

SIZE, PART = 64, 512
COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
BASE = 0x9E3779B97F4A7C15


def parse(text, seen, cur="", at=0):
    """Adds the phrases of text to seen. The ends of the new phrases, and the unfinished one."""
    add, ends, i = seen.add, [], at
    for c in text:
        i += 1
        cur += c
        if cur not in seen:
            add(cur)
            ends.append(i)
            cur = ""
    return ends, cur


def _powers(n, base):
    import numpy as np

    out = np.full(n, base, "u8")
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Minimum-hash signatures of phrases given by where they end in a text."""

    def __init__(self):
        import numpy as np

        r = np.random.default_rng(11)
        self.xor = r.integers(0, 2**64, (SIZE, 1), dtype="u8")
        self.by = r.integers(0, 2**64, (SIZE, 1), dtype="u8") | np.uint64(1)
        self.size = 0

    def _grow(self, n):
        if n > self.size:
            self.size = 2 * n
            self.up, self.down = _powers(self.size, BASE), _powers(self.size, pow(BASE, -1, 1 << 64))

    def of(self, text, starts, ends):
        """64-bit hashes of text[start:end] for each phrase."""
        import numpy as np

        self._grow(len(text) + 1)
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "u4").astype("u8") + np.uint64(1)
        sums = np.zeros(len(c) + 1, "u8")
        np.cumsum(c * self.up[: len(c)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))

    def minima(self, h):
        """SIZE minima: each from hashes mixed by an own xor and multiplier."""
        import numpy as np

        out = np.full(SIZE, 0xFFFFFFFF, "u4")
        for i in range(0, len(h), PART):
            m = (h[None, i : i + PART] ^ self.xor) * self.by
            m ^= m >> np.uint64(31)
            m *= np.uint64(0x94D049BB133111EB)
            out = np.minimum(out, (m >> np.uint64(32)).min(1).astype("u4"))
        return out


def _spans(ends, cur, n):
    """Starts and ends of consecutive phrases, the unfinished one with them."""
    import numpy as np

    ends = np.array(ends + [n] if cur else ends, "i8")
    return np.r_[0, ends[:-1]].astype("i8"), ends


def both_signatures(text, after, hashes):
    """(n_chars, signature, edited text, its signature) with `after` as the next document."""
    import numpy as np

    n = len(text)
    keep = n - n // 4
    edited, seen = text[:keep] + after[: n // 4], set()
    first, cur = parse(text[:keep], seen)
    known = set()
    out = []
    for whole in (text, edited):
        rest, left = _rest(whole[keep:], seen, known, cur, keep)
        starts, ends = _spans(first + rest, left, len(whole))
        out.append((whole, starts, ends))
    (_, s, e), (_, s2, e2) = out
    k = len(first)
    base = hashes.minima(hashes.of(text[:keep], s[:k], e[:k])) if k else np.full(SIZE, 0xFFFFFFFF, "u4")
    sig, sig2 = (np.minimum(base, hashes.minima(hashes.of(t, a[k:], b[k:]))) if len(b) > k else base for t, a, b in out)
    return n, sig, edited, sig2


def _rest(text, seen, own, cur, at):
    """Ends of the phrases of the rest of a text; seen is left as it was."""
    own.clear()
    ends, i = [], at
    for c in text:
        i += 1
        cur += c
        if cur not in seen and cur not in own:
            own.add(cur)
            ends.append(i)
            cur = ""
    return ends, cur


def _likeness(a, b):
    import numpy as np

    return float(np.mean(a == b))


def _hexed(s):
    return s.astype(">u4").tobytes().hex()


def signature(text, hashes):
    return hashes.minima(hashes.of(text, *_spans(*parse(text, set()), len(text)))) if text else hashes.minima([])


def _own(doc, text, after, hashes):
    """All of a row but near_next, and its signature."""
    import hashlib

    n, sig, edited, sig2 = both_signatures(text, after, hashes)
    return [doc, n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), _hexed(sig), _hexed(sig2), _likeness(sig, sig2)], sig


def fingerprints(docs):
    """One row per document, see COLUMNS."""
    ready(docs.sparkSession)

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        hashes, task, names = Hashes(), TaskContext.get().partitionId(), [*NAMES, "task", "edge", "text"]
        blank, none = (None,) * 6, (None, None, None)
        waiting, before = None, None  # the row whose own signature waits for its next text; the one that waits for near_next
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf.doc_id, pdf.text):
                text = text or ""
                if waiting is None:
                    rows.append((doc, *blank, task, 0, text))
                else:
                    row, sig = _own(*waiting, text, hashes)
                    if before:
                        rows.append((*before[0], _likeness(before[1], sig), *none))
                    before = row, sig
                waiting = doc, text
            yield pd.DataFrame(rows, columns=names)
        if waiting is not None:
            rows = [(waiting[0], *blank, task, 1, waiting[1])]
            if before:
                rows.append((*before[0], _likeness(before[1], signature(waiting[1], hashes)), *none))
            yield pd.DataFrame(rows, columns=names)

    def finish(batches):
        import pandas as pd

        hashes = Hashes()
        for pdf in batches:
            rows = []
            for d, t, n in zip(pdf.doc_id, pdf.text, pdf["next"]):
                row, sig = _own(d, t, n, hashes)
                rows.append((*row, _likeness(sig, signature(n, hashes))))
            yield pd.DataFrame(rows, columns=NAMES)

    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    out = rows.mapInPandas(run, COLUMNS + ", task int, edge int, text string").checkpoint()
    edges = out.where("edge is not null").select("doc_id", "task", "edge", "text")
    tasks = sorted(r.task for r in edges.where("edge = 0").select("task").collect())
    if not tasks:
        return out.drop("task", "edge", "text")
    order = docs.sparkSession.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1])), "task int, then int")
    head = edges.where("edge = 0").select(F.col("task").alias("then"), F.col("text").alias("next"))
    tail = edges.where("edge = 1").join(order, "task").join(head, "then").select("doc_id", "text", "next")
    return out.where("edge is null").drop("task", "edge", "text").union(tail.mapInPandas(finish, COLUMNS))
