import hashlib
import random

from rayframe.llm import suffix
from rayframe.llm.suffix import LENGTH, digests, without_repeats


def brute(rows):
    least = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - LENGTH + 1):
            w = b[i : i + LENGTH]
            least[w] = min(least.get(w, d), d)
    out = []
    for d, b in data:
        cut = [False] * len(b)
        for i in range(len(b) - LENGTH + 1):
            if least[b[i : i + LENGTH]] < d:
                cut[i : i + LENGTH] = [True] * LENGTH
        spans = sum(c and not (i and cut[i - 1]) for i, c in enumerate(cut))
        out.append((d, len(b), sum(cut), spans, hashlib.sha256(bytes(x for x, c in zip(b, cut) if not c)).hexdigest()))
    return sorted(out)


def test_same_as_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, digests(docs).collect())) == brute(docs.select("doc_id", "text").collect())


def test_edges(spark, odd):
    r = random.Random(3)
    p = "".join(r.choices("abcdé ", k=70))
    texts = [None, "", p[:49], p, p[:49], "x" + p[3:60], p + p, "é" * 200, "ab" * 300, "zé" * 30 + "é" * 80, "ba" * 90]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, runs int")
    assert sorted(map(tuple, digests(docs).collect())) == brute(rows)
    assert digests(docs.where("false")).count() == 0
    assert digests(odd).count() == odd.count() == without_repeats(odd).count()
    assert without_repeats(odd).columns == odd.columns


def test_hot_keys_and_equal_texts(spark, monkeypatch):
    """One passage in most documents between different words, its ends too, and groups of equal texts."""
    monkeypatch.setattr(suffix, "HOT", 6)
    monkeypatch.setattr(suffix, "PART", 200)
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    passage = " ".join(word() for _ in range(14))
    rows = []
    for d in range(60):
        own = " ".join(word() for _ in range(r.randrange(12)))
        rows.append((d, f"{own} {passage[r.randrange(30):]} {own[:r.randrange(9)]}" + " ".join(word() for _ in range(r.randrange(40)))))
    rows += [(100 + d, rows[d % 3][1]) for d in range(9)] + [(d, rows[7][1]) for d in (3, 3)] + [(None, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute([x for x in rows if x[0] is not None])
    assert sorted(map(tuple, digests(docs.where("doc_id is not null")).collect())) == want
    assert sorted(map(tuple, digests(docs).where("doc_id is not null").collect())) == want
    kept = {x.doc_id: x.text for x in without_repeats(docs).where("doc_id >= 100").collect()}
    assert all(len(t) == 0 for t in kept.values())


def test_exchanges_go_before_the_last_join(spark, monkeypatch):
    """Each large exchange is dropped by writing a table after it, but the last."""
    from rayframe.llm import common

    saved, save = [], common.Tables.save
    monkeypatch.setattr(common.Tables, "save", lambda self, df, name: (saved.append(name), save(self, df, name))[1])
    docs = spark.createDataFrame([(d, f"{'abcdefghij' * 7}{d * 999}") for d in range(6)], "doc_id long, text string")
    assert suffix.repeats(docs).count() == 5
    assert [n for n in saved if n in ("shared", "lists", "found", "different", "least")] == ["shared", "lists", "found", "different", "least"]
