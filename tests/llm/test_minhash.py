import random
import re

from rayframe.llm import minhash
from rayframe.llm.minhash import near_duplicates, one_of_each

COLUMNS = ["doc_id", "n_shingles", "component_id", "kept"]


def brute(rows):
    """Rows are documents, also with one id; null ids come last."""
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    of = list(range(len(rows)))

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, s in enumerate(sets):
        for b, t in enumerate(sets[:a]):
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                of[root(a)] = root(b)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in ids.items()}
    out = [(d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows)]
    return sorted(out, key=str)


def found(docs):
    return sorted(map(tuple, near_duplicates(docs).select(*COLUMNS).collect()), key=str)


def test_same_as_brute_force_on_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(docs) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_edges(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(0, None), (1, ""), (2, " \t"), (3, "a b"), (4, "A  b"), (5, " ".join(base))]
    rows += [(10 + i, " ".join([*base[: 39 - i % 4], f"z{i}"])) for i in range(90)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, comp int")
    assert found(docs) == brute(rows)
    assert near_duplicates(docs.where("false")).count() == 0


def test_repeated_and_null_ids(spark, odd):
    a, b = ([f"{x}{i}" for i in range(1, 41)] for x in "ab")
    rows = [(1, a), (2, b), (5, [*a, "z1"]), (5, [*b, "z2"]), (7, [*b, "z2", "z3"]), (7, ["another", "text"]), (None, [*a, "z9"]), (None, ["alone", "here"]), (9, ["alone", "here"])]
    rows = [(d, " ".join(w)) for d, w in rows]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string")
    assert found(docs) == brute(rows + rows[:2])
    left = sorted((r.doc_id, r.text) for r in one_of_each(docs).collect())
    assert left == sorted([rows[0], rows[1], rows[5], rows[8]])
    assert near_duplicates(odd).count() == odd.count() and one_of_each(odd).columns == odd.columns


def test_near_copies_in_several_blocks(spark, monkeypatch):
    """A group whose members hang together only through each other, in blocks of few members."""
    monkeypatch.setattr(minhash, "CHUNK", 7)
    r = random.Random(4)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for d in range(60):
        w = list(base)
        for _ in range(r.choice((2, 3, 4, 5))):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
