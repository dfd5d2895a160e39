import random

from rayframe.llm.decontam import RATE, clean, leaks, least_distance, norm


def brute(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_distance():
    r = random.Random(1)
    for _ in range(200):
        p, t = ("".join(r.choices("abc", k=r.randint(1, n))) for n in (20, 60))
        assert least_distance(p, t)[0] == brute(p, t)


def test_same_as_brute_force(spark):
    r = random.Random(2)
    item = "".join(r.choices("abcdefgh ", k=60)).strip() + "xyz"
    texts = [None, "", "clean text of no item", f"q {item.upper()} z"]
    for n in range(1, 12):
        t = list(item)
        for _ in range(n):
            t[r.randrange(len(t))] = r.choice("mnop")
        texts.append("pre " + "".join(t) + " post" * 50)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    want = {(i, 7, brute(norm(item), norm(t))) for i, t in enumerate(texts) if t and brute(norm(item), norm(t)) <= int(len(norm(item)) * RATE)}
    assert {tuple(x)[:3] for x in leaks(docs, bench).collect()} == want
    assert clean(docs, bench).count() == len(texts) - len(want)
    assert leaks(docs, bench.where("false")).count() == 0 == leaks(docs.where("false"), bench).count()


def test_short_items_at_word_bounds_and_clean_by_text(spark):
    from rayframe.llm.decontam import clean

    items = spark.createDataFrame([(1, "Yes or no"), (2, "ab"), (3, ""), (4, None)], "item_id long, text string")
    rows = [(1, "well, yes  or no?"), (2, "byes or not"), (3, "cab ab"), (4, "cabs"), (None, "say ab"), (5, None), (5, "ab"), (5, "plain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id) for r in leaks(docs, items).collect()) == [(0, 2), (1, 1), (3, 2), (5, 2)]
    assert sorted(map(str, (tuple(r) for r in clean(docs, items).collect()))) == sorted(map(str, [(2, "byes or not"), (4, "cabs"), (5, None), (5, "plain")]))
    assert clean(docs.where("false"), items).count() == 0
