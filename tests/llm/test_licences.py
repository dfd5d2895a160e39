import re

from rayframe.llm import licences


def test_families(odd, tables):
    docs = tables("documents")
    model = licences.train(docs)
    assert model.family("Foo bar.\nReleased under the MIT License."[9:])[0] == "mit"
    assert model.family("Licensed under the Apache License, Version 2.0")[0] == "apache"
    got = {r.doc_id: r for r in licences.scan(docs, model).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    assert {d for d, r in got.items() if r.n_paragraphs} == {d for d, t in text.items() if re.search("(?i)licensed under|released under|rights reserved", t)}
    assert licences.scan(odd, model).count() == odd.count()
    assert licences.scan(odd, licences.train(odd.where("false"))).count() == odd.count()


def test_notice_inside_long_lines(tables):
    docs = tables("documents")
    model = licences.train(docs)
    pool = [w for r in docs.limit(200).collect() for w in licences.words(r.text or "") if w.isalpha() and not licences.HINT & {w} and w not in {w for p in licences.PAIRS for w in p}]
    for k, (family, notices) in enumerate(licences.TEMPLATES.items()):
        for n in (12, 50, 1000):
            c = pool[k * 1000 : k * 1000 + n]
            line = " ".join([*c[: n // 3], notices[0], *c[n // 3 :]])
            assert set(model.families(line)) == {family}, (family, n)
            assert not model.families(" ".join(c))
    both = " ".join([*pool[:40], "Released under the MIT License.", *pool[40:90], "Licensed under the Apache License, Version 2.0", *pool[90:140]])
    assert set(model.families(both)) == {"apache", "mit"}
