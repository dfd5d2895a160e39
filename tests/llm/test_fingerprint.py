import hashlib

from rayframe.llm.fingerprint import fingerprints


def test_contract(tables):
    docs = sorted(map(tuple, tables("documents").select("doc_id", "text").collect()))
    got = {r.doc_id: r for r in fingerprints(tables("documents")).collect()}
    assert len(got) == len(docs)
    by_text = {}
    for (d, t), (n, after) in zip(docs, docs[1:] + docs[:1]):
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        same = lambda a, b: sum(a[i : i + 8] == b[i : i + 8] for i in range(0, len(a), 8)) / (len(a) // 8)
        assert (r.near_edited, r.near_next) == (same(r.fingerprint, r.edited_fingerprint), same(r.fingerprint, got[n].fingerprint))


def test_edges(spark, odd):
    assert fingerprints(odd).count() == odd.count()
    assert fingerprints(odd.where("false")).count() == 0
    assert fingerprints(odd.where("doc_id = 5")).first().near_next == 1
