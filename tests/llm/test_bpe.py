import hashlib
import random

import public_tokenizers as P
import regex
import tiktoken

from rayframe.llm import bpe
from rayframe.llm.bpe import StreamDecoder, Transducer, digests, load_ranks


def test_same_as_library_and_round_trip():
    ranks = load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    fst, pat = Transducer(ranks), regex.compile(P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ["", "a", "It's  a test\n\n 123 ßölich ciónmente", "日本語 🙂🙂", "x" * 300, "thonherestionwhich éauxé " * 20]:
        ids = list(fst.encode(text, pat))
        assert ids == lib.encode_ordinary(text)
        d = StreamDecoder({v: k for k, v in ranks.items()})
        assert (b"".join(d.feed([i]) for i in ids) + d.end()).decode() == text and not d.bad


def test_pairs_fit_as_merging_says():
    ranks = load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    fst, r, tokens = Transducer(ranks), random.Random(2), list(ranks)
    assert all(fst._tree(i) for i in ranks.values())
    for _ in range(4000):
        a, b = r.choice(tokens)[-3:], r.choice(tokens)[:3]
        if a in ranks and b in ranks:
            assert fst.fits(ranks[a], ranks[b]) == (fst.merge(a + b) == [a, b])


def test_same_with_tables_that_fill_up(monkeypatch, tables):
    monkeypatch.setattr(bpe, "KEPT", 40)
    monkeypatch.setattr(bpe, "PIECES", 30)
    ranks = load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    fst, pat = Transducer(ranks), regex.compile(P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in tables("documents").limit(60).collect():
        assert list(fst.encode(r.text or "", pat)) == lib.encode_ordinary(r.text or "")


def test_decoder_waits_for_whole_characters_and_tells_bad_ones():
    by_id = {i: bytes([i]) for i in range(256)}
    d = StreamDecoder(by_id)
    assert [d.feed([b]) for b in "aé€🙂".encode()] == [b"a", b"", "é".encode(), b"", b"", "€".encode(), b"", b"", b"", "🙂".encode()]
    for bad in (b"\x80\x80", b"\xc0\xaf", b"\xe2\x82a", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xe2\x82"):
        d = StreamDecoder(by_id)
        assert d.feed(list(bad)) + d.end() == bad and d.bad, bad


def test_digests_of_odd_rows(spark, odd):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = digests(odd.withColumn("n_tokens", odd.y), path, P.PATTERN).collect()
    text = {r.doc_id: r.text or "" for r in odd.collect()}
    assert len(rows) == odd.count() and all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in rows)
    assert digests(odd.where("false"), path, P.PATTERN).count() == 0
