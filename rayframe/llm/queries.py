"""One thin query per operator, over whole tables."""


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_html(spark, sf_dir):
    from rayframe.llm.html import extract

    return extract(_table(spark, sf_dir, "pages"))


def op9_bpe(spark, sf_dir):
    import public_tokenizers as P

    from rayframe.llm.bpe import digests

    return digests(_table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def op10_minhash(spark, sf_dir):
    from rayframe.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_langid(spark, sf_dir):
    from rayframe.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op5_quality(spark, sf_dir):
    from rayframe.llm import quality

    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op7_toxicity(spark, sf_dir):
    from rayframe.llm import toxicity

    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op1_decontam(spark, sf_dir):
    from rayframe.llm.decontam import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_fingerprint(spark, sf_dir):
    from rayframe.llm.fingerprint import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op3_suffix(spark, sf_dir):
    from rayframe.llm.suffix import digests

    return digests(_table(spark, sf_dir, "documents"))


def op8_licences(spark, sf_dir):
    from rayframe.llm import licences

    docs = _table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.train(docs))


QUERIES = {"op8_licences": op8_licences, "op3_suffix": op3_suffix, "op1_decontam": op1_decontam, "op6_fingerprint": op6_fingerprint, "op7_toxicity": op7_toxicity, "op2_langid": op2_langid, "op5_quality": op5_quality, "op4_html": op4_html, "op9_bpe": op9_bpe, "op10_minhash": op10_minhash}
SQL = {}
