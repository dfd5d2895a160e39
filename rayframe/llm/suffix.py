"""Removal of long repeated byte strings by threshold-bounded interval expansion on a
Burrows-Wheeler transform.

1. Of each group of equal texts (by MD5) the row with the least doc_id is looked at; the
   others lose every byte if they have LENGTH bytes.
2. Every LENGTH-byte window is keyed by the least hash of its GRAM-byte parts, so equal
   windows of any documents share a key and runs of windows with one key are short
   strings. Keys that one text alone holds go; the others come back to their documents as
   lists, by joins that may split a hot key, so nothing is sent whole to any one place.
3. The runs under shared keys, each with the least and greatest doc_id that holds it, meet
   by key. Blocks of them are sorted into suffix rows; breadth-first backward extension
   over their transform splits the one interval of length 0 into those of length 1, 2,
   ... and stops at LENGTH. A window's interval gives the least doc_id that holds it.
   Every shared run goes that way. A key with more than HOT different runs would make one
   task's block large: its runs are cut into single windows, keyed by the whole window,
   and these meet instead.
4. The windows that a smaller doc_id holds come back to the documents.

Null texts are empty; texts under LENGTH bytes and rows with a null doc_id lose nothing.
Rows with one doc_id don't count as each other's repeats. Surrogates become '?'. Between
the steps tables are written to the shared folder, and removed when used.
"""
from pyspark.sql import functions as F

from rayframe.llm.common import Tables, ready

LENGTH, GRAM, CUT, BLOCK, HOT, PART, MANY, DEEP = 50, 20, 64, 1 << 16, 4096, 1 << 17, 8192, 16
BASE = 0x9E3779B97F4A7C15
RUN = "k long, doc_id long, th long, at long, n int, s binary"
_POWERS = []


def _powers():
    """BASE and its inverse to the powers 0 to PART + LENGTH, of this worker process."""
    import numpy as np

    if not _POWERS:
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            x = np.full(PART + LENGTH + 1, b, "u8")
            x[0] = 1
            _POWERS.append(np.multiply.accumulate(x))
    return _POWERS


def _least_hashes(data):
    """The least hash of each window's GRAM-byte parts."""
    import numpy as np

    up, down = _powers()
    sums = np.zeros(len(data) + 1, "u8")
    np.cumsum((np.frombuffer(data, "u1").astype("u8") + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    n, span, size = len(data) - LENGTH + 1, LENGTH - GRAM + 1, 1
    while size * 2 <= span:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[:n], h[span - size : span - size + n])


def keyed_runs(data):
    """(key, first window, windows) of the runs of windows that share a key."""
    import numpy as np

    n = len(data) - LENGTH + 1
    if n <= 0:
        e = np.empty(0, "i8")
        return e.astype("u8"), e, e
    h = [_least_hashes(data[i : i + PART + LENGTH - 1]) for i in range(0, n, PART)]
    h = np.concatenate(h) if len(h) > 1 else h[0]
    new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    sizes = np.diff(np.r_[new, n])
    if sizes.max() <= CUT:
        return h[new], new, sizes
    parts = -(-sizes // CUT)
    k = np.repeat(np.arange(len(new)), parts)
    nth = np.arange(len(k)) - np.repeat(np.cumsum(parts) - parts, parts)
    return h[new][k], new[k] + nth * CUT, np.minimum(CUT, sizes[k] - nth * CUT)


def suffix_rows(codes):
    """Rows of the suffixes in the order of their first LENGTH codes at least; codes are 1 to 511, 0 ends a string."""
    import numpy as np

    n, step = len(codes), 7
    padded = np.r_[codes.astype("i8"), np.zeros(64, "i8")]
    key = np.zeros(n, "i8")
    for i in range(step):
        key = key << 9 | padded[i : i + n]
    while True:
        order = np.argsort(key)
        key = key[order]
        ranks = np.zeros(n, "i8")
        np.cumsum(key[1:] != key[:-1], out=ranks[1:])
        if step >= LENGTH or ranks[-1] == n - 1:
            return order
        rank = np.zeros(n + step, "i8")
        rank[order] = ranks + 1
        key = rank[:n] << 32 | rank[step:]
        step *= 2


def _expanded(by_char, first):
    """Where the intervals of length LENGTH begin, by that many rounds of backward extension.

    An interval's name is the count of beginnings up to its rows. Rows lie in DEEP lines of
    a table, column by column, so that a count is few additions of whole lines.
    """
    import numpy as np

    n = len(by_char)
    wide = -(-n // DEEP)
    at = lambda r: r % DEEP * wide + r // DEEP
    rows = np.arange(DEEP * wide)
    place = at(rows)
    to, start = np.empty(DEEP * wide, "i8"), np.ones(DEEP * wide, bool)
    to[place[:n]], start[place[:n]] = place[by_char], first
    to[place[n:]] = place[n:]
    start, edge = start.reshape(DEEP, wide), np.zeros((DEEP, wide), bool)
    count, before = np.empty((DEEP, wide), "i4"), np.empty((DEEP, wide), "i4")
    for _ in range(LENGTH):
        count[0] = edge[0]
        for i in range(1, DEEP):
            np.add(count[i - 1], edge[i], out=count[i])
        count += np.r_[0, np.cumsum(count[-1, :-1], dtype="i4")].astype("i4")
        np.take(count.ravel(), to, out=before.ravel(), mode="clip")
        np.not_equal(before[1:], before[:-1], out=edge[1:])
        np.not_equal(before[0, 1:], before[-1, :-1], out=edge[0, 1:])
        np.logical_or(edge, start, out=edge)
    return edge.ravel()[place[:n]]


def least_holder(strings, docs):
    """The least doc of every window's interval, for all strings one after the other."""
    import numpy as np

    lens = np.fromiter(map(len, strings), "i8", len(strings))
    ends = np.cumsum(lens + 1) - 1
    text = np.zeros(int(ends[-1]) + 1, "i4")
    body = np.ones(len(text), bool)
    body[ends] = False
    text[body] = np.frombuffer(b"".join(strings), "u1").astype("i4") + 1
    sa = suffix_rows(text)
    bwt = text[sa - 1].astype("u2")
    by_char = np.argsort(bwt, kind="stable")  # row r of the sorted order is the extension of row by_char[r]
    first = np.r_[True, bwt[by_char][1:] != bwt[by_char][:-1]]
    # No interval reaches over the end of a string: each end is an interval of its own.
    first[: len(strings)] = True
    edge = _expanded(by_char, first)
    left = np.repeat(ends, lens + 1) - np.arange(len(text))
    owner = np.where(left >= LENGTH, np.repeat(docs, lens + 1), np.iinfo("i8").max)[sa]
    least = np.minimum.reduceat(owner, np.flatnonzero(edge))[np.cumsum(edge) - 1]
    at = np.empty_like(least)
    at[sa] = least
    return at[left >= LENGTH]


def _bytes(text):
    return (text or "").encode("utf-8", "replace")


def _of_arrays(arrays, offsets):
    """An Arrow list column of int64 values."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(arrays, pa.int64()))


def _keys(batches):
    """For each text the distinct keys, beside the other column."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        found = [np.unique(keyed_runs(_bytes(t))[0]).view("i8") for t in b.column(1).to_pylist()]
        offsets = np.r_[0, np.cumsum([len(x) for x in found])]
        yield pa.RecordBatch.from_arrays([b.column(0), _of_arrays(np.concatenate(found) if found else [], offsets)], ["id", "k"])


def _runs(batches):
    """The runs under the keys in ks."""
    import numpy as np
    import pyarrow as pa

    names = [x.split()[0] for x in RUN.split(", ")]

    def table(found, texts):
        k, at, n = (np.concatenate([f[i] for f in found]) for i in (2, 3, 4))
        each = [len(f[2]) for f in found]
        ids, ths = (np.repeat(np.array([f[i] for f in found], "i8"), each) for i in (0, 1))
        size, data = n + LENGTH - 1, np.frombuffer(b"".join(texts), "u1")
        first = np.repeat(np.cumsum([0] + [len(t) for t in texts[:-1]]), each) + at
        offsets = np.r_[0, np.cumsum(size)]
        flat = data[np.repeat(first - offsets[:-1], size) + np.arange(offsets[-1])]
        s = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype("i4")), pa.py_buffer(flat)])
        return pa.RecordBatch.from_arrays([pa.array(k.view("i8")), pa.array(ids), pa.array(ths), pa.array(at), pa.array(n.astype("i4")), s], names)

    for b in batches:
        found, texts, rows = [], [], 0
        for d, th, t, ks in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
            data = _bytes(t)
            k, at, n = keyed_runs(data)
            keep = np.isin(k.view("i8"), np.asarray(ks.values))
            k, at, n = k[keep], at[keep], n[keep]
            # A part of a text's runs at a time, so that a batch stays small beside very long texts.
            for i in range(0, len(k), MANY):
                found.append((d, th, k[i : i + MANY], at[i : i + MANY], n[i : i + MANY]))
                texts.append(data)
                rows += len(found[-1][2])
                if rows >= MANY:
                    yield table(found, texts)
                    found, texts, rows = [], [], 0
        if rows:
            yield table(found, texts)


def _solve(batches):
    """(k, h, parts) of the runs of rows (k, h, s, lo, hi) in order of k: parts (first window, windows, least holder) in which windows have one least holder.

    Runs that one doc_id holds and none of whose windows another one holds are left out.
    """
    import numpy as np
    import pyarrow as pa

    def done(k, h, strings, lo, hi):
        sizes = np.fromiter(map(len, strings), "i8", len(strings)) - LENGTH + 1
        least = least_holder(strings, np.array(lo, "i8"))
        starts = np.cumsum(sizes) - sizes
        run = np.repeat(np.arange(len(sizes)), sizes)
        new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (run[1:] != run[:-1])])
        at, n, of = new - starts[run[new]], np.diff(np.r_[new, len(least)]), run[new]
        # A part tells something if a holder of the run is greater than the part's least one.
        tells = least[new] < np.array(hi, "i8")[of]
        at, n, of, low = at[tells], n[tells], of[tells], least[new][tells]
        runs, counts = np.unique(of, return_counts=True)
        lists = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(low, pa.int64())], ["j", "n", "m"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), lists)
        return pa.RecordBatch.from_arrays([pa.array(np.array(k, "i8")[runs]), pa.array(np.array(h, "i8")[runs]), lists], ["k", "h", "parts"])

    rest, size = [[], [], [], [], []], 0
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(5))):
            # A block ends where the key changes; no key has more than HOT runs.
            if size > BLOCK and row[0] != rest[0][-1]:
                yield done(*rest)
                rest, size = [[], [], [], [], []], 0
            for x, v in zip(rest, row):
                x.append(v)
            size += len(row[2])
    if size:
        yield done(*rest)


def _windows(batches):
    """Each window of the runs of rows (k, h, s, lo, hi): (k: its hash, run_k, run_h, place, window, lo, hi)."""
    import pyarrow as pa
    import xxhash

    for b in batches:
        for k, h, s, lo, hi in zip(*(b.column(x).to_pylist() for x in range(5))):
            w = [s[a : a + LENGTH] for a in range(len(s) - LENGTH + 1)]
            own = [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in w]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([k] * len(w), pa.int64()), pa.array([h] * len(w), pa.int64()), pa.array(range(len(w)), pa.int32()), pa.array(w, pa.binary()), pa.array([lo] * len(w), pa.int64()), pa.array([hi] * len(w), pa.int64())], ["k", "run_k", "run_h", "j", "s", "lo", "hi"])


def repeats(docs):
    """(doc_id, th: xxhash64 of the text, whole: all bytes go, runs: lists of (first window, windows) that go)."""
    spark = docs.sparkSession
    ready(spark)
    tables = Tables(spark, "repeats")
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").where(f"doc_id is not null AND octet_length(text) >= {LENGTH}")
    # 1. Equal texts.
    named = tables.save(texts.select("doc_id", "th", F.md5("text").alias("name")), "named")
    same = named.groupBy("name").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copies = named.join(same.where("first < last"), "name").where("first < doc_id").select("doc_id", "th").distinct()
    copies = tables.save(copies, "copies")
    tables.drop("named")
    # 2. Keys of several texts, as lists of their documents. What is hashed for a join is the smaller side of each partition.
    pairs = lambda id_: texts.select(F.expr(id_).alias("id"), "text").mapInArrow(_keys, "id long, k array<long>").select("id", F.explode("k").alias("k"))
    shared = pairs("th").groupBy("k").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("k")
    shared = tables.save(shared, "shared")  # so that the pairs lie in one exchange at a time
    lists = pairs("doc_id").join(shared.hint("shuffle_hash"), "k").groupBy(F.col("id").alias("doc_id")).agg(F.collect_list("k").alias("ks"))
    gone = copies.groupBy("doc_id").agg(F.collect_set("th").alias("gone"))
    lists = tables.save(lists.join(gone, "doc_id", "left"), "lists")
    tables.drop("shared")
    # 3. Runs under those keys, each different one once.
    held = texts.join(lists.hint("shuffle_hash"), "doc_id").where("gone is null OR NOT array_contains(gone, th)")
    found = tables.save(held.select("doc_id", "th", "text", "ks").mapInArrow(_runs, RUN).withColumn("h", F.xxhash64("s")), "found")
    tables.drop("lists")
    different = found.groupBy("k", "h", "s").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    different = tables.save(different, "different")
    hot = different.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("k")
    order = lambda rows: rows.select("k", "h", "s", "lo", "hi").repartition("k").sortWithinPartitions("k")
    solved = "k long, h long, parts array<struct<j:int,n:int,m:long>>"
    if hot.isEmpty():
        least = order(different).mapInArrow(_solve, solved)
    else:
        hot = tables.save(hot, "hot")
        least = order(different.join(hot, "k", "left_anti")).mapInArrow(_solve, solved)
        single = different.join(hot, "k", "left_semi").select("k", "h", "s", "lo", "hi").mapInArrow(_windows, "k long, run_k long, run_h long, j int, s binary, lo long, hi long")
        single = tables.save(single, "windows")
        # A window's rows meet in partial sums; the different windows go through the transform too.
        met = single.groupBy("k", "s").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).withColumn("h", F.xxhash64("s"))
        met = order(met).mapInArrow(_solve, solved).select("k", "h", F.col("parts")[0].m.alias("m"))
        back = single.withColumn("h", F.xxhash64("s")).join(met, ["k", "h"])
        back = back.groupBy(F.col("run_k").alias("k"), F.col("run_h").alias("h")).agg(F.collect_list(F.struct("j", F.lit(1).alias("n"), "m")).alias("parts"))
        least = least.unionByName(back)
    least = tables.save(least, "least")
    tables.drop("different", "hot", "windows")
    # 4. Back to the documents.
    hit = found.select("doc_id", "th", "at", "k", "h").join(least.hint("shuffle_hash"), ["k", "h"])
    hit = hit.select("doc_id", "th", F.transform(F.filter("parts", lambda p: p.m < F.col("doc_id")), lambda p: F.struct((F.col("at") + p.j).alias("at"), p.n.alias("n"))).alias("run")).where(F.size("run") > 0)
    out = hit.groupBy("doc_id", "th").agg(F.collect_list("run").alias("runs"))
    out = out.select("doc_id", "th", F.lit(False).alias("whole"), "runs").union(copies.select("doc_id", "th", F.lit(True), F.expr("cast(null AS array<array<struct<at:bigint,n:int>>>)")))
    out = out.checkpoint()
    tables.drop()
    return out


def _marked(text, whole, spans):
    """The text's bytes, and which of them go; spans are the (first windows, windows) arrays, which share no window."""
    import numpy as np

    data = _bytes(text)
    if whole:
        return np.frombuffer(data, "u1"), np.ones(len(data), bool)
    step = np.zeros(len(data) + 1, "i4")
    if spans is not None:
        at, n = spans
        np.add.at(step, at, 1)
        np.add.at(step, at + n + LENGTH - 1, -1)
    return np.frombuffer(data, "u1"), np.cumsum(step)[:-1] > 0


def _rows(batch):
    """(text, whole, spans) of an Arrow batch with the columns text, whole and runs at its end."""
    import numpy as np

    texts, whole, runs = batch.columns[-3:]
    for t, w, r in zip(texts.to_pylist(), whole.to_pylist(), runs):
        flat = r.values.flatten() if r.is_valid else None
        yield t, w, None if flat is None else (np.asarray(flat.field(0)), np.asarray(flat.field(1)))


def _joined(docs):
    found = repeats(docs).select(F.col("doc_id").alias("__rep_id"), F.col("th").alias("__rep_th"), F.col("whole").alias("__rep_whole"), F.col("runs").alias("__rep_runs"))
    x = docs.join(found.hint("shuffle_hash"), (docs.doc_id == F.col("__rep_id")) & (F.xxhash64(docs.text) == F.col("__rep_th")), "left")
    return x.select(*docs.columns, F.col("text").alias("__rep_text"), "__rep_whole", "__rep_runs")


def digests(docs):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each whole text."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            rows = []
            for t, w, spans in _rows(b):
                data, cut = _marked(t, w, spans)
                spans = int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum())
                rows.append((len(data), int(cut.sum()), spans, hashlib.sha256(data[~cut].tobytes() if spans else data).hexdigest()))
            columns = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    x = _joined(docs.select("doc_id", "text")).drop("text")
    return x.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs):
    """docs with the repeated bytes cut from text (cut characters' other bytes go too); n_chars follows, null texts stay."""
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = []
            for t, w, spans in _rows(b):
                data, cut = _marked(t, w, spans)
                texts.append(None if t is None else data[~cut].tobytes().decode("utf-8", "ignore"))
            columns = list(b.columns[: len(names)])
            columns[names.index("text")] = pa.array(texts, pa.string())
            if "n_chars" in names:
                i = names.index("n_chars")
                columns[i] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    x = _joined(docs)
    return x.mapInArrow(run, docs.schema)
