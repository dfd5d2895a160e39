"""Near-duplicate components by bottom-k sketches from one hash function.

A document's set: 64-bit hashes of its distinct five-word shingles (A-Z lower-cased,
words `[^\\x20\\x09-\\x0D]+`); fewer words give one shingle; null, empty or blank texts
give the empty set and link with nothing. Equal sets form one class, named by a 64-bit
hash of the set, before any pair is made: with n classes, two are taken for one with a
chance of n * n / 2**65, and single shingles likewise.

First the KEYS least values of each class make inverted lists; each class is compared with
the least member of its lists, and links make components. Then come prefix lists: the
union sketch of a pair that may reach the threshold holds at least `must_share` values of
both, so with the retained values in order of rarity two such classes share one of their
first `size - must_share + 1`. Common values stand last and make no list for classes that
have enough others. Lists whose members are in different components are worked through in
blocks of CHUNK members against CHUNK: pairs of different components are judged by union
sketch, which drops those more than DEVIATIONS deviations under the threshold, at the
first value they share; the members that are left bring their texts, and full sets
confirm links until the block's members hang together as far as they do. No pair becomes
a row before it is confirmed, and a block gives fewer links than members.

Rows are documents: rows with one doc_id count each for itself, and component_id is the
least doc_id of a component (null ids come last). An empty table gives no rows.
"""
import re

from pyspark.sql import functions as F

from rayframe.llm.common import Tables, groups, ready

SKETCH, KEYS, WORDS, CHUNK, DEVIATIONS = 64, 16, 5, 1024, 5
SLACK = DEVIATIONS * (0.75 * 0.25 / SKETCH) ** 0.5
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
FLIP = "v ^ (-9223372036854775807L - 1)"  # unsigned order of the hashes as signed longs


def shingles(text):
    """Sorted distinct 64-bit hashes of the text's set."""
    import numpy as np
    import xxhash

    words = WORD.findall((text or "").encode("utf-8", "replace").translate(LOWER))
    if not words:
        return np.empty(0, "u8")
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], "u8")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
    n, out = len(words) - WORDS + 1, None
    for i in range(WORDS):
        part = h[i : i + n]
        out = part.copy() if out is None else (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + part
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(out ^ (out >> np.uint64(31)))


def must_share(n):
    """SQL for the least number of retained values that a set of n shares with the sketch of any set it may link with."""
    return f"CASE WHEN {n} >= {SKETCH} THEN {-(-int((0.75 - SLACK) * SKETCH * 1e6) // 1000000)} ELSE greatest(1, cast(ceil(0.75D * {n}) AS int) - greatest(0, cast(floor({n} / 0.75D) AS int) - {SKETCH})) END"


def linked(s, t):
    """Whether the full sets reach the threshold; both are sorted."""
    import numpy as np

    if 100 * min(len(s), len(t)) < 75 * max(len(s), len(t)):
        return False
    both = int((s[np.minimum(np.searchsorted(s, t), len(s) - 1)] == t).sum()) if len(s) and len(t) else 0
    return both > 0 and 100 * both >= 75 * (len(s) + len(t) - both)


def maybe(a, b):
    """Whether the union sketch of two sketches (sorted) doesn't rule out the threshold."""
    import numpy as np

    union = np.union1d(a, b)[:SKETCH]
    both = np.intersect1d(a, b, assume_unique=True)
    return int((both <= union[-1]).sum()) >= (0.75 - SLACK) * len(union)


def sketches(docs):
    """doc_id, th (hash of the text), n_shingles, class (null for the empty set), sketch: its least values."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for b in batches:
            sets = [shingles(t) for t in b.column(2).to_pylist()]
            own = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
            least = [s[:SKETCH].view("i8") for s in sets]
            offsets = np.r_[0, np.cumsum([len(x) for x in least])]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(least) if least else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(own, pa.int64()), lists], ["doc_id", "th", "n_shingles", "class", "sketch"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, n_shingles long, class long, sketch array<long>")


def _close_enough(pairs, classes):
    """Pairs (a, b) whose union sketch does not rule out the threshold."""
    one = lambda c: classes.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    x = pairs.join(one("a"), "a").join(one("b"), "b")
    x = x.withColumn("u", F.expr(f"slice(array_sort(transform(array_union(s_a, s_b), v -> {FLIP})), 1, {SKETCH})"))
    x = x.withColumn("both", F.expr(f"size(array_intersect(u, transform(array_intersect(s_a, s_b), v -> {FLIP})))"))
    return x.where((100 * F.least("n_a", "n_b") >= 75 * F.greatest("n_a", "n_b")) & (F.col("both") >= (0.75 - SLACK) * F.size("u"))).select("a", "b")


def _texts(ids, docs, owners):
    """(class, text) of the named classes: one row of each class brings its text."""
    rows = owners.join(ids.distinct(), "class").select("class", F.col("doc_id").alias("__near_id"), F.col("th").alias("__near_th"))
    return docs.join(rows, F.col("doc_id").eqNullSafe(F.col("__near_id")) & (F.xxhash64("text") == F.col("__near_th"))).groupBy("class").agg(F.min("text").alias("text"))


def _confirm(pairs, texts):
    """Pairs whose full sets reach the threshold; the rows of one `a` stand together, so its set is made once."""

    def run(batches):
        import pyarrow as pa

        last, own = None, None
        for batch in batches:
            keep = []
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if a != last:
                    last, own = a, shingles(x)
                keep.append(linked(own, shingles(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = lambda c: texts.select(F.col("class").alias(c), F.col("text").alias(f"t{c}"))
    x = pairs.join(one("b"), "b").join(one("a"), "a")
    return x.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


class Components:
    """Members of a block that hang together."""

    def __init__(self, of):
        self.of = {x: x for x in of}

    def find(self, x):
        while self.of[x] != x:
            self.of[x] = x = self.of[self.of[x]]
        return x

    def join(self, a, b):
        self.of[self.find(a)] = self.find(b)


def _pairs(rows, sets):
    """Pairs (i, j) of a block's rows of different components that the union sketch lets pass and that share no earlier value."""
    import numpy as np

    at = {}
    for i, s in enumerate(sets):
        for v in s.tolist():
            at.setdefault(v, []).append(i)
    at = {v: np.array(x) for v, x in at.items() if len(x) > 1}
    n = np.array([r["n"] for r in rows])
    comps = np.unique([r["comp"] for r in rows], return_inverse=True)[1]
    part = np.array([r["side"] for r in rows])
    whole = rows[0]["i"] == rows[0]["j"]
    before = [set(r["before"]) for r in rows]
    for i in range(len(rows)):
        near = [at[v] for v in sets[i].tolist() if v in at]
        if not near:
            continue
        count = np.bincount(np.concatenate(near), minlength=len(rows))
        ok = (count >= (0.75 - SLACK) * min(SKETCH, n[i])) & (comps != comps[i]) & (100 * np.minimum(n, n[i]) >= 75 * np.maximum(n, n[i]))
        ok &= np.arange(len(rows)) > i if whole else part != part[i]
        for j in np.flatnonzero(ok).tolist():
            if (whole or part[i] < part[j]) and before[i].isdisjoint(before[j]) and maybe(sets[i], sets[j]):
                yield i, j


def _blocks(lists):
    """Rows of lists (v, n of the list, class, comp, ...), each dealt to the blocks (i, j) of its list."""
    x = lists.withColumn("nb", F.ceil(F.col("members") / CHUNK).cast("int")).withColumn("side", F.pmod(F.xxhash64("class"), F.col("nb")).cast("int"))
    x = x.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return x.withColumn("i", F.least("side", "o").cast("int")).withColumn("j", F.greatest("side", "o").cast("int")).drop("o", "nb", "members")


def _left_over(lists):
    """(v, i, j, side, class, comp, n, before) of the block members that some pair needs."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["v", "i", "j", "side", "class", "comp", "n", "before"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        for _, rows in groups(batches, ("v", "i", "j")):
            sets = [np.sort(np.array(r["sketch"], "i8").view("u8")) for r in rows]
            need = set()
            for i, j in _pairs(rows, sets):
                need |= {i, j}
            own = [rows[i] for i in sorted(need)]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in own], k) for c, k in zip(names, kinds)], names)

    x = _blocks(lists).repartition("v", "i", "j").sortWithinPartitions("v", "i", "j")
    return x.mapInArrow(run, "v long, i int, j int, side int, class long, comp long, n long, before array<long>")


def _block_links(members, texts):
    """Confirmed links (a, b) of the blocks, fewer than their members."""

    def run(batches):
        import pyarrow as pa

        for _, rows in groups(batches, ("v", "i", "j")):
            full = [shingles(r["text"]) for r in rows]
            comps, links = Components(r["comp"] for r in rows), []
            for i, j in _pairs(rows, [s[:SKETCH] for s in full]):
                x, y = rows[i]["comp"], rows[j]["comp"]
                if comps.find(x) != comps.find(y) and linked(full[i], full[j]):
                    comps.join(x, y)
                    links.append((rows[i]["class"], rows[j]["class"]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    x = members.join(texts, "class").repartition("v", "i", "j").sortWithinPartitions("v", "i", "j")
    return x.mapInArrow(run, "a long, b long")


def _rare_lists(classes, label):
    """Lists of the rarest values that members of different components share: (v, members, class, comp, n, sketch, before)."""
    own = classes.select("class", F.explode("sketch").alias("v"))
    common = own.groupBy("v").agg(F.count("*").alias("n")).where("n > 1")
    first = own.join(common, "v").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("n", "v"))).alias("p"))
    x = classes.join(first, "class").join(label, "class", "left")
    x = x.withColumn("p", F.expr(f"slice(transform(p, e -> e.v), 1, greatest(0, size(p) - ({must_share('n')}) + 1))"))
    return x.select("class", F.coalesce("comp", "class").alias("comp"), "n", "sketch", "p").where("size(p) > 0")


def components(links, tables, tag):
    """(class, comp) for every end of a link: least class reachable, by label passing with pointer jumps."""
    both = tables.save(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{tag}-both")
    label = tables.save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("class"), F.least("a", "m").alias("comp")), f"{tag}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(label.select(F.col("class").alias("b"), "comp"), "b").groupBy(F.col("a").alias("class")).agg(F.min("comp").alias("m"))
        x = label.join(near, "class").select("class", F.least("comp", "m").alias("new"), F.col("comp").alias("old"))
        up = x.select(F.col("class").alias("new"), F.col("new").alias("up"))
        x = tables.save(x.join(up, "new", "left").select("class", F.coalesce("up", "new").alias("comp"), "old"), f"{tag}-{turn}")
        tables.drop(f"{tag}-{turn - 1}")
        label = x.select("class", "comp")
        if x.where("comp < old").isEmpty():
            tables.drop(f"{tag}-both")
            return label


def near_duplicates(docs):
    """doc_id, n_shingles, component_id, kept, th (xxhash64 of the text), component (its least class, null without a set) for every row of docs."""
    spark = docs.sparkSession
    ready(spark)
    tables, docs = Tables(spark, "near"), docs.select("doc_id", "text")
    all_rows = tables.save(sketches(docs), "rows")
    known = all_rows.where("class IS NOT NULL")
    classes = tables.save(known.groupBy("class").agg(F.min("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("lo")), "classes")
    owners = known.groupBy("class").agg(F.min(F.struct("doc_id", "th")).alias("o")).select("class", "o.doc_id", "o.th")
    held = classes.select("class", F.explode(F.slice("sketch", 1, KEYS)).alias("v"))
    lists = held.groupBy("v").agg(F.min("class").alias("lead"), F.max("class").alias("last")).where("lead < last").select("v", "lead")
    stars = held.join(lists, "v").where("lead < class").select(F.col("lead").alias("a"), F.col("class").alias("b")).distinct()
    pairs = tables.save(_close_enough(stars, classes), "pairs")
    texts = tables.save(_texts(pairs.select(F.col("a").alias("class")).union(pairs.select("b")), docs, owners), "texts")
    links = tables.save(_confirm(pairs, texts), "links")
    tables.drop("pairs", "texts")
    label = components(links, tables, "first")
    rare = tables.save(_rare_lists(classes, label), "rare")
    mixed = rare.select("comp", F.explode("p").alias("v")).groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members")).where("lo < hi").select("v", "members")
    rows = rare.select("class", "comp", "n", "sketch", "p", F.posexplode("p").alias("at", "v")).join(mixed, "v")
    members = tables.save(_left_over(rows.select("v", "members", "class", "comp", "n", "sketch", F.expr("slice(p, 1, at)").alias("before"))), "members")
    tables.drop("rare")
    if not members.isEmpty():
        texts = tables.save(_texts(members.select("class"), docs, owners), "more-texts")
        more = tables.save(_block_links(members, texts), "more-links")
        tables.drop("members", "more-texts")
        label = components(links.union(more), tables, "second")
    of_class = classes.select("class", "lo").join(label, "class", "left").select("class", "lo", F.coalesce("comp", "class").alias("component"))
    least = of_class.groupBy("component").agg(F.min("lo").alias("least"))
    of_class = of_class.join(least, "component").select("class", "component", "least")
    out = all_rows.select("doc_id", "th", "n_shingles", "class").join(of_class, "class", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "th", "component")
    out = out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "n_shingles", "component_id", "kept", "th", "component").checkpoint()
    tables.drop()
    return out


def one_of_each(docs):
    """docs with one row of each component: that of the least doc_id, of several texts with that id the one of least hash. Rows without a word all stay."""
    found = near_duplicates(docs).where("kept AND component IS NOT NULL")
    chosen = found.groupBy("component", "doc_id").agg(F.min("th").alias("__near_th")).select(F.col("doc_id").alias("__near_id"), "__near_th")
    word = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(word).withColumn("__near_hash", F.xxhash64("text"))
    rows = rows.join(chosen, rows.doc_id.eqNullSafe(F.col("__near_id")) & (F.col("__near_hash") == F.col("__near_th")), "left_semi")
    return rows.dropDuplicates(["doc_id", "__near_hash"]).select(*docs.columns).union(docs.where(~word))
