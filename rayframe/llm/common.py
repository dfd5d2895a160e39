"""Helpers shared by the text operators."""
import uuid

from pyspark.sql import functions as F

BATCH = "256"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark):
    """Arrow batches stay small since texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def shared_folder(spark):
    """The cluster's checkpoint folder; in local mode one of our own where none is set."""
    import tempfile

    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp()
        spark.sparkContext.setCheckpointDir(at)
    return at


def ready(spark):
    shared_folder(spark)
    small_batches(spark)


class Tables:
    """Tables written to the shared folder between the steps of an operator.

    A table is whole before the next step reads it, so a lost executor costs tasks only;
    shuffle files go when a table is written, and drop() removes tables no longer needed.
    """

    def __init__(self, spark, name):
        self.spark, self.at = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df, name):
        conf = self.spark.conf
        before = conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            df.write.parquet(f"{self.at}/{name}")
        finally:
            conf.set(CLEANUP, before)
        return self.spark.read.parquet(f"{self.at}/{name}")

    def drop(self, *names):
        """Removes the named tables, or all without names."""
        jvm = self.spark.sparkContext._jvm
        for path in [f"{self.at}/{n}" for n in names] or [self.at]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def rows_of(batches, *columns):
    """Per Arrow batch the named columns, strings as Python values."""
    for b in batches:
        yield [b.column(b.schema.get_field_index(c)).to_pylist() for c in columns]


def groups(batches, keys):
    """(key, rows) of runs of rows with equal keys in an Arrow batch stream; rows are dicts."""
    now, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            key = tuple(r[k] for k in keys)
            if key != now:
                if rows:
                    yield now, rows
                now, rows = key, []
            rows.append(r)
    if rows:
        yield now, rows


def held_out(modulus, rest):
    """crc32 of the doc_id as text, modulo; null ids count as the text 'null'."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % modulus == rest


def sample(rows, bound, *cols):
    """Rows of at most `bound` doc_ids by hash, to fit a classifier on the driver.

    Ids are chosen without texts; only the chosen rows' texts are read out.
    """
    ids = rows.select("doc_id").orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id").limit(bound).distinct()
    return rows.select("doc_id", *cols).join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id").toPandas()


def sample_labelled(docs, labels, column, bound):
    """text and y of at most `bound` labelled doc_ids; one label per doc_id (the least)."""
    known = labels.where(F.col(column).isNotNull()).groupBy("doc_id").agg(F.min(column).alias("y"))
    ids = docs.select("doc_id").distinct().join(known, "doc_id").orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id").limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id").toPandas()
