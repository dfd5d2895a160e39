"""Arrays as Parquet tables with their metadata beside them, read back whole."""
import json


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


def save(path, arrays, metadata=None, partition_by=None):
    """Writes named DataFrames under a path, and metadata as one JSON row; a whole array is written before the next."""
    spark = next(iter(arrays.values())).sparkSession
    for name, df in arrays.items():
        w = df.write.mode("overwrite")
        (w.partitionBy(partition_by) if partition_by in df.columns else w).parquet(f"{path}/{name}")
    rows = [(json.dumps({"arrays": sorted(arrays), "metadata": metadata or {}}),)]
    spark.createDataFrame(rows, "json string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_about")


def about(spark, path):
    return json.loads(spark.read.parquet(f"{path}/_about").first().json)


def names(spark, path):
    """The arrays under a path."""
    return about(spark, path)["arrays"]


def load(spark, path, name=None):
    """(array or dict of arrays, metadata)."""
    info = about(spark, path)
    if name is not None and name not in info["arrays"]:
        raise KeyError(f"{name} is none of {info['arrays']}")
    read = lambda n: spark.read.parquet(f"{path}/{n}")
    return (read(name) if name else {n: read(n) for n in info["arrays"]}), info["metadata"]


def save_recon(path, volume, model, traces=None, notes=None):
    """A reconstruction with what made it."""
    required, optional, regularisation = model.all_params()
    plain = lambda d: {k: v for k, v in d.items()}
    save(path, {"volume": volume}, {"required": plain(required), "optional": plain(optional), "regularisation": plain(regularisation), "traces": traces or [], "notes": notes or ""})


def load_recon(spark, path):
    """(volume, model, traces, notes)."""
    from rayframe.geometry import build

    volume, m = load(spark, path, "volume")
    tuples = lambda d: {k: tuple(v) if isinstance(v, list) and k != "views" else v for k, v in d.items()}
    return volume, build(tuples(m["required"]), tuples(m["optional"]), tuples(m["regularisation"])), m["traces"], m["notes"]


def save_preprocessing(path, sino, required, optional):
    save(path, {"sino": sino}, {"required": required, "optional": optional})


def load_preprocessing(spark, path):
    """(sinogram, required, optional)."""
    sino, m = load(spark, path, "sino")
    return sino, m["required"], m["optional"]
