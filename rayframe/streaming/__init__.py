"""Views as they come: transmission of a growing folder of scans."""
from pyspark.sql import functions as F

from rayframe.operators.scans import CELL, mean_scan, transmission

SCAN = "view int, det_row int, channel int, value double"


def sino_stream(spark, folder, blank, dark):
    """A streaming sinogram of the Parquet scans that arrive in a folder; references are still tables."""
    refs = mean_scan(blank).withColumnRenamed("value", "_b").join(mean_scan(dark).withColumnRenamed("value", "_d"), ["det_row", "channel"])
    scans = spark.readStream.schema(SCAN).parquet(folder)
    return scans.join(refs, ["det_row", "channel"]).select(*CELL, transmission(F.col("value"), F.col("_b"), F.col("_d")).alias("value"))


def write_views(stream, path, checkpoint, once=False):
    """Appends a streaming sinogram to Parquet; exactly once by the checkpoint, which lies in a shared folder."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
