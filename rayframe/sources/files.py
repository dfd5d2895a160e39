"""Scans from files: folders of grey TIFF images and tagged text.

Images are read as binary files by Spark's own reader, so any store works; a task decodes
the images of its files, one at a time.
"""
import struct

from pyspark.sql import functions as F

# TIFF's field sizes by type, and the sample kinds it names.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8, 16: 8}
KINDS = {1: "u", 2: "i", 3: "f"}


def decode_tiff(data):
    """The first grey image of an uncompressed TIFF as a NumPy array."""
    import numpy as np

    order = {b"II": "<", b"MM": ">"}[data[:2]]
    if struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("no TIFF of the common kind")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n, _ = struct.unpack(order + "HHII", data[at + 2 + 12 * i : at + 14 + 12 * i])
        size = SIZES.get(kind, 1) * n
        start = at + 10 + 12 * i
        if size > 4:
            start = struct.unpack(order + "I", data[start : start + 4])[0]
        if kind in (1, 3, 4):
            tags[tag] = struct.unpack(order + {1: "B", 3: "H", 4: "I"}[kind] * n, data[start : start + size])
    if tags.get(259, (1,))[0] != 1 or tags.get(277, (1,))[0] != 1:
        raise ValueError("only grey images without compression are read")
    kind = np.dtype(f"{order}{KINDS[tags.get(339, (1,))[0]]}{tags[258][0] // 8}")
    pixels = b"".join(data[a : a + n] for a, n in zip(tags[273], tags[279]))
    return np.frombuffer(pixels, kind).reshape(tags[257][0], tags[256][0])


def encode_tiff(image):
    """A NumPy array as an uncompressed TIFF of one strip."""
    import numpy as np

    image = np.ascontiguousarray(image)
    image = image.astype(image.dtype.newbyteorder("<"))
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    fields = [(256, 4, image.shape[1]), (257, 4, image.shape[0]), (258, 3, image.dtype.itemsize * 8), (259, 3, 1), (262, 3, 1), (273, 4, 0), (277, 3, 1), (278, 4, image.shape[0]), (279, 4, image.nbytes), (339, 3, kind)]
    start = 8 + 2 + 12 * len(fields) + 4
    body = b"".join(struct.pack("<HHII", t, k, 1, start if t == 273 else v) for t, k, v in fields)
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(fields)) + body + b"\0" * 4 + image.tobytes()


def tiff_stack(spark, path, first=0, last=None, step=1, normalise=True):
    """(view, det_row, channel, value) of a folder's images in the order of their names; counts as a share of their type's greatest value."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").load(path)
    names = sorted(r.path for r in files.select("path").collect())[first:last:step]  # one name a view
    if not names:
        raise FileNotFoundError(f"no image under {path}")
    number = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "path string, view int")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for view, data in zip(b.column(0).to_pylist(), b.column(1)):
                x = decode_tiff(data.as_py())
                y = x.astype("f8") / (np.iinfo(x.dtype).max if normalise and x.dtype.kind in "ui" else 1)
                r, c = np.indices(x.shape)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(x.size, view, "i4")), pa.array(r.ravel().astype("i4")), pa.array(c.ravel().astype("i4")), pa.array(y.ravel())], ["view", "det_row", "channel", "value"])

    return files.join(number, "path").select("view", "content").mapInArrow(run, "view int, det_row int, channel int, value double")


def tiff_image(spark, path, **how):
    """(det_row, channel, value) of one image."""
    import os

    return tiff_stack(spark, os.path.dirname(path), **how) if not path.lower().endswith((".tif", ".tiff")) else _one(spark, path, **how)


def _one(spark, path, normalise=True):
    x = decode_tiff(spark.read.format("binaryFile").load(path).first().content)
    import numpy as np

    y = x.astype("f8") / (np.iinfo(x.dtype).max if normalise and x.dtype.kind in "ui" else 1)
    r, c = np.indices(x.shape)
    return spark.createDataFrame(list(zip(r.ravel().tolist(), c.ravel().tolist(), y.ravel().tolist())), "det_row int, channel int, value double")


def tagged(spark, path):
    """(section, tag, value) of text whose values stand between <tag> and </tag>, section by section of the innermost open tag."""
    lines = spark.read.option("wholetext", True).text(path)

    def run(batches):
        import re

        import pyarrow as pa

        for b in batches:
            rows, open_ = [], []
            for text in b.column(0).to_pylist():
                for m in re.finditer(r"<(/?)([^<>/]+)>([^<]*)", text or ""):
                    if m[1]:
                        open_ = open_[: len(open_) - 1 - open_[::-1].index(m[2])] if m[2] in open_ else open_
                        continue
                    value = m[3].strip()
                    if value:
                        rows.append((open_[-1] if open_ else "", m[2], value))
                    open_.append(m[2])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 3, ["section", "tag", "value"])

    return lines.mapInArrow(run, "section string, tag string, value string")


def tag_value(table, tag, section=None):
    """The first value of a tag, in a section if one is given."""
    x = table.where(F.col("tag") == tag) if section is None else table.where((F.col("tag") == tag) & (F.col("section") == section))
    r = x.first()
    if r is None:
        raise KeyError(f"no tag {tag}")
    return r.value
