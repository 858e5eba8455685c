"""Image sources and sinks.

IDX files (optionally gzip-compressed) are read as whole binary files, one
task per file pair (gzip does not split), decoded by ``applyInPandas`` into one row
per picture, and repartitioned so later stages run wide. The embeddings table
stands in for decoded pictures in registered queries.
"""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_engine.schema import IMAGE_SCHEMA

# The 10 class names of the image set, by label.
CLASS_NAMES = ["T-shirt/top", "Trouser", "Pullover", "Dress", "Coat",
               "Sandal", "Shirt", "Sneaker", "Bag", "Ankle boot"]

IDX_IMAGES_MAGIC = 2051
IDX_LABELS_MAGIC = 2049


def class_frame(spark: SparkSession) -> DataFrame:
    """J2 dimension: label -> class name (10 fixed rows)."""
    return spark.createDataFrame(list(enumerate(CLASS_NAMES)), "label int, class_name string")


def with_class_names(df: DataFrame, label: str = "label") -> DataFrame:
    """Attach class names; the dimension has 10 rows, so broadcast."""
    dim = class_frame(df.sparkSession).withColumnRenamed("label", label)
    return df.join(F.broadcast(dim), label, "left")


def _open(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def _decode_pair(pdf: pd.DataFrame) -> pd.DataFrame:
    """Decode one image file (and its label file, if present) into rows."""
    files = {p: _open(c) for p, c in zip(pdf["path"], pdf["content"])}
    out = []
    for path, raw in files.items():
        if struct.unpack(">I", raw[:4])[0] != IDX_IMAGES_MAGIC:
            continue
        n, rows, cols = struct.unpack(">III", raw[4:16])
        pix = np.frombuffer(raw, dtype=np.uint8, offset=16, count=n * rows * cols)
        pix = pix.reshape(n, rows * cols).astype(np.float64)
        labels = np.full(n, -1, dtype=np.int32)
        for lp, lraw in files.items():
            if struct.unpack(">I", lraw[:4])[0] == IDX_LABELS_MAGIC:
                ln = struct.unpack(">I", lraw[4:8])[0]
                if ln != n:
                    raise ValueError(f"{lp}: {ln} labels for {n} images")
                labels[:] = np.frombuffer(lraw, dtype=np.uint8, offset=8, count=ln)
        name = path.rsplit("/", 1)[-1].split("-images-")[0]  # the set's name, wherever it is stored
        out.append(pd.DataFrame({"image_id": [f"{name}:{i}" for i in range(n)],
                                 "label": labels, "pixels": list(pix)}))
    if not out:
        return pd.DataFrame({"image_id": pd.Series([], dtype="str"),
                             "label": pd.Series([], dtype="int32"), "pixels": []})
    return pd.concat(out, ignore_index=True)


def read_idx(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Decode IDX image + label files under ``path`` into IMAGE_SCHEMA rows.

    Files are grouped by their shared stem (``x-images-idx3-ubyte.gz`` with
    ``x-labels-idx1-ubyte.gz``), one group per image file, then the decoded
    rows are spread over ``partitions`` tasks.
    """
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    stem = F.regexp_replace(F.col("path"), r"-(images-idx3|labels-idx1)-ubyte(\.gz)?$", "")
    out = raw.groupBy(stem.alias("stem")).applyInPandas(
        lambda pdf: _decode_pair(pdf), IMAGE_SCHEMA)
    n = partitions or spark.sparkContext.defaultParallelism
    return out.repartition(n)


def scale_pixels(df: DataFrame, col: str = "pixels", out: str | None = None) -> DataFrame:
    """0..255 -> 0..1."""
    return df.withColumn(out or col, F.transform(F.col(col), lambda x: x / F.lit(255.0)))


def to_grid(col: str, rows: int, cols: int):
    """The inverse of P19: flat row-major pixels -> array of rows."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)),
                       lambda i: F.slice(F.col(col), i * cols + 1, cols))


def flatten_grid(col: str):
    """2-D picture -> 1-D row-major array."""
    return F.flatten(F.col(col))


def write_parquet(df: DataFrame, path: str) -> None:
    """Binary array persistence."""
    df.write.mode("overwrite").parquet(path)


def write_flat_csv(df: DataFrame, path: str, n_pixels: int = 784) -> None:
    """``label`` first, then one column per pixel named 0..n-1."""
    cols = [F.col("label")] + [F.col("pixels")[i].alias(str(i)) for i in range(n_pixels)]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)
