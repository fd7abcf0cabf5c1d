"""Page photos as pixels, and what is read besides: manifests, labels and overrides as JSON."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_SIDE, MOST_SIDE = 16, 4200
#: Bytes at a file's start in which its orientation is looked for: some segments of at most 64 KB before it, and its own.
HEAD = 1 << 20
BOX = T.StructType([T.StructField(c, T.IntegerType()) for c in ("x0", "y0", "x1", "y1")])
BLOBS = T.StructType(
    [
        T.StructField("pad", T.IntegerType()),
        T.StructField("mode", T.StringType()),
        T.StructField("photos", T.ArrayType(T.StringType())),
        T.StructField(
            "blobs",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.IntegerType()),
                        T.StructField("photo", T.StringType()),
                        T.StructField("row", T.IntegerType()),
                        T.StructField("box", BOX),
                        T.StructField("area", T.LongType()),
                        T.StructField("crop", T.StringType()),
                        T.StructField("cropSize", T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])),
                    ]
                )
            ),
        ),
    ]
)


def orientation(content: bytes) -> int:
    """How a camera held the page, 1 to 8, by the orientation tag of a JPEG's APP1 segment; 1 if there is none or it cannot be read."""
    if content[:2] != b"\xff\xd8":
        return 1
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] not in (0xD9, 0xDA):
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        body = content[at + 4 : at + 2 + size]
        if content[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
            return _tag(body[6:])
        at += 2 + max(size, 2)
    return 1


def _tag(tiff: bytes) -> int:
    """The orientation in the first directory of a TIFF header."""
    order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
    if order is None or int.from_bytes(tiff[2:4], order) != 42:
        return 1
    at = int.from_bytes(tiff[4:8], order)
    for k in range(int.from_bytes(tiff[at : at + 2], order)):
        entry = tiff[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) == 12 and int.from_bytes(entry[:2], order) == 0x0112:
            found = int.from_bytes(entry[8:10], order)
            return found if 1 <= found <= 8 else 1
    return 1


def upright(image: np.ndarray, held: int) -> np.ndarray:
    """The image as it was seen: 2 to 4 mirror rows and columns, 5 to 8 also exchange them."""
    image = image.swapaxes(0, 1) if held >= 5 else image
    image = image[::-1] if held in (3, 4, 7, 8) else image
    return image[:, ::-1] if held in (2, 3, 6, 7) else image


def orientations(spark: SparkSession, path: str) -> DataFrame:
    """(place, orientation) of the files under a path; place is the path without the file system's slashes."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"place": batch["place"], "orientation": [orientation(bytes(c)) for c in batch["head"]]})

    files = spark.read.format("binaryFile").load(path)
    return files.select(_place(F.col("path")).alias("place"), F.substring("content", 1, HEAD).alias("head")).mapInPandas(kernel, "place string, orientation int")


def _place(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:/")


def photos(spark: SparkSession, path: str) -> DataFrame:
    """(photo, width, height, channels, data, orientation) of the images under a path; one that cannot be decoded, or is below 16 pixels a side, is an error.

    Width, height and data are as stored; ``gray_pixels`` turns the page as its orientation says.
    """
    read = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")
    broken = (F.col("width") < 0) | (F.col("height") < 0)
    small = (F.col("width") < LEAST_SIDE) | (F.col("height") < LEAST_SIDE)
    width = F.when(broken, F.raise_error(F.concat(F.lit("cannot decode: "), F.col("origin"))).cast("int")).when(small, F.raise_error(F.concat(F.lit("image too small: "), F.col("origin"))).cast("int")).otherwise(F.col("width"))
    held = read.withColumn("place", _place(F.col("origin"))).join(orientations(spark, path), "place", "left")
    return held.select(F.col("origin").alias("photo"), width.alias("width"), "height", F.col("nChannels").alias("channels"), "data", F.coalesce("orientation", F.lit(1)).alias("orientation"))


def _median3(g: np.ndarray) -> np.ndarray:
    padded = np.pad(g, 1, mode="edge")
    windows = np.lib.stride_tricks.sliding_window_view(padded, (3, 3)).reshape(*g.shape, 9)
    return np.partition(windows, 4, axis=2)[:, :, 4]


def _shrunk(g: np.ndarray, most: int) -> np.ndarray:
    """Means of blocks as even as whole pixels allow, so that the longer side is ``most``; never enlarged, no pixel left out."""
    longest = max(g.shape)
    if longest <= most:
        return g
    rows, columns = (np.arange(n) * side // n for side in g.shape for n in (max(1, (2 * side * most + longest) // (2 * longest)),))
    sums = np.add.reduceat(np.add.reduceat(g.astype(np.int64), rows, 0), columns, 1)
    counts = np.diff(np.r_[rows, g.shape[0]])[:, None] * np.diff(np.r_[columns, g.shape[1]])[None, :]
    return ((2 * sums + counts) // (2 * counts)).astype(g.dtype)


def gray_pixels(images: DataFrame, median: bool = True, most: int = MOST_SIDE) -> DataFrame:
    """(page_id, y, x, gray): upright, transparency on white paper, whole-number luma, at most ``most`` a side, 3 by 3 median.

    Spark's images are BGR or BGRA, row by row; without the column orientation they are upright. Pages
    stream through one at a time.
    """
    if "orientation" not in images.columns:
        images = images.withColumn("orientation", F.lit(1))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for photo, width, height, channels, data, held in zip(*(batch[c] for c in ("photo", "width", "height", "channels", "data", "orientation")), strict=True):
                p = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.int64)
                if channels == 4:
                    p = (p[:, :, :3] * p[:, :, 3:] + 255 * (255 - p[:, :, 3:]) + 127) // 255
                g = p[:, :, 0] if channels == 1 else (77 * p[:, :, 2] + 150 * p[:, :, 1] + 29 * p[:, :, 0]) >> 8
                g = _shrunk(upright(g, held), most)
                g = _median3(g) if median else g
                y, x = np.indices(g.shape)
                yield pd.DataFrame({"page_id": photo, "y": y.ravel(), "x": x.ravel(), "gray": g.ravel()})

    return images.mapInPandas(kernel, "page_id string, y int, x int, gray int")


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """(id, photo, row, x0, y0, x1, y1, area, crop) of a manifest of boxes; a box without a photo is on the first."""
    read = spark.read.schema(BLOBS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    each = read.select(F.col("photos").getItem(0).alias("first"), F.explode("blobs").alias("b"))
    return each.select("b.id", F.coalesce("b.photo", "first").alias("photo"), "b.row", "b.box.*", "b.area", "b.crop")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(blob_id, label) of a JSON map; empty labels go."""
    read = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("id", "label"))
    return read.where("label <> ''").select(F.col("id").cast("int").alias("blob_id"), "label")


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """(blob_id, ox0, oy0, ox1, oy1) of a JSON map from ids to four whole numbers; anything else is an error."""
    read = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<int>>")).alias("id", "b"))
    four = F.when((F.size("b") == 4) & ~F.exists("b", lambda v: v.isNull()), F.col("b")).otherwise(F.raise_error(F.concat(F.lit("a box needs four numbers: "), F.col("id"))).cast("array<int>"))
    return read.select(F.col("id").cast("int").alias("blob_id"), four.alias("b")).select("blob_id", *(F.col("b")[i].alias(n) for i, n in enumerate(("ox0", "oy0", "ox1", "oy1"))))
