"""Image folders as tables of images and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(images, rejected)`` of a folder of PNG, JPEG, BMP or GIF files.

    ``images`` has ``image_id, origin, width, height, n_channels, data``.  Files
    that cannot be decoded are listed in ``rejected`` and do not stop the rest.
    """
    raw = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path)
    rows = raw.select(F.xxhash64("image.origin").alias("image_id"), "image.origin", "image.width", "image.height",
                      F.col("image.nChannels").alias("n_channels"), "image.data")
    good = (F.col("width") > 0) & (F.col("height") > 0)
    return rows.filter(good), rows.filter(~good).select("origin")


def explode_pixels(images: DataFrame) -> DataFrame:
    """One row per pixel.  Bytes are B, G, R(, A) row by row; a single channel is grey.

    Image rows are cut out first, so no expression walks the whole buffer once
    per pixel.
    """
    lines = images.select("image_id", "width", "n_channels", F.explode(F.expr(
        "transform(sequence(0, height - 1), y -> named_struct('y', y, "
        "'line', substring(data, y * width * n_channels + 1, width * n_channels)))")).alias("l"))
    cells = lines.select("image_id", "n_channels", F.col("l.y").alias("y"), F.col("l.line").alias("line"),
                         F.explode(F.expr("sequence(0, width - 1)")).alias("x"))

    def byte(offset: str) -> str:
        return f"CAST(conv(hex(substring(line, x * n_channels + {offset} + 1, 1)), 16, 10) AS INT)"
    return cells.selectExpr(
        "image_id", "x", "y", f"{byte('CASE WHEN n_channels >= 3 THEN 2 ELSE 0 END')} AS r",
        f"{byte('CASE WHEN n_channels >= 3 THEN 1 ELSE 0 END')} AS g", f"{byte('0')} AS b",
        f"CASE WHEN n_channels = 4 THEN {byte('3')} ELSE 255 END AS a")
