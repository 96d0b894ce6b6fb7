"""Plain files, JSON records and guarded outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, length, modification time and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return fingerprint(files, "content").select("path", "length", F.col("modificationTime").alias("modified_at"), "sha256")


def fingerprint(rows: DataFrame, content: str) -> DataFrame:
    return rows.withColumn("sha256", F.sha2(content, 256))


def scan_records(spark: SparkSession, path: str, schema: T.StructType | str, required: list[str],
                 version: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(good, rejected)`` of a tree of JSON documents, one per file.

    Malformed text, an unknown version or a missing required field moves a
    record to ``rejected`` with the reason; the rest load.
    """
    texts = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(
        F.input_file_name().alias("path"), "value")
    return split_records(texts, schema, required, version)


def split_records(texts: DataFrame, schema: T.StructType | str, required: list[str], version: int = 1) -> tuple[DataFrame, DataFrame]:
    full = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = T.StructType([*full.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = texts.withColumn("r", F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    reason = F.when(F.col("r").isNull() | F.col("r._corrupt_record").isNotNull(), "malformed").when(
        ~F.col("r.version").eqNullSafe(F.lit(version)), "unsupported version")
    for name in required:
        reason = reason.when(F.col(f"r.{name}").isNull(), f"missing {name}")
    parsed = parsed.withColumn("reason", reason)
    good = parsed.filter("reason IS NULL").select("path", *[F.col(f"r.{f.name}").alias(f.name) for f in full.fields])
    return good, parsed.filter("reason IS NOT NULL").select("path", "reason")


def write_pixels(px: DataFrame, path: str, overwrite: bool = False, buckets: int = 256) -> None:
    """Parquet partitioned by a hash of the image; refuses to replace an output unless told to.

    A range over image and row inside a bucket keeps a huge image in many files.
    """
    placed = px.withColumn("image_bucket", F.pmod(F.hash("image_id"), F.lit(buckets)))
    (placed.repartitionByRange("image_bucket", "image_id", "y").write
     .mode("overwrite" if overwrite else "errorifexists").partitionBy("image_bucket").parquet(path))


def report_json(df: DataFrame, key: str) -> DataFrame:
    """One JSON document per row next to its key."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("report"))


def write_report(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)
