"""Session settings and the few distribution helpers every module shares.

Nothing here looks at data on the driver.  The helpers exist so that one hot
image, source or colour never ends up whole in a single task.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the operators assume."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="atlasmill-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, for stream state and outputs."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read on from there.

    Used once per round of an iterative operator.  The next round starts from
    files that survive the loss of an executor, is computed only once, and has
    a known size, so Spark can decide on its own whether a side is small enough
    to broadcast.
    """
    folder = work_folder(df.sparkSession, "round")
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._stored = folder
    return out


def stored(df: DataFrame) -> DataFrame:
    """``df`` itself if it is a stored round, else a stored copy."""
    return df if hasattr(df, "_stored") else cut_lineage(df)


def discard(*frames: DataFrame) -> None:
    """Delete stored rounds that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, on whatever file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def attach_per_image(rows: DataFrame, per_image: DataFrame, how: str = "inner",
                     keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Join a one-row-per-key table onto many rows.

    The small side is not copied: Spark broadcasts it where it is small, and splits the rows of a hot image
    at run time (``configure``) where it is not.
    """
    return rows.join(per_image, list(keys), how)


def attach_unique(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: list[str],
                  how: str = "left") -> DataFrame:
    """Equi join to a table unique on ``keys`` when ``keys`` may be hot on the left.

    ``lookup`` may be as long as ``rows``, so it is not copied per salt: at run time Spark splits a hot key's rows
    (``configure``) and reads the lookup beside each part. ``spread`` names the columns that tell rows of one key apart.
    """
    return rows.join(lookup, keys, how)


def bucketed_row_number(df: DataFrame, keys: list[str], bucket: Column,
                        order: list[str | Column], name: str) -> DataFrame:
    """Exact one-based row number per ``keys`` without sorting a whole key in one task.

    ``bucket`` must be non-decreasing in ``order``.  Rows are ranked inside a
    bucket and shifted by the running size of the buckets before it, so a hot
    key costs one task per bucket; only bucket sizes are ordered per key.
    """
    tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = tagged.withColumn("_rank", F.row_number().over(inside))
    return (ranked.join(offsets, [*keys, "_bucket"])
            .withColumn(name, F.col("_before") + F.col("_rank"))
            .drop("_bucket", "_rank", "_before"))


def bucketed_running_sum(df: DataFrame, keys: list[str], bucket: Column, order: list[str | Column],
                         value: str, name: str, how: str = "sum") -> DataFrame:
    """Sum (or maximum) of ``value`` over the rows before each row, with the same bucketing idea."""
    combine = {"sum": F.sum, "max": F.max}[how]
    tagged = df.withColumn("_bucket", bucket)
    sums = tagged.groupBy(*keys, "_bucket").agg(combine(value).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_bucket", combine("_n").over(before).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = tagged.withColumn("_inside", combine(value).over(inside))
    left, right = summed.alias("l"), offsets.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_bucket"]]
    parts = F.col("r._before"), F.col("l._inside")
    if how == "sum":
        total = F.coalesce(parts[0], F.lit(0)) + F.coalesce(parts[1], F.lit(0))
    else:
        total = F.greatest(*parts)
    return left.join(right, same).select("l.*", total.alias(name)).drop(
        "_bucket", "_inside")


def require(condition: bool, message: str) -> None:
    """Reject a bad parameter before any job starts."""
    if not condition:
        raise ValueError(message)
