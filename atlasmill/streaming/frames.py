"""Frame sequences: the same recipe on every frame of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasmill.plans.recipes import apply_recipe, check_steps
from atlasmill.runtime import cut_lineage, exists, work_folder

PIXEL_SCHEMA = "image_id BIGINT, x INT, y INT, r INT, g INT, b INT, a INT"
#: With the number of pixel rows of the frame, so that a frame may be cut over files.
CUT_SCHEMA = f"{PIXEL_SCHEMA}, total BIGINT"


def read_frame_stream(spark: SparkSession, path: str, files_per_trigger: int = 100, cut: bool = False) -> DataFrame:
    """Stream of pixel Parquet files. A file holds whole frames, or with ``cut`` any rows of frames, with ``total``."""
    return spark.readStream.schema(CUT_SCHEMA if cut else PIXEL_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def frame_stream_apply(frames: DataFrame, steps: list[dict], folder: str | None = None) -> DataFrame:
    """Replay a recipe on every frame and return the written pixels.

    Frames are independent, so each micro-batch is an ordinary corpus. Frames with a ``total`` wait
    until all their rows have come. All outputs must share one size, which the first ones fix. What waits and the
    size are stored beside the output, batch by batch: a restart goes on with them, and a repeated batch
    replaces its own files.
    """
    spark = frames.sparkSession
    check_steps(spark, steps)
    folder = folder or work_folder(spark, "frames")
    cut = "total" in frames.columns
    columns = PIXEL_SCHEMA.replace(" BIGINT", "").replace(" INT", "").split(", ")

    def earlier(name: str, schema: str, batch_id: int) -> DataFrame:
        path = f"{folder}/{name}"
        if not exists(spark, path):
            return spark.createDataFrame([], f"{schema}, batch INT")
        return spark.read.schema(f"{schema}, batch INT").parquet(path).filter(F.col("batch") < batch_id)

    def complete(batch: DataFrame, batch_id: int) -> DataFrame:
        waiting = earlier("waiting", CUT_SCHEMA, batch_id).filter(F.col("batch") == batch_id - 1).drop("batch")
        rows = cut_lineage(waiting.unionByName(batch.select(*waiting.columns)))
        full = rows.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("need")).filter("n >= need").select("image_id")
        full = cut_lineage(full)
        rows.join(full, "image_id", "left_anti").write.mode("overwrite").parquet(f"{folder}/waiting/batch={batch_id}")
        return rows.join(full, "image_id", "left_semi").select(*columns)

    def store(batch: DataFrame, batch_id: int) -> None:
        ready = complete(batch, batch_id) if cut else batch
        target = f"{folder}/out/batch={batch_id}"
        apply_recipe(ready, steps).write.mode("overwrite").parquet(target)
        shapes = spark.read.schema(PIXEL_SCHEMA).parquet(target).groupBy("image_id").agg(
            (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")).select("width", "height").distinct()
        known = earlier("size", "width INT, height INT", batch_id).select("width", "height")
        sizes = shapes.unionByName(known).distinct().head(2)
        if len(sizes) > 1:
            raise ValueError(f"frames differ in size: {sorted(map(tuple, sizes))}")
        spark.createDataFrame(sizes, "width INT, height INT").coalesce(1).write.mode("overwrite").parquet(f"{folder}/size/batch={batch_id}")

    query = (frames.writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(f"{PIXEL_SCHEMA}, batch INT").parquet(f"{folder}/out").drop("batch")
