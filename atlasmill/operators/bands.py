"""Windows along image rows and columns, in bands of bounded length.

A column of a tall image, or a row of a wide one, is cut into bands; pixels near a band's end are
copied to the band beside it, so a window sees the neighbours it needs and no task ever sorts a whole
column. Copies are dropped when the window has done its work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BAND = 2048
OTHER = {"x": "y", "y": "x"}


def along(px: DataFrame, axis: str, build: Callable[[DataFrame, WindowSpec], DataFrame], reach: int = 1) -> DataFrame:
    """``build(rows, window)`` over pixels ordered by ``axis``, right for what looks at most ``reach`` pixels ahead or back."""
    at, band = F.pmod(F.col(axis), F.lit(BAND)), F.floor(F.col(axis) / BAND)
    homes = F.array(F.struct(band.alias("_band"), F.lit(False).alias("_copy")),
                    F.when(at < reach, F.struct((band - 1).alias("_band"), F.lit(True).alias("_copy"))),
                    F.when(at >= BAND - reach, F.struct((band + 1).alias("_band"), F.lit(True).alias("_copy"))))
    rows = px.select("*", F.inline(F.filter(homes, lambda h: h.isNotNull())))
    window = Window.partitionBy("image_id", OTHER[axis], "_band").orderBy(axis)
    return build(rows, window).filter(~F.col("_copy")).drop("_band", "_copy")


#: Side of the tiles that windows in both directions share.
TILE = 256


def _tile(x: Column, y: Column) -> Column:
    return (y.cast("long") * F.lit(1 << 32) + x.cast("long")).alias("_tile")


def within_tiles(px: DataFrame, build: Callable[[DataFrame, WindowSpec, WindowSpec], DataFrame]) -> DataFrame:
    """``build(rows, line, column)`` with windows along x and along y, right for what looks at pixels around each.

    Pixels are sent once to their tile, those at its border also to the tiles beside it. Both windows stay
    inside a tile, so the steps of ``build`` need no further shuffle and no task sorts more than whole tiles.
    """
    def homes(axis: str) -> Column:
        at, own = F.pmod(F.col(axis), F.lit(TILE)), F.floor(F.col(axis) / TILE)
        return F.array_compact(F.array(own, F.when(at == 0, own - 1), F.when(at == TILE - 1, own + 1)))

    rows = px.withColumn("_tx", F.explode(homes("x"))).withColumn("_ty", F.explode(homes("y")))
    rows = rows.select(*px.columns, _tile(F.col("_tx"), F.col("_ty"))).repartition("image_id", "_tile")
    line = Window.partitionBy("image_id", "_tile", "y").orderBy("x")
    column = Window.partitionBy("image_id", "_tile", "x").orderBy("y")
    own = _tile(F.floor(F.col("x") / TILE), F.floor(F.col("y") / TILE))
    return build(rows, line, column).filter(F.col("_tile") == own).drop("_tile")


def run_lengths(px: DataFrame, axis: str, name: str) -> DataFrame:
    """``px`` with the length of the run of touching pixels along ``axis`` that holds each.

    Runs are found inside bands. Those that reach a band's end are put together from band to band:
    only their ends are looked at, so a column costs as many rows as it has bands.
    """
    other = OTHER[axis]
    rows = px.withColumn("_band", F.floor(F.col(axis) / BAND))
    line = Window.partitionBy("image_id", other, "_band").orderBy(axis)
    rows = rows.withColumn("_run", F.col(axis) - F.row_number().over(line))
    own = Window.partitionBy("image_id", other, "_band", "_run")
    rows = rows.withColumns({"_first": F.min(axis).over(own), "_last": F.max(axis).over(own)})
    ends = (F.pmod("_first", F.lit(BAND)) == 0) | (F.pmod("_last", F.lit(BAND)) == BAND - 1)
    cut = rows.filter(ends & (F.col(axis) == F.col("_first"))).select("image_id", other, "_first", "_last")
    column = Window.partitionBy("image_id", other).orderBy("_first")
    goes_on = F.coalesce(F.lag("_last").over(column) + 1 == F.col("_first"), F.lit(False))
    cut = cut.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_chain", F.sum("_new").over(column))
    whole = F.sum(F.col("_last") - F.col("_first") + 1).over(Window.partitionBy("image_id", other, "_chain"))
    cut = cut.select("image_id", other, "_first", whole.alias("_whole"))
    joined = rows.join(cut, ["image_id", other, "_first"], "left")
    length = F.coalesce("_whole", F.col("_last") - F.col("_first") + 1).cast("long")
    return joined.select(*px.columns, length.alias(name))
