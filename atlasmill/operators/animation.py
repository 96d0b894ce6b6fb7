"""Animation frames, sprite sheets, cel compositing and boards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atlasmill.functions import color as c
from atlasmill.runtime import require

# Sheet limits of the exporter.
MAX_SIDE = 32768
MAX_SHEET_PIXELS = 16777216
BAND_HEIGHT = 128


def tag_frames(frames: DataFrame, tags: DataFrame) -> DataFrame:
    """Frames with every tag whose range contains them.

    A tag lists its own frame numbers, so the interval join is an equi join on
    document and frame; a document holds at most 65,535 frames.
    """
    spread = tags.select("doc_id", "name", F.explode(F.expr("sequence(CAST(from_frame AS BIGINT), CAST(to_frame AS BIGINT))")).alias("frame"))
    return frames.join(spread, ["doc_id", "frame"])


def _by_document(frames: DataFrame) -> Window:
    return Window.partitionBy("doc_id").orderBy("frame")


def frame_offsets(frames: DataFrame) -> DataFrame:
    """Start time of every frame: the durations before it."""
    before = _by_document(frames).rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("start_ms", F.coalesce(F.sum("duration_ms").over(before), F.lit(0)))


def sequence_totals(frames: DataFrame) -> DataFrame:
    return frames.groupBy("doc_id").agg(F.count(F.lit(1)).alias("frame_count"), F.sum("duration_ms").alias("total_ms"))


def sheet_layout(frames: DataFrame, width: int, height: int, layout: str = "grid", columns: int = 4, padding: int = 0) -> DataFrame:
    """Position of every frame on its sprite sheet, sheet size, and whether limits hold."""
    require(layout in ("horizontal", "vertical", "grid"), "layout must be horizontal, vertical or grid")
    require(width >= 1 and height >= 1 and columns >= 1 and padding >= 0, "sizes must be positive")
    counts = frames.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    wide = {"horizontal": "n", "vertical": "CAST(1 AS BIGINT)", "grid": f"LEAST(CAST({columns} AS BIGINT), n)"}[layout]
    plan = counts.selectExpr("doc_id", f"{wide} AS cols", f"(n + {wide} - 1) DIV {wide} AS rows")
    plan = plan.selectExpr("doc_id", "cols", f"cols * {width} + (cols - 1) * {padding} AS sheet_width",
                           f"rows * {height} + (rows - 1) * {padding} AS sheet_height")
    placed = frames.withColumn("i", F.row_number().over(_by_document(frames)) - 1).join(plan, "doc_id")
    return placed.selectExpr(
        "doc_id", "frame", f"CAST(i % cols AS BIGINT) * {width + padding} AS x", f"(i DIV cols) * {height + padding} AS y",
        "sheet_width", "sheet_height", f"sheet_width <= {MAX_SIDE} AND sheet_height <= {MAX_SIDE} "
        f"AND sheet_width * sheet_height <= {MAX_SHEET_PIXELS} AS within_limits")


def composite_cels(cels: DataFrame, pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Flatten the visible layers of every frame, bottom to top.

    ``cels`` has ``image_id, layer, x, y, visible``, ``pixels`` the cel pixels
    keyed by ``image_id, layer``.  Pixels outside the canvas are clipped, the
    lowest one on a spot is copied, the others are blended over it.  A spot
    folds at most one pixel per layer.
    """
    moved = pixels.withColumnsRenamed({"x": "px", "y": "py"}).join(
        cels.filter("visible").select("image_id", "layer", F.col("x").alias("ox"), F.col("y").alias("oy")), ["image_id", "layer"])
    placed = moved.selectExpr("image_id", "layer", "px + ox AS x", "py + oy AS y", "r", "g", "b", "a").filter(
        f"x >= 0 AND y >= 0 AND x < {width} AND y < {height}")
    stacks = placed.groupBy("image_id", "x", "y").agg(
        F.array_sort(F.collect_list(F.struct("layer", "r", "g", "b", "a"))).alias("s"))
    blend = ", ".join(f"'{v}', {c.over_channel(f's.{v}', 's.a', f't.{v}', 't.a')}" for v in "rgb")
    fold = (f"aggregate(slice(s, 2, size(s)), named_struct('r', s[0].r, 'g', s[0].g, 'b', s[0].b, 'a', s[0].a), "
            f"(t, s) -> named_struct({blend}, 'a', {c.over_alpha('s.a', 't.a')}))")
    return stacks.withColumn("v", F.expr(fold)).select("image_id", "x", "y", "v.r", "v.g", "v.b", "v.a")


# --- boards -----------------------------------------------------------------------------

def layers_in_band(layers: DataFrame, board_width: float, board_height: float) -> DataFrame:
    """Bands of 128 rows every rotated layer reaches; layers beside the board are left out.

    A layer computes its own bands from its bounding box.
    """
    require(board_width > 0 and board_height > 0, "board size must be positive")
    boxes = layers.selectExpr(
        "layer_index", "width * scale / 2 AS hw", "height * scale / 2 AS hh", "radians(angle) AS t", "x", "y").selectExpr(
        "layer_index", "abs(cos(t)) * hw + abs(sin(t)) * hh AS ex", "abs(sin(t)) * hw + abs(cos(t)) * hh AS ey",
        "x + hw AS cx", "y + hh AS cy")
    last = int((board_height - 1) // BAND_HEIGHT)
    reached = boxes.filter(f"cx + ex > 0 AND cx - ex < {c.num(board_width)} AND cy + ey > 0 AND cy - ey < {c.num(board_height)}")
    low = f"GREATEST(0, CAST(FLOOR((cy - ey) / {BAND_HEIGHT}) AS INT) - 1)"
    high = f"LEAST({last}, CAST(FLOOR((cy + ey) / {BAND_HEIGHT}) AS INT) + 1)"
    each = reached.withColumn("band", F.explode(F.expr(f"sequence({low}, {high})"))).filter(
        f"cy + ey > band * {BAND_HEIGHT} AND cy - ey < LEAST((band + 1) * {BAND_HEIGHT}, {c.num(board_height)})")
    return each.select("band", "layer_index")


def remove_layer(layers: DataFrame, index: int) -> DataFrame:
    """Remove one layer; the ones above move down."""
    return layers.filter(F.col("layer_index") != index).withColumn(
        "layer_index", F.expr(f"layer_index - CASE WHEN layer_index > {index} THEN 1 ELSE 0 END"))


def reorder_layer(layers: DataFrame, source: int, target: int) -> DataFrame:
    """Move one layer to another place; the layers between shift by one."""
    low, high, step = (source + 1, target, -1) if source < target else (target, source - 1, 1)
    return layers.withColumn("layer_index", F.expr(
        f"CASE WHEN layer_index = {source} THEN CAST({target} AS BIGINT) "
        f"WHEN layer_index BETWEEN {low} AND {high} THEN layer_index + {step} ELSE layer_index END"))


def transform_layer(layers: DataFrame, index: int, **changes: float) -> DataFrame:
    """Set x, y, angle or scale of one layer."""
    limits = {"x": (-1e9, 1e9), "y": (-1e9, 1e9), "angle": (-360000, 360000), "scale": (0.1, 3)}
    require(bool(changes) and set(changes) <= set(limits), "change at least one of x, y, angle, scale")
    out = layers
    for name, value in changes.items():
        require(limits[name][0] <= value <= limits[name][1], f"{name} is out of range")
        out = out.withColumn(name, F.when(F.col("layer_index") == index, F.lit(float(value))).otherwise(F.col(name)))
    return out
