"""Projections, filters and aggregates over pixel rows.

A pixel row is ``(image_id, x, y, r, g, b, a)``.  Scan order is ``(y, x)``;
"first" always means first in scan order.  Alpha 0 means the colour is unknown:
such pixels stay in every output but never enter a colour statistic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasmill.functions import color as c
from atlasmill.runtime import attach_per_image, attach_unique, require

PALETTE_LIMIT = 1024
PIXEL = ["image_id", "x", "y", "r", "g", "b", "a"]


def scan_order() -> Column:
    return F.struct("y", "x")


def image_sizes(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def with_sizes(px: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Add ``width`` and ``height``; pass ``sizes`` when a table of images has them."""
    return attach_per_image(px, sizes if sizes is not None else image_sizes(px))


def with_rgb(px: DataFrame) -> DataFrame:
    return px.withColumn("rgb", F.expr(c.pack_rgb()))


# --- classes, crops, masks -----------------------------------------------------

def visible(px: DataFrame) -> DataFrame:
    return px.filter("a > 0")


def alpha_class(px: DataFrame) -> DataFrame:
    return px.withColumn("alpha_class", F.expr(
        "CASE WHEN a = 0 THEN 'transparent' WHEN a = 255 THEN 'opaque' ELSE 'translucent' END"))


def trim_transparent(px: DataFrame) -> DataFrame:
    """Crop to the visible bounding box; an image without one becomes a single empty pixel."""
    box = px.groupBy("image_id").agg(
        *[F.min(F.when(F.col("a") > 0, F.col(v))).alias(f"{v}0") for v in "xy"],
        *[F.max(F.when(F.col("a") > 0, F.col(v))).alias(f"{v}1") for v in "xy"])
    kept = (attach_per_image(px, box.filter("x0 IS NOT NULL"))
            .filter("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
            .select("image_id", (F.col("x") - F.col("x0")).alias("x"),
                    (F.col("y") - F.col("y0")).alias("y"), "r", "g", "b", "a"))
    blank = box.filter("x0 IS NULL").selectExpr(
        "image_id", *[f"0 AS {v}" for v in ("x", "y", "r", "g", "b", "a")])
    return kept.unionByName(blank)


_SHIFT = {"left": "0", "top": "0", "center": "CAST(FLOOR({slack} / 2) AS INT)", "right": "{slack}", "bottom": "{slack}"}


def integer_crop(px: DataFrame, target_width: int, target_height: int,
                 horizontal: str = "center", vertical: str = "center",
                 sizes: DataFrame | None = None) -> DataFrame:
    """Keep the largest area divisible by the target size.

    Images smaller than the target have no block to crop to and are left out;
    ``crop_rejects`` lists them.
    """
    require(target_width >= 1 and target_height >= 1, "target size must be positive")
    require(horizontal in ("left", "center", "right"), "horizontal alignment is left, center or right")
    require(vertical in ("top", "center", "bottom"), "vertical alignment is top, center or bottom")
    plan = (sizes if sizes is not None else image_sizes(px)).filter(
        (F.col("width") >= target_width) & (F.col("height") >= target_height))
    plan = plan.selectExpr(
        "image_id", f"width - width % {target_width} AS cw", f"height - height % {target_height} AS ch",
        f"{_SHIFT[horizontal].format(slack=f'(width % {target_width})')} AS cx",
        f"{_SHIFT[vertical].format(slack=f'(height % {target_height})')} AS cy")
    return (attach_per_image(px, plan).filter("x >= cx AND x < cx + cw AND y >= cy AND y < cy + ch")
            .selectExpr("image_id", "x - cx AS x", "y - cy AS y", "r", "g", "b", "a"))


def crop_rejects(px: DataFrame, target_width: int, target_height: int) -> DataFrame:
    return image_sizes(px).filter((F.col("width") < target_width) | (F.col("height") < target_height))


def detect_background(px: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Background colour of every image, judged by its border pixels only.

    NULL when at least half of the border is mostly transparent.  Otherwise the
    most frequent bucket of 4 bits per channel wins and its first border pixel
    is the colour.
    """
    border = with_sizes(px, sizes).filter("x = 0 OR y = 0 OR x = width - 1 OR y = height - 1")
    # Border walk: both horizontal edges interleaved from the left, then both vertical ones.
    walk = F.expr("CASE WHEN y = 0 THEN 2 * x WHEN y = height - 1 THEN 2 * x + 1 "
                  "ELSE 2 * width + 2 * (y - 1) + CASE WHEN x = 0 THEN 0 ELSE 1 END END")
    border = with_rgb(border).withColumn("walk", walk.cast("bigint")).withColumn(
        "bucket", F.expr("CASE WHEN a >= 128 THEN CAST(FLOOR(r / 16) * 256 + FLOOR(g / 16) * 16 "
                         "+ FLOOR(b / 16) AS INT) END"))
    buckets = border.groupBy("image_id", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("walk").alias("first_walk"),
        F.min_by("rgb", "walk").alias("rgb"))
    best = F.max_by(F.when(F.col("bucket").isNotNull(), F.col("rgb")),
                    F.when(F.col("bucket").isNotNull(), F.struct("n", (-F.col("first_walk")).alias("w"))))
    clear = F.sum(F.when(F.col("bucket").isNull(), F.col("n")).otherwise(0))
    return (buckets.groupBy("image_id").agg(best.alias("candidate"), clear.alias("clear"),
                                            F.sum("n").alias("border"))
            .select("image_id", F.when(F.col("clear") * 2 < F.col("border"), F.col("candidate"))
                    .alias("background")))


def background_delta(tolerance: float) -> int:
    require(0 <= tolerance <= 100, "background tolerance must be 0..100")
    return round(tolerance * 255 / 100)


def near_background(delta: int) -> Column:
    """Every channel within ``delta`` of the packed ``background`` column."""
    parts = [f"abs({v} - {c.channel('background', i)}) <= {delta}" for v, i in (("r", 2), ("g", 1), ("b", 0))]
    return F.expr("background IS NOT NULL AND " + " AND ".join(parts))


def with_background(px: DataFrame, color: int | None) -> DataFrame:
    if color is not None:
        return px.withColumn("background", F.lit(color))
    return attach_per_image(px, detect_background(px), "left")


def remove_background_global(px: DataFrame, tolerance: float, color: int | None = None) -> DataFrame:
    """Alpha 0 wherever the colour is within the tolerance of the background."""
    hit = near_background(background_delta(tolerance))
    return (with_background(px, color)
            .withColumn("a", F.when(hit, F.lit(0)).otherwise(F.col("a"))).select(*PIXEL))


def edge_band(original: DataFrame, processed: DataFrame, band: int, tile: int) -> DataFrame:
    """Processed pixels near the tile edge, original pixels inside."""
    require(band >= 1 and tile >= 1, "band and tile must be positive")
    near = F.expr(f"x % {tile} < {band} OR x % {tile} >= {tile - band} OR "
                  f"y % {tile} < {band} OR y % {tile} >= {tile - band}")
    if tile <= band * 2:
        near = F.lit(True)
    inside = original.filter(~near)
    return inside.select(*PIXEL).unionByName(processed.filter(near).select(*PIXEL))


def grid_preview(px: DataFrame, step_x: int, step_y: int, off_x: int = 0, off_y: int = 0,
                 color: int = 0x00C8FF, alpha: int = 190) -> DataFrame:
    """Draw translucent grid lines over a copy."""
    require(1 <= step_x <= 2048 and 1 <= step_y <= 2048, "grid steps must be 1..2048")
    require(0 <= off_x < step_x and 0 <= off_y < step_y, "grid offsets must lie inside a step")
    on = f"(pmod(x - {off_x}, {step_x}) = 0 AND x >= {off_x} OR pmod(y - {off_y}, {step_y}) = 0 AND y >= {off_y})"
    line = (color >> 16, color >> 8 & 255, color & 255)
    out = {v: c.over_channel(str(line[i]), str(alpha), v, "a") for i, v in enumerate("rgb")}
    out["a"] = c.over_alpha(str(alpha), "a")
    return px.select("image_id", "x", "y", *[
        F.expr(f"CASE WHEN {on} THEN {out[v]} ELSE {v} END").alias(v) for v in "rgba"])


# --- per-pixel colour changes ----------------------------------------------------

def replace_color(px: DataFrame, source: int, target: int) -> DataFrame:
    """Swap one exact visible colour; alpha is kept."""
    hit = f"(a > 0 AND {c.pack_rgb()} = {source})"
    parts = {"r": target >> 16, "g": target >> 8 & 255, "b": target & 255}
    return px.select("image_id", "x", "y", *[
        F.expr(f"CASE WHEN {hit} THEN {parts[v]} ELSE {v} END").alias(v) for v in "rgb"], "a")


def adjust_channel(px: DataFrame, channel: str, mode: str, amount: float, subtract: bool = False) -> DataFrame:
    """Shift one of r, g, b, a by a value or percentage; hidden colours change too."""
    require(channel in ("r", "g", "b", "a"), "channel must be r, g, b or a")
    limit = {"value": 255, "percent": 100}
    require(mode in limit, "mode must be value or percent")
    require(0 <= amount <= limit[mode], f"{mode} amount must be 0..{limit.get(mode)}")
    return px.select(*[F.expr(c.adjust_channel(v, mode, amount, subtract)).alias(v) if v == channel
                       else F.col(v) for v in PIXEL])


def monochrome(px: DataFrame) -> DataFrame:
    gray = f"CASE WHEN a > 0 THEN {c.monochrome()} ELSE {{v}} END"
    return px.select("image_id", "x", "y", *[F.expr(gray.format(v=v)).alias(v) for v in "rgb"], "a")


def round_colors(px: DataFrame, step: int) -> DataFrame:
    require(1 <= step <= 255, "step must be 1..255")
    return px.select("image_id", "x", "y", *[F.expr(c.round_to_step(v, step)).alias(v) for v in "rgb"], "a")


# --- colour statistics -------------------------------------------------------------

def color_histogram(px: DataFrame) -> DataFrame:
    return with_rgb(visible(px)).groupBy("image_id", "rgb").agg(F.count(F.lit(1)).alias("n"))


def color_count(px: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct visible colours of every image, exactly or from sketches."""
    if approx:
        return sketched_count(color_sketches(px), "image_id")
    return px.groupBy("image_id").agg(F.countDistinct(F.when(F.col("a") > 0, F.expr(c.pack_rgb()))).alias("n_colors"))


def color_sketches(px: DataFrame, precision: int = 14) -> DataFrame:
    """``(image_id, colors)``: a sketch of each image's visible colours, some kilobytes whatever their number.

    Sketches can be stored and united over any groups of images; with 2^precision registers the usual
    error is 1.04 / sqrt(2^precision).
    """
    return px.groupBy("image_id").agg(F.hll_sketch_agg(F.when(F.col("a") > 0, F.expr(c.pack_rgb())), precision).alias("colors"))


def sketched_count(sketches: DataFrame, *group: str) -> DataFrame:
    """Colours of each group of images, or of all, from their sketches."""
    united = sketches.groupBy(*group).agg(F.hll_union_agg("colors").alias("colors"))
    return united.select(*group, F.hll_sketch_estimate("colors").alias("n_colors"))


def palette(px: DataFrame, limit: int = PALETTE_LIMIT) -> DataFrame:
    """One row per distinct colour, ranked by first appearance; ``over_limit`` only marks large palettes."""
    first = with_rgb(visible(px)).groupBy("image_id", "rgb").agg(F.min(scan_order()).alias("seen"))
    counts = first.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_colors"))
    head = Window.partitionBy("image_id").orderBy("seen")
    ranked = first.withColumn("rank", F.row_number().over(head))
    return attach_unique(ranked, counts, ["image_id"], ["rgb"]).select(
        "image_id", "rank", "rgb", "n_colors", (F.col("n_colors") > limit).alias("over_limit"))


def palette_info(px: DataFrame, limit: int = PALETTE_LIMIT) -> DataFrame:
    """One report row per image: size, alpha classes, grey flag, colour counts."""
    shown = F.col("a") > 0
    rgb = F.when(shown, F.expr(c.pack_rgb()))
    report = px.groupBy("image_id").agg(
        (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"),
        F.count(F.lit(1)).alias("pixel_count"),
        F.count_if(F.col("a") == 0).alias("transparent"),
        F.count_if((F.col("a") > 0) & (F.col("a") < 255)).alias("translucent"),
        F.count_if(F.col("a") == 255).alias("opaque"),
        F.coalesce(F.bool_and(F.when(shown, F.expr("r = g AND g = b"))), F.lit(True)).alias("grayscale"),
        F.countDistinct(rgb).alias("n_colors"))
    return report.withColumn("aspect_ratio", F.expr("CAST(width AS DOUBLE) / height")).withColumn(
        "grouped_colors", F.greatest(F.lit(0), F.col("n_colors") - limit))


def top_colors(px: DataFrame, k: int) -> DataFrame:
    """The k most frequent colours of every image; Spark prunes to k before the shuffle."""
    require(k >= 1, "k must be positive")
    rank = Window.partitionBy("image_id").orderBy(F.desc("n"), F.asc("rgb"))
    return (color_histogram(px).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k))


def color_treemap(px: DataFrame, k: int = PALETTE_LIMIT) -> DataFrame:
    """Areas of the k most frequent colours plus one NULL row for the rest."""
    top = top_colors(px, k).select("image_id", "rgb", "n")
    total = visible(px).groupBy("image_id").agg(F.count(F.lit(1)).alias("total"))
    listed = top.groupBy("image_id").agg(F.sum("n").alias("listed"))
    rest = (total.join(listed, "image_id").filter("total > listed")
            .select("image_id", F.lit(None).cast("int").alias("rgb"),
                    (F.col("total") - F.col("listed")).alias("n")))
    return top.unionByName(rest)


def dominant_color(px: DataFrame) -> DataFrame:
    """Most frequent visible ARGB; equal counts go to the smaller signed value."""
    counts = (visible(px).withColumn("argb", F.expr(c.pack_argb()))
              .groupBy("image_id", "argb").agg(F.count(F.lit(1)).alias("n")))
    best = F.max_by(F.struct("argb", "n"), F.struct("n", F.expr(f"-{c.signed_argb()}").alias("t")))
    return counts.groupBy("image_id").agg(best.alias("v")).select("image_id", "v.argb", "v.n")


def transparent_flag(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg(F.bool_or(F.col("a") < 255).alias("has_transparency"))


def palette_overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """Shared and one-sided colour counts of two versions of every image."""
    def side(px, name):
        return with_rgb(visible(px)).select("image_id", "rgb").distinct().withColumn(name, F.lit(1))
    both = side(first, "l").join(side(second, "r"), ["image_id", "rgb"], "full")
    left, right = F.col("l").isNotNull(), F.col("r").isNotNull()
    return both.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_union"), F.count_if(left & right).alias("n_common"),
        F.count_if(left & ~right).alias("n_only_first"), F.count_if(~left & right).alias("n_only_second"))


def invented_colors(before: DataFrame, after: DataFrame) -> DataFrame:
    """Colours (with alpha) the output has and the input lacks."""
    def colors(px):
        return px.select("image_id", F.expr(c.canonical_argb()).alias("argb"))
    return colors(after).subtract(colors(before))


# --- tiles ---------------------------------------------------------------------------

def tile_layout(images: DataFrame, tile_w: int, tile_h: int, margin: int = 0, spacing: int = 0) -> DataFrame:
    """Grid of every image with ``ok`` telling whether it covers the image exactly."""
    require(tile_w > 0 and tile_h > 0 and margin >= 0 and spacing >= 0,
            "tile size must be positive, margin and spacing not negative")
    fit = images.selectExpr(
        "image_id", "width", "height", f"width - 2 * {margin} + {spacing} AS uw",
        f"height - 2 * {margin} + {spacing} AS uh")
    return fit.selectExpr(
        "image_id", "width", "height",
        f"CAST(FLOOR(uw / {tile_w + spacing}) AS INT) AS tile_cols",
        f"CAST(FLOOR(uh / {tile_h + spacing}) AS INT) AS tile_rows",
        f"uw > {spacing} AND uh > {spacing} AND uw % {tile_w + spacing} = 0 AND uh % {tile_h + spacing} = 0 "
        f"AND FLOOR(uw / {tile_w + spacing}) * FLOOR(uh / {tile_h + spacing}) >= 1 AS ok")


def slice_tiles(px: DataFrame, tile_w: int, tile_h: int, margin: int = 0, spacing: int = 0,
                sizes: DataFrame | None = None) -> DataFrame:
    """Pixels keyed by tile; images the grid does not cover exactly are left out."""
    grid = tile_layout(sizes if sizes is not None else image_sizes(px), tile_w, tile_h, margin, spacing)
    placed = attach_per_image(px, grid.filter("ok").select("image_id", "tile_cols", "tile_rows"))
    sx, sy = tile_w + spacing, tile_h + spacing
    return (placed.selectExpr(
        "image_id", f"CAST(FLOOR((x - {margin}) / {sx}) AS INT) AS tile_col",
        f"CAST(FLOOR((y - {margin}) / {sy}) AS INT) AS tile_row",
        f"pmod(x - {margin}, {sx}) AS tx", f"pmod(y - {margin}, {sy}) AS ty",
        "r", "g", "b", "a", "tile_cols", "tile_rows")
        .filter(f"tile_col BETWEEN 0 AND tile_cols - 1 AND tile_row BETWEEN 0 AND tile_rows - 1 "
                f"AND tx < {tile_w} AND ty < {tile_h}")
        .drop("tile_cols", "tile_rows"))


# --- dense buffers ---------------------------------------------------------------------

def assemble_images(px: DataFrame, band_pixels: int = 65536) -> DataFrame:
    """Dense row-major buffers, in bands of whole rows of about ``band_pixels`` pixels.

    A small image is one band.  Bands bound what any task holds, however large
    one image is; concatenated in ``band`` order they are the image.
    """
    sized = with_sizes(px).withColumn(
        "band_rows", F.expr(f"GREATEST(1, CAST(FLOOR({band_pixels} / width) AS INT))"))
    sized = sized.withColumn("band", F.expr("CAST(FLOOR(y / band_rows) AS INT)"))
    q = F.expr("CAST(y AS BIGINT) * width + x")
    packed = F.struct(q.alias("q"), F.expr(c.pack_argb()).alias("argb"))
    return (sized.groupBy("image_id", "band").agg(
        F.first("width").alias("width"), F.first("height").alias("height"),
        F.sort_array(F.collect_list(packed)).alias("cells"))
        .select("image_id", "band", "width", "height", F.expr("transform(cells, v -> v.argb)").alias("data")))
