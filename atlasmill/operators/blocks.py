"""Resampling and block reductions.  Target coordinates are computed from each
source pixel, so resizing needs no grid table and no join beyond image sizes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasmill.functions import color as c
from atlasmill.operators.palette import apply_colors, nearest_palette, quantize
from atlasmill.operators.pixels import PIXEL, dominant_color, image_sizes, integer_crop, scan_order, with_sizes
from atlasmill.operators.stencil import edge_map, sprite_edges
from atlasmill.runtime import attach_per_image, cut_lineage, require, stored


def _argb_pixel(frame: DataFrame, *keys: str) -> DataFrame:
    """Unpack an ``argb`` column; NULL becomes an empty pixel."""
    value = "coalesce(argb, CAST(0 AS BIGINT))"
    return frame.select(*keys, *[F.expr(c.channel(value, i)).alias(v)
                                 for v, i in (("r", 2), ("g", 1), ("b", 0), ("a", 3))])


def _nearest_targets(axis: str, size: str, target: int | str) -> str:
    first = f"CAST(CEIL(CAST({axis} AS DOUBLE) * {target} / {size}) AS INT)"
    last = f"CAST(CEIL(CAST({axis} + 1 AS DOUBLE) * {target} / {size}) AS INT) - 1"
    return f"filter(sequence(GREATEST({first} - 1, 0), LEAST({last} + 1, {target} - 1)), " \
           f"t -> CAST(FLOOR(CAST(t AS BIGINT) * {size} / CAST({target} AS DOUBLE)) AS INT) = {axis})"


def resample_nearest(px: DataFrame, width: int, height: int, sizes: DataFrame | None = None) -> DataFrame:
    """Nearest resize by truncating integer coordinates.

    Source pixel ``x`` covers the targets ``t`` with ``t * w div width = x``,
    a range known from the pixel itself.
    """
    require(width >= 1 and height >= 1, "target size must be positive")
    placed = with_sizes(px, sizes)

    rows = placed.withColumn("tx", F.explode(F.expr(_nearest_targets("x", "width", width))))
    rows = rows.withColumn("ty", F.explode(F.expr(_nearest_targets("y", "height", height))))
    return rows.select("image_id", F.col("tx").alias("x"), F.col("ty").alias("y"), "r", "g", "b", "a")


def resolve_resize(images: DataFrame, factor: float) -> DataFrame:
    """Target size for a relative resize: halves round away from zero, at least one pixel."""
    require(factor > 0, "factor must be positive")
    return images.select("*", *[F.expr(
        f"CAST(GREATEST(1, ROUND({n} * {c.num(factor)}, 0)) AS INT)").alias(f"target_{n}") for n in ("width", "height")])


def overlap_blocks(px: DataFrame, width: int, height: int, sizes: DataFrame | None = None) -> DataFrame:
    """Every pixel with the target blocks it overlaps and the overlapping ``area``.

    A pixel reaches at most the blocks its own unit square touches, so the
    overlap join is a computed range, not a comparison of pixels with blocks.
    """
    require(width >= 1 and height >= 1, "target size must be positive")
    return _overlaps(with_sizes(px, sizes), width, height)


def _overlaps(placed: DataFrame, width: int | str, height: int | str) -> DataFrame:
    for axis, size, target in (("x", "width", width), ("y", "height", height)):
        first = f"CAST(FLOOR(CAST({axis} AS DOUBLE) * {target} / {size}) AS INT)"
        last = f"CAST(CEIL(CAST({axis} + 1 AS DOUBLE) * {target} / {size}) AS INT) - 1"
        placed = placed.withColumn(f"b{axis}", F.explode(F.expr(
            f"sequence(GREATEST({first}, 0), LEAST(GREATEST({last}, {first}), {target} - 1))")))
        low, high = f"b{axis} * CAST({size} AS DOUBLE) / {target}", f"(b{axis} + 1) * CAST({size} AS DOUBLE) / {target}"
        placed = placed.withColumn(f"len_{axis}", F.expr(f"LEAST({axis} + 1, {high}) - GREATEST({axis}, {low})"))
        placed = placed.withColumn(f"size_{axis}", F.expr(f"{high} - {low}"))
    return (placed.filter("len_x > 1E-12 AND len_y > 1E-12")
            .withColumn("area", F.col("len_x") * F.col("len_y"))
            .withColumn("block_area", F.col("size_x") * F.col("size_y"))
            .drop("len_x", "len_y", "size_x", "size_y", "width", "height"))



def pick_automatic(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Most important colour per block: count x contrast x saturation x edge.

    Equal importance goes to the colour met first.  Two aggregations: per
    (block, colour), then per block.
    """
    colors = rows.groupBy(*keys, "argb").agg(
        F.count(F.lit(1)).alias("n"), F.avg("edge").alias("edge"), F.min(scan_order()).alias("seen"))
    rgb = c.unpack_rgb("argb")
    weight = f"n * {c.contrast_weight(*rgb)} * {c.saturation_weight(*rgb)} * GREATEST(edge, 5E-2)"
    ranked = F.struct(F.expr(c.tie(weight)).alias("w"), (-F.col("seen.y")).alias("y"), (-F.col("seen.x")).alias("x"))
    return colors.groupBy(*keys).agg(F.max_by("argb", ranked).alias("argb"))


CRITERIA = ("brightness", "contrast", "saturation", "edge")


def pick_manual(rows: DataFrame, keys: list[str], targets: dict[str, float], importance: dict[str, float]) -> DataFrame:
    """Colour nearest the wanted features; near ties go to the more frequent, then the first."""
    for group in (targets, importance):
        require(set(group) <= set(CRITERIA) and all(0 <= v <= 1 for v in group.values()),
                "criteria are brightness, contrast, saturation and edge within 0..1")
    rgb = c.unpack_rgb("argb")
    features = dict(zip(CRITERIA, (c.brightness(*rgb), c.contrast_weight(*rgb), c.saturation_weight(*rgb), "edge")))
    cost = " + ".join(f"{c.num(importance.get(n, 0))} * abs({e} - {c.num(targets.get(n, 0))})" for n, e in features.items())
    best = F.struct(F.expr(c.tie(cost)).alias("d"), "y", "x")
    colors = rows.groupBy(*keys, "argb").agg(F.count(F.lit(1)).alias("n"), F.min(best).alias("best"))
    order = F.struct(F.col("best.d"), (-F.col("n")).alias("n"), F.col("best.y"), F.col("best.x"))
    return colors.groupBy(*keys).agg(F.min_by("argb", order).alias("argb"))


def _pick(rows: DataFrame, keys: list[str], manual: tuple[dict, dict] | None) -> DataFrame:
    return pick_manual(rows, keys, *manual) if manual else pick_automatic(rows, keys)


def block_representative(px: DataFrame, bw: int, bh: int, manual: tuple[dict, dict] | None = None) -> DataFrame:
    """One pixel per ``bw x bh`` block; blocks less than half visible become empty."""
    require(bw >= 1 and bh >= 1, "block size must be positive")
    edged = edge_map(px)
    keys = ["image_id", "bx", "by"]
    cells = edged.selectExpr("*", f"CAST(FLOOR(x / {bw}) AS INT) AS bx", f"CAST(FLOOR(y / {bh}) AS INT) AS by",
                             f"{c.pack_argb()} AS argb")
    chosen = _pick(cells.filter("a > 0"), keys, manual)
    blocks = cells.groupBy(*keys).agg(F.count_if(F.col("a") > 0).alias("shown"))
    out = blocks.join(chosen, keys, "left").withColumn(
        "argb", F.when(F.col("shown") * 2 >= bw * bh, F.col("argb")))
    return _argb_pixel(out, "image_id", F.col("bx").alias("x"), F.col("by").alias("y"))


def resize(px: DataFrame, targets: DataFrame, sprite: bool = False, alpha_threshold: int = 50,
           manual: tuple[dict, dict] | None = None, horizontal: str = "center", vertical: str = "center") -> DataFrame:
    """Resize every image to its own size in ``targets(image_id, width, height, target_width, target_height)``.

    An image that has its target size stays, one that grows in any direction takes nearest pixels,
    and any other gets one of its own colours per block, as in ``scale_down``.
    """
    require(1 <= alpha_threshold <= 100, "alpha threshold must be 1..100")
    grows = "(target_width > width OR target_height > height)"
    same = "(target_width = width AND target_height = height)"
    placed = attach_per_image(px, targets)
    kept = placed.filter(same).select("image_id", "x", "y", "r", "g", "b", "a")
    near = placed.filter(f"{grows} AND NOT {same}")
    for axis, size in (("x", "width"), ("y", "height")):
        near = near.withColumn(f"t{axis}", F.explode(F.expr(_nearest_targets(axis, size, f"target_{size}"))))
    near = near.select("image_id", F.col("tx").alias("x"), F.col("ty").alias("y"), "r", "g", "b", "a")
    small = placed.filter(f"NOT {grows} AND NOT {same}")
    if not sprite:
        for axis, size, where in (("x", "width", horizontal), ("y", "height", vertical)):
            slack = f"({size} % target_{size})"
            shift = {"left": "0", "top": "0", "center": f"CAST(FLOOR({slack} / 2) AS INT)"}.get(where, slack)
            small = small.withColumn("_shift", F.expr(shift)).withColumn("_size", F.expr(f"{size} - {slack}"))
            small = small.filter(f"{axis} >= _shift AND {axis} < _shift + _size").withColumn(axis, F.expr(f"{axis} - _shift")).withColumn(size, F.col("_size"))
        small = small.drop("_shift", "_size")
    blocks = _pick_blocks(_overlaps(small.withColumn("edge", F.lit(0.0)), "target_width", "target_height").drop("target_width", "target_height"),
                          alpha_threshold / 100 if sprite else 0.5, manual)
    return kept.unionByName(near).unionByName(blocks)


def scale_down(px: DataFrame, width: int, height: int, sprite: bool = True, alpha_threshold: int = 50,
               manual: tuple[dict, dict] | None = None, horizontal: str = "center", vertical: str = "center",
               edges: DataFrame | None = None) -> DataFrame:
    """Resize by choosing one existing colour per block.

    Sprite mode uses fractional blocks over the whole canvas and a coverage
    threshold in percent; otherwise the image is cropped to whole blocks and
    half coverage is needed.
    """
    require(1 <= alpha_threshold <= 100, "alpha threshold must be 1..100")
    source = px if sprite else integer_crop(px, width, height, horizontal, vertical)
    if edges is None:
        edged = source.withColumn("edge", F.lit(0.0))
        sizes = image_sizes(source)
    else:
        edged, sizes = edges, image_sizes(px)
    return _pick_blocks(overlap_blocks(edged, width, height, sizes), alpha_threshold / 100 if sprite else 0.5, manual)


def _pick_blocks(cells: DataFrame, threshold: float, manual: tuple[dict, dict] | None) -> DataFrame:
    keys = ["image_id", "bx", "by"]
    cells = cells.withColumn("argb", F.expr(c.pack_argb()))
    blocks = cells.groupBy(*keys).agg(
        F.sum(F.when(F.col("a") > 0, F.col("area")).otherwise(0.0)).alias("covered"),
        F.first("block_area").alias("block_area"))
    chosen = _pick(cells.filter("a > 0"), keys, manual)
    full = F.col("covered") + 1e-9 >= F.col("block_area") * threshold
    out = blocks.join(chosen, keys, "left").withColumn("argb", F.when(full, F.col("argb")))
    return _argb_pixel(out, "image_id", F.col("bx").alias("x"), F.col("by").alias("y"))


def sprite_downscale(px: DataFrame, width: int, height: int, palette: Sequence[int] | None = None,
                     colors: int | None = None, method: str = "kmeans_lab", weighted: bool = False,
                     alpha_threshold: int = 50, step: int | None = None) -> DataFrame:
    """Whole-canvas sprite reduction: quantise, weigh edges, pick block colours, snap to a palette."""
    source = quantize(px, colors, method, weighted) if colors else px
    small = scale_down(source, width, height, True, alpha_threshold, edges=sprite_edges(source))
    return apply_colors(small, "palette", palette, step)


def profile_downscale(px: DataFrame, width: int, height: int, palette: Sequence[int] | None = None,
                      colors: int | None = None, method: str = "kmeans_lab", weighted: bool = False,
                      step: int | None = None, horizontal: str = "center", vertical: str = "center",
                      manual: tuple[dict, dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """Crop, quantise, reduce to whole blocks, snap; returns pixels and the dominant colours."""
    cropped = integer_crop(px, width, height, horizontal, vertical)
    source = quantize(cropped, colors, method, weighted) if colors else cropped
    edged = edge_map(source)
    keys = ["image_id", "bx", "by"]
    cells = overlap_blocks(edged, width, height, image_sizes(source)).withColumn("argb", F.expr(c.pack_argb()))
    blocks = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") > 0).alias("shown"))
    chosen = _pick(cells.filter("a > 0"), keys, manual)
    out = blocks.join(chosen, keys, "left").withColumn("argb", F.when(F.expr("shown * 2 >= n"), F.col("argb")))
    small = _argb_pixel(out, "image_id", F.col("bx").alias("x"), F.col("by").alias("y"))
    snapped = apply_colors(small, "palette", palette, step)
    return snapped, dominant_color(snapped)


def finalist_reduce(px: DataFrame, mode: str, factor: int, sizes: DataFrame | None = None) -> DataFrame:
    """Alpha-weighted integer means per cell.

    ``t3`` uses cells shifted by half a factor, ``p5`` aligned cells (a cell whose
    alpha rounds to 0 loses its colour) and ``mixed`` blends both.  Sums are
    BIGINT, so results do not depend on the order of rows.
    """
    require(mode in ("t3", "p5", "mixed"), "mode must be t3, p5 or mixed")
    require(2 <= factor <= 64, "factor must be 2..64")
    placed = with_sizes(px, sizes)

    def reduce(phase, zero):
        def cell(axis, size):
            count = f"(1 + CAST(FLOOR(({size} - 1) / {factor}) AS INT))"
            regular = f"CAST(FLOOR(({axis} - {phase}) / CAST({factor} AS DOUBLE)) AS INT)"
            return f"LEAST({count} - 1, GREATEST(0, {regular}, {axis} - ({size} - {count})))"
        cells = placed.selectExpr("image_id", f"{cell('x', 'width')} AS cx", f"{cell('y', 'height')} AS cy",
                                  "CAST(a AS BIGINT) AS a", *[f"CAST(a AS BIGINT) * {v} AS {v}" for v in "rgb"])
        sums = cells.groupBy("image_id", "cx", "cy").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(v) for v in "rgba"])
        sums = sums.withColumn("oa", F.expr("(2 * a + n) DIV (2 * n)"))
        blank = "a = 0 OR oa = 0" if zero else "a = 0"
        return sums.select("image_id", F.col("cx").alias("x"), F.col("cy").alias("y"), *[F.expr(
            f"CASE WHEN {blank} THEN 0 ELSE CAST((2 * {v} + a) DIV (2 * a) AS INT) END").alias(v) for v in "rgb"],
            F.col("oa").cast("int").alias("a"))
    if mode == "t3":
        return reduce(factor // 2, False)
    if mode == "p5":
        return reduce(0, True)
    first, second = reduce(factor // 2, False), reduce(0, True)
    second = second.select("image_id", "x", "y", *[F.col(v).alias(f"{v}2") for v in "rgba"])
    return first.join(second, ["image_id", "x", "y"]).select(
        "image_id", "x", "y", *[F.expr(c.finalist_channel(v, "a", f"{v}2", "a2")).alias(v) for v in "rgb"],
        F.expr(c.finalist_alpha("a", "a2")).alias("a"))


def _grid_cells(px: DataFrame, pitch: int | str) -> DataFrame:
    """``pitch`` may name a column."""
    require(isinstance(pitch, str) or pitch >= 2, "pitch must be at least 2")
    cells = px.selectExpr("*", f"CAST(FLOOR(x / {pitch}) AS INT) AS cx", f"CAST(FLOOR(y / {pitch}) AS INT) AS cy",
                          f"{c.canonical_argb()} AS canon")
    return cells.groupBy("image_id", "cx", "cy").agg(
        F.min("canon").alias("low"), F.max("canon").alias("high"),
        F.min_by(F.struct("r", "g", "b", "a"), scan_order()).alias("anchor"))


def grid_is_aligned(px: DataFrame, pitch: int) -> DataFrame:
    """Whether every cell of an image shows one colour (hidden colours ignored)."""
    return _grid_cells(px, pitch).groupBy("image_id").agg(
        F.bool_and(F.col("low") == F.col("high")).alias("aligned"),
        F.count_if(F.col("low") != F.col("high")).alias("mixed_cells"))


def grid_mixed(px: DataFrame, pitch: int | str) -> DataFrame:
    """Ids of the images that ``grid_reduce`` leaves out."""
    return _grid_cells(px, pitch).filter("low <> high").select("image_id").distinct()


def grid_reduce(px: DataFrame, pitch: int | str) -> DataFrame:
    """One pixel per cell of aligned images; images with a mixed cell are left out, see ``grid_mixed``."""
    cells = _grid_cells(px, pitch)
    mixed = cells.filter("low <> high").select("image_id").distinct()
    return cells.join(mixed, "image_id", "left_anti").select(
        "image_id", F.col("cx").alias("x"), F.col("cy").alias("y"), "anchor.r", "anchor.g", "anchor.b", "anchor.a")


def _sampled(at: pd.Series, full: pd.Series, target: pd.Series, start: pd.Series, extent: pd.Series) -> pd.DataFrame:
    """First and last target pixel that samples the source position; their samples never go back."""
    at, full, target, start, extent = (v.to_numpy(dtype=float) for v in (at, full, target, start, extent))

    def begin(value):  # the first target at or beyond a source position, looked up beside the computed place
        guess = np.ceil((value - start) * target / extent - 0.5)
        found = guess + 1
        for t in (guess, guess - 1):
            found = np.where(np.floor(start + (t + 0.5) * extent / target) >= value, t, found)
        return found

    last = np.where(at == full - 1, target - 1, np.minimum(target - 1, begin(at + 1) - 1))
    return pd.DataFrame({"first": np.maximum(0, begin(at)).astype(np.int32), "last": last.astype(np.int32)})


def fit_frames(px: DataFrame, sizes: Sequence[int], fit: str = "contain",
               images: DataFrame | None = None) -> DataFrame:
    """Square icon frames by nearest sampling: contain, cover or stretch.

    Each source pixel finds the frame pixels whose centre falls into it: they follow one another, so
    only the first and the last are looked up.
    """
    require(fit in ("contain", "cover", "stretch"), "fit must be contain, cover or stretch")
    require(all(1 <= n <= 1024 for n in sizes), "icon sizes must be 1..1024")
    if images is None:
        px = stored(px)  # read for the sizes and for the pixels
        images = cut_lineage(image_sizes(px))
    frames = images.withColumn("size", F.explode(F.array(*[F.lit(n) for n in sizes])))
    scaled = {n: f"CAST(LEAST(size, GREATEST(1, ROUND({n} * (size / CAST(GREATEST(width, height) AS DOUBLE)), 0))) AS INT)"
              for n in ("width", "height")}
    for axis, full in (("x", "width"), ("y", "height")):
        side = "LEAST(width, height)"
        if fit == "contain":
            target, offset, start, extent = scaled[full], f"CAST(FLOOR((size - {scaled[full]}) / 2) AS INT)", "0E0", full
        elif fit == "cover":
            target, offset, start, extent = "size", "0", f"({full} - {side}) / 2E0", side
        else:
            target, offset, start, extent = "size", "0", "0E0", full
        frames = frames.selectExpr("*", f"{target} AS t_{axis}", f"{offset} AS o_{axis}",
                                   f"CAST({start} AS DOUBLE) AS s_{axis}", f"CAST({extent} AS DOUBLE) AS e_{axis}")
    sampled = F.pandas_udf(_sampled, "first INT, last INT")
    spans = {axis: sampled(axis, full, f"t_{axis}", f"s_{axis}", f"e_{axis}") for axis, full in (("x", "width"), ("y", "height"))}
    placed = attach_per_image(px, frames).withColumns({f"_{axis}": span for axis, span in spans.items()})
    placed = placed.filter("_x.first <= _x.last AND _y.first <= _y.last")
    for axis in "xy":
        placed = placed.withColumn(f"p_{axis}", F.explode(F.expr(f"sequence(_{axis}.first, _{axis}.last)")))
    return placed.selectExpr("image_id", "size", "o_x + p_x AS x", "o_y + p_y AS y", "r", "g", "b", "a")


def ascii_text(px: DataFrame, columns: int | None, rows: int | None, ramp: str = "@%#*+=-:. ", invert: bool = False,
               dither: bool = False, sizes: DataFrame | None = None, cell: tuple[int, int] = (1, 2)) -> DataFrame:
    """Text picture per image: mean brightness of a cell picks a ramp character.

    ``cell`` is the width and height of a character. Without ``columns`` an image gets one per character
    width, at most 512; without ``rows`` as many as keep its proportions, half-even rounded and at least one.
    """
    require((columns is None or 1 <= columns <= 512) and (rows is None or rows >= 1), "columns must be 1..512 and rows positive")
    require(min(cell) >= 1, "a character has a positive size")
    require(bool(ramp) and "\n" not in ramp and "\r" not in ramp, "the ramp must be one non-empty line")
    placed = with_sizes(px, sizes)
    own = f"LEAST(512, width, GREATEST(1, CAST(bround(width / CAST({cell[0]} AS DOUBLE), 0) AS INT)))"
    placed = placed.withColumn("_columns", F.expr(own) if columns is None else F.lit(columns))
    shape = f"GREATEST(1, CAST(bround(height / CAST(width AS DOUBLE) * _columns * {cell[0]} / {cell[1]}, 0) AS INT))"
    placed = placed.withColumn("_rows", F.expr(shape) if rows is None else F.lit(rows))
    for axis, size, count in (("x", "width", "_columns"), ("y", "height", "_rows")):
        start = f"CAST(FLOOR(CAST(t AS BIGINT) * {size} / CAST({count} AS DOUBLE)) AS INT)"
        end = f"GREATEST({start} + 1, CAST(FLOOR(CAST(t + 1 AS BIGINT) * {size} / CAST({count} AS DOUBLE)) AS INT))"
        low = f"GREATEST(0, CAST(FLOOR(CAST({axis} AS DOUBLE) * {count} / {size}) AS INT) - 1)"
        high = f"LEAST({count} - 1, CAST(CEIL(CAST({axis} + 1 AS DOUBLE) * {count} / {size}) AS INT) + 1)"
        placed = placed.withColumn(f"c{axis}", F.explode(F.expr(
            f"filter(sequence({low}, {high}), t -> {axis} >= {start} AND {axis} < {end})")))
    light = f"(1E0 - {c.brightness()})" if invert else c.brightness()
    cells = placed.groupBy("image_id", "cy", "cx").agg(
        F.sum(F.expr(f"{light} * a / 255E0")).alias("lit"), F.sum(F.expr("a / 255E0")).alias("cover"))
    last = len(ramp) - 1
    tone = "(lit / cover)"
    if dither:
        tone = c.ordered_dither(tone, "cx", "cy", 1.0 / max(1, last))
    # The tone is rounded before the half-even step so summation order cannot tip a half.
    index = f"CAST(LEAST({last}, GREATEST(0, bround(round({tone} * {last}, 9), 0))) AS INT)"
    filler = " " if " " in ramp else ramp[-1]
    glyphs = F.array(*[F.lit(ch) for ch in ramp])
    cells = cells.withColumn("i", F.expr(f"CASE WHEN cover > 0 THEN {index} END"))
    cells = cells.withColumn("ch", F.coalesce(F.get(glyphs, F.col("i")), F.lit(filler)))
    lines = cells.groupBy("image_id", "cy").agg(F.expr("listagg(ch, '') WITHIN GROUP (ORDER BY cx)").alias("line"))
    return lines.groupBy("image_id").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY cy)").alias("text"))
