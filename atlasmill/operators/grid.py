"""Pixel-grid detection, voting and tile-size suggestions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atlasmill.functions import color as c
from atlasmill.operators.bands import along
from atlasmill.operators.pixels import PIXEL, image_sizes
from atlasmill.operators.stencil import suppress_speckles, transition_edges
from atlasmill.runtime import attach_per_image, bucketed_row_number, cut_lineage, require, stored

#: Positions of a profile in one block.
BLOCK = 2048


def projection_profiles(px: DataFrame, despeckle: bool = False) -> DataFrame:
    """Mean edge strength per column (axis x) and per row (axis y); position 0 is 0."""
    edges = transition_edges(suppress_speckles(px) if despeckle else px)
    sides = F.array(*[F.struct(F.lit(axis).alias("axis"), F.col(axis).alias("pos"), F.col(f"e{axis}").alias("v")) for axis in "xy"])
    both = edges.select("image_id", F.inline(sides)).groupBy("image_id", "axis", "pos").agg(F.avg("v").alias("v"))
    return both.select("image_id", "axis", "pos", F.when(F.col("pos") > 0, F.col("v")).otherwise(0.0).alias("v"))


def _pitch_scores(profiles: DataFrame, pitches: list[int]) -> DataFrame:
    """Phase sums, confidence and periodicity per image, axis and candidate pitch.

    Profiles are cut into blocks that overlap by the largest pitch. Each block gives its part of every sum,
    so an axis of any length costs bounded rows.
    """
    keys, most = ["image_id", "axis"], max(pitches)
    placed = bucketed_row_number(cut_lineage(profiles), keys, F.floor(F.col("pos") / BLOCK), ["pos"], "i").withColumn("i", F.col("i") - 1)
    stats = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.max("v").alias("peak")).filter("n > 1")
    own = F.floor(F.col("i") / BLOCK)
    home = F.array(own, F.when(F.pmod("i", F.lit(BLOCK)) >= BLOCK - most, own + 1))
    blocks = placed.select(*keys, "i", "v", F.explode(F.array_compact(home)).alias("block")).groupBy(*keys, "block").agg(
        F.sort_array(F.collect_list(F.struct("i", "v"))).alias("p"))
    blocks = attach_per_image(blocks, stats, keys=("image_id", "axis")).select(
        *keys, "mean", F.expr("transform(p, q -> q.v)").alias("v"), F.expr("p[0].i").alias("start"),
        F.expr(f"CAST(block * {BLOCK} - p[0].i AS INT)").alias("first"),
        F.expr("size(filter(slice(p, CAST(block * {0} - p[0].i AS INT) + 1, {0}), q -> q.v > peak * 3E-2))".format(BLOCK)).alias("edges"),
        F.explode(F.array(*map(F.lit, pitches))).alias("pitch"))
    blocks = blocks.filter("first < size(v)")  # a block of copies only has nothing of its own
    turn = c.num(2 * math.pi)
    sums = ("aggregate(sequence(first, size(v) - 1), named_struct('re', 0E0, 'im', 0E0, 's', 0E0), (t, j) -> "
            "CASE WHEN start + j = 0 THEN t ELSE named_struct("
            f"'re', t.re + v[j] * cos((start + j) * {turn} / pitch), 'im', t.im + v[j] * sin((start + j) * {turn} / pitch), 's', t.s + v[j]) END)")
    lag = ("aggregate(sequence(first, size(v) - 1), named_struct('c', 0E0, 'w', 0E0), (t, j) -> "
           "CASE WHEN start + j < pitch THEN t ELSE named_struct("
           "'c', t.c + (v[j] - mean) * (v[j - pitch] - mean), "
           "'w', t.w + (pow(v[j] - mean, 2) + pow(v[j - pitch] - mean, 2)) * 5E-1) END)")
    parts = blocks.withColumn("k", F.expr(sums)).withColumn("l", F.expr(lag)).groupBy(*keys, "pitch").agg(
        F.sum("edges").alias("edges"), *[F.sum(f"{x}").alias(x.replace(".", "_")) for x in ("k.re", "k.im", "k.s", "l.c", "l.w")])
    return parts.join(stats, keys).selectExpr(
        "image_id", "axis", "pitch", "n", "edges",
        "CASE WHEN k_s < 1E-10 THEN 0E0 ELSE sqrt(k_re * k_re + k_im * k_im) / k_s END AS confidence",
        "CASE WHEN l_w < 1E-10 THEN 0E0 ELSE l_c / l_w END AS periodicity",
        f"atan2(k_im, k_re) * pitch / {turn} AS raw_phase")


def phase(profiles: DataFrame, pitch: int) -> DataFrame:
    """Circular phase and its confidence per image and axis for a known pitch."""
    require(pitch >= 2, "pitch must be at least 2")
    found = _pitch_scores(profiles, [pitch])
    return found.selectExpr("image_id", "axis",
                            "CASE WHEN raw_phase < -pitch * 5E-1 + 1E-8 THEN raw_phase + pitch ELSE raw_phase END AS phase",
                            "confidence")


def detect_pitch(profiles: DataFrame, max_pitch: int = 32) -> DataFrame:
    """Cell size of every image; NULL where no grid is found.

    The largest pitch on which both axes have several edges in phase wins,
    otherwise the most periodic one (smaller on ties, at least 0.05).
    """
    require(2 <= max_pitch <= 256, "largest pitch must be 2..256")
    scores = _pitch_scores(profiles, list(range(2, max_pitch + 1)))
    both = scores.groupBy("image_id", "pitch").agg(
        F.min("n").alias("n"), F.min("edges").alias("edges"), F.count(F.lit(1)).alias("axes"),
        F.min("confidence").alias("confidence"), F.sum("periodicity").alias("periodicity"))
    both = both.filter((F.col("axes") == 2) & (F.col("pitch") <= F.floor(F.col("n") / 3)))
    both = both.withColumn("exact", F.expr("edges >= 4 AND round(confidence, 9) > 9.85E-1"))
    best = both.groupBy("image_id").agg(
        F.max_by(F.struct("pitch", "confidence"), F.when(F.col("exact"), F.col("pitch"))).alias("e"),
        F.max_by(F.struct("pitch", "periodicity"), F.struct(F.round("periodicity", 9).alias("s"),
                                                             (-F.col("pitch")).alias("p"))).alias("p"))
    found = F.expr("CASE WHEN e IS NOT NULL THEN e.pitch WHEN p.periodicity >= 5E-2 THEN p.pitch END")
    sure = F.expr("CASE WHEN e IS NOT NULL THEN e.confidence WHEN p.periodicity >= 5E-2 "
                  "THEN LEAST(1E0, GREATEST(0E0, p.periodicity / 2E0)) ELSE 0E0 END")
    return best.select("image_id", found.alias("pitch"), sure.alias("confidence"))


def _touched(at: pd.Series, size: pd.Series, n: pd.Series, gap: pd.Series, pitch: pd.Series, phase: pd.Series) -> pd.DataFrame:
    """First and last of the cells a pixel touches; bounds grow with the cell, so those between are touched too."""
    at, size, n, gap, pitch, phase = (v.to_numpy(dtype=float) for v in (at, size, n, gap, pitch, phase))
    near = np.floor(at / pitch)

    def bound(i):
        inner = np.minimum(size - (n - i) * gap, np.maximum(i * gap, i * pitch + phase))
        return np.where(i == 0, 0.0, np.where(i == n, size, inner))

    first, last = np.zeros(len(at)), np.full(len(at), -1.0)
    for d in range(2, -3, -1):
        i = near + d
        met = (i >= 0) & (i <= n - 1) & (bound(i) < at + 1) & (bound(i + 1) > at)
        last = np.where(met & (last < 0), i, last)
        first = np.where(met, i, first)
    return pd.DataFrame({"first": first.astype(np.int32), "last": last.astype(np.int32)})


def grid_vote(px: DataFrame, grid: DataFrame | None = None, pitch: int | None = None,
              phase_x: float = 0.0, phase_y: float = 0.0, sizes: DataFrame | None = None) -> DataFrame:
    """Winning colour of every grid cell; pixels near the cell centre weigh more.

    Inner cell boundaries are ``i * pitch + phase``, the outer ones the image
    border.  ``grid`` gives ``image_id, pitch, phase_x, phase_y`` per image.
    """
    images = sizes if sizes is not None else image_sizes(px)
    if grid is not None:
        images = cut_lineage(images.join(grid.select("image_id", "pitch", "phase_x", "phase_y"), "image_id"))  # known to be small
    else:
        require(pitch is not None and pitch >= 2, "pitch must be at least 2")
        images = images.selectExpr("*", f"{pitch} AS pitch", f"{c.num(phase_x)} AS phase_x", f"{c.num(phase_y)} AS phase_y")
    for axis, size in (("x", "width"), ("y", "height")):
        count = f"CAST(CEIL({size} / CAST(pitch AS DOUBLE)) AS INT)"
        gap = f"LEAST(pitch * 2.5E-1, {size} / (2E0 * ({count} + 1)))"
        images = images.selectExpr("*", f"{count} AS n_{axis}", f"CAST({gap} AS DOUBLE) AS g_{axis}")
    touched = F.pandas_udf(_touched, "first INT, last INT")
    cells = {axis: touched(axis, size, f"n_{axis}", f"g_{axis}", "pitch", f"phase_{axis}") for axis, size in (("x", "width"), ("y", "height"))}
    placed = attach_per_image(px, images).withColumns({f"_t{axis}": span for axis, span in cells.items()})
    placed = placed.filter("_tx.first <= _tx.last AND _ty.first <= _ty.last")
    for axis, size in (("x", "width"), ("y", "height")):
        def bound(i):
            return (f"(CASE WHEN {i} = 0 THEN 0E0 WHEN {i} = n_{axis} THEN CAST({size} AS DOUBLE) ELSE "
                    f"LEAST({size} - (n_{axis} - {i}) * g_{axis}, GREATEST({i} * g_{axis}, {i} * pitch + phase_{axis})) END)")
        placed = placed.withColumn(f"c{axis}", F.explode(F.expr(f"sequence(_t{axis}.first, _t{axis}.last)")))
        placed = placed.selectExpr("*", f"{bound(f'c{axis}')} AS lo_{axis}", f"{bound(f'(c{axis} + 1)')} AS hi_{axis}")
    near = " + ".join(f"pow(({v} + 5E-1 - (lo_{v} + hi_{v}) * 5E-1) / (hi_{v} - lo_{v}), 2)" for v in "xy")
    area = " * ".join(f"(LEAST({v} + 1, hi_{v}) - GREATEST({v}, lo_{v}))" for v in "xy")
    votes = placed.withColumn("w", F.expr(f"{area} * exp(-10E0 * ({near}))")).withColumn(
        "argb", F.expr(c.canonical_argb()))
    sums = votes.groupBy("image_id", "cx", "cy", "argb").agg(F.sum("w").alias("w"))
    return sums.groupBy("image_id", "cx", "cy").agg(
        F.max_by("argb", F.struct(F.expr(c.tie("w")).alias("w"), (-F.col("argb")).alias("t"))).alias("argb"))


def align_to_grid(px: DataFrame, pitch: int | None = None, max_pitch: int = 32) -> tuple[DataFrame, DataFrame]:
    """Snap every image to a regular grid; returns pixels and the pitch per image.

    Cells keep their regular boundaries (no boundary fitting).  Images without a
    detected grid stay as they are.
    """
    px = stored(px)  # read for sizes, votes and pixels
    sizes = cut_lineage(image_sizes(px))
    if pitch is None:
        cells = cut_lineage(detect_pitch(projection_profiles(px, True), max_pitch).filter("pitch IS NOT NULL").select("image_id", "pitch"))
    else:
        cells = sizes.select("image_id", F.lit(pitch).alias("pitch"))
    grid = cells.withColumn("phase_x", F.lit(0.0)).withColumn("phase_y", F.lit(0.0))
    votes = grid_vote(px, grid, sizes=sizes)
    placed = attach_per_image(px, cells, "left").selectExpr(
        "*", "CAST(FLOOR(x / pitch) AS INT) AS cx", "CAST(FLOOR(y / pitch) AS INT) AS cy")
    joined = placed.join(votes, ["image_id", "cx", "cy"], "left")
    pixels = joined.select("image_id", "x", "y", *[
        F.expr(f"CASE WHEN argb IS NULL THEN {v} ELSE {c.channel('argb', i)} END").alias(v)
        for v, i in (("r", 2), ("g", 1), ("b", 0), ("a", 3))])
    return pixels.select(*PIXEL), cells


# --- tile grids --------------------------------------------------------------------------

def cut_profiles(px: DataFrame) -> DataFrame:
    """Mean change across every vertical (axis x) and horizontal (axis y) cut line, over all its pixels."""
    pixel = F.struct("x", "y", "r", "g", "b", "a")
    here = ("r", "g", "b", "a")
    before = tuple(f"q.{v}" for v in here)
    out = None
    for axis in ("x", "y"):
        pairs = along(px, axis, lambda rows, line: rows.withColumn("q", F.lag(pixel).over(line))).filter(f"q.{axis} = {axis} - 1")
        part = pairs.groupBy("image_id", F.col(axis).alias("pos")).agg(
            F.avg(F.expr(c.cut_change(before, here))).alias("v")).withColumn("axis", F.lit(axis))
        out = part if out is None else out.unionByName(part)
    return out.select("image_id", "axis", "pos", "v")


# How common square tile sizes are, and the side pairs of oblong tiles.
SIZE_PRIOR = {32: 55, 16: 43, 64: 40, 8: 30, 24: 28, 48: 28, 128: 24}
OBLONG = (8, 16, 32, 64, 128)


def suggest_tile_grids(px: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Scored tile sizes per image: a size prior, a tile-count term and boundary evidence."""
    images = sizes if sizes is not None else image_sizes(px)
    cuts = cut_profiles(px)
    extents = images.select("image_id", F.inline(F.array(
        F.struct(F.lit("x").alias("axis"), F.col("width").alias("extent")),
        F.struct(F.lit("y").alias("axis"), F.col("height").alias("extent")))))
    means = cuts.groupBy("image_id", "axis").agg(F.avg("v").alias("mean"))
    # A cut line is compared only with the tile sizes that divide its position.
    hits = cuts.join(extents, ["image_id", "axis"]).withColumn("size", F.explode(F.expr(
        "filter(sequence(4, 512), s -> pos % s = 0 AND extent % s = 0)")))
    hits = hits.groupBy("image_id", "axis", "size").agg(F.sum("v").alias("total"), F.first("extent").alias("extent"))
    evidence = hits.join(means, ["image_id", "axis"]).withColumn(
        "boundary", F.expr("total / (extent DIV size - 1)")).selectExpr(
        "image_id", "axis", "size", "CASE WHEN mean < 1E-9 THEN 0E0 ELSE "
        "LEAST(1E0, GREATEST(-1E0, (boundary - mean) / (boundary + mean + 1E-9))) END AS e")
    squares = images.withColumn("w", F.explode(F.expr(
        "filter(sequence(4, GREATEST(4, LEAST(512, width, height))), s -> width % s = 0 AND height % s = 0)"))).withColumn("h", F.col("w"))
    pairs = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for s in OBLONG for w, h in ((s, 2 * s), (2 * s, s))])
    oblong = images.select("*", F.inline(pairs)).filter("width % w = 0 AND height % h = 0")
    grids = squares.unionByName(oblong).selectExpr(
        "image_id", "w AS tile_w", "h AS tile_h", "CAST(width DIV w AS INT) AS tile_cols",
        "CAST(height DIV h AS INT) AS tile_rows").filter(
        "CAST(tile_cols AS BIGINT) * tile_rows >= 2")
    for axis, size in (("x", "tile_w"), ("y", "tile_h")):
        side = evidence.filter(F.col("axis") == axis).select("image_id", F.col("size").alias(size), F.col("e").alias(f"e{axis}"))
        grids = grids.join(side, ["image_id", size], "left")
    prior = " ".join(f"WHEN {s} THEN {v}" for s, v in SIZE_PRIOR.items())
    score = (f"CASE WHEN tile_w <> tile_h THEN 20 ELSE CASE tile_w {prior} ELSE 15 END END "
             "- 8 * abs(ln(tile_cols * tile_rows / 18E0)) + (coalesce(ex, 0E0) + coalesce(ey, 0E0)) * 12")
    return grids.select("image_id", "tile_w", "tile_h", "tile_cols", "tile_rows", F.round(F.expr(score), 6).alias("score"))


def best_suggestions(px: DataFrame, k: int) -> DataFrame:
    """The k best tile grids per image: score, then fewer tiles."""
    require(k >= 1, "k must be positive")
    order = Window.partitionBy("image_id").orderBy(
        F.desc("score"), F.expr("tile_cols * tile_rows"), "tile_w")
    return suggest_tile_grids(px).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# --- seams ---------------------------------------------------------------------------------

def tile_pair_seams(tiles: DataFrame, pairs: DataFrame, tile_w: int, tile_h: int) -> DataFrame:
    """Seam distance along both joins of every ``(first_id, second_id)`` pair.

    Axis x joins the right edge of the first tile with the left edge of the
    second, axis y its bottom with the top.  Only edge pixels are shuffled.
    """
    def strip(condition, at, key, tag):
        return tiles.filter(condition).select(F.col("tile_id").alias(key), F.col(at).alias("pos"),
                                              *[F.col(v).alias(f"{v}_{tag}") for v in "rgba"])
    out = None
    for axis, last, first, at in (("x", f"tx = {tile_w - 1}", "tx = 0", "ty"), ("y", f"ty = {tile_h - 1}", "ty = 0", "tx")):
        left = pairs.join(strip(last, at, "first_id", "p"), "first_id")
        both = left.join(strip(first, at, "second_id", "q"), ["second_id", "pos"])
        p, q = (tuple(f"{v}_{t}" for v in "rgba") for t in "pq")
        part = both.select("first_id", "second_id", F.lit(axis).alias("axis"), "pos",
                           F.expr(c.seam_distance(p, q)).alias("difference"))
        out = part if out is None else out.unionByName(part)
    return out


def seam_summary(seams: DataFrame, threshold: float) -> DataFrame:
    require(threshold >= 0, "threshold must not be negative")
    return seams.groupBy("first_id", "second_id", "axis").agg(
        F.avg("difference").alias("mean"), F.max("difference").alias("maximum"),
        F.count_if(F.col("difference") > threshold).alias("above"), F.count(F.lit(1)).alias("n"))
