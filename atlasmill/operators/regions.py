"""Connected regions and what is measured on them.

Regions are labelled in two steps.  Fixed-size tiles of an image are labelled
independently (a tile is at most ``tile`` x ``tile`` pixels), then only the
label pairs that touch across tile borders form a graph, which is contracted
with alternating star operations, one job per round.  Neither a huge image nor a
huge region ever sits in one task.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atlasmill.functions import color as c
from atlasmill.functions.lab import add_lab
from atlasmill.operators.bands import along
from atlasmill.operators.palette import set_rgb
from atlasmill.operators.pixels import PIXEL, background_delta, image_sizes, near_background, with_background, with_rgb, with_sizes
from atlasmill.operators.stencil import RING, cell, gather
from atlasmill.runtime import attach_unique, cut_lineage, require

SCAN = 2147483648  # a pixel's scan code is y * SCAN + x
FORWARD = {4: [(1, 0), (0, 1)], 8: [(1, 0), (0, 1), (1, 1), (-1, 1)]}
CROSS = [(0, -1), (-1, 0), (1, 0), (0, 1)]
MAX_COLORS = 4096


def _tile_labels(connectivity: int, limit: float | None):
    """Label one tile: every pixel gets the smallest scan code of its region."""
    def label(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
        gx, gy = x - x.min(), y - y.min()
        h, w = int(gy.max()) + 1, int(gx.max()) + 1
        at = np.full((h, w), -1, dtype=np.int64)
        order = np.lexsort((x, y))
        rank = np.empty(len(rows), dtype=np.int64)
        rank[order] = np.arange(len(rows))
        at[gy, gx] = rank
        key = rows["key"].to_numpy()[order]
        lab = rows[["lab_l", "lab_a", "lab_b"]].to_numpy()[order] if limit is not None else None
        pairs = []
        for dx, dy in FORWARD[connectivity]:
            here = at[:h - dy, max(0, -dx):w - max(0, dx)]
            there = at[dy:, max(0, dx):w + min(0, dx)]
            u, v = here.ravel(), there.ravel()
            both = (u >= 0) & (v >= 0)
            u, v = u[both], v[both]
            same = key[u] == key[v]
            if lab is not None:
                same &= np.sqrt(((lab[u] - lab[v]) ** 2).sum(axis=1)) <= limit
            pairs.append(np.stack([u[same], v[same]]))
        u, v = np.concatenate(pairs, axis=1)
        root = np.arange(len(rows))
        while True:
            low = np.minimum(root[u], root[v])
            new = root.copy()
            np.minimum.at(new, root[u], low)
            np.minimum.at(new, root[v], low)
            new = new[new]
            if np.array_equal(new, root):
                break
            root = new
        code = y[order].astype(np.int64) * SCAN + x[order]
        return pd.DataFrame({"image_id": rows["image_id"].to_numpy(), "x": x, "y": y, "root": code[root][rank]})
    return label


def _contract(edges: DataFrame) -> DataFrame:
    """``image_id, root, component``: the smallest root reachable from every root."""
    edges = cut_lineage(edges.select("image_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        # Large star: every larger neighbour of a node is linked to the node's minimum.
        both = edges.unionByName(edges.select("image_id", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("image_id", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = attach_unique(both.filter("v > u"), low, ["image_id", "u"], ["v"], "inner").select(
            "image_id", F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: smaller neighbours and the node itself are linked to the minimum.
        least = large.groupBy("image_id", "u").agg(F.min("v").alias("m"))
        hung = attach_unique(large, least, ["image_id", "u"], ["v"], "inner").select("image_id", F.col("v").alias("u"), F.col("m").alias("v"))
        small = cut_lineage(hung.unionByName(least.select("image_id", "u", F.col("m").alias("v"))).filter("u <> v").distinct())
        if small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty():
            return small.select("image_id", F.col("u").alias("root"), F.col("v").alias("component"))
        edges = small


def connected_components(px: DataFrame, key: str, connectivity: int = 4, tile: int = 64,
                         max_distance: float | None = None) -> DataFrame:
    """Add ``component``, the scan code of the first pixel of the pixel's region.

    Touching pixels belong together when ``key`` (an SQL expression) is equal
    and, with ``max_distance``, their Lab distance does not exceed it.
    """
    require(connectivity in FORWARD, "connectivity must be 4 or 8")
    require(2 <= tile <= 256, "tile must be 2..256")
    keyed = px.withColumn("key", F.expr(key).cast("bigint"))
    features = ["key"]
    if max_distance is not None:
        require(max_distance >= 0, "distance must not be negative")
        keyed = add_lab(keyed)
        features += ["lab_l", "lab_a", "lab_b"]
    placed = keyed.select("image_id", "x", "y", *features, F.floor(F.col("x") / tile).cast("int").alias("tx"),
                          F.floor(F.col("y") / tile).cast("int").alias("ty"))
    if max_distance is not None:
        placed = cut_lineage(placed)  # read by the tiles and by both sides of their borders
    schema = f"image_id {dict(px.dtypes)['image_id']}, x int, y int, root bigint"
    labels = cut_lineage(placed.groupBy("image_id", "tx", "ty").applyInPandas(_tile_labels(connectivity, max_distance), schema))
    edge_of = (f"pmod(x, {tile}) IN (0, {tile - 1}) OR pmod(y, {tile}) IN (0, {tile - 1})")
    border = placed.filter(edge_of).join(labels.filter(edge_of), ["image_id", "x", "y"])
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in FORWARD[connectivity]])
    reach = border.select("*", F.inline(steps)).withColumn("nx", F.expr("x + dx")).withColumn("ny", F.expr("y + dy"))
    reach = reach.filter(f"FLOOR(nx / {tile}) <> tx OR FLOOR(ny / {tile}) <> ty")
    other = border.select("image_id", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("root").alias("v"),
                          *[F.col(n).alias(f"n_{n}") for n in features])
    touching = reach.join(other, ["image_id", "nx", "ny"]).filter("key = n_key")
    if max_distance is not None:
        far = c.distance(("lab_l", "lab_a", "lab_b"), ("n_lab_l", "n_lab_a", "n_lab_b"))
        touching = touching.filter(F.expr(f"{far} <= {c.num(max_distance)}"))
    edges = cut_lineage(touching.select("image_id", F.col("root").alias("u"), "v").filter("u <> v").distinct())
    if not edges.isEmpty():
        labels = labels.join(_contract(edges), ["image_id", "root"], "left").withColumn(
            "component", F.coalesce("component", "root"))
    else:
        labels = labels.withColumn("component", F.col("root"))
    return px.join(labels.select("image_id", "x", "y", "component"), ["image_id", "x", "y"])


def component_stats(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("image_id", "component").agg(
        F.count(F.lit(1)).alias("size"), F.min("x").alias("min_x"), F.max("x").alias("max_x"),
        F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def remove_background_edges(px: DataFrame, tolerance: float, color: int | None = None) -> DataFrame:
    """Clear background-like pixels reachable from the border through such pixels (4-connected)."""
    delta = background_delta(tolerance)
    based = with_background(px, color).filter("background IS NOT NULL")
    open_px = based.filter((F.col("a") == 0) | near_background(delta)).drop("background")
    regions = connected_components(open_px, "1", 4)
    outer = _touching_border(regions, px)
    hit = attach_unique(regions, outer.withColumn("hit", F.lit(True)), ["image_id", "component"], ["x", "y"], "inner")
    cleared = hit.select("image_id", "x", "y", "hit")
    return px.join(cleared, ["image_id", "x", "y"], "left").select(
        "image_id", "x", "y", "r", "g", "b", F.when(F.col("hit"), F.lit(0)).otherwise(F.col("a")).alias("a"))


def _touching_border(regions: DataFrame, px: DataFrame) -> DataFrame:
    sized = with_sizes(regions, image_sizes(px))
    return sized.filter("x = 0 OR y = 0 OR x = width - 1 OR y = height - 1").select("image_id", "component").distinct()


def component_votes(px: DataFrame) -> DataFrame:
    """Colours around every exact-colour region: votes of 4-neighbours with the same alpha."""
    labelled = connected_components(px.filter("a > 0"), c.pack_argb(), 8).withColumn("rgb", F.expr(c.pack_rgb()))
    return _votes(labelled)


def _votes(labelled: DataFrame) -> DataFrame:
    wide = gather(labelled.select("image_id", "x", "y", "a", "rgb", "component"), ["a", "rgb", "component"], 1, CROSS)
    near = F.filter(F.array(*[F.col(cell(*o)) for o in CROSS]), lambda v: v.isNotNull())
    pairs = wide.select("image_id", "component", "a", F.inline(near).alias("n_a", "n_rgb", "n_component"))
    votes = pairs.filter("n_a = a AND n_component <> component").groupBy("image_id", "component", "n_rgb").agg(
        F.count(F.lit(1)).alias("votes"))
    totals = votes.groupBy("image_id", "component").agg(F.sum("votes").alias("boundary"))
    return attach_unique(votes, totals, ["image_id", "component"], ["n_rgb"], "inner").select(
        "image_id", "component", F.col("n_rgb").alias("rgb"), "votes",
        (F.col("votes") / F.col("boundary")).alias("agreement"))


def structure_probe(px: DataFrame, similar: float = 0.0, max_size: int = 12, min_agreement: float = 0.6,
                    max_distance: float = 40.0, detail_distance: float = 12.0, min_confidence: float = 0.5,
                    protect_lines: bool = True, protect_boundary: bool = True) -> tuple[DataFrame, DataFrame]:
    """Small regions that look like noise: report per region and the changed frame.

    Regions grow between touching pixels of nearly equal colour; the distance is
    measured between neighbours only, so the result does not depend on where a
    search would start.
    """
    require(0 <= similar <= 100, "similar colour distance must be 0..100")
    require(1 <= max_size <= 4096, "maximum component size must be 1..4096")
    require(0 <= min_agreement <= 1 and 0 <= min_confidence <= 1, "agreement and confidence must be 0..1")
    require(0 < max_distance <= 150 and 0 <= detail_distance <= 100, "distances out of range")
    shown = px.filter("a > 0")
    labelled = cut_lineage(connected_components(shown, "a" if similar > 0 else c.pack_argb(), 8,
                                                max_distance=similar if similar > 0 else None)
                           .withColumn("rgb", F.expr(c.pack_rgb())))
    sizes = component_stats(labelled)
    small = sizes.filter(F.col("size") <= max_size)
    everything = px.join(labelled.select("image_id", "x", "y", "component", "rgb"), ["image_id", "x", "y"], "left")
    wide = gather(everything.select("image_id", "x", "y", "a", "rgb", "component"), ["a", "rgb", "component"])
    members = wide.filter("component IS NOT NULL").join(small.select("image_id", "component"), ["image_id", "component"], "left_semi")
    ring = F.filter(F.array(*[F.struct(F.lit(dx != 0 and dy != 0).alias("diagonal"), F.col(cell(dx, dy)).alias("n"))
                              for dx, dy in RING]), lambda v: v["n"].isNotNull())
    members = members.withColumn("ring", ring)

    def links(flag):
        return F.expr(f"size(filter(ring, v -> v.diagonal = {flag} AND v.n.component = component))")
    shape = members.groupBy("image_id", "component").agg(
        F.max(F.expr("exists(ring, v -> v.n.a = 0)")).alias("transparent_boundary"),
        F.sum(links("false")).alias("cardinal"), F.sum(links("true")).alias("diagonal"))
    votes = members.select("image_id", "component", "a", F.explode(F.expr(
        "filter(ring, v -> NOT v.diagonal AND v.n.a = a AND v.n.component <> component)")).alias("v")).groupBy(
        "image_id", "component", F.col("v.n.rgb").alias("n_rgb")).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("image_id", "component").agg(
        F.max_by("n_rgb", F.struct("votes", (-F.col("n_rgb")).alias("t"))).alias("best"),
        F.max("votes").alias("top"), F.sum("votes").alias("boundary"))
    aim = add_lab(best.select("image_id", "component", "best"), c.unpack_rgb("best"), "t_")
    own = add_lab(members.select("image_id", "component", "rgb"), c.unpack_rgb("rgb"))
    delta = F.expr(c.distance(("lab_l", "lab_a", "lab_b"), ("t_l", "t_a", "t_b")))
    distances = own.join(aim, ["image_id", "component"]).groupBy("image_id", "component").agg(F.avg(delta).alias("distance"))
    report = small.join(best, ["image_id", "component"]).join(distances, ["image_id", "component"]).join(
        shape, ["image_id", "component"]).withColumn("agreement", F.expr("CAST(top AS DOUBLE) / boundary"))
    report = report.filter(F.expr(f"agreement >= {c.num(min_agreement)} AND round(distance, 9) <= {c.num(max_distance)}"))
    report = report.withColumn("long", F.expr("GREATEST(max_x - min_x, max_y - min_y) + 1")).withColumn(
        "short", F.expr("LEAST(max_x - min_x, max_y - min_y) + 1"))
    report = report.withColumn("line", F.expr(
        "size >= 3 AND (long >= 3 * short OR (diagonal >= 2 * (size - 1) AND cardinal <= 2))"))
    keep = []
    if protect_boundary:
        keep.append("transparent_boundary")
    if protect_lines:
        keep.append("line")
    keep.append(f"(size <= 2 AND round(distance, 9) >= {c.num(detail_distance)})")
    report = report.withColumn("protected", F.expr(" OR ".join(keep)))
    report = report.withColumn("confidence", F.expr(
        f"agreement * (1E0 - 2.5E-1 * distance / {c.num(max_distance)}) * (1E0 - 1.5E-1 * (size - 1) / {c.num(max_size)}) "
        "* CASE WHEN protected THEN 3.5E-1 ELSE 1E0 END"))
    report = cut_lineage(report.select("image_id", "component", "size", "best", "agreement", "distance", "line",
                                       "transparent_boundary", "protected", "confidence"))
    accepted = report.filter(F.expr(f"NOT protected AND confidence >= {c.num(min_confidence)}")).select("image_id", "component", "best")
    moves = labelled.select("image_id", "x", "y", "component").join(accepted, ["image_id", "component"]).select("image_id", "x", "y", "best")
    changed = set_rgb(px.join(moves, ["image_id", "x", "y"], "left"), F.col("best"))
    return changed, report


def structure_heatmap(px: DataFrame, report: DataFrame, labelled: DataFrame) -> DataFrame:
    """Grey picture tinted red where a candidate region lies, by its confidence."""
    heat = report.select("image_id", "component", F.expr(
        "CAST(LEAST(255, GREATEST(1, bround(255E0 * confidence, 0))) AS INT)").alias("heat"))
    placed = labelled.select("image_id", "x", "y", "component").join(heat, ["image_id", "component"])
    both = px.join(placed.select("image_id", "x", "y", "heat"), ["image_id", "x", "y"], "left")
    gray = f"CAST(bround({c.weighted(c.LUMA_709, ('r', 'g', 'b'))}, 0) AS INT)"
    other = f"CASE WHEN a = 0 THEN {{v}} WHEN heat IS NULL THEN {gray} ELSE CAST(bround({gray} * (1E0 - heat / 255E0), 0) AS INT) END"
    return both.select("image_id", "x", "y", F.expr(f"CASE WHEN a = 0 THEN r WHEN heat IS NULL THEN {gray} ELSE 255 END").alias("r"),
                       F.expr(other.format(v="g")).alias("g"), F.expr(other.format(v="b")).alias("b"), "a")


# --- dark features -----------------------------------------------------------------------

def _ring_counts() -> list[int]:
    """Number of connected groups among the set neighbours, for each of the 256 ring masks."""
    counts = []
    for mask in range(256):
        todo = {o for i, o in enumerate(RING) if mask >> i & 1}
        groups = 0
        while todo:
            groups += 1
            open_set = [todo.pop()]
            while open_set:
                x, y = open_set.pop()
                near = {o for o in todo if abs(o[0] - x) <= 1 and abs(o[1] - y) <= 1}
                todo -= near
                open_set.extend(near)
        counts.append(groups)
    return counts


def alpha_clearance(px: DataFrame, radius: int = 5) -> DataFrame:
    """Chebyshev distance of every visible pixel to the next empty or missing one, capped at ``radius + 1``.

    One pass along rows (visible runs) and one along columns.
    """
    shown = px.filter("a > 0").select("image_id", "x", "y")
    def reach(rows, line):
        rows = rows.withColumn("island", F.col("x") - F.row_number().over(line))
        island = Window.partitionBy("image_id", "y", "_band", "island")
        return rows.withColumn("reach", F.least(F.col("x") - F.min("x").over(island) + 1, F.max("x").over(island) - F.col("x") + 1))

    runs = along(shown, "x", reach, radius)
    near = along(runs, "y", lambda rows, column: rows.withColumn(
        "col", F.collect_list(F.struct("y", "reach")).over(column.rangeBetween(-radius, radius))), radius)
    inside = f"aggregate(col, {radius + 1}, (t, v) -> LEAST(t, GREATEST(abs(v.y - y), v.reach)))"
    gap = (f"aggregate(filter(sequence(-{radius}, {radius}), d -> NOT exists(col, v -> v.y = y + d)), {radius + 1}, "
           "(t, d) -> LEAST(t, abs(d)))")
    return near.select("image_id", "x", "y", F.expr(f"LEAST({inside}, {gap})").alias("clearance"))


def dark_features(px: DataFrame, lightness: float = 5.0) -> DataFrame:
    """Shape features of every dark visible pixel: region sizes, neighbour counts, clearance, ring groups."""
    marked = cut_lineage(px.withColumn("dark", F.expr(f"a > 0 AND {c.rgb_to_lab()[0]} < {c.num(lightness)}")))
    dark = marked.filter("dark").select(*PIXEL)
    out = dark.select("image_id", "x", "y")
    for connectivity, name in ((8, ""), (4, "4")):
        regions = connected_components(dark, "1", connectivity)
        sizes = regions.groupBy("image_id", "component").agg(F.count(F.lit(1)).alias("_size"))
        largest = sizes.groupBy("image_id").agg(F.max("_size").alias(f"largest{name}"))
        sized = attach_unique(regions.select("image_id", "x", "y", "component"), sizes.join(largest, "image_id"),
                              ["image_id", "component"], ["x", "y"], "inner")
        sized = sized.drop("component").withColumnRenamed("_size", f"component{name}")
        out = out.join(sized, ["image_id", "x", "y"])
    wide = gather(marked.select("image_id", "x", "y", "dark"), ["dark"], 2).filter("dark")

    def on(dx, dy):
        return F.coalesce(F.col(cell(dx, dy))["dark"], F.lit(False))

    def count(cells):
        return sum((on(*o).cast("int") for o in cells), F.lit(0))
    five = [(dx, dy) for dy in range(-2, 3) for dx in range(-2, 3) if dx or dy]
    run2 = sum(((on(dx, dy) & on(2 * dx, 2 * dy)).cast("int") for dx, dy in RING), F.lit(0))
    opposite = F.lit(False)
    for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1)):
        opposite = opposite | (on(dx, dy) & on(-dx, -dy))
    mask = sum((on(*o).cast("int") * (1 << i) for i, o in enumerate(RING)), F.lit(0))
    shape = wide.select("image_id", "x", "y", count(RING).alias("dark8"), count(CROSS).alias("dark4"),
                        count(five).alias("dark5"), run2.alias("run2"), opposite.alias("opposite"), mask.alias("mask"))
    groups = F.array(*[F.lit(v) for v in _ring_counts()])
    shape = shape.withColumn("ring", F.get(groups, F.col("mask"))).drop("mask")
    clear = alpha_clearance(px)
    return out.join(shape, ["image_id", "x", "y"]).join(clear, ["image_id", "x", "y"])


def dark_noise_candidates(px: DataFrame, lightness: float = 5.0, clearance: int = 1, max_dark: int = 2, max_cardinal: int = 1,
                          min_gain: float = 10.0, tolerance: float = 28.0, min_consensus: float = 0.5,
                          cardinal_weight: float = 1.0) -> DataFrame:
    """Dark pixels that fit the first-stage noise rule, with the bright colour to use instead.

    Only the first rule: clear of transparency, few dark neighbours, at least
    five bright ones that mostly agree, and enough lightness to gain.
    """
    marked = add_lab(px).withColumn("rgb", F.expr(c.pack_rgb()))
    marked = marked.withColumn("dark", F.expr(f"a > 0 AND lab_l < {c.num(lightness)}"))
    wide = gather(marked, ["a", "rgb", "dark", "lab_l", "lab_a", "lab_b"]).filter("dark")
    full = F.lit(True)
    for o in RING:
        full = full & F.coalesce(F.col(cell(*o))["a"] > 0, F.lit(False))
    ring = F.array(*[F.struct(F.lit(cardinal_weight if dx == 0 or dy == 0 else 1.0).alias("w"),
                              F.lit(dx == 0 or dy == 0).alias("cardinal"), F.col(cell(dx, dy)).alias("n")) for dx, dy in RING])
    wide = wide.filter(full).withColumn("ring", ring).withColumn("bright", F.expr("filter(ring, v -> NOT v.n.dark)"))
    wide = wide.filter(F.expr(
        f"8 - size(bright) <= {max_dark} AND size(filter(ring, v -> v.n.dark AND v.cardinal)) <= {max_cardinal} AND size(bright) >= 5"))
    gap = "sqrt(pow(k.n.lab_l - v.n.lab_l, 2) + pow(k.n.lab_a - v.n.lab_a, 2) + pow(k.n.lab_b - v.n.lab_b, 2))"
    support = f"aggregate(bright, 0E0, (t, v) -> t + v.w * GREATEST(0E0, 1E0 - {gap} / {c.num(max(tolerance, 1))}))"
    wide = wide.withColumn("best", F.expr(
        f"array_max(transform(bright, (k, i) -> named_struct('s', {c.tie(support)}, 'o', -i, 'n', k.n))).n"))
    agree = "size(filter(bright, v -> sqrt(pow(best.lab_l - v.n.lab_l, 2) + pow(best.lab_a - v.n.lab_a, 2) " \
            f"+ pow(best.lab_b - v.n.lab_b, 2)) <= {c.num(tolerance)}))"
    wide = wide.filter(F.expr(f"best.lab_l - lab_l >= {c.num(min_gain)} AND {agree} >= {c.num(min_consensus)} * size(bright)"))
    clear = alpha_clearance(px, max(1, clearance)).filter(F.col("clearance") > clearance).select("image_id", "x", "y")
    return wide.select("image_id", "x", "y", "rgb", F.col("best.rgb").alias("new_rgb")).join(
        clear, ["image_id", "x", "y"], "left_semi")


# --- palettes by coherence -----------------------------------------------------------------

def color_coherence(px: DataFrame, tile: int = 16, connectivity_weight: float = 0.5, local_weight: float = 0.5,
                    detail_weight: float = 0.5, labelled: DataFrame | None = None) -> DataFrame:
    """Per colour: area, coherence of its regions, densest tile and the cost of losing it.

    An image with a single colour has no nearest other one, and NULL as cost.
    """
    require(tile == 0 or 4 <= tile <= 256, "tile must be 0 or 4..256")
    require(all(0 <= w <= 1 for w in (connectivity_weight, local_weight, detail_weight)), "weights must be 0..1")
    if labelled is None:
        labelled = label_colors(px)
    regions = labelled.groupBy("image_id", "rgb", "component").agg(F.count(F.lit(1)).alias("size"))
    colors = regions.groupBy("image_id", "rgb").agg(F.sum("size").alias("n"), F.sum(F.expr("size * size")).alias("squares"))
    if tile:
        densest = labelled.groupBy("image_id", "rgb", F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty")).agg(
            F.count(F.lit(1)).alias("k")).groupBy("image_id", "rgb").agg(F.max("k").alias("tile_max"))
        colors = colors.join(densest, ["image_id", "rgb"])
    else:
        colors = colors.withColumn("tile_max", F.lit(0).cast("bigint"))
    ok = dict(zip(("k_l", "k_a", "k_b"), c.rgb_to_oklab(*c.unpack_rgb("rgb"))))
    colors = cut_lineage(colors.select("*", *[F.expr(e).alias(n) for n, e in ok.items()]))
    both = colors.join(nearest_other_color(colors), ["image_id", "rgb"], "left")
    area = f"pow(n, {c.num(1 - connectivity_weight)}) * pow(CAST(squares AS DOUBLE) / n, {c.num(connectivity_weight)})"
    local = f"(1E0 + 4E0 * {c.num(local_weight)} * tile_max / GREATEST(1E0, n))"
    return both.select("image_id", "rgb", "n", "squares", F.expr("CAST(squares AS DOUBLE) / n").alias("coherence"), "tile_max",
                       "nearest_sq", F.expr(f"{area} * {local} * pow(nearest_sq, {c.num(0.5 + detail_weight)})").alias("cost"),
                       *ok)


def nearest_other_color(colors: DataFrame) -> DataFrame:
    """``(image_id, rgb, nearest_sq)``: squared OKLab distance to the nearest other colour of the image.

    Colours lie in cells of a grid. A colour looks into its own and the 26 cells around it; what
    lies elsewhere is farther than a cell is wide, so a find within that width is final. The rest
    look again in a grid twice as coarse, until one cell holds the whole cube.
    """
    base = colors.select("image_id", "rgb", "k_l", "k_a", "k_b")
    around = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dl", "da", "db"), step)])
                       for step in itertools.product((-1, 0, 1), repeat=3)])
    open_, done, width = base, [], 1 / 256
    while True:
        cells = [F.floor(F.col(f"k_{n}") / width).cast("int").alias(f"c{n}") for n in "lab"]
        there = base.select("image_id", F.col("rgb").alias("o_rgb"), *[F.col(f"k_{n}").alias(f"o_{n}") for n in "lab"], *cells)
        mine = open_.select("*", *cells, F.explode(around).alias("s")).select(
            "image_id", "rgb", "k_l", "k_a", "k_b", *[(F.col(f"c{n}") + F.col(f"s.d{n}")).alias(f"c{n}") for n in "lab"])
        found = mine.join(there, ["image_id", "cl", "ca", "cb"]).filter("rgb <> o_rgb").groupBy("image_id", "rgb").agg(
            F.min(F.expr("pow(o_l - k_l, 2) + pow(o_a - k_a, 2) + pow(o_b - k_b, 2)")).alias("nearest_sq"))
        found = cut_lineage(open_.join(found, ["image_id", "rgb"], "left"))
        final = F.lit(width > 2) | F.coalesce(F.col("nearest_sq") <= width * width, F.lit(False))
        done.append(found.filter(final).select("image_id", "rgb", "nearest_sq"))
        open_ = found.filter(~final).drop("nearest_sq")
        if width > 2 or open_.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)
        width *= 4


def label_colors(px: DataFrame) -> DataFrame:
    """Visible pixels with their exact-colour region (8-connected) and packed colour."""
    return cut_lineage(connected_components(with_rgb(px.filter("a > 0")), "rgb", 8))


def connected_palette(px: DataFrame, target: int, tile: int = 16, connectivity_weight: float = 0.5, local_weight: float = 0.5,
                      detail_weight: float = 0.5, context_weight: float = 0.5) -> DataFrame:
    """Keep the ``target`` colours that cost most to lose and recolour the other regions.

    All colours are ranked once by ``color_coherence``; a dropped region takes
    the nearest kept colour, or a kept 4-neighbour colour when the vote of its
    border outweighs the extra distance.
    """
    require(1 <= target <= MAX_COLORS, f"target must be 1..{MAX_COLORS}")
    require(0 <= context_weight <= 1, "weights must be 0..1")
    labelled = label_colors(px)
    scored = color_coherence(px, tile, connectivity_weight, local_weight, detail_weight, labelled)
    order = Window.partitionBy("image_id").orderBy(F.desc(F.round("cost", 6)), "rgb")
    top = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= target).select(
        "image_id", "rgb", "k_l", "k_a", "k_b", F.lit(True).alias("kept"))
    top = cut_lineage(top)
    lists = top.groupBy("image_id").agg(F.collect_list(F.struct("rgb", "k_l", "k_a", "k_b")).alias("all"))
    dropped = scored.select("image_id", "rgb", "k_l", "k_a", "k_b").join(top.select("image_id", "rgb"), ["image_id", "rgb"], "left_anti")
    nearest = attach_unique(dropped, lists, ["image_id"], ["rgb"], "inner").withColumn("near", F.expr(
        "array_min(transform(all, p -> named_struct('d', round(pow(p.k_l - k_l, 2) + pow(p.k_a - k_a, 2) + pow(p.k_b - k_b, 2), 9), 'rgb', p.rgb)))"))
    nearest = cut_lineage(nearest.select("image_id", "rgb", "k_l", "k_a", "k_b", F.col("near.d").alias("d"), F.col("near.rgb").alias("near_rgb")))
    votes = _kept_votes(labelled, top, nearest)
    costs = votes.withColumn("cost", F.expr(
        f"round(pow(v_l - k_l, 2) + pow(v_a - k_a, 2) + pow(v_b - k_b, 2) - {c.num(context_weight)} * votes / total * 2E-2, 9)"))
    pulled = costs.groupBy("image_id", "component").agg(F.min(F.struct("cost", "v_rgb")).alias("v"))
    regions = labelled.select("image_id", "component", "rgb").distinct().join(nearest.select("image_id", "rgb", "d", "near_rgb"), ["image_id", "rgb"])
    chosen = regions.join(pulled, ["image_id", "component"], "left").select(
        "image_id", "component", F.expr("CASE WHEN v.cost < d THEN v.v_rgb ELSE near_rgb END").alias("new_rgb"))
    if context_weight == 0:
        chosen = regions.select("image_id", "component", F.col("near_rgb").alias("new_rgb"))
    moves = attach_unique(labelled.select("image_id", "x", "y", "component"), chosen, ["image_id", "component"], ["x", "y"], "inner")
    return set_rgb(px.join(moves.select("image_id", "x", "y", "new_rgb"), ["image_id", "x", "y"], "left"), F.col("new_rgb"))


def _kept_votes(labelled: DataFrame, top: DataFrame, nearest: DataFrame) -> DataFrame:
    """Border votes of dropped regions for kept colours, with both OKLab positions."""
    wide = gather(labelled.select("image_id", "x", "y", "a", "rgb", "component"), ["a", "rgb"], 1, CROSS)
    near = F.filter(F.array(*[F.col(cell(*o)) for o in CROSS]), lambda v: v.isNotNull())
    pairs = wide.select("image_id", "component", "rgb", "a", F.inline(near).alias("n_a", "v_rgb")).filter("n_a = a AND v_rgb <> rgb")
    counted = pairs.groupBy("image_id", "component", "rgb", "v_rgb").agg(F.count(F.lit(1)).alias("votes"))
    mine = nearest.select("image_id", "rgb", "k_l", "k_a", "k_b")
    theirs = top.select("image_id", F.col("rgb").alias("v_rgb"), *[F.col(f"k_{n}").alias(f"v_{n}") for n in "lab"])
    both = attach_unique(counted, mine, ["image_id", "rgb"], ["component"], "inner")
    both = attach_unique(both, theirs, ["image_id", "v_rgb"], ["component"], "inner")
    total = both.groupBy("image_id", "component").agg(F.sum("votes").alias("total"))
    return both.join(total, ["image_id", "component"])
