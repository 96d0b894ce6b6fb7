"""Neighbourhood operators.  All of them read the untouched image, so every
pixel can be computed at the same time.

Neighbours are gathered without multiplying rows by the window area: each pixel
is sent to the ``2r + 1`` image rows that need it, one shuffle groups image
rows, and ``lag``/``lead`` along the row provide the rest.  A group is one row
of one image, never a whole image.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasmill.functions import color as c
from atlasmill.functions.lab import add_lab
from atlasmill.operators.bands import along, run_lengths, within_tiles
from atlasmill.operators.pixels import PIXEL
from atlasmill.runtime import cut_lineage, require

RING = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dx, dy) != (0, 0)]


def cell(dx: int, dy: int) -> str:
    """Column name of the neighbour at an offset."""
    def part(v):
        return f"m{-v}" if v < 0 else str(v)
    return f"at_{part(dx)}_{part(dy)}"


def gather(px: DataFrame, cols: list[str], radius: int = 1,
           offsets: list[tuple[int, int]] | None = None) -> DataFrame:
    """Add a struct of ``cols`` for every neighbour within ``radius`` (NULL outside the image).

    Works for ragged images too: a missing pixel is simply NULL.
    """
    span = range(-radius, radius + 1)
    if offsets is None:
        offsets = [(dx, dy) for dy in span for dx in span if (dx, dy) != (0, 0)]
    rows = sorted({dy for _, dy in offsets} | {0})
    sent = px.select("image_id", "x", F.explode(F.array(*[F.lit(dy) for dy in rows])).alias("_dy"),
                     "y", F.struct(*cols).alias("_p"), F.struct(*px.columns).alias("_c"))
    # A pixel at y is the neighbour "dy" of the row y - dy; the whole row is only kept for dy = 0.
    sent = sent.select("image_id", "x", (F.col("y") - F.col("_dy")).alias("_row"), "_dy", "_p",
                       F.when(F.col("_dy") == 0, F.col("_c")).alias("_c"))
    columns = sent.repartition("image_id", "_row").groupBy("image_id", "_row", "x").agg(
        F.first("_c", ignorenulls=True).alias("_here"), *[
            F.first(F.when(F.col("_dy") == dy, F.col("_p")), ignorenulls=True).alias(f"_v{i}")
            for i, dy in enumerate(rows)])
    along = Window.partitionBy("image_id", "_row").orderBy("x")
    by_row = {dy: i for i, dy in enumerate(rows)}
    packed = F.struct("x", *[f"_v{i}" for i in range(len(rows))])
    reach = {-1: max([-dx for dx, _ in offsets if dx < 0], default=0), 1: max([dx for dx, _ in offsets if dx > 0], default=0)}
    near = columns.select("*", *[
        (F.lag if side < 0 else F.lead)(packed, k).over(along).alias(f"_t{'m' if side < 0 else 'p'}{k}")
        for side, far in reach.items() for k in range(1, far + 1)])
    # Gaps make a position come earlier in the row, never later.
    shifted = near.select("_here", *[f"_v{i}" for i in range(len(rows))], *[
        F.coalesce(*[F.when(F.col(f"_t{s}{k}.x") == F.col("x") + dx, F.col(f"_t{s}{k}")) for k in range(1, abs(dx) + 1)])
        .alias(f"_h_{s}{abs(dx)}")
        for dx in sorted({dx for dx, _ in offsets} - {0}) for s in ("m" if dx < 0 else "p",)])
    out = [F.col(f"_here.{n}").alias(n) for n in px.columns]
    for dx, dy in offsets:
        base = f"_v{by_row[dy]}" if dx == 0 else f"_h_{'m' if dx < 0 else 'p'}{abs(dx)}._v{by_row[dy]}"
        out.append(F.col(base).alias(cell(dx, dy)))
    return shifted.filter(F.col("_here").isNotNull()).select(*out)


def neighbors(px: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """One row per pixel and existing neighbour: ``dx, dy`` and the neighbour's channels."""
    radius = max(max(abs(dx), abs(dy)) for dx, dy in offsets)
    wide = gather(px, ["r", "g", "b", "a"], radius, offsets)
    listed = F.filter(F.array(*[
        F.when(F.col(cell(dx, dy)).isNotNull(), F.struct(
            F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), *[F.col(cell(dx, dy))[v].alias(f"n_{v}") for v in "rgba"]))
        for dx, dy in offsets]), lambda v: v.isNotNull())
    return wide.select("image_id", "x", "y", F.inline(listed))


def with_cross(px: DataFrame, value: str = "v") -> DataFrame:
    """Add ``left, right, up, down`` of one column; NULL where there is no pixel."""
    both = lambda axis: F.struct(F.col(axis).alias("p"), F.col(value).alias("v"))
    out = px
    for axis, (back, ahead) in (("x", ("left", "right")), ("y", ("up", "down"))):
        out = along(out, axis, lambda rows, line: rows.withColumns(
            {"_b": F.lag(both(axis)).over(line), "_f": F.lead(both(axis)).over(line)}))
        out = out.withColumns({back: F.when(F.col("_b.p") == F.col(axis) - 1, F.col("_b.v")),
                               ahead: F.when(F.col("_f.p") == F.col(axis) + 1, F.col("_f.v"))}).drop("_b", "_f")
    return out


# --- edges -----------------------------------------------------------------------

def edge_map(px: DataFrame) -> DataFrame:
    """Central-difference luminance gradient, 0..1; borders repeat, transparent pixels count as black."""
    lum = px.withColumn("v", F.expr(f"CASE WHEN a = 0 THEN 0E0 ELSE {c.luminance601()} END"))
    steep = with_cross(lum).withColumn("edge", F.expr(
        "LEAST(1E0, sqrt(pow(coalesce(right, v) - coalesce(left, v), 2) "
        "+ pow(coalesce(down, v) - coalesce(up, v), 2)) / 255E0)"))
    return steep.select(*px.columns, "edge")


def sprite_edges(px: DataFrame) -> DataFrame:
    """Largest luminance step to a 4-neighbour; 1 at the border or next to transparency."""
    lum = px.withColumn("v", F.expr(f"CASE WHEN a > 0 THEN {c.luminance601()} END"))
    sides = ["left", "right", "up", "down"]
    worst = ", ".join(f"coalesce(abs(v - {s}) / 255E0, 1E0)" for s in sides)
    return with_cross(lum).withColumn("edge", F.expr(
        f"CASE WHEN a = 0 THEN 0E0 ELSE GREATEST({worst}) END")).select(*px.columns, "edge")


def transition_edges(px: DataFrame) -> DataFrame:
    """``ex`` and ``ey``: change against the left and the upper pixel, each smoothed
    by a median of three across the direction of change."""
    pixel = F.struct("x", "y", "r", "g", "b", "a")
    here = ("r", "g", "b", "a")
    before = tuple(f"_q.{v}" for v in here)

    def difference(axis):
        return F.expr(f"CASE WHEN _q.{axis} = {axis} - 1 THEN {c.edge_difference(before, here)} ELSE 0E0 END")

    def median(frame, value, window, axis):
        both = F.struct(F.col(axis).alias("p"), F.col(value).alias("v"))
        frame = frame.withColumns({"_b": F.lag(both).over(window), "_f": F.lead(both).over(window)})
        frame = frame.withColumn("_b", F.when(F.col("_b.p") == F.col(axis) - 1, F.col("_b.v")).otherwise(F.col(value)))
        frame = frame.withColumn("_f", F.when(F.col("_f.p") == F.col(axis) + 1, F.col("_f.v")).otherwise(F.col(value)))
        middle = F.expr(f"GREATEST(LEAST(_b, _f), LEAST({value}, GREATEST(_b, _f)))")
        return frame.withColumn(value, middle).drop("_b", "_f")

    def build(rows, line, down):
        out = rows.withColumn("_q", F.lag(pixel).over(down)).withColumn("ey", difference("y"))
        out = out.withColumn("_q", F.lag(pixel).over(line)).withColumn("ex", difference("x")).drop("_q")
        return median(median(out, "ey", line, "x"), "ex", down, "y")

    return within_tiles(px, build).select(*px.columns, "ey", "ex")


def dark_runs(px: DataFrame, lightness: float = 5.0) -> DataFrame:
    """Length of the horizontal and vertical dark run through every dark pixel."""
    dark = px.filter("a > 0").filter(F.expr(c.rgb_to_lab()[0]) < lightness).select("image_id", "x", "y")
    return run_lengths(run_lengths(dark, "x", "run_h"), "y", "run_v")


# --- filters -----------------------------------------------------------------------

def _ring_array(fields: list[str], ring=RING) -> Column:
    """Existing ring neighbours in scan order as an array of structs with dx and dy."""
    items = [F.when(F.col(cell(dx, dy)).isNotNull(), F.struct(
        F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), *[F.col(cell(dx, dy))[f].alias(f) for f in fields]))
        for dx, dy in ring]
    return F.filter(F.array(*items), lambda v: v.isNotNull())


def sharpen(px: DataFrame, strength: int, threshold: int) -> DataFrame:
    """Alpha-weighted 3x3 unsharp mask that only moves toward an existing neighbour colour."""
    require(0 <= strength <= 200, "strength must be 0..200")
    require(0 <= threshold <= 64, "threshold must be 0..64")
    if strength == 0:
        return px.select(*PIXEL)
    offsets = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    wide = gather(px, ["r", "g", "b", "a"])
    kernel = {(dx, dy): (2 - abs(dx)) * (2 - abs(dy)) for dx, dy in offsets}

    # Outside the canvas the nearest border pixel is repeated, so an absent
    # neighbour falls back to the pixel on the same row or column, then to itself.
    def clamped(dx, dy):
        me = F.struct("r", "g", "b", "a")
        chain = [F.col(cell(dx, dy))] if (dx, dy) != (0, 0) else []
        if dx and dy:
            chain += [F.col(cell(dx, 0)), F.col(cell(0, dy))]
        return F.coalesce(*chain, me)
    samples = F.struct(*[clamped(*o)[v].cast("double").alias(f"{v}{i}") for i, o in enumerate(offsets) for v in "rgba"])
    amount, middle, weight = strength / 100, offsets.index((0, 0)), [kernel[o] for o in offsets]

    @F.pandas_udf("r INT, g INT, b INT")
    def move(cells: pd.DataFrame) -> pd.DataFrame:
        near = [[cells[f"{v}{i}"].to_numpy(dtype=float) for v in "rgb"] for i in range(len(offsets))]
        alpha = [cells[f"a{i}"].to_numpy(dtype=float) for i in range(len(offsets))]
        own, a = near[middle], alpha[middle]
        shown = a > 0
        w = np.where(shown, sum(k * v for k, v in zip(weight, alpha)), 1.0)
        d = [np.where(shown, own[c] - sum(p[c] * k * v for p, k, v in zip(near, weight, alpha)) / w, 0.0) for c in range(3)]
        wanted = [v * amount for v in d]
        square = wanted[0] * wanted[0] + wanted[1] * wanted[1] + wanted[2] * wanted[2]
        best, to = np.full(len(a), np.inf), [v.copy() for v in own]
        for p, v in zip(near, alpha):  # of equals the first in scan order stays
            step = [p[c] - own[c] for c in range(3)]
            length = step[0] * step[0] + step[1] * step[1] + step[2] * step[2]
            dot = wanted[0] * step[0] + wanted[1] * step[1] + wanted[2] * step[2]
            toward = (v * 2 >= a) & (length > 0) & (dot > 0) & (dot * dot >= 0.64 * square * length)
            part = np.minimum(1.0, dot / np.where(length > 0, length, 1.0))
            rest = np.floor(((wanted[0] - part * step[0]) ** 2 + (wanted[1] - part * step[1]) ** 2 + (wanted[2] - part * step[2]) ** 2) * 1e9 + 0.5)
            better = toward & (rest < best)
            best = np.where(better, rest, best)
            to = [np.where(better, np.rint(own[c] + part * step[c]), to[c]) for c in range(3)]
        moving = shown & (np.fmax(np.fmax(abs(d[0]), abs(d[1])), abs(d[2])) > threshold) & (best < np.inf)
        return pd.DataFrame({v: pd.Series(np.where(moving, to[c], np.nan)).astype("Int32") for c, v in enumerate("rgb")})
    moved = wide.select(*PIXEL, move(samples).alias("_to"))
    return moved.select("image_id", "x", "y", *[F.coalesce(f"_to.{v}", v).alias(v) for v in "rgb"], "a")


def suppress_speckles(px: DataFrame) -> DataFrame:
    """An interior pixel takes the colour at least six of its eight neighbours share."""
    canon = px.withColumn("c", F.expr(c.canonical_argb()))
    wide = gather(canon, ["c"])
    ring = [F.col(cell(*o))["c"] for o in RING]
    interior = F.lit(True)
    for v in ring:
        interior = interior & v.isNotNull()
    # A colour held by six of eight must appear among any three of them.
    votes = [(v, sum((F.when(v == w, 1).otherwise(0) for w in ring), F.lit(0))) for v in ring[:3]]
    winner = F.coalesce(*[F.when(n >= 6, v) for v, n in votes])
    out = wide.withColumn("w", F.when(interior, winner))
    return out.select("image_id", "x", "y", *[
        F.expr(f"CASE WHEN w IS NULL THEN {v} ELSE {c.channel('w', i)} END").alias(v)
        for v, i in (("r", 2), ("g", 1), ("b", 0), ("a", 3))])


def clean_grid_singletons(px: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Replace a pixel unlike all eight neighbours by the colour of an agreeing corner.

    A corner is a neighbour triple completing a 2x2 square; when two corners
    disagree the pixel stays.
    """
    require(0 <= tolerance <= 442, "tolerance must be 0..442")
    wide = gather(px, ["r", "g", "b", "a"])
    limit = tolerance * tolerance

    def similar(p, q):
        d = sum(((p[v] - q[v]) * (p[v] - q[v]) for v in "rgb"), F.lit(0))
        return (p["a"] == q["a"]) & ((p["a"] == 0) | (d <= limit))

    me = F.struct("r", "g", "b", "a")
    at = {o: F.col(cell(*o)) for o in RING}
    corners = []
    for dx, dy in ((-1, -1), (1, -1), (-1, 1), (1, 1)):
        p, q, r = at[(dx, dy)], at[(0, dy)], at[(dx, 0)]
        corners.append(F.when((p["a"] == F.col("a")) & similar(p, q) & similar(p, r) & similar(q, r), p))
    lonely = wide.withColumn("ring", F.array(*at.values())).withColumn("me", me).select(
        *PIXEL, F.filter(F.array(*corners), lambda v: v.isNotNull()).alias("corners"),
        ((F.col("a") > 0) & F.forall("ring", lambda v: v.isNotNull() & ~similar(F.col("me"), v))).alias("alone"))
    agreed = F.get("corners", F.lit(0))
    take = F.col("alone") & (F.size("corners") > 0) & F.forall("corners", lambda v: similar(F.col("agreed"), v))
    marked = lonely.withColumn("agreed", agreed).withColumn("take", take)
    return marked.select("image_id", "x", "y", *[
        F.when(F.col("take"), F.col("agreed")[v]).otherwise(F.col(v)).alias(v) for v in "rgba"])


def _lab_columns(px: DataFrame) -> DataFrame:
    return add_lab(px)


def contour_gradient(px: DataFrame) -> DataFrame:
    """Lab gradient ``gx, gy`` over same-alpha neighbours, weighted by inverse squared distance."""
    wide = gather(_lab_columns(px), ["a", "lab_l", "lab_a", "lab_b"])
    sums = {n: F.lit(0.0) for n in ("gx", "gy", "wx", "wy")}
    for dx, dy in RING:
        near = cell(dx, dy)
        d = F.expr(f"pow(lab_l - {near}.lab_l, 2) + pow(lab_a - {near}.lab_a, 2) + pow(lab_b - {near}.lab_b, 2)")
        same = F.col(near)["a"] == F.col("a")
        weight = 1.0 / (dx * dx + dy * dy)
        for name, k in (("gx", dx * weight), ("gy", dy * weight)):
            sums[name] = sums[name] + F.when(same, d * k).otherwise(0.0)
        sums["wx"] = sums["wx"] + F.when(same, abs(dx) * weight).otherwise(0.0)
        sums["wy"] = sums["wy"] + F.when(same, abs(dy) * weight).otherwise(0.0)
    wide = wide.select(*px.columns, "lab_l", "lab_a", "lab_b", *[v.alias(n) for n, v in sums.items()])
    shown = F.col("a") > 0
    return wide.select(*px.columns, "lab_l", "lab_a", "lab_b", *[
        F.when(shown & (F.col(w) > 0), F.col(g) / F.col(w)).otherwise(0.0).alias(g) for g, w in (("gx", "wx"), ("gy", "wy"))])


CONTOUR = {"window": 3, "similar": 12.0, "min_pixel": 30.0, "min_neighbor": 10.0, "min_similar": 2,
           "agreement": 0.5, "opposition": 0.5, "protect_details": False}


def contour_options(**options) -> dict:
    o = {**CONTOUR, **options}
    require(o["window"] in range(3, 16, 2), "window must be an odd number 3..15")
    require(0 <= o["similar"] <= 100, "similar colour distance must be 0..100")
    require(0 <= o["min_pixel"] <= 20000 and 0 <= o["min_neighbor"] <= 20000, "gradients must be 0..20000")
    require(1 <= o["min_similar"] <= 224, "similar neighbour count must be 1..224")
    require(0 <= o["agreement"] <= 1 and 0 <= o["opposition"] <= 1, "agreement and opposition must be 0..1")
    return o


def contour_candidates(px: DataFrame, **options) -> DataFrame:
    """Pixels whose strong gradient opposes the mean direction of similar neighbours.

    Only pixels above the gradient limits enter the window search.
    """
    o = contour_options(**options)
    radius = o["window"] // 2
    if o["protect_details"]:
        details = protected_details(px)
    strong = contour_gradient(px).filter("a > 0").withColumn("len", F.expr("sqrt(gx * gx + gy * gy)"))
    # Written once: both sides of the window join need the same gradients.
    strong = cut_lineage(strong.filter(F.col("len") > 1e-9))
    voters = strong.filter(F.col("len") >= o["min_neighbor"]).selectExpr(
        "image_id", "x", "y", "a", "lab_l", "lab_a", "lab_b", "gx / len AS ux", "gy / len AS uy")
    centers = strong.filter(F.col("len") >= o["min_pixel"]).select(
        "image_id", "x", "y", "a", "lab_l", "lab_a", "lab_b", "gx", "gy", "len")
    if o["protect_details"]:
        centers = centers.join(details, ["image_id", "x", "y"], "left_anti")
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                        for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dx or dy])
    reach = centers.select("*", F.inline(offsets)).withColumn("nx", F.expr("x + dx")).withColumn("ny", F.expr("y + dy"))
    votes = voters.select("image_id", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("a").alias("va"),
                          *[F.col(f"lab_{v}").alias(f"v_{v}") for v in "lab"], "ux", "uy")
    near = reach.join(votes, ["image_id", "nx", "ny"]).filter(
        F.expr(f"a = va AND pow(lab_l - v_l, 2) + pow(lab_a - v_a, 2) + pow(lab_b - v_b, 2) <= {c.num(o['similar'] ** 2)}"))
    common = near.groupBy("image_id", "x", "y").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ux").alias("cx"), F.sum("uy").alias("cy"),
        F.first("gx").alias("gx"), F.first("gy").alias("gy"), F.first("len").alias("len"))
    common = common.withColumn("clen", F.expr("sqrt(cx * cx + cy * cy)"))
    return common.filter(
        (F.col("n") >= o["min_similar"]) & (F.col("clen") > 1e-9)
        & F.expr(f"clen / n >= {c.num(o['agreement'] - 1e-12)}")
        & F.expr(f"-(gx * cx + gy * cy) / (len * clen) >= {c.num(o['opposition'] - 1e-12)}")).select("image_id", "x", "y")


def protected_details(px: DataFrame) -> DataFrame:
    """Pixels on a thin same-colour line: a two-step tail or a straight middle."""
    wide = gather(px.withColumn("c", F.expr(c.pack_argb())), ["c"], 2)

    def same(dx, dy):
        return F.coalesce(F.col(cell(dx, dy))["c"] == F.col("c"), F.lit(False))
    matches = sum((same(*o).cast("int") for o in RING), F.lit(0))
    tail = F.lit(False)
    for dx, dy in RING:
        tail = tail | (same(dx, dy) & same(2 * dx, 2 * dy))
    middle = F.lit(False)
    for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1)):
        middle = middle | (same(dx, dy) & same(-dx, -dy))
    return wide.filter(((matches == 1) & tail) | ((matches <= 4) & middle)).select("image_id", "x", "y")


def contour_heatmap(px: DataFrame, **options) -> DataFrame:
    """White to red by gradient strength of the four neighbours; candidates fully red."""
    hits = contour_candidates(px, **options).withColumn("hit", F.lit(True))
    wide = gather(_lab_columns(px), ["a", "lab_l", "lab_a", "lab_b"], 1, [(-1, 0), (1, 0), (0, -1), (0, 1)])

    def step(dx, dy):
        n = cell(dx, dy)
        return (f"CASE WHEN {n}.a = a THEN pow(lab_l - {n}.lab_l, 2) + pow(lab_a - {n}.lab_a, 2) "
                f"+ pow(lab_b - {n}.lab_b, 2) ELSE 0E0 END")
    wide = wide.withColumn("h", F.expr(f"{step(-1, 0)} + {step(1, 0)}")).withColumn(
        "w", F.expr(f"{step(0, -1)} + {step(0, 1)}"))
    heat = wide.select(*PIXEL, F.expr("LEAST(4.5E-1, sqrt(h * h + w * w) / 6400E0 * 4.5E-1)").alias("s"))
    heat = heat.join(hits, ["image_id", "x", "y"], "left").withColumn(
        "s", F.when(F.col("hit"), F.lit(1.0)).otherwise(F.col("s")))
    other = "CASE WHEN a = 0 THEN 0 ELSE CAST(bround(255E0 * (1E0 - s), 0) AS INT) END"
    return heat.select("image_id", "x", "y", F.expr("CASE WHEN a = 0 THEN 0 ELSE 255 END").alias("r"),
                       F.expr(other).alias("g"), F.expr(other).alias("b"), "a")


#: What votes need of a pixel and its neighbours.
_CELL = ("rgb", "a", "lab_l", "lab_a", "lab_b")


def _packed_cells(offsets: list[tuple[int, int]]) -> Column:
    """One struct of ``_CELL`` values of all cells, for an Arrow batch function."""
    return F.struct(*[(F.col(n) if (dx, dy) == (0, 0) else F.col(cell(dx, dy))[n]).cast("double").alias(f"{n}{k}")
                      for k, (dx, dy) in enumerate(offsets) for n in _CELL])


def _cells_of(cells: pd.DataFrame, count: int):
    """``rgb, a, lab`` as lists by cell; what does not exist is NaN."""
    values = [[cells[f"{n}{k}"].to_numpy(dtype=float) for n in _CELL] for k in range(count)]
    return [v[0] for v in values], [v[1] for v in values], [np.stack(v[2:]) for v in values]


def _square(p, q):
    return (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2


def local_delta(px: DataFrame, delta: float = 8.0, radius: int = 1, protect_details: bool = False,
                passes: int = 1) -> DataFrame:
    """Replace a pixel by the weighted majority colour around it, within ``delta`` of the original.

    Candidates are same-alpha neighbours; without a majority the member nearest
    the weighted mean is taken.  Every pass measures against the original
    colours, so changes cannot drift.
    """
    require(0 <= delta <= 100, "delta must be 0..100")
    require(1 <= radius <= 5, "radius must be 1..5")
    require(passes >= 1, "at least one pass")
    current = px.select(*PIXEL)
    keep = None
    if protect_details:
        keep = stable_patches(px).unionByName(thin_lines(px, delta)).distinct().withColumn("keep", F.lit(True))
    original = _lab_columns(px).select("image_id", "x", "y", *[F.col(f"lab_{v}").alias(f"o_{v}") for v in "lab"])
    for step in range(passes):
        if step:
            current = cut_lineage(current)
        current = _local_vote(current, original, keep, delta, radius)
    return current


def _local_vote(px: DataFrame, original: DataFrame, keep: DataFrame | None, delta: float, radius: int) -> DataFrame:
    sigma = max(1.0, radius * 0.8)
    span = range(-radius, radius + 1)
    base = _lab_columns(px).withColumn("rgb", F.expr(c.pack_rgb())).join(original, ["image_id", "x", "y"])
    wide = gather(base, ["rgb", "a", "lab_l", "lab_a", "lab_b"], radius)
    around = [(dx, dy) for dy in span for dx in span]
    middle, share = around.index((0, 0)), [math.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma)) for dx, dy in around]

    @F.pandas_udf("double")
    def vote(cells: pd.DataFrame, l: pd.Series, a_: pd.Series, b: pd.Series) -> pd.Series:
        rgb, a, lab = _cells_of(cells, len(around))
        first = np.stack([v.to_numpy(dtype=float) for v in (l, a_, b)])
        own, size = rgb[middle], len(l)
        w = [np.where((a[k] == a[middle]) & (_square(first, lab[k]) <= delta * delta + 1e-10), share[k], 0.0) for k in range(len(around))]
        total = sum(w)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.stack([sum(np.where(w[k] > 0, lab[k][v] * w[k], 0.0) for k in range(len(around))) / total for v in range(3)])
        low, high = np.full(size, np.inf), np.full(size, -np.inf)
        top, top_own, top_rgb = np.full(size, -1.0), np.zeros(size, dtype=bool), np.full(size, np.nan)
        near, near_own, near_rgb = np.full(size, np.inf), np.zeros(size, dtype=bool), np.full(size, np.nan)
        for k in range(len(around)):  # of equals the first in scan order stays
            member, mine = w[k] > 0, rgb[k] == own
            low, high = np.where(member, np.minimum(low, rgb[k]), low), np.where(member, np.maximum(high, rgb[k]), high)
            weight = np.floor(sum(np.where(rgb[j] == rgb[k], w[j], 0.0) for j in range(len(around))) * 1e9 + 0.5)
            better = member & ((weight > top) | ((weight == top) & mine & ~top_own))
            top, top_own, top_rgb = np.where(better, weight, top), np.where(better, mine, top_own), np.where(better, rgb[k], top_rgb)
            d = np.floor(_square(lab[k], mean) * 1e9 + 0.5)
            better = member & ((d < near) | ((d == near) & mine & ~near_own))
            near, near_own, near_rgb = np.where(better, d, near), np.where(better, mine, near_own), np.where(better, rgb[k], near_rgb)
        chosen = np.where(top >= np.floor(total * 0.5 * 1e9 + 0.5), top_rgb, near_rgb)
        return pd.Series(np.where((a[middle] != 0) & (low < high), chosen, np.nan))
    wide = wide.select(*PIXEL, vote(_packed_cells(around), "o_l", "o_a", "o_b").cast(base.schema["rgb"].dataType).alias("_vote"))
    chosen = F.col("_vote")
    if keep is not None:
        wide = wide.join(keep, ["image_id", "x", "y"], "left")
        chosen = F.when(F.col("keep").isNull(), chosen)
    wide = wide.withColumn("new", chosen)
    return wide.select("image_id", "x", "y", *[
        F.expr(f"CASE WHEN new IS NULL THEN {v} ELSE {c.channel('new', i)} END").alias(v)
        for v, i in (("r", 2), ("g", 1), ("b", 0))], "a")


def stable_patches(px: DataFrame) -> DataFrame:
    """Visible pixels inside some 3x3 patch of one exact colour."""
    wide = gather(px.withColumn("c", F.expr(c.pack_argb())), ["c"])
    solid = F.lit(True)
    for o in RING:
        solid = solid & F.coalesce(F.col(cell(*o))["c"] == F.col("c"), F.lit(False))
    centers = wide.filter(solid & (F.col("a") > 0)).select("image_id", "x", "y")
    spread = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in [(0, 0), *RING]])
    return (centers.select("image_id", "x", "y", F.inline(spread))
            .selectExpr("image_id", "x + dx AS x", "y + dy AS y").distinct())


def thin_lines(px: DataFrame, delta: float) -> DataFrame:
    """Pixels on, or attached to, a ridge one pixel wide of nearly equal colour."""
    tolerance = min(0.75, delta * 0.2) ** 2 + 1e-10
    wide = gather(_lab_columns(px), ["a", "lab_l", "lab_a", "lab_b"], 2)

    def similar(dx, dy):
        n = cell(dx, dy)
        return F.coalesce(F.expr(
            f"{n}.a = a AND pow(lab_l - {n}.lab_l, 2) + pow(lab_a - {n}.lab_a, 2) + pow(lab_b - {n}.lab_b, 2) "
            f"<= {c.num(tolerance)}"), F.lit(False))

    lines = [((-1, 0), (1, 0), (0, -1), (0, 1)), ((0, -1), (0, 1), (-1, 0), (1, 0)),
             ((-1, -1), (1, 1), (1, -1), (-1, 1)), ((1, -1), (-1, 1), (-1, -1), (1, 1))]

    def at(px_, py_, d):
        x, y = px_ + d[0], py_ + d[1]
        return F.lit(True) if (x, y) == (0, 0) else similar(x, y)

    def ridge(ox, oy):
        found = F.lit(False)
        for on1, on2, off1, off2 in lines:
            found = found | (at(ox, oy, on1) & at(ox, oy, on2) & ~at(ox, oy, off1) & ~at(ox, oy, off2))
        return found
    thin = ridge(0, 0)
    for o in RING:
        thin = thin | (similar(*o) & ridge(*o))
    return wide.filter((F.col("a") > 0) & thin).select("image_id", "x", "y")


# --- material maps -------------------------------------------------------------------

def _ao_samples(radius: int) -> list[tuple[int, int, int, float]]:
    """Eight directions, four steps: (direction, dx, dy, slope scale)."""
    out = []
    for direction in range(8):
        angle = direction * math.pi / 4
        for step in range(1, 5):
            reach = max(1, round(radius * step / 4))
            dx, dy = round(math.cos(angle) * reach), round(math.sin(angle) * reach)
            out.append((direction, dx, dy, radius / math.sqrt(dx * dx + dy * dy)))
    return out


def material_maps(px: DataFrame, normal_strength: float = 4.0, ao_strength: float = 1.0, ao_radius: int = 4) -> DataFrame:
    """Height, unit normal (+Y up) and ambient occlusion of every pixel.

    Far samples are fetched by exact offset: the row scatter covers only the
    image rows the sample pattern touches.
    """
    require(0 <= normal_strength <= 32, "normal strength must be 0..32")
    require(0 <= ao_strength <= 16, "ambient occlusion strength must be 0..16")
    require(1 <= ao_radius <= 64, "ambient occlusion radius must be 1..64")
    samples = _ao_samples(ao_radius)
    cross = [(-1, 0), (1, 0), (0, -1), (0, 1)]
    offsets = sorted({(dx, dy) for _, dx, dy, _ in samples} | set(cross))
    radius = max(max(abs(dx), abs(dy)) for dx, dy in offsets)
    high = px.withColumn("height", F.expr(c.relief_height()))
    wide = gather(high, ["height", "a"], radius, offsets)

    def level(dx, dy):
        n = cell(dx, dy)
        return f"CASE WHEN {n}.a > 0 THEN {n}.height ELSE height END"
    # A missing neighbour beyond the canvas repeats the border pixel, i.e. this one.
    nx = f"(-(({level(1, 0)}) - ({level(-1, 0)})) * 5E-1 * {c.num(normal_strength)})"
    ny = f"((({level(0, 1)}) - ({level(0, -1)})) * 5E-1 * {c.num(normal_strength)})"
    horizons = []
    for direction in range(8):
        slopes = []
        for d, dx, dy, scale in samples:
            if d == direction:
                n = cell(dx, dy)
                slopes.append(f"CASE WHEN {n}.a > 0 THEN GREATEST(0E0, {n}.height - height) * {c.num(scale)} ELSE 0E0 END")
        horizons.append(f"GREATEST({', '.join(slopes)})")
    wide = wide.select(*PIXEL, "height", F.expr(nx).alias("sx"), F.expr(ny).alias("sy"),
                       F.expr(f"array({', '.join(horizons)})").alias("slopes"))
    wide = wide.withColumn("len", F.expr("sqrt(sx * sx + sy * sy + 1E0)")).withColumn(
        "occlusion", F.expr("aggregate(slopes, 0E0, (t, s) -> t + s / sqrt(1E0 + s * s))"))
    return wide.selectExpr(
        *PIXEL, "height", "CASE WHEN a > 0 THEN sx / len ELSE 0E0 END AS nx",
        "CASE WHEN a > 0 THEN sy / len ELSE 0E0 END AS ny", "CASE WHEN a > 0 THEN 1E0 / len ELSE 1E0 END AS nz",
        f"CASE WHEN a > 0 THEN LEAST(1E0, GREATEST(0E0, 1E0 - occlusion / 8E0 * {c.num(ao_strength)})) ELSE 1E0 END AS ao")


def _byte(value: str) -> str:
    return c.clamp_byte(c.round_half_even(f"({value}) * 255E0"))


def map_pixels(maps: DataFrame, kind: str, convention: str = "opengl") -> DataFrame:
    """Byte encoding of one map; the DirectX convention flips green."""
    require(kind in ("height", "normal", "ao"), "kind must be height, normal or ao")
    require(convention in ("opengl", "directx"), "convention must be opengl or directx")
    if kind == "normal":
        flip = "-ny" if convention == "directx" else "ny"
        parts = ["nx * 5E-1 + 5E-1", f"({flip}) * 5E-1 + 5E-1", "nz * 5E-1 + 5E-1"]
    else:
        parts = ["height" if kind == "height" else "ao"] * 3
    return maps.select("image_id", "x", "y", *[F.expr(_byte(e)).alias(v) for v, e in zip("rgb", parts)], "a")


def material_blend(generated: DataFrame, layer: DataFrame) -> DataFrame:
    """Blend a painted layer into generated maps.

    ``layer`` has ``layer_nx, layer_ny, layer_nz, normal_mask, layer_ao, ao_mask``
    per pixel; normals are interpolated and renormalised, occlusion linearly.
    """
    both = generated.join(layer, ["image_id", "x", "y"], "left")
    both = both.fillna(0.0, subset=["normal_mask", "ao_mask"])
    for v in "xyz":
        both = both.withColumn(f"b{v}", F.expr(f"n{v} + coalesce(layer_n{v} - n{v}, 0E0) * normal_mask"))
    both = both.withColumn("blen", F.expr("sqrt(bx * bx + by * by + bz * bz)"))
    return both.selectExpr(*PIXEL, "height", *[f"CASE WHEN blen > 0 THEN b{v} / blen ELSE n{v} END AS n{v}" for v in "xyz"],
                           "ao + coalesce(layer_ao - ao, 0E0) * ao_mask AS ao")


def lit_pixels(maps: DataFrame, light: tuple[float, float, float], use_normal: bool = True,
               use_ao: bool = True, unlit: bool = False) -> DataFrame:
    """Shade in linear light: a quarter of the occlusion plus 0.85 of the diffuse term."""
    length = math.sqrt(sum(v * v for v in light))
    require(length > 1e-3, "light direction must not be zero")
    lx, ly, lz = (v / length for v in light)
    dot = f"nx * {c.num(lx)} + ny * {c.num(ly)} + nz * {c.num(lz)}" if use_normal else c.num(lz)
    shade = "1E0" if unlit else f"({'ao' if use_ao else '1E0'} * 2.5E-1 + 8.5E-1 * GREATEST(0E0, {dot}))"
    lit = maps.withColumn("shade", F.expr(shade))

    def shaded(v):
        linear = f"({c.srgb_to_linear(v)} * shade)"
        srgb = f"(CASE WHEN {linear} <= 3.1308E-3 THEN {linear} * 12.92E0 ELSE 1.055E0 * pow({linear}, 1E0 / 2.4E0) - 5.5E-2 END)"
        return _byte(srgb)
    return lit.select("image_id", "x", "y", *[F.expr(shaded(v)).alias(v) for v in "rgb"], "a")


# --- local consensus and patterns ------------------------------------------------------

def local_consensus(px: DataFrame, tolerance: float = 12.0, strength: float = 0.5) -> DataFrame:
    """Proposals of one simultaneous clean-up pass with their cost gain.

    Every neighbour colour within the tolerance is tried against the pixel's own;
    cost = anchor * distance^2 + sum of weighted, capped distances to the ring.
    Applying proposals at once could swap colours back and forth, so they are
    only reported; ``apply_consensus`` applies them once per call.
    """
    require(0 <= tolerance <= 40, "tolerance must be 0..40")
    require(0 <= strength <= 1, "strength must be 0..1")
    cap, anchor = tolerance * tolerance, 1 + (1 - strength) * 8
    margin = max(0.0001, cap * 0.002 * (1 - strength))
    wide = gather(_lab_columns(px).withColumn("rgb", F.expr(c.pack_rgb())), list(_CELL)).filter("a > 0")

    @F.pandas_udf("rgb DOUBLE, gain DOUBLE")
    def propose(cells: pd.DataFrame) -> pd.DataFrame:
        rgb, a, lab = _cells_of(cells, len(RING) + 1)
        ring = [(k, a[k] / 255 * (0.7 if dx and dy else 1.0)) for k, (dx, dy) in enumerate(RING, 1)]
        ring = [(k, np.where(a[k] > 0, w, 0.0)) for k, w in ring]
        total = sum(w for _, w in ring)
        hold = (anchor + a[0] / 255) * total / 6.8

        def cost(at):
            pull = np.zeros(len(total))
            for k, w in ring:
                pull += w * np.fmin(_square(at, lab[k]), cap)
            return hold * _square(at, lab[0]) + pull
        best, color = np.full(len(total), np.inf), np.full(len(total), np.nan)
        for k, _ in ring:
            price = np.floor(cost(lab[k]) * 1e9 + 0.5) / 1e9
            open_ = (a[k] > 0) & (rgb[k] != rgb[0]) & (_square(lab[k], lab[0]) <= cap)
            better = open_ & ((price < best) | ((price == best) & (rgb[k] < color)))
            best, color = np.where(better, price, best), np.where(better, rgb[k], color)
        base = cost(lab[0])
        moves = (sum((a[k] > 0).astype(int) for k, _ in ring) >= 2) & (best < base - margin)
        return pd.DataFrame({"rgb": np.where(moves, color, np.nan), "gain": np.where(moves, base - np.where(moves, best, 0), np.nan)})
    found = wide.select("image_id", "x", "y", "rgb", propose(_packed_cells([(0, 0), *RING])).alias("_m"))
    return found.filter("_m.rgb IS NOT NULL").select(
        "image_id", "x", "y", "rgb", F.col("_m.rgb").cast(found.schema["rgb"].dataType).alias("new_rgb"), F.col("_m.gain").alias("gain"))


def apply_consensus(px: DataFrame, tolerance: float = 12.0, strength: float = 0.5) -> DataFrame:
    moves = local_consensus(px, tolerance, strength).select("image_id", "x", "y", "new_rgb")
    both = px.join(moves, ["image_id", "x", "y"], "left")
    return both.select("image_id", "x", "y", *[
        F.expr(f"CASE WHEN new_rgb IS NULL THEN {v} ELSE {c.channel('new_rgb', i)} END").alias(v)
        for v, i in (("r", 2), ("g", 1), ("b", 0))], "a")


def patch_pattern_counts(px: DataFrame, radius: int = 1, lightness: float = 5.0) -> DataFrame:
    """How often every neighbourhood pattern surrounds a bright and a dark pixel.

    A pattern is one digit per neighbour in scan order: 0 transparent, 1 dark, 2 bright.
    """
    require(1 <= radius <= 3, "radius must be 1..3")
    kind = px.withColumn("k", F.expr(
        f"CASE WHEN a = 0 THEN '0' WHEN {c.rgb_to_lab()[0]} < {c.num(lightness)} THEN '1' ELSE '2' END"))
    wide = gather(kind, ["k"], radius)
    span = range(-radius, radius + 1)
    ring = [F.col(cell(dx, dy))["k"] for dy in span for dx in span if dx or dy]
    keyed = wide.filter("a > 0").select("image_id", "k", F.concat(*ring).alias("pattern")).filter("pattern IS NOT NULL")
    return keyed.groupBy("image_id", "pattern").agg(
        F.count_if(F.col("k") == "2").alias("bright"), F.count_if(F.col("k") == "1").alias("dark"))
