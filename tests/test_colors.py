"""Colour arithmetic against plain Python and hand-computed values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasmill.functions.nearest import ColorTree, _ticks
from atlasmill.functions import color as c
from atlasmill.functions import palettes, registry
from atlasmill.operators import palette as pal
from conftest import pixels


def lab(r, g, b):
    lin = [v / 255 / 12.92 if v / 255 <= 0.04045 else ((v / 255 + 0.055) / 1.055) ** 2.4 for v in (r, g, b)]
    xyz = [sum(k * v for k, v in zip(row[:3], lin)) / row[3] for row in c.XYZ_ROWS]
    f = [t ** (1 / 3) if t > 0.008856 else 7.787 * t + 16 / 116 for t in xyz]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def value(spark, expr, **columns):
    row = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
    return row.select(F.expr(expr).alias("v")).head().v


@pytest.mark.parametrize("rgb", [(0, 0, 0), (255, 255, 255), (12, 200, 97), (255, 0, 3)])
def test_lab(spark, rgb):
    got = [value(spark, e, r=rgb[0], g=rgb[1], b=rgb[2]) for e in c.rgb_to_lab()]
    assert got == pytest.approx(lab(*rgb), abs=1e-9)


def test_oklab_white_is_one(spark):
    got = [value(spark, e, r=255, g=255, b=255) for e in c.rgb_to_oklab()]
    assert got == pytest.approx([1, 0, 0], abs=1e-6)


def test_transfer_curve_round_trip(spark):
    rows = spark.range(256).select(F.col("id"), F.expr(c.linear_to_srgb(c.srgb_to_linear("id"))).alias("v")).collect()
    assert all(abs(r.v - r.id) < 1e-6 for r in rows)


def test_rounding_rules(spark):
    assert value(spark, c.round_to_step("v", 2), v=5) == 4       # 2.5 goes to the even step
    assert value(spark, c.adjust_channel("v", "value", 0.5, False), v=4) == 5   # away from zero
    assert value(spark, c.adjust_channel("v", "percent", 50, True), v=255) == 128
    assert value(spark, c.monochrome(), r=255, g=255, b=255) == 255


def test_source_over_edges(spark):
    def over(src, dst):
        cols = dict(zip(("r1", "g1", "b1", "a1", "r2", "g2", "b2", "a2"), (*src, *dst)))
        parts = [c.over_channel(f"{v}1", "a1", f"{v}2", "a2") for v in "rgb"] + [c.over_alpha("a1", "a2")]
        return tuple(value(spark, e, **cols) for e in parts)
    assert over((10, 20, 30, 255), (1, 2, 3, 255)) == (10, 20, 30, 255)
    assert over((10, 20, 30, 0), (1, 2, 3, 200)) == (1, 2, 3, 200)
    assert over((10, 20, 30, 0), (1, 2, 3, 0)) == (10, 20, 30, 0)
    assert over((255, 0, 0, 128), (0, 0, 255, 255)) == (128, 0, 127, 255)


def test_seam_distance_black_white(spark):
    p, q = tuple("abcd"), tuple("efgh")
    cols = dict(zip("abcdefgh", (0, 0, 0, 255, 255, 255, 255, 255)))
    assert value(spark, c.seam_distance(p, q), **cols) == pytest.approx(100, abs=1e-3)
    hidden = dict(zip("abcdefgh", (9, 9, 9, 0, 200, 10, 0, 0)))
    assert value(spark, c.seam_distance(p, q), **hidden) == 0


def test_saturation_and_contrast_of_grey(spark):
    assert value(spark, c.saturation_weight(), r=80, g=80, b=80) == 0
    assert value(spark, c.saturation_weight(), r=0, g=0, b=0) == 0
    assert value(spark, c.contrast_weight(), r=0, g=0, b=0) == 0.5


def test_hex(spark):
    assert value(spark, c.rgb_hex(), r=1, g=171, b=255) == "#01ABFF"
    for bad in ("#12345", "123456", "#12345G", "#1234567"):
        assert value(spark, c.parse_hex_color("t"), t=bad) is None


def test_sql_functions_agree_with_columns(spark):
    names = registry.register_functions(spark)
    assert len(names) >= 20
    row = spark.sql("SELECT pack_rgb(1, 2, 3) AS p, rgb_to_lab(12, 200, 97) AS lab, source_over(255,0,0,128, 0,0,255,255) AS o").head()
    assert row.p == 0x010203 and row.o.r == 128
    assert tuple(row.lab) == pytest.approx(lab(12, 200, 97), abs=1e-9)


def test_palette_checks():
    assert palettes.fixed_palette("DB16")[0] == 0x140C1C
    for bad in ([], [-1], [0x1000000], ["red"]):
        with pytest.raises(ValueError):
            palettes.custom_palette(bad)
    with pytest.raises(ValueError):
        palettes.fixed_palette("rainbow")


def test_nearest_matches_exhaustive_search(spark):
    grid = [(r, g, b) for r in range(0, 256, 51) for g in range(0, 256, 51) for b in range(0, 256, 85)]
    px = spark.createDataFrame([(1, i, 0, *v, 255) for i, v in enumerate(grid)], "image_id BIGINT, x INT, y INT, r INT, g INT, b INT, a INT")
    for colors in (palettes.DB16, palettes.DB16[:3], [g << 16 | r << 8 | b for r, g, b in grid] + list(palettes.DB16)):
        expected = {}
        for i, v in enumerate(grid):
            d = [(math.floor(math.dist(lab(*v), lab(p >> 16, p >> 8 & 255, p & 255)) ** 2 * 1e9 + 0.5), k) for k, p in enumerate(colors)]
            expected[i] = colors[min(d)[1]]
        got = pixels(pal.nearest_palette(px, colors))
        assert {x: r << 16 | g << 8 | b for (_, x, _), (r, g, b, _) in got.items()} == expected


@pytest.mark.parametrize("k", [1, 16, 17, 300, 4096])
def test_color_tree_matches_exhaustive_search(k):
    rng = np.random.default_rng(k)
    # a coarse grid, so that many entries are equal or equally far
    entries, queries = rng.integers(0, 9, (k, 3)) * 4.0, rng.integers(0, 17, (1500, 3)) * 2.0
    entry, ticks = ColorTree(entries).nearest(queries)
    for at in range(0, len(queries), 100):
        d = _ticks(((queries[at:at + 100, None] - entries[None]) ** 2).sum(-1))
        assert (entry[at:at + 100] == d.argmin(1)).all() and (ticks[at:at + 100] == d.min(1)).all()


def median_cut_colors(counts, k):
    """Palette members by cutting the box with the widest channel k - 1 times."""
    boxes, order = {0: list(counts)}, 1
    while order < k:
        best = None
        for box, members in boxes.items():
            for c in range(3):
                span = max(m[c] for m in members) - min(m[c] for m in members)
                if len(members) > 1 and (best is None or (span, -box, -c) > best[0]):
                    best = (span, -box, -c), box, c
        if best is None:
            break
        members = sorted(boxes.pop(best[1]), key=lambda m: (m[best[2]], m))
        half = max(1, len(members) // 2)
        boxes[2 * order], boxes[2 * order + 1] = members[:half], members[half:]
        order += 1
    return sorted(map(len, boxes.values())), {m: box for box, members in boxes.items() for m in members}


@pytest.mark.parametrize("k", [2, 7, 40, 256])
def test_median_cut_boxes_match_brute_force(spark, k):
    import random
    rng = random.Random(k)
    colors = {i: [(rng.choice([0, 10, 20, 200]), rng.randrange(256), rng.randrange(0, 256, 9)) for _ in range(350)] for i in range(3)}
    colors[3] = [(1, 2, 3)]
    rows = [(i, n, 0, *v, 255) for i, own in colors.items() for n, v in enumerate(own)]
    px = spark.createDataFrame(rows, "image_id BIGINT, x INT, y INT, r INT, g INT, b INT, a INT")
    got = {}
    for r in pal.median_cut_boxes(px, k).select("image_id", "rgb", "box").collect():
        got.setdefault(r.image_id, {})[(r.rgb >> 16, r.rgb >> 8 & 255, r.rgb & 255)] = r.box
    for i, own in colors.items():
        assert got[i] == median_cut_colors(dict.fromkeys(own), k)[1]


def test_duplicate_palette_entry_takes_the_first(spark):
    px = spark.createDataFrame([(1, 0, 0, 5, 5, 5, 255)], "image_id BIGINT, x INT, y INT, r INT, g INT, b INT, a INT")
    found = pal.nearest_palette(px, [0x060606, 0x060606])
    assert pixels(found)[(1, 0, 0)] == (6, 6, 6, 255)


@pytest.mark.parametrize("method", ["kmeans_lab", "kmeans_linear", "median_cut"])
def test_quantize_invariants(spark, method):
    rows = [(i % 2, x, y, (x * 37 + i) % 256, (y * 53) % 256, (x * y) % 256, 255 if (x + y) % 5 else 0)
            for i in range(2) for x in range(12) for y in range(9)]
    px = spark.createDataFrame(rows, "image_id BIGINT, x INT, y INT, r INT, g INT, b INT, a INT")
    before, after = pixels(px), pixels(pal.quantize(px, 5, method, True))
    assert before.keys() == after.keys()
    assert all(before[k][3] == after[k][3] for k in before)
    for image_id in (0, 1):
        own = {v[:3] for k, v in before.items() if k[0] == image_id and v[3]}
        new = {v[:3] for k, v in after.items() if k[0] == image_id and v[3]}
        assert new <= own and len(new) <= 5


def test_quantize_keeps_small_palettes(spark, image):
    px = image([["ab", "ba"]], {"a": (1, 2, 3, 255), "b": (200, 9, 9, 255)})
    assert pixels(pal.quantize(px, 4)) == pixels(px)


def test_frequency_filter_reports_rejection(spark, image):
    px = image([["ab", "cd"]], {"a": (1, 2, 3, 255), "b": (200, 9, 9, 255), "c": (7, 7, 90, 255), "d": (0, 250, 0, 255)})
    out, report = pal.frequency_filter(px, 60)
    assert report.head().rejected and pixels(out) == pixels(px)
