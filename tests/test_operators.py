"""Invariants, brute force on small frames, and skewed inputs."""

import math
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from atlasmill.operators import blocks, grid, pixels as pix, quality, regions, stencil
from atlasmill.plans import recipes
from atlasmill.sources import files, images
from conftest import pixels
from test_colors import lab

SCHEMA = "image_id BIGINT, x INT, y INT, r INT, g INT, b INT, a INT"
COLORS = {"#": (0, 0, 0, 255), "o": (250, 240, 230, 255), ".": (9, 9, 9, 0), "r": (220, 30, 30, 255), "g": (30, 180, 60, 255)}


def noise(spark, width, height, seed, levels=4, images_n=1, clear=0.1):
    rnd = random.Random(seed)
    rows = [(i, x, y, *[rnd.randrange(levels) * (255 // (levels - 1)) for _ in range(3)], 0 if rnd.random() < clear else 255)
            for i in range(images_n) for y in range(height) for x in range(width)]
    return spark.createDataFrame(rows, SCHEMA)


def flood(frame, diagonal, same):
    """Brute-force regions: first scan position of every pixel's region."""
    steps = [(1, 0), (-1, 0), (0, 1), (0, -1)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    out = {}
    for start in sorted(frame, key=lambda k: (k[0], k[2], k[1])):
        if start in out:
            continue
        todo = [start]
        out[start] = start
        while todo:
            i, x, y = todo.pop()
            for dx, dy in steps:
                near = (i, x + dx, y + dy)
                if near in frame and near not in out and same(frame[(i, x, y)], frame[near]):
                    out[near] = start
                    todo.append(near)
    return {k: v[2] * regions.SCAN + v[1] for k, v in out.items()}


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("tile", [2, 5, 64])
def test_components_match_flood_fill(spark, connectivity, tile):
    px = noise(spark, 23, 17, 7, 2, 2, 0.2).filter("a > 0")
    got = {(r.image_id, r.x, r.y): r.component for r in
           regions.connected_components(px, "r * 65536 + g * 256 + b", connectivity, tile).collect()}
    assert got == flood(pixels(px), connectivity == 8, lambda p, q: p == q)


def test_spiral_is_one_component(spark):
    """A long winding region crossing many tiles."""
    n, cells, x, y, dx, dy = 21, set(), 0, 0, 1, 0
    for _ in range(n * n):
        cells.add((x, y))
        ahead, beyond = (x + dx, y + dy), (x + 2 * dx, y + 2 * dy)
        if not (0 <= ahead[0] < n and 0 <= ahead[1] < n) or beyond in cells:
            dx, dy = -dy, dx
            if (x + 2 * dx, y + 2 * dy) in cells or (x + dx, y + dy) in cells:
                break
        x, y = x + dx, y + dy
    px = spark.createDataFrame([(1, a, b, 0, 0, 0, 255) for a, b in cells], SCHEMA)
    labels = {r.component for r in regions.connected_components(px, "1", 4, 3).collect()}
    assert labels == {0}


def test_similar_components_match_flood_fill(spark):
    px = noise(spark, 14, 11, 3, 4, 1, 0.1).filter("a > 0")
    got = {(r.image_id, r.x, r.y): r.component for r in regions.connected_components(px, "a", 8, 4, 40.0).collect()}
    assert got == flood(pixels(px), True, lambda p, q: math.dist(lab(*p[:3]), lab(*q[:3])) <= 40)


def test_edge_background_stops_at_closed_outline(spark, image):
    px = image([["ooooo", "o###o", "o#o#o", "o###o", "ooooo"]], COLORS)
    out = pixels(regions.remove_background_edges(px, 0))
    assert out[(0, 0, 0)][3] == 0 and out[(0, 2, 2)][3] == 255 and out[(0, 1, 1)][3] == 255
    everywhere = pixels(pix.remove_background_global(px, 0))
    assert everywhere[(0, 2, 2)][3] == 0


def test_transparent_border_is_no_background(spark, image):
    px = image([["...", ".o.", "..."], ["...", "...", "..."]], COLORS)
    assert {r.background for r in pix.detect_background(px).collect()} == {None}
    assert pixels(pix.trim_transparent(px)) == {(0, 0, 0): COLORS["o"], (1, 0, 0): (0, 0, 0, 0)}


def test_row_order_and_partitions_do_not_matter(spark):
    px = noise(spark, 12, 9, 5, 4, 3)
    for op in (pix.dominant_color, lambda p: pix.palette(p), lambda p: blocks.block_representative(p, 3, 3),
               lambda p: stencil.sharpen(p, 100, 2), lambda p: grid.grid_vote(p, pitch=3)):
        base = sorted(map(repr, op(px).collect()))
        shuffled = px.orderBy(F.rand(1)).repartition(7)
        assert sorted(map(repr, op(shuffled).collect())) == base


def test_gather_sees_ragged_corners(spark):
    """Neighbours next to missing pixels are found from every side."""
    rows = [(1, x, y, x, y, 0, 255) for y in range(4) for x in range(5) if (x, y) not in ((3, 3), (4, 3), (2, 1))]
    px = spark.createDataFrame(rows, SCHEMA)
    have = {(r[1], r[2]) for r in rows}
    for radius in (1, 2):
        for r in stencil.gather(px, ["r", "g"], radius).collect():
            for dy in range(-radius, radius + 1):
                for dx in range(-radius, radius + 1):
                    if dx or dy:
                        near, at = r[stencil.cell(dx, dy)], (r.x + dx, r.y + dy)
                        assert (tuple(near) if near else None) == (at if at in have else None)


def test_sharpen_rules(spark, image):
    flat = image([["oooo"] * 4], COLORS)
    assert pixels(stencil.sharpen(flat, 200, 0)) == pixels(flat)
    px = noise(spark, 9, 9, 11)
    out, before = pixels(stencil.sharpen(px, 120, 3)), pixels(px)
    assert all(out[k][3] == before[k][3] for k in before)
    with pytest.raises(ValueError):
        stencil.sharpen(px, 201, 0)


def test_local_delta_two_passes_bounded(spark):
    px = noise(spark, 10, 8, 2, 6)
    before, out = pixels(px), pixels(stencil.local_delta(px, 25.0, 2, True, 2))
    assert before.keys() == out.keys()
    old = {v[:3] for v in before.values()}
    for k, v in out.items():
        assert v[3] == before[k][3] and v[:3] in old
        if v[3]:
            assert math.dist(lab(*v[:3]), lab(*before[k][:3])) <= 25 + 1e-6


def test_local_delta_against_brute_force(spark):
    px = noise(spark, 8, 7, 4, 6)
    frame, delta = pixels(px), 45.0
    expected = {}
    for (i, x, y), v in frame.items():
        votes, order, total, mean = {}, [], 0.0, [0.0] * 3
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                n = frame.get((i, x + dx, y + dy))
                if n and n[3] == v[3] and math.dist(lab(*n[:3]), lab(*v[:3])) ** 2 <= delta ** 2 + 1e-10:
                    w = math.exp(-(dx * dx + dy * dy) / 2)
                    if n[:3] not in votes:
                        order.append(n[:3])
                    votes[n[:3]] = votes.get(n[:3], 0) + w
                    total += w
                    mean = [m + w * c for m, c in zip(mean, lab(*n[:3]))]
        new = v[:3]
        if v[3] and len(order) >= 2:
            best = max(order, key=lambda k: (round(votes[k], 9), k == v[:3], -order.index(k)))
            if votes[best] >= total * .5 - 1e-12:
                new = best
            else:
                mean = [m / total for m in mean]
                new = min(order, key=lambda k: (round(math.dist(lab(*k), mean) ** 2, 9), k != v[:3], order.index(k)))
        expected[(i, x, y)] = (*new, v[3])
    assert pixels(stencil.local_delta(px, delta, 1)) == expected


def test_material_maps_flat_and_hidden(spark, image):
    px = image([["oo.", "ooo"]], COLORS)
    for r in stencil.material_maps(px).collect():
        assert (r.nx, r.ny, r.nz, r.ao) == (0, 0, 1, 1)


def test_grid_round_trip(spark):
    px = noise(spark, 8, 6, 9, 4, 2)
    big = blocks.resample_nearest(px, 40, 30)
    assert all(r.aligned for r in blocks.grid_is_aligned(big, 5).collect())
    canon = {k: v if v[3] else (0, 0, 0, 0) for k, v in pixels(px).items()}
    reduced = {k: v if v[3] else (0, 0, 0, 0) for k, v in pixels(blocks.grid_reduce(big, 5)).items()}
    assert reduced == canon
    again, cells = grid.align_to_grid(big, 5)
    assert {k: v if v[3] else (0, 0, 0, 0) for k, v in pixels(again).items()} == {
        k: v if v[3] else (0, 0, 0, 0) for k, v in pixels(big).items()}
    found = {r.image_id: r.pitch for r in grid.detect_pitch(grid.projection_profiles(big)).collect()}
    assert found == {0: 5, 1: 5}


def test_quality_self_checks(spark):
    px = blocks.resample_nearest(noise(spark, 8, 6, 21, 4, 1, 0.0), 32, 24)
    assert quality.grid_quality(px, px, 4).head().score == 100
    solid = px.select("image_id", "x", "y", *[F.lit(7).alias(v) for v in "rgb"], "a")
    assert quality.grid_quality(solid, px, 4).head().score < 20
    wrong = px.selectExpr("image_id", "x", "y", "255 - r AS r", "(g + 85) % 340 AS g", "b", "a")
    assert quality.grid_quality(wrong, px, 4).head().score < 20


def test_finalist_alpha_weighting(spark):
    rows = [(1, 0, 0, 200, 0, 0, 255), (1, 1, 0, 9, 9, 9, 0), (1, 0, 1, 100, 0, 0, 255), (1, 1, 1, 5, 5, 5, 0)]
    out = pixels(blocks.finalist_reduce(spark.createDataFrame(rows, SCHEMA), "p5", 2))
    assert out == {(1, 0, 0): (150, 0, 0, 128)}


def test_one_image_holding_most_rows(spark):
    """The same answers when one image dwarfs the others."""
    big = noise(spark, 90, 60, 31, 3, 1)
    small = noise(spark, 6, 5, 32, 3, 12).withColumn("image_id", F.col("image_id") + 1)
    both = big.unionByName(small)
    for op in (pix.top_colors, pix.color_treemap):
        whole = sorted(map(repr, op(both, 3).collect()))
        assert whole == sorted(map(repr, op(big, 3).collect() + op(small, 3).collect()))
    dense = pix.assemble_images(both, 1000).collect()
    assert sum(len(r.data) for r in dense) == 90 * 60 + 12 * 30 and max(len(r.data) for r in dense) <= 1000


def test_recipe_errors_come_before_jobs(spark):
    px = noise(spark, 4, 4, 1)
    for steps in ([], [{"operationId": "magic"}], [{"operationId": "grid.reduce", "usePreviousAlignment": True}],
                  [{"operationId": "filter.sharpen", "sharpen": {"strength": 300, "threshold": 0}}],
                  [{"operationId": "contours.clean", "contours": {}}], [{"operationId": "image.trim", "cellSize": 2}],
                  [{"operationId": "filter.ascii", "ascii": {"characters": "@ ", "columns": 2, "rows": 2}}, {"operationId": "image.trim"}]):
        with pytest.raises(ValueError):
            recipes.apply_recipe(px, steps)


def test_registered_step_and_recipe_order(spark):
    px = noise(spark, 8, 8, 3, clear=0)
    recipes.register_operation("test.invert", lambda p, s, state: p.selectExpr(
        "image_id", "x", "y", "255 - r AS r", "255 - g AS g", "255 - b AS b", "a"), one_pass=True)
    try:
        twice = recipes.apply_recipe(px, [{"operationId": "test.invert"}, {"operationId": "test.invert"}])
        assert pixels(twice) == pixels(px)
        with pytest.raises(ValueError):
            recipes.register_operation("test.invert", None)
    finally:
        del recipes.OPERATIONS["test.invert"]
    report = recipes.step_report(px, [{"operationId": "image.resize", "resizeFactor": {"factor": 0.5}}, {"operationId": "filter.monochrome"}]).collect()
    assert {(r.step_index, r.width, r.height) for r in report} == {(1, 4, 4), (2, 4, 4)}


def test_replay_reports_images_it_leaves_out(spark):
    import json
    cells = [(1, x, y, 60 * (x // 4 % 2), 90 * (y // 4 % 2), 9, 255) for y in range(24) for x in range(24)]  # a grid
    tiny = [(2, x, y, 40 * x, 40 * y, 0, 255) for y in range(4) for x in range(4)]  # too small for one
    px = spark.createDataFrame(cells + tiny, SCHEMA)
    found = [{"operationId": "grid.align"}, {"operationId": "grid.reduce", "usePreviousAlignment": True}]
    out, rejects = recipes.apply_recipe_with_rejects(px, found)
    assert {p.image_id for p in out.collect()} == {1}
    assert list(map(tuple, rejects.collect())) == [(2, 2, "grid.reduce", "no grid was detected")]
    out, mixed = recipes.apply_recipe_with_rejects(px, [{"operationId": "grid.reduce", "cellSize": 4}])
    assert out.count() == 36 and list(map(tuple, mixed.collect())) == [(2, 1, "grid.reduce", "mixed cells")]
    # cells that a later step mixes again are not reduced to one of their colours
    blur = [{"operationId": "grid.align", "cellSize": 4}, {"operationId": "image.resize", "downscale": {"targetWidth": 18, "targetHeight": 18}},
            {"operationId": "grid.reduce", "usePreviousAlignment": True}]
    assert {tuple(r)[:2] + (r.reason,) for r in recipes.apply_recipe_with_rejects(px.filter("image_id = 1"), blur)[1].collect()} == {(1, 3, "mixed cells")}
    small = [{"operationId": "image.profile", "downscale": {"targetWidth": 6, "targetHeight": 6}}]
    out, cropped = recipes.apply_recipe_with_rejects(px, small)
    assert {p.image_id for p in out.collect()} == {1} and list(map(tuple, cropped.collect())) == [(2, 1, "image.profile", "smaller than the target")]
    items = spark.createDataFrame([(i, json.dumps({"version": 1, "steps": found})) for i in (1, 2)] + [(3, "no json")], "image_id BIGINT, json STRING")
    status = {r.image_id: tuple(r)[1:] for r in recipes.batch_status(items, "image_id", rejects=rejects).collect()}
    assert status == {1: ("done", None, None), 2: ("failed", 2, "no grid was detected"), 3: ("failed", 0, "not a recipe")}


# --- sources and sinks -------------------------------------------------------------------

def write_png(path, width, height, rgba):
    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))
    lines = b"".join(b"\0" + bytes(v for x in range(width) for v in rgba[y * width + x]) for y in range(height))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0))
                     + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))


def test_image_folder(spark, tmp_path):
    rgba = [(10, 20, 30, 255), (40, 50, 60, 128), (70, 80, 90, 0), (1, 2, 3, 4), (5, 6, 7, 8), (255, 254, 253, 252)]
    write_png(tmp_path / "a.png", 3, 2, rgba)
    (tmp_path / "broken.png").write_bytes(b"no image")
    found, rejected = images.scan_images(spark, str(tmp_path))
    assert [(r.width, r.height, r.n_channels) for r in found.collect()] == [(3, 2, 4)]
    assert [r.origin.split("/")[-1] for r in rejected.collect()] == ["broken.png"]
    got = {(p.x, p.y): (p.r, p.g, p.b, p.a) for p in images.explode_pixels(found).collect()}
    assert got == {(i % 3, i // 3): v for i, v in enumerate(rgba)}
    hashes = files.scan_files(spark, str(tmp_path)).collect()
    assert len(hashes) == 2 and all(len(r.sha256) == 64 for r in hashes)


def test_records_and_guarded_output(spark, tmp_path):
    folder = tmp_path / "records"
    folder.mkdir()
    for i, text in enumerate(['{"version": 1, "id": 5, "name": "a"}', '{"version": 2, "id": 6, "name": "b"}', "{oops", '{"version": 1, "id": 7}']):
        (folder / f"{i}.json").write_text(text)
    good, bad = files.scan_records(spark, str(folder), "version INT, id BIGINT, name STRING", ["id", "name"])
    assert [r.id for r in good.collect()] == [5]
    assert sorted(r.reason for r in bad.collect()) == ["malformed", "missing name", "unsupported version"]
    px, target = noise(spark, 5, 4, 1), str(tmp_path / "out")
    files.write_pixels(px, target)
    with pytest.raises(Exception, match="already exists"):
        files.write_pixels(px, target)
    files.write_pixels(px, target, overwrite=True)
    assert pixels(spark.read.parquet(target).drop("image_bucket")) == pixels(px)


def test_coherence_of_many_colours(spark):
    """More colours than any list limit: the nearest other colour against brute force."""
    import numpy as np
    from atlasmill.operators import regions
    rng = np.random.default_rng(3)
    rgb = np.unique(rng.integers(0, 256, (5000, 3)), axis=0)
    px = spark.createDataFrame([(1, k % 100, k // 100, int(r), int(g), int(b), 255) for k, (r, g, b) in enumerate(rgb)],
                               "image_id BIGINT, x INT, y INT, r INT, g INT, b INT, a INT")
    rows = regions.color_coherence(px).select("rgb", "nearest_sq", "k_l", "k_a", "k_b").collect()
    assert len(rows) == len(rgb)
    place = np.array([[r.k_l, r.k_a, r.k_b] for r in rows])
    for k in range(0, len(rows), 50):
        d = ((place - place[k]) ** 2).sum(1)
        d[k] = np.inf
        assert abs(d.min() - rows[k].nearest_sq) < 1e-12


def test_incomplete_steps_are_rejected(spark):
    import json
    from atlasmill.plans import recipes
    steps = [{"operationId": "filter.ascii", "ascii": {"columns": 4, "rows": 0, "characters": "#."}},
             {"operationId": "image.profile", "downscale": {"palette": "none"}},
             {"operationId": "image.resize", "downscale": {"targetWidth": 4}},
             {"operationId": "image.colors", "downscale": {"independentColorMode": "other"}},
             {"operationId": "color.channel.adjust", "channelAdjustment": {"channel": "R", "mode": "times", "amount": 2}},
             {"operationId": "image.resize", "resizeFactor": {"factor": 0.5, "cropHorizontal": "middle"}},
             {"operationId": "image.profile", "downscale": {"targetWidth": 4, "targetHeight": 4, "manualCriteria": {"edgeImportance": 2}}},
             # rows and columns of a text picture follow from the image where they are not given
             {"operationId": "filter.ascii", "ascii": {"columns": 0, "characters": "#."}}]
    rows = spark.createDataFrame([(k, json.dumps({"version": 1, "steps": [s]})) for k, s in enumerate(steps)], "id INT, json STRING")
    errors = {r.id: r.error for r in recipes.validate_recipes(recipes.parse_recipes(rows), "id").collect()}
    assert errors == {0: "rows must be positive", 1: "target dimensions are required", 2: "target dimensions are required",
                      3: "unknown colour mode", 4: "unknown adjustment mode",
                      5: "unknown crop alignment in resizeFactor", 6: "manual criteria in downscale must be 0..1"}


def test_resize_shrinks_by_blocks(spark):
    from atlasmill.plans import recipes
    rows = [(1, x, y, *((200, 20, 0) if x % 2 and not (x == 1 and y == 0) else (10, 10, 10)), 255) for y in range(4) for x in range(4)]
    px = spark.createDataFrame(rows, "image_id BIGINT, x INT, y INT, r INT, g INT, b INT, a INT")
    small = recipes.apply_recipe(px, [{"operationId": "image.resize", "downscale": {"targetWidth": 2, "targetHeight": 2}}]).collect()
    assert {(p.x, p.y): p.r for p in small}[1, 1] == 200 and len(small) == 4
    same = recipes.apply_recipe(px, [{"operationId": "image.resize", "resizeFactor": {"factor": 1.0}}]).collect()
    assert sorted(map(tuple, same)) == sorted(map(tuple, px.collect()))
    assert recipes.apply_recipe(px, [{"operationId": "image.resize", "resizeFactor": {"factor": 2.0}}]).count() == 64
