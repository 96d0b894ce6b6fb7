"""Operators whose shuffles must not grow faster than their input."""

import numpy as np
from pyspark.sql import functions as F

from atlasmill.operators import bands, stencil

SCHEMA = "image_id BIGINT, x INT, y INT, r INT, g INT, b INT, a INT"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def random_pixels(spark, width, height, seed=3, images=1, colors=256):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, x, y, *map(int, rng.integers(0, colors, 3)), 255)
                                  for i in range(images) for x in range(width) for y in range(height)], SCHEMA)


def test_edges_shuffle_once_and_match_across_tiles(spark, monkeypatch):
    px = random_pixels(spark, 11, 9)
    whole = {(p.x, p.y): (p.ex, p.ey) for p in stencil.transition_edges(px).collect()}
    monkeypatch.setattr(bands, "TILE", 4)
    edges = stencil.transition_edges(px)
    assert plan(edges).count("Exchange") == 1
    assert {(p.x, p.y): (p.ex, p.ey) for p in edges.collect()} == whole and len(whole) == 99


def test_clusters_do_not_shuffle_colors_again(spark, monkeypatch):
    """Means, members and boxes of chunked colours are those of whole images."""
    from atlasmill.operators import palette as pal
    px = random_pixels(spark, 14, 10, images=3, colors=90)
    for build in (lambda: pal.kmeans_palette(px, 3, "linear", True, rounds=1), lambda: pal.median_cut_palette(px, 3, True)):
        whole = sorted(map(tuple, build().collect()))
        monkeypatch.setattr(pal, "CHUNK", 4)
        assert pal.color_chunks(px).count() == 36
        assert sorted(map(tuple, build().collect())) == whole
        monkeypatch.setattr(pal, "CHUNK", 32)


def test_weighted_box_is_cut_where_population_is_nearest_half(spark):
    from atlasmill.operators import palette as pal
    counts = {(10, 0, 0): 2, (10, 5, 0): 3, (40, 0, 0): 4, (40, 1, 0): 1, (90, 0, 0): 3}
    rows = [(0, i, 0, *v, 255) for i, v in enumerate(v for v, n in counts.items() for _ in range(n))]
    boxes = pal.median_cut_boxes(spark.createDataFrame(rows, SCHEMA), 2, True).collect()
    total, order = sum(counts.values()), sorted(counts)
    split = min(range(1, len(order)), key=lambda r: (abs(total - 2 * sum(counts[v] for v in order[:r])), r))
    assert {(b.rgb >> 16, b.rgb >> 8 & 255, b.rgb & 255): b.box for b in boxes} == {v: 2 + (i >= split) for i, v in enumerate(order)}


def test_color_map_is_not_copied(spark):
    from atlasmill.operators import palette as pal
    px = random_pixels(spark, 3, 3)
    mapped = pal.apply_color_map(px, pal.color_chunks(px).select("image_id", F.explode("rgb").alias("rgb")).withColumn("new_rgb", F.lit(7)))
    assert "sequence(0" not in plan(mapped) and {(p.r, p.g, p.b) for p in mapped.collect()} == {(0, 0, 7)}


def test_small_images_are_clustered_where_they_are(spark, monkeypatch):
    """Colours of an image of one chunk are not joined to clusters round by round, and the palettes are the same."""
    from atlasmill.operators import palette as pal
    px = random_pixels(spark, 14, 10, images=3, colors=90)
    monkeypatch.setattr(pal, "CHUNK", 4)
    chunked = {space: sorted(map(tuple, pal.kmeans_palette(px, 5, space, True).collect())) for space in ("lab", "linear")}
    monkeypatch.setattr(pal, "CHUNK", 32)
    monkeypatch.setattr(pal, "_moved", lambda *args: 1 / 0)
    assert {space: sorted(map(tuple, pal.kmeans_palette(px, 5, space, True).collect())) for space in chunked} == chunked


def test_recipe_options_are_not_shuffled(spark):
    """Steps are judged where the recipe is parsed; only keys, names and errors reach a shuffle."""
    from atlasmill.plans import recipes as rc
    texts = ['{"version": 1, "steps": [{"operationId": "grid.align", "cellSize": 4}, {"operationId": "grid.reduce", "usePreviousAlignment": true}]}',
             '{"version": 1, "steps": [{"operationId": "grid.reduce", "usePreviousAlignment": true}, {"operationId": "image.trim", "cellSize": 3}]}',
             '{"version": 1, "steps": []}', "text"]
    items = spark.createDataFrame(list(enumerate(texts)), "id INT, json STRING")
    errors = rc.validate_recipes(rc.parse_recipes(items), "id")
    assert "cellSize" not in plan(errors) and "from_json" not in plan(errors)
    assert sorted((e.id, e.step_index, e.error) for e in errors.collect()) == [
        (1, 1, "needs an earlier alignment"), (1, 2, "unsupported parameters"), (2, 0, "no steps"), (3, 0, "not a recipe")]
    status = rc.batch_status(items, "id")
    assert "from_json" not in plan(status)
    assert sorted((s.id, s.status, s.step_index) for s in status.collect()) == [(0, "done", None), (1, "failed", 1), (2, "failed", 0), (3, "failed", 0)]


def test_frames_and_votes_look_up_ranges(spark):
    """Target pixels and cells come from ranges worked out in batches, and tables of images are not copied."""
    import math
    from atlasmill.operators import blocks, grid
    px = random_pixels(spark, 11, 7, images=2)
    for fit in ("contain", "cover", "stretch"):
        frames = blocks.fit_frames(px, [5, 16], fit)
        assert "lambda" not in plan(frames) and "sequence(0" not in plan(frames)
        got = {(f.image_id, f.size, f.x, f.y): (f.r, f.g, f.b) for f in frames.collect()}
        rgb = {(p.image_id, p.x, p.y): (p.r, p.g, p.b) for p in px.collect()}
        want = {}
        for size in (5, 16):
            t = {n: min(size, max(1, math.floor(n * (size / 11) + 0.5))) if fit == "contain" else size for n in (11, 7)}
            o = {n: (size - t[n]) // 2 if fit == "contain" else 0 for n in (11, 7)}
            e = {n: 7 if fit == "cover" else n for n in (11, 7)}
            at = {n: [min(n - 1, math.floor((n - e[n]) / 2 + (k + 0.5) * e[n] / t[n])) for k in range(t[n])] for n in (11, 7)}
            want |= {(i, size, o[11] + a, o[7] + b): rgb[i, x, y] for i in (0, 1) for a, x in enumerate(at[11]) for b, y in enumerate(at[7])}
        assert got == want
    votes = grid.grid_vote(px, pitch=3, phase_x=1.4, phase_y=-0.7)
    assert "lambda" not in plan(votes) and "sequence(0" not in plan(votes)
    cells = {(v.image_id, v.cx, v.cy) for v in votes.collect()}
    assert cells == {(i, cx, cy) for i in (0, 1) for cx in range(4) for cy in range(3)}


def test_votes_of_neighbours_are_taken_in_batches(spark):
    px = random_pixels(spark, 6, 5, colors=12)
    for found in (stencil.local_consensus(px, 40.0, 0.8), stencil.local_delta(px, 20.0, 2), stencil.sharpen(px, 80, 2)):
        assert "lambda" not in plan(found)
        assert found.count() > 0
