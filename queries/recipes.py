"""Recipes: validation, usage and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasmill.functions import palettes
from atlasmill.plans import recipes as rc
from queries import sqlmath as m
from queries.base import Area
from queries.blocks import AUTO, MANUAL, PROFILE, SIZES, covered, overlaps
from queries.colors import nearest_sql, remap_sql
from queries.grids import vote_sql
from queries.pixels import ARGB, RGB

area = Area()
add = area.add
add("alignment_errors", lambda v: rc.alignment_errors(v.recipes()), """
    WITH r AS (SELECT *, coalesce(bool_or(operation_id = 'grid.align') OVER (PARTITION BY source_id ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ok FROM recipes)
    SELECT source_id, step_index, 'needs an earlier alignment' AS error FROM r WHERE use_previous_alignment AND NOT ok""")


def documents(v):
    """One JSON recipe per order line, some broken in different ways."""
    return v.gens().selectExpr("gen_id", """CASE gen_id % 9
      WHEN 0 THEN '{"version": 1, "steps": [{"operationId": "filter.monochrome"}]}'
      WHEN 1 THEN '{"version": 2, "steps": [{"operationId": "filter.monochrome"}]}'
      WHEN 2 THEN '{"version": 1, "steps": []}'
      WHEN 3 THEN concat('{"version": 1, "steps": [{"operationId": "filter.sharpen", "sharpen": {"strength": ', gen_id % 400, ', "threshold": 3}}]}')
      WHEN 4 THEN '{"version": 1, "steps": [{"operationId": "grid.align", "cellSize": 4}, {"operationId": "grid.reduce", "usePreviousAlignment": true}]}'
      WHEN 5 THEN '{"version": 1, "steps": [{"operationId": "grid.reduce", "usePreviousAlignment": true}, {"operationId": "image.trim", "cellSize": 3}]}'
      WHEN 6 THEN concat('{"version": 1, "steps": [{"operationId": "', operation_id, '"}]}')
      WHEN 7 THEN 'not json'
      ELSE '{"version": 1, "steps": [{"operationId": "contours.clean", "contours": {}}, {"operationId": "magic"}]}' END AS json""")


ERR = """er AS (
    SELECT gen_id, 0 AS step_index, NULL AS operation_id, CASE gen_id % 9 WHEN 1 THEN 'unsupported version' WHEN 2 THEN 'no steps' ELSE 'not a recipe' END AS error FROM gens WHERE gen_id % 9 IN (1, 2, 7)
    UNION ALL SELECT gen_id, 1, 'filter.sharpen', 'sharpen strength must be 0..200 and threshold 0..64' FROM gens WHERE gen_id % 9 = 3 AND gen_id % 400 > 200
    UNION ALL SELECT gen_id, 1, 'grid.reduce', 'needs an earlier alignment' FROM gens WHERE gen_id % 9 = 5
    UNION ALL SELECT gen_id, 2, 'image.trim', 'unsupported parameters' FROM gens WHERE gen_id % 9 = 5
    UNION ALL SELECT gen_id, 1, operation_id, CASE operation_id WHEN 'image.resize' THEN 'resize takes either dimensions or a factor' WHEN 'image.colors' THEN 'downscale is required'
      WHEN 'grid.reduce' THEN 'cell size is required' ELSE 'sharpen is required' END FROM gens WHERE gen_id % 9 = 6 AND operation_id <> 'grid.align'
    UNION ALL SELECT gen_id, 1, 'contours.clean', 'operation cannot be replayed' FROM gens WHERE gen_id % 9 = 8
    UNION ALL SELECT gen_id, 2, 'magic', 'unsupported operation' FROM gens WHERE gen_id % 9 = 8)"""
add("validate_recipes", lambda v: rc.validate_recipes(rc.parse_recipes(documents(v)), "gen_id"), f"WITH {ERR} SELECT * FROM er /* FROM gens */")
add("batch_status", lambda v: rc.batch_status(documents(v), "gen_id"), f"""
    WITH {ERR}, f AS (SELECT gen_id, min(step_index) AS step_index, arg_min(error, step_index) AS error FROM er GROUP BY 1)
    SELECT g.gen_id, CASE WHEN f.gen_id IS NULL THEN 'done' ELSE 'failed' END AS status, step_index, error FROM gens g LEFT JOIN f ON f.gen_id = g.gen_id""")
add("macro_duplicates", lambda v: rc.macro_duplicates(v.table("part").selectExpr("p_partkey % 1500 AS id", "p_name AS name")), """
    SELECT 'id' AS kind, CAST(p_partkey % 1500 AS VARCHAR) AS value, count(*) AS n FROM part GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'name', lower(p_name), count(*) FROM part GROUP BY 2 HAVING count(*) > 1""")
add("operation_usage", lambda v: rc.operation_usage(v.gens()), """
    SELECT source_id, operation_id, count(*) AS steps, CAST(grouping(source_id, operation_id) AS INT) AS level FROM gens GROUP BY CUBE (source_id, operation_id)""")
add("macro_summary", lambda v: rc.macro_summary(v.gens()),
    "SELECT source_id, count(*) AS steps, list_sort(list(DISTINCT operation_id)) AS operations FROM gens GROUP BY source_id")
_CAP = "CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Upscale' WHEN 2 THEN 'Палитра' WHEN 3 THEN 'Monochrome' ELSE o_orderpriority END"
add("legacy_operation", lambda v: v.table("orders").selectExpr("o_orderkey", f"{_CAP} AS caption").select("o_orderkey", rc.legacy_operation("caption").alias("operation_id")), f"""
    SELECT o_orderkey, CASE {_CAP} WHEN '' THEN 'image.profile' WHEN 'Upscale' THEN 'image.resize' WHEN 'Палитра' THEN 'image.colors' WHEN 'Monochrome' THEN 'filter.monochrome' END AS operation_id FROM orders""")
add("missing_legacy_fields", lambda v: rc.missing_legacy_fields(v.table("events").select(
    "event_id", F.expr("CASE WHEN event_id % 3 = 0 THEN props WHEN event_id % 3 = 1 THEN '{\"Palette\": 1, \"TARGETWIDTH\": 2}' ELSE 'oops' END AS p")), "p",
    ["TargetWidth", "Palette", "K"]).select("event_id", "missing"), """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN list_filter(['TargetWidth', 'Palette', 'K'], lambda n: NOT list_contains(list_transform(json_keys(props), lambda k: lower(k)), lower(n)))
      WHEN event_id % 3 = 1 THEN ['K'] ELSE ['TargetWidth', 'Palette', 'K'] END AS missing FROM events""")
COLOR = [{"operationId": "color.channel.adjust", "channelAdjustment": {"channel": "r", "mode": "value", "amount": 20, "subtract": False}},
         {"operationId": "image.colors", "downscale": {"independentColorMode": "palette", "palette": "db16"}},
         {"operationId": "filter.monochrome"}]
BRIGHT = "br AS MATERIALIZED (SELECT image_id, x, y, CAST(least(255, r + 20) AS INT) AS r, g, b, a FROM px8)"
GRAY = f"CAST(CASE WHEN a > 0 THEN round_even({m.lum()}, 0) ELSE {{c}} END AS INT) AS {{c}}"
PLAN = f"{BRIGHT}, {nearest_sql('br', palettes.DB16)}, st AS ({remap_sql('br')}), mo AS (SELECT image_id, x, y, {', '.join(GRAY.format(c=c) for c in 'rgb')}, a FROM st)"
add("apply_recipe", lambda v: rc.apply_recipe(v.px8(), COLOR), f"WITH {PLAN} SELECT * FROM mo")
_REP = "SELECT image_id, {i} AS step_index, '{o}' AS operation_id, max(x)+1 AS width, max(y)+1 AS height, count(DISTINCT CASE WHEN a > 0 THEN " + RGB + " END) AS n_colors, NULL AS cell_size FROM {t} GROUP BY image_id"
add("step_report", lambda v: rc.step_report(v.px8(), COLOR), f"WITH {PLAN} " + " UNION ALL ".join(
    _REP.format(i=i, o=s["operationId"], t=t) for i, (s, t) in enumerate(zip(COLOR, ("br", "st", "mo")), 1)))
GRID = [{"operationId": "grid.align", "cellSize": 3}, {"operationId": "grid.reduce", "usePreviousAlignment": True}]
add("apply_recipe_grid", lambda v: rc.apply_recipe(v.pxl(), GRID), f"""
    WITH {vote_sql('pxl', 3, 0.0, 0.0)} SELECT p.image_id, CAST(p.x//3 AS INT) AS x, CAST(p.y//3 AS INT) AS y, CAST((argb//65536)%256 AS INT) AS r, CAST((argb//256)%256 AS INT) AS g, CAST(argb%256 AS INT) AS b, CAST(argb//16777216 AS INT) AS a
    FROM pxl p JOIN vt ON vt.image_id = p.image_id AND cx = p.x//3 AND cy = p.y//3 WHERE p.x%3 = 0 AND p.y%3 = 0""")
MANY = [{"operationId": "background.remove", "background": {"mode": "edges", "tolerance": 8}}, {"operationId": "image.trim"},
        {"operationId": "filter.sharpen", "sharpen": {"strength": 40, "threshold": 4}},
        {"operationId": "image.finalist.reduce", "finalistMode": "mixed", "finalistFactor": 2},
        {"operationId": "image.resize", "resizeFactor": {"factor": 1.5}}]
# target sizes differ by image: half of its own, rounded away from zero
HALVES = f"""sz AS ({SIZES.format(v='px8')}),
    gx AS (SELECT image_id, bx, bx*width::DOUBLE/tw AS x0, (bx+1)*width::DOUBLE/tw AS x1 FROM (SELECT *, unnest(range(tw)) AS bx FROM (SELECT *, CAST(greatest(1, round(width*0.5::DOUBLE)) AS INT) AS tw FROM sz))),
    gy AS (SELECT image_id, byy, byy*height::DOUBLE/th AS y0, (byy+1)*height::DOUBLE/th AS y1 FROM (SELECT *, unnest(range(th)) AS byy FROM (SELECT *, CAST(greatest(1, round(height*0.5::DOUBLE)) AS INT) AS th FROM sz))),
    cl AS MATERIALIZED (SELECT p.*, 0 AS edge, bx, byy, (least(x+1, x1) - greatest(x, x0))*(least(y+1, y1) - greatest(y, y0)) AS area, (x1-x0)*(y1-y0) AS ba, {ARGB} AS argb
      FROM px8 p JOIN gx ON gx.image_id = p.image_id AND p.x < x1 AND p.x+1 > x0 JOIN gy ON gy.image_id = p.image_id AND p.y < y1 AND p.y+1 > y0)"""
# smaller in every image: one of its own colours per block, after cropping to whole blocks
add("apply_recipe_shrink", lambda v: rc.apply_recipe(v.px8(), [{"operationId": "image.resize", "downscale": {"targetWidth": 12, "targetHeight": 10}}]), f"""
    WITH s0 AS ({SIZES.format(v='px8')}), cr AS (SELECT p.image_id, CAST(x - (width%12)//2 AS INT) AS x, CAST(y - (height%10)//2 AS INT) AS y, r, g, b, a FROM px8 p JOIN s0 USING (image_id)
      WHERE x >= (width%12)//2 AND x < (width%12)//2 + width - width%12 AND y >= (height%10)//2 AND y < (height%10)//2 + height - height%10),
    {overlaps('cr', 12, 10)}, {AUTO}, {covered('CAST(0.5 AS DOUBLE)')} SELECT * FROM sm""")
add("apply_recipe_factor_sprite", lambda v: rc.apply_recipe(v.px8(), [{"operationId": "image.resize", "resizeFactor": {
    "factor": 0.5, "spriteMode": True, "alphaThreshold": 60}}]), f"""
    WITH {HALVES}, {AUTO}, {covered('CAST(0.6 AS DOUBLE)')} SELECT * FROM sm""")
CRITERIA = {"targetBrightness": 0.4, "targetContrast": 0.9, "targetSaturation": 0.6, "targetEdge": 0.2,
            "brightnessImportance": 0.8, "contrastImportance": 0.3, "saturationImportance": 0.7, "edgeImportance": 0.5}
CORNER = {"targetWidth": 12, "targetHeight": 10, "cropHorizontal": "Left", "cropVertical": "Bottom"}


def left_bottom(sql):
    """The same query with whole blocks cropped at the left and the lower side."""
    return sql.replace("(width%12)//2", "0").replace("(height%10)//2", "(height%10)")


SHRINK = f"""WITH s0 AS ({SIZES.format(v='px8')}), cr AS (SELECT p.image_id, CAST(x - (width%12)//2 AS INT) AS x, CAST(y - (height%10)//2 AS INT) AS y, r, g, b, a FROM px8 p JOIN s0 USING (image_id)
      WHERE x >= (width%12)//2 AND x < (width%12)//2 + width - width%12 AND y >= (height%10)//2 AND y < (height%10)//2 + height - height%10),
    {overlaps('cr', 12, 10)}, {AUTO}, {covered('CAST(0.5 AS DOUBLE)')} SELECT * FROM sm"""
add("apply_recipe_crop", lambda v: rc.apply_recipe(v.px8(), [{"operationId": "image.resize", "downscale": CORNER}]), left_bottom(SHRINK))
add("apply_recipe_resize_manual", lambda v: rc.apply_recipe(v.px8(), [{"operationId": "image.resize", "resizeFactor": {
    "factor": 0.5, "spriteMode": True, "alphaThreshold": 60, "blockMode": "Manual", "manualCriteria": CRITERIA}}]), f"""
    WITH {HALVES}, {MANUAL}, {covered('CAST(0.6 AS DOUBLE)')} SELECT * FROM sm""")
add("apply_recipe_profile_manual", lambda v: rc.apply_recipe(v.px8(), [{"operationId": "image.profile", "downscale": {
    **CORNER, "blockMode": "Manual", "manualCriteria": CRITERIA}}]), left_bottom(f"WITH {PROFILE.replace(AUTO, MANUAL)} SELECT * FROM sm"))
# images that a replay leaves out: too small for a grid, more than one colour in a cell, smaller than the target
FOUND = [{"operationId": "grid.align"}, {"operationId": "grid.reduce", "usePreviousAlignment": True}]
CELLS = [{"operationId": "filter.monochrome"}, {"operationId": "grid.reduce", "cellSize": 2}]
SMALL = [{"operationId": "image.profile", "downscale": {"targetWidth": 12, "targetHeight": 60}}]


def tiny(v):
    return v.px().filter("x < 5 AND y < 5")


def mixed_source(v):
    """One image in three shows its left upper pixel everywhere."""
    return v.px().selectExpr("image_id", "x", "y", *[f"CASE WHEN image_id % 3 = 0 THEN {w} ELSE {u} END AS {u}" for u, w in (("r", "100"), ("g", "100"), ("b", "100"), ("a", "255"))])


def rejected(v):
    out = None
    for name, px, steps in (("undetected", tiny(v), FOUND), ("mixed", mixed_source(v), CELLS), ("small", v.px(), SMALL)):
        part = rc.apply_recipe_with_rejects(px, steps)[1].select(F.lit(name).alias("recipe"), "*")
        out = part if out is None else out.unionByName(part)
    return out


LEFT_OUT = f"""mx AS (SELECT image_id, x//2 AS cx, y//2 AS cy, count(DISTINCT CASE WHEN a = 0 THEN 0 ELSE 1 + a + 256*CAST(round_even({m.lum()}, 0) AS BIGINT) END) AS n
      FROM px WHERE image_id % 3 <> 0 GROUP BY ALL HAVING n > 1),
    rj AS (SELECT DISTINCT 'undetected' AS recipe, image_id, 2 AS step_index, 'grid.reduce' AS operation_id, 'no grid was detected' AS reason FROM px WHERE x < 5 AND y < 5
    UNION ALL SELECT DISTINCT 'mixed', image_id, 2, 'grid.reduce', 'mixed cells' FROM mx
    UNION ALL SELECT 'small', image_id, 1, 'image.profile', 'smaller than the target' FROM px GROUP BY image_id HAVING max(x)+1 < 12 OR max(y)+1 < 60)"""
add("recipe_rejects", rejected, f"WITH {LEFT_OUT} SELECT * FROM rj")


def judged(v):
    """Every image with the recipe of the mixed ones as its item."""
    import json
    px = mixed_source(v)
    items = px.select("image_id").distinct().withColumn("json", F.lit(json.dumps({"version": 1, "steps": CELLS})))
    return rc.batch_status(items, "image_id", rejects=rc.apply_recipe_with_rejects(px, CELLS)[1])


add("batch_status_rejects", judged, f"""
    WITH {LEFT_OUT} SELECT i.image_id, CASE WHEN r.image_id IS NULL THEN 'done' ELSE 'failed' END AS status, r.step_index, r.reason AS error
    FROM (SELECT DISTINCT image_id FROM px) i LEFT JOIN rj r ON r.image_id = i.image_id AND r.recipe = 'mixed'""")
add("apply_recipe_mixed", lambda v: rc.apply_recipe(v.px8(), MANY))

QUERIES, SQL = area.queries, area.sql
