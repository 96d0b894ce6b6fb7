"""Resizing and block reductions."""

from __future__ import annotations

from atlasmill.functions import palettes
from atlasmill.operators import blocks as b
from queries import sqlmath as m
from queries.base import Area
from queries.colors import kmeans_sql, nearest_sql, quantize_sql, remap_sql
from queries.pixels import ARGB, SIZES
from queries.stencils import EDGE, SPRITE

area = Area()
add = area.add

UN = """CAST((coalesce(argb, 0)//65536)%256 AS INT) AS r, CAST((coalesce(argb, 0)//256)%256 AS INT) AS g,
  CAST(coalesce(argb, 0)%256 AS INT) AS b, CAST(coalesce(argb, 0)//16777216 AS INT) AS a"""
ARG_RGB = ("((argb//65536)%256)", "((argb//256)%256)", "(argb%256)")
IMPORTANCE = f"round(n*{m.contrast(*ARG_RGB)}*{m.sat(*ARG_RGB)}*greatest(edge, {m.n(.05)}), 9)"
AUTO = f"""cc AS (SELECT image_id, bx, byy, argb, count(*) AS n, avg(edge) AS edge, min(y*100000 + x) AS q FROM cl WHERE a > 0 GROUP BY 1, 2, 3, 4),
    pk AS (SELECT image_id, bx, byy, arg_max(argb, ({IMPORTANCE}, -q)) AS argb FROM cc GROUP BY 1, 2, 3)"""


def overlaps(view, w, h, src="SELECT *, 0 AS edge FROM {v}"):
    return f"""sz AS ({SIZES.format(v=view)}),
    gx AS (SELECT image_id, width, height, bx, bx*width::DOUBLE/{w} AS x0, (bx+1)*width::DOUBLE/{w} AS x1 FROM sz, (SELECT unnest(range({w})) AS bx)),
    gy AS (SELECT image_id, byy, byy*height::DOUBLE/{h} AS y0, (byy+1)*height::DOUBLE/{h} AS y1 FROM sz, (SELECT unnest(range({h})) AS byy)),
    cl AS MATERIALIZED (SELECT p.*, bx, byy, (least(x+1, x1) - greatest(x, x0))*(least(y+1, y1) - greatest(y, y0)) AS area, (x1-x0)*(y1-y0) AS ba, {ARGB} AS argb
      FROM ({src.format(v=view)}) p JOIN gx ON gx.image_id = p.image_id AND p.x < x1 AND p.x+1 > x0 JOIN gy ON gy.image_id = p.image_id AND p.y < y1 AND p.y+1 > y0
      WHERE least(x+1, x1) - greatest(x, x0) > 1e-12 AND least(y+1, y1) - greatest(y, y0) > 1e-12)"""


add("resample_nearest", lambda v: b.resample_nearest(v.px(), 96, 23), f"""
    WITH s AS ({SIZES.format(v='px')}), g AS (SELECT image_id, tx, ty, (tx*width)//96 AS x, (ty*height)//23 AS y FROM s, (SELECT unnest(range(96)) AS tx), (SELECT unnest(range(23)) AS ty))
    SELECT image_id, CAST(tx AS INT) AS x, CAST(ty AS INT) AS y, r, g, b, a FROM (SELECT g.image_id, tx, ty, r, px.g, b, a FROM g JOIN px ON px.image_id = g.image_id AND px.x = g.x AND px.y = g.y)""")
add("resolve_resize", lambda v: b.resolve_resize(v.assets().select("asset_id", "width", "height"), 0.35), """
    SELECT asset_id, width, height, CAST(greatest(1, round(width*CAST(0.35 AS DOUBLE), 0)) AS INT) AS target_width,
      CAST(greatest(1, round(height*CAST(0.35 AS DOUBLE), 0)) AS INT) AS target_height FROM assets""")
add("overlap_blocks", lambda v: b.overlap_blocks(v.px(), 9, 5).selectExpr(
    "image_id", "x", "y", "bx", "by AS byy", "round(area, 6) AS area"), f"""
    WITH {overlaps('px', 9, 5)} SELECT image_id, x, y, CAST(bx AS INT) AS bx, CAST(byy AS INT) AS byy, round(area, 6) AS area FROM cl""")
add("block_representative_auto", lambda v: b.block_representative(v.px(), 4, 4), f"""
    WITH {EDGE.format(lum=m.lum(), view='px')}, cl AS (SELECT *, x//4 AS bx, y//4 AS byy, {ARGB} AS argb FROM ge), {AUTO},
    bl AS (SELECT image_id, bx, byy, count(*) FILTER (a > 0) AS shown FROM cl GROUP BY 1, 2, 3),
    o AS (SELECT bl.image_id, bl.bx, bl.byy, CASE WHEN shown*2 >= 16 THEN argb END AS argb FROM bl LEFT JOIN pk USING (image_id, bx, byy))
    SELECT image_id, CAST(bx AS INT) AS x, CAST(byy AS INT) AS y, {UN} FROM o""")
_T = {"brightness": 0.4, "contrast": 0.9, "saturation": 0.6, "edge": 0.2}
_I = {"brightness": 0.8, "contrast": 0.3, "saturation": 0.7, "edge": 0.5}
_F = {"brightness": m.lum(*ARG_RGB) + "/255", "contrast": m.contrast(*ARG_RGB), "saturation": m.sat(*ARG_RGB), "edge": "edge"}
_COST = "round(" + " + ".join(f"{m.n(_I[k])}*abs({_F[k]} - {m.n(_T[k])})" for k in _F) + ", 9)"
MANUAL = f"""f AS (SELECT image_id, bx, byy, argb, {_COST} AS d, count(*) OVER (PARTITION BY image_id, bx, byy, argb) AS n, y, x FROM cl WHERE a > 0),
    pk AS (SELECT image_id, bx, byy, arg_min(argb, (d, -n, y, x)) AS argb FROM f GROUP BY 1, 2, 3)"""
add("block_representative_manual", lambda v: b.block_representative(v.px(), 4, 4, (_T, _I)), f"""
    WITH {EDGE.format(lum=m.lum(), view='px')}, cl AS (SELECT *, x//4 AS bx, y//4 AS byy, {ARGB} AS argb FROM ge), {MANUAL},
    bl AS (SELECT image_id, bx, byy, count(*) FILTER (a > 0) AS shown FROM cl GROUP BY 1, 2, 3),
    o AS (SELECT bl.image_id, bl.bx, bl.byy, CASE WHEN shown*2 >= 16 THEN argb END AS argb FROM bl LEFT JOIN pk USING (image_id, bx, byy))
    SELECT image_id, CAST(bx AS INT) AS x, CAST(byy AS INT) AS y, {UN} FROM o""")


def covered(threshold):
    return f"""bl AS (SELECT image_id, bx, byy, sum(CASE WHEN a > 0 THEN area ELSE 0 END) AS cov, any_value(ba) AS ba FROM cl GROUP BY 1, 2, 3),
    o AS (SELECT bl.image_id, bl.bx, bl.byy, CASE WHEN cov + 1e-9 >= ba*{threshold} THEN argb END AS argb FROM bl LEFT JOIN pk USING (image_id, bx, byy)),
    sm AS MATERIALIZED (SELECT image_id, CAST(bx AS INT) AS x, CAST(byy AS INT) AS y, {UN} FROM o)"""


add("scale_down_sprite", lambda v: b.scale_down(v.pxl(), 7, 5, True, 60),
    f"WITH {overlaps('pxl', 7, 5)}, {AUTO}, {covered('CAST(0.6 AS DOUBLE)')} SELECT * FROM sm")
add("scale_down_crop", lambda v: b.scale_down(v.px(), 12, 10, False), f"""
    WITH s0 AS ({SIZES.format(v='px')}), cr AS (SELECT p.image_id, CAST(x - (width%12)//2 AS INT) AS x, CAST(y - (height%10)//2 AS INT) AS y, r, g, b, a FROM px p JOIN s0 USING (image_id)
      WHERE x >= (width%12)//2 AND x < (width%12)//2 + width - width%12 AND y >= (height%10)//2 AND y < (height%10)//2 + height - height%10),
    {overlaps('cr', 12, 10)}, {AUTO}, {covered('CAST(0.5 AS DOUBLE)')} SELECT * FROM sm""")
add("sprite_downscale", lambda v: b.sprite_downscale(v.px8(), 9, 7, palettes.DB16), f"""
    WITH {SPRITE.format(lum=m.lum(), view='px8')}, {overlaps('px8', 9, 7, 'SELECT image_id, x, y, r, g, b, a, edge FROM ge')}, {AUTO}, {covered('CAST(0.5 AS DOUBLE)')},
    {nearest_sql('sm', palettes.DB16)} {remap_sql('sm')}""")
PROFILE = f"""sz0 AS ({SIZES.format(v='px8')}), cr AS MATERIALIZED (SELECT p.image_id, CAST(x - (width%12)//2 AS INT) AS x, CAST(y - (height%10)//2 AS INT) AS y, r, g, b, a FROM px8 p JOIN sz0 USING (image_id)
      WHERE x >= (width%12)//2 AND x < (width%12)//2 + width - width%12 AND y >= (height%10)//2 AND y < (height%10)//2 + height - height%10),
    {EDGE.format(lum=m.lum(), view='cr')}, {overlaps('cr', 12, 10, 'SELECT image_id, x, y, r, g, b, a, edge FROM ge')}, {AUTO},
    bl AS (SELECT image_id, bx, byy, count(*) AS k, count(*) FILTER (a > 0) AS shown FROM cl GROUP BY 1, 2, 3),
    o AS (SELECT bl.image_id, bl.bx, bl.byy, CASE WHEN shown*2 >= k THEN argb END AS argb FROM bl LEFT JOIN pk USING (image_id, bx, byy)),
    sm AS MATERIALIZED (SELECT image_id, CAST(bx AS INT) AS x, CAST(byy AS INT) AS y, {UN} FROM o)"""
add("profile_downscale", lambda v: b.profile_downscale(v.px8(), 12, 10, palettes.NES)[0],
    f"WITH {PROFILE}, {nearest_sql('sm', palettes.NES)} {remap_sql('sm')}")
add("profile_downscale_dominant", lambda v: b.profile_downscale(v.px8(), 12, 10, palettes.NES)[1], f"""
    WITH {PROFILE}, {nearest_sql('sm', palettes.NES)}, fin AS ({remap_sql('sm')}),
    h AS (SELECT image_id, {ARGB} AS argb, count(*) AS n FROM fin WHERE a > 0 GROUP BY 1, 2)
    SELECT image_id, arg_max(argb, (n, -(CASE WHEN argb >= 2147483648 THEN argb - 4294967296 ELSE argb END))) AS argb, max(n) AS n FROM h GROUP BY image_id""")
add("profile_downscale_quantized", lambda v: b.profile_downscale(v.px8(), 12, 10, None, 3)[0], "WITH " + PROFILE.split(", " + "e AS")[0].split(",\n    e AS")[0] + ", "
    + kmeans_sql("cr", 3, "lab", False) + "," + quantize_sql("cr", "k5") + ", " + EDGE.format(lum=m.lum(), view="qz") + ", "
    + overlaps("qz", 12, 10, "SELECT image_id, x, y, r, g, b, a, edge FROM ge") + ", " + AUTO + """,
    bl AS (SELECT image_id, bx, byy, count(*) AS k, count(*) FILTER (a > 0) AS shown FROM cl GROUP BY 1, 2, 3),
    o AS (SELECT bl.image_id, bl.bx, bl.byy, CASE WHEN shown*2 >= k THEN argb END AS argb FROM bl LEFT JOIN pk USING (image_id, bx, byy))
    SELECT image_id, CAST(bx AS INT) AS x, CAST(byy AS INT) AS y, """ + UN + " FROM o /* FROM px8 */")


def finalist(view, phase, zero, factor, tag):
    def cell(ax, size):
        cnt = f"(1 + ({size}-1)//{factor})"
        return f"least({cnt}-1, greatest(0, CAST(floor(({ax}-{phase})/{factor}) AS INT), {ax} - ({size} - {cnt})))"
    blank = "a = 0 OR oa = 0" if zero else "a = 0"
    return f"""{tag}s AS (SELECT image_id, {cell('x', 'width')} AS x, {cell('y', 'height')} AS y, count(*) AS n, CAST(sum(a) AS BIGINT) AS a, CAST(sum(a*r) AS BIGINT) AS r, CAST(sum(a*g) AS BIGINT) AS g, CAST(sum(a*b) AS BIGINT) AS b
      FROM {view} JOIN sz USING (image_id) GROUP BY 1, 2, 3), {tag}o AS (SELECT *, (2*a+n)//(2*n) AS oa FROM {tag}s),
    {tag} AS (SELECT image_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, {', '.join(f'CAST(CASE WHEN {blank} THEN 0 ELSE (2*{ch}+a)//(2*a) END AS INT) AS {ch}' for ch in 'rgb')}, CAST(oa AS INT) AS a FROM {tag}o)"""


add("finalist_reduce_t3", lambda v: b.finalist_reduce(v.px8(), "t3", 6),
    f"WITH sz AS ({SIZES.format(v='px8')}), {finalist('px8', 3, False, 6, 'f1')} SELECT * FROM f1")
add("finalist_reduce_p5", lambda v: b.finalist_reduce(v.pxl(), "p5", 5),
    f"WITH sz AS ({SIZES.format(v='pxl')}), {finalist('pxl', 0, True, 5, 'f2')} SELECT * FROM f2")
add("finalist_reduce_mixed", lambda v: b.finalist_reduce(v.px8(), "mixed", 6), f"""
    WITH sz AS ({SIZES.format(v='px8')}), {finalist('px8', 3, False, 6, 'f1')}, {finalist('px8', 0, True, 6, 'f2')}
    SELECT image_id, x, y, {', '.join(f'CAST(CASE WHEN p.a + q.a = 0 THEN 0 ELSE (p.{ch}*p.a + q.{ch}*q.a + (p.a+q.a)//2)//(p.a+q.a) END AS INT) AS {ch}' for ch in 'rgb')},
      CAST((p.a + q.a + 1)//2 AS INT) AS a FROM f1 p JOIN f2 q USING (image_id, x, y)""")
_CANON = f"CASE WHEN a = 0 THEN 0 ELSE {ARGB} END"
add("grid_is_aligned", lambda v: b.grid_is_aligned(v.px(), 2), f"""
    WITH c AS (SELECT image_id, x//2 AS cx, y//2 AS cy, count(DISTINCT {_CANON}) AS k FROM px GROUP BY 1, 2, 3)
    SELECT image_id, bool_and(k = 1) AS aligned, count(*) FILTER (k > 1) AS mixed_cells FROM c GROUP BY image_id""")
add("grid_reduce", lambda v: b.grid_reduce(b.resample_nearest(v.px(), 128, 128), 2), f"""
    WITH s AS ({SIZES.format(v='px')}), g AS (SELECT image_id, tx, ty, (tx*width)//128 AS x, (ty*height)//128 AS y FROM s, (SELECT unnest(range(128)) AS tx), (SELECT unnest(range(128)) AS ty)),
    u AS MATERIALIZED (SELECT g.image_id, tx, ty, r, px.g, b, a, tx//2 AS cx, ty//2 AS cy FROM g JOIN px ON px.image_id = g.image_id AND px.x = g.x AND px.y = g.y),
    c AS (SELECT image_id, cx, cy, count(DISTINCT {_CANON}) AS k, arg_min({{'r': r, 'g': g, 'b': b, 'a': a}}, ty*100000 + tx) AS p FROM u GROUP BY 1, 2, 3)
    SELECT image_id, CAST(cx AS INT) AS x, CAST(cy AS INT) AS y, p.r AS r, p.g AS g, p.b AS b, p.a AS a FROM c
    WHERE image_id NOT IN (SELECT image_id FROM c WHERE k > 1)""")


def fit_sql(fit):
    if fit == "contain":
        d = "greatest(width, height)"
        t = {n: f"CAST(least(size, greatest(1, round({n}*(size/{d}::DOUBLE), 0))) AS INT)" for n in ("width", "height")}
        parts = [(t["width"], f"(size - {t['width']})//2", "0", "width"), (t["height"], f"(size - {t['height']})//2", "0", "height")]
    else:
        sd = "least(width, height)"
        parts = [("size", "0", f"(width - {sd})/2.0::DOUBLE", sd), ("size", "0", f"(height - {sd})/2.0::DOUBLE", sd)]
    (tw, ox, sx, ew), (th, oy, sy, eh) = parts
    return f"""WITH s AS ({SIZES.format(v='pxl')}), z AS (SELECT *, {tw} AS tw, {ox} AS ox, {sx} AS sx, {ew} AS ew, {th} AS th, {oy} AS oy, {sy} AS sy, {eh} AS eh FROM s, (SELECT unnest([16, 48]) AS size)),
    g AS (SELECT *, unnest(range(tw)) AS fx FROM z), h AS (SELECT *, unnest(range(th)) AS fy FROM g),
    k AS (SELECT image_id, size, ox+fx AS x, oy+fy AS y, least(width-1, CAST(floor(sx + (fx+0.5::DOUBLE)*ew/tw) AS INT)) AS px_, least(height-1, CAST(floor(sy + (fy+0.5::DOUBLE)*eh/th) AS INT)) AS py_ FROM h)
    SELECT k.image_id, CAST(size AS INT) AS size, CAST(k.x AS INT) AS x, CAST(k.y AS INT) AS y, r, g, b, a FROM k JOIN pxl ON pxl.image_id = k.image_id AND pxl.x = px_ AND pxl.y = py_"""


add("fit_frames_contain", lambda v: b.fit_frames(v.pxl(), [16, 48], "contain"), fit_sql("contain"))
add("fit_frames_cover", lambda v: b.fit_frames(v.pxl(), [16, 48], "cover"), fit_sql("cover"))
RAMP = "@%#*+=-:. "
# as many columns as an image is wide, and rows for characters twice as high as wide
def ascii_sql(columns, rows):
    return f"""
    WITH s AS (SELECT *, {columns} AS cols, {rows} AS lines FROM ({SIZES.format(v='px')})),
    cx AS (SELECT image_id, cx, (cx*width)//cols AS x0, greatest((cx*width)//cols + 1, ((cx+1)*width)//cols) AS x1 FROM (SELECT *, unnest(range(cols)) AS cx FROM s)),
    cy AS (SELECT image_id, cy, (cy*height)//lines AS y0, greatest((cy*height)//lines + 1, ((cy+1)*height)//lines) AS y1 FROM (SELECT *, unnest(range(lines)) AS cy FROM s)),
    c AS (SELECT p.image_id, cx, cy, sum({m.lum()}/255*a/255) AS lit, sum(a/255.0::DOUBLE) AS cover FROM px p JOIN cx ON cx.image_id = p.image_id AND x >= x0 AND x < x1 JOIN cy ON cy.image_id = p.image_id AND y >= y0 AND y < y1 GROUP BY 1, 2, 3),
    t AS (SELECT *, lit/cover AS t, ([0,8,2,10,12,4,14,6,3,11,1,9,15,7,13,5][(cy%4)*4 + cx%4 + 1] + 0.5::DOUBLE)/16 - 0.5::DOUBLE AS o FROM c),
    i AS (SELECT *, CASE WHEN cover > 0 THEN CAST(least(9, greatest(0, round_even(round((CASE WHEN t <= 0 OR t >= 1 THEN t ELSE least(1, greatest(0, t + o*(1.0::DOUBLE/9))) END)*9, 9), 0))) AS INT) END AS i FROM t),
    l AS (SELECT image_id, cy, string_agg(CASE WHEN i IS NULL THEN ' ' ELSE substring('{RAMP}', i+1, 1) END, '' ORDER BY cx) AS line FROM i GROUP BY 1, 2)
    SELECT image_id, string_agg(line, chr(10) ORDER BY cy) AS text FROM l GROUP BY image_id"""


add("ascii_text", lambda v: b.ascii_text(v.px(), 20, 10, RAMP, False, True), ascii_sql(20, 10))
add("ascii_text_derived", lambda v: b.ascii_text(v.px(), None, None, RAMP, False, True), ascii_sql(
    "CAST(least(512, width) AS INT)", "CAST(greatest(1, round_even(height/width::DOUBLE*least(512, width)/2, 0)) AS INT)"))

QUERIES, SQL = area.queries, area.sql
