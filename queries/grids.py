"""Grid detection, tile suggestions and seams."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from atlasmill.operators import grid as g
from queries import sqlmath as m
from queries.base import Area
from queries.pixels import ARGB, SIZES
from queries.stencils import rounded, transitions

area = Area()
add = area.add

PROFILES = transitions("{v}") + """,
    pf AS MATERIALIZED (SELECT image_id, 'x' AS axis, x AS pos, CASE WHEN x = 0 THEN 0 ELSE avg(ex) END AS v FROM te GROUP BY 1, 2, 3
      UNION ALL SELECT image_id, 'y', y, CASE WHEN y = 0 THEN 0 ELSE avg(ey) END FROM te GROUP BY 1, 2, 3)"""
TURN = f"CAST({2 * math.pi!r} AS DOUBLE)"


def scores(view, lo, hi):
    return PROFILES.format(v=view) + f""",
    ln AS (SELECT *, count(*) OVER w AS n, avg(v) OVER w AS mean, max(v) OVER w AS peak FROM pf WINDOW w AS (PARTITION BY image_id, axis)),
    pt AS (SELECT * FROM ln, (SELECT unnest(range({lo}, {hi}+1)) AS pitch)),
    ph AS (SELECT image_id, axis, pitch, any_value(n) AS n, count(*) FILTER (v > peak*{m.n(.03)}) AS edges,
      sum(CASE WHEN pos > 0 THEN v*cos(pos*{TURN}/pitch) ELSE 0 END) AS re, sum(CASE WHEN pos > 0 THEN v*sin(pos*{TURN}/pitch) ELSE 0 END) AS im, sum(CASE WHEN pos > 0 THEN v ELSE 0 END) AS s FROM pt GROUP BY 1, 2, 3),
    pe AS (SELECT p.image_id, p.axis, p.pitch, sum((p.v-p.mean)*(q.v-p.mean)) AS c, sum(((p.v-p.mean)*(p.v-p.mean) + (q.v-p.mean)*(q.v-p.mean))*0.5::DOUBLE) AS w
      FROM pt p JOIN pf q ON q.image_id = p.image_id AND q.axis = p.axis AND q.pos = p.pos - p.pitch GROUP BY 1, 2, 3),
    sc AS (SELECT ph.*, CASE WHEN s < 1e-10 THEN 0 ELSE sqrt(re*re + im*im)/s END AS confidence, CASE WHEN coalesce(w, 0) < 1e-10 THEN 0 ELSE c/w END AS periodicity,
      atan2(im, re)*ph.pitch/{TURN} AS raw FROM ph LEFT JOIN pe USING (image_id, axis, pitch))"""


add("projection_profiles", lambda v: rounded(g.projection_profiles(v.px())),
    f"WITH {PROFILES.format(v='px')} SELECT image_id, axis, pos, {m.r6('v', 'v')} FROM pf")
add("projection_profiles_tall", lambda v: rounded(g.projection_profiles(v.tall())),
    f"WITH {PROFILES.format(v='tall')} SELECT image_id, axis, pos, {m.r6('v', 'v')} FROM pf")
add("phase", lambda v: rounded(g.phase(g.projection_profiles(v.px()), 8), 5), f"""
    WITH {scores('px', 8, 8)} SELECT image_id, axis, {m.r6('CASE WHEN raw < -4 + 1e-8 THEN raw + 8 ELSE raw END', 'phase', 5)}, {m.r6('confidence', 'confidence', 5)} FROM sc""")
DETECT = """bo AS (SELECT image_id, pitch, min(n) AS n, min(edges) AS edges, min(confidence) AS confidence, sum(periodicity) AS periodicity FROM sc GROUP BY 1, 2 HAVING count(*) = 2),
    ok AS (SELECT *, edges >= 4 AND round(confidence, 9) > CAST(0.985 AS DOUBLE) AS exact FROM bo WHERE pitch <= n//3),
    be AS (SELECT image_id, max(CASE WHEN exact THEN pitch END) AS ep, arg_max(confidence, CASE WHEN exact THEN pitch END) AS ec,
      arg_max(pitch, (round(periodicity, 9), -pitch)) AS pp, arg_max(periodicity, (round(periodicity, 9), -pitch)) AS ps FROM ok GROUP BY 1)"""
PITCH = f"""SELECT image_id, CAST(CASE WHEN ep IS NOT NULL THEN ep WHEN ps >= CAST(0.05 AS DOUBLE) THEN pp END AS INT) AS pitch,
      {m.r6('CASE WHEN ep IS NOT NULL THEN ec WHEN ps >= CAST(0.05 AS DOUBLE) THEN least(1, greatest(0, ps/2)) ELSE 0 END', 'confidence', 5)} FROM be"""
add("detect_pitch", lambda v: rounded(g.detect_pitch(g.projection_profiles(v.px())), 5),
    f"WITH {scores('px', 2, 32)}, {DETECT} {PITCH}")


# profiles of the tall image span several blocks
add("phase_tall", lambda v: rounded(g.phase(g.projection_profiles(v.tall()), 8), 5), f"""
    WITH {scores('tall', 8, 8)} SELECT image_id, axis, {m.r6('CASE WHEN raw < -4 + 1e-8 THEN raw + 8 ELSE raw END', 'phase', 5)}, {m.r6('confidence', 'confidence', 5)} FROM sc""")
add("detect_pitch_tall", lambda v: rounded(g.detect_pitch(g.projection_profiles(v.tall())), 5),
    f"WITH {scores('tall', 2, 32)}, {DETECT} {PITCH}")


def upscaled(v):
    from atlasmill.operators.blocks import resample_nearest
    return resample_nearest(v.pxl(), 72, 84)


UP = f"""us AS ({SIZES.format(v='pxl')}), ug AS (SELECT image_id, tx, ty, (tx*width)//72 AS x, (ty*height)//84 AS y FROM us, (SELECT unnest(range(72)) AS tx), (SELECT unnest(range(84)) AS ty)),
    up3 AS MATERIALIZED (SELECT ug.image_id, tx AS x, ty AS y, r, pxl.g, b, a FROM ug JOIN pxl ON pxl.image_id = ug.image_id AND pxl.x = ug.x AND pxl.y = ug.y)"""
add("detect_pitch_upscaled", lambda v: rounded(g.detect_pitch(g.projection_profiles(upscaled(v))), 5),
    f"WITH {UP}, {scores('up3', 2, 32)}, {DETECT} {PITCH} /* FROM pxl */")


def vote_sql(view, pitch, px, py):
    def b(i, n, size, ph):
        return f"CASE WHEN {i} = 0 THEN 0.0::DOUBLE WHEN {i} = {n} THEN {size}::DOUBLE ELSE least({size} - ({n}-{i})*least({pitch}*0.25::DOUBLE, {size}/(2.0::DOUBLE*({n}+1))), greatest({i}*least({pitch}*0.25::DOUBLE, {size}/(2.0::DOUBLE*({n}+1))), {i}*{pitch} + {m.n(ph)})) END"
    return f"""sz AS ({SIZES.format(v=view)}), nc AS (SELECT *, CAST(ceil(width/{pitch}.0) AS INT) AS nx, CAST(ceil(height/{pitch}.0) AS INT) AS ny FROM sz),
    vx AS (SELECT image_id, cx, {b('cx', 'nx', 'width', px)} AS x0, {b('(cx+1)', 'nx', 'width', px)} AS x1 FROM (SELECT *, unnest(range(nx)) AS cx FROM nc)),
    vy AS (SELECT image_id, cy, {b('cy', 'ny', 'height', py)} AS y0, {b('(cy+1)', 'ny', 'height', py)} AS y1 FROM (SELECT *, unnest(range(ny)) AS cy FROM nc)),
    vo AS (SELECT p.image_id, cx, cy, CASE WHEN a = 0 THEN 0 ELSE {ARGB} END AS argb, sum((least(x+1, x1)-greatest(x, x0))*(least(y+1, y1)-greatest(y, y0))
      *exp(-10*(pow((x+0.5::DOUBLE-(x0+x1)*0.5::DOUBLE)/(x1-x0), 2) + pow((y+0.5::DOUBLE-(y0+y1)*0.5::DOUBLE)/(y1-y0), 2)))) AS w
      FROM {view} p JOIN vx ON vx.image_id = p.image_id AND x0 < x+1 AND x1 > x JOIN vy ON vy.image_id = p.image_id AND y0 < y+1 AND y1 > y GROUP BY 1, 2, 3, 4),
    vt AS MATERIALIZED (SELECT image_id, cx, cy, arg_max(argb, (round(w, 9), -argb)) AS argb FROM vo GROUP BY 1, 2, 3)"""


add("grid_vote", lambda v: g.grid_vote(v.px(), pitch=8, phase_x=1.25, phase_y=-2.5),
    f"WITH {vote_sql('px', 8, 1.25, -2.5)} SELECT image_id, CAST(cx AS INT) AS cx, CAST(cy AS INT) AS cy, argb FROM vt")
add("align_to_grid", lambda v: g.align_to_grid(v.pxl(), 3)[0], f"""
    WITH {vote_sql('pxl', 3, 0.0, 0.0)} SELECT p.image_id, p.x, p.y, CAST((argb//65536)%256 AS INT) AS r, CAST((argb//256)%256 AS INT) AS g, CAST(argb%256 AS INT) AS b, CAST(argb//16777216 AS INT) AS a
    FROM pxl p JOIN vt ON vt.image_id = p.image_id AND cx = p.x//3 AND cy = p.y//3""")


def cut_sql(view):
    def ch(q):
        qa, pa = f"({q}.a/255.0::DOUBLE)", "(p.a/255.0::DOUBLE)"
        return f"(abs({qa} - {pa}) + (" + " + ".join(f"abs({q}.{c}*{qa} - p.{c}*{pa})" for c in "rgb") + ")/255)/4"
    return f"""sz AS ({SIZES.format(v=view)}),
    ct AS MATERIALIZED (SELECT p.image_id, 'x' AS axis, p.x AS pos, avg({ch('q')}) AS v FROM {view} p JOIN {view} q ON q.image_id = p.image_id AND q.x = p.x-1 AND q.y = p.y GROUP BY 1, 2, 3
      UNION ALL SELECT p.image_id, 'y', p.y, avg({ch('q')}) FROM {view} p JOIN {view} q ON q.image_id = p.image_id AND q.x = p.x AND q.y = p.y-1 GROUP BY 1, 2, 3)"""


_PRIOR = " ".join(f"WHEN {s} THEN {v}" for s, v in g.SIZE_PRIOR.items())
SUGGEST = f"""{cut_sql('px')}, mn AS (SELECT image_id, axis, avg(v) AS mean FROM ct GROUP BY 1, 2),
    cs AS (SELECT unnest(range(4, 513)) AS w, unnest(range(4, 513)) AS h UNION ALL SELECT * FROM (VALUES (8,16),(16,8),(16,32),(32,16),(32,64),(64,32),(64,128),(128,64),(128,256),(256,128))),
    gr AS (SELECT image_id, w, h, width//w AS c, height//h AS r FROM sz, cs WHERE width%w = 0 AND height%h = 0 AND (w <> h OR w <= least(512, width, height)) AND (width//w)*(height//h) >= 2),
    ev AS (SELECT gr.image_id, w, h, ct.axis, sum(v)/(CASE WHEN ct.axis = 'x' THEN any_value(c) ELSE any_value(r) END - 1) AS bd, any_value(mean) AS mean
      FROM gr JOIN ct ON ct.image_id = gr.image_id AND pos % (CASE WHEN ct.axis = 'x' THEN w ELSE h END) = 0 JOIN mn ON mn.image_id = ct.image_id AND mn.axis = ct.axis GROUP BY 1, 2, 3, 4),
    es AS (SELECT image_id, w, h, sum(CASE WHEN mean < 1e-9 THEN 0 ELSE least(1, greatest(-1, (bd-mean)/(bd+mean+1e-9))) END) AS e FROM ev GROUP BY 1, 2, 3),
    sg AS (SELECT gr.image_id, CAST(w AS INT) AS tile_w, CAST(h AS INT) AS tile_h, CAST(c AS INT) AS tile_cols, CAST(r AS INT) AS tile_rows,
      round(CASE WHEN w <> h THEN 20 ELSE CASE w {_PRIOR} ELSE 15 END END - 8*abs(ln(c*r/18.0::DOUBLE)) + coalesce(e, 0)*12, 6) AS score FROM gr LEFT JOIN es USING (image_id, w, h))"""
add("cut_profiles_tall", lambda v: rounded(g.cut_profiles(v.tall()), 9), f"WITH {cut_sql('tall')} SELECT image_id, axis, pos, {m.r6('v', 'v', 9)} FROM ct")
add("cut_profiles", lambda v: rounded(g.cut_profiles(v.px()), 9), f"WITH {cut_sql('px')} SELECT image_id, axis, pos, {m.r6('v', 'v', 9)} FROM ct")
add("suggest_tile_grids", lambda v: g.suggest_tile_grids(v.px()), f"WITH {SUGGEST} SELECT * FROM sg")
add("best_suggestions", lambda v: g.best_suggestions(v.px(), 3), f"""
    WITH {SUGGEST} SELECT * FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY score DESC, tile_cols*tile_rows, tile_w) AS INT) AS rank FROM sg) WHERE rank <= 3""")


def seams(v):
    pairs = v.tiles().select(F.col("tile_id").alias("first_id")).distinct().withColumn(
        "second_id", F.col("first_id") + 1)
    return g.tile_pair_seams(v.tiles(), pairs, 8, 8)


_LINEAR = "({lin}*{a} + {bg}*(1 - {a}))"


def _seam(bg):
    def side(t):
        a = f"({t}.a/255.0::DOUBLE)"
        return m.oklab_lin(*[f"({m.lin(f'{t}.{ch}')}*{a} + {bg}*(1 - {a}))" for ch in "rgb"])
    return m.dist(side("p"), side("q"))


SEAMS = f"""se AS (SELECT p.tile_id AS first_id, q.tile_id AS second_id, 'x' AS axis, p.ty AS pos, 100*greatest({_seam(0)}, {_seam(1)}) AS difference
      FROM tiles p JOIN tiles q ON q.tile_id = p.tile_id+1 AND p.ty = q.ty WHERE p.tx = 7 AND q.tx = 0
    UNION ALL SELECT p.tile_id, q.tile_id, 'y', p.tx, 100*greatest({_seam(0)}, {_seam(1)}) FROM tiles p JOIN tiles q ON q.tile_id = p.tile_id+1 AND p.tx = q.tx WHERE p.ty = 7 AND q.ty = 0)"""
add("tile_pair_seams", lambda v: rounded(seams(v)), f"WITH {SEAMS} SELECT first_id, second_id, axis, pos, {m.r6('difference', 'difference')} FROM se")
add("seam_summary", lambda v: rounded(g.seam_summary(seams(v), 20.0)), f"""
    WITH {SEAMS} SELECT first_id, second_id, axis, {m.r6('avg(difference)', 'mean')}, {m.r6('max(difference)', 'maximum')}, count(*) FILTER (difference > 20) AS above, count(*) AS n FROM se GROUP BY 1, 2, 3""")

QUERIES, SQL = area.queries, area.sql
