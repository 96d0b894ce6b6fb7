"""Comparison with reference frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasmill.operators import quality as q
from atlasmill.operators.stencil import suppress_speckles
from queries import sqlmath as m
from queries.base import Area
from queries.pixels import ARGB, RGB
from queries.stencils import ring

area = Area()
add = area.add
CANON = f"CASE WHEN a = 0 THEN 0 ELSE {ARGB} END"
add("distort_corpus", lambda v: v.pxd(), "SELECT * FROM pxd")
add("distort_phase", lambda v: q.distort_corpus(v.px(), "phase", 19), """
    WITH w AS (SELECT *, max(x) OVER (PARTITION BY image_id) + 1 AS width, max(y) OVER (PARTITION BY image_id) + 1 AS height FROM px)
    SELECT image_id, CAST((x + 3) % width AS INT) AS x, CAST((y + 2) % height AS INT) AS y, r, g, b, a FROM w""")
add("compare_pixels", lambda v: q.compare_pixels(q.distort_corpus(v.px(), "phase", 1), v.px()), f"""
    WITH a1 AS (SELECT image_id, CAST((x + 1) % (max(x) OVER (PARTITION BY image_id) + 1) AS INT) AS x, y, {CANON} AS got FROM px), e1 AS (SELECT image_id, x, y, {CANON} AS expected FROM px)
    SELECT coalesce(a1.image_id, e1.image_id) AS image_id, coalesce(a1.x, e1.x) AS x, coalesce(a1.y, e1.y) AS y, got, expected FROM a1 FULL JOIN e1 ON a1.image_id = e1.image_id AND a1.x = e1.x AND a1.y = e1.y""")
DELTA = m.dist(m.lab("p.r", "p.g", "p.b"), m.lab("d.r", "d.g", "d.b"))
add("image_diff_counts", lambda v: q.image_diff_counts(v.px(), v.pxd()), f"""
    WITH j AS (SELECT p.image_id, p.a, (p.r, p.g, p.b, p.a) <> (d.r, d.g, d.b, d.a) AS ch, {DELTA} AS e, p.r*65536+p.g*256+p.b AS c0, d.r*65536+d.g*256+d.b AS c1 FROM px p JOIN pxd d USING (image_id, x, y))
    SELECT image_id, count(*) FILTER (ch) AS changed_pixels, round(max(CASE WHEN a > 0 AND ch THEN e ELSE 0 END), 6) AS max_delta,
      count(DISTINCT c0) FILTER (a > 0) AS colors_before, count(DISTINCT c1) FILTER (a > 0) AS colors_after FROM j GROUP BY image_id""")
add("grid_quality", lambda v: q.grid_quality(v.pxd(), v.px(), 4), f"""
    WITH b AS MATERIALIZED (SELECT p.image_id, p.x, p.y, CASE WHEN p.a = 0 THEN 0 ELSE p.a::BIGINT*16777216+p.r*65536+p.g*256+p.b END AS e, CASE WHEN d.a = 0 THEN 0 ELSE d.a::BIGINT*16777216+d.r*65536+d.g*256+d.b END AS g FROM px p JOIN pxd d USING (image_id, x, y)),
    ac AS (SELECT image_id, avg(CASE WHEN e = g THEN 1 ELSE 0 END) AS pa, count(*) AS n FROM b GROUP BY 1),
    rc AS (SELECT image_id, avg(r) AS cr FROM (SELECT image_id, e, avg(CASE WHEN e = g THEN 1 ELSE 0 END) AS r FROM b GROUP BY 1, 2) GROUP BY 1),
    pu AS (SELECT image_id, sum(n) AS pure FROM (SELECT image_id, cx, cy, max(n) AS n FROM (SELECT image_id, x//4 AS cx, y//4 AS cy, g, count(*) AS n FROM b GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) GROUP BY 1),
    ed AS (SELECT p.image_id, p.e <> n.e AS ee, p.g <> n.g AS gg FROM b p JOIN b n ON n.image_id = p.image_id AND n.x = p.x+1 AND n.y = p.y UNION ALL SELECT p.image_id, p.e <> n.e, p.g <> n.g FROM b p JOIN b n ON n.image_id = p.image_id AND n.x = p.x AND n.y = p.y+1),
    f AS (SELECT image_id, count(*) FILTER (ee AND gg) AS tp, count(*) FILTER (ee <> gg) AS mis FROM ed GROUP BY 1),
    s AS (SELECT image_id, pure/n::DOUBLE AS grid_purity, pa AS pixel_accuracy, cr AS color_recall, CASE WHEN tp + mis = 0 THEN 1 ELSE 2.0::DOUBLE*tp/(2*tp+mis) END AS boundary_f1 FROM ac JOIN rc USING (image_id) JOIN pu USING (image_id) JOIN f USING (image_id))
    SELECT image_id, round(grid_purity, 6) AS grid_purity, round(pixel_accuracy, 6) AS pixel_accuracy, round(color_recall, 6) AS color_recall, round(boundary_f1, 6) AS boundary_f1,
      round(100*least(grid_purity, pixel_accuracy, color_recall, boundary_f1), 4) AS score FROM s""")
_E = m.d2(m.lab("c.r", "c.g", "c.b"), m.lab("{t}.r", "{t}.g", "{t}.b"))


def _sup(view):
    return f"""SELECT p.image_id, p.x, p.y, CAST(CASE WHEN w IS NULL THEN r ELSE (w//65536)%256 END AS INT) AS r, CAST(CASE WHEN w IS NULL THEN g ELSE (w//256)%256 END AS INT) AS g,
      CAST(CASE WHEN w IS NULL THEN b ELSE w%256 END AS INT) AS b, CAST(CASE WHEN w IS NULL THEN a ELSE w//16777216 END AS INT) AS a
      FROM {view} p LEFT JOIN (SELECT image_id, x, y, max(CASE WHEN n >= 6 THEN nc END) AS w FROM (SELECT p.image_id, p.x, p.y, {CANON.replace('a ', 'n.a ').replace('CAST(a ', 'CAST(n.a ').replace('r*', 'n.r*').replace('g*', 'n.g*').replace('+ b', '+ n.b')} AS nc, count(*) AS n
        FROM {view} p CROSS JOIN (SELECT unnest([-1,0,1]) AS dx) CROSS JOIN (SELECT unnest([-1,0,1]) AS dy) JOIN {view} n ON n.image_id = p.image_id AND n.x = p.x+dx AND n.y = p.y+dy WHERE dx <> 0 OR dy <> 0 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3 HAVING sum(n) = 8) k USING (image_id, x, y)"""


add("corpus_scores", lambda v: q.corpus_scores(v.px(), v.pxd(), suppress_speckles(v.pxd()), suppress_speckles(v.px()), "image_id % 3"), f"""
    WITH pn AS MATERIALIZED ({_sup('pxd')}), qn AS MATERIALIZED ({_sup('px')}),
    j AS (SELECT c.image_id, c.image_id % 3 AS motif, (c.r,c.g,c.b,c.a) <> (n.r,n.g,n.b,n.a) AS i, (p.r,p.g,p.b,p.a) <> (n.r,n.g,n.b,n.a) AS ch, (p.r,p.g,p.b,p.a) = (c.r,c.g,c.b,c.a) AS ex, (q.r,q.g,q.b,q.a) <> (c.r,c.g,c.b,c.a) AS dm,
      {_E.format(t='n')} AS e0, {_E.format(t='p')} AS e1 FROM px c JOIN pxd n USING (image_id, x, y) JOIN pn p USING (image_id, x, y) JOIN qn q USING (image_id, x, y) WHERE c.a > 0)
    SELECT motif, image_id, count(*) FILTER (i) AS injected, count(*) FILTER (i AND ch) AS corrected, count(*) FILTER (i AND ex) AS recovered, count(*) FILTER (i AND ch AND NOT ex) AS wrong_color, count(*) FILTER (NOT i AND ch) AS other_changes,
      count(*) FILTER (dm) AS clean_damage, round(sum(e0), 1) AS error_before, round(sum(e1), 1) AS error_after, CAST(grouping(motif, image_id) AS INT) AS level FROM j GROUP BY ROLLUP (motif, image_id)""")

QUERIES, SQL = area.queries, area.sql
