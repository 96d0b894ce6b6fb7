"""Neighbourhood filters, edges and material maps."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from atlasmill.operators import stencil as s
from queries import sqlmath as m
from queries.base import Area
from queries.pixels import ARGB, RGB

area = Area()
add = area.add

OFF = "(SELECT dx, dy FROM (SELECT unnest(range(-{r}, {r}+1)) AS dx), (SELECT unnest(range(-{r}, {r}+1)) AS dy) WHERE dx <> 0 OR dy <> 0)"
LAB = ", ".join(f"{e} AS {n}" for n, e in zip(("cl", "ca", "cb"), m.lab()))


def rounded(df, places=6):
    return df.select(*[(F.round(n, places) + F.lit(0.0)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def base(view, extra=""):
    return f"bs AS MATERIALIZED (SELECT *, {LAB}{extra} FROM {view})"


def ring(r=1, fields=("r", "g", "b", "a", "cl", "ca", "cb")):
    cols = ", ".join(f"q.{f} AS n_{f}" for f in fields)
    return f"""nb AS MATERIALIZED (SELECT p.*, dx, dy, {cols} FROM bs p CROSS JOIN {OFF.format(r=r)} o
      JOIN bs q ON q.image_id = p.image_id AND q.x = p.x + dx AND q.y = p.y + dy)"""


ND2 = m.d2(("cl", "ca", "cb"), ("n_cl", "n_ca", "n_cb"))
add("neighbors", lambda v: s.neighbors(v.px(), [(0, -1), (-1, 0), (1, 0), (0, 1)]), """
    SELECT p.image_id, p.x, p.y, dx, dy, q.r AS n_r, q.g AS n_g, q.b AS n_b, q.a AS n_a
    FROM px p CROSS JOIN (VALUES (0,-1), (-1,0), (1,0), (0,1)) o(dx, dy) JOIN px q ON q.image_id = p.image_id AND q.x = p.x+dx AND q.y = p.y+dy""")
EDGE = """e AS (SELECT *, CASE WHEN a = 0 THEN 0 ELSE {lum} END AS v FROM {view}),
    ge AS (SELECT p.*, least(1.0, sqrt(pow(coalesce(rt.v, p.v) - coalesce(lf.v, p.v), 2) + pow(coalesce(dn.v, p.v) - coalesce(up.v, p.v), 2))/255) AS edge
      FROM e p LEFT JOIN e rt ON rt.image_id = p.image_id AND rt.x = p.x+1 AND rt.y = p.y LEFT JOIN e lf ON lf.image_id = p.image_id AND lf.x = p.x-1 AND lf.y = p.y
      LEFT JOIN e dn ON dn.image_id = p.image_id AND dn.x = p.x AND dn.y = p.y+1 LEFT JOIN e up ON up.image_id = p.image_id AND up.x = p.x AND up.y = p.y-1)"""
add("edge_map", lambda v: rounded(s.edge_map(v.px8())), f"""
    WITH {EDGE.format(lum=m.lum(), view='px8')} SELECT image_id, x, y, r, g, b, a, {m.r6('edge', 'edge')} FROM ge""")
SPRITE = """e AS (SELECT *, CASE WHEN a > 0 THEN {lum} END AS v FROM {view}),
    ge AS (SELECT p.*, CASE WHEN p.a = 0 THEN 0 ELSE greatest(coalesce(abs(p.v - rt.v)/255, 1), coalesce(abs(p.v - lf.v)/255, 1), coalesce(abs(p.v - dn.v)/255, 1), coalesce(abs(p.v - up.v)/255, 1)) END AS edge
      FROM e p LEFT JOIN e rt ON rt.image_id = p.image_id AND rt.x = p.x+1 AND rt.y = p.y LEFT JOIN e lf ON lf.image_id = p.image_id AND lf.x = p.x-1 AND lf.y = p.y
      LEFT JOIN e dn ON dn.image_id = p.image_id AND dn.x = p.x AND dn.y = p.y+1 LEFT JOIN e up ON up.image_id = p.image_id AND up.x = p.x AND up.y = p.y-1)"""
add("edge_map_tall", lambda v: rounded(s.edge_map(v.tall())), f"""
    WITH {EDGE.format(lum=m.lum(), view='tall')} SELECT image_id, x, y, r, g, b, a, {m.r6('edge', 'edge')} FROM ge""")
add("sprite_edges", lambda v: rounded(s.sprite_edges(v.px8())), f"""
    WITH {SPRITE.format(lum=m.lum(), view='px8')} SELECT image_id, x, y, r, g, b, a, {m.r6('edge', 'edge')} FROM ge""")


add("sprite_edges_tall", lambda v: rounded(s.sprite_edges(v.tall())), f"""
    WITH {SPRITE.format(lum=m.lum(), view='tall')} SELECT image_id, x, y, r, g, b, a, {m.r6('edge', 'edge')} FROM ge""")


def _ediff(p, q):
    d = [f"abs(CAST({p}.a AS DOUBLE) - {q}.a)"] + [f"abs({p}.{ch}*CAST({p}.a AS DOUBLE)/255 - {q}.{ch}*CAST({q}.a AS DOUBLE)/255)" for ch in "rgb"]
    return f"coalesce(greatest({', '.join(d)})/255, 0)"


def transitions(view):
    med = "(p.{v} + coalesce(u.{v}, p.{v}) + coalesce(d.{v}, p.{v}) - least(p.{v}, coalesce(u.{v}, p.{v}), coalesce(d.{v}, p.{v})) - greatest(p.{v}, coalesce(u.{v}, p.{v}), coalesce(d.{v}, p.{v})))"
    return f"""t0 AS MATERIALIZED (SELECT p.*, CASE WHEN lf.x IS NULL THEN 0 ELSE {_ediff('p', 'lf')} END AS ex, CASE WHEN up.x IS NULL THEN 0 ELSE {_ediff('p', 'up')} END AS ey
      FROM {view} p LEFT JOIN {view} lf ON lf.image_id = p.image_id AND lf.x = p.x-1 AND lf.y = p.y LEFT JOIN {view} up ON up.image_id = p.image_id AND up.x = p.x AND up.y = p.y-1),
    t1 AS MATERIALIZED (SELECT p.image_id, p.x, p.y, p.r, p.g, p.b, p.a, {med.format(v='ex')} AS ex, p.ey FROM t0 p LEFT JOIN t0 u ON u.image_id = p.image_id AND u.x = p.x AND u.y = p.y-1
      LEFT JOIN t0 d ON d.image_id = p.image_id AND d.x = p.x AND d.y = p.y+1),
    te AS MATERIALIZED (SELECT p.image_id, p.x, p.y, p.r, p.g, p.b, p.a, p.ex, {med.format(v='ey')} AS ey FROM t1 p LEFT JOIN t1 u ON u.image_id = p.image_id AND u.x = p.x-1 AND u.y = p.y
      LEFT JOIN t1 d ON d.image_id = p.image_id AND d.x = p.x+1 AND d.y = p.y)"""


add("transition_edges", lambda v: rounded(s.transition_edges(v.px())),
    f"WITH {transitions('px')} SELECT image_id, x, y, r, g, b, a, {m.r6('ex', 'ex')}, {m.r6('ey', 'ey')} FROM te")
add("transition_edges_tall", lambda v: rounded(s.transition_edges(v.tall())),
    f"WITH {transitions('tall')} SELECT image_id, x, y, r, g, b, a, {m.r6('ex', 'ex')}, {m.r6('ey', 'ey')} FROM te")
DARK_RUNS = """
    WITH d AS (SELECT image_id, x, y FROM {view} WHERE a > 0 AND {lightness} < {limit}),
    h AS (SELECT *, x - ROW_NUMBER() OVER (PARTITION BY image_id, y ORDER BY x) AS ih, y - ROW_NUMBER() OVER (PARTITION BY image_id, x ORDER BY y) AS iv FROM d)
    SELECT image_id, x, y, count(*) OVER (PARTITION BY image_id, y, ih) AS run_h, count(*) OVER (PARTITION BY image_id, x, iv) AS run_v FROM h"""
add("dark_runs", lambda v: s.dark_runs(v.pxd(), 30.0), DARK_RUNS.format(view="pxd", lightness=m.lab()[0], limit=30))
# light enough that most pixels of the tall image are dark and its runs cross many bands
add("dark_runs_tall", lambda v: s.dark_runs(v.tall(), 95.0), DARK_RUNS.format(view="tall", lightness=m.lab()[0], limit=95))
_BOX = {"px8": "(SELECT image_id, max(x) AS mx, max(y) AS my FROM px8 GROUP BY image_id)"}
add("sharpen", lambda v: s.sharpen(v.px8(), 80, 6), f"""
    WITH o AS (SELECT dx, dy, (2-abs(dx))*(2-abs(dy)) AS k, (dy+1)*3 + dx+1 AS i FROM (SELECT unnest([-1,0,1]) AS dx), (SELECT unnest([-1,0,1]) AS dy)),
    nb AS MATERIALIZED (SELECT p.*, k, i, coalesce(c.r, h.r, v.r, p.r) AS qr, coalesce(c.g, h.g, v.g, p.g) AS qg, coalesce(c.b, h.b, v.b, p.b) AS qb, coalesce(c.a, h.a, v.a, p.a) AS qa
      FROM px8 p CROSS JOIN o LEFT JOIN px8 c ON c.image_id = p.image_id AND c.x = p.x+dx AND c.y = p.y+dy
      LEFT JOIN px8 h ON h.image_id = p.image_id AND h.x = p.x+dx AND h.y = p.y LEFT JOIN px8 v ON v.image_id = p.image_id AND v.x = p.x AND v.y = p.y+dy),
    bl AS (SELECT image_id, x, y, sum(qr*k*qa)::DOUBLE/nullif(sum(k*qa), 0) AS br, sum(qg*k*qa)::DOUBLE/nullif(sum(k*qa), 0) AS bg, sum(qb*k*qa)::DOUBLE/nullif(sum(k*qa), 0) AS bb FROM nb GROUP BY 1, 2, 3),
    w AS (SELECT n.*, r - br AS dr, g - bg AS dg, b - bb AS db, qr - r AS vr, qg - g AS vg, qb - b AS vb FROM nb n JOIN bl USING (image_id, x, y) WHERE a > 0),
    d AS (SELECT *, {m.n(0.8)}*(dr*vr + dg*vg + db*vb) AS dot, CAST(vr*vr + vg*vg + vb*vb AS DOUBLE) AS len, {m.n(0.64)}*(dr*dr + dg*dg + db*db) AS w2 FROM w
      WHERE qa*2 >= a AND (vr <> 0 OR vg <> 0 OR vb <> 0) AND greatest(abs(dr), abs(dg), abs(db)) > 6),
    f AS (SELECT *, least(1.0::DOUBLE, dot/len) AS part FROM d WHERE dot > 0 AND dot*dot >= {m.n(0.64)}*w2*len),
    g AS (SELECT image_id, x, y, arg_min({{'p': part, 'r': vr, 'g': vg, 'b': vb}}, (round(pow({m.n(0.8)}*dr - part*vr, 2) + pow({m.n(0.8)}*dg - part*vg, 2) + pow({m.n(0.8)}*db - part*vb, 2), 9), i)) AS m FROM f GROUP BY 1, 2, 3)
    SELECT image_id, x, y, CAST(coalesce(round_even(r + m.p*m.r, 0), r) AS INT) AS r, CAST(coalesce(round_even(g + m.p*m.g, 0), g) AS INT) AS g,
      CAST(coalesce(round_even(b + m.p*m.b, 0), b) AS INT) AS b, a FROM px8 LEFT JOIN g USING (image_id, x, y)""")
add("suppress_speckles", lambda v: s.suppress_speckles(v.pxd()), f"""
    WITH bs AS MATERIALIZED (SELECT *, CASE WHEN a = 0 THEN 0 ELSE {ARGB} END AS c FROM pxd), {ring(1, ('c',))},
    k AS (SELECT image_id, x, y, n_c, count(*) AS n FROM nb GROUP BY 1, 2, 3, 4),
    w AS (SELECT image_id, x, y, max(CASE WHEN n >= 6 THEN n_c END) AS w FROM k GROUP BY 1, 2, 3 HAVING sum(n) = 8)
    SELECT image_id, x, y, CAST(CASE WHEN w IS NULL THEN r ELSE (w//65536)%256 END AS INT) AS r, CAST(CASE WHEN w IS NULL THEN g ELSE (w//256)%256 END AS INT) AS g,
      CAST(CASE WHEN w IS NULL THEN b ELSE w%256 END AS INT) AS b, CAST(CASE WHEN w IS NULL THEN a ELSE w//16777216 END AS INT) AS a FROM pxd LEFT JOIN w USING (image_id, x, y)""")


def _sim(p, q, lim):
    return f"({p}.a = {q}.a AND ({p}.a = 0 OR ({p}.r-{q}.r)*({p}.r-{q}.r) + ({p}.g-{q}.g)*({p}.g-{q}.g) + ({p}.b-{q}.b)*({p}.b-{q}.b) <= {lim}))"


_C = {"p00": (-1, -1), "p10": (0, -1), "p20": (1, -1), "p01": (-1, 0), "p21": (1, 0), "p02": (-1, 1), "p12": (0, 1), "p22": (1, 1)}
_SQ = [("p00", "p10", "p01"), ("p20", "p10", "p21"), ("p02", "p12", "p01"), ("p22", "p12", "p21")]
_L = 40 * 40
_CELLS = {n: f"any_value({{'r': n_r, 'g': n_g, 'b': n_b, 'a': n_a}}) FILTER (dx = {dx} AND dy = {dy})" for n, (dx, dy) in _C.items()}
add("clean_grid_singletons", lambda v: s.clean_grid_singletons(v.pxd(), 40.0), f"""
    WITH bs AS MATERIALIZED (SELECT * FROM pxd), {ring(1, ("r", "g", "b", "a"))},
    w AS (SELECT image_id, x, y, any_value(a) AS pa, {', '.join(f'{e} AS {n}' for n, e in _CELLS.items())} FROM nb
      GROUP BY 1, 2, 3 HAVING any_value(a) > 0 AND count(*) = 8 AND count(*) FILTER (a = n_a AND (a = 0 OR (r-n_r)*(r-n_r) + (g-n_g)*(g-n_g) + (b-n_b)*(b-n_b) <= {_L})) = 0),
    k AS (SELECT *, {', '.join(f"CASE WHEN {a}.a = pa AND {_sim(a, b, _L)} AND {_sim(a, c, _L)} AND {_sim(b, c, _L)} THEN {a} END AS s{i}" for i, (a, b, c) in enumerate(_SQ))} FROM w),
    g AS (SELECT *, coalesce(s0, s1, s2, s3) AS t FROM k),
    z AS (SELECT image_id, x, y, t FROM g WHERE t IS NOT NULL AND {' AND '.join(f"(s{i} IS NULL OR {_sim('t', f's{i}', _L)})" for i in range(4))})
    SELECT image_id, x, y, coalesce(t.r, p.r) AS r, coalesce(t.g, p.g) AS g, coalesce(t.b, p.b) AS b, coalesce(t.a, p.a) AS a FROM pxd p LEFT JOIN z USING (image_id, x, y)""")
GRAD = f"""gr AS MATERIALIZED (SELECT image_id, x, y, any_value(a) AS a, any_value(cl) AS cl, any_value(ca) AS ca, any_value(cb) AS cb,
      coalesce(sum(CASE WHEN n_a = a THEN {ND2}*dx/(dx*dx+dy*dy) END)/nullif(sum(CASE WHEN n_a = a THEN abs(dx)/(dx*dx+dy*dy) END), 0), 0) AS gx,
      coalesce(sum(CASE WHEN n_a = a THEN {ND2}*dy/(dx*dx+dy*dy) END)/nullif(sum(CASE WHEN n_a = a THEN abs(dy)/(dx*dx+dy*dy) END), 0), 0) AS gy
      FROM nb GROUP BY 1, 2, 3)"""
add("contour_gradient", lambda v: rounded(s.contour_gradient(v.px8()).select("image_id", "x", "y", "gx", "gy"), 4), f"""
    WITH {base('px8')}, {ring()}, {GRAD}
    SELECT image_id, x, y, {m.r6('CASE WHEN a > 0 THEN gx ELSE 0 END', 'gx', 4)}, {m.r6('CASE WHEN a > 0 THEN gy ELSE 0 END', 'gy', 4)} FROM gr""")
CAND = f"""st AS MATERIALIZED (SELECT *, sqrt(gx*gx + gy*gy) AS len FROM gr WHERE a > 0),
    cm AS (SELECT p.image_id, p.x, p.y, any_value(p.gx) AS gx, any_value(p.gy) AS gy, any_value(p.len) AS len, count(*) AS n, sum(q.gx/q.len) AS cx, sum(q.gy/q.len) AS cy
      FROM st p JOIN st q ON p.image_id = q.image_id AND q.x BETWEEN p.x-1 AND p.x+1 AND q.y BETWEEN p.y-1 AND p.y+1 AND NOT (p.x = q.x AND p.y = q.y)
      WHERE p.len >= 30 AND q.len >= 10 AND p.a = q.a AND {m.d2(('p.cl', 'p.ca', 'p.cb'), ('q.cl', 'q.ca', 'q.cb'))} <= 3600 GROUP BY 1, 2, 3),
    cd AS (SELECT image_id, x, y FROM (SELECT *, sqrt(cx*cx + cy*cy) AS cn FROM cm WHERE n >= 2) WHERE cn > 1e-9 AND cn/n >= 0.5 - 1e-12 AND -(gx*cx + gy*cy)/(len*cn) >= 0.5 - 1e-12)"""
add("contour_candidates", lambda v: s.contour_candidates(v.px8(), similar=60.0),
    f"WITH {base('px8')}, {ring()}, {GRAD}, {CAND} SELECT * FROM cd")
add("contour_heatmap", lambda v: s.contour_heatmap(v.px8(), similar=60.0), f"""
    WITH {base('px8')}, {ring()}, {GRAD}, {CAND},
    hv AS (SELECT image_id, x, y, sum(CASE WHEN n_a = a AND dy = 0 THEN {ND2} ELSE 0 END) AS h, sum(CASE WHEN n_a = a AND dx = 0 THEN {ND2} ELSE 0 END) AS w FROM nb GROUP BY 1, 2, 3),
    ht AS (SELECT p.image_id, p.x, p.y, p.a, CASE WHEN cd.x IS NOT NULL THEN 1 ELSE least({m.n(0.45)}, sqrt(h*h + w*w)/6400*{m.n(0.45)}) END AS s
      FROM px8 p LEFT JOIN hv USING (image_id, x, y) LEFT JOIN cd ON cd.image_id = p.image_id AND cd.x = p.x AND cd.y = p.y)
    SELECT image_id, x, y, CASE WHEN a = 0 THEN 0 ELSE 255 END AS r, CASE WHEN a = 0 THEN 0 ELSE CAST(round_even(255*(1-s), 0) AS INT) END AS g,
      CASE WHEN a = 0 THEN 0 ELSE CAST(round_even(255*(1-s), 0) AS INT) END AS b, a FROM ht""")


def local_delta_sql(view, delta, keep=""):
    e1, e2 = math.exp(-0.5), math.exp(-1.0)
    return f"""{base(view, f', {RGB} AS rgb')},
    nv AS MATERIALIZED (SELECT p.image_id, p.x, p.y, p.rgb, q.rgb AS k, CASE abs(dx)+abs(dy) WHEN 0 THEN 1 WHEN 1 THEN {m.n(e1)} ELSE {m.n(e2)} END AS w, dy*3+dx AS o, q.cl AS l, q.ca AS la, q.cb AS lb
      FROM bs p CROSS JOIN (SELECT dx, dy FROM (SELECT unnest([-1,0,1]) AS dx), (SELECT unnest([-1,0,1]) AS dy)) o JOIN bs q ON q.image_id = p.image_id AND q.x = p.x+dx AND q.y = p.y+dy
      WHERE p.a > 0 AND p.a = q.a AND {m.d2(('p.cl', 'p.ca', 'p.cb'), ('q.cl', 'q.ca', 'q.cb'))} <= {delta * delta} + 1e-10),
    kk AS (SELECT image_id, x, y, k, any_value(rgb) AS rgb, round(sum(w), 9) AS w, min(o) AS o, any_value(l) AS l, any_value(la) AS la, any_value(lb) AS lb FROM nv GROUP BY 1, 2, 3, 4),
    tt AS (SELECT image_id, x, y, sum(w) AS total, sum(l*w)/sum(w) AS ml, sum(la*w)/sum(w) AS ma, sum(lb*w)/sum(w) AS mb FROM nv GROUP BY 1, 2, 3),
    ch AS (SELECT image_id, x, y, count(*) AS n, arg_max(k, (w, CASE WHEN k = rgb THEN 1 ELSE 0 END, -o)) AS top, max(w) AS tw,
      arg_min(k, (round({m.d2(('l', 'la', 'lb'), ('ml', 'ma', 'mb'))}, 9), CASE WHEN k = rgb THEN 0 ELSE 1 END, o)) AS near, any_value(total) AS total FROM kk JOIN tt USING (image_id, x, y) GROUP BY 1, 2, 3),
    nw AS (SELECT image_id, x, y, CASE WHEN tw >= round(total*0.5, 9) THEN top ELSE near END AS w FROM ch WHERE n >= 2{keep})
    SELECT image_id, x, y, CAST(CASE WHEN w IS NULL THEN r ELSE w//65536 END AS INT) AS r, CAST(CASE WHEN w IS NULL THEN g ELSE (w//256)%256 END AS INT) AS g,
      CAST(CASE WHEN w IS NULL THEN b ELSE w%256 END AS INT) AS b, a FROM {view} LEFT JOIN nw USING (image_id, x, y)"""


add("local_delta", lambda v: s.local_delta(v.px8(), 40.0, 1), "WITH " + local_delta_sql("px8", 40.0))
add("local_delta_protected", lambda v: s.local_delta(v.pxd(), 20.0, 2, True, 2))


def maps_sql(view, radius, ns, ao):
    samples = s._ao_samples(radius)
    vals = ", ".join(f"({d}, {dx}, {dy}, {sc!r}::DOUBLE)" for d, dx, dy, sc in samples)
    return f"""hb AS MATERIALIZED (SELECT *, ({m.n(.2126)}*r + {m.n(.7152)}*g + {m.n(.0722)}*b)/255 AS height FROM {view}),
    sl AS (SELECT p.image_id, p.x, p.y, d, max(CASE WHEN q.a > 0 THEN greatest(0, q.height - p.height)*sc ELSE 0 END) AS slope
      FROM hb p CROSS JOIN (VALUES {vals}) o(d, dx, dy, sc) LEFT JOIN hb q ON q.image_id = p.image_id AND q.x = p.x+dx AND q.y = p.y+dy GROUP BY 1, 2, 3, 4),
    oc AS (SELECT image_id, x, y, sum(slope/sqrt(1+slope*slope)) AS o FROM sl GROUP BY 1, 2, 3),
    sp AS (SELECT p.*, -((CASE WHEN rt.a > 0 THEN rt.height ELSE p.height END) - (CASE WHEN lf.a > 0 THEN lf.height ELSE p.height END))*0.5::DOUBLE*{ns} AS sx,
      ((CASE WHEN dn.a > 0 THEN dn.height ELSE p.height END) - (CASE WHEN up.a > 0 THEN up.height ELSE p.height END))*0.5::DOUBLE*{ns} AS sy, o
      FROM hb p JOIN oc USING (image_id, x, y) LEFT JOIN hb rt ON rt.image_id = p.image_id AND rt.x = p.x+1 AND rt.y = p.y LEFT JOIN hb lf ON lf.image_id = p.image_id AND lf.x = p.x-1 AND lf.y = p.y
      LEFT JOIN hb dn ON dn.image_id = p.image_id AND dn.x = p.x AND dn.y = p.y+1 LEFT JOIN hb up ON up.image_id = p.image_id AND up.x = p.x AND up.y = p.y-1),
    mp AS MATERIALIZED (SELECT image_id, x, y, r, g, b, a, height, CASE WHEN a > 0 THEN sx/sqrt(sx*sx+sy*sy+1) ELSE 0 END AS nx, CASE WHEN a > 0 THEN sy/sqrt(sx*sx+sy*sy+1) ELSE 0 END AS ny,
      CASE WHEN a > 0 THEN 1/sqrt(sx*sx+sy*sy+1) ELSE 1 END AS nz, CASE WHEN a > 0 THEN least(1, greatest(0, 1 - o/8*{ao})) ELSE 1 END AS ao FROM sp)"""


MAPS = maps_sql("px8", 4, 4.0, 1.0)
DBL = ("height", "nx", "ny", "nz", "ao")
add("material_maps", lambda v: rounded(s.material_maps(v.px8())),
    f"WITH {MAPS} SELECT image_id, x, y, r, g, b, a, {', '.join(m.r6(c, c) for c in DBL)} FROM mp")
add("material_map_bytes", lambda v: s.map_pixels(s.material_maps(v.px8()), "normal", "directx"), f"""
    WITH {MAPS} SELECT image_id, x, y, CAST(least(255, greatest(0, round_even((nx*0.5::DOUBLE + 0.5::DOUBLE)*255, 0))) AS INT) AS r,
      CAST(least(255, greatest(0, round_even((-ny*0.5::DOUBLE + 0.5::DOUBLE)*255, 0))) AS INT) AS g, CAST(least(255, greatest(0, round_even((nz*0.5::DOUBLE + 0.5::DOUBLE)*255, 0))) AS INT) AS b, a FROM mp""")
_LAYER = [("layer_nx", "x % 3 - 1E0"), ("layer_ny", "y % 3 - 1E0"), ("layer_nz", "5E-1"), ("normal_mask", "(x + y) % 4 / 3E0"),
          ("layer_ao", "2.5E-1"), ("ao_mask", "x % 2 * 1E0")]
add("material_blend", lambda v: rounded(s.material_blend(s.material_maps(v.px8()), v.px8().selectExpr(
    "image_id", "x", "y", *[f"{e} AS {n}" for n, e in _LAYER]))), f"""
    WITH {MAPS}, bl AS (SELECT *, nx + ((x%3 - 1) - nx)*((x+y)%4)/3 AS bx, ny + ((y%3 - 1) - ny)*((x+y)%4)/3 AS b_y, nz + (0.5::DOUBLE - nz)*((x+y)%4)/3 AS bz FROM mp),
    ln AS (SELECT *, sqrt(bx*bx + b_y*b_y + bz*bz) AS l FROM bl)
    SELECT image_id, x, y, r, g, b, a, {m.r6('height', 'height')}, {m.r6('CASE WHEN l > 0 THEN bx/l ELSE nx END', 'nx')}, {m.r6('CASE WHEN l > 0 THEN b_y/l ELSE ny END', 'ny')},
      {m.r6('CASE WHEN l > 0 THEN bz/l ELSE nz END', 'nz')}, {m.r6('ao + (0.25::DOUBLE - ao)*(x%2)', 'ao')} FROM ln""")


def _lit(ch):
    li = f"({m.lin(ch)}*sh)"
    return f"CAST(least(255, greatest(0, round_even((CASE WHEN {li} <= {m.n(0.0031308)} THEN {li}*{m.n(12.92)} ELSE {m.n(1.055)}*pow({li}, 1.0::DOUBLE/{m.n(2.4)}) - {m.n(0.055)} END)*255, 0))) AS INT) AS {ch}"


_LEN = math.sqrt(0.3 ** 2 + 0.5 ** 2 + 0.8 ** 2)
add("lit_pixels", lambda v: s.lit_pixels(s.material_maps(v.px8()), (0.3, 0.5, 0.8)), f"""
    WITH {MAPS}, lt AS (SELECT *, ao*0.25::DOUBLE + {m.n(.85)}*greatest(0, nx*{m.n(.3 / _LEN)} + ny*{m.n(.5 / _LEN)} + nz*{m.n(.8 / _LEN)}) AS sh FROM mp)
    SELECT image_id, x, y, {', '.join(_lit(ch) for ch in 'rgb')}, a FROM lt""")


def consensus_sql(view, tol, strength):
    cap, anchor = tol * tol, 1 + (1 - strength) * 8
    margin = max(0.0001, cap * 0.002 * (1 - strength))
    return f"""{base(view, f', {RGB} AS rgb')}, {ring(1, ('rgb', 'a', 'cl', 'ca', 'cb'))},
    rg AS MATERIALIZED (SELECT *, n_a/255.0::DOUBLE*CASE WHEN dx <> 0 AND dy <> 0 THEN {m.n(.7)} ELSE 1 END AS w FROM nb WHERE a > 0 AND n_a > 0),
    tt AS (SELECT image_id, x, y, ({m.n(anchor)} + any_value(a)/255.0::DOUBLE)*sum(w)/{m.n(6.8)} AS anchor, sum(w*least({ND2}, {cap})) AS base FROM rg GROUP BY 1, 2, 3 HAVING count(*) >= 2),
    cd AS (SELECT DISTINCT image_id, x, y, n_rgb AS k, n_cl AS kl, n_ca AS ka, n_cb AS kb, {ND2} AS own FROM rg WHERE n_rgb <> rgb AND {ND2} <= {cap}),
    co AS (SELECT c.image_id, c.x, c.y, k, round(any_value(anchor)*any_value(own) + sum(w*least({m.d2(('kl', 'ka', 'kb'), ('n_cl', 'n_ca', 'n_cb'))}, {cap})), 9) AS cost, any_value(base) AS base, any_value(rgb) AS rgb
      FROM cd c JOIN tt t ON c.image_id = t.image_id AND c.x = t.x AND c.y = t.y JOIN rg n ON n.image_id = c.image_id AND n.x = c.x AND n.y = c.y GROUP BY 1, 2, 3, 4),
    bb AS (SELECT image_id, x, y, any_value(rgb) AS rgb, arg_min(k, (cost, k)) AS new_rgb, min(cost) AS cost, any_value(base) AS base FROM co GROUP BY 1, 2, 3)
    SELECT image_id, x, y, rgb, new_rgb, {m.r6('base - cost', 'gain', 3)} FROM bb WHERE cost < base - {m.n(margin)}"""


add("local_consensus", lambda v: rounded(s.local_consensus(v.px8(), 40.0, 0.8), 3), "WITH " + consensus_sql("px8", 40.0, 0.8))
add("patch_pattern_counts", lambda v: s.patch_pattern_counts(v.pxd(), 1, 60.0), f"""
    WITH bs AS MATERIALIZED (SELECT *, CASE WHEN a = 0 THEN '0' WHEN {m.lab()[0]} < 60 THEN '1' ELSE '2' END AS k FROM pxd), {ring(1, ('k',))},
    p AS (SELECT image_id, x, y, any_value(k) AS k, any_value(a) AS a, string_agg(n_k, '' ORDER BY dy, dx) AS pattern FROM nb GROUP BY 1, 2, 3 HAVING count(*) = 8)
    SELECT image_id, pattern, count(*) FILTER (k = '2') AS bright, count(*) FILTER (k = '1') AS dark FROM p WHERE a > 0 GROUP BY 1, 2""")

QUERIES, SQL = area.queries, area.sql
