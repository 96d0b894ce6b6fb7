"""Connected regions, structure probe, dark features and coherent palettes."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasmill.functions import color as c
from atlasmill.operators import regions as rg
from queries import sqlmath as m
from queries.base import Area
from queries.pixels import ARGB, BACKGROUND, RGB, SIZES
from queries.stencils import LAB, rounded

area = Area()
add = area.add
Q = "(CAST(y AS BIGINT)*2147483648 + x)"


def components(src, key, conn, name="cc"):
    """Recursive flood: every pixel keeps the smallest scan code that reaches it."""
    near = "abs(p.x - f.x) <= 1 AND abs(p.y - f.y) <= 1" if conn == 8 else "abs(p.x - f.x) + abs(p.y - f.y) = 1"
    return f"""{name}_s AS MATERIALIZED (SELECT *, {key} AS k, {Q} AS q FROM {src}),
    {name}_e AS MATERIALIZED (SELECT f.image_id, f.q AS u, p.q AS v FROM {name}_s f JOIN {name}_s p ON p.image_id = f.image_id AND p.x BETWEEN f.x-1 AND f.x+1 AND p.y BETWEEN f.y-1 AND f.y+1 AND {near} AND p.k = f.k AND p.q <> f.q),
    {name}_r AS (SELECT image_id, q, q AS lab FROM {name}_s UNION SELECT r.image_id, e.v, r.lab FROM {name}_r r JOIN {name}_e e ON e.image_id = r.image_id AND e.u = r.q WHERE r.lab < e.v),
    {name} AS MATERIALIZED (SELECT s.*, l.component FROM {name}_s s JOIN (SELECT image_id, q, min(lab) AS component FROM {name}_r GROUP BY 1, 2) l USING (image_id, q))"""


add("connected_components", lambda v: rg.component_stats(rg.connected_components(v.px().filter("a > 0"), c.pack_rgb(), 4)), f"""
    WITH RECURSIVE vi AS MATERIALIZED (SELECT * FROM px WHERE a > 0), {components('vi', RGB, 4)}
    SELECT image_id, component, count(*) AS size, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM cc GROUP BY 1, 2""")
add("connected_components_tiled", lambda v: rg.component_stats(rg.connected_components(v.px().filter("a > 0"), c.pack_rgb(), 8, tile=8)), f"""
    WITH RECURSIVE vi AS MATERIALIZED (SELECT * FROM px WHERE a > 0), {components('vi', RGB, 8)}
    SELECT image_id, component, count(*) AS size, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM cc GROUP BY 1, 2""")
add("remove_background_edges", lambda v: rg.remove_background_edges(v.px8(), 30.0), f"""
    WITH RECURSIVE {BACKGROUND},
    op AS MATERIALIZED (SELECT image_id, x, y, x = 0 OR y = 0 OR x = width-1 OR y = height-1 AS edge FROM px8 JOIN bg USING (image_id) JOIN s USING (image_id) WHERE background IS NOT NULL AND (a = 0 OR (abs(r - background//65536) <= 76
      AND abs(g - (background//256)%256) <= 76 AND abs(b - background%256) <= 76))),
    fl AS (SELECT image_id, x, y FROM op WHERE edge UNION SELECT o.image_id, o.x, o.y FROM fl f JOIN op o ON o.image_id = f.image_id AND ((o.x = f.x+1 AND o.y = f.y) OR (o.x = f.x-1 AND o.y = f.y) OR (o.x = f.x AND o.y = f.y+1) OR (o.x = f.x AND o.y = f.y-1)))
    SELECT p.image_id, p.x, p.y, r, g, b, CASE WHEN fl.x IS NOT NULL THEN 0 ELSE a END AS a FROM px8 p LEFT JOIN fl ON fl.image_id = p.image_id AND fl.x = p.x AND fl.y = p.y""")
CCA = f"vi AS MATERIALIZED (SELECT *, {RGB} AS rgb FROM px WHERE a > 0), {components('vi', ARGB, 8)}"
NEAR4 = "JOIN {t} n ON n.image_id = p.image_id AND ((n.x = p.x+1 AND n.y = p.y) OR (n.x = p.x-1 AND n.y = p.y) OR (n.x = p.x AND n.y = p.y+1) OR (n.x = p.x AND n.y = p.y-1))"
OFF4 = "CROSS JOIN (VALUES (1,0),(-1,0),(0,1),(0,-1)) o(dx, dy) JOIN {t} n ON n.image_id = p.image_id AND n.x = p.x+dx AND n.y = p.y+dy"
add("component_votes", lambda v: rounded(rg.component_votes(v.px())), f"""
    WITH RECURSIVE {CCA}, vo AS (SELECT p.image_id, p.component, n.rgb, count(*) AS votes FROM cc p {OFF4.format(t='cc')} WHERE n.a = p.a AND n.component <> p.component GROUP BY 1, 2, 3)
    SELECT image_id, component, rgb, votes, {m.r6('votes::DOUBLE/sum(votes) OVER (PARTITION BY image_id, component)', 'agreement')} FROM vo""")
PROBE = f"""{CCA},
    ss AS (SELECT image_id, component, count(*) AS size, max(x)-min(x)+1 AS sx, max(y)-min(y)+1 AS sy FROM cc GROUP BY 1, 2 HAVING count(*) <= 12),
    mb AS MATERIALIZED (SELECT cc.* FROM cc JOIN ss USING (image_id, component)),
    nr AS MATERIALIZED (SELECT p.image_id, p.component, p.a, dx, dy, n.a AS na, cc.component AS nc, cc.rgb AS nrgb FROM mb p CROSS JOIN (SELECT unnest([-1,0,1]) AS dx) CROSS JOIN (SELECT unnest([-1,0,1]) AS dy)
      JOIN px n ON n.image_id = p.image_id AND n.x = p.x+dx AND n.y = p.y+dy LEFT JOIN cc ON cc.image_id = n.image_id AND cc.x = n.x AND cc.y = n.y WHERE dx <> 0 OR dy <> 0),
    sh AS (SELECT image_id, component, bool_or(na = 0) AS transparent_boundary, count(*) FILTER (nc = component AND (dx = 0 OR dy = 0)) AS card, count(*) FILTER (nc = component AND dx <> 0 AND dy <> 0) AS diag FROM nr GROUP BY 1, 2),
    vt AS (SELECT image_id, component, nrgb, count(*) AS n FROM nr WHERE (dx = 0 OR dy = 0) AND na = a AND nc <> component GROUP BY 1, 2, 3),
    be AS (SELECT image_id, component, arg_max(nrgb, (n, -nrgb)) AS best, max(n)::DOUBLE/sum(n) AS agreement FROM vt GROUP BY 1, 2),
    di AS (SELECT image_id, component, avg({m.dist(m.lab_of('rgb'), m.lab_of('best'))}) AS distance FROM mb JOIN be USING (image_id, component) GROUP BY 1, 2),
    rp AS (SELECT *, size >= 3 AND (greatest(sx, sy) >= 3*least(sx, sy) OR (diag >= 2*(size-1) AND card <= 2)) AS line FROM ss JOIN be USING (image_id, component) JOIN di USING (image_id, component) JOIN sh USING (image_id, component)
      WHERE agreement >= CAST(0.6 AS DOUBLE) AND round(distance, 9) <= 120),
    pr AS (SELECT *, transparent_boundary OR line OR (size <= 2 AND round(distance, 9) >= 60) AS protected FROM rp),
    cf AS MATERIALIZED (SELECT *, agreement*(1 - 0.25::DOUBLE*distance/120)*(1 - {m.n(.15)}*(size-1)/12)*CASE WHEN protected THEN {m.n(.35)} ELSE 1 END AS confidence FROM pr)"""
_P = {"max_distance": 120.0, "detail_distance": 60.0}
add("structure_probe_report", lambda v: rounded(rg.structure_probe(v.px(), **_P)[1]), f"""
    WITH RECURSIVE {PROBE} SELECT image_id, component, size, best, {m.r6('agreement', 'agreement')}, {m.r6('distance', 'distance')}, line, transparent_boundary, protected, {m.r6('confidence', 'confidence')} FROM cf""")
add("structure_probe", lambda v: rg.structure_probe(v.px(), **_P)[0], f"""
    WITH RECURSIVE {PROBE}, ok AS (SELECT cc.image_id, cc.x, cc.y, best FROM cc JOIN cf USING (image_id, component) WHERE NOT protected AND confidence >= 0.5)
    SELECT p.image_id, p.x, p.y, CAST(coalesce(best//65536, r) AS INT) AS r, CAST(coalesce((best//256)%256, g) AS INT) AS g, CAST(coalesce(best%256, b) AS INT) AS b, a FROM px p LEFT JOIN ok USING (image_id, x, y)""")


def heat(v):
    report = rg.structure_probe(v.px(), **_P)[1]
    return rg.structure_heatmap(v.px(), report, rg.connected_components(v.px().filter("a > 0"), c.pack_argb(), 8))


add("structure_heatmap", heat, f"""
    WITH RECURSIVE {PROBE}, ht AS (SELECT cc.image_id, cc.x, cc.y, least(255, greatest(1, round_even(255*confidence, 0))) AS h FROM cc JOIN cf USING (image_id, component)),
    g AS (SELECT p.*, h, round_even({m.n(.2126)}*r + {m.n(.7152)}*p.g + {m.n(.0722)}*b, 0) AS gray FROM px p LEFT JOIN ht USING (image_id, x, y))
    SELECT image_id, x, y, CAST(CASE WHEN a = 0 THEN r WHEN h IS NULL THEN gray ELSE 255 END AS INT) AS r, CAST(CASE WHEN a = 0 THEN g WHEN h IS NULL THEN gray ELSE round_even(gray*(1 - h/255.0::DOUBLE), 0) END AS INT) AS g,
      CAST(CASE WHEN a = 0 THEN b WHEN h IS NULL THEN gray ELSE round_even(gray*(1 - h/255.0::DOUBLE), 0) END AS INT) AS b, a FROM g /* FROM px */""")
add("structure_probe_similar", lambda v: rg.structure_probe(v.px8(), similar=18.0, max_distance=90.0)[1])
_ring = ", ".join(map(str, rg._ring_counts()))
_BITS = " + ".join(f"(CASE WHEN dx = {dx} AND dy = {dy} THEN {1 << i} ELSE 0 END)" for i, (dx, dy) in enumerate(rg.RING))
add("dark_features", lambda v: rg.dark_features(v.px(), 40.0), f"""
    WITH RECURSIVE dk AS MATERIALIZED (SELECT image_id, x, y FROM px WHERE a > 0 AND {m.lab()[0]} < 40), {components('dk', '1', 8, 'ca')}, {components('dk', '1', 4, 'cb')},
    za AS (SELECT image_id, component, count(*) AS n FROM ca GROUP BY 1, 2), zb AS (SELECT image_id, component, count(*) AS n FROM cb GROUP BY 1, 2),
    la AS (SELECT image_id, max(n) AS n FROM za GROUP BY 1), lb AS (SELECT image_id, max(n) AS n FROM zb GROUP BY 1),
    o AS (SELECT dx, dy FROM (SELECT unnest(range(-5, 6)) AS dx), (SELECT unnest(range(-5, 6)) AS dy)),
    nd AS (SELECT p.image_id, p.x, p.y, count(*) FILTER (greatest(abs(dx), abs(dy)) = 1) AS dark8, count(*) FILTER (abs(dx)+abs(dy) = 1) AS dark4, count(*) FILTER (greatest(abs(dx), abs(dy)) BETWEEN 1 AND 2) AS dark5,
      sum(CASE WHEN greatest(abs(dx), abs(dy)) = 1 THEN {_BITS} ELSE 0 END) AS mask, list((dx, dy)) FILTER (greatest(abs(dx), abs(dy)) BETWEEN 1 AND 2) AS offs
      FROM dk p CROSS JOIN o JOIN dk n ON n.image_id = p.image_id AND n.x = p.x+dx AND n.y = p.y+dy WHERE greatest(abs(dx), abs(dy)) <= 2 GROUP BY 1, 2, 3),
    cl AS (SELECT p.image_id, p.x, p.y, coalesce(min(CASE WHEN n.x IS NULL THEN greatest(abs(dx), abs(dy)) END), 6) AS clearance FROM dk p CROSS JOIN o LEFT JOIN (SELECT * FROM px WHERE a > 0) n ON n.image_id = p.image_id AND n.x = p.x+dx AND n.y = p.y+dy GROUP BY 1, 2, 3)
    SELECT d.image_id, d.x, d.y, za.n AS component, la.n AS largest, zb.n AS component4, lb.n AS largest4, dark8, dark4, dark5,
      {' + '.join(f"(CASE WHEN list_contains(offs, ({dx}, {dy})) AND list_contains(offs, ({2 * dx}, {2 * dy})) THEN 1 ELSE 0 END)" for dx, dy in rg.RING)} AS run2,
      {' OR '.join(f"(coalesce(list_contains(offs, ({dx}, {dy})) AND list_contains(offs, ({-dx}, {-dy})), false))" for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1)))} AS opposite,
      clearance, [{_ring}][CAST(mask AS INT)+1] AS ring
    FROM dk d JOIN ca USING (image_id, x, y) JOIN za ON za.image_id = d.image_id AND za.component = ca.component JOIN la ON la.image_id = d.image_id
      JOIN cb ON cb.image_id = d.image_id AND cb.x = d.x AND cb.y = d.y JOIN zb ON zb.image_id = d.image_id AND zb.component = cb.component JOIN lb ON lb.image_id = d.image_id
      JOIN (SELECT d.image_id, d.x, d.y, coalesce(dark8, 0) AS dark8, coalesce(dark4, 0) AS dark4, coalesce(dark5, 0) AS dark5, coalesce(mask, 0) AS mask, coalesce(offs, []) AS offs FROM dk d LEFT JOIN nd USING (image_id, x, y)) nn ON nn.image_id = d.image_id AND nn.x = d.x AND nn.y = d.y
      JOIN cl ON cl.image_id = d.image_id AND cl.x = d.x AND cl.y = d.y""")
add("dark_noise_candidates", lambda v: rg.dark_noise_candidates(v.pxd(), 20.0, 1, 2, 1, 10.0, 60.0, 0.3), f"""
    WITH bs AS MATERIALIZED (SELECT *, {LAB}, {RGB} AS rgb, a > 0 AND {m.lab()[0]} < 20 AS dark FROM pxd),
    nb AS MATERIALIZED (SELECT p.image_id, p.x, p.y, p.rgb, p.cl, dx, dy, n.rgb AS nrgb, n.a AS na, n.dark AS nd, n.cl AS l, n.ca AS la, n.cb AS lb
      FROM bs p CROSS JOIN (SELECT unnest([-1,0,1]) AS dx) CROSS JOIN (SELECT unnest([-1,0,1]) AS dy) JOIN bs n ON n.image_id = p.image_id AND n.x = p.x+dx AND n.y = p.y+dy WHERE p.dark AND (dx <> 0 OR dy <> 0)),
    ce AS (SELECT image_id, x, y, any_value(rgb) AS rgb, any_value(cl) AS cl, count(*) FILTER (NOT nd) AS nbright FROM nb GROUP BY 1, 2, 3
      HAVING count(*) = 8 AND min(na) > 0 AND count(*) FILTER (nd) <= 2 AND count(*) FILTER (nd AND (dx = 0 OR dy = 0)) <= 1 AND count(*) FILTER (NOT nd) >= 5),
    br AS (SELECT nb.* FROM nb JOIN ce USING (image_id, x, y) WHERE NOT nd),
    su AS (SELECT k.image_id, k.x, k.y, k.nrgb, k.l, k.la, k.lb, k.dy*3 + k.dx AS o, round(sum(greatest(0, 1 - {m.dist(('k.l', 'k.la', 'k.lb'), ('v.l', 'v.la', 'v.lb'))}/60)), 9) AS s
      FROM br k JOIN br v ON v.image_id = k.image_id AND v.x = k.x AND v.y = k.y GROUP BY ALL),
    bt AS (SELECT image_id, x, y, arg_max({{'rgb': nrgb, 'l': l, 'la': la, 'lb': lb}}, (s, -o)) AS best FROM su GROUP BY 1, 2, 3),
    ag AS (SELECT b.image_id, b.x, b.y, any_value(best) AS best, count(*) FILTER ({m.dist(('best.l', 'best.la', 'best.lb'), ('l', 'la', 'lb'))} <= 60) AS n FROM bt b JOIN br USING (image_id, x, y) GROUP BY 1, 2, 3)
    SELECT image_id, x, y, rgb, best.rgb AS new_rgb FROM ag JOIN ce USING (image_id, x, y) WHERE best.l - cl >= 10 AND n >= {m.n(.3)}*nbright""")
OK = ", ".join(f"{e} AS k{n}" for n, e in zip("lab", m.oklab("(rgb//65536)", "((rgb//256)%256)", "(rgb%256)")))
COH = f"""vi AS MATERIALIZED (SELECT *, {RGB} AS rgb FROM px WHERE a > 0), {components('vi', 'rgb', 8)},
    re AS (SELECT image_id, rgb, component, count(*) AS size FROM cc GROUP BY 1, 2, 3), co AS (SELECT image_id, rgb, CAST(sum(size) AS BIGINT) AS n, CAST(sum(size*size) AS BIGINT) AS squares FROM re GROUP BY 1, 2),
    ti AS (SELECT image_id, rgb, max(k) AS tile_max FROM (SELECT image_id, rgb, x//16 AS tx, y//16 AS ty, count(*) AS k FROM cc GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
    ok AS MATERIALIZED (SELECT *, {OK} FROM co JOIN ti USING (image_id, rgb)),
    ne AS (SELECT p.image_id, p.rgb, min({m.d2(('p.kl', 'p.ka', 'p.kb'), ('q.kl', 'q.ka', 'q.kb'))}) AS nearest_sq FROM ok p JOIN ok q ON q.image_id = p.image_id AND q.rgb <> p.rgb GROUP BY 1, 2),
    sc AS MATERIALIZED (SELECT ok.*, squares::DOUBLE/n AS coherence, nearest_sq, pow(n, 0.5)*pow(squares::DOUBLE/n, 0.5)*(1 + 2.0::DOUBLE*tile_max/n)*nearest_sq AS cost FROM ok JOIN ne USING (image_id, rgb))"""
add("color_coherence", lambda v: rounded(rg.color_coherence(v.px(), 16).select(
    "image_id", "rgb", "n", "squares", "coherence", "tile_max", "nearest_sq", "cost")), f"""
    WITH RECURSIVE {COH} SELECT image_id, rgb, n, squares, {m.r6('coherence', 'coherence')}, tile_max, {m.r6('nearest_sq', 'nearest_sq')}, {m.r6('cost', 'cost')} FROM sc""")
add("connected_palette", lambda v: rg.connected_palette(v.px(), 6, 16), f"""
    WITH RECURSIVE {COH}, rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY round(cost, 6) DESC, rgb) <= 6 AS kept FROM sc),
    gn AS (SELECT p.image_id, p.rgb, any_value(p.kl) AS kl, any_value(p.ka) AS ka, any_value(p.kb) AS kb, min((round({m.d2(('p.kl', 'p.ka', 'p.kb'), ('q.kl', 'q.ka', 'q.kb'))}, 9), q.rgb)) AS z FROM rk p JOIN rk q ON q.image_id = p.image_id AND q.kept WHERE NOT p.kept GROUP BY 1, 2),
    vo AS (SELECT p.image_id, p.component, any_value(p.rgb) AS rgb, n.rgb AS v_rgb, count(*) AS votes FROM cc p {OFF4.format(t='cc')} JOIN rk ON rk.image_id = n.image_id AND rk.rgb = n.rgb AND kept WHERE n.a = p.a AND n.rgb <> p.rgb GROUP BY p.image_id, p.component, n.rgb),
    vc AS (SELECT vo.image_id, component, v_rgb, round({m.d2(('q.kl', 'q.ka', 'q.kb'), ('g.kl', 'g.ka', 'g.kb'))} - 0.5::DOUBLE*votes/sum(votes) OVER (PARTITION BY vo.image_id, component)*{m.n(.02)}, 9) AS cost
      FROM vo JOIN gn g ON g.image_id = vo.image_id AND g.rgb = vo.rgb JOIN rk q ON q.image_id = vo.image_id AND q.rgb = v_rgb),
    pv AS (SELECT image_id, component, min((cost, v_rgb)) AS v FROM vc GROUP BY 1, 2),
    ch AS (SELECT cc.image_id, cc.x, cc.y, CASE WHEN v[1] < z[1] THEN v[2] ELSE z[2] END AS w FROM cc JOIN gn USING (image_id, rgb) LEFT JOIN pv ON pv.image_id = cc.image_id AND pv.component = cc.component)
    SELECT p.image_id, p.x, p.y, CAST(coalesce(w//65536, r) AS INT) AS r, CAST(coalesce((w//256)%256, g) AS INT) AS g, CAST(coalesce(w%256, b) AS INT) AS b, a FROM px p LEFT JOIN ch USING (image_id, x, y)""")

QUERIES, SQL = area.queries, area.sql
