"""Colour functions, palettes, clustering and colour replacement."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasmill.functions import color as c
from atlasmill.functions import palettes
from atlasmill.functions.registry import register_functions
from atlasmill.operators import palette as pal
from queries import sqlmath as m
from queries.base import Area
from queries.pixels import ARGB, RGB

area = Area()
add = area.add
KEY = ("image_id", "x", "y")


def exprs(px, r6=6, **columns):
    """Keys plus expressions; doubles are rounded for comparison."""
    out = px.select(*KEY, *[F.expr(e).alias(n) for n, e in columns.items()])
    return out.select(*[(F.round(n, r6) + F.lit(0.0)).alias(n) if t == "double" else F.col(n)
                        for n, t in out.dtypes])


# A second pixel for two-argument functions: rotated channels and a shifted alpha.
Q = ("g", "b", "r", "((a + 64) % 256)")
P = ("r", "g", "b", "a")

add("fn_packing", lambda v: exprs(
    v.px8(), rgb=c.pack_rgb(), argb=c.pack_argb(), canonical=c.canonical_argb(),
    signed=c.signed_argb(c.pack_argb()), red=c.channel(c.pack_argb(), 2), alpha=c.channel(c.pack_argb(), 3)), f"""
    SELECT image_id, x, y, {RGB} AS rgb, {ARGB} AS argb, CASE WHEN a = 0 THEN 0 ELSE {ARGB} END AS canonical,
      CASE WHEN {ARGB} >= 2147483648 THEN {ARGB} - 4294967296 ELSE {ARGB} END AS signed, r AS red, a AS alpha FROM px8""")
add("fn_linear", lambda v: exprs(v.px8(), linear=c.srgb_to_linear("r"), back=c.linear_to_srgb(c.srgb_to_linear("r"))),
    f"SELECT image_id, x, y, {m.r6(m.lin('r'), 'linear')}, {m.r6(m.unlin(m.lin('r')), 'back')} FROM px8")
add("fn_lab", lambda v: exprs(v.px8(), **dict(zip(("l", "a", "b"), c.rgb_to_lab()))),
    "SELECT image_id, x, y, " + ", ".join(m.r6(e, n) for n, e in zip("lab", m.lab())) + " FROM px8")
add("fn_oklab", lambda v: exprs(v.px8(), **dict(zip(("l", "a", "b"), c.rgb_to_oklab()))),
    "SELECT image_id, x, y, " + ", ".join(m.r6(e, n) for n, e in zip("lab", m.oklab())) + " FROM px8")
add("fn_lab_distance", lambda v: exprs(
    v.px8(), d=c.distance(c.rgb_to_lab(), c.rgb_to_lab(*Q[:3])), d2=c.distance_sq(c.rgb_to_lab(), c.rgb_to_lab(*Q[:3]))),
    f"SELECT image_id, x, y, {m.r6(m.dist(m.lab(), m.lab(*Q[:3])), 'd')}, {m.r6(m.d2(m.lab(), m.lab(*Q[:3])), 'd2')} FROM px8")
add("fn_weights", lambda v: exprs(
    v.px8(), luminance=c.luminance601(), bright=c.brightness(), saturation=c.saturation_weight(),
    contrast=c.contrast_weight(), relief=c.relief_height()), f"""
    SELECT image_id, x, y, {m.r6(m.lum(), 'luminance')}, {m.r6(m.lum() + '/255', 'bright')}, {m.r6(m.sat(), 'saturation')},
      {m.r6(m.contrast(), 'contrast')}, {m.r6(f"({m.n(.2126)}*r + {m.n(.7152)}*g + {m.n(.0722)}*b)/255", 'relief')} FROM px8""")
add("fn_hex", lambda v: exprs(v.px8(), hex=c.rgb_hex(), parsed=c.parse_hex_color(c.rgb_hex()),
                              bad=c.parse_hex_color("concat('x', r)")), f"""
    SELECT image_id, x, y, printf('#%02X%02X%02X', r, g, b) AS hex, {RGB} AS parsed, NULL AS bad FROM px8""")
add("fn_source_over", lambda v: exprs(
    v.px8(), **{n: c.over_channel(P[i], "a", Q[i], Q[3]) for i, n in enumerate("rgb")}, a=c.over_alpha("a", Q[3])), """
    WITH q AS (SELECT *, (a + 64) % 256 AS d FROM px8), t AS (SELECT *, 255*a + d*(255-a) AS t FROM q)
    SELECT image_id, x, y, CAST((r*a*255 + g*d*(255-a) + t//2)//t AS INT) AS r, CAST((g*a*255 + b*d*(255-a) + t//2)//t AS INT) AS g,
      CAST((b*a*255 + r*d*(255-a) + t//2)//t AS INT) AS b, CAST((t + 127)//255 AS INT) AS a FROM t /* FROM px8 */""")
add("fn_ordered_dither", lambda v: exprs(v.px(), offset=c.bayer4("x", "y"), tone=c.ordered_dither(c.brightness(), "x", "y", 0.1234567), r6=6), f"""
    WITH q AS (SELECT image_id, x, y, {m.lum()}/255 AS t, ([0,8,2,10,12,4,14,6,3,11,1,9,15,7,13,5][(y%4)*4 + x%4 + 1] + 0.5::DOUBLE)/16 - 0.5::DOUBLE AS o FROM px)
    SELECT image_id, x, y, {m.r6('o', 'offset', 6)}, {m.r6('CASE WHEN t <= 0 OR t >= 1 THEN t ELSE least(1::DOUBLE, greatest(0::DOUBLE, t + o*0.1234567::DOUBLE)) END', 'tone', 6)} FROM q""")
_DA = "(CAST((a + 64) % 256 AS DOUBLE)/255)"
_A = "(CAST(a AS DOUBLE)/255)"


def _seam(bg):
    one = m.oklab_lin(*[f"({m.lin(ch)}*{_A} + {bg}*(1 - {_A}))" for ch in "rgb"])
    two = m.oklab_lin(*[f"({m.lin(ch)}*{_DA} + {bg}*(1 - {_DA}))" for ch in "gbr"])
    return m.dist(one, two)


add("fn_seam_distance", lambda v: exprs(v.px8(), seam=c.seam_distance(P, Q)),
    f"SELECT image_id, x, y, {m.r6(f'100*greatest({_seam(0)}, {_seam(1)})', 'seam')} FROM px8")
add("fn_pixel_changes", lambda v: exprs(v.px8(), edge=c.edge_difference(P, Q), cut=c.cut_change(P, Q)), f"""
    WITH q AS (SELECT *, CAST((a + 64) % 256 AS DOUBLE) AS d FROM px8)
    SELECT image_id, x, y,
      {m.r6('greatest(abs(a - d), abs(r*CAST(a AS DOUBLE)/255 - g*d/255), abs(g*CAST(a AS DOUBLE)/255 - b*d/255), abs(b*CAST(a AS DOUBLE)/255 - r*d/255))/255', 'edge')},
      {m.r6(f'(abs({_A} - d/255) + (abs(r*{_A} - g*d/255) + abs(g*{_A} - b*d/255) + abs(b*{_A} - r*d/255))/255)/4', 'cut')} FROM q /* FROM px8 */""")
add("fn_finalist_blend", lambda v: exprs(
    v.px8(), **{n: c.finalist_channel(P[i], "a", Q[i], Q[3]) for i, n in enumerate("rgb")}, a=c.finalist_alpha("a", Q[3])), """
    WITH q AS (SELECT *, (a + 64) % 256 AS d FROM px8)
    SELECT image_id, x, y, CAST((r*a + g*d + (a+d)//2)//(a+d) AS INT) AS r, CAST((g*a + b*d + (a+d)//2)//(a+d) AS INT) AS g,
      CAST((b*a + r*d + (a+d)//2)//(a+d) AS INT) AS b, CAST((a+d+1)//2 AS INT) AS a FROM q /* FROM px8 */""")


def sql_functions(v):
    register_functions(v.spark)
    return exprs(v.px8(), rgb="pack_rgb(r, g, b)", light="rgb_to_lab(r, g, b).l", mono="monochrome(r, g, b)",
                 alpha="source_over(r, g, b, a, g, b, r, 255).a", stepped="round_to_step(r, 51)")


add("sql_functions", sql_functions, f"""
    SELECT image_id, x, y, {RGB} AS rgb, {m.r6(m.lab()[0], 'light')}, CAST(round_even({m.lum()}, 0) AS INT) AS mono,
      255 AS alpha, CAST(least(255, round_even(CAST(r AS DOUBLE)/51, 0)*51) AS INT) AS stepped FROM px8""")
add("fixed_palettes", lambda v: v.px().select("r", "g", "b").distinct().select(
    F.expr(c.pack_rgb()).alias("rgb")).select(
        "rgb", *[pal.nearest_color(F.col("rgb"), palettes.fixed_palette(n)).alias(n) for n in palettes.FIXED]),
    "WITH c AS (SELECT DISTINCT " + RGB + " AS rgb FROM px) SELECT rgb, " + ", ".join(
        f"(SELECT arg_min(col1, (round({m.d2(m.lab_of('c.rgb'), m.lab_of('col1'))}, 9), col0)) FROM {m.values(colors)}) AS {n}"
        for n, colors in palettes.FIXED.items()) + " FROM c")


def nearest_sql(view: str, colors, tag: str = "") -> str:
    """Snap visible pixels of a view to a palette."""
    return f"""
    pe{tag} AS (SELECT col0 AS idx, col1 AS prgb, {', '.join(f'{e} AS p{n}' for n, e in zip('lab', m.lab_of('col1')))} FROM {m.values(colors)}),
    ucl{tag} AS (SELECT DISTINCT {RGB} AS rgb FROM {view} WHERE a > 0),
    ce{tag} AS (SELECT rgb, {', '.join(f'{e} AS c{n}' for n, e in zip("lab", m.lab_of("rgb")))} FROM ucl{tag}),
    nm{tag} AS (SELECT rgb, arg_min(prgb, (round({m.d2(('cl', 'ca', 'cb'), ('pl', 'pa', 'pb'))}, 9), idx)) AS new_rgb FROM ce{tag} CROSS JOIN pe{tag} GROUP BY rgb)"""


def remap_sql(view: str, key: str = "rgb", nm: str = "nm") -> str:
    on = f"{nm}.rgb = {RGB}" + (f" AND {nm}.image_id = p.image_id" if key == "image" else "")
    return f"""SELECT p.image_id, x, y, CAST(CASE WHEN a > 0 AND new_rgb IS NOT NULL THEN new_rgb//65536 ELSE r END AS INT) AS r,
      CAST(CASE WHEN a > 0 AND new_rgb IS NOT NULL THEN (new_rgb//256)%256 ELSE g END AS INT) AS g,
      CAST(CASE WHEN a > 0 AND new_rgb IS NOT NULL THEN new_rgb%256 ELSE b END AS INT) AS b, a FROM {view} p LEFT JOIN {nm} ON {on}"""


add("nearest_palette", lambda v: pal.nearest_palette(v.px8(), palettes.fixed_palette("db32")),
    f"WITH {nearest_sql('px8', palettes.DB32)} {remap_sql('px8')}")
CUBE = [(i % 5 * 63) << 16 | (i // 5 % 5 * 63) << 8 | i // 25 * 63 for i in range(125)]
add("nearest_custom_palette", lambda v: pal.nearest_palette(v.pxl(), CUBE),
    f"WITH {nearest_sql('pxl', CUBE)} {remap_sql('pxl')}")
add("apply_color_map", lambda v: pal.apply_color_map(
    v.pxl(), pal.color_table(v.pxl()).filter("n % 2 = 1").selectExpr("image_id", "rgb", "16777215 - rgb AS new_rgb")), f"""
    WITH nm AS (SELECT image_id, {RGB} AS rgb, 16777215 - {RGB} AS new_rgb FROM pxl WHERE a > 0 GROUP BY ALL HAVING count(*) % 2 = 1)
    {remap_sql('pxl', 'image')}""")
add("apply_colors_palette", lambda v: pal.apply_colors(v.px8(), "palette", palettes.fixed_palette("gameboy")),
    f"WITH {nearest_sql('px8', palettes.GAMEBOY)} {remap_sql('px8')}")

CT = f"""ct AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in zip(('cl', 'ca', 'cb'), m.lab_of('rgb')))} FROM
      (SELECT image_id, {RGB} AS rgb, count(*) AS n, min(y*100000 + x) AS seen FROM {{v}} WHERE a > 0 GROUP BY 1, 2))"""
_LINS = [m.lin(e) for e in ("(rgb//65536)", "((rgb//256)%256)", "(rgb%256)")]


def _from_linear(r, g, b):
    parts = [f"CAST(least(255, greatest(0, round_even({m.unlin(e)}, 0))) AS INT)" for e in (r, g, b)]
    return f"({parts[0]}*65536 + {parts[1]}*256 + {parts[2]})"


def kmeans_sql(view: str, k: int, space: str, weighted: bool, rounds: int = 5) -> str:
    w = "n" if weighted else "1"
    parts = [CT.format(v=view), f"""k0 AS (SELECT image_id, idx, rgb FROM (SELECT image_id, rgb,
      ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY seen) - 1 AS idx FROM ct) WHERE idx < {k})"""]
    for i in range(rounds):
        parts.append(f"""e{i} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in zip(('pl', 'pa', 'pb'), m.lab_of('rgb')))} FROM k{i})""")
        parts.append(f"""a{i} AS MATERIALIZED (SELECT ct.image_id, ct.rgb, any_value(n) AS n, any_value(seen) AS seen, any_value(cl) AS cl, any_value(ca) AS ca, any_value(cb) AS cb,
          arg_min(idx, (round({m.d2(('cl', 'ca', 'cb'), ('pl', 'pa', 'pb'))}, 9), idx)) AS idx FROM ct JOIN e{i} ON ct.image_id = e{i}.image_id GROUP BY 1, 2)""")
        if space == "lab":
            parts.append(f"m{i} AS (SELECT image_id, idx, sum(cl*{w})/sum({w}) AS tl, sum(ca*{w})/sum({w}) AS ta, sum(cb*{w})/sum({w}) AS tb FROM a{i} GROUP BY 1, 2)")
        else:
            parts.append(f"""l{i} AS (SELECT image_id, idx, {_from_linear(*[f'mean{j}' for j in range(3)])} AS t FROM (SELECT image_id, idx,
              {', '.join(f'sum({e}*{w})/sum({w}) AS mean{j}' for j, e in enumerate(_LINS))} FROM a{i} GROUP BY 1, 2))""")
            parts.append(f"m{i} AS (SELECT image_id, idx, {', '.join(f'{e} AS {n}' for n, e in zip(('tl', 'ta', 'tb'), m.lab_of('t')))} FROM l{i})")
        parts.append(f"""s{i} AS (SELECT image_id, idx, arg_min(rgb, (round({m.d2(('cl', 'ca', 'cb'), ('tl', 'ta', 'tb'))}, 9), seen)) AS snapped
          FROM a{i} JOIN m{i} USING (image_id, idx) GROUP BY 1, 2)""")
        parts.append(f"k{i + 1} AS (SELECT image_id, idx, coalesce(snapped, rgb) AS rgb FROM k{i} LEFT JOIN s{i} USING (image_id, idx))")
    return ", ".join(parts)


def palette_rows(last: str) -> str:
    return f" SELECT image_id, CAST(min(idx) AS INT) AS idx, rgb FROM {last} GROUP BY image_id, rgb"


add("kmeans_palette_lab", lambda v: pal.kmeans_palette(v.px8(), 4), "WITH " + kmeans_sql("px8", 4, "lab", False) + palette_rows("k5"))
add("kmeans_palette_linear", lambda v: pal.kmeans_palette(v.pxl(), 5, "linear", True),
    "WITH " + kmeans_sql("pxl", 5, "linear", True) + palette_rows("k5"))


def quantize_sql(view: str, last: str) -> str:
    """Frame ``qz``: every colour replaced by the nearest palette entry of its image."""
    return f"""
    nq AS (SELECT ct.image_id, ct.rgb, arg_min(e.rgb, (round({m.d2(('cl', 'ca', 'cb'), m.lab_of('e.rgb'))}, 9), e.idx)) AS new_rgb
      FROM ct JOIN {last} e ON ct.image_id = e.image_id GROUP BY 1, 2), qz AS MATERIALIZED ({remap_sql(view, "image", "nq")})"""


add("quantize_kmeans", lambda v: pal.quantize(v.px8(), 4), "WITH " + kmeans_sql("px8", 4, "lab", False) + "," + quantize_sql("px8", "k5") + " SELECT * FROM qz")
add("apply_colors_combined", lambda v: pal.apply_colors(v.pxl(), "combined", palettes.fixed_palette("nes"), k=8),
    "WITH " + kmeans_sql("pxl", 8, "lab", False) + "," + quantize_sql("pxl", "k5") + "," + nearest_sql("qz", palettes.NES) + " " + remap_sql("qz"))


def median_sql(view: str, k: int, weighted: bool) -> str:
    ch = ("(rgb//65536)", "((rgb//256)%256)", "(rgb%256)")
    parts = [CT.format(v=view), "b0 AS (SELECT *, 0 AS box FROM ct)"]
    for s in range(1, k):
        p = f"b{s - 1}"
        parts.append(f"""w{s} AS (SELECT image_id, arg_max(box, o) AS cut_box, arg_max(pick, o) AS pick FROM (
          SELECT image_id, box, pick, (span, -box, -pick) AS o FROM (
            {' UNION ALL '.join(f'SELECT image_id, box, {i} AS pick, max({e}) - min({e}) AS span FROM {p} GROUP BY image_id, box HAVING count(*) > 1' for i, e in enumerate(ch))})) GROUP BY image_id)""")
        parts.append(f"""r{s} AS (SELECT b.*, ROW_NUMBER() OVER o AS rank, sum(n) OVER o AS cum, sum(n) OVER (PARTITION BY b.image_id) AS total, count(*) OVER (PARTITION BY b.image_id) AS size
          FROM {p} b JOIN w{s} w ON b.image_id = w.image_id AND b.box = w.cut_box
          WINDOW o AS (PARTITION BY b.image_id ORDER BY CASE pick WHEN 0 THEN {ch[0]} WHEN 1 THEN {ch[1]} ELSE {ch[2]} END, rgb))""")
        split = "arg_min(rank, (abs(total - 2*cum), rank))" if weighted else "greatest(1, any_value(size)//2)"
        parts.append(f"p{s} AS (SELECT image_id, {split} AS split FROM r{s} WHERE rank < size GROUP BY image_id)")
        cols = "image_id, rgb, n, seen, cl, ca, cb"
        parts.append(f"""b{s} AS MATERIALIZED (SELECT {cols}, CASE WHEN rank <= split THEN {2 * s} ELSE {2 * s + 1} END AS box FROM r{s} JOIN p{s} USING (image_id)
          UNION ALL SELECT {cols}, box FROM {p} b WHERE NOT EXISTS (SELECT 1 FROM w{s} w WHERE w.image_id = b.image_id AND w.cut_box = b.box))""")
    w = "n" if weighted else "1"
    last = f"b{k - 1}"
    parts.append(f"""lm AS (SELECT image_id, box, {_from_linear('m0', 'm1', 'm2')} AS t FROM (SELECT image_id, box,
      {', '.join(f'sum({e}*{w})/sum({w}) AS m{j}' for j, e in enumerate(_LINS))} FROM {last} GROUP BY 1, 2))""")
    parts.append(f"""sn AS (SELECT image_id, box, arg_min(rgb, (round({m.d2(('cl', 'ca', 'cb'), m.lab_of('t'))}, 9), seen)) AS rgb
      FROM {last} JOIN lm USING (image_id, box) GROUP BY 1, 2)""")
    return "WITH " + ", ".join(parts) + " SELECT image_id, CAST(min(box) AS INT) AS idx, rgb FROM sn GROUP BY image_id, rgb"


add("median_cut_palette", lambda v: pal.median_cut_palette(v.px8(), 4), median_sql("px8", 4, False))
add("median_cut_weighted", lambda v: pal.median_cut_palette(v.pxl(), 3, True), median_sql("pxl", 3, True))
add("weighted_split", lambda v: pal.weighted_split(
    pal.color_table(v.pxl()).withColumn("along", F.expr(c.channel("rgb", 2))), ["image_id"], "along")
    .groupBy("image_id").agg(F.max("rank").alias("size"), F.first("split").alias("split")), f"""
    WITH {CT.format(v='pxl')}, r AS (SELECT *, ROW_NUMBER() OVER o AS rank, sum(n) OVER o AS cum, sum(n) OVER (PARTITION BY image_id) AS total,
      count(*) OVER (PARTITION BY image_id) AS size FROM ct WINDOW o AS (PARTITION BY image_id ORDER BY rgb//65536, rgb))
    SELECT image_id, any_value(size) AS size, arg_min(rank, (abs(total - 2*cum), rank)) FILTER (rank < size) AS split FROM r GROUP BY image_id""")
add("quantize_median_cut", lambda v: pal.quantize(v.pxl(), 3, "median_cut"),
    median_sql("pxl", 3, False).replace(" SELECT image_id, CAST(min(box) AS INT) AS idx, rgb FROM sn GROUP BY image_id, rgb",
    ", pl AS (SELECT image_id, min(box) AS idx, rgb FROM sn GROUP BY image_id, rgb)," + quantize_sql("pxl", "pl") + " SELECT * FROM qz"))
add("linear_average", lambda v: pal.linear_average(v.px8()), f"""
    WITH {CT.format(v='px8')}, l AS (SELECT image_id, {_from_linear('m0', 'm1', 'm2')} AS average FROM (SELECT image_id,
      {', '.join(f'avg({e}) AS m{j}' for j, e in enumerate(_LINS))} FROM ct GROUP BY 1))
    SELECT image_id, average, arg_min(rgb, (round({m.d2(('cl', 'ca', 'cb'), m.lab_of('average'))}, 9), seen)) AS member
    FROM ct JOIN l USING (image_id) GROUP BY 1, 2""")


def frequency_sql(view: str, pct: float) -> str:
    return f"""{CT.format(v=view)}, tot AS (SELECT image_id, sum(n) AS total FROM ct GROUP BY 1),
    mk AS (SELECT ct.*, total, n*100.0::DOUBLE >= {m.n(pct)}*total AS kept FROM ct JOIN tot USING (image_id)),
    pe AS (SELECT image_id, rgb, cl AS pl, ca AS pa, cb AS pb, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY n DESC, rgb) AS idx FROM mk WHERE kept),
    nm AS (SELECT c.image_id, c.rgb, any_value(c.n) AS n, arg_min(p.rgb, (round({m.d2(('cl', 'ca', 'cb'), ('pl', 'pa', 'pb'))}, 9), idx)) AS new_rgb,
      min(round({m.d2(('cl', 'ca', 'cb'), ('pl', 'pa', 'pb'))}, 9)) AS d FROM mk c JOIN pe p ON c.image_id = p.image_id WHERE NOT kept GROUP BY 1, 2)"""


add("frequency_filter", lambda v: pal.frequency_filter(v.pxl(), 0.4)[0],
    f"WITH {frequency_sql('pxl', 0.4)} {remap_sql('pxl', 'image')}")
add("frequency_filter_report", lambda v: pal.frequency_filter(v.px8(), 0.03)[1], f"""
    WITH {frequency_sql('px8', 0.03)}, s AS (SELECT image_id, CAST(any_value(total) AS BIGINT) AS visible_pixels, count(*) AS n_colors, count(*) FILTER (kept) AS n_retained FROM mk GROUP BY 1),
    k AS (SELECT image_id, count(*) AS n_replaced, CAST(sum(n) AS BIGINT) AS changed_pixels, max(d) AS d FROM nm GROUP BY 1)
    SELECT image_id, visible_pixels, n_colors, n_retained, coalesce(n_replaced, 0) AS n_replaced, coalesce(changed_pixels, 0) AS changed_pixels,
      round(sqrt(coalesce(d, 0)), 6) AS max_delta, n_retained = 0 AS rejected FROM s LEFT JOIN k USING (image_id)""")

QUERIES, SQL = area.queries, area.sql
