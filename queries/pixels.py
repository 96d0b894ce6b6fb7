"""Projections, filters and colour statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasmill.operators import pixels as p
from queries.base import Area

area = Area()
add = area.add
RGB = "(r*65536 + g*256 + b)"
ARGB = "(CAST(a AS BIGINT)*16777216 + r*65536 + g*256 + b)"
SIZES = "SELECT image_id, max(x)+1 AS width, max(y)+1 AS height FROM {v} GROUP BY image_id"


def long(df, *names):
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in names else F.col(c) for c in df.columns])



def _one_image(px):
    """Images on top of each other, 1,000 rows apart."""
    return px.selectExpr("0 AS image_id", "x", "CAST(image_id * 1000 + y AS INT) AS y", "r", "g", "b", "a")


add("color_histogram", lambda v: p.color_histogram(v.pxl()),
    f"SELECT image_id, {RGB} AS rgb, count(*) AS n FROM pxl WHERE a > 0 GROUP BY 1, 2")
add("dominant_color", lambda v: p.dominant_color(v.px()), f"""
    WITH h AS (SELECT image_id, {ARGB} AS argb, count(*) AS n FROM px WHERE a > 0 GROUP BY 1, 2),
    s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY n DESC,
      CASE WHEN argb >= 2147483648 THEN argb - 4294967296 ELSE argb END) AS k FROM h)
    SELECT image_id, argb, n FROM s WHERE k = 1""")
add("color_count", lambda v: p.color_count(v.px8()),
    f"SELECT image_id, count(DISTINCT CASE WHEN a > 0 THEN {RGB} END) AS n_colors FROM px8 GROUP BY image_id")


def sketched_colors(v):
    """Counts from sketches beside the exact ones: per image, and over all images from the same sketches."""
    px, sketches = v.px8(), p.color_sketches(v.px8())
    whole = px.agg(F.countDistinct(F.when(F.col("a") > 0, F.expr("r * 65536 + g * 256 + b"))).alias("n_colors")).select(F.lit(-1).cast("long").alias("image_id"), "n_colors")
    near = p.sketched_count(sketches, "image_id").unionByName(p.sketched_count(sketches).select(F.lit(-1).cast("long").alias("image_id"), "n_colors"))
    both = p.color_count(px).unionByName(whole).join(near.withColumnRenamed("n_colors", "about"), "image_id")
    return both.select("image_id", "n_colors", (F.abs(F.col("about") - F.col("n_colors")) <= F.col("n_colors") * 0.03).alias("within_3_percent"))


add("color_count_sketched", sketched_colors, f"""
    SELECT image_id, count(DISTINCT CASE WHEN a > 0 THEN {RGB} END) AS n_colors, true AS within_3_percent FROM px8 GROUP BY image_id
    UNION ALL SELECT -1, count(DISTINCT CASE WHEN a > 0 THEN {RGB} END), true FROM px8""")
add("palette_first_seen", lambda v: p.palette(v.px()), f"""
    WITH f AS (SELECT image_id, {RGB} AS rgb, min(y*100000 + x) AS q FROM px WHERE a > 0 GROUP BY 1, 2)
    SELECT image_id, CAST(ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY q) AS INT) AS rank, rgb,
      count(*) OVER (PARTITION BY image_id) AS n_colors, count(*) OVER (PARTITION BY image_id) > 1024 AS over_limit FROM f""")
# all rows as one image: far more colours than the limit
add("palette_over_limit", lambda v: p.palette(_one_image(v.px8())), f"""
    WITH f AS (SELECT {RGB} AS rgb, min((image_id*1000 + y)*100000 + x) AS q FROM px8 WHERE a > 0 GROUP BY 1)
    SELECT 0 AS image_id, CAST(ROW_NUMBER() OVER (ORDER BY q) AS INT) AS rank, rgb,
      count(*) OVER () AS n_colors, count(*) OVER () > 1024 AS over_limit FROM f""")
add("crop_rejects", lambda v: p.crop_rejects(v.px(), 12, 60), """
    SELECT image_id, max(x)+1 AS width, max(y)+1 AS height FROM px GROUP BY image_id HAVING max(x)+1 < 12 OR max(y)+1 < 60""")
add("palette_info", lambda v: p.palette_info(v.px8()), f"""
    SELECT image_id, max(x)+1 AS width, max(y)+1 AS height, count(*) AS pixel_count,
      count(*) FILTER (a = 0) AS transparent, count(*) FILTER (a > 0 AND a < 255) AS translucent,
      count(*) FILTER (a = 255) AS opaque, coalesce(bool_and(r = g AND g = b) FILTER (a > 0), true) AS grayscale,
      count(DISTINCT CASE WHEN a > 0 THEN {RGB} END) AS n_colors,
      CAST(max(x)+1 AS DOUBLE) / (max(y)+1) AS aspect_ratio,
      greatest(0, count(DISTINCT CASE WHEN a > 0 THEN {RGB} END) - 1024) AS grouped_colors
    FROM px8 GROUP BY image_id""")
add("top_colors", lambda v: p.top_colors(v.pxl(), 5), f"""
    WITH h AS (SELECT image_id, {RGB} AS rgb, count(*) AS n FROM pxl WHERE a > 0 GROUP BY 1, 2)
    SELECT * FROM (SELECT image_id, rgb, n, CAST(ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY n DESC, rgb) AS INT) AS rank FROM h)
    WHERE rank <= 5""")
add("color_treemap", lambda v: p.color_treemap(v.px8(), 64), f"""
    WITH h AS (SELECT image_id, {RGB} AS rgb, count(*) AS n FROM px8 WHERE a > 0 GROUP BY 1, 2),
    k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY n DESC, rgb) AS rank FROM h)
    SELECT image_id, rgb, n FROM k WHERE rank <= 64
    UNION ALL SELECT image_id, NULL, CAST(sum(n) AS BIGINT) FROM k WHERE rank > 64 GROUP BY image_id""")
add("transparent_flag", lambda v: p.transparent_flag(v.px()),
    "SELECT image_id, bool_or(a < 255) AS has_transparency FROM px GROUP BY image_id")
add("alpha_classes", lambda v: p.alpha_class(v.pxl()).groupBy("image_id", "alpha_class")
    .agg(F.count(F.lit(1)).alias("n")), """
    SELECT image_id, CASE WHEN a = 0 THEN 'transparent' WHEN a = 255 THEN 'opaque' ELSE 'translucent' END AS alpha_class,
      count(*) AS n FROM pxl GROUP BY 1, 2""")
add("visible_pixels", lambda v: p.visible(v.px()), "SELECT * FROM px WHERE a > 0")
add("trim_transparent", lambda v: p.trim_transparent(v.pxl()), """
    WITH b AS (SELECT image_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pxl WHERE a > 0 GROUP BY image_id)
    SELECT p.image_id, x - x0 AS x, y - y0 AS y, r, g, b, a FROM pxl p JOIN b USING (image_id)
    WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1
    UNION ALL SELECT DISTINCT image_id, 0, 0, 0, 0, 0, 0 FROM pxl WHERE image_id NOT IN (SELECT image_id FROM b)""")
add("integer_crop", lambda v: p.integer_crop(v.pxl(), 5, 7, "center", "bottom"), f"""
    WITH s AS ({SIZES.format(v='pxl')}), c AS (SELECT image_id, width - width % 5 AS cw, height - height % 7 AS ch,
      (width % 5) // 2 AS cx, height % 7 AS cy FROM s WHERE width >= 5 AND height >= 7)
    SELECT image_id, CAST(x - cx AS INT) AS x, y - cy AS y, r, g, b, a FROM pxl JOIN c USING (image_id)
    WHERE x >= cx AND x < cx + cw AND y >= cy AND y < cy + ch""")
BACKGROUND = f"""
    s AS ({SIZES.format(v='px8')}),
    bd AS (SELECT image_id, {RGB} AS rgb, CASE WHEN a >= 128 THEN (r//16)*256 + (g//16)*16 + b//16 END AS bucket,
      CASE WHEN y = 0 THEN 2*x WHEN y = height-1 THEN 2*x+1 ELSE 2*width + 2*(y-1) + CASE WHEN x = 0 THEN 0 ELSE 1 END END AS w
      FROM px8 JOIN s USING (image_id) WHERE x = 0 OR y = 0 OR x = width-1 OR y = height-1),
    bk AS (SELECT image_id, bucket, count(*) AS n, min(w) AS fw, arg_min(rgb, w) AS rgb FROM bd GROUP BY 1, 2),
    rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY bucket IS NULL, n DESC, fw) AS k FROM bk),
    bg AS (SELECT image_id, CASE WHEN 2*sum(CASE WHEN bucket IS NULL THEN n ELSE 0 END) < sum(n)
      THEN max(CASE WHEN k = 1 AND bucket IS NOT NULL THEN rgb END) END AS background FROM rk GROUP BY image_id)"""
add("detect_background", lambda v: p.detect_background(v.px8()), f"WITH {BACKGROUND} SELECT * FROM bg /* FROM px8 */")
add("remove_background_global", lambda v: p.remove_background_global(v.px8(), 12.5), f"""
    WITH {BACKGROUND}
    SELECT image_id, x, y, r, g, b, CAST(CASE WHEN background IS NOT NULL AND abs(r - background//65536) <= 32
      AND abs(g - (background//256)%256) <= 32 AND abs(b - background%256) <= 32 THEN 0 ELSE a END AS INT) AS a
    FROM px8 LEFT JOIN bg USING (image_id)""")
add("edge_band", lambda v: p.edge_band(v.px(), p.monochrome(v.px()), 2, 8), """
    SELECT image_id, x, y, CAST(CASE WHEN e AND a > 0 THEN m ELSE r END AS INT) AS r,
      CAST(CASE WHEN e AND a > 0 THEN m ELSE g END AS INT) AS g, CAST(CASE WHEN e AND a > 0 THEN m ELSE b END AS INT) AS b, a
    FROM (SELECT *, round_even(CAST(0.299*r + 0.587*g + 0.114*b AS DOUBLE), 0) AS m,
      (x%8 < 2 OR x%8 >= 6 OR y%8 < 2 OR y%8 >= 6) AS e FROM px)""")
add("grid_preview", lambda v: p.grid_preview(v.px(), 8, 5, 0, 2), """
    WITH q AS (SELECT *, (x%8 = 0 OR (y >= 2 AND (y-2)%5 = 0)) AS on_line, 255*190 + a*65 AS t FROM px)
    SELECT image_id, x, y, CAST(CASE WHEN on_line THEN (0*190*255 + r*a*65 + t//2)//t ELSE r END AS INT) AS r,
      CAST(CASE WHEN on_line THEN (200*190*255 + g*a*65 + t//2)//t ELSE g END AS INT) AS g,
      CAST(CASE WHEN on_line THEN (255*190*255 + b*a*65 + t//2)//t ELSE b END AS INT) AS b,
      CAST(CASE WHEN on_line THEN (t + 127)//255 ELSE a END AS INT) AS a FROM q /* FROM px */""")
add("replace_color", lambda v: p.replace_color(v.px(), 85 * 65536 + 85 * 256 + 170, 0x102030), f"""
    SELECT image_id, x, y, CASE WHEN a > 0 AND {RGB} = {85 * 65536 + 85 * 256 + 170} THEN 16 ELSE r END AS r,
      CASE WHEN a > 0 AND {RGB} = {85 * 65536 + 85 * 256 + 170} THEN 32 ELSE g END AS g,
      CASE WHEN a > 0 AND {RGB} = {85 * 65536 + 85 * 256 + 170} THEN 48 ELSE b END AS b, a FROM px""")
add("adjust_channel", lambda v: p.adjust_channel(p.adjust_channel(v.px8(), "r", "percent", 37.5), "a", "value", 20.5, True), """
    SELECT image_id, x, y, CAST(least(255, greatest(0, round(r + r * CAST(0.375 AS DOUBLE), 0))) AS INT) AS r, g, b,
      CAST(least(255, greatest(0, round(a - CAST(20.5 AS DOUBLE), 0))) AS INT) AS a FROM px8""")
add("monochrome", lambda v: p.monochrome(v.px8()), """
    SELECT image_id, x, y, CAST(CASE WHEN a > 0 THEN m ELSE r END AS INT) AS r, CAST(CASE WHEN a > 0 THEN m ELSE g END AS INT) AS g,
      CAST(CASE WHEN a > 0 THEN m ELSE b END AS INT) AS b, a
    FROM (SELECT *, round_even(CAST(0.299 AS DOUBLE)*r + CAST(0.587 AS DOUBLE)*g + CAST(0.114 AS DOUBLE)*b, 0) AS m FROM px8)""")
add("round_to_step", lambda v: p.round_colors(v.px8(), 24), """
    SELECT image_id, x, y, CAST(least(255, round_even(CAST(r AS DOUBLE)/24, 0)*24) AS INT) AS r,
      CAST(least(255, round_even(CAST(g AS DOUBLE)/24, 0)*24) AS INT) AS g,
      CAST(least(255, round_even(CAST(b AS DOUBLE)/24, 0)*24) AS INT) AS b, a FROM px8""")
add("palette_overlap", lambda v: p.palette_overlap(v.px8(), p.round_colors(v.px8(), 4)), f"""
    WITH l AS (SELECT DISTINCT image_id, {RGB} AS rgb FROM px8 WHERE a > 0),
    r AS (SELECT DISTINCT image_id, CAST(least(255, round_even(CAST(r AS DOUBLE)/4, 0)*4)*65536 +
      least(255, round_even(CAST(g AS DOUBLE)/4, 0)*4)*256 + least(255, round_even(CAST(b AS DOUBLE)/4, 0)*4) AS INT) AS rgb
      FROM px8 WHERE a > 0),
    j AS (SELECT coalesce(l.image_id, r.image_id) AS image_id, l.rgb AS lr, r.rgb AS rr FROM l FULL JOIN r ON l.image_id = r.image_id AND l.rgb = r.rgb)
    SELECT image_id, count(*) AS n_union, count(*) FILTER (lr IS NOT NULL AND rr IS NOT NULL) AS n_common,
      count(*) FILTER (rr IS NULL) AS n_only_first, count(*) FILTER (lr IS NULL) AS n_only_second FROM j GROUP BY image_id""")
add("invented_colors", lambda v: p.invented_colors(v.px(), v.pxd()), f"""
    SELECT image_id, CASE WHEN a = 0 THEN 0 ELSE {ARGB} END AS argb FROM pxd
    EXCEPT SELECT image_id, CASE WHEN a = 0 THEN 0 ELSE {ARGB} END FROM px""")
add("tile_layout", lambda v: p.tile_layout(p.image_sizes(v.pxl()), 6, 3, 0, 0), f"""
    WITH s AS ({SIZES.format(v='pxl')})
    SELECT *, CAST(width//6 AS INT) AS tile_cols, CAST(height//3 AS INT) AS tile_rows,
      width%6 = 0 AND height%3 = 0 AND (width//6)*(height//3) BETWEEN 1 AND 4096 AS ok FROM s""")
add("slice_tiles", lambda v: p.slice_tiles(v.px(), 12, 12, 2, 4), f"""
    WITH s AS ({SIZES.format(v='px')}), ok AS (SELECT image_id, width//16 AS tc, height//16 AS tr FROM s WHERE width%16 = 0 AND height%16 = 0)
    SELECT image_id, CAST((x-2)//16 AS INT) AS tile_col, CAST((y-2)//16 AS INT) AS tile_row, (x-2)%16 AS tx, (y-2)%16 AS ty, r, g, b, a
    FROM px JOIN ok USING (image_id) WHERE x >= 2 AND y >= 2 AND (x-2)//16 < tc AND (y-2)//16 < tr AND (x-2)%16 < 12 AND (y-2)%16 < 12""")
add("assemble_images", lambda v: p.assemble_images(v.px(), 2048), f"""
    WITH s AS ({SIZES.format(v='px')}), t AS (SELECT p.*, width, height, CAST(y // (2048//width) AS INT) AS band FROM px p JOIN s USING (image_id))
    SELECT image_id, band, width, height, list({ARGB} ORDER BY y, x) AS data FROM t GROUP BY 1, 2, 3, 4""")

QUERIES, SQL = area.queries, area.sql
