"""Frames, sheets, cels and boards."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasmill.operators import animation as an
from queries.base import Area

area = Area()
add = area.add
add("tag_frames", lambda v: an.tag_frames(v.frames(), v.tags()), """
    SELECT f.doc_id, f.frame, duration_ms, t.name FROM frames f JOIN tags t ON f.doc_id = t.doc_id AND f.frame BETWEEN from_frame AND to_frame""")
add("frame_offsets", lambda v: an.frame_offsets(v.frames()), """
    SELECT *, CAST(coalesce(sum(duration_ms) OVER (PARTITION BY doc_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM frames""")
add("sequence_totals", lambda v: an.sequence_totals(v.frames()),
    "SELECT doc_id, count(*) AS frame_count, CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM frames GROUP BY doc_id")
add("sheet_layout", lambda v: an.sheet_layout(v.frames(), 48, 32, "grid", 4, 3), """
    WITH n AS (SELECT doc_id, least(4, count(*)) AS c, count(*) AS n FROM frames GROUP BY 1),
    p AS (SELECT f.doc_id, frame, c, n, ROW_NUMBER() OVER (PARTITION BY f.doc_id ORDER BY frame) - 1 AS i FROM frames f JOIN n USING (doc_id))
    SELECT doc_id, frame, (i % c)*51 AS x, (i//c)*35 AS y, c*48 + (c-1)*3 AS sheet_width, ((n+c-1)//c)*32 + ((n+c-1)//c - 1)*3 AS sheet_height,
      c*48 + (c-1)*3 <= 32768 AND ((n+c-1)//c)*32 + ((n+c-1)//c - 1)*3 <= 32768 AND (c*48 + (c-1)*3)*(((n+c-1)//c)*32 + ((n+c-1)//c - 1)*3) <= 16777216 AS within_limits FROM p""")
add("sheet_layout_horizontal", lambda v: an.sheet_layout(v.frames(), 4000, 900, "horizontal"), """
    WITH n AS (SELECT doc_id, count(*) AS n FROM frames GROUP BY 1)
    SELECT doc_id, frame, (ROW_NUMBER() OVER (PARTITION BY f.doc_id ORDER BY frame) - 1)*4000 AS x, 0 AS y, n*4000 AS sheet_width, 900 AS sheet_height, n*4000 <= 32768 AND n*4000*900 <= 16777216 AS within_limits FROM frames f JOIN n USING (doc_id)""")


def two_layers(v):
    """The posterised frame below a shifted, half-transparent 8-bit frame."""
    cels = v.px().select("image_id").distinct().select("image_id", F.inline(F.array(
        F.struct(F.lit(0).alias("layer"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(True).alias("visible")),
        F.struct(F.lit(1).alias("layer"), F.lit(3).alias("x"), F.lit(-2).alias("y"), F.lit(True).alias("visible")),
        F.struct(F.lit(2).alias("layer"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(False).alias("visible")))))
    top = v.px8().withColumn("a", F.expr("CAST(FLOOR(a / 2) AS INT)")).withColumn("layer", F.lit(1))
    hidden = v.px8().withColumn("layer", F.lit(2))
    return cels, v.px().withColumn("layer", F.lit(0)).unionByName(top).unionByName(hidden)


def _ch(c):
    return f"""CAST(CASE WHEN t.x IS NULL THEN b.{c} WHEN b.x IS NULL THEN t.{c} WHEN t.a = 0 THEN CASE WHEN b.a = 0 THEN t.{c} ELSE b.{c} END
      WHEN t.a = 255 OR b.a = 0 THEN t.{c} ELSE (t.{c}*t.a*255 + b.{c}*b.a*(255-t.a) + (255*t.a + b.a*(255-t.a))//2)//(255*t.a + b.a*(255-t.a)) END AS INT) AS {c}"""


add("composite_cels", lambda v: an.composite_cels(*two_layers(v), 64, 64), f"""
    WITH t AS (SELECT image_id, x + 3 AS x, y - 2 AS y, r, g, b, a//2 AS a FROM px8 WHERE x + 3 < 64 AND y >= 2)
    SELECT coalesce(b.image_id, t.image_id) AS image_id, coalesce(b.x, t.x) AS x, coalesce(b.y, t.y) AS y, {_ch('r')}, {_ch('g')}, {_ch('b')},
      CAST(CASE WHEN t.x IS NULL THEN b.a WHEN b.x IS NULL THEN t.a WHEN t.a = 0 THEN b.a ELSE (255*t.a + b.a*(255-t.a) + 127)//255 END AS INT) AS a
    FROM px b FULL JOIN t ON t.image_id = b.image_id AND t.x = b.x AND t.y = b.y""")
add("layers_in_band", lambda v: an.layers_in_band(v.board(), 450.0, 520.0), """
    WITH e AS (SELECT layer_index, abs(cos(radians(angle)))*width*scale/2 + abs(sin(radians(angle)))*height*scale/2 AS ex, abs(sin(radians(angle)))*width*scale/2 + abs(cos(radians(angle)))*height*scale/2 AS ey,
      x + width*scale/2 AS cx, y + height*scale/2 AS cy FROM board)
    SELECT CAST(b AS INT) AS band, layer_index FROM e, (SELECT unnest(range(5)) AS b) WHERE cx + ex > 0 AND cx - ex < 450 AND cy + ey > b*128 AND cy - ey < least((b+1)*128, 520)""")
COLS = "layer_index, name, width, height, x, y, angle, scale"
add("remove_layer", lambda v: an.remove_layer(v.board(), 9), """
    SELECT ROW_NUMBER() OVER (ORDER BY layer_index) AS layer_index, name, width, height, x, y, angle, scale FROM board WHERE layer_index <> 9""")
add("reorder_layer", lambda v: an.reorder_layer(v.board(), 5, 30), """
    SELECT ROW_NUMBER() OVER (ORDER BY CASE WHEN layer_index = 5 THEN 30.5 ELSE layer_index END) AS layer_index, name, width, height, x, y, angle, scale FROM board""")
add("transform_layer", lambda v: an.transform_layer(v.board(), 12, x=-4.5, angle=90), f"""
    SELECT layer_index, name, width, height, CASE WHEN layer_index = 12 THEN -4.5 ELSE x END AS x, y, CASE WHEN layer_index = 12 THEN 90 ELSE angle END AS angle, scale FROM board""")

QUERIES, SQL = area.queries, area.sql
