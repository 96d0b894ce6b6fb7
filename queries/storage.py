"""Fingerprints, records, reports and outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasmill.operators import pixels as p
from atlasmill.runtime import work_folder
from atlasmill.sources import files as f
from queries.base import Area
from queries.pixels import RGB

area = Area()
add = area.add
add("fingerprint", lambda v: f.fingerprint(v.table("documents"), "text").select("doc_id", "n_chars", "sha256"),
    "SELECT doc_id, n_chars, sha256(text) AS sha256 FROM documents")
_TEXT = """CASE event_id % 5 WHEN 0 THEN concat('{"version": 1, "id": ', event_id, ', "name": "', event_type, '"}')
  WHEN 1 THEN concat('{"version": 3, "id": ', event_id, ', "name": "x"}') WHEN 2 THEN concat('{"version": 1, "id": ', event_id, '}')
  WHEN 3 THEN '{"version": 1, "name": "no id"}' ELSE props END"""
_SCHEMA = "version INT, id BIGINT, name STRING"


def records(v):
    texts = v.table("events").selectExpr("CAST(event_id AS STRING) AS path", f"{_TEXT} AS value")
    return f.split_records(texts, _SCHEMA, ["id", "name"])


add("scan_records_good", lambda v: records(v)[0],
    "SELECT CAST(event_id AS VARCHAR) AS path, 1 AS version, event_id AS id, event_type AS name FROM events WHERE event_id % 5 = 0")
add("scan_records_rejected", lambda v: records(v)[1], """
    SELECT CAST(event_id AS VARCHAR) AS path, CASE event_id % 5 WHEN 2 THEN 'missing name' WHEN 3 THEN 'missing id' ELSE 'unsupported version' END AS reason FROM events WHERE event_id % 5 <> 0""")
add("report_json", lambda v: f.report_json(p.top_colors(v.px(), 1), "image_id"), f"""
    WITH h AS (SELECT image_id, {RGB} AS rgb, count(*) AS n FROM px WHERE a > 0 GROUP BY 1, 2), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY n DESC, rgb) AS rank FROM h)
    SELECT image_id, concat('{{"image_id":', image_id, ',"rgb":', rgb, ',"n":', n, ',"rank":1}}') AS report FROM k WHERE rank = 1""")


def written(v):
    folder = work_folder(v.spark, "pixels")
    f.write_pixels(v.px(), folder, buckets=8)
    return v.spark.read.parquet(folder).drop("image_bucket").select(*p.PIXEL)


add("write_pixels", written, "SELECT * FROM px")
add("write_report", lambda v: _report(v), """
    SELECT image_id, count(*) AS pixel_count, bool_or(a < 255) AS has_transparency FROM px GROUP BY image_id""")


def _report(v):
    folder = work_folder(v.spark, "report")
    f.write_report(v.px().groupBy("image_id").agg(F.count(F.lit(1)).alias("pixel_count"), F.bool_or(F.col("a") < 255).alias("has_transparency")), folder)
    return v.spark.read.schema("image_id BIGINT, pixel_count BIGINT, has_transparency BOOLEAN").json(folder)


QUERIES, SQL = area.queries, area.sql
