"""Mailbox streams and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasmill.runtime import work_folder
from atlasmill.streaming import frames as fr
from atlasmill.streaming import mailbox as mb
from queries import sqlmath as m
from queries.base import Area
from queries.recipes import COLOR

area = Area()
add = area.add


def jobs(v):
    return v.jobs().withColumn("destination", F.expr("CASE WHEN operation = 'move' THEN concat('/Game/M', job_id) END"))


SLICES = 5
_JOB = ["event_id AS job_id", "user_id AS asset_id", "CAST(ts AS TIMESTAMP) AS ts",
        "CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'save' WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'move' ELSE 'delete' END AS operation",
        "CAST(FLOOR(value) AS BIGINT) AS revision", "CASE WHEN event_type = 'purchase' THEN concat('/Game/M', event_id) END AS destination"]
#: Longer than any row of the split streams is late: rows of a slice come one slice later at most.
DELAY = "20 days"


def split_stream(v, rows, at, closing=None):
    """A table as a stream of several batches: slices of time one after the other, every seventh row one slice late.

    ``closing`` is a last batch after all others.
    """
    folder = work_folder(v.spark, "slices")
    low, high = rows.agg(F.min(F.unix_micros(at)), F.max(F.unix_micros(at))).first()
    late = F.when(F.xxhash64("job_id") % 7 == 0, 1).otherwise(0)
    sliced = rows.withColumn("slot", F.floor((F.unix_micros(at) - F.lit(low)) * SLICES / F.lit(high - low + 1)) + late)
    for k in range(SLICES + 1):
        sliced.filter(F.col("slot") == k).drop("slot").coalesce(2).write.parquet(f"{folder}/slot={k}")
    if closing is not None:
        closing.write.parquet(f"{folder}/slot={SLICES + 1}")
    return v.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", True).parquet(folder)


def event_jobs(v):
    return v.table("events").selectExpr(*_JOB)


def job_stream(v):
    """The events in several batches, shaped like the mailbox."""
    return split_stream(v, event_jobs(v), "ts")


def closed_job_stream(v):
    """The same with a last job long after all others, of an asset of its own, so that every wait ends."""
    rows = event_jobs(v)
    last = rows.agg((F.max("ts") + F.expr("INTERVAL 100 days")).alias("ts")).selectExpr(
        "CAST(-1 AS BIGINT) AS job_id", "CAST(-1 AS BIGINT) AS asset_id", "ts", "'read' AS operation", "CAST(0 AS BIGINT) AS revision",
        "CAST(NULL AS STRING) AS destination")
    return split_stream(v, rows, "ts", last)


_STATUS = """CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'odd' WHEN event_id % 5 = 0 THEN 'conflict'
  ELSE CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'saved' WHEN 'signup' THEN 'occupied' WHEN 'purchase' THEN 'moved' ELSE 'deleted' END END"""


def responses(v):
    return v.table("events").selectExpr("event_id AS job_id", f"{_STATUS} AS status").filter("status IS NOT NULL")


STATUS_SQL = f"""WITH r AS (SELECT event_id AS job_id, {_STATUS} AS status FROM events),
    s AS (SELECT j.operation, CASE WHEN r.status IS NULL THEN 'pending' WHEN r.status = 'odd' THEN 'error' ELSE r.status END AS status FROM jobs j JOIN r USING (job_id))
    SELECT operation, status, count(*) AS n FROM s GROUP BY 1, 2"""
add("mailbox_status", lambda v: mb.status_counts(mb.mailbox_status(v.jobs(), responses(v))), STATUS_SQL)
add("stream_mailbox_status", lambda v: mb.status_counts(mb.stream_rows(mb.mailbox_status(job_stream(v), responses(v)))), STATUS_SQL)


def answers(v):
    """Answers up to 49 hours after the job; those of some jobs never come."""
    return v.table("events").selectExpr("event_id AS job_id", "CAST(ts AS TIMESTAMP) + make_interval(0, 0, 0, 0, CAST(event_id % 50 AS INT)) AS answered_at",
                                        f"{_STATUS} AS status").filter("status IS NOT NULL")


def answered_mailbox(v):
    requests, replies = split_stream(v, event_jobs(v), "ts"), split_stream(v, answers(v), "answered_at")
    return mb.status_counts(mb.drain_mailbox(requests, replies, work_folder(v.spark, "mailbox"), "40 hours", DELAY))


add("stream_mailbox_answers", answered_mailbox, f"""WITH r AS (SELECT event_id AS job_id, {_STATUS} AS status FROM events WHERE event_id % 50 <= 40),
    s AS (SELECT j.operation, CASE WHEN r.status IS NULL THEN 'pending' WHEN r.status = 'odd' THEN 'error' ELSE r.status END AS status FROM jobs j LEFT JOIN r USING (job_id))
    SELECT operation, status, count(*) AS n FROM s GROUP BY 1, 2""")
LATEST = """WITH j AS (SELECT *, CASE WHEN operation = 'move' THEN concat('/Game/M', job_id) END AS destination FROM jobs)
    SELECT asset_id, arg_max(revision, (ts, job_id)) FILTER (operation <> 'read') AS revision, arg_max(destination, (ts, job_id)) FILTER (operation = 'move') AS path,
      coalesce(arg_max(operation = 'delete', (ts, job_id)) FILTER (operation <> 'read'), false) AS missing FROM j GROUP BY asset_id"""
add("latest_revision", lambda v: mb.latest_revision(jobs(v)), LATEST)
add("stream_latest_revision", lambda v: mb.stream_latest_revision(job_stream(v)), LATEST)
CONFLICTS = """WITH c AS (SELECT *, last_value(CASE WHEN operation <> 'read' THEN revision END IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY ts, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS current_revision FROM jobs)
    SELECT job_id, asset_id, operation, revision, current_revision FROM c WHERE operation IN ('move', 'delete', 'save') AND current_revision <> revision"""
add("revision_conflicts", lambda v: mb.revision_conflicts(v.jobs()), CONFLICTS)
add("stream_revision_conflicts", lambda v: mb.stream_rows(mb.revision_conflict_stream(closed_job_stream(v), DELAY)), CONFLICTS)
add("online_sessions", lambda v: mb.online_sessions(v.jobs().withColumn("ts", F.col("ts").cast("timestamp")), "asset_id", "6 hours"), """
    WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM jobs WINDOW w AS (PARTITION BY asset_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY asset_id ORDER BY ts) AS k FROM g)
    SELECT asset_id, min(ts) AS started_at, max(ts) + INTERVAL 6 HOUR AS online_until, count(*) AS beats FROM s GROUP BY asset_id, k""")
DEDUPE = "SELECT DISTINCT asset_id, operation, revision FROM jobs"
add("dedupe_transfers", lambda v: mb.dedupe_transfers(v.jobs(), ["asset_id", "operation", "revision"]).select("asset_id", "operation", "revision"), DEDUPE)
add("stream_dedupe_transfers", lambda v: mb.stream_rows(mb.dedupe_transfers(job_stream(v), ["asset_id", "operation", "revision"], "400 days"))
    .select("asset_id", "operation", "revision"), DEDUPE)


def frame_stream(v):
    folder = work_folder(v.spark, "frame-input")
    tiles = v.tiles().selectExpr("tile_id AS image_id", "tx AS x", "ty AS y", "r", "g", "b", "a")
    tiles.repartition(8, "image_id").write.parquet(folder)
    return fr.frame_stream_apply(fr.read_frame_stream(v.spark, folder), COLOR[:1] + COLOR[2:])


def cut_frame_stream(v):
    """Frames cut over files by image row, two files a batch."""
    folder = work_folder(v.spark, "frame-input")
    tiles = v.tiles().selectExpr("tile_id AS image_id", "tx AS x", "ty AS y", "r", "g", "b", "a")
    total = tiles.groupBy("image_id").agg(F.count(F.lit(1)).alias("total"))
    tiles.join(total, "image_id").repartition(4, "y").write.parquet(folder)
    return fr.frame_stream_apply(fr.read_frame_stream(v.spark, folder, 2, cut=True), COLOR[:1] + COLOR[2:])


_G = "CAST(CASE WHEN a > 0 THEN round_even({l}, 0) ELSE {c} END AS INT) AS {c}"


FRAMES = f"""
    WITH br AS (SELECT tile_id AS image_id, tx AS x, ty AS y, CAST(least(255, r + 20) AS INT) AS r, g, b, a FROM tiles)
    SELECT image_id, x, y, {', '.join(_G.format(l=m.lum(), c=ch) for ch in 'rgb')}, a FROM br"""
add("frame_stream_apply", frame_stream, FRAMES)
add("frame_stream_cut", cut_frame_stream, FRAMES)

QUERIES, SQL = area.queries, area.sql
