"""Job mailboxes as streams.

Batch and stream share the same expressions; watermarks only bound state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from atlasmill.runtime import attach_unique, bucketed_running_sum, require, work_folder

REQUEST_SCHEMA = ("job_id BIGINT, asset_id BIGINT, ts TIMESTAMP, operation STRING, revision BIGINT, path STRING, "
                  "destination STRING, sha256 STRING")
RESPONSE_SCHEMA = "job_id BIGINT, status STRING, answered_at TIMESTAMP"
# Answers a job can get.
STATUSES = ("saved", "read", "moved", "deleted", "conflict", "occupied", "missing", "error")
GUARDED = ("move", "delete", "save")


def read_mailbox_stream(spark: SparkSession, path: str, schema: str = REQUEST_SCHEMA, files_per_trigger: int = 1000) -> DataFrame:
    """Poll a folder of JSON request or response files."""
    require(files_per_trigger >= 1, "files per trigger must be positive")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option(
        "recursiveFileLookup", True).json(path)


def known_status() -> Column:
    """The status of an answer; what no job can get is an error."""
    return F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("error")


def mailbox_status(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with their answer, or ``pending``; ``requests`` may be a stream."""
    answers = responses.select("job_id", known_status().alias("status"))
    return requests.join(answers, "job_id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def settled_status(requests: DataFrame, responses: DataFrame, wait: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Both sides as streams: each request once, with its answer or as ``pending`` when none can come any more.

    An answer counts if it comes within ``wait`` of its request (``answered_at`` against ``ts``); of several
    the first received counts. A request with an answer comes out with it, one without as soon as both
    watermarks, ``delay`` behind their newest rows, have passed the end of its wait. That bounds the state:
    requests and answers older than ``wait`` and ``delay`` are dropped from it.
    """
    asked = requests.withWatermark("ts", delay)
    answers = responses.select(F.col("job_id").alias("answered_job"), "answered_at", known_status().alias("status"))
    answers = answers.withWatermark("answered_at", delay).dropDuplicatesWithinWatermark(["answered_job"])
    in_time = (F.col("job_id") == F.col("answered_job")) & (F.col("answered_at") >= F.col("ts")) & (
        F.col("answered_at") <= F.col("ts") + F.expr(f"INTERVAL {wait}"))
    return asked.join(answers, in_time, "left").select(*requests.columns, F.coalesce("status", F.lit("pending")).alias("status"))


def drain_mailbox(requests: DataFrame, responses: DataFrame, folder: str, wait: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Take in what both streams have and return every request seen so far with its present status.

    Requests land in one table, settled ones in another; those that are only in the first are ``pending``.
    Calling it again with the same folder goes on from there: an answer in a later batch turns ``pending``
    into its status, and a repeated batch replaces its own files.
    """
    spark = requests.sparkSession
    run_to_table(requests, "append", f"{folder}/requests")
    run_to_table(settled_status(requests, responses, wait, delay), "append", f"{folder}/settled")
    landed = stored_rows(spark, f"{folder}/requests", requests.columns)
    settled = stored_rows(spark, f"{folder}/settled", [*requests.columns, "status"])
    open_ = landed.join(settled.select("job_id"), "job_id", "left_anti").withColumn("status", F.lit("pending"))
    return settled.unionByName(open_)


def dedupe_transfers(transfers: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """Drop transfers already received within the watermark delay."""
    if transfers.isStreaming:
        return transfers.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
    return transfers.dropDuplicates(keys)


def latest_revision(jobs: DataFrame) -> DataFrame:
    """Current revision and path of every asset, and whether it was deleted.

    Pure aggregation: combined before the shuffle, and usable in update mode.
    """
    at = F.struct("ts", "job_id")
    change = F.col("operation") != "read"
    return jobs.groupBy("asset_id").agg(
        F.max_by("revision", F.when(change, at)).alias("revision"),
        F.max_by("destination", F.when(F.col("operation") == "move", at)).alias("path"),
        F.coalesce(F.max_by(F.col("operation") == "delete", F.when(change, at)), F.lit(False)).alias("missing"))


def revision_conflicts(jobs: DataFrame) -> DataFrame:
    """Guarded jobs whose revision is not the one the asset had before them.

    The previous change is found through day buckets, so a busy asset is spread
    over its days.
    """
    seen = jobs.withColumn("_change", F.when(F.col("operation") != "read", F.struct("ts", "job_id", "revision")))
    before = bucketed_running_sum(seen, ["asset_id"], F.to_date("ts"), ["ts", "job_id"], "_change", "_before", "max")
    return before.filter(F.col("operation").isin(*GUARDED) & (F.col("_before.revision") != F.col("revision"))).select(
        "job_id", "asset_id", "operation", "revision", F.col("_before.revision").alias("current_revision"))


CONFLICT_SCHEMA = "job_id BIGINT, asset_id BIGINT, operation STRING, revision BIGINT, current_revision BIGINT"
_WAITING = ["asset_id", "job_id", "us", "operation", "revision"]
#: Groups of assets that share a state; state calls are paid per group and batch, not per asset.
GROUPS = 512


def _whole(values) -> pd.Series:
    return pd.Series([None if pd.isna(v) else int(v) for v in values], dtype="Int64")


class RevisionCheck(StatefulProcessor):
    """Jobs of a group of assets wait until the watermark has passed them and are then judged in the order of time.

    State is the list of waiting jobs, which the watermark bounds, the revision of each asset's last change, and
    the watermark of the last judgement, as several timers may end with one batch.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "asset_id BIGINT, job_id BIGINT, us BIGINT, operation STRING, revision BIGINT")
        self.current = handle.getListState("current", "asset_id BIGINT, revision BIGINT")
        self.judged = handle.getValueState("judged", "us BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for frame in rows:
            columns = [[None if pd.isna(v) else v for v in frame[c].tolist()] for c in _WAITING]
            self.waiting.appendList([(asset, job, us, op, None if rev is None else int(rev)) for asset, job, us, op, rev in zip(*columns)])
            newest = max(filter(None, (newest, int(frame["us"].max()))))
        if newest is not None:
            self.handle.registerTimer(-(-newest // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        if self.judged.exists() and self.judged.get()[0] >= passed:
            return
        self.judged.update((passed,))
        if not self.waiting.exists():
            return
        waiting = list(self.waiting.get())
        ripe = [r for r in waiting if r[2] <= passed]
        if len(ripe) == len(waiting):
            self.waiting.clear()
        elif ripe:
            self.waiting.put([tuple(r) for r in waiting if r[2] > passed])
        if not ripe:
            return
        rows = pd.DataFrame({c: pd.Series(v, dtype=object) if c == "operation" else _whole(v) for c, v in zip(_WAITING, zip(*ripe))})
        rows = rows.sort_values(["asset_id", "us", "job_id"], ignore_index=True)
        asset, change = rows["asset_id"], rows["operation"] != "read"
        last = pd.Series(rows.index, dtype="Int64").where(change).groupby(asset).ffill()  # the newest change up to each row
        before = last.groupby(asset).shift()
        held = {a: rev for a, rev in self.current.get()} if self.current.exists() else {}
        current = rows["revision"].reindex(before.fillna(-1)).reset_index(drop=True)
        current = current.where(before.notna(), _whole(held.get(a) for a in asset))
        if change.any():
            newest = rows[change].drop_duplicates("asset_id", keep="last")
            held.update((int(a), None if pd.isna(rev) else int(rev)) for a, rev in zip(newest["asset_id"], newest["revision"]))
            self.current.put(list(held.items()))
        clash = (rows["operation"].isin(GUARDED) & (current != rows["revision"])).fillna(False)
        found = rows[clash.astype(bool)]
        yield pd.DataFrame({"job_id": found["job_id"], "asset_id": found["asset_id"], "operation": found["operation"],
                            "revision": found["revision"], "current_revision": current[found.index]})

    def close(self) -> None:
        pass


def revision_conflict_stream(jobs: DataFrame, delay: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """``revision_conflicts`` on a stream, in event-time order however jobs are spread over batches.

    A job is judged once the watermark, ``delay`` behind the newest job, has passed it. Jobs that come later
    than that are dropped. Rows without an asset or a time are left out. Assets are dealt into ``groups``
    by hash, whose number must stay the same over restarts.
    """
    require(groups >= 1, "there must be a group")
    spark = jobs.sparkSession
    # timers and list state need this store
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = jobs.filter("asset_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay).select(
        F.pmod(F.xxhash64("asset_id"), F.lit(groups)).cast("int").alias("asset_group"), "asset_id", "ts", "job_id", F.unix_micros("ts").alias("us"), "operation", "revision")
    return timed.groupBy("asset_group").transformWithStateInPandas(RevisionCheck(), CONFLICT_SCHEMA, "append", "eventTime")


def online_sessions(beats: DataFrame, key: str, gap: str = "9 seconds", delay: str = "1 minute") -> DataFrame:
    """Sessions of heartbeats closer than ``gap``."""
    source = beats.withWatermark("ts", delay) if beats.isStreaming else beats
    return source.groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.count(F.lit(1)).alias("beats")).select(
        key, F.col("s.start").alias("started_at"), F.col("s.end").alias("online_until"), "beats")


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("operation", "status").agg(F.count(F.lit(1)).alias("n"))


# --- running a stream into a table -----------------------------------------------------------

def run_to_table(stream: DataFrame, mode: str, folder: str) -> StreamingQuery:
    """Drain what is available, one Parquet folder per micro-batch.

    A repeated batch overwrites its own folder, so replays do not duplicate rows.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
    query = (stream.writeStream.outputMode(mode).foreachBatch(store)
             .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def stored_rows(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """The rows that ``run_to_table`` has written so far."""
    return spark.read.parquet(f"{folder}/out").select(*columns)


def newest_rows(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Latest version of every key after an update-mode run."""
    rows = spark.read.parquet(f"{folder}/out").drop("batch")
    last = rows.groupBy(*keys).agg(F.max("batch_id").alias("batch_id"))
    return attach_unique(rows, last.withColumnRenamed("batch_id", "newest"), keys, ["batch_id"], "inner").filter(
        "batch_id = newest").drop("batch_id", "newest")


def stream_latest_revision(jobs: DataFrame) -> DataFrame:
    """Drain a job stream and return the current revision of every asset."""
    folder = work_folder(jobs.sparkSession, "latest-revision")
    run_to_table(latest_revision(jobs), "update", folder)
    return newest_rows(jobs.sparkSession, folder, ["asset_id"])


def stream_rows(stream: DataFrame) -> DataFrame:
    """Drain an append-mode stream and return its rows."""
    folder = work_folder(stream.sparkSession, "stream")
    run_to_table(stream, "append", folder)
    return stream.sparkSession.read.parquet(f"{folder}/out").drop("batch", "batch_id")
