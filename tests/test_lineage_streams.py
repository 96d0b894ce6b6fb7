"""Hierarchies with awkward shapes, and mailbox streams from folders."""

import json
import os

import pytest
from pyspark.sql import functions as F

from atlasmill.operators import lineage
from atlasmill.streaming import frames, mailbox


def table(spark, rows):
    return spark.createDataFrame(rows, "gen_id BIGINT, parent_id BIGINT")


def test_long_chain_needs_few_rounds(spark):
    n = 3000
    chain = spark.range(n).selectExpr("id AS gen_id", "CASE WHEN id > 0 THEN id - 1 END AS parent_id")
    out = lineage.ancestry(chain, "gen_id", "parent_id", keep_path=False)
    row = out.agg(F.max("depth").alias("d"), F.countDistinct("top").alias("tops"), F.count_if(F.col("status") == "ok").alias("ok")).head()
    assert (row.d, row.tops, row.ok) == (n - 1, 1, n)


def test_wide_star_and_cycles(spark):
    rows = [(0, None)] + [(i, 0) for i in range(1, 500)] + [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1000), (2000, 2000), (3000, 9999)]
    out = {r.node: r for r in lineage.ancestry(table(spark, rows), "gen_id", "parent_id").collect()}
    assert out[7].top == 0 and out[7].depth == 1 and out[0].depth == 0
    assert {k for k, r in out.items() if r.status == "cycle"} == {1000, 1001, 1002, 1003, 2000}
    assert out[3000].status == "missing_parent"
    cut = {r.node for r in lineage.break_cycles(table(spark, rows), "gen_id", "parent_id").collect()}
    assert cut == {1000, 2000}
    shown = {r.gen_id: r for r in lineage.branch_forest(table(spark, rows)).collect()}
    assert shown[1003].root_id == 1000 and shown[1001].depth == 2 and shown[3000].display_parent is None


def test_full_recipe_stops_at_snapshot(spark):
    rows = [(1, None, ["a"], None), (2, 1, ["b"], None), (3, 2, ["c"], ["saved"]), (4, 3, ["d"], None), (5, None, None, None), (6, 5, ["f"], None)]
    gens = spark.createDataFrame(rows, "gen_id BIGINT, parent_id BIGINT, steps ARRAY<STRING>, snapshot ARRAY<STRING>")
    full = lineage.full_recipes(gens)
    got = {r.gen_id: (r.steps, r.status) for r in full.collect()}
    assert got[2] == (["a", "b"], "ok") and got[4] == (["saved", "d"], "ok")
    assert got[5] == (None, "missing_recipe") and got[6] == (None, "missing_recipe")
    local = {r.gen_id: r.local_steps for r in lineage.local_recipes(gens, full).collect()}
    assert local[2] == ["b"] and local[4] == ["d"] and local[1] == ["a"]


def test_redirect_loop_is_dropped(spark):
    red = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("d", "gone")], "path STRING, target STRING")
    live = spark.createDataFrame([("c",)], "path STRING")
    assert {(r.path, r.target) for r in lineage.resolve_redirects(red, live).collect()} == {("a", "c"), ("b", "c")}


def write_jobs(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def job(i, asset, op, revision, minute):
    return {"job_id": i, "asset_id": asset, "operation": op, "revision": revision, "ts": f"2024-01-01T00:{minute:02d}:00Z",
            "destination": f"/Game/M{i}" if op == "move" else None}


def test_mailbox_folder(spark, tmp_path):
    inbox = tmp_path / "inbox"
    write_jobs(inbox, "1.json", [job(1, 7, "save", 3, 1), job(2, 7, "move", 3, 2), job(3, 8, "read", 1, 2)])
    write_jobs(inbox, "2.json", [job(4, 7, "delete", 9, 5), job(5, 8, "create", 2, 6)])

    def stream():
        return mailbox.read_mailbox_stream(spark, str(inbox), files_per_trigger=1)
    latest = {r.asset_id: (r.revision, r.path, r.missing) for r in mailbox.stream_latest_revision(stream()).collect()}
    assert latest == {7: (9, "/Game/M2", True), 8: (2, None, False)}
    write_jobs(inbox, "3.json", [job(6, -1, "read", 0, 59)])  # time moves on, so that all waits end
    clashes = {r.job_id for r in mailbox.stream_rows(mailbox.revision_conflict_stream(stream(), "10 minutes")).collect()}
    assert clashes == {4} == {r.job_id for r in mailbox.revision_conflicts(spark.read.schema(mailbox.REQUEST_SCHEMA).json(str(inbox))).collect()}
    answers = spark.createDataFrame([(1, "saved"), (2, "strange")], "job_id BIGINT, status STRING")
    status = {r.job_id: r.status for r in mailbox.stream_rows(mailbox.mailbox_status(stream(), answers)).collect()}
    assert status == {1: "saved", 2: "error", 3: "pending", 4: "pending", 5: "pending", 6: "pending"}


def test_duplicate_transfers_across_batches(spark, tmp_path):
    inbox = tmp_path / "inbox"
    for n in range(3):
        write_jobs(inbox, f"{n}.json", [job(1, 7, "save", 3, 1), job(10 + n, 8, "save", n, 2)])
    stream = mailbox.dedupe_transfers(mailbox.read_mailbox_stream(spark, str(inbox), files_per_trigger=1), ["asset_id", "operation", "revision"])
    assert mailbox.stream_rows(stream).count() == 4


def test_sessions_split_at_the_gap(spark):
    beats = spark.createDataFrame([("a", 0), ("a", 5), ("a", 13), ("a", 40), ("b", 2)], "who STRING, s INT").select(
        "who", F.timestamp_seconds("s").alias("ts"))
    got = sorted((r.who, r.beats) for r in mailbox.online_sessions(beats, "who").collect())
    assert got == [("a", 1), ("a", 3), ("b", 1)]


def test_frames_must_share_one_size(spark, tmp_path):
    def frame(i, w, h):
        return [(i, x, y, 10 * x, 10 * y, 0, 255) for x in range(w) for y in range(h)]
    good, bad = tmp_path / "good", tmp_path / "bad"
    spark.createDataFrame(frame(1, 4, 3) + frame(2, 4, 3), frames.PIXEL_SCHEMA).write.parquet(str(good))
    spark.createDataFrame(frame(1, 4, 3) + frame(2, 3, 3), frames.PIXEL_SCHEMA).write.parquet(str(bad))
    steps = [{"operationId": "filter.monochrome"}]
    assert frames.frame_stream_apply(frames.read_frame_stream(spark, str(good)), steps).count() == 24
    with pytest.raises(Exception, match="differ in size"):
        frames.frame_stream_apply(frames.read_frame_stream(spark, str(bad)), steps)


def at(minute):
    return f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"


def test_answers_that_come_batches_later(spark, tmp_path):
    jobs, replies, folder = tmp_path / "jobs", tmp_path / "replies", str(tmp_path / "table")

    def status():
        requests = mailbox.read_mailbox_stream(spark, str(jobs), files_per_trigger=1)
        responses = mailbox.read_mailbox_stream(spark, str(replies), mailbox.RESPONSE_SCHEMA, files_per_trigger=1)
        return {r.job_id: r.status for r in mailbox.drain_mailbox(requests, responses, folder, "30 minutes", "10 minutes").collect()}

    def ask(name, *rows):
        write_jobs(jobs, name, [{**job(i, 7, "save", 1, 0), "ts": at(minute)} for i, minute in rows])

    def answer(name, *rows):
        write_jobs(replies, name, [{"job_id": i, "status": s, "answered_at": at(minute)} for i, s, minute in rows])

    ask("1.json", (1, 1), (2, 2), (3, 3))
    answer("1.json", (1, "saved", 4))
    assert status() == {1: "saved", 2: "pending", 3: "pending"}
    answer("2.json", (2, "strange", 9), (2, "saved", 10))  # a later batch; of two answers the first counts
    assert status() == {1: "saved", 2: "error", 3: "pending"}
    settled = lambda: {r.job_id for r in mailbox.stored_rows(spark, f"{folder}/settled", ["job_id"]).collect()}
    assert settled() == {1, 2}
    ask("2.json", (4, 90), (5, 91))
    answer("3.json", (4, "read", 95), (3, "saved", 96), (99, "read", 97))  # too late for 3, unknown 99
    ask("3.json", (6, 92))
    assert status() == {1: "saved", 2: "error", 3: "pending", 4: "read", 5: "pending", 6: "pending"}
    assert settled() == {1, 2, 3, 4}  # the watermark has passed the wait of 3
    answer("4.json", (5, "conflict", 100))
    assert status()[5] == "conflict"


def test_revisions_in_the_order_of_time_across_batches(spark, tmp_path):
    import random
    rng = random.Random(4)
    rows = [{**job(i, rng.choice([7, 7, 7, 8, 9]), rng.choice(["save", "read", "move", "delete", "create"]), rng.choice([1, 2, None]), 0), "ts": at(i)}
            for i in range(1, 200)]
    inbox = tmp_path / "inbox"
    late = sorted(rows, key=lambda r: r["job_id"] + rng.randint(0, 25))  # out of order by up to 25 minutes
    for k in range(0, len(late), 40):
        write_jobs(inbox, f"{k:03d}.json", late[k:k + 40])
    write_jobs(inbox, "999.json", [{**job(1000, -1, "read", 0, 0), "ts": at(600)}])
    stream = mailbox.read_mailbox_stream(spark, str(inbox), files_per_trigger=1)
    got = sorted(tuple(r) for r in mailbox.stream_rows(mailbox.revision_conflict_stream(stream, "30 minutes")).collect())
    batch = mailbox.revision_conflicts(spark.read.schema(mailbox.REQUEST_SCHEMA).json(str(inbox)))
    assert got == sorted(tuple(r) for r in batch.collect()) and len(got) > 20


@pytest.mark.parametrize("groups", [1, 3])
def test_assets_of_one_group_are_judged_apart(spark, tmp_path, groups):
    rows = [job(i, i % 5, ["save", "read", "move", "create"][i % 4], (i // 15) % 3 if i % 7 else None, i) for i in range(1, 60)]
    inbox = tmp_path / "inbox"
    for k in range(0, 59, 10):
        write_jobs(inbox, f"{k:02d}.json", rows[k:k + 10])
    write_jobs(inbox, "99.json", [{**job(1000, -1, "read", 0, 0), "ts": at(600)}])
    for k, path in enumerate(sorted(inbox.glob("*.json"))):
        os.utime(path, (10**9 + k,) * 2)  # files of one millisecond come in any order, and then jobs come too late
    stream = mailbox.read_mailbox_stream(spark, str(inbox), files_per_trigger=1)
    got = sorted(tuple(r) for r in mailbox.stream_rows(mailbox.revision_conflict_stream(stream, "5 minutes", groups)).collect())
    batch = mailbox.revision_conflicts(spark.read.schema(mailbox.REQUEST_SCHEMA).json(str(inbox)))
    assert got == sorted(tuple(r) for r in batch.collect()) and len(got) == 10


def test_frame_size_and_cut_frames_survive_a_restart(spark, tmp_path):
    def rows(i, w, h):
        return [(i, x, y, 10 * x, 10 * y, 0, 255, w * h) for x in range(w) for y in range(h)]

    def add(part):
        spark.createDataFrame(part, frames.CUT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = frames.read_frame_stream(spark, str(tmp_path / "in"), 1, cut=True)
        out = frames.frame_stream_apply(stream, [{"operationId": "filter.monochrome"}], str(tmp_path / "table"))
        return sorted((r.image_id, r["count"]) for r in out.groupBy("image_id").count().collect())

    first, second = rows(1, 4, 3), rows(2, 4, 3)
    add(first + second[:5])
    assert run() == [(1, 12)]
    add(second[5:9])
    assert run() == [(1, 12)]
    add(second[9:])
    assert run() == [(1, 12), (2, 12)]
    add(rows(3, 3, 3))
    with pytest.raises(Exception, match="differ in size"):
        run()
