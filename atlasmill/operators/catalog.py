"""Asset catalog: search, links, reconciliation and bookkeeping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atlasmill.functions import text
from atlasmill.operators.lineage import descendants, folder_paths, resolve_redirects
from atlasmill.runtime import attach_unique, require


def asset_search(assets: DataFrame, words: Sequence[str] = (), kind: int | None = None, width: int | None = None,
                 height: int | None = None, transparent: bool | None = None) -> DataFrame:
    """Every word must occur in the name or a tag; case does not matter, ``#`` is ignored."""
    out = assets
    for word in words:
        bare = F.lit(word.lstrip("#").lower())
        named = F.contains(F.lower("name"), F.lit(word.lower()))
        lowered = F.transform("tags", F.lower)
        out = out.filter(named | F.contains(F.array_join(lowered, "\n"), bare))
    for column, value in (("kind", kind), ("width", width), ("height", height), ("transparent", transparent)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out


def asset_locations(links: DataFrame, folders: DataFrame, projects: DataFrame) -> DataFrame:
    """Readable place of every link; links without a folder sit in the project itself."""
    paths = folder_paths(folders, projects).select("folder_id", "path")
    placed = attach_unique(links, paths, ["folder_id"], ["asset_id"])
    named = placed.join(projects.select("project_id", F.col("name").alias("project")), "project_id")
    return named.select("project_id", "asset_id", F.coalesce("path", "project").alias("location"))


def unassigned_assets(assets: DataFrame, links: DataFrame) -> DataFrame:
    return assets.join(links.select("asset_id").distinct(), "asset_id", "left_anti")


def assets_in_scope(assets: DataFrame, links: DataFrame, folders: DataFrame, project_id: int,
                    folder_id: int | None = None) -> DataFrame:
    """Assets linked to a project, or to a folder and everything below it."""
    here = links.filter(F.col("project_id") == project_id)
    if folder_id is not None:
        seed = folders.select("folder_id").filter(F.col("folder_id") == folder_id)
        inside = descendants(folders, "folder_id", "parent_id", seed).select(F.col("node").alias("folder_id"))
        here = attach_unique(here, inside.withColumn("hit", F.lit(True)), ["folder_id"], ["asset_id"], "inner")
    return assets.join(here.select("asset_id").distinct(), "asset_id", "left_semi")


def recent_assets(assets: DataFrame, n: int) -> DataFrame:
    """Most recently opened; assets never opened are left out."""
    return assets.filter("opened_at IS NOT NULL").orderBy(F.desc("opened_at"), "asset_id").limit(n)


def modified_assets(assets: DataFrame, n: int) -> DataFrame:
    """Most recently modified; assets without a time come last."""
    return assets.orderBy(F.desc_nulls_last("modified_at"), "asset_id").limit(n)


def macros_by_name(macros: DataFrame, name: str) -> DataFrame:
    return macros.orderBy(F.lower(name), name)


def common_tags(assets: DataFrame, keys: list[str]) -> DataFrame:
    """Tags every selected asset of a group has."""
    total = assets.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    tags = assets.select(*keys, "asset_id", F.explode(F.array_distinct("tags")).alias("tag"))
    return (tags.groupBy(*keys, "tag").agg(F.count(F.lit(1)).alias("n")).join(total, keys)
            .filter("n = total").select(*keys, "tag"))


def ancestor_folders(paths: DataFrame) -> DataFrame:
    """Distinct folders above every valid object path, with the shown name and parent."""
    parts = paths.filter(F.expr(text.valid_object_path("path"))).select(F.split("path", "/").alias("p"))
    each = parts.select(F.explode(F.expr("transform(sequence(2, size(p) - 1), i -> array_join(slice(p, 1, i), '/'))")).alias("folder"))
    return each.distinct()


def first_per_path(rows: DataFrame) -> DataFrame:
    """One row per path ignoring case: the one with the smallest id."""
    return rows.groupBy(F.lower("path").alias("path_key")).agg(F.min(F.struct("page_id", "path")).alias("v")).select(
        "path_key", "v.page_id", "v.path")


def reconcile_catalog(local: DataFrame, remote: DataFrame, redirects: DataFrame) -> DataFrame:
    """Match local bindings with a remote listing.

    ``matched`` by path, ``moved`` through a redirect whose target is still
    free (one taker per target), ``needs_destination`` for the rest that were
    synchronised before, ``missing`` otherwise; unclaimed remote entries are ``new``.
    """
    mine = local.select(F.lower("path").alias("key"), F.col("path").alias("local_path"), F.col("revision").alias("local_revision"))
    theirs = remote.groupBy(F.lower("path").alias("key")).agg(F.min(F.struct("path", "revision")).alias("v")).select(
        "key", F.col("v.path").alias("remote_path"), F.col("v.revision").alias("remote_revision"))
    matched = mine.join(theirs, "key").select(F.lit("matched").alias("status"), "local_path", "remote_path", "remote_revision")
    open_mine = mine.join(theirs, "key", "left_anti")
    free = theirs.join(mine, "key", "left_anti")
    chased = resolve_redirects(redirects, remote).select(F.lower("path").alias("key"), F.lower("target").alias("target"))
    wanted = open_mine.join(chased, "key").groupBy("target").agg(F.min("local_path").alias("local_path"))
    moved = wanted.join(free.withColumnRenamed("key", "target"), "target").select(
        F.lit("moved").alias("status"), "local_path", "remote_path", "remote_revision")
    claimed = moved.select("local_path")
    lost = open_mine.join(claimed, "local_path", "left_anti").select(
        F.when(F.col("local_revision").isNotNull(), "needs_destination").otherwise("missing").alias("status"),
        "local_path", F.lit(None).cast("string").alias("remote_path"), F.lit(None).cast("bigint").alias("remote_revision"))
    fresh = free.join(moved.select("remote_path"), "remote_path", "left_anti").select(
        F.lit("new").alias("status"), F.lit(None).cast("string").alias("local_path"), "remote_path", "remote_revision")
    return matched.unionByName(moved).unionByName(lost).unionByName(fresh)


def verify_transfers(files: DataFrame, manifests: DataFrame, received: DataFrame) -> DataFrame:
    """Files whose content matches its manifest and that were not received before."""
    hashed = files.select("name", F.sha2("payload", 256).alias("hash"))
    good = hashed.join(manifests.select("name", F.lower("hash").alias("hash")), ["name", "hash"])
    return good.join(received.select("name", F.lower("hash").alias("hash")), ["name", "hash"], "left_anti")


def import_dedupe(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New files whose path (ignoring case) and content are not in the library yet."""
    def keyed(rows):
        return rows.withColumn("path_key", F.lower("path")).withColumn("hash", F.sha2("content", 256))
    known = keyed(existing).select("path_key", "hash").distinct()
    return keyed(new).join(known, ["path_key", "hash"], "left_anti").drop("path_key", "content")


def sync_upsert(assets: DataFrame, sources: DataFrame) -> DataFrame:
    """Insert missing assets; dimensions come from the selected result, else the source."""
    a = assets.select("asset_id", "name", "width", "height")
    s = sources.select("asset_id", F.col("label").alias("s_name"), F.coalesce("result_width", "source_width").alias("s_width"),
                       F.coalesce("result_height", "source_height").alias("s_height"))
    return a.join(s, "asset_id", "full").select(
        "asset_id", F.coalesce("name", "s_name").alias("name"), F.coalesce("s_width", "width").alias("width"),
        F.coalesce("s_height", "height").alias("height"))


def cascade_delete(assets: DataFrame, projects: DataFrame, folders: DataFrame, links: DataFrame,
                   project_ids: DataFrame | None = None, asset_ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables after deleting projects (with folders and links) or assets (with links)."""
    out = {"assets": assets, "projects": projects, "folders": folders, "links": links}
    if project_ids is not None:
        for name in ("projects", "folders", "links"):
            out[name] = out[name].join(project_ids, "project_id", "left_anti")
    if asset_ids is not None:
        for name in ("assets", "links"):
            out[name] = out[name].join(asset_ids, "asset_id", "left_anti")
    return out


def path_conflicts(candidates: DataFrame, bound: DataFrame, pending: DataFrame) -> DataFrame:
    """Why each candidate ``(asset_id, path)`` cannot be created; NULL means it can."""
    keyed = candidates.withColumn("key", F.lower("path"))

    def others(rows, name):
        held = rows.select(F.lower("path").alias("key"), F.col("asset_id").alias("holder"))
        held = held.groupBy("key").agg(F.min("holder").alias("lo"), F.max("holder").alias("hi"))
        return held.withColumnRenamed("lo", f"{name}_lo").withColumnRenamed("hi", f"{name}_hi")
    out = keyed.join(others(bound, "bound"), "key", "left").join(others(pending, "pending"), "key", "left")

    def other(name):
        return (F.col(f"{name}_lo") != F.col("asset_id")) | (F.col(f"{name}_hi") != F.col("asset_id"))
    reason = (F.when(F.col("path").rlike(r"\s"), "whitespace")
              .when(~F.expr(text.valid_object_path("path")), "invalid_path")
              .when(other("bound"), "bound").when(other("pending"), "pending_create"))
    return out.select("asset_id", "path", reason.alias("reason"))


def job_backlog(jobs: DataFrame) -> DataFrame:
    """Unanswered jobs per project and operation; reads do not count as backlog."""
    return jobs.groupBy("project_id", "operation").agg(
        F.count_if(F.col("response").isNull() & (F.col("operation") != "read")).alias("pending"))


def next_reads(jobs: DataFrame, visible: DataFrame, max_inflight: int = 3, window: int = 8) -> DataFrame:
    """Next asset to read per project: the first eligible visible one without a job.

    Only the first ``window`` visible assets are considered, and none while
    ``max_inflight`` reads wait.
    """
    require(max_inflight >= 1 and window >= 1, "limits must be positive")
    busy = jobs.filter("response IS NULL AND operation = 'read'").groupBy("project_id").agg(F.count(F.lit(1)).alias("reads"))
    order = Window.partitionBy("project_id").orderBy("position", "asset_id")
    shown = visible.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= window)
    free = shown.filter("eligible").join(jobs.select("project_id", "asset_id").distinct(), ["project_id", "asset_id"], "left_anti")
    ready = free.join(busy, "project_id", "left").filter(F.coalesce("reads", F.lit(0)) < max_inflight)
    return ready.groupBy("project_id").agg(F.min(F.struct("rank", "asset_id")).alias("v")).select("project_id", "v.asset_id")
