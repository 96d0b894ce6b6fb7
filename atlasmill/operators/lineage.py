"""Hierarchies and processing history.

Parents are resolved by pointer doubling: every round each node skips over the
ancestors its current pointer already knows, so a chain of depth d takes about
log2(d) joins over the whole forest.  A round that resolves nothing proves that
the nodes left sit on, or lead into, a cycle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasmill.operators.forest import Forest
from atlasmill.runtime import attach_unique, bucketed_running_sum, cut_lineage, require


def ancestry(nodes: DataFrame, node: str, parent: str, carry: list[str] | None = None,
             stop: Column | None = None, stop_status: Column | None = None, keep_path: bool = True) -> DataFrame:
    """Path from the top of every node's chain down to the node.

    Returns ``node, top, end_parent, depth, path, status``.  ``path`` holds
    structs of the node and the ``carry`` columns; ``end_parent`` is the parent
    value of the topmost node.  ``status`` is ``ok``, ``missing_parent``,
    ``cycle`` or what ``stop_status`` gives for nodes where ``stop`` holds.
    Without ``keep_path`` only the depth is carried.
    """
    item = F.struct(F.col(node).alias("node"), *(carry or []))
    base = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"), item.alias("item"),
                        (stop if stop is not None else F.lit(False)).alias("stop"),
                        (stop_status if stop_status is not None else F.lit("ok")).alias("stop_status"))
    known = base.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    base = attach_unique(base, known, ["parent"], ["node"])
    state = base.select(
        "node", F.when(F.col("known") & ~F.col("stop"), F.col("parent")).alias("ptr"),
        F.col("node").alias("top"), F.col("parent").alias("end_parent"),
        F.when(F.col("known") & ~F.col("stop"), 1).otherwise(0).alias("depth"),
        F.array("item").alias("path") if keep_path else F.lit(None).cast("array<int>").alias("path"),
        F.when(F.col("stop"), F.col("stop_status")).when(F.col("parent").isNotNull() & F.col("known").isNull(),
                                                        F.lit("missing_parent")).otherwise(F.lit("ok")).alias("status"))
    # Finished nodes are written once; each round rewrites only the open ones.
    state = cut_lineage(state)
    done, active = [state.filter("ptr IS NULL")], state.filter("ptr IS NOT NULL")
    left = active.count()
    while left:
        above = reduce(DataFrame.unionByName, [*done, active]).select(F.col("node").alias("ptr"), F.struct(
            "ptr", "top", "end_parent", "depth", "path", "status").alias("up"))
        # A pointer that skipped n ancestors adds n to whatever lies above it.
        # ``above`` is stored and unique on the pointer; a hot parent is split at run time.
        moving = active.join(above, "ptr")
        moved = cut_lineage(moving.select(
            "node", F.col("up.ptr").alias("ptr"), F.col("up.top").alias("top"), F.col("up.end_parent").alias("end_parent"),
            (F.col("up.depth") + F.col("depth")).alias("depth"),
            F.concat("up.path", "path").alias("path") if keep_path else "path", F.col("up.status").alias("status")))
        done, active = [*done, moved.filter("ptr IS NULL")], moved.filter("ptr IS NOT NULL")
        now = active.count()
        if now == left:
            break
        left = now
    state = reduce(DataFrame.unionByName, [*done, active])
    looped = F.col("ptr").isNotNull()
    return state.select(
        "node", F.when(~looped, F.col("top")).alias("top"), F.when(~looped, F.col("end_parent")).alias("end_parent"),
        F.when(~looped, F.col("depth")).alias("depth"), F.when(~looped, F.col("path")).alias("path"),
        F.when(looped, F.lit("cycle")).otherwise(F.col("status")).alias("status"))


def break_cycles(nodes: DataFrame, node: str, parent: str, stuck: DataFrame | None = None) -> DataFrame:
    """The smallest node of every cycle: ``(node)`` rows whose parent link must go.

    Only nodes left over by ``ancestry`` are followed, long enough to be surely
    on the cycle; ``stuck`` has them if that is known already.
    """
    if stuck is None:
        stuck = ancestry(nodes, node, parent, keep_path=False).filter("status = 'cycle'").select("node")
    ring = cut_lineage(nodes.select(F.col(node).alias("node"), F.col(parent).alias("ptr"))
                       .join(stuck, "node", "left_semi").withColumn("low", F.col("node")))
    hops, total = 1, ring.count()
    while hops <= total:
        above = ring.select(F.col("node").alias("ptr"), F.struct("ptr", "low").alias("up"))
        ring = cut_lineage(attach_unique(ring, above, ["ptr"], ["node"], "inner").select(
            "node", F.col("up.ptr").alias("ptr"), F.least("low", "up.low").alias("low")))
        hops *= 2
    on_cycle = ring.select(F.col("ptr").alias("node")).distinct()
    return ring.filter("low = node").join(on_cycle, "node", "left_semi").select("node")


def descendants(nodes: DataFrame, node: str, parent: str, seeds: DataFrame) -> DataFrame:
    """``seed, node, distance`` of every node at or below a seed (cycles have no ancestors)."""
    return Forest(nodes, node, parent).below(seeds)


# --- folders ---------------------------------------------------------------------

def folder_descendants(folders: DataFrame, roots: DataFrame) -> DataFrame:
    below = descendants(folders, "folder_id", "parent_id", roots)
    return below.filter("distance > 0").select(F.col("seed").alias("root_id"), F.col("node").alias("folder_id"))


def folder_paths(folders: DataFrame, projects: DataFrame) -> DataFrame:
    """``Project / A / B`` of every folder; a chain stops at a missing parent."""
    lines = ancestry(folders, "folder_id", "parent_id", ["name"])
    named = lines.select(F.col("node").alias("folder_id"), F.expr("transform(path, p -> p.name)").alias("names"))
    home = folders.select("folder_id", "project_id", "name")
    label = projects.select("project_id", F.col("name").alias("project"))
    return (home.join(named, "folder_id").join(label, "project_id").select(
        "folder_id", "project_id", F.concat_ws(" / ", F.concat(
            F.array("project"), F.coalesce("names", F.array("name")))).alias("path")))


def prune_folders(folders: DataFrame, live_links: DataFrame) -> DataFrame:
    """Folders with at least one live asset at or below them."""
    used = live_links.select(F.col("folder_id").alias("node")).distinct()
    forest = Forest(folders, "folder_id", "parent_id")
    live = forest.nodes.join(used, "node", "left_semi").select("node", F.lit(1).cast("long").alias("n"))
    return folders.join(forest.totals(live).select(F.col("node").alias("folder_id")), "folder_id", "left_semi")


def move_folder_check(folders: DataFrame, moves: DataFrame) -> DataFrame:
    """Verdict per ``(folder_id, new_parent_id)``: ok, own_subtree or name_taken."""
    numbers = Forest(folders, "folder_id", "parent_id").intervals()
    own = numbers.select(F.col("node").alias("folder_id"), "enter", "leave")
    target = numbers.select(F.col("node").alias("new_parent_id"), F.col("enter").alias("at"))
    below = moves.join(own, "folder_id").join(target, "new_parent_id").filter("at BETWEEN enter AND leave").select(
        "folder_id", "new_parent_id", F.lit(True).alias("inside")).distinct()
    moved = moves.join(folders.select("folder_id", "project_id", "name"), "folder_id")
    siblings = folders.select("project_id", F.col("parent_id").alias("new_parent_id"), F.lower("name").alias("low"),
                              F.col("folder_id").alias("other"))
    m, s = moved.withColumn("low", F.lower("name")).alias("m"), siblings.alias("s")
    clash = m.join(s, (F.col("m.project_id") == F.col("s.project_id"))
                   & F.col("m.new_parent_id").eqNullSafe(F.col("s.new_parent_id"))
                   & (F.col("m.low") == F.col("s.low")) & (F.col("m.folder_id") != F.col("s.other"))).select(
        "m.folder_id", "m.new_parent_id").distinct().withColumn("taken", F.lit(True))
    a, b, k = moves.alias("a"), below.alias("b"), clash.alias("k")
    out = a.join(b, ["folder_id", "new_parent_id"], "left")
    out = out.alias("o").join(k, (F.col("o.folder_id") == F.col("k.folder_id"))
                              & F.col("o.new_parent_id").eqNullSafe(F.col("k.new_parent_id")), "left")
    return out.select("o.folder_id", "o.new_parent_id", F.when(F.col("inside"), "own_subtree").when(
        F.col("taken"), "name_taken").otherwise("ok").alias("verdict"))


def name_conflicts(folders: DataFrame) -> DataFrame:
    """Sibling names used more than once, ignoring case."""
    return (folders.groupBy("project_id", "parent_id", F.lower("name").alias("name_key"))
            .agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))


def remove_folder_plan(folders: DataFrame, removed: DataFrame) -> DataFrame:
    """Children of removed folders with their new parent and, on a clash, a numbered name.

    A name is numbered when a folder that stays in the destination, or an
    earlier moved child, already has it.
    """
    gone = removed.join(folders.select("folder_id", F.col("parent_id").alias("new_parent_id")), "folder_id").select(
        F.col("folder_id").alias("parent_id"), "new_parent_id")
    children = folders.join(gone, "parent_id").withColumn("low", F.lower("name"))
    stay = folders.join(removed, "folder_id", "left_anti").select(
        F.col("project_id").alias("p"), F.col("parent_id").alias("np"), F.lower("name").alias("n")).groupBy(
        "p", "np", "n").agg(F.count(F.lit(1)).alias("held"))
    c, s = children.alias("c"), stay.alias("s")
    both = c.join(s, (F.col("c.project_id") == F.col("s.p")) & F.col("c.new_parent_id").eqNullSafe(F.col("s.np"))
                  & (F.col("c.low") == F.col("s.n")), "left").select("c.*", F.coalesce("held", F.lit(0)).alias("held"))
    order = Window.partitionBy("project_id", "new_parent_id", "low").orderBy("folder_id")
    both = both.withColumn("k", F.row_number().over(order) + F.col("held"))
    return both.select("folder_id", "new_parent_id", F.when(F.col("k") > 1, F.concat_ws(" ", "name", "k"))
                       .otherwise(F.col("name")).alias("new_name"))


def remove_folder_links(links: DataFrame, folders: DataFrame, removed: DataFrame) -> DataFrame:
    """Links after the removal: those of a removed folder move to its parent."""
    gone = removed.join(folders.select("folder_id", F.col("parent_id").alias("up")), "folder_id").withColumn("hit", F.lit(True))
    out = attach_unique(links, gone, ["folder_id"], ["asset_id"])
    return out.select("project_id", "asset_id", F.when(F.col("hit"), F.col("up")).otherwise(F.col("folder_id")).alias("folder_id"))


# --- processing history ----------------------------------------------------------------

def full_recipes(gens: DataFrame) -> DataFrame:
    """Complete recipe of every result: ``gen_id, steps, status``.

    Walks up to the nearest saved ``snapshot`` or the root and concatenates
    ``steps`` from there down.  A result without steps, a missing parent or a
    cycle makes the recipe unavailable and is named in ``status``.
    """
    part = F.coalesce("snapshot", "steps")
    prepared = gens.withColumn("part", part)
    lines = ancestry(prepared, "gen_id", "parent_id", ["part"],
                     stop=F.col("snapshot").isNotNull() | F.col("part").isNull(),
                     stop_status=F.when(F.col("part").isNull(), "missing_recipe").otherwise("ok"))
    return lines.select(F.col("node").alias("gen_id"), F.when(
        F.col("status") == "ok", F.expr("flatten(transform(path, p -> p.part))")).alias("steps"), "status")


def local_recipes(gens: DataFrame, full: DataFrame) -> DataFrame:
    """Own steps of every result: what its full recipe adds to its parent's exact prefix."""
    mine = full.select("gen_id", F.col("steps").alias("mine"))
    theirs = full.select(F.col("gen_id").alias("parent_id"), F.col("steps").alias("above"))
    both = attach_unique(gens.select("gen_id", "parent_id").join(mine, "gen_id"), theirs, ["parent_id"], ["gen_id"])
    prefix = F.expr("coalesce(size(above), 0)")
    both = both.withColumn("n", F.when(F.col("above").isNull(), F.lit(0)).otherwise(prefix))
    fits = F.expr("size(mine) > n AND (n = 0 OR slice(mine, 1, GREATEST(n, 1)) = above)")
    return both.select("gen_id", F.when(fits, F.expr("slice(mine, n + 1, size(mine))")).alias("local_steps"))


def _known_parents(gens: DataFrame, detached: DataFrame | None) -> DataFrame:
    """Stored ``gen_id, parent_id`` without the parents of detached results and parents that are missing."""
    gens = cut_lineage(gens.select("gen_id", "parent_id"))  # read for the results and for their parents
    out = gens
    if detached is not None:
        cut = detached.select("gen_id").withColumn("cut", F.lit(True))
        out = out.join(cut, "gen_id", "left").select("gen_id", F.when(F.col("cut").isNull(), F.col("parent_id")).alias("parent_id"))
    known = gens.select(F.col("gen_id").alias("parent_id")).withColumn("known", F.lit(True))
    return cut_lineage(attach_unique(out, known, ["parent_id"], ["gen_id"]).select(
        "gen_id", F.when(F.col("known"), F.col("parent_id")).alias("parent_id")))


def _without_loops(linked: DataFrame, loops: DataFrame) -> DataFrame:
    loops = loops.select(F.col("node").alias("gen_id")).withColumn("cut", F.lit(True))
    return linked.join(loops, "gen_id", "left").select(
        "gen_id", F.when(F.col("cut").isNull(), F.col("parent_id")).alias("display_parent"))


def display_parents(gens: DataFrame, detached: DataFrame | None = None) -> DataFrame:
    """Parent used for drawing: none for detached results, missing parents and one node per cycle."""
    linked = _known_parents(gens, detached)
    return _without_loops(linked, break_cycles(linked, "gen_id", "parent_id"))


def branch_forest(gens: DataFrame, detached: DataFrame | None = None) -> DataFrame:
    """Display parent, root and depth of every result.

    All results are followed once; only those on or below a cycle are followed again, when it is cut.
    """
    linked = _known_parents(gens, detached)
    lines = ancestry(linked, "gen_id", "parent_id", keep_path=False)
    stuck = cut_lineage(lines.filter("status = 'cycle'").select("node").distinct())
    if stuck.isEmpty():
        shown = linked.withColumnRenamed("parent_id", "display_parent")
    else:
        shown = cut_lineage(_without_loops(linked, break_cycles(linked, "gen_id", "parent_id", stuck)))
        again = shown.join(stuck.withColumnRenamed("node", "gen_id"), "gen_id", "left_semi")
        lines = lines.filter("status <> 'cycle'").unionByName(ancestry(again, "gen_id", "display_parent", keep_path=False))
    lines = lines.select(F.col("node").alias("gen_id"), F.col("top").alias("root_id"), "depth")
    return shown.join(lines, "gen_id")


def branch_rows(gens: DataFrame) -> DataFrame:
    """Drawing row of every result inside its tree.

    The first child continues its parent's row, later children start below all
    rows of the earlier ones.  Rows are sums of leaf counts along the path, so
    no tree is ever sorted in one task and no node meets all its ancestors.
    """
    gens = cut_lineage(gens.select("gen_id", "parent_id", "created_at"))
    forest = Forest(gens, "gen_id", "parent_id")
    inner = forest.nodes.filter("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct()
    leaves = forest.totals(forest.nodes.join(inner, "node", "left_anti").select("node", F.lit(1).cast("long").alias("leaves")))
    # children of one parent are numbered by month, so that no parent is a hot spot
    placed = bucketed_running_sum(gens.join(leaves.withColumnRenamed("node", "gen_id"), "gen_id"), ["parent_id"],
                                  F.trunc("created_at", "month"), ["created_at", "gen_id"], "leaves", "before")
    root = F.col("parent").isNull()
    steps = forest.nodes.join(placed.select(F.col("gen_id").alias("node"), "before"), "node").select(
        "node", F.when(root, 0).otherwise(F.coalesce("before", F.lit(0))).cast("long").alias("row"), F.lit(1).cast("long").alias("depth"),
        F.when(root, F.col("node")).alias("root_id"))
    rows = forest.along_paths(steps, {"row": "sum", "depth": "sum", "root_id": "max"})
    return rows.select(F.col("node").alias("gen_id"), "root_id", (F.col("depth") - 1).cast("int").alias("depth"), "row")


def subtree(gens: DataFrame, seeds: DataFrame) -> DataFrame:
    """Results at or below each seed with their depth below it."""
    return descendants(gens, "gen_id", "parent_id", seeds).select(
        "seed", F.col("node").alias("gen_id"), F.col("distance").alias("depth"))


def delete_plan(gens: DataFrame, seeds: DataFrame) -> DataFrame:
    """Deletion order: a result is removed only after everything below it."""
    below = Forest(gens, "gen_id", "parent_id").under_any(seeds)
    return below.select(F.col("node").alias("gen_id"), F.col("distance").alias("depth")).orderBy(F.desc("depth"), "gen_id")


def insertion_plan(gens: DataFrame, anchors: DataFrame) -> DataFrame:
    """Results to recompute after inserting ``(anchor_id, inserted_id)``, level by level."""
    below = descendants(gens, "gen_id", "parent_id", anchors.select("anchor_id")).filter("distance > 0")
    old = gens.select(F.col("gen_id").alias("node"), "parent_id", "operation_id")
    out = below.join(old, "node").join(anchors.withColumnRenamed("anchor_id", "seed"), "seed")
    return out.select(F.col("seed").alias("anchor_id"), F.col("node").alias("gen_id"), F.col("distance").alias("level"),
                      F.when(F.col("distance") == 1, F.col("inserted_id")).otherwise(F.col("parent_id")).alias("new_parent_id"),
                      "operation_id")


def merge_plan(gens: DataFrame, pairs: DataFrame, detached: DataFrame | None = None) -> DataFrame:
    """Steps that replay the path of ``leaf_a`` after ``leaf_b``, or why that is refused.

    Only the paths of the named leaves are followed.
    """
    gens = cut_lineage(gens.select("gen_id", "parent_id", "operation_id"))
    linked = _known_parents(gens, detached)
    forest = Forest(linked, "gen_id", "parent_id")
    if forest.looped is not None:  # the forest has no place for these until their cycles are cut
        rest = linked.join(forest.looped.withColumnRenamed("node", "gen_id"), "gen_id", "left_semi")
        forest.add(Forest(_without_loops(rest, break_cycles(rest, "gen_id", "parent_id", forest.looped)), "gen_id", "display_parent"))
    pairs = cut_lineage(pairs)  # read for the leaves and for the verdicts
    leaves = pairs.select(F.col("leaf_a").alias("leaf")).unionByName(pairs.select(F.col("leaf_b").alias("leaf"))).distinct()
    paths = cut_lineage(forest.above(leaves))
    ends = paths.groupBy("seed").agg(F.max("distance").alias("depth"), F.max_by("node", "distance").alias("top"))
    inner = forest.nodes.filter("parent IS NOT NULL").select(F.col("parent").alias("seed")).distinct().withColumn("inner", F.lit(True))
    ends = ends.join(inner, "seed", "left")
    both = pairs
    for side in "ab":
        both = both.join(ends.select(F.col("seed").alias(f"leaf_{side}"), F.col("top").alias(f"top_{side}"),
                                     F.col("depth").alias(f"depth_{side}"), F.col("inner").alias(f"inner_{side}")), f"leaf_{side}")
    verdict = (F.when(F.col("top_a") == F.col("top_b"), "same_branch").when(F.col("inner_a"), "source_not_leaf")
               .when(F.col("inner_b"), "target_not_leaf").otherwise("ok"))
    both = both.withColumn("verdict", verdict)
    refused = both.filter("verdict <> 'ok'").select("leaf_a", "leaf_b", "verdict", F.lit(None).cast("int").alias("step_index"),
                                                    F.lit(None).cast(gens.schema["gen_id"].dataType).alias("gen_id"))
    replayed = both.filter("verdict = 'ok'").join(paths.withColumnRenamed("seed", "leaf_a"), "leaf_a").select(
        "leaf_a", "leaf_b", "verdict", (F.col("depth_a") - F.col("distance")).alias("step_index"), F.col("node").alias("gen_id"))
    return attach_unique(replayed.unionByName(refused), gens.select("gen_id", "operation_id"), ["gen_id"], ["leaf_a"]).select(
        "leaf_a", "leaf_b", "verdict", "step_index", "gen_id", "operation_id")


def remap_clone(gens: DataFrame, id_map: DataFrame) -> DataFrame:
    """Copies of the mapped results; a parent outside the copy becomes NULL."""
    own = id_map.select(F.col("old_id").alias("gen_id"), F.col("new_id").alias("new_gen_id"))
    above = id_map.select(F.col("old_id").alias("parent_id"), F.col("new_id").alias("new_parent_id"))
    out = attach_unique(gens.join(own, "gen_id"), above, ["parent_id"], ["gen_id"])
    return out.select("source_id", F.col("new_gen_id").alias("gen_id"), F.col("new_parent_id").alias("parent_id"),
                      "created_at", "operation_id")


def selected_generation(gens: DataFrame) -> DataFrame:
    """Newest result per source; combined before the shuffle, so a busy source is no hot spot."""
    return gens.groupBy("source_id").agg(F.max(F.struct("created_at", "gen_id", "operation_id")).alias("v")).select(
        "source_id", "v.gen_id", "v.created_at", "v.operation_id")


# --- undo store, links between cels ---------------------------------------------------------

def undo_retention(actions: DataFrame, capacity: int) -> DataFrame:
    """The newest ``capacity`` actions."""
    require(1 <= capacity <= 64, "capacity must be 1..64")
    return actions.select("action_id").distinct().orderBy(F.desc("action_id")).limit(capacity)


def unused_objects(snapshots: DataFrame, kept: DataFrame) -> DataFrame:
    """Content hashes no kept snapshot refers to."""
    hashed = snapshots.select("action_id", F.sha2("payload", 256).alias("hash"))
    used = hashed.join(kept.select("action_id").distinct(), "action_id", "left_semi").select("hash")
    return hashed.select("hash").distinct().join(used.distinct(), "hash", "left_anti")


def resolve_linked_cels(cels: DataFrame) -> DataFrame:
    """Frame whose image every cel shows, with the number of links followed."""
    nodes = cels.select(
        F.struct("doc_id", "layer", "frame").alias("id"),
        F.when(F.col("linked_frame").isNotNull(), F.struct(
            "doc_id", "layer", F.col("linked_frame").alias("frame"))).alias("parent"))
    lines = ancestry(nodes, "id", "parent", keep_path=False)
    return lines.select("node.doc_id", "node.layer", "node.frame", F.col("top.frame").alias("source_frame"),
                        F.col("depth").alias("hops"), F.when(F.col("status") == "missing_parent", "dangling")
                        .otherwise(F.col("status")).alias("status"))


def resolve_redirects(redirects: DataFrame, live: DataFrame) -> DataFrame:
    """Live path behind every redirect chain; dead and circular chains are dropped."""
    ends = ancestry(redirects.filter("path <> target"), "path", "target", keep_path=False).filter("end_parent IS NOT NULL").select(
        F.col("node").alias("path"), F.col("end_parent").alias("target"))
    return attach_unique(ends, live.select(F.col("path").alias("target")).distinct().withColumn("live", F.lit(True)),
                         ["target"], ["path"], "inner").select("path", "target")
