"""Hierarchies, history and undo."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasmill.operators import lineage as g
from queries.base import Area

area = Area()
add = area.add

UP = """up AS (SELECT folder_id, folder_id AS anc, parent_id AS nxt FROM folders UNION ALL SELECT up.folder_id, f.folder_id, f.parent_id FROM up JOIN folders f ON f.folder_id = up.nxt)"""
add("folder_descendants", lambda v: g.folder_descendants(v.folders(), v.folders().filter("folder_id % 2 = 1").select("folder_id")), f"""
    WITH RECURSIVE {UP} SELECT anc AS root_id, folder_id FROM up WHERE anc % 2 = 1 AND folder_id <> anc""")
add("folder_paths", lambda v: g.folder_paths(v.folders(), v.projects()), """
    WITH RECURSIVE fp AS (SELECT folder_id, project_id, name AS path FROM folders WHERE parent_id IS NULL
      UNION ALL SELECT f.folder_id, f.project_id, concat(fp.path, ' / ', f.name) FROM folders f JOIN fp ON f.parent_id = fp.folder_id)
    SELECT folder_id, fp.project_id, concat(p.name, ' / ', path) AS path FROM fp JOIN projects p ON p.project_id = fp.project_id""")
add("prune_folders", lambda v: g.prune_folders(v.folders(), v.links().filter("asset_id % 17 = 1")), f"""
    WITH RECURSIVE {UP} SELECT * FROM folders WHERE folder_id IN (SELECT anc FROM up WHERE folder_id IN (SELECT folder_id FROM links WHERE asset_id % 17 = 1))""")
_MOVES = "n_nationkey AS folder_id, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE (n_nationkey * 3 + 5) % 25 END AS new_parent_id"


def initials(v):
    """Folder names cut to their first letter, so siblings collide."""
    return v.folders().withColumn("name", F.expr("CASE WHEN folder_id % 2 = 0 THEN left(name, 1) ELSE lower(left(name, 1)) END"))


INIT = "nf AS (SELECT folder_id, project_id, parent_id, CASE WHEN folder_id % 2 = 0 THEN left(name, 1) ELSE lower(left(name, 1)) END AS name FROM folders)"
add("move_folder_check", lambda v: g.move_folder_check(initials(v).withColumn("project_id", F.lit(0)), v.table("nation").selectExpr(*_MOVES.split(", ", 1))), f"""
    WITH RECURSIVE {UP}, {INIT}, mv AS (SELECT {_MOVES} FROM nation)
    SELECT m.folder_id, m.new_parent_id, CASE WHEN EXISTS (SELECT 1 FROM up WHERE up.anc = m.folder_id AND up.folder_id = m.new_parent_id) THEN 'own_subtree'
      WHEN EXISTS (SELECT 1 FROM nf s WHERE s.parent_id IS NOT DISTINCT FROM m.new_parent_id AND lower(s.name) = lower(f.name) AND s.folder_id <> m.folder_id) THEN 'name_taken' ELSE 'ok' END AS verdict
    FROM mv m JOIN nf f ON f.folder_id = m.folder_id""")
add("name_conflicts", lambda v: g.name_conflicts(initials(v).withColumn("project_id", F.expr("project_id % 2")).withColumn("parent_id", F.expr("parent_id % 3"))), f"""
    WITH {INIT} SELECT project_id % 2 AS project_id, parent_id % 3 AS parent_id, lower(name) AS name_key, count(*) AS n FROM nf GROUP BY 1, 2, 3 HAVING count(*) > 1""")
_GONE = "folder_id BETWEEN 5 AND 9"
add("remove_folder_plan", lambda v: g.remove_folder_plan(initials(v).withColumn("project_id", F.lit(0)).withColumn(
    "parent_id", F.expr("CASE WHEN folder_id BETWEEN 5 AND 9 THEN 0 ELSE parent_id END")), v.folders().filter(_GONE).select("folder_id")), f"""
    WITH {INIT}, f AS (SELECT folder_id, CASE WHEN folder_id BETWEEN 5 AND 9 THEN 0 ELSE parent_id END AS parent_id, name FROM nf),
    c AS (SELECT f.folder_id, f.name, p.parent_id AS new_parent_id FROM f JOIN f p ON p.folder_id = f.parent_id WHERE p.{_GONE}),
    s AS (SELECT parent_id, lower(name) AS n, count(*) AS held FROM f WHERE NOT ({_GONE}) GROUP BY 1, 2),
    k AS (SELECT c.*, ROW_NUMBER() OVER (PARTITION BY new_parent_id, lower(name) ORDER BY folder_id) + coalesce(held, 0) AS k FROM c LEFT JOIN s ON s.parent_id IS NOT DISTINCT FROM c.new_parent_id AND s.n = lower(c.name))
    SELECT folder_id, new_parent_id, CASE WHEN k > 1 THEN concat(name, ' ', k) ELSE name END AS new_name FROM k""")
add("remove_folder_links", lambda v: g.remove_folder_links(v.links(), v.folders(), v.folders().filter(_GONE).select("folder_id")), f"""
    SELECT l.project_id, asset_id, CASE WHEN l.{_GONE} THEN f.parent_id ELSE l.folder_id END AS folder_id FROM links l LEFT JOIN folders f ON f.folder_id = l.folder_id""")

BAD = [(-1, -1, -2), (-1, -2, -1), (-1, -3, -99), (-1, -4, -3), (-1, -5, -2)]
STEPS = "CASE WHEN gen_id % 13 = 0 THEN NULL ELSE {a}operation_id, CAST(gen_id % 3 AS {s}){z} END AS steps"
SNAP = "CASE WHEN gen_id % 11 = 0 THEN {a}'saved', operation_id{z} END AS snapshot"


def history(v):
    """The history plus a cycle, a branch into it and a missing parent."""
    bad = v.table("region").agg(F.count("*")).select(F.inline(F.array(*[F.struct(
        F.lit(s).cast("bigint").alias("source_id"), F.lit(i).cast("bigint").alias("gen_id"), F.lit(p).cast("bigint").alias("parent_id"))
        for s, i, p in BAD]))).selectExpr("*", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS created_at", "'image.resize' AS operation_id")
    gens = v.gens()
    return gens.unionByName(bad.withColumn("created_at", F.col("created_at").cast(gens.schema["created_at"].dataType)))


HIST = "h AS MATERIALIZED (SELECT * FROM gens UNION ALL SELECT s, i, p, TIMESTAMP '2024-01-01', 'image.resize' FROM (VALUES " + ", ".join(map(str, BAD)) + ") t(s, i, p))"


def with_parts(v):
    return history(v).selectExpr("*", STEPS.format(a="array(", z=")", s="STRING"), SNAP.format(a="array(", z=")"))


PARTS = f"hp AS MATERIALIZED (SELECT *, {STEPS.format(a='[', z=']', s='VARCHAR')}, {SNAP.format(a='[', z=']')} FROM h)"
FULL = f"""{HIST}, {PARTS},
    w AS (SELECT gen_id, coalesce(snapshot, steps) AS acc, CASE WHEN snapshot IS NOT NULL OR steps IS NULL THEN NULL ELSE parent_id END AS nxt,
        CASE WHEN snapshot IS NOT NULL OR (steps IS NOT NULL AND parent_id IS NULL) THEN 'ok' WHEN steps IS NULL THEN 'missing_recipe' END AS st, 1 AS d FROM hp
      UNION ALL SELECT w.gen_id, list_concat(coalesce(p.snapshot, p.steps), acc), CASE WHEN p.snapshot IS NOT NULL OR p.steps IS NULL THEN NULL ELSE p.parent_id END,
        CASE WHEN p.snapshot IS NOT NULL OR (p.steps IS NOT NULL AND p.parent_id IS NULL) THEN 'ok' WHEN p.steps IS NULL THEN 'missing_recipe' END, d + 1
      FROM w JOIN hp p ON p.gen_id = w.nxt WHERE d < 20),
    miss AS (SELECT gen_id FROM w WHERE nxt IS NOT NULL AND nxt NOT IN (SELECT gen_id FROM h)),
    fr AS MATERIALIZED (SELECT h.gen_id, CASE WHEN w.st = 'ok' THEN acc END AS steps, CASE WHEN w.st IS NOT NULL THEN w.st WHEN h.gen_id IN (SELECT gen_id FROM miss) THEN 'missing_parent' ELSE 'cycle' END AS status
      FROM h LEFT JOIN w ON w.gen_id = h.gen_id AND w.st IS NOT NULL)"""
add("full_recipes", lambda v: g.full_recipes(with_parts(v)), f"WITH RECURSIVE {FULL} SELECT * FROM fr")
add("local_recipes", lambda v: g.local_recipes(with_parts(v), g.full_recipes(with_parts(v))), f"""
    WITH RECURSIVE {FULL} SELECT h.gen_id, CASE WHEN len(m.steps) > coalesce(len(p.steps), 0) AND (p.steps IS NULL OR m.steps[1:len(p.steps)] = p.steps) THEN m.steps[coalesce(len(p.steps), 0)+1:] END AS local_steps
    FROM h JOIN fr m ON m.gen_id = h.gen_id LEFT JOIN fr p ON p.gen_id = h.parent_id""")
SHOWN = f"""{HIST}, dp AS MATERIALIZED (SELECT gen_id, CASE WHEN gen_id % 29 = 3 OR gen_id = -2 OR parent_id NOT IN (SELECT gen_id FROM h) THEN NULL ELSE parent_id END AS display_parent FROM h),
    fo AS (SELECT gen_id, gen_id AS root_id, 0 AS depth, [gen_id] AS path FROM dp WHERE display_parent IS NULL UNION ALL SELECT d.gen_id, root_id, depth + 1, list_append(path, d.gen_id) FROM dp d JOIN fo ON d.display_parent = fo.gen_id)"""
add("branch_forest", lambda v: g.branch_forest(history(v), history(v).filter("gen_id % 29 = 3").select("gen_id")), f"""
    WITH RECURSIVE {SHOWN} SELECT gen_id, display_parent, root_id, CAST(depth AS INT) AS depth FROM fo JOIN dp USING (gen_id)""")
add("branch_rows", lambda v: g.branch_rows(v.gens()), """
    WITH RECURSIVE t AS MATERIALIZED (SELECT * FROM gens),
    p AS (SELECT gen_id, gen_id AS root_id, 0 AS depth, [gen_id] AS path FROM t WHERE parent_id IS NULL UNION ALL SELECT t.gen_id, root_id, depth + 1, list_append(path, t.gen_id) FROM t JOIN p ON t.parent_id = p.gen_id),
    l AS (SELECT g, count(*) AS leaves FROM (SELECT unnest(path) AS g FROM p WHERE gen_id NOT IN (SELECT parent_id FROM t WHERE parent_id IS NOT NULL)) GROUP BY g),
    s AS (SELECT gen_id, coalesce(sum(leaves) OVER (PARTITION BY parent_id ORDER BY created_at, gen_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t JOIN l ON l.g = t.gen_id WHERE parent_id IS NOT NULL),
    r AS (SELECT p.gen_id, CAST(sum(coalesce(before, 0)) AS BIGINT) AS row FROM (SELECT gen_id, unnest(path) AS g FROM p) p LEFT JOIN s ON s.gen_id = p.g GROUP BY 1)
    SELECT gen_id, root_id, CAST(depth AS INT) AS depth, "row" FROM p JOIN r USING (gen_id)""".replace(" AS row", ' AS "row"'))
TREE = "st AS (SELECT gen_id AS seed, gen_id, 0 AS depth FROM h WHERE gen_id % 10 = 1 AND gen_id > 0 UNION ALL SELECT seed, h.gen_id, depth + 1 FROM st JOIN h ON h.parent_id = st.gen_id)"
_SEEDS = "gen_id % 10 = 1 AND gen_id > 0"
add("subtree", lambda v: g.subtree(history(v), history(v).filter(_SEEDS).select("gen_id")),
    f"WITH RECURSIVE {HIST}, {TREE} SELECT seed, gen_id, CAST(depth AS INT) AS depth FROM st")
add("delete_plan", lambda v: g.delete_plan(history(v), history(v).filter(_SEEDS).select("gen_id")),
    f"WITH RECURSIVE {HIST}, {TREE} SELECT gen_id, CAST(max(depth) AS INT) AS depth FROM st GROUP BY gen_id ORDER BY 2 DESC, 1")
add("insertion_plan", lambda v: g.insertion_plan(history(v), history(v).filter(_SEEDS).selectExpr("gen_id AS anchor_id", "gen_id + 1000000000 AS inserted_id")), f"""
    WITH RECURSIVE {HIST}, {TREE} SELECT seed AS anchor_id, st.gen_id, CAST(depth AS INT) AS level, CASE WHEN depth = 1 THEN seed + 1000000000 ELSE h.parent_id END AS new_parent_id, operation_id
    FROM st JOIN h ON h.gen_id = st.gen_id WHERE depth > 0""")


def pairs(v):
    return v.gens().groupBy("source_id").agg(F.max("gen_id").alias("leaf_a"), F.max_by("gen_id", F.expr("gen_id % 101 * 1000000000 + gen_id")).alias("leaf_b")).drop("source_id")


add("merge_plan", lambda v: g.merge_plan(history(v), pairs(v), history(v).filter("gen_id % 29 = 3").select("gen_id")), f"""
    WITH RECURSIVE {SHOWN}, pr AS (SELECT max(gen_id) AS leaf_a, arg_max(gen_id, gen_id % 101 * 1000000000 + gen_id) AS leaf_b FROM gens GROUP BY source_id),
    ps AS (SELECT leaf_a, leaf_b, fa.path, CASE WHEN fa.root_id = fb.root_id THEN 'same_branch' WHEN leaf_a IN (SELECT display_parent FROM dp) THEN 'source_not_leaf'
      WHEN leaf_b IN (SELECT display_parent FROM dp) THEN 'target_not_leaf' ELSE 'ok' END AS verdict FROM pr JOIN fo fa ON fa.gen_id = leaf_a JOIN fo fb ON fb.gen_id = leaf_b),
    e AS (SELECT leaf_a, leaf_b, verdict, i - 1 AS step_index, path[i] AS gen_id FROM (SELECT *, unnest(range(1, len(path)+1)) AS i FROM ps WHERE verdict = 'ok') UNION ALL SELECT leaf_a, leaf_b, verdict, NULL, NULL FROM ps WHERE verdict <> 'ok')
    SELECT leaf_a, leaf_b, verdict, CAST(step_index AS INT) AS step_index, e.gen_id, operation_id FROM e LEFT JOIN h ON h.gen_id = e.gen_id""")
add("remap_clone", lambda v: g.remap_clone(v.gens(), v.gens().filter("gen_id % 8 <> 0").selectExpr("gen_id AS old_id", "gen_id * 2 + 1 AS new_id")), """
    WITH t AS MATERIALIZED (SELECT * FROM gens) SELECT source_id, gen_id*2 + 1 AS gen_id, CASE WHEN parent_id % 8 <> 0 THEN parent_id*2 + 1 END AS parent_id, created_at, operation_id FROM t WHERE gen_id % 8 <> 0""")
add("selected_generation", lambda v: g.selected_generation(v.gens()), """
    SELECT source_id, gen_id, created_at, operation_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY created_at DESC, gen_id DESC) AS k FROM gens) WHERE k = 1""")
add("undo_retention", lambda v: g.undo_retention(v.snaps(), 20), "SELECT DISTINCT action_id FROM snaps ORDER BY action_id DESC LIMIT 20")
add("unused_objects", lambda v: g.unused_objects(v.snaps(), g.undo_retention(v.snaps(), 40)), """
    WITH k AS (SELECT DISTINCT action_id FROM snaps ORDER BY action_id DESC LIMIT 40)
    SELECT DISTINCT sha256(payload) AS hash FROM snaps EXCEPT SELECT sha256(payload) FROM snaps WHERE action_id IN (SELECT action_id FROM k)""")
# far more kept actions than an undo store holds: all but the ten newest
add("unused_objects_many_kept", lambda v: g.unused_objects(v.snaps(), v.snaps().select("action_id").distinct().join(
    g.undo_retention(v.snaps(), 10), "action_id", "left_anti")), """
    WITH k AS (SELECT DISTINCT action_id FROM snaps ORDER BY action_id DESC LIMIT 10)
    SELECT DISTINCT sha256(payload) AS hash FROM snaps EXCEPT SELECT sha256(payload) FROM snaps WHERE action_id NOT IN (SELECT action_id FROM k)""")
add("resolve_linked_cels", lambda v: g.resolve_linked_cels(v.cels().withColumn(
    "linked_frame", F.expr("CASE WHEN doc_id % 50 = 7 AND frame = 0 THEN 99 ELSE linked_frame END"))), """
    WITH RECURSIVE c AS MATERIALIZED (SELECT doc_id, layer, frame, CASE WHEN doc_id % 50 = 7 AND frame = 0 THEN 99 ELSE linked_frame END AS linked_frame FROM cels),
    r AS (SELECT doc_id, layer, frame, frame AS source_frame, linked_frame AS nxt, 0 AS hops FROM c UNION ALL SELECT r.doc_id, r.layer, r.frame, c.frame, c.linked_frame, hops + 1 FROM r JOIN c ON c.doc_id = r.doc_id AND c.layer = r.layer AND c.frame = r.nxt)
    SELECT doc_id, layer, frame, arg_max(source_frame, hops) AS source_frame, CAST(max(hops) AS INT) AS hops, CASE WHEN arg_max(coalesce(nxt, -1), hops) >= 0 THEN 'dangling' ELSE 'ok' END AS status FROM r GROUP BY 1, 2, 3""")


def chains(v):
    """Redirects lengthened by a second hop."""
    base = v.redirects()
    return base.selectExpr("path", "concat(target, '2') AS target").unionByName(
        base.selectExpr("concat(target, '2') AS path", "target"))


add("resolve_redirects", lambda v: g.resolve_redirects(chains(v), v.sync().filter("side = 'remote'")), """
    SELECT path, target FROM redirects WHERE target IN (SELECT path FROM sync WHERE side = 'remote')
    UNION ALL SELECT concat(target, '2'), target FROM redirects WHERE target IN (SELECT path FROM sync WHERE side = 'remote')""")

QUERIES, SQL = area.queries, area.sql
