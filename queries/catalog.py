"""Catalog search, links and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasmill.functions import text
from atlasmill.operators import catalog as c
from queries.base import Area

area = Area()
add = area.add

PART_OK = r"""NOT regexp_matches(p, '[\\.:*?"<>|\r\n]') AND p <> '' AND lower(p) NOT IN ('__externalactors__', '__externalobjects__')"""


def visible_sql(path):
    return rf"""({path} = '/Game' OR (starts_with({path}, '/Game/') AND len(list_filter(string_split(substring({path}, 7), '/'), lambda p: NOT ({PART_OK}))) = 0))"""


def valid_sql(path):
    dot = f"(length({path}) - strpos(reverse({path}), '.'))"
    slash = f"(length({path}) - strpos(reverse({path}), '/'))"
    return f"""(contains({path}, '.') AND contains({path}, '/') AND {slash} >= 5 AND {dot} > {slash} + 1
      AND substring({path}, {slash} + 2, {dot} - {slash} - 1) = substring({path}, {dot} + 2) AND {visible_sql(f'left({path}, {dot})')})"""


add("asset_search", lambda v: c.asset_search(v.assets(), ["re", "#BRAND"], kind=1, transparent=False), """
    SELECT * FROM assets WHERE (contains(lower(name), 're') OR len(list_filter(tags, lambda t: contains(lower(t), 're'))) > 0)
      AND (contains(lower(name), '#brand') OR len(list_filter(tags, lambda t: contains(lower(t), 'brand'))) > 0) AND kind = 1 AND transparent = false""")
# Real URLs are seldom well-formed object paths; give every third one its own name twice and break some.
def varied_paths(v):
    named = "CONCAT(regexp_replace(path, '/[^/]*$', ''), '/A', page_id, '.A', page_id)"
    return v.paths().selectExpr("page_id", f"CASE page_id % 4 WHEN 0 THEN path WHEN 1 THEN {named} WHEN 2 THEN lower({named}) "
                                f"ELSE CONCAT(regexp_replace({named}, '[.][^.]*$', ''), '.B') END AS path")


VARIED = """vp AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN path WHEN 1 THEN n WHEN 2 THEN lower(n) ELSE concat(regexp_replace(n, '[.][^.]*$', ''), '.B') END AS path
      FROM (SELECT *, concat(regexp_replace(path, '/[^/]*$', ''), '/A', page_id, '.A', page_id) AS n FROM paths))"""
add("valid_object_path", lambda v: varied_paths(v).select(
    "page_id", "path", F.expr(text.valid_object_path("path")).alias("valid"),
    F.expr(text.visible_folder("regexp_replace(path, '/[^/]*$', '')")).alias("folder_visible")), f"""
    WITH {VARIED}, f AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS fo FROM vp)
    SELECT page_id, path, {valid_sql('path')} AS valid, {visible_sql('fo')} AS folder_visible FROM f""")
_COPIES = "concat(name, CASE WHEN asset_id % 3 = 0 THEN '.PNG' ELSE '.ase' END, repeat(' — copy', CAST(asset_id % 3 AS INT)))"
add("display_name", lambda v: v.assets().selectExpr("asset_id", f"{_COPIES} AS shown").select(
    "asset_id", F.expr(text.display_name("shown", "'.png'")).alias("display_name")), f"""
    WITH s AS (SELECT asset_id, {_COPIES} AS n FROM assets), t AS (SELECT *, regexp_extract(n, '((?: — (?:copy|копия))*)$', 1) AS tail FROM s),
    u AS (SELECT *, left(n, length(n) - length(tail)) AS stem FROM t)
    SELECT asset_id, CASE WHEN length(stem) > 4 AND lower(right(stem, 4)) = '.png' THEN concat(left(stem, length(stem)-4), tail) ELSE n END AS display_name FROM u""")
add("safe_asset_name", lambda v: v.assets().select("asset_id", F.expr(text.safe_asset_name(
    "concat(name, '-', array_join(tags, ' '), '.png')", "asset_id", "CASE WHEN kind = 0 THEN 'color' ELSE 'normal' END")).alias("safe_name")), """
    WITH s AS (SELECT asset_id, kind, trim(regexp_replace(concat(name, '-', array_to_string(tags, ' ')), '[^A-Za-z0-9_]+', '_', 'g'), '_') AS n FROM assets),
    t AS (SELECT *, CASE WHEN regexp_matches(n, '^[A-Za-z]') THEN n ELSE concat('Image_', n) END AS m FROM s)
    SELECT asset_id, concat('T_', CASE WHEN length(m) > 20 THEN rtrim(left(m, 20), '_') ELSE m END, '_', asset_id, CASE WHEN kind = 0 THEN '' ELSE '_normal' END) AS safe_name FROM t""")
PATHS = """fp AS (SELECT folder_id, project_id, name AS path FROM folders WHERE parent_id IS NULL
      UNION ALL SELECT f.folder_id, f.project_id, concat(fp.path, ' / ', f.name) FROM folders f JOIN fp ON f.parent_id = fp.folder_id)"""
add("asset_locations", lambda v: c.asset_locations(v.links(), v.folders(), v.projects()), f"""
    WITH RECURSIVE {PATHS} SELECT l.project_id, l.asset_id, CASE WHEN fp.path IS NULL THEN p.name ELSE concat(q.name, ' / ', fp.path) END AS location
    FROM links l JOIN projects p ON p.project_id = l.project_id LEFT JOIN fp ON fp.folder_id = l.folder_id LEFT JOIN projects q ON q.project_id = fp.project_id""")
add("unassigned_assets", lambda v: c.unassigned_assets(v.assets(), v.links()).select("asset_id", "name"),
    "SELECT asset_id, name FROM assets WHERE asset_id NOT IN (SELECT asset_id FROM links)")
add("assets_in_scope", lambda v: c.assets_in_scope(v.assets(), v.links(), v.folders(), 2, 7).select("asset_id", "name"), """
    WITH RECURSIVE d AS (SELECT folder_id FROM folders WHERE folder_id = 7 UNION SELECT f.folder_id FROM folders f JOIN d ON f.parent_id = d.folder_id)
    SELECT asset_id, name FROM assets WHERE asset_id IN (SELECT asset_id FROM links WHERE project_id = 2 AND folder_id IN (SELECT folder_id FROM d))""")
add("recent_assets", lambda v: c.recent_assets(v.assets(), 50).select("asset_id", "opened_at"),
    "SELECT asset_id, opened_at FROM assets WHERE opened_at IS NOT NULL ORDER BY opened_at DESC, asset_id LIMIT 50")
_CHANGED = "CASE WHEN asset_id % 9 = 0 THEN NULL ELSE width * 1000 + asset_id % 7 END AS modified_at"
add("modified_assets", lambda v: c.modified_assets(v.assets().selectExpr("asset_id", _CHANGED), 60),
    f"SELECT asset_id, {_CHANGED} FROM assets ORDER BY modified_at DESC NULLS LAST, asset_id LIMIT 60")
add("macros_by_name", lambda v: c.macros_by_name(v.assets().select("asset_id", "name"), "name"),
    "SELECT asset_id, name FROM assets ORDER BY lower(name), name")
add("common_tags", lambda v: c.common_tags(v.assets(), ["width"]).unionByName(
    c.common_tags(v.assets().withColumn("width", F.expr("CAST(asset_id AS INT)")), ["width"])), """
    WITH u AS (SELECT width, asset_id, tags FROM assets UNION ALL SELECT CAST(asset_id AS INT), asset_id + 1000000000, tags FROM assets),
    g AS (SELECT *, asset_id >= 1000000000 AS side FROM u),
    t AS (SELECT side, width, count(*) AS total FROM g GROUP BY 1, 2), e AS (SELECT DISTINCT side, width, asset_id, unnest(tags) AS tag FROM g)
    SELECT width, tag FROM (SELECT side, width, tag, count(*) AS n FROM e GROUP BY 1, 2, 3) JOIN t USING (side, width) WHERE n = total""")
add("ancestor_folders", lambda v: c.ancestor_folders(varied_paths(v)), f"""
    WITH {VARIED}, s AS (SELECT string_split(path, '/') AS p FROM vp WHERE {valid_sql('path')})
    SELECT DISTINCT array_to_string(p[1:i], '/') AS folder FROM (SELECT p, unnest(range(2, len(p))) AS i FROM s)""")
add("first_per_path", lambda v: c.first_per_path(v.paths()), """
    SELECT lower(path) AS path_key, min(page_id) AS page_id, arg_min(path, page_id) AS path FROM paths GROUP BY 1""")


def sides(v):
    s = v.sync()
    return s.filter("side = 'local'").drop("side"), s.filter("side = 'remote'").drop("side"), v.redirects()


add("reconcile_catalog", lambda v: c.reconcile_catalog(*sides(v)), """
    WITH l AS (SELECT path, revision FROM sync WHERE side = 'local'), r AS (SELECT path, revision FROM sync WHERE side = 'remote'),
    m AS (SELECT 'matched' AS status, l.path AS local_path, r.path AS remote_path, r.revision AS remote_revision FROM l JOIN r ON lower(l.path) = lower(r.path)),
    mv AS (SELECT 'moved' AS status, min(l.path) AS local_path, r.path AS remote_path, r.revision AS remote_revision FROM l JOIN redirects d ON d.path = l.path JOIN r ON r.path = d.target
      WHERE l.path NOT IN (SELECT local_path FROM m) AND r.path NOT IN (SELECT remote_path FROM m) GROUP BY r.path, r.revision)
    SELECT * FROM m UNION ALL SELECT * FROM mv
    UNION ALL SELECT 'needs_destination', path, NULL, NULL FROM l WHERE path NOT IN (SELECT local_path FROM m UNION ALL SELECT local_path FROM mv)
    UNION ALL SELECT 'new', NULL, path, revision FROM r WHERE path NOT IN (SELECT remote_path FROM m UNION ALL SELECT remote_path FROM mv)""")


def transfers(v):
    t = v.transfers().withColumnRenamed("doc_id", "name")
    announced = t.filter("announced = 1").select("name", F.upper(F.sha2(F.expr(
        "CASE WHEN name % 5 = 0 THEN concat(payload, '!') ELSE payload END"), 256)).alias("hash"))
    return c.verify_transfers(t, announced, t.filter("received = 1").select("name", F.sha2("payload", 256).alias("hash")))


add("verify_transfers", transfers, "SELECT doc_id AS name, sha256(payload) AS hash FROM transfers WHERE announced = 1 AND doc_id % 5 <> 0 AND received <> 1")
add("import_dedupe", lambda v: c.import_dedupe(
    v.table("documents").selectExpr("doc_id", "upper(source) AS path", "text AS content"),
    v.table("documents").join(v.table("labels"), "doc_id").selectExpr("source AS path", "text AS content")), """
    SELECT doc_id, upper(source) AS path, sha256(text) AS hash FROM documents d WHERE NOT EXISTS (
      SELECT 1 FROM documents e JOIN labels l ON e.doc_id = l.doc_id WHERE lower(e.source) = lower(d.source) AND e.text = d.text)""")
add("sync_upsert", lambda v: c.sync_upsert(
    v.assets().filter("asset_id % 3 <> 0"),
    v.table("part").selectExpr("p_partkey AS asset_id", "p_brand AS label", "p_size AS source_width", "p_size + 1 AS source_height",
                               "CASE WHEN p_partkey % 2 = 0 THEN p_size * 3 END AS result_width",
                               "CASE WHEN p_partkey % 2 = 0 THEN p_size * 4 END AS result_height").filter("asset_id % 5 <> 0")), """
    WITH a AS (SELECT asset_id, name, width, height FROM assets WHERE asset_id % 3 <> 0),
    s AS (SELECT p_partkey AS asset_id, p_brand AS label, CASE WHEN p_partkey % 2 = 0 THEN p_size*3 ELSE p_size END AS w, CASE WHEN p_partkey % 2 = 0 THEN p_size*4 ELSE p_size+1 END AS h FROM part WHERE p_partkey % 5 <> 0)
    SELECT coalesce(a.asset_id, s.asset_id) AS asset_id, coalesce(name, label) AS name, coalesce(w, width) AS width, coalesce(h, height) AS height FROM a FULL JOIN s ON a.asset_id = s.asset_id""")


def cascaded(v):
    out = c.cascade_delete(v.assets(), v.projects(), v.folders(), v.links(), v.projects().filter("name LIKE 'A%'").select("project_id"),
                           v.assets().filter("kind = 3").select("asset_id"))
    parts = [out[n].groupBy(F.lit(n).alias("table_name")).agg(F.count(F.lit(1)).alias("n")) for n in sorted(out)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


add("cascade_delete", cascaded, """
    WITH gp AS (SELECT project_id FROM projects WHERE name LIKE 'A%'), ga AS (SELECT asset_id FROM assets WHERE kind = 3)
    SELECT 'assets' AS table_name, count(*) AS n FROM assets WHERE asset_id NOT IN (SELECT asset_id FROM ga)
    UNION ALL SELECT 'folders', count(*) FROM folders WHERE project_id NOT IN (SELECT project_id FROM gp)
    UNION ALL SELECT 'links', count(*) FROM links WHERE project_id NOT IN (SELECT project_id FROM gp) AND asset_id NOT IN (SELECT asset_id FROM ga)
    UNION ALL SELECT 'projects', count(*) FROM projects WHERE project_id NOT IN (SELECT project_id FROM gp)""")
add("path_conflicts", lambda v: c.path_conflicts(
    varied_paths(v).selectExpr("page_id AS asset_id", "CASE WHEN page_id % 10 = 5 THEN concat(path, ' x') ELSE path END AS path"),
    varied_paths(v).filter("page_id % 3 = 0").selectExpr("page_id + page_id % 2 AS asset_id", "path"),
    varied_paths(v).filter("page_id % 5 = 0").selectExpr("page_id + page_id % 2 AS asset_id", "path")), f"""
    WITH {VARIED}, c AS (SELECT page_id AS asset_id, CASE WHEN page_id % 10 = 5 THEN concat(path, ' x') ELSE path END AS path FROM vp),
    b AS (SELECT page_id + page_id % 2 AS asset_id, lower(path) AS k FROM vp WHERE page_id % 3 = 0), p AS (SELECT page_id + page_id % 2 AS asset_id, lower(path) AS k FROM vp WHERE page_id % 5 = 0)
    SELECT asset_id, path, CASE WHEN regexp_matches(path, '\\s') THEN 'whitespace' WHEN NOT {valid_sql('path')} THEN 'invalid_path'
      WHEN EXISTS (SELECT 1 FROM b WHERE k = lower(path) AND b.asset_id <> c.asset_id) THEN 'bound' WHEN EXISTS (SELECT 1 FROM p WHERE k = lower(path) AND p.asset_id <> c.asset_id) THEN 'pending_create' END AS reason FROM c""")


def jobs(v):
    return v.jobs().selectExpr("job_id", "asset_id", "operation", "asset_id % 5 AS project_id", "CASE WHEN job_id % 3 = 0 THEN 'done' END AS response")


JOBS = "jb AS (SELECT job_id, asset_id, operation, asset_id % 5 AS project_id, CASE WHEN job_id % 3 = 0 THEN 'done' END AS response FROM jobs)"
add("job_backlog", lambda v: c.job_backlog(jobs(v)),
    f"WITH {JOBS} SELECT project_id, operation, count(*) FILTER (response IS NULL AND operation <> 'read') AS pending FROM jb GROUP BY 1, 2")
add("next_reads", lambda v: c.next_reads(
    jobs(v).filter("project_id <> 3 OR operation <> 'read'").filter("asset_id > 40"), v.assets().selectExpr(
        "asset_id % 5 AS project_id", "asset_id", "asset_id * 7 % 101 AS position", "kind <> 1 AS eligible"), 400), f"""
    WITH {JOBS}, j AS (SELECT * FROM jb WHERE (project_id <> 3 OR operation <> 'read') AND asset_id > 40),
    b AS (SELECT project_id, count(*) AS n FROM j WHERE response IS NULL AND operation = 'read' GROUP BY 1),
    v AS (SELECT asset_id % 5 AS project_id, asset_id, kind <> 1 AS eligible, ROW_NUMBER() OVER (PARTITION BY asset_id % 5 ORDER BY asset_id*7 % 101, asset_id) AS k FROM assets)
    SELECT project_id, arg_min(asset_id, k) AS asset_id FROM v LEFT JOIN b USING (project_id) WHERE k <= 8 AND eligible AND coalesce(n, 0) < 400
      AND NOT EXISTS (SELECT 1 FROM j WHERE j.project_id = v.project_id AND j.asset_id = v.asset_id) GROUP BY project_id""")

QUERIES, SQL = area.queries, area.sql
