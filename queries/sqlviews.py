"""The same views as SQL text for the comparison engine.

``view_sql("px", ...)`` prefixes a query with just the CTEs it needs.
"""

from __future__ import annotations

import re

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "emb_long": ((), "SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding) AS val FROM embeddings"),
    "px": (("emb_long",), """
      SELECT CAST(FLOOR(vec_id/64) AS BIGINT) AS image_id,
        CAST((vec_id % 8)*8 + i % 8 AS INT) AS x,
        CAST(FLOOR((vec_id % 64)/8)*8 + FLOOR(i/8) AS INT) AS y,
        CAST(85*lv AS INT) AS r, CAST(85*((lv+label)%4) AS INT) AS g, CAST(255-85*lv AS INT) AS b,
        CAST(CASE WHEN val < -0.2 THEN 0 WHEN val < -0.12 THEN 128 ELSE 255 END AS INT) AS a
      FROM (SELECT vec_id, label, i, CAST(val AS DOUBLE) AS val,
              LEAST(3, GREATEST(0, CAST(FLOOR((CAST(val AS DOUBLE)+0.2)*10) AS INT))) AS lv FROM emb_long) t"""),
    "px8": (("px", "emb_long"), """
      SELECT p.image_id, p.x, p.y,
        LEAST(255,GREATEST(0,CAST(FLOOR((CAST(a.val AS DOUBLE)+0.5)*256) AS INT))) AS r,
        LEAST(255,GREATEST(0,CAST(FLOOR((CAST(b.val AS DOUBLE)+0.5)*256) AS INT))) AS g,
        LEAST(255,GREATEST(0,CAST(FLOOR((CAST(c.val AS DOUBLE)+0.5)*256) AS INT))) AS b, p.a
      FROM px p
      JOIN emb_long a ON a.vec_id = p.image_id*64 + CAST(FLOOR(p.y/8) AS INT)*8 + CAST(FLOOR(p.x/8) AS INT)
        AND a.i = (p.y%8)*8 + p.x%8
      JOIN emb_long b ON b.vec_id = a.vec_id AND b.i = 63 - a.i
      JOIN emb_long c ON c.vec_id = a.vec_id AND c.i = (a.i*7+3) % 64"""),
    "pxd": (("px",), """
      SELECT image_id, x, y,
        CASE WHEN (x*7+y*13+image_id*5) % 97 = 0 THEN 0 ELSE r END AS r,
        CASE WHEN (x*7+y*13+image_id*5) % 97 = 0 THEN 0 ELSE g END AS g,
        CASE WHEN (x*7+y*13+image_id*5) % 97 = 0 THEN 0 ELSE b END AS b, a FROM px"""),
    "pxl": ((), """
      SELECT image_id, CAST(rn % 24 AS INT) AS x, CAST(FLOOR(rn/24) AS INT) AS y,
        CAST(l_quantity*5 AS INT) AS r, CAST(ROUND(l_discount*100)*25 AS INT) AS g, CAST(ROUND(l_tax*100)*28 AS INT) AS b,
        CAST(CASE WHEN l_quantity<=3 THEN 0 WHEN l_quantity<=6 THEN 128 ELSE 255 END AS INT) AS a
      FROM (SELECT l_suppkey AS image_id, l_quantity, l_discount, l_tax,
        ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey,l_linenumber,l_partkey,l_extendedprice,l_quantity,l_discount,l_tax) - 1 AS rn
        FROM lineitem) t"""),
    "tall": ((), """
      SELECT CAST(0 AS BIGINT) AS image_id, CAST(rn % 24 AS INT) AS x, CAST(FLOOR(rn/24) AS INT) AS y,
        CAST(l_quantity*5 AS INT) AS r, CAST(ROUND(l_discount*100)*25 AS INT) AS g, CAST(ROUND(l_tax*100)*28 AS INT) AS b,
        CAST(CASE WHEN l_quantity<=3 THEN 0 WHEN l_quantity<=6 THEN 128 ELSE 255 END AS INT) AS a
      FROM (SELECT l_quantity, l_discount, l_tax,
        ROW_NUMBER() OVER (ORDER BY l_orderkey,l_linenumber,l_partkey,l_extendedprice,l_quantity,l_discount,l_tax) - 1 AS rn
        FROM lineitem) t"""),
    "tiles": (("px",), """
      SELECT image_id*64 + CAST(FLOOR(y/8) AS BIGINT)*8 + CAST(FLOOR(x/8) AS BIGINT) AS tile_id,
        x % 8 AS tx, y % 8 AS ty, r, g, b, a FROM px"""),
    "assets": ((), """
      SELECT p_partkey AS asset_id, p_name AS name, [p_brand, p_type] AS tags,
        CAST(p_partkey % 4 AS INT) AS kind, p_size AS width, CAST(p_size*2 AS INT) AS height,
        CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey % 2 = 0 END AS transparent,
        p_retailprice AS opened_at FROM part"""),
    "projects": ((), "SELECT r_regionkey AS project_id, r_name AS name FROM region"),
    "folders": ((), """
      SELECT n_nationkey AS folder_id, n_regionkey AS project_id,
        CASE WHEN n_nationkey < 5 THEN NULL ELSE n_nationkey - 5 END AS parent_id, n_name AS name FROM nation"""),
    "links": ((), """
      SELECT n_regionkey AS project_id, CASE WHEN l_partkey % 5 = 0 THEN l_partkey - 1 ELSE l_partkey END AS asset_id, MIN(n_nationkey) AS folder_id
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2"""),
    "paths": ((), """
      SELECT page_id, CONCAT('/Game/', REPLACE(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '.', '_'), '.',
        regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)$', 1)) AS path FROM pages"""),
    "sync": (("links",), """
      SELECT side, path, revision FROM (
        SELECT 'local' AS side, CONCAT('/Game/P', project_id, '/F', folder_id, '/T', asset_id) AS path, asset_id AS revision
        FROM links WHERE asset_id % 3 <> 0
        UNION ALL
        SELECT 'remote', CONCAT('/Game/P', project_id, '/F', folder_id, '/T', asset_id, CASE WHEN asset_id % 4 = 1 THEN '_moved' ELSE '' END),
          asset_id + asset_id % 2 FROM links WHERE asset_id % 5 <> 2) u"""),
    "redirects": (("links",), """
      SELECT CONCAT('/Game/P', project_id, '/F', folder_id, '/T', asset_id) AS path,
        CONCAT('/Game/P', project_id, '/F', folder_id, '/T', asset_id, '_moved') AS target
      FROM links WHERE asset_id % 4 = 1"""),
    "transfers": ((), """
      SELECT d.doc_id, d.text AS payload, COALESCE(l.quality, 1) AS announced, COALESCE(l.toxic, 0) AS received
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "snaps": ((), "SELECT conv_id AS action_id, turn AS file_no, text AS payload FROM conversations"),
    "board": ((), """
      SELECT p_partkey + 1 AS layer_index, p_name AS name, CAST(p_size AS DOUBLE) AS width,
        CAST(p_size*2 AS DOUBLE) AS height, CAST((p_partkey*7) % 500 AS DOUBLE) AS x,
        CAST((p_partkey*31) % 500 AS DOUBLE) AS y, CAST((p_size*7) % 360 AS DOUBLE) AS angle,
        CAST(1 AS DOUBLE) AS scale FROM part"""),
    "gens_n": ((), """
      SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority,
        ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders"""),
    "gens": (("gens_n",), """
      SELECT c.o_custkey AS source_id, c.o_orderkey AS gen_id, p.o_orderkey AS parent_id, c.o_orderdate AS created_at,
        CASE SUBSTRING(c.o_orderpriority,1,1) WHEN '1' THEN 'image.resize' WHEN '2' THEN 'image.colors'
          WHEN '3' THEN 'grid.align' WHEN '4' THEN 'grid.reduce' ELSE 'filter.sharpen' END AS operation_id
      FROM gens_n c LEFT JOIN gens_n p ON p.o_custkey = c.o_custkey AND p.rn = CAST(FLOOR(c.rn/2) AS BIGINT) AND c.rn > 1"""),
    "recipes": (("gens",), """
      SELECT source_id, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY created_at, gen_id) AS step_index, operation_id,
        CASE WHEN operation_id='grid.reduce' THEN gen_id % 2 = 0 ELSE FALSE END AS use_previous_alignment FROM gens"""),
    "jobs": ((), """
      SELECT event_id AS job_id, user_id AS asset_id, ts,
        CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'save' WHEN 'signup' THEN 'create'
          WHEN 'purchase' THEN 'move' ELSE 'delete' END AS operation,
        CAST(FLOOR(value) AS BIGINT) AS revision FROM events"""),
    "cels": ((), """
      SELECT doc_id, frame, 0 AS layer, CAST((frame*3) % 5 AS INT) - 1 AS x, CAST(frame % 3 AS INT) - 1 AS y,
        CASE WHEN l_returnflag = 'A' AND frame > 0 THEN frame - 1 END AS linked_frame,
        CAST(l_quantity*10 AS INT) AS duration_ms
      FROM (SELECT l_orderkey AS doc_id, l_returnflag, l_quantity,
        ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_returnflag,l_quantity) - 1 AS frame
        FROM lineitem) t"""),
    "frames": (("cels",), "SELECT doc_id, frame, duration_ms FROM cels"),
    "tags": ((), """
      SELECT d.doc_id, t.name, t.f AS from_frame, t.t AS to_frame FROM (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem) d
      CROSS JOIN (SELECT 'idle' AS name, 0 AS f, 1 AS t UNION ALL SELECT 'walk', 1, 3 UNION ALL SELECT 'run', 2, 5) t"""),
}


def with_views(body: str, recursive: bool = False) -> str:
    """Prefix ``body`` with the CTEs of every view it mentions.

    ``body`` may start with its own ``WITH``; its CTEs follow the views.
    """
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed:
            return
        for parent in VIEWS[name][0]:
            visit(parent)
        needed.append(name)

    words = set(re.findall(r"\b[a-z_0-9]+\b", body))
    for name in VIEWS:
        if name in words and re.search(rf"\b(FROM|JOIN)\s+{name}\b", body):
            visit(name)
    ctes = [f"{name} AS {'MATERIALIZED ' if name.startswith('px') else ''}({VIEWS[name][1]})" for name in needed]
    body = body.strip()
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if own:
        recursive = recursive or bool(own.group(1))
        body = body[own.end():]
        joined = ",\n".join([*ctes, body])
        return f"WITH {'RECURSIVE ' if recursive else ''}{joined}"
    if not ctes:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)}\n{body}"
