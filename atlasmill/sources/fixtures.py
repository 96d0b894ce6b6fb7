"""Pixel, catalog and lineage views derived from the driver's parquet tables.

Every view covers its whole input tables.  They are plain DataFrames: filters
and column pruning of the queries built on them reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atlasmill.runtime import bucketed_row_number, configure


class Views:
    """Lazily built views of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # --- rasters -------------------------------------------------------------

    def _vectors(self) -> DataFrame:
        """One row per vector element; ``i`` is the position in its 8x8 tile."""
        return self.table("embeddings").select(
            "vec_id", "label", "embedding", F.posexplode("embedding").alias("i", "v")
        ).withColumn("val", F.col("v").cast("double"))

    _AT = ("CAST(FLOOR(vec_id / 64) AS BIGINT) AS image_id",
           "CAST((vec_id % 8) * 8 + i % 8 AS INT) AS x",
           "CAST(FLOOR((vec_id % 64) / 8) * 8 + FLOOR(i / 8) AS INT) AS y")
    _ALPHA = "CAST(CASE WHEN val < -0.2E0 THEN 0 WHEN val < -0.12E0 THEN 128 ELSE 255 END AS INT) AS a"

    def px(self) -> DataFrame:
        """Posterised atlases: 64x64 images of 8x8 tiles, 16 colours."""
        leveled = self._vectors().withColumn(
            "lv", F.expr("LEAST(3, GREATEST(0, CAST(FLOOR((val + 0.2E0) * 10) AS INT)))"))
        return leveled.selectExpr(*self._AT, "CAST(85 * lv AS INT) AS r",
                                  "CAST(85 * ((lv + label) % 4) AS INT) AS g",
                                  "CAST(255 - 85 * lv AS INT) AS b", self._ALPHA)

    def px8(self) -> DataFrame:
        """Same coordinates and alpha with 8-bit channels (about one colour per pixel)."""
        def byte(position: str) -> str:
            value = f"CAST(embedding[{position}] AS DOUBLE)"
            return f"LEAST(255, GREATEST(0, CAST(FLOOR(({value} + 0.5E0) * 256) AS INT)))"
        return self._vectors().selectExpr(
            *self._AT, f"{byte('i')} AS r", f"{byte('63 - i')} AS g",
            f"{byte('(i * 7 + 3) % 64')} AS b", self._ALPHA)

    def pxd(self, base: DataFrame | None = None) -> DataFrame:
        """``px`` with a deterministic share of pixels blackened."""
        from atlasmill.operators.quality import distort_corpus
        return distort_corpus(base if base is not None else self.px(), "contamination", 97)

    def pxl(self) -> DataFrame:
        """One 24-wide raster per supplier with a ragged last row; grows with the scale factor."""
        line = self.table("lineitem").select(
            "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
            "l_quantity", "l_discount", "l_tax")
        ranked = bucketed_row_number(
            line, ["l_suppkey"], F.floor(F.col("l_orderkey") / 65536),
            ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity",
             "l_discount", "l_tax"], "rn")
        return ranked.selectExpr(
            "l_suppkey AS image_id", "CAST((rn - 1) % 24 AS INT) AS x",
            "CAST(FLOOR((rn - 1) / 24) AS INT) AS y", "CAST(l_quantity * 5 AS INT) AS r",
            "CAST(ROUND(l_discount * 100) * 25 AS INT) AS g",
            "CAST(ROUND(l_tax * 100) * 28 AS INT) AS b",
            "CAST(CASE WHEN l_quantity <= 3 THEN 0 WHEN l_quantity <= 6 THEN 128 ELSE 255 END AS INT) AS a")

    def tall(self) -> DataFrame:
        """One image of all rows of ``lineitem``, 24 wide."""
        ranked = bucketed_row_number(
            self.table("lineitem").withColumn("image_id", F.lit(0).cast("long")), ["image_id"], F.floor(F.col("l_orderkey") / 4096),
            ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"], "rn")
        return ranked.selectExpr(
            "image_id", "CAST((rn - 1) % 24 AS INT) AS x", "CAST(FLOOR((rn - 1) / 24) AS INT) AS y", "CAST(l_quantity * 5 AS INT) AS r",
            "CAST(ROUND(l_discount * 100) * 25 AS INT) AS g", "CAST(ROUND(l_tax * 100) * 28 AS INT) AS b",
            "CAST(CASE WHEN l_quantity <= 3 THEN 0 WHEN l_quantity <= 6 THEN 128 ELSE 255 END AS INT) AS a")

    def tiles(self) -> DataFrame:
        return self.px().selectExpr(
            "image_id * 64 + CAST(FLOOR(y / 8) AS BIGINT) * 8 + CAST(FLOOR(x / 8) AS BIGINT) AS tile_id",
            "x % 8 AS tx", "y % 8 AS ty", "r", "g", "b", "a")

    # --- catalog ---------------------------------------------------------------

    def assets(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey AS asset_id", "p_name AS name", "array(p_brand, p_type) AS tags",
            "CAST(p_partkey % 4 AS INT) AS kind", "p_size AS width", "CAST(p_size * 2 AS INT) AS height",
            "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey % 2 = 0 END AS transparent",
            "p_retailprice AS opened_at")

    def projects(self) -> DataFrame:
        return self.table("region").selectExpr("r_regionkey AS project_id", "r_name AS name")

    def folders(self) -> DataFrame:
        return self.table("nation").selectExpr(
            "n_nationkey AS folder_id", "n_regionkey AS project_id",
            "CASE WHEN n_nationkey < 5 THEN NULL ELSE n_nationkey - 5 END AS parent_id", "n_name AS name")

    def links(self) -> DataFrame:
        """Parts placed where their suppliers are; every fifth part's places belong to the part before, so it has none."""
        line = self.table("lineitem").withColumn("asset_id", F.expr("CASE WHEN l_partkey % 5 = 0 THEN l_partkey - 1 ELSE l_partkey END"))
        places = self.table("supplier").join(
            self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        return (line.join(places, F.col("l_suppkey") == F.col("s_suppkey"))
                .groupBy(F.col("n_regionkey").alias("project_id"), "asset_id")
                .agg(F.min("n_nationkey").alias("folder_id")))

    def paths(self) -> DataFrame:
        bare = self.table("pages").selectExpr(
            "page_id", "regexp_replace(url, '[?#].*$', '') AS clean")
        return bare.selectExpr(
            "page_id",
            "CONCAT('/Game/', REPLACE(regexp_replace(clean, '^https?://', ''), '.', '_'), '.', "
            "regexp_extract(clean, '([^/]+)$', 1)) AS path")

    _OBJECT = "CONCAT('/Game/P', project_id, '/F', folder_id, '/T', asset_id{})"

    def sync(self) -> DataFrame:
        """Local and remote listing of all linked assets; each side lacks some and some moved."""
        base = self.links()
        local = base.filter("asset_id % 3 <> 0").selectExpr(
            "'local' AS side", self._OBJECT.format("") + " AS path", "asset_id AS revision")
        moved = ", CASE WHEN asset_id % 4 = 1 THEN '_moved' ELSE '' END"
        remote = base.filter("asset_id % 5 <> 2").selectExpr(
            "'remote' AS side", self._OBJECT.format(moved) + " AS path", "asset_id + asset_id % 2 AS revision")
        return local.unionByName(remote)

    def redirects(self) -> DataFrame:
        return self.links().filter("asset_id % 4 = 1").selectExpr(
            self._OBJECT.format("") + " AS path", self._OBJECT.format(", '_moved'") + " AS target")

    def transfers(self) -> DataFrame:
        """All documents; those without labels were announced and not received."""
        return self.table("documents").join(self.table("labels"), "doc_id", "left").selectExpr(
            "doc_id", "text AS payload", "COALESCE(quality, 1) AS announced", "COALESCE(toxic, 0) AS received")

    def snaps(self) -> DataFrame:
        return self.table("conversations").selectExpr(
            "conv_id AS action_id", "turn AS file_no", "text AS payload")

    def board(self) -> DataFrame:
        """One layer per part; the whole table is one very tall board."""
        return self.table("part").selectExpr(
            "p_partkey + 1 AS layer_index", "p_name AS name", "CAST(p_size AS DOUBLE) AS width",
            "CAST(p_size * 2 AS DOUBLE) AS height", "CAST((p_partkey * 7) % 500 AS DOUBLE) AS x",
            "CAST((p_partkey * 31) % 500 AS DOUBLE) AS y",
            "CAST((p_size * 7) % 360 AS DOUBLE) AS angle", "CAST(1 AS DOUBLE) AS scale")

    # --- lineage ---------------------------------------------------------------

    def gens(self) -> DataFrame:
        """Heap-shaped branching history per customer."""
        ranked = bucketed_row_number(
            self.table("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority"),
            ["o_custkey"], F.floor(F.col("o_orderkey") / 65536), ["o_orderkey"], "rn")
        children = ranked.selectExpr(
            "o_custkey AS source_id", "o_orderkey AS gen_id", "o_orderdate AS created_at",
            "CASE WHEN rn > 1 THEN CAST(FLOOR(rn / 2) AS BIGINT) END AS parent_rn",
            "CASE SUBSTRING(o_orderpriority, 1, 1) WHEN '1' THEN 'image.resize' WHEN '2' THEN 'image.colors' "
            "WHEN '3' THEN 'grid.align' WHEN '4' THEN 'grid.reduce' ELSE 'filter.sharpen' END AS operation_id")
        parents = ranked.selectExpr("o_custkey AS source_id", "rn AS parent_rn", "o_orderkey AS parent_id")
        return children.join(parents, ["source_id", "parent_rn"], "left").select(
            "source_id", "gen_id", "parent_id", "created_at", "operation_id")

    def recipes(self) -> DataFrame:
        """Steps in creation order; the month keeps a busy source in many tasks."""
        ranked = bucketed_row_number(
            self.gens().select("source_id", "gen_id", "created_at", "operation_id"), ["source_id"],
            F.trunc("created_at", "month"), ["created_at", "gen_id"], "step_index")
        return ranked.selectExpr(
            "source_id", "step_index", "operation_id",
            "CASE WHEN operation_id = 'grid.reduce' THEN gen_id % 2 = 0 ELSE FALSE END AS use_previous_alignment")

    def jobs(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id AS job_id", "user_id AS asset_id", "ts",
            "CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'save' WHEN 'signup' THEN 'create' "
            "WHEN 'purchase' THEN 'move' ELSE 'delete' END AS operation",
            "CAST(FLOOR(value) AS BIGINT) AS revision")

    # --- animation -------------------------------------------------------------

    def cels(self) -> DataFrame:
        """One document per order; a document holds at most 65,535 frames."""
        order = Window.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_quantity")
        frames = self.table("lineitem").select(
            "l_orderkey", "l_returnflag", "l_quantity",
            (F.row_number().over(order) - 1).cast("bigint").alias("frame"))
        return frames.selectExpr(
            "l_orderkey AS doc_id", "frame", "0 AS layer", "CAST((frame * 3) % 5 AS INT) - 1 AS x",
            "CAST(frame % 3 AS INT) - 1 AS y",
            "CASE WHEN l_returnflag = 'A' AND frame > 0 THEN frame - 1 END AS linked_frame",
            "CAST(l_quantity * 10 AS INT) AS duration_ms")

    def frames(self) -> DataFrame:
        return self.cels().select("doc_id", "frame", "duration_ms")

    def tags(self) -> DataFrame:
        """The same three frame ranges for every document."""
        ranges = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f).alias("from_frame"),
                                    F.lit(t).alias("to_frame"))
                           for n, f, t in (("idle", 0, 1), ("walk", 1, 3), ("run", 2, 5))])
        return (self.table("lineitem").select(F.col("l_orderkey").alias("doc_id")).distinct()
                .select("doc_id", F.inline(ranges)))
