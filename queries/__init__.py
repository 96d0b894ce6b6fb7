"""Registered queries with the SQL text each is compared with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from queries.sqlviews import with_views

AREAS = ("pixels", "colors", "blocks", "grids", "stencils", "regions", "quality", "catalog",
         "lineage", "recipes", "animation", "streams", "storage")


def _areas():
    for area in AREAS:
        try:
            yield importlib.import_module(f"queries.{area}")
        except ModuleNotFoundError as missing:
            if missing.name != f"queries.{area}":
                raise


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for area in _areas() for name, fn in area.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: with_views(text) for area in _areas() for name, text in area.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from atlasmill.operators import pixels
    from atlasmill.sources.fixtures import Views
    px = Views(spark, sf_dir).px()
    top = pixels.top_colors(px, 3).groupBy("image_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "rgb", "n"))).alias("top_colors"))
    return pixels.palette_info(px).join(top, "image_id", "left")
