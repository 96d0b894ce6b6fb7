"""Lab columns computed in stages.

Each stage is its own projection, so Spark plans and compiles every shared
intermediate once instead of repeating it inside one large expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasmill.functions import color as c


def add_lab(df: DataFrame, channels: tuple[str, str, str] = ("r", "g", "b"), prefix: str = "lab_") -> DataFrame:
    """Append CIE Lab of three channel expressions as ``<prefix>l, <prefix>a, <prefix>b``."""
    keep = df.columns
    lin = df.select("*", *[F.expr(e).alias(f"_c{i}") for i, e in enumerate(channels)])
    lin = lin.select(*keep, *[F.expr(c.srgb_to_linear(f"_c{i}")).alias(f"_n{i}") for i in range(3)])
    xyz = lin.select(*keep, *[F.expr(f"{c.weighted(row[:3], ('_n0', '_n1', '_n2'))} / {c.num(row[3])}").alias(f"_t{i}")
                              for i, row in enumerate(c.XYZ_ROWS)])
    bent = xyz.select(*keep, *[F.expr(
        f"CASE WHEN _t{i} > 8.856E-3 THEN pow(_t{i}, 1E0 / 3E0) ELSE 7.787E0 * _t{i} + 16E0 / 116E0 END").alias(f"_f{i}")
        for i in range(3)])
    return bent.select(*keep, F.expr("116E0 * _f1 - 16E0").alias(f"{prefix}l"),
                       F.expr("500E0 * (_f0 - _f1)").alias(f"{prefix}a"), F.expr("200E0 * (_f1 - _f2)").alias(f"{prefix}b"))
