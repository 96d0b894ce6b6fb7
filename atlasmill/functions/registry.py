"""Colour functions as SQL functions.

``register_functions`` creates temporary SQL functions whose bodies are plain
expressions: a query that calls them is planned as if it had been written out.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from atlasmill.functions import color as c

_RGB = "r INT, g INT, b INT"
_PAIR = "r1 INT, g1 INT, b1 INT, a1 INT, r2 INT, g2 INT, b2 INT, a2 INT"
_P, _Q = ("r1", "g1", "b1", "a1"), ("r2", "g2", "b2", "a2")
_LAB = "STRUCT<l DOUBLE, a DOUBLE, b DOUBLE>"


def _lab(parts) -> str:
    return f"named_struct('l', {parts[0]}, 'a', {parts[1]}, 'b', {parts[2]})"


def _rgba(build) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in build) + ")"


_RGBA = "STRUCT<r INT, g INT, b INT, a INT>"


def definitions() -> dict[str, tuple[str, str, str]]:
    """Name to (parameters, return type, body)."""
    lab_pair = "l1 DOUBLE, a1 DOUBLE, b1 DOUBLE, l2 DOUBLE, a2 DOUBLE, b2 DOUBLE"
    lab_points = (("l1", "a1", "b1"), ("l2", "a2", "b2"))
    over = [(v, c.over_channel(f"{v}1", "a1", f"{v}2", "a2")) for v in "rgb"]
    blend = [(v, c.finalist_channel(f"{v}1", "a1", f"{v}2", "a2")) for v in "rgb"]
    return {
        "pack_rgb": (_RGB, "INT", c.pack_rgb()),
        "pack_argb": ("a INT, r INT, g INT, b INT", "BIGINT", c.pack_argb()),
        "canonical_argb": ("a INT, r INT, g INT, b INT", "BIGINT", c.canonical_argb()),
        "unpack_rgb": ("rgb INT", "STRUCT<r INT, g INT, b INT>",
                       _rgba(zip("rgb", c.unpack_rgb("rgb")))),
        "srgb_to_linear": ("v DOUBLE", "DOUBLE", c.srgb_to_linear("v")),
        "linear_to_srgb": ("v DOUBLE", "DOUBLE", c.linear_to_srgb("v")),
        "rgb_to_lab": (_RGB, _LAB, _lab(c.rgb_to_lab())),
        "rgb_to_oklab": (_RGB, _LAB, _lab(c.rgb_to_oklab())),
        "lab_distance": (lab_pair, "DOUBLE", c.distance(*lab_points)),
        "lab_distance_sq": (lab_pair, "DOUBLE", c.distance_sq(*lab_points)),
        "luminance601": (_RGB, "DOUBLE", c.luminance601()),
        "brightness": (_RGB, "DOUBLE", c.brightness()),
        "saturation_weight": (_RGB, "DOUBLE", c.saturation_weight()),
        "contrast_weight": (_RGB, "DOUBLE", c.contrast_weight()),
        "relief_height": (_RGB, "DOUBLE", c.relief_height()),
        "round_to_step": ("v INT, step INT", "INT", c.round_to_step("v", "step")),
        "monochrome": (_RGB, "INT", c.monochrome()),
        "rgb_hex": (_RGB, "STRING", c.rgb_hex()),
        "parse_hex_color": ("text STRING", "INT", c.parse_hex_color("text")),
        "source_over": (_PAIR, _RGBA, _rgba([*over, ("a", c.over_alpha("a1", "a2"))])),
        "bayer4": ("x INT, y INT", "DOUBLE", c.bayer4("x", "y")),
        "seam_distance": (_PAIR, "DOUBLE", c.seam_distance(_P, _Q)),
        "edge_difference": (_PAIR, "DOUBLE", c.edge_difference(_P, _Q)),
        "cut_change": (_PAIR, "DOUBLE", c.cut_change(_P, _Q)),
        "finalist_blend": (_PAIR, _RGBA, _rgba([*blend, ("a", c.finalist_alpha("a1", "a2"))])),
    }


def register_functions(spark: SparkSession) -> list[str]:
    """Create every colour function in the session; returns their names."""
    found = definitions()
    for name, (parameters, returns, body) in found.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    return list(found)
