"""Comparing pixel frames with a reference version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atlasmill.functions import color as c
from atlasmill.operators.bands import along
from atlasmill.operators.pixels import with_sizes
from atlasmill.runtime import require

KEY = ["image_id", "x", "y"]


def distort_corpus(px: DataFrame, kind: str, seed: int, pitch: int = 8) -> DataFrame:
    """Deterministic test damage: ``contamination`` blackens one pixel in ``seed``,
    ``phase`` moves every pixel right and down by part of a cell; what leaves its
    image comes in on the other side."""
    if kind == "contamination":
        hit = f"(x * 7 + y * 13 + image_id * 5) % {seed} = 0"
        return px.select(*KEY, *[F.expr(f"CASE WHEN {hit} THEN 0 ELSE {v} END").alias(v) for v in "rgb"], "a")
    require(kind == "phase", "kind must be contamination or phase")
    return with_sizes(px).selectExpr("image_id", f"pmod(x + {seed % pitch}, width) AS x", f"pmod(y + {seed // pitch % pitch}, height) AS y",
                                     "r", "g", "b", "a")


def compare_pixels(actual: DataFrame, reference: DataFrame) -> DataFrame:
    """Full outer match on coordinates with both canonical colours."""
    def side(px, name):
        return px.select(*KEY, F.expr(c.canonical_argb()).alias(name))
    return side(actual, "got").join(side(reference, "expected"), KEY, "full")


def image_diff_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed pixels, largest Lab change and colour counts of two versions."""
    old = before.select(*KEY, *[F.col(v).alias(f"{v}0") for v in "rgba"])
    both = old.join(after, KEY)
    delta = F.expr(c.distance(c.rgb_to_lab("r0", "g0", "b0"), c.rgb_to_lab()))
    shown = F.col("a0") > 0
    both = both.withColumn("changed", F.expr("r <> r0 OR g <> g0 OR b <> b0 OR a <> a0"))
    both = both.withColumn("delta", F.when(shown & F.col("changed"), delta).otherwise(F.lit(0.0)))
    diff = both.groupBy("image_id").agg(
        F.count_if(F.expr("changed")).alias("changed_pixels"), F.max("delta").alias("max_delta"))
    before_after = both.filter(shown).select(
        "image_id", F.expr("inline(array(struct(0 AS v, r0 * 65536 + g0 * 256 + b0 AS rgb), "
                           "struct(1 AS v, r * 65536 + g * 256 + b AS rgb)))"))
    colors = before_after.distinct().groupBy("image_id").agg(
        F.count_if(F.col("v") == 0).alias("colors_before"), F.count_if(F.col("v") == 1).alias("colors_after"))
    return diff.join(colors, "image_id", "left").select(
        "image_id", "changed_pixels", F.round("max_delta", 6).alias("max_delta"),
        F.coalesce("colors_before", F.lit(0)).alias("colors_before"),
        F.coalesce("colors_after", F.lit(0)).alias("colors_after"))


def grid_quality(actual: DataFrame, reference: DataFrame, cell: int) -> DataFrame:
    """Grid purity, pixel accuracy, macro colour recall, boundary F1 and 100 x their minimum."""
    require(cell >= 2, "cell must be at least 2")
    both = compare_pixels(actual, reference).withColumn("hit", F.expr("CASE WHEN got <=> expected THEN 1 ELSE 0 END"))
    accuracy = both.groupBy("image_id").agg(
        F.avg("hit").alias("pixel_accuracy"), F.count(F.lit(1)).alias("n_pixels"))
    recall = (both.groupBy("image_id", "expected").agg(F.avg("hit").alias("recall"))
              .groupBy("image_id").agg(F.avg("recall").alias("color_recall")))
    pure = (both.groupBy("image_id", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"),
                         "got").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("image_id", "cx", "cy").agg(F.max("n").alias("n"))
            .groupBy("image_id").agg(F.sum("n").alias("pure")))
    steps = both
    for axis in ("x", "y"):
        steps = along(steps, axis, lambda rows, line: rows.withColumn(f"next_{axis}", F.lead(F.struct(axis, "got", "expected")).over(line)))
    changes = F.expr("filter(array("
                     "CASE WHEN next_x.x = x + 1 THEN struct(next_x.expected <> expected AS e, next_x.got <> got AS g) END, "
                     "CASE WHEN next_y.y = y + 1 THEN struct(next_y.expected <> expected AS e, next_y.got <> got AS g) END), "
                     "v -> v IS NOT NULL)")
    edges = steps.select("image_id", F.inline(changes)).groupBy("image_id").agg(
        F.count_if(F.col("e") & F.col("g")).alias("tp"), F.count_if(~F.col("e") & F.col("g")).alias("fp"),
        F.count_if(F.col("e") & ~F.col("g")).alias("fn"))
    scores = (accuracy.join(recall, "image_id").join(pure, "image_id").join(edges, "image_id", "left")
              .withColumn("grid_purity", F.col("pure") / F.col("n_pixels"))
              .withColumn("boundary_f1", F.expr(
                  "CASE WHEN coalesce(tp + fp + fn, 0) = 0 THEN 1E0 ELSE 2E0 * tp / (2 * tp + fp + fn) END")))
    names = ["grid_purity", "pixel_accuracy", "color_recall", "boundary_f1"]
    return scores.select("image_id", *[F.round(v, 6).alias(v) for v in names],
                         F.round(100 * F.least(*names), 4).alias("score"))


def corpus_scores(clean: DataFrame, noisy: DataFrame, processed: DataFrame, clean_processed: DataFrame,
                  motif: str) -> DataFrame:
    """Repair bookkeeping per image, per motif and overall (NULL keys are the totals).

    ``motif`` is an SQL expression over ``image_id``.  Visible pixels of the
    clean frame that differ in the noisy frame are the injected ones.
    """
    def side(px, tag):
        return px.select(*KEY, *[F.col(v).alias(f"{v}_{tag}") for v in "rgba"])

    def color(tag):
        return c.pack_argb(*[f"{v}_{tag}" for v in "argb"])

    def error(tag):
        return c.distance_sq(c.rgb_to_lab("r_c", "g_c", "b_c"), c.rgb_to_lab(*[f"{v}_{tag}" for v in "rgb"]))

    rows = (side(clean, "c").filter("a_c > 0").join(side(noisy, "n"), KEY)
            .join(side(processed, "p"), KEY).join(side(clean_processed, "q"), KEY))
    rows = rows.selectExpr(
        "image_id", f"{motif} AS motif", f"{color('c')} <> {color('n')} AS injected",
        f"{color('p')} <> {color('n')} AS changed", f"{color('p')} = {color('c')} AS exact",
        f"{color('q')} <> {color('c')} AS damage", f"{error('n')} AS e0", f"{error('p')} AS e1")
    scored = rows.rollup("motif", "image_id").agg(
        F.count_if(F.expr("injected")).alias("injected"), F.count_if(F.expr("injected AND changed")).alias("corrected"),
        F.count_if(F.expr("injected AND exact")).alias("recovered"),
        F.count_if(F.expr("injected AND changed AND NOT exact")).alias("wrong_color"),
        F.count_if(F.expr("NOT injected AND changed")).alias("other_changes"), F.count_if(F.expr("damage")).alias("clean_damage"),
        F.round(F.sum("e0"), 1).alias("error_before"), F.round(F.sum("e1"), 1).alias("error_after"),
        F.grouping_id().cast("int").alias("level"))
    return scored
