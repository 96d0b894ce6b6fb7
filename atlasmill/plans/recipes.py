"""Processing recipes: parsing, validation and replay over a whole corpus.

A recipe is a list of steps.  Validating works on tables of recipes; applying
composes one lazy DataFrame plan, so Catalyst fuses neighbouring steps.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasmill.functions.palettes import FIXED
from atlasmill.operators import blocks, grid, palette, pixels, regions, stencil
from atlasmill.runtime import attach_per_image, bucketed_running_sum, cut_lineage, require

STEP_SCHEMA = """operationId STRING, cellSize INT, usePreviousAlignment BOOLEAN,
 downscale STRUCT<targetWidth: INT, targetHeight: INT, spriteMode: BOOLEAN, alphaThreshold: INT, palette: STRING, paletteStep: INT,
   quantizationColors: INT, quantization: STRING, useColorWeights: BOOLEAN, independentColorMode: STRING, localColorPasses: INT,
   colorTolerance: DOUBLE, strength: DOUBLE, cropHorizontal: STRING, cropVertical: STRING, blockMode: STRING, manualCriteria: STRUCT<
   targetBrightness: DOUBLE, targetContrast: DOUBLE, targetSaturation: DOUBLE, targetEdge: DOUBLE,
   brightnessImportance: DOUBLE, contrastImportance: DOUBLE, saturationImportance: DOUBLE, edgeImportance: DOUBLE>>,
 resizeFactor STRUCT<factor: DOUBLE, spriteMode: BOOLEAN, alphaThreshold: INT, cropHorizontal: STRING, cropVertical: STRING, blockMode: STRING, manualCriteria: STRUCT<
   targetBrightness: DOUBLE, targetContrast: DOUBLE, targetSaturation: DOUBLE, targetEdge: DOUBLE,
   brightnessImportance: DOUBLE, contrastImportance: DOUBLE, saturationImportance: DOUBLE, edgeImportance: DOUBLE>>,
 ascii STRUCT<characters: STRING, columns: INT, rows: INT, invert: BOOLEAN, dither: BOOLEAN>,
 sharpen STRUCT<strength: INT, threshold: INT>, colorReplacement STRUCT<source: INT, target: INT>,
 channelAdjustment STRUCT<channel: STRING, mode: STRING, amount: DOUBLE, subtract: BOOLEAN>,
 background STRUCT<mode: STRING, tolerance: DOUBLE, color: INT>,
 contours STRUCT<windowSize: INT, similarColorDistance: DOUBLE>,
 connectedPalette STRUCT<targetColors: INT, tileSize: INT, connectivityWeight: DOUBLE, localWeight: DOUBLE, detailWeight: DOUBLE, contextWeight: DOUBLE>,
 finalistMode STRING, finalistFactor INT"""
RECIPE_SCHEMA = f"version INT, id STRING, name STRING, steps ARRAY<STRUCT<{STEP_SCHEMA.replace(chr(10), ' ')}>>"
for _word in ("operationId", "cellSize", "usePreviousAlignment", "downscale", "resizeFactor", "ascii", "sharpen", "colorReplacement",
              "channelAdjustment", "background", "contours", "connectedPalette", "finalistMode", "finalistFactor"):
    RECIPE_SCHEMA = RECIPE_SCHEMA.replace(f" {_word} ", f" {_word}: ").replace(f"<{_word} ", f"<{_word}: ")

BLOCKS = ("cellSize", "usePreviousAlignment", "downscale", "resizeFactor", "ascii", "sharpen", "colorReplacement",
          "channelAdjustment", "background", "contours", "connectedPalette", "finalistMode", "finalistFactor")


@dataclass
class Operation:
    """A recipe step: how to run it, which option blocks it takes and its rules.

    ``rules`` are SQL predicates over the step that must not be false.
    ``run`` gets the pixels, the step options and the running state.
    """
    run: Callable[[DataFrame, dict, "State"], DataFrame] | None
    allowed: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    rules: dict[str, str] = field(default_factory=dict)
    one_pass: bool = False  # reads its input once, so it can stay fused with the step before


@dataclass
class State:
    """What later steps may need: the aligned cell size per image; and ``(image_id, reason)`` of images the last step left out."""
    cells: DataFrame | None = None
    lost: list[DataFrame] = field(default_factory=list)

    def lose(self, images: DataFrame, reason: str) -> None:
        self.lost.append(images.select("image_id", F.lit(reason).alias("reason")))


def _between(name: str, low, high) -> str:
    return f"{name} IS NULL OR {name} BETWEEN {low} AND {high}"


def _block_rules(block: str) -> dict[str, str]:
    """Rules for where whole blocks are cropped and how a block's colour is chosen."""
    criteria = [f"coalesce({block}.manualCriteria.{n}, 0.5) BETWEEN 0 AND 1" for group in _MANUAL.values() for n in group]
    return {f"unknown crop alignment in {block}": f"coalesce(lower({block}.cropHorizontal), 'center') IN ('center', 'left', 'right') "
                                                  f"AND coalesce(lower({block}.cropVertical), 'center') IN ('center', 'top', 'bottom')",
            f"unknown block mode in {block}": f"coalesce(lower({block}.blockMode), 'automatic') IN ('automatic', 'manual')",
            f"manual criteria in {block} must be 0..1": " AND ".join(criteria)}


# Option names and defaults of manual block criteria.
_MANUAL = {"targets": ("targetBrightness", "targetContrast", "targetSaturation", "targetEdge"),
           "importance": ("brightnessImportance", "contrastImportance", "saturationImportance", "edgeImportance")}
_MANUAL_DEFAULTS = {"targets": 0.5, "importance": 1.0}


def _block_options(o: dict) -> dict:
    """Crop alignment and, in manual mode, the wanted features and how much each counts."""
    wanted = None
    if (o.get("blockMode") or "automatic").lower() == "manual":
        given = o.get("manualCriteria") or {}
        wanted = tuple({c: given[n] if given.get(n) is not None else _MANUAL_DEFAULTS[group] for c, n in zip(blocks.CRITERIA, _MANUAL[group])}
                       for group in ("targets", "importance"))
    return {"horizontal": (o.get("cropHorizontal") or "center").lower(), "vertical": (o.get("cropVertical") or "center").lower(), "manual": wanted}


_PALETTES = ", ".join(f"'{n}'" for n in (*FIXED, "none", "step"))
_DOWNSCALE = {
    "target dimensions must be positive": "downscale IS NULL OR (coalesce(downscale.targetWidth, 1) >= 1 AND coalesce(downscale.targetHeight, 1) >= 1)",
    "alpha threshold must be 1..100": _between("downscale.alphaThreshold", 1, 100),
    "palette step must be 1..255": _between("downscale.paletteStep", 1, 255),
    "quantisation colours must be 1..4096": _between("downscale.quantizationColors", 1, 4096),
    "clean-up passes must be positive": "downscale.localColorPasses IS NULL OR downscale.localColorPasses >= 1",
    "unknown palette": f"downscale.palette IS NULL OR lower(downscale.palette) IN ({_PALETTES})",
    "unknown quantisation": "downscale.quantization IS NULL OR downscale.quantization IN ('kmeans_lab', 'kmeans_linear', 'median_cut')",
    "clean-up tolerance must be 0..40": _between("downscale.colorTolerance", 0, 40),
    "clean-up strength must be 0..1": _between("downscale.strength", 0, 1),
    "unknown colour mode": "downscale.independentColorMode IS NULL OR lower(downscale.independentColorMode) IN ('combined', 'quantization', 'palette')",
}
_SIZE = {"target dimensions are required": "downscale IS NULL OR (downscale.targetWidth IS NOT NULL AND downscale.targetHeight IS NOT NULL)"}
_CONNECTED = {"connected palette parameters are invalid":
              "connectedPalette IS NULL OR (connectedPalette.targetColors BETWEEN 1 AND 4096 AND (coalesce(connectedPalette.tileSize, 16) = 0 "
              "OR coalesce(connectedPalette.tileSize, 16) BETWEEN 4 AND 256) AND "
              + " AND ".join(f"coalesce(connectedPalette.{w}, 0.5) BETWEEN 0 AND 1" for w in
                             ("connectivityWeight", "localWeight", "detailWeight", "contextWeight")) + ")"}
_CELL = {"cell size must be 2..65535": _between("cellSize", 2, 65535)}


def _palette_of(o: dict) -> dict:
    name = (o.get("palette") or "none").lower()
    return {"palette": FIXED.get(name), "step": o.get("paletteStep", 16) if name == "step" else None}


def _colors_of(o: dict) -> dict:
    return {"colors": o.get("quantizationColors"), "method": o.get("quantization", "kmeans_lab"), "weighted": bool(o.get("useColorWeights"))}


def _profile(px, s, state):
    o = s["downscale"]
    state.lose(pixels.crop_rejects(px, o["targetWidth"], o["targetHeight"]), "smaller than the target")
    return blocks.profile_downscale(px, o["targetWidth"], o["targetHeight"], **_palette_of(o), **_colors_of(o), **_block_options(o))[0]


def _resize(px, s, state):
    o = s["downscale"] if "downscale" in s else s["resizeFactor"]
    sizes = pixels.image_sizes(px)
    if "downscale" in s:
        targets = sizes.selectExpr("*", f"{int(o['targetWidth'])} AS target_width", f"{int(o['targetHeight'])} AS target_height")
    else:
        targets = blocks.resolve_resize(sizes, o["factor"])
    return blocks.resize(px, targets, bool(o.get("spriteMode")), o.get("alphaThreshold") or 50, **_block_options(o))


def _colors(px, s, state):
    if "connectedPalette" in s:
        return _connected(px, s, state)
    o = s["downscale"]
    return palette.apply_colors(px, (o.get("independentColorMode") or "combined").lower(), **_palette_of(o),
                                k=o.get("quantizationColors", 16), method=o.get("quantization", "kmeans_lab"),
                                weighted=bool(o.get("useColorWeights")))


def _connected(px, s, state):
    o = s["connectedPalette"]
    names = {"connectivityWeight": "connectivity_weight", "localWeight": "local_weight", "detailWeight": "detail_weight",
             "contextWeight": "context_weight"}
    return regions.connected_palette(px, o["targetColors"], o.get("tileSize", 16), **{names[k]: o[k] for k in names if k in o})


def _cleanup(px, s, state):
    o = s["downscale"]
    for i in range(o.get("localColorPasses", 1)):
        px = stencil.apply_consensus(cut_lineage(px) if i else px, o.get("colorTolerance", 12.0), o.get("strength", 0.5))
    return px


def _align(px, s, state):
    out, cells = grid.align_to_grid(px, s.get("cellSize"))
    state.cells = cut_lineage(cells)  # read by the reductions and their rejects
    return out


def _reduce(px, s, state):
    pitch = s.get("cellSize")
    if s.get("usePreviousAlignment"):
        require(state.cells is not None, "usePreviousAlignment needs an earlier alignment")
        state.lose(px.select("image_id").distinct().join(state.cells, "image_id", "left_anti"), "no grid was detected")
        px, pitch = attach_per_image(px, state.cells), "pitch"
    state.lose(blocks.grid_mixed(px, pitch), "mixed cells")
    return blocks.grid_reduce(px, pitch)


def _background(px, s, state):
    o = s["background"]
    run = regions.remove_background_edges if (o.get("mode") or "global").lower() == "edges" else pixels.remove_background_global
    return run(px, o.get("tolerance", 0.0), o.get("color"))


def _channel(px, s, state):
    o = s["channelAdjustment"]
    return pixels.adjust_channel(px, o["channel"].lower(), o["mode"].lower(), o["amount"], bool(o.get("subtract")))


def _ascii(px, s, state):
    o = s["ascii"]
    return blocks.ascii_text(px, o.get("columns") or None, o.get("rows"), o["characters"], bool(o.get("invert")), bool(o.get("dither")))


OPERATIONS: dict[str, Operation] = {
    "image.profile": Operation(_profile, ("downscale",), ("downscale",), {**_SIZE, **_DOWNSCALE, **_block_rules("downscale")}),
    "image.resize": Operation(_resize, ("downscale", "resizeFactor"), (), {
        "resize takes either dimensions or a factor": "(downscale IS NULL) <> (resizeFactor IS NULL)",
        "resize factor must be positive": "resizeFactor IS NULL OR resizeFactor.factor > 0",
        "resize alpha threshold must be 1..100": _between("resizeFactor.alphaThreshold", 1, 100), **_SIZE, **_DOWNSCALE,
        **_block_rules("downscale"), **_block_rules("resizeFactor")}),
    "image.trim": Operation(lambda px, s, state: pixels.trim_transparent(px)),
    "image.colors": Operation(_colors, ("downscale", "connectedPalette"), ("downscale",), {**_DOWNSCALE, **_CONNECTED}),
    "image.cleanup": Operation(_cleanup, ("downscale",), ("downscale",), _DOWNSCALE),
    "grid.align": Operation(_align, ("cellSize",), (), _CELL),
    "grid.align.local": Operation(None, ("cellSize",), (), _CELL),
    "grid.align.local.snapped": Operation(None, ("cellSize",), (), _CELL),
    "grid.reduce": Operation(_reduce, ("cellSize", "usePreviousAlignment"), (), {
        "cell size is required": "coalesce(usePreviousAlignment, false) OR cellSize IS NOT NULL", **_CELL,
        "needs an earlier alignment": "NOT coalesce(usePreviousAlignment, false) OR has_alignment"}),
    "filter.monochrome": Operation(lambda px, s, state: pixels.monochrome(px), one_pass=True),
    "filter.sharpen": Operation(lambda px, s, state: stencil.sharpen(px, s["sharpen"]["strength"], s["sharpen"]["threshold"]),
                                ("sharpen",), ("sharpen",), {"sharpen strength must be 0..200 and threshold 0..64":
                                                             "sharpen.strength BETWEEN 0 AND 200 AND sharpen.threshold BETWEEN 0 AND 64"}, one_pass=True),
    "filter.ascii": Operation(_ascii, ("ascii",), ("ascii",), {
        "characters must be one non-empty line": "length(ascii.characters) > 0 AND NOT ascii.characters RLIKE '[\\\\r\\\\n]'",
        "columns must be 0..512": _between("ascii.columns", 0, 512),
        "rows must be positive": "ascii.rows IS NULL OR ascii.rows >= 1"}),
    "color.replace": Operation(lambda px, s, state: pixels.replace_color(px, s["colorReplacement"]["source"], s["colorReplacement"]["target"]),
                               ("colorReplacement",), ("colorReplacement",), one_pass=True),
    "color.channel.adjust": Operation(_channel, ("channelAdjustment",), ("channelAdjustment",), {
        "unknown adjustment mode": "lower(channelAdjustment.mode) IN ('value', 'percent')",
        "unknown channel": "upper(channelAdjustment.channel) IN ('R', 'G', 'B', 'A')",
        "amount out of range": "channelAdjustment.amount BETWEEN 0 AND CASE lower(channelAdjustment.mode) WHEN 'percent' THEN 100 ELSE 255 END"}, one_pass=True),
    "background.remove": Operation(_background, ("background",), ("background",), {
        "background tolerance must be 0..100": _between("background.tolerance", 0, 100),
        "unsupported background mode": "coalesce(lower(background.mode), 'global') IN ('global', 'edges')"}),
    "contours.heatmap": Operation(lambda px, s, state: stencil.contour_heatmap(
        px, window=s["contours"].get("windowSize", 3), similar=s["contours"].get("similarColorDistance", 12.0)),
        ("contours",), ("contours",), {"window must be odd, 3..15": "contours.windowSize IS NULL OR (contours.windowSize BETWEEN 3 AND 15 AND contours.windowSize % 2 = 1)",
                                       "similar colour distance must be 0..100": _between("contours.similarColorDistance", 0, 100)}),
    "contours.clean": Operation(None, ("contours",), ("contours",)),
    "connected-palette": Operation(_connected, ("connectedPalette",), ("connectedPalette",), _CONNECTED),
    "image.finalist.reduce": Operation(lambda px, s, state: blocks.finalist_reduce(px, s["finalistMode"].lower(), s["finalistFactor"]),
                                       ("finalistMode", "finalistFactor"), ("finalistMode", "finalistFactor"), {
        "unknown finalist mode": "lower(finalistMode) IN ('t3', 'p5', 'mixed')", "finalist factor must be 2..64": "finalistFactor BETWEEN 2 AND 64"}),
}


def register_operation(name: str, run: Callable[[DataFrame, dict, State], DataFrame], rules: dict[str, str] | None = None,
                       allowed: tuple[str, ...] = (), required: tuple[str, ...] = (), one_pass: bool = False) -> None:
    """Add a recipe step; it is validated and replayed like the built-in ones."""
    require(bool(name) and name not in OPERATIONS, f"operation {name!r} already exists")
    require(set(allowed) | set(required) <= set(BLOCKS), "unknown option block")
    OPERATIONS[name] = Operation(run, tuple(allowed), tuple(required), dict(rules or {}), one_pass)


# --- tables of recipes -----------------------------------------------------------------

def parse_recipes(rows: DataFrame, text: str = "json") -> DataFrame:
    """Add the parsed ``recipe``; malformed text leaves it NULL."""
    return rows.withColumn("recipe", F.from_json(text, RECIPE_SCHEMA)).withColumn(
        "recipe", F.when(F.expr("recipe.version IS NOT NULL OR recipe.steps IS NOT NULL"), F.col("recipe")))


def with_alignment(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``has_alignment``: an earlier global or snapped alignment not undone by a local one."""
    event = F.expr("CASE WHEN operation_id IN ('grid.align', 'grid.align.local.snapped') THEN CAST(step_index AS BIGINT) * 2 + 1 "
                   "WHEN operation_id = 'grid.align.local' THEN CAST(step_index AS BIGINT) * 2 END")
    ordered = bucketed_running_sum(steps.withColumn("_event", event), keys, F.floor(F.col("step_index") / 1024),
                                   ["step_index"], "_event", "_last", "max")
    return ordered.withColumn("has_alignment", F.coalesce(F.col("_last") % 2 == 1, F.lit(False))).drop("_event", "_last")


def alignment_errors(steps: DataFrame) -> DataFrame:
    """Steps that rely on a previous alignment their source does not have."""
    return with_alignment(steps, ["source_id"]).filter("use_previous_alignment AND NOT has_alignment").select(
        "source_id", "step_index", F.lit("needs an earlier alignment").alias("error"))


#: Steps that begin or undo an alignment.
_ALIGNING = ("grid.align", "grid.align.local.snapped", "grid.align.local")


def _problem(aligned: bool) -> Column:
    """First problem of a step, with or without an earlier alignment."""
    checks = F.when(F.coalesce(F.trim("operation_id"), F.lit("")) == "", "operation is required")
    checks = checks.when(~F.col("operation_id").isin(*OPERATIONS), "unsupported operation")
    for name, op in OPERATIONS.items():
        if op.run is None:
            own = F.lit("operation cannot be replayed")
        else:
            extra = [f"({b} IS NOT NULL{' AND ' + b if b == 'usePreviousAlignment' else ''})" for b in BLOCKS if b not in (*op.allowed, *op.required)]
            own = F.when(F.expr(" OR ".join(extra)), "unsupported parameters")
            for block in op.required:
                own = own.when(F.col(block).isNull(), f"{block} is required")
            for message, rule in op.rules.items():
                own = own.when(F.expr(f"NOT coalesce({re.sub('has_alignment', str(aligned), rule)}, false)"), message)
        checks = checks.when(F.col("operation_id") == name, own)  # only the rules of its own operation are looked at
    # All rules in one generated method would exceed the JVM's size limit and make the
    # whole stage fall back; inside a lambda only the rule chain is interpreted.
    return F.get(F.transform(F.array(F.lit(0)), lambda _: checks), F.lit(0))


def _judged(parsed: DataFrame, key: str) -> DataFrame:
    """``key, step_index, operation_id, error, alone`` of every step, and one row of step 0 for what is no list of steps.

    ``alone`` is the error if no alignment comes before. One pass without a shuffle reads the parsed recipes,
    whose options stay behind; only these narrow rows are stored.
    """
    whole = F.expr("CASE WHEN recipe IS NULL THEN 'not a recipe' WHEN recipe.version IS DISTINCT FROM 1 THEN 'unsupported version' "
                   "WHEN recipe.steps IS NULL OR size(recipe.steps) = 0 THEN 'no steps' END")
    steps = parsed.select(key, whole.alias("_whole"), F.expr("CASE WHEN recipe.version = 1 THEN recipe.steps END").alias("_steps"))
    steps = steps.select(key, "_whole", F.posexplode_outer("_steps").alias("_i", "_step"))
    steps = steps.select(key, "_whole", "_i", F.col("_step.operationId").alias("operation_id"), "_step.*")
    hangs = [name for name, op in OPERATIONS.items() if any("has_alignment" in rule for rule in op.rules.values())]
    judged = steps.select(key, "_i", "_whole", "operation_id", F.when(F.col("_i").isNotNull(), _problem(True)).alias("error"), F.when(
        F.col("_i").isNotNull() & F.col("operation_id").isin(*hangs), _problem(False)).alias("alone"))
    return cut_lineage(judged.select(
        key, (F.coalesce("_i", F.lit(-1)) + 1).alias("step_index"), "operation_id", F.coalesce("_whole", "error").alias("error"),
        F.when(F.col("operation_id").isin(*hangs), F.col("alone")).otherwise(F.coalesce("_whole", "error")).alias("alone")))


def _errors(judged: DataFrame, key: str) -> DataFrame:
    hangs = F.coalesce(F.col("operation_id").isin(*_ALIGNING), F.lit(False)) | ~F.col("error").eqNullSafe(F.col("alone"))
    placed = with_alignment(judged.filter(hangs), [key]).withColumn("error", F.when(F.col("has_alignment"), F.col("error")).otherwise(F.col("alone")))
    names = [key, "step_index", "operation_id", "error"]
    return judged.filter(~hangs).select(*names).unionByName(placed.select(*names)).filter("error IS NOT NULL")


def validate_recipes(parsed: DataFrame, key: str) -> DataFrame:
    """First problem of every bad recipe or step: ``key, step_index, operation_id, error``."""
    return _errors(_judged(parsed, key), key)


def macro_duplicates(macros: DataFrame) -> DataFrame:
    """Ids used twice and names used twice ignoring case."""
    ids = macros.groupBy(F.col("id").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    names = macros.groupBy(F.lower("name").alias("value")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return ids.select(F.lit("id").alias("kind"), "value", "n").unionByName(names.select(F.lit("name").alias("kind"), "value", "n"))


def operation_usage(steps: DataFrame) -> DataFrame:
    """Step counts per source and operation with all subtotals."""
    return steps.cube("source_id", "operation_id").agg(
        F.count(F.lit(1)).alias("steps"), F.grouping_id().cast("int").alias("level"))


def macro_summary(steps: DataFrame) -> DataFrame:
    """Step count and the sorted list of operations of every source."""
    return steps.groupBy("source_id").agg(F.count(F.lit(1)).alias("steps"),
                                          F.array_sort(F.collect_set("operation_id")).alias("operations"))


# Captions older results were saved with, and the option names
# their records must contain.
LEGACY = {"": "image.profile", "Размер": "image.resize", "Увеличение": "image.resize", "Size": "image.resize", "Upscale": "image.resize",
          "Очистка цветов": "image.cleanup", "Cleanup Colors": "image.cleanup", "Квантование": "image.colors", "Палитра": "image.colors",
          "Цвет": "image.colors", "Quantization": "image.colors", "Palette": "image.colors", "Color": "image.colors",
          "Монохром": "filter.monochrome", "Monochrome": "filter.monochrome"}


def legacy_operation(caption: str) -> F.Column:
    """Operation id behind an old caption; NULL when it cannot be restored."""
    return F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in LEGACY.items()) + f")[{caption}]")


def missing_legacy_fields(rows: DataFrame, text: str, required: list[str]) -> DataFrame:
    """Required names (ignoring case) that a JSON record lacks."""
    have = F.transform(F.coalesce(F.json_object_keys(text), F.array()), F.lower)
    want = F.array(*[F.lit(n) for n in required])
    return rows.withColumn("missing", F.filter(want, lambda n: ~F.array_contains(have, F.lower(n))))


# --- replay ---------------------------------------------------------------------------------

def check_steps(spark: SparkSession, steps: list[dict]) -> None:
    """Raise on the first invalid step, before any pixel job starts."""
    text = json.dumps({"version": 1, "steps": steps})
    parsed = parse_recipes(spark.createDataFrame([(0, text)], "recipe_id INT, json STRING"))
    errors = validate_recipes(parsed, "recipe_id").orderBy("step_index").head(1)
    if errors:
        raise ValueError(f"step {errors[0]['step_index']} ({errors[0]['operation_id']}): {errors[0]['error']}")
    for step in steps[:-1]:
        require(step["operationId"] != "filter.ascii", "text output must be the last step")


def replay(px: DataFrame, steps: list[dict], store_all: bool = False, state: State | None = None):
    """Yield the frame and the aligned cells after every step.

    A step that reads its input more than once (sizes, then pixels) gets it as a
    written table unless it is one already; otherwise every such step would
    double the work of all steps before it.  One-pass steps stay fused.
    """
    check_steps(px.sparkSession, steps)
    state, stored = state or State(), True
    for step in steps:
        state.lost.clear()
        op = OPERATIONS[step["operationId"]]
        simple = op.one_pass or (step["operationId"] == "image.colors" and "connectedPalette" not in step
                                 and (step["downscale"].get("independentColorMode") or "").lower() == "palette")
        if not (stored or simple):
            px, stored = cut_lineage(px), True
        px, stored = op.run(px, step, state), False
        if store_all and step["operationId"] != "filter.ascii":
            px, stored = cut_lineage(px), True
        yield step, px, state.cells


def apply_recipe(px: DataFrame, steps: list[dict]) -> DataFrame:
    """Run a validated recipe on every image of the corpus."""
    out = px
    for _, out, _ in replay(px, steps):
        pass
    return out


def apply_recipe_with_rejects(px: DataFrame, steps: list[dict]) -> tuple[DataFrame, DataFrame]:
    """The result of ``apply_recipe``, and ``(image_id, step_index, operation_id, reason)`` of every image it does not have.

    Images before and after each step are compared, so an image that a step drops without a
    known reason has a row too.
    """
    state, rejects = State(), None
    before = px
    for index, (step, out, _) in enumerate(replay(px, steps, store_all=True, state=state), 1):
        gone = before.select("image_id").distinct().join(out.select("image_id").distinct(), "image_id", "left_anti")
        reasons = None
        for part in state.lost:
            reasons = part if reasons is None else reasons.unionByName(part)
        if reasons is not None:
            gone = gone.join(reasons.groupBy("image_id").agg(F.min("reason").alias("reason")), "image_id", "left")
        else:
            gone = gone.withColumn("reason", F.lit(None).cast("string"))
        part = gone.select("image_id", F.lit(index).alias("step_index"), F.lit(step["operationId"]).alias("operation_id"),
                           F.coalesce("reason", F.lit("left out by the step")).alias("reason"))
        rejects = part if rejects is None else rejects.unionByName(part)
        before = out
    return before, rejects


def step_report(px: DataFrame, steps: list[dict]) -> DataFrame:
    """Size, colour count and aligned cell of every image after every step."""
    report = None
    for index, (step, out, cells) in enumerate(replay(px, steps, store_all=True), 1):
        part = out.groupBy("image_id").agg(
            (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"),
            F.countDistinct(F.when(F.col("a") > 0, F.expr("r * 65536 + g * 256 + b"))).alias("n_colors"))
        part = part.withColumn("step_index", F.lit(index)).withColumn("operation_id", F.lit(step["operationId"]))
        part = part.join(cells.select("image_id", F.col("pitch").alias("cell_size")), "image_id", "left") if cells is not None \
            else part.withColumn("cell_size", F.lit(None).cast("int"))
        report = part if report is None else report.unionByName(part)
    return report


def batch_status(items: DataFrame, key: str, text: str = "json", rejects: DataFrame | None = None) -> DataFrame:
    """One status row per item; a bad item never stops the others.

    ``rejects``, as of ``apply_recipe_with_rejects`` with the items' ids as image ids, has the images that a
    replay left out: their items have failed at that step.
    """
    judged = _judged(parse_recipes(items, text), key)
    errors = _errors(judged, key).select(key, "step_index", "error")
    if rejects is not None:
        errors = errors.unionByName(rejects.select(F.col("image_id").alias(key), "step_index", F.col("reason").alias("error")))
    first = errors.groupBy(key).agg(F.min(F.struct("step_index", "error")).alias("v"))
    # every item has one row of step 0 or 1
    return judged.filter("step_index <= 1").select(key).join(first, key, "left").select(
        key, F.when(F.col("v").isNull(), "done").otherwise("failed").alias("status"), "v.step_index", "v.error")
