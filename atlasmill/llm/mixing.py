"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies. Its whole part is fixed; the
fraction is rounded so that the words of a source add up: fractional documents meet in pairs, the
pair shifts words from one to the other at random, with the expected copies kept, until one of
the two is whole, and the other goes on. Pairs are played inside small blocks, each block leaves
one open document, and these meet in the next level of a reduction tree, until a source has one
open document, which is drawn. So a source misses its target by less than one document.

Of a pair the larger document tends to stay open. So the few heavy documents of a source play
first, from the heaviest on, each against all lighter ones together as one partner; what that
partner wins or loses is spread over its members. The last open document is then a light one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasmill.llm.common import SPACE, scratch, stage
from atlasmill.runtime import bucketed_row_number

#: Documents that meet in one block of the tree.
BLOCK = 64
#: A document is heavy that holds more than one part in so many of its source; no source has more of them.
HEAVY = 256


def source_targets(sizes: DataFrame, weights: list[int], percent: int, most: int) -> DataFrame:
    """``(source, source_size, target)`` from rows ``(source, size)``.

    Weights repeat over the sources by code point, null last. A target is the smaller of
    ``most`` times the source and its weight times a level; the level makes the targets add up.
    Sources that reach their ceiling come first in the order of ceiling by weight, so the level
    follows from running sums, without rounds.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = stage(totals.withColumn("none", F.col("source").isNull()), "sources")
    ranked = bucketed_row_number(totals.withColumn("all", F.lit(0)), ["all"],
                                 F.when(F.col("none"), F.lit(1 << 16)).otherwise(F.ascii("source")), ["none", "source"], "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = stage(ranked.select("source", "source_size", weight.cast("double").alias("weight"))
                   .withColumn("ceiling", F.col("source_size") * F.lit(float(most))), "ceilings")
    # all sources with the same ratio reach their ceiling together: one row a ratio
    ratio = capped.groupBy((F.col("ceiling") / F.col("weight")).alias("ratio")).agg(F.sum("ceiling").alias("c"), F.sum("weight").alias("w"))
    up = Window.orderBy("ratio").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.lit(percent / 100) * F.sum(F.col("c") / F.lit(float(most))).over(Window.partitionBy())
    left = F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(up), F.lit(0.0))
    level = ((whole - F.coalesce(F.sum("c").over(up), F.lit(0.0))) / left).alias("level")
    reached = ratio.select("ratio", level).filter("level <= ratio").agg(F.min_by("level", "ratio").alias("level"))
    return capped.crossJoin(F.broadcast(reached)).select(  # one row on the right
        "source", "source_size", F.least("ceiling", F.col("weight") * F.coalesce("level", F.lit(0.0))).alias("target"))


def _unit(*cols: Column) -> Column:
    """A number in [0, 1) that only depends on the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def _play(state: Column, item: Column) -> Column:
    """One pair: the open document of the block and the next one. ``x``: open words, in [0, size]."""
    a, b = state["open"], item
    whole = (a["x"] == 0) | (a["x"] == a["size"]) | (b["x"] == 0) | (b["x"] == b["size"])
    up = F.when(whole, F.lit(0.0)).otherwise(F.least(a["size"] - a["x"], b["x"]))      # what b can give to a
    down = F.when(whole, F.lit(0.0)).otherwise(F.least(a["x"], b["size"] - b["x"]))    # what a can give to b
    to_a = b["u"] * (up + down) < down            # with probability down / (up + down)
    ax = F.when(to_a, F.when(up == a["size"] - a["x"], a["size"]).otherwise(a["x"] + up)).otherwise(
        F.when(down == a["x"], F.lit(0.0)).otherwise(a["x"] - down))
    bx = F.when(to_a, F.when(up == b["x"], F.lit(0.0)).otherwise(b["x"] - up)).otherwise(
        F.when(down == b["size"] - b["x"], b["size"]).otherwise(b["x"] + down))
    a2, b2 = a.withField("x", ax), b.withField("x", bx)
    a_done = (ax == 0) | (ax == a["size"])
    return F.when(a["size"].isNull(), F.struct(b.alias("open"), state["done"].alias("done"))).when(
        a_done, F.struct(b2.alias("open"), F.concat(state["done"], F.array(a2)).alias("done"))).otherwise(
        F.struct(a2.alias("open"), F.concat(state["done"], F.array(b2)).alias("done")))


def settle_heavy(items: DataFrame, seed: int, heavy: int = HEAVY) -> DataFrame:
    """The same rows with the heavy documents' ``x`` whole, and that of the lighter ones shifted for it.

    Rows that stand for one document each take part; they all have one probability. At most
    ``heavy`` rows of a source meet in one list, because each holds over one part in ``heavy`` of it.
    """
    single = items.filter("times = 1")
    # a maximum and a sum of whole numbers do not depend on the order of rows
    pool = single.groupBy("source").agg(F.sum("size").alias("s"), F.max(F.col("x") / F.col("size")).alias("p"))
    pool = pool.select(F.col("source").alias("src"), "s", (F.col("p") * F.col("s")).alias("x"))
    same = F.col("source").eqNullSafe(F.col("src"))
    big = single.join(pool.drop("x"), same).filter(F.col("size") * heavy > F.col("s"))
    salt = F.lit(seed * 1000 + 999)
    lists = big.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(
        "size", F.xxhash64("doc_id", salt).alias("o"), "doc_id", _unit(F.col("doc_id"), F.col("size"), salt).alias("u"))), asc=False).alias("all"))

    def step(state: Column, doc: Column) -> Column:
        x = doc["size"] * state["x"] / state["s"]
        rest_s, rest_x = state["s"] - doc["size"], state["x"] - x
        up, down = F.greatest(F.lit(0.0), F.least(doc["size"] - x, rest_x)), F.greatest(F.lit(0.0), F.least(x, rest_s - rest_x))
        gains = doc["u"] * (up + down) < down
        new = F.when(gains, F.when(up == doc["size"] - x, doc["size"]).otherwise(x + up)).otherwise(
            F.when(down == x, F.lit(0.0)).otherwise(x - down))
        left = F.when(gains, rest_x - up).otherwise(rest_x + down)
        return F.struct(rest_s.alias("s"), F.greatest(F.lit(0.0), F.least(rest_s, left)).alias("x"),
                        F.concat(state["done"], F.array(F.struct(doc["doc_id"].alias("doc_id"), doc["size"].alias("size"), new.alias("x")))).alias("done"))

    kind = f"array<struct<doc_id:{items.schema['doc_id'].dataType.simpleString()},size:double,x:double>>"
    start = F.struct(F.col("s").cast("double").alias("s"), F.col("x").cast("double").alias("x"), F.array().cast(kind).alias("done"))
    played = stage(lists.join(pool, same).select("source", F.aggregate("all", start, step).alias("r")), "mix-heavy")
    done = played.select(F.col("source").alias("h_source"), F.explode("r.done").alias("d")).select(
        "h_source", F.col("d.doc_id").alias("h_doc"), F.col("d.size").alias("h_size"), F.col("d.x").alias("h_x"))
    rest = played.select(F.col("source").alias("r_source"), F.col("r.s").alias("r_s"), F.col("r.x").alias("r_x"))
    joined = items.join(done, F.col("source").eqNullSafe(F.col("h_source")) & F.col("doc_id").eqNullSafe(F.col("h_doc"))
                        & (F.col("size") == F.col("h_size")) & (F.col("times") == 1), "left").join(
        rest, F.col("source").eqNullSafe(F.col("r_source")), "left")
    light = F.when(F.col("r_x") <= F.col("r_s") * 1e-12, F.lit(0.0)).when(
        F.col("r_x") >= F.col("r_s") * (1 - 1e-12), F.col("size")).otherwise(F.col("size") * F.col("r_x") / F.col("r_s"))
    x = F.when((F.col("times") > 1) | F.col("r_s").isNull(), F.col("x")).when(F.col("h_x").isNotNull(), F.col("h_x")).otherwise(light)
    return joined.withColumn("x", x).select(*items.columns)


def draw(items: DataFrame, levels: int, block: int, seed: int) -> DataFrame:
    """Round ``x`` of every row ``(source, n, doc_id, size, x, ...)`` to 0 or to ``size``.

    ``n``: rows of the source, which fixes its number of blocks in each level. Ties in the order of a
    block are between rows that are equal in all columns.
    """
    carried = [c for c in items.columns if c not in ("source", "n", "x", "size")]
    kind = "struct<o:bigint,size:double,x:double,u:double," + ",".join(f"{c}:{items.schema[c].dataType.simpleString()}" for c in carried) + ">"
    done = []
    for level in range(levels):
        salt = F.lit(seed * 1000 + level)
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / F.pow(F.lit(float(block)), F.lit(level + 1)))).cast("long")
        last = level == levels - 1
        piece = F.struct(F.xxhash64("doc_id", "size", salt).alias("o"), "size", "x",
                         _unit(F.col("doc_id"), F.col("size"), F.col("x"), salt).alias("u"), *carried).cast(kind)
        lists = (items.withColumn("block", F.pmod(F.xxhash64(salt, "size", "doc_id"), blocks))
                 .groupBy("source", "n", "block").agg(F.sort_array(F.collect_list(piece)).alias("all")))
        state = F.struct(F.lit(None).cast(kind).alias("open"), F.array().cast(f"array<{kind}>").alias("done"))
        played = lists.select("source", "n", F.aggregate("all", state, _play).alias("s"))
        both = F.concat(F.transform("s.done", lambda d: F.struct(F.lit(False).alias("more"), d.alias("d"))),
                        F.array(F.struct(F.lit(True).alias("more"), F.col("s.open").alias("d"))))
        rows = played.select("source", "n", F.explode(both).alias("e")).select(
            "source", "n", "e.more", F.col("e.d.size").alias("size"), F.col("e.d.x").alias("x"), *[F.col(f"e.d.{c}").alias(c) for c in carried])
        rows = stage(rows, "mix-level")
        decided = ~F.col("more") | (F.col("x") == 0) | (F.col("x") == F.col("size"))
        if last:
            drawn = F.when(decided, F.col("x")).otherwise(
                F.when(_unit(F.col("doc_id"), F.col("size"), F.lit(seed)) * F.col("size") < F.col("x"), F.col("size")).otherwise(F.lit(0.0)))
            done.append(rows.withColumn("x", drawn))
        else:
            done.append(rows.filter(decided))
            items = rows.filter(~decided).drop("more")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("more", "n")


def copies(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2,
           block: int = BLOCK, seed: int = 11) -> DataFrame:
    """``(source, doc_id, size, n, total, source_size, target)``: how often documents enter the mix.

    A row stands for ``n`` documents that agree in source, id and size, which share ``total``
    copies. A null text has no words; documents without words, and an empty table, enter as they
    are and take none. Equal input gives equal output on any partitioning: all chance comes from hashes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select("source", "doc_id", F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long").alias("size"))
    groups = stage(words.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    targets = stage(source_targets(groups.select("source", (F.col("size") * F.col("n")).alias("size")), list(weights), percent, most), "mix-targets")
    per_source = targets.join(groups.filter("size > 0").groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("rows")),
                              F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    per_source = stage(per_source.withColumnRenamed("source", "src"), "mix-sources")
    known = groups.join(per_source, F.col("source").eqNullSafe(F.col("src"))).drop("src")
    expected = F.col("n") * F.col("target") / F.col("source_size")
    # a sum within a billionth of a whole number is that number
    whole = F.floor(expected + 1e-9)
    open_ = F.when(F.abs(expected - whole) <= 1e-9, 0.0).otherwise(expected - whole)
    known = known.withColumn("fixed", F.when(F.col("size") > 0, whole).otherwise(F.lit(0)).cast("long")).withColumn(
        "part", F.when(F.col("size") > 0, open_).otherwise(F.lit(0.0)))
    most_rows = per_source.agg(F.max("rows")).first()[0] or 1
    levels = max(1, math.ceil(math.log(max(2, most_rows), block)))
    items = known.filter("part > 0").select(
        "source", F.col("rows").alias("n"), "doc_id", F.col("size").cast("double").alias("size"),
        (F.col("part") * F.col("size")).alias("x"), F.col("n").alias("times"), "fixed", "source_size", "target")
    drawn = draw(settle_heavy(items, seed), levels, block, seed).select(
        "source", "doc_id", F.col("size").cast("long").alias("size"), F.col("times").alias("n"),
        (F.col("fixed") + F.when(F.col("x") > 0, 1).otherwise(0)).alias("total"), "source_size", "target")
    return drawn.unionByName(known.filter("part = 0").select("source", "doc_id", "size", "n", F.col("fixed").alias("total"), "source_size", "target"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their own columns.

    Documents without words, null texts among them, are not taken. Rows that agree in source, id and
    size share their copies as evenly as whole numbers allow, the smaller text first. Rows with a null
    source or id take part like any other; an empty table stays empty. Column names are free: the
    row travels as one column.
    """
    with scratch() as kept:
        chosen = copies(docs, **options).filter("total > 0")
        chosen = stage(chosen.select(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("size").alias("z"), "n", "total"), "mix-copies")
        kept.append(chosen)
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    own = docs.select(row.alias("row"), "source", "doc_id", size.alias("size"))
    same = F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("z"))
    taken = own.join(chosen.filter("n = 1"), same).select("row", F.col("total").alias("each"))
    # only rows that share a key have to be put in order
    shared = chosen.filter("n > 1")
    if not shared.isEmpty():
        turn = F.row_number().over(Window.partitionBy("source", "doc_id", "size").orderBy(f"row.c{docs.columns.index('text')}"))
        each = F.floor(F.col("total") / F.col("n")) + F.when(turn <= F.col("total") % F.col("n"), 1).otherwise(0)
        taken = taken.unionByName(own.join(shared, same).select("row", each.alias("each")).filter("each > 0"))
    copied = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("each").cast("int"))).alias("copy"))
    return copied.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every document."""
    shared = copies(docs, **options).withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("n"))))
    each = F.floor(F.col("total") / F.col("n")) + F.when(F.col("turn") <= F.col("total") % F.col("n"), 1).otherwise(0)
    return shared.select("doc_id", "size", "source_size", "target", (each * F.col("size")).cast("long").alias("taken"), "source")
