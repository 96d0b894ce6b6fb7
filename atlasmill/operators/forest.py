"""Forests as tables: jump pointers, sums over subtrees and paths, and intervals.

A forest of depth ``d`` has about ``log2(d)`` jump tables: table ``k`` leads from every node to the
ancestor ``2^k`` levels up. With them every question below takes ``log2(d)`` joins, whatever the
shape, and no table ever pairs nodes with all their ancestors:

* ``totals`` adds up values over subtrees: what lies within ``2^k`` levels grows by the sums of
  the nodes exactly ``2^k`` below. Contributions combine before the shuffle, so a parent with a
  third of all nodes as children is no hot spot.
* ``along_paths`` adds up values from a node to its root in the same way.
* ``intervals`` numbers the nodes in preorder; a subtree is the range ``enter .. leave``, so
  "is below" is a comparison of two numbers.
* ``below`` and ``above`` list only the pairs that are asked for.

Nodes whose parent is not in the table are roots. Nodes on or above a cycle belong to no tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasmill.runtime import bucketed_running_sum, cut_lineage, discard, stored

BLOCK = 64
#: Rounds that share one plan; each reads the one before twice, so the plan doubles with each.
FUSED = 3


class Forest:
    """``nodes`` with unique ``node`` ids and a ``parent`` column."""

    def __init__(self, nodes: DataFrame, node: str, parent: str):
        pairs = stored(nodes).select(F.col(node).alias("node"), F.col(parent).alias("ptr"))
        known = pairs.select(F.col("node").alias("ptr"))
        step = cut_lineage(pairs.filter("ptr IS NOT NULL").join(known, "ptr", "left_semi").select("node", "ptr"))
        jumps, left = [], step.count()
        #: Nodes on or above a cycle, which belong to no tree, or ``None``.
        self.looped = None
        while left:
            jumps.append(step)
            step = cut_lineage(step.join(step.select(F.col("node").alias("ptr"), F.col("ptr").alias("up")), "ptr").select("node", F.col("up").alias("ptr")))
            now = step.count()
            if now == left:  # none of the nodes left gets nearer to a root
                looped = self.looped = step.select("node")
                jumps = [cut_lineage(jump.join(looped, "node", "left_anti")) for jump in jumps]
                pairs = pairs.join(looped, "node", "left_anti")
                break
            left = now
        self.jumps = jumps
        parents = jumps[0].withColumnRenamed("ptr", "parent") if jumps else pairs.filter("false").select("node", F.col("ptr").alias("parent"))
        self.nodes = cut_lineage(pairs.select("node").join(parents, "node", "left"))

    def add(self, other: Forest) -> None:
        """Take in the trees of a forest that shares no node with this one."""
        both = list(zip(self.jumps, other.jumps))
        longer = self.jumps if len(self.jumps) > len(other.jumps) else other.jumps
        self.jumps = [a.unionByName(b) for a, b in both] + longer[len(both):]
        self.nodes, self.looped = self.nodes.unionByName(other.nodes), other.looped

    def _rounds(self, values: DataFrame, step) -> DataFrame:
        """``step(now, jump)`` for every jump table, stored after every few of them."""
        now = stored(values)
        mine = now is not values
        for k in range(0, len(self.jumps), FUSED):
            following = now
            for jump in self.jumps[k:k + FUSED]:
                following = step(following, jump)
            following = cut_lineage(following)
            if mine:
                discard(now)
            now, mine = following, True
        return now

    def totals(self, values: DataFrame) -> DataFrame:
        """Sums of the columns of ``values(node, ...)`` over every node's subtree, for nodes with any."""
        names = values.columns[1:]

        def step(now, jump):
            lifted = now.join(jump, "node").select(F.col("ptr").alias("node"), *names)
            return now.unionByName(lifted).groupBy("node").agg(*[F.sum(c).alias(c) for c in names])

        return self._rounds(values, step)

    def along_paths(self, values: DataFrame, combine: dict[str, str]) -> DataFrame:
        """``sum`` or ``max`` of columns of ``values(node, ...)`` over every node and all nodes above it.

        ``values`` needs a row for every node.
        """
        merge = [{"sum": F.sum, "max": F.max}[how](c).alias(c) for c, how in combine.items()]

        def step(now, jump):
            above = now.select(F.col("node").alias("ptr"), *combine)
            return now.unionByName(jump.join(above, "ptr").select("node", *combine)).groupBy("node").agg(*merge)

        return self._rounds(values.select("node", *combine), step)

    def intervals(self) -> DataFrame:
        """``node, enter, leave, depth``: preorder numbers over the whole forest, ends included."""
        sizes = self.totals(self.nodes.select("node", F.lit(1).cast("long").alias("size")))
        sized = self.nodes.join(sizes, "node").withColumn("at", F.xxhash64("node"))
        # siblings stand in the order of a hash, which cuts the children of one parent into even buckets
        placed = bucketed_running_sum(sized, ["parent"], F.shiftright("at", 52), ["at", "node"], "size", "before")
        steps = placed.select("node", (F.coalesce("before", F.lit(0)) + 1).alias("enter"), F.lit(1).cast("long").alias("depth"))
        numbers = self.along_paths(steps, {"enter": "sum", "depth": "sum"})
        return cut_lineage(numbers.join(sizes, "node").select(
            "node", (F.col("enter") - 1).alias("enter"), (F.col("enter") + F.col("size") - 2).alias("leave"), (F.col("depth") - 1).alias("depth")))

    def below(self, seeds: DataFrame) -> DataFrame:
        """``seed, node, distance`` of every node at or below the nodes in the first column of ``seeds``."""
        numbers = self.intervals()
        wanted = seeds.select(F.col(seeds.columns[0]).alias("node")).distinct()
        ranges = numbers.join(wanted, "node").select(
            F.col("node").alias("seed"), F.col("enter").alias("low"), F.col("leave").alias("high"), F.col("depth").alias("top"),
            F.explode(F.sequence(_block("enter"), _block("leave"))).alias("block"))
        inside = numbers.withColumn("block", _block("enter")).join(ranges, "block").filter("enter BETWEEN low AND high")
        return inside.select("seed", "node", (F.col("depth") - F.col("top")).cast("int").alias("distance"))

    def under_any(self, seeds: DataFrame) -> DataFrame:
        """``node, distance`` of nodes at or below any seed, counted from the topmost one: one row a node, no pairs."""
        numbers = self.intervals()
        wanted = numbers.join(seeds.select(F.col(seeds.columns[0]).alias("node")).distinct(), "node")
        # a seed is topmost if no seed that starts before it reaches it
        reach = bucketed_running_sum(wanted, [], F.floor(F.col("enter") / 65536), ["enter"], "leave", "reach", "max")
        tops = reach.filter("reach IS NULL OR reach < enter").select(
            F.col("enter").alias("low"), F.col("leave").alias("high"), F.col("depth").alias("top"),
            F.explode(F.sequence(_block("enter"), _block("leave"))).alias("block"))
        inside = numbers.withColumn("block", _block("enter")).join(tops, "block").filter("enter BETWEEN low AND high")
        return inside.select("node", (F.col("depth") - F.col("top")).cast("int").alias("distance"))

    def above(self, seeds: DataFrame) -> DataFrame:
        """``seed, node, distance`` of the seeds and all nodes above them, as many rows as come out."""
        wanted = seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().join(self.nodes.select("node"), "node", "left_semi")
        found = wanted.select(F.col("node").alias("seed"), "node", F.lit(0).alias("distance"))
        for k, jump in reversed(list(enumerate(self.jumps))):
            lifted = found.join(jump, "node").select("seed", F.col("ptr").alias("node"), (F.col("distance") + (1 << k)).alias("distance"))
            found = cut_lineage(found.unionByName(lifted))
        return found


def _block(column: str) -> Column:
    return F.floor(F.col(column) / BLOCK)
