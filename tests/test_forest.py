"""Forests: sums, paths and intervals against brute force, and on extreme shapes."""

import random

import pytest
from pyspark.sql import functions as F

from atlasmill.operators import lineage
from atlasmill.operators.forest import Forest

SCHEMA = "node BIGINT, parent BIGINT"


def random_forest(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.random()
        parent = None if i == 0 or kind < .03 else 10_000 + i if kind < .05 else i - 1 if kind < .4 else rng.randrange(i)
        rows.append((i, parent))
    # a cycle, nodes leading into it, and a loop of one
    rows += [(n, n + 1), (n + 1, n + 2), (n + 2, n), (n + 3, n + 1), (n + 4, n + 3), (n + 5, n + 5)]
    rng.shuffle(rows)
    return rows


def paths_of(rows):
    """Nodes from each node up to its root; None for nodes on or above a cycle."""
    parents = dict(rows)
    out = {}
    for node in parents:
        path, at = [], node
        while at in parents and at not in path:
            path.append(at)
            at = parents[at]
        out[node] = None if at in path else path
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_questions_match_brute_force(spark, seed):
    rows = random_forest(seed)
    paths = {node: p for node, p in paths_of(rows).items() if p}
    forest = Forest(spark.createDataFrame(rows, SCHEMA).repartition(5), "node", "parent")
    assert {r.node for r in forest.nodes.collect()} == set(paths)

    weights = {node: node % 7 for node in paths if node % 3}
    totals = {}
    for node, w in weights.items():
        for above in paths[node]:
            totals[above] = totals.get(above, 0) + w
    got = forest.totals(spark.createDataFrame(list(weights.items()), "node BIGINT, w BIGINT"))
    assert {r.node: r.w for r in got.collect()} == totals

    every = spark.createDataFrame([(n, n % 5, n) for n in paths], "node BIGINT, s BIGINT, m BIGINT")
    got = {r.node: (r.s, r.m) for r in forest.along_paths(every, {"s": "sum", "m": "max"}).collect()}
    assert got == {node: (sum(p % 5 for p in path), max(path)) for node, path in paths.items()}

    numbers = {r.node: r for r in forest.intervals().collect()}
    assert sorted(r.enter for r in numbers.values()) == list(range(len(paths)))
    assert all(numbers[n].depth == len(p) - 1 for n, p in paths.items())
    inside = {(a.node, b.node) for a in numbers.values() for b in numbers.values() if a.enter <= b.enter <= a.leave}
    assert inside == {(above, node) for node, path in paths.items() for above in path}

    seeds = spark.createDataFrame([(n,) for n in range(0, 450, 7)] + [(7,), (999_999,)], "seed BIGINT")
    wanted = {n for n in range(0, 450, 7) if n in paths}
    below = {(above, node, k) for node, path in paths.items() for k, above in enumerate(path) if above in wanted}
    assert sorted(tuple(r) for r in forest.below(seeds).collect()) == sorted(below)
    under = {}
    for above, node, k in below:
        under[node] = max(k, under.get(node, 0))
    assert sorted(tuple(r) for r in forest.under_any(seeds).collect()) == sorted(under.items())
    assert sorted(tuple(r) for r in forest.above(seeds).collect()) == sorted((s, n, k) for s in wanted for k, n in enumerate(paths[s]))


def test_empty_and_single(spark):
    none = Forest(spark.createDataFrame([], SCHEMA), "node", "parent")
    assert none.intervals().count() == 0 and none.below(spark.createDataFrame([(1,)], "s BIGINT")).count() == 0
    one = Forest(spark.createDataFrame([(5, None)], SCHEMA), "node", "parent")
    assert [tuple(r) for r in one.intervals().collect()] == [(5, 0, 0, 0)]


def test_chain_of_100_000_nodes(spark):
    n = 100_000
    chain = spark.range(n).selectExpr("id AS gen_id", "CASE WHEN id > 0 THEN id - 1 END AS parent_id")
    forest = Forest(chain, "gen_id", "parent_id")
    assert len(forest.jumps) == 17
    off = forest.intervals().filter("enter != node OR depth != node OR leave != 99999").count()
    assert off == 0
    deep = forest.below(spark.createDataFrame([(n - 3,)], "s BIGINT")).collect()
    assert sorted(tuple(r) for r in deep) == [(n - 3, n - 3, 0), (n - 3, n - 2, 1), (n - 3, n - 1, 2)]


def test_wide_star(spark):
    star = spark.range(50_000).selectExpr("id AS gen_id", "CASE WHEN id > 0 THEN 0 END AS parent_id", "CAST('2024-01-01' AS TIMESTAMP) AS created_at")
    numbers = Forest(star, "gen_id", "parent_id").intervals()
    row = numbers.agg(F.countDistinct("enter").alias("n"), F.max("leave").alias("high"), F.max("depth").alias("d")).first()
    assert (row.n, row.high, row.d) == (50_000, 49_999, 1)
    rows = lineage.branch_rows(star).agg(F.countDistinct("row").alias("n"), F.max("row").alias("high")).first()
    assert (rows.n, rows.high) == (49_999, 49_998)


def test_delete_plan_counts_from_the_topmost_seed(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (5, 1), (6, None)]
    gens = spark.createDataFrame(rows, "gen_id BIGINT, parent_id BIGINT")
    seeds = spark.createDataFrame([(2,), (3,), (6,)], "gen_id BIGINT")
    assert [tuple(r) for r in lineage.delete_plan(gens, seeds).collect()] == [(4, 2), (3, 1), (2, 0), (6, 0)]


def test_only_results_on_cycles_are_followed_again(spark, monkeypatch):
    """Display parents, roots and replayed paths with cycles cut; results on trees are followed once."""
    from atlasmill.operators import lineage
    rows = [(i, i // 2 if i > 1 else None) for i in range(1, 40)] + [(100, 102), (101, 100), (102, 101), (103, 102), (104, 103)]
    gens = spark.createDataFrame([(7, g, p, 0, f"op{g}") for g, p in rows], "source_id INT, gen_id INT, parent_id INT, created_at INT, operation_id STRING")
    asked = []
    first = lineage.ancestry
    monkeypatch.setattr(lineage, "ancestry", lambda nodes, *args, **kw: asked.append(nodes.count()) or first(nodes, *args, **kw))
    found = {r.gen_id: (r.display_parent, r.root_id, r.depth) for r in lineage.branch_forest(gens).collect()}
    assert asked == [44, 5]
    up = dict(rows) | {100: None}
    for g in up:
        path = [g]
        while up[path[-1]] is not None:
            path.append(up[path[-1]])
        assert found[g] == (up[g], path[-1], len(path) - 1)
    asked.clear()
    pairs = spark.createDataFrame([(104, 39), (101, 104), (39, 38)], "leaf_a INT, leaf_b INT")
    plan = lineage.merge_plan(gens, pairs).collect()
    assert asked == []
    assert sorted((r.step_index, r.gen_id, r.operation_id) for r in plan if r.leaf_a == 104) == [
        (k, g, f"op{g}") for k, g in enumerate([100, 101, 102, 103, 104])]
    assert {(r.leaf_a, r.verdict) for r in plan if r.leaf_a != 104} == {(101, "same_branch"), (39, "same_branch")}
