"""Shared pieces of the text operators: reading, stored stages, word patterns, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java and Python character class body.
SPACE = r"\x20\x09-\x0D"
#: Ids that a task contracts together.
CONTRACTED = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def configure(spark: SparkSession) -> SparkSession:
    """Settings the operators assume; none of them changes a result."""
    for key, value in {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
                       "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
                       # a stored stage no longer needs the shuffle files that led to it
                       "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
                       "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place named by ``spark.checkpoint.dir``.

    A local master without that setting gets a temporary folder; a cluster without it is refused,
    because its executors could not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="atlasmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Store ``df`` as Parquet in the shared folder and read on from there.

    What follows starts from files that outlive any executor and is computed once.
    """
    folder = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._staged = folder
    if _scratch:
        _scratch[-1].append(out)
    return out


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes the stages made inside at its end, but for those appended to the list it gives."""
    kept: list[DataFrame] = []
    _scratch.append([])
    try:
        yield kept
    finally:
        left = {df._staged for df in kept}
        unstage(*[df for df in _scratch.pop() if df._staged not in left])


def unstage(*frames: DataFrame) -> None:
    """Delete stored stages that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; pure ASCII takes the quick way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key falls into fold 0."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.coalesce(F.crc32(key.cast("string")), F.lit(0)), F.lit(n))


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` with the same components: those of a partition become stars around their smallest ids.

    A task holds ``CONTRACTED`` ids at most; those that follow make stars of their own.
    """

    def run(batches):
        up: dict = {}

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = up[x]
            return x

        def stars(kinds):
            found = [(x, r) for x in up if (r := root(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kinds[i]) for i in range(2)], names=["a", "b"])

        for batch in batches:
            kinds = [c.type for c in batch.columns]
            for x, y in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) >= CONTRACTED:
                yield stars(kinds)
                up.clear()
        if up:
            yield stars(kinds)

    return edges.mapInArrow(run, edges.schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest id reachable over ``edges(a, b)``: rows ``(id, component)`` of every id in an edge.

    Each partition's edges are contracted to stars first, so that rounds only have to join partitions;
    there is none where one task had all edges.
    Alternating star contraction: every id points to a smaller neighbour, and neighbours are
    handed to the smallest, so paths halve in each round. A round is two aggregations that
    combine before the shuffle and one join on the id; it is stored, and so is cut off from
    the ones before. Rounds end when the edge set, summed in an order-free way, stands still.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    marked = lambda found: tuple(found.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    current = stage(_contracted(pairs), "edges")
    mark = marked(current)
    if 2 * mark[0] < CONTRACTED and len(current.inputFiles()) == 1:  # one task saw all edges and kept all ids
        rounds = 0
    for _ in range(rounds):
        # large star: larger neighbours of a node move to its smallest neighbour or itself
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours of a node and the node itself move to the smallest one
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(floor.select("a", F.col("m").alias("b"))).filter("a > b").distinct())
        following = stage(small, "edges")
        seen = marked(following)
        unstage(current)
        current = following
        if mark == seen:
            break
        mark = seen
    else:
        if rounds:
            raise RuntimeError("components did not settle")
    roots = current.select("b").distinct()
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        roots.select(F.col("b").alias("id"), F.col("b").alias("component")))
