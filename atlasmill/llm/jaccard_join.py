"""Word n-gram Jaccard self-join by T-occurrence search.

Two sets with Jaccard similarity of at least ``t`` share at least T shingles. T-occurrence search
finds the sets that a query shares T inverted lists with: DivideSkip merges the query's short
lists with a heap, asks for T less the number of its long lists there, and probes the long lists
by binary search for the sets that come through.

On Spark the search runs where it can succeed, and nothing is dropped on the way:

1. Equal sets become one class; only one row of a class goes on.
2. Two linked sets share at least ``l`` of their ``p + l - 1`` smallest hashes, where ``p = n - T + 1``
   and ``l`` is the smaller of their two. Sets with fewer that occur twice in the corpus link with nothing.
3. Of the rest, whole sets are counted among each other. A set with ``p`` shingles of its own
   links with nothing. Others keep those of their ``p`` rarest shingles that are shared, and sets
   that share one of these are put into one family by connected components.
4. In a family, all sets are compared with the one that has the fewest shingles of its own. Sets
   linked with it need no comparison with each other. Each other set is a query of a T-occurrence
   search against the family, in blocks of bounded size. A block returns links that span what it
   found, not all pairs, and links between the sets of a family give its classes.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasmill.llm import shingles
from atlasmill.llm.common import components, parallelism, scratch, stage, unstage

#: Sets in one block of a search.
BLOCK = 256
#: Sets whose sizes differ by less than this factor share a shelf of blocks.
SIZE_STEP = 1.02
#: Lists of a block with at least this many sets count as long.
LONG = 32
#: Cost of one step of a binary probe against one of merging, and probes made at a time.
PROBE_COST, PROBES = 0.1, 1 << 20


def overlap_needed(n: int, m: int, percent: int) -> int:
    """Smallest intersection with which sets of n and m shingles reach the similarity."""
    return -(-percent * (n + m) // (100 + percent))


def _prefix(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1 if n else 0


def _digest(items: np.ndarray) -> bytes:
    import hashlib
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``(doc_id, n_shingles, digest, low)``: set size, 128-bit digest of the set, smallest hashes."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_shingles", T.LongType()),
                           T.StructField("digest", T.BinaryType()), T.StructField("low", T.ArrayType(T.LongType(), False))])

    def run(batches):
        for batch in batches:
            sets = [shingles.shingle_set(t.as_py(), k) for t in batch.column(1)]
            low = []
            for s in sets:
                p = _prefix(len(s), percent)
                low.append(s[:p + p // 2])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int32)
            flat = np.concatenate(low) if low else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_digest(s) for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "n_shingles", "digest", "low"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """``(id, items)``: the whole set of every row under its digest."""
    schema = T.StructType([T.StructField("id", T.BinaryType()), T.StructField("items", T.ArrayType(T.LongType(), False))])

    def run(batches):
        for batch in batches:
            sets = [shingles.shingle_set(t.as_py(), k) for t in batch.column(1)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()),
                                              pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class InvertedBlock:
    """Inverted lists over the sets of one block, long and short ones apart."""

    def __init__(self, sets: list[np.ndarray], long: int):
        self.sets, self.sizes = sets, np.array([len(s) for s in sets], np.int64)
        values = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        order = np.argsort(values, kind="stable")
        values, self.owner = values[order], owner[order]
        self.keys, self.start = np.unique(values, return_index=True)
        self.length = np.diff(np.append(self.start, len(values)))
        self.is_long = self.length >= long
        # one number an entry, in order: what binary probes look for
        self.codes = np.repeat(np.arange(len(self.keys)), self.length) * len(sets) + self.owner

    def aside(self, needed: np.ndarray, longest: np.ndarray, long_lists: np.ndarray) -> np.ndarray:
        """Number of lists to put aside: fewer the dearer a probe is, and one less than the overlap at most."""
        wanted = (needed / (PROBE_COST * np.log2(longest + 1) + 1)).astype(np.int64)
        return np.maximum(0, np.minimum(np.minimum(wanted, needed - 1), long_lists))

    def search_all(self, queries: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
        """``(query, set)`` numbers of all links between queries and sets of the block.

        The same as ``search`` for each query, in arrays: the entries of all short lists are merged by
        counting them, and the pairs that reach the lower threshold probe the long lists.
        """
        width, n = len(self.sets), np.array([len(q) for q in queries], np.int64)
        asked = np.repeat(np.arange(len(queries)), n)
        values = np.concatenate(queries)
        lists = np.minimum(np.searchsorted(self.keys, values), len(self.keys) - 1)
        known = self.keys[lists] == values
        asked, lists = asked[known], lists[known]
        order = np.lexsort((lists, self.length[lists], asked))
        asked, lists = asked[order], lists[order]
        held = np.bincount(asked, minlength=len(queries))
        first = np.cumsum(held) - held
        longest = np.ones(len(queries), np.int64)
        longest[held > 0] = self.length[lists[(first + held - 1)[held > 0]]]
        least = -(-percent * (n + -(-percent * n // 100)) // (100 + percent))
        put = np.minimum(self.aside(least, longest, np.bincount(asked, self.is_long[lists], len(queries)).astype(np.int64)), held)
        short = np.arange(len(lists)) - first[asked] < held[asked] - put[asked]
        lengths = self.length[lists[short]]
        spots = np.repeat(self.start[lists[short]] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        seen = np.bincount(np.repeat(asked[short], lengths) * width + self.owner[spots], minlength=len(queries) * width).reshape(-1, width)
        need = -(-percent * (n[:, None] + self.sizes[None]) // (100 + percent))
        q, d = np.nonzero((seen > 0) & (seen >= need - put[:, None]))
        total, need = seen[q, d], need[q, d]
        step = max(1, PROBES // max(1, int(put.max(initial=1))))
        for at in range(0, len(q), step):
            some = slice(at, at + step)
            probes = put[q[some]]
            pair = np.repeat(np.arange(len(probes)), probes)
            rank = np.arange(int(probes.sum())) - np.repeat(np.cumsum(probes) - probes, probes)
            one = lists[(first + held - put)[q[some]][pair] + rank]
            code = one * width + d[some][pair]
            place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            total[some] += np.bincount(pair, self.codes[place] == code, len(probes)).astype(np.int64)
        return q[total >= need], d[total >= need]

    def search(self, query: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """``(set, overlap)`` of every set of the block that links with the query."""
        n = len(query)
        at = np.searchsorted(self.keys, query)
        at = at[(at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == query)]
        lists = at[np.argsort(self.length[at], kind="stable")]
        least = overlap_needed(n, -(-percent * n // 100), percent)
        if len(lists) < least:
            return []
        # at most T - 1 lists may be put aside, so that a result shows up in the short ones
        aside = int(self.aside(np.int64(least), self.length[lists].max(), self.is_long[lists].sum()))
        short, long = lists[:len(lists) - aside], lists[len(lists) - aside:]
        found = []
        for d, seen in self._merge(short, least - aside):
            need = overlap_needed(n, int(self.sizes[d]), percent)
            left = len(long)
            for k in long[::-1]:
                if seen + left < need:
                    break
                own = self.owner[self.start[k]:self.start[k] + self.length[k]]
                i = np.searchsorted(own, d)
                seen, left = seen + bool(i < len(own) and own[i] == d), left - 1
            if seen >= need:
                found.append((d, seen))
        return found

    def _merge(self, lists: np.ndarray, least: int):
        """Sets in at least ``least`` of the lists, by merging them with a heap."""
        parts = [self.owner[self.start[k]:self.start[k] + self.length[k]] for k in lists]
        heap = [(int(p[0]), k, 0) for k, p in enumerate(parts) if len(p)]
        heapq.heapify(heap)
        while heap:
            d, seen = heap[0][0], 0
            while heap and heap[0][0] == d:
                _, k, i = heap[0]
                seen += 1
                if i + 1 < len(parts[k]):
                    heapq.heapreplace(heap, (int(parts[k][i + 1]), k, i + 1))
                else:
                    heapq.heappop(heap)
            if seen >= least:
                yield d, seen


class _Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def candidates(signed: DataFrame, percent: int) -> DataFrame:
    """Stored ``id`` (a ``doc_id``) of the sets that step 2 lets through; ``signed`` has one row a class."""
    smallest = F.ceil(F.col("n_shingles") * percent / 100)  # set that can link with this one
    p = smallest - F.ceil(smallest * percent / 100) + 1
    low = signed.select(F.col("doc_id").alias("id"), (F.floor(p / 2) + 1).alias("l"), F.explode("low").alias("h"))
    twice = low.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h")
    twice = stage(twice, "twice")  # so that the join has exchanges only below it and hot hashes can be split
    passed = stage(low.join(twice, "h").groupBy("id", "l").agg(F.count(F.lit(1)).alias("c")).filter("c >= l").select("id"), "maybe")
    unstage(twice)
    return passed


def families(sets: DataFrame, percent: int) -> DataFrame:
    """``(id, family, own)`` of the sets that may link; ``own``: shingles that no other set has."""
    rows = sets.select("id", F.size("items").alias("n"), F.explode("items").alias("h"))
    p = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    counts = stage(counts, "counts")
    shared = stage(rows.join(counts, "h"), "shared")
    unstage(counts)
    # of the p rarest shingles, those of its own come first
    own = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("id"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("c", "h"))
    prefix = stage(shared.withColumn("own", own).withColumn("r", rank).withColumn("p", p).filter("own < p AND own + r <= p").select("id", "h", "own"), "prefix")
    unstage(shared)
    first = stage(prefix.groupBy("h").agg(F.min("id").alias("f")), "first")
    linked = components(prefix.join(first, "h").select(F.col("id").alias("a"), F.col("f").alias("b")))
    found = stage(linked.withColumnRenamed("component", "family").join(prefix.select("id", "own").distinct(), "id"), "families")
    unstage(prefix, first)
    return found


def _spanning(found, union):
    return [(a, b) for a, b in found if union.join(a, b)]


def search_families(sets: DataFrame, family: DataFrame, percent: int, block: int, long: int) -> DataFrame:
    """Links ``(a, b)`` that span the classes of linked sets."""
    kind = sets.schema["id"].dataType
    pair = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    known = stage(sets.join(family, "id"), "family-sets")
    hub = known.groupBy("family").agg(F.min_by(F.struct("id", "items"), F.struct("own", F.size("items"), "id")).alias("hub"), F.count(F.lit(1)).alias("f"))
    hub = stage(hub, "hubs")

    def against_hub(batches):
        for batch in batches:
            ids, items, hub_ids, hubs = (batch.column(k) for k in range(4))
            linked = []
            for k in range(batch.num_rows):
                x, y = items[k].values.to_numpy(), hubs[k].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([ids, hub_ids, pa.array(linked)], names=["id", "hub", "linked"])

    # one row a family on the right: families are split by skew handling, sets are never grouped
    pairs = known.join(hub, "family").select("id", "items", F.col("hub.id").alias("hub"), F.col("hub.items").alias("hub_items"))
    verdict = stage(pairs.mapInArrow(against_hub, T.StructType([T.StructField("id", kind), T.StructField("hub", kind), T.StructField("linked", T.BooleanType())])), "verdicts")
    links = verdict.filter("linked AND id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    # Queries are sets not linked with the hub. A set shares all but its own shingles at most, which
    # bounds the size of its partners from above; blocks hold sets of similar size, so a query meets
    # few of them. A link of two queries is found from either side.
    sized = known.join(verdict, "id").withColumn("n", F.size("items").cast("long"))
    bucket = lambda m: F.floor(F.log(m) / F.log(F.lit(SIZE_STEP)) + 1e-9).cast("int")
    sized = sized.withColumn("bucket", bucket(F.col("n")))
    open_ = sized.filter("NOT linked").select("family", "id", "n", "own")
    highest = F.least(F.floor(F.col("n") * 100 / percent), F.floor((F.col("n") - F.col("own")) * (100 + percent) / percent) - F.col("n"))
    open_ = open_.withColumn("low", F.ceil(F.col("n") * percent / 100)).withColumn("high", highest).filter("low <= high")
    counted = open_.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("query_blocks"))
    asked = open_.join(counted, "family").select(
        "family", "id", F.pmod(F.xxhash64("id", F.lit(1)), F.col("query_blocks")).cast("int").alias("j"), F.explode(F.sequence(bucket(F.col("low")) - 1, bucket(F.col("high")) + 1)).alias("bucket"))
    shelves = sized.groupBy("family", "bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    asked = stage(asked.join(shelves, ["family", "bucket"]).select("family", "bucket", "id", "j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")), "asked")
    cells = asked.select("family", "bucket", "i", "j").distinct()
    placed = sized.join(shelves, ["family", "bucket"]).withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    as_index = placed.join(cells, ["family", "bucket", "i"]).select("family", "bucket", "i", "j", F.lit(False).alias("query"), "id", "items")
    as_query = asked.join(sets, "id").select("family", "bucket", "i", "j", F.lit(True).alias("query"), "id", "items")
    rows = as_index.unionByName(as_query).select(F.xxhash64("family", "bucket", "i", "j").alias("cell"), "query", "id", "items")

    def search(batches):
        pending, cell = [], None

        def solve(members):
            queries = [(i, s) for q, i, s in members if q]
            index = [(i, s) for q, i, s in members if not q]
            if not queries or len(index) < 1:
                return []
            lists, union = InvertedBlock([s for _, s in index], long), _Union()
            q, d = lists.search_all([s for _, s in queries], percent)
            return _spanning([(queries[a][0], index[b][0]) for a, b in zip(q.tolist(), d.tolist()) if queries[a][0] != index[b][0]], union)

        def rows_of(found):
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], batch.column(2).type), pa.array([b for _, b in found], batch.column(2).type)], names=["a", "b"])

        for batch in batches:
            cells, query, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = []
            for k in range(batch.num_rows):
                if cells[k] != cell:
                    out += solve(pending)
                    pending, cell = [], cells[k]
                pending.append((query[k], ids[k], batch.column(3)[k].values.to_numpy()))
            yield rows_of(out)
        if pending:
            yield rows_of(solve(pending))

    dealt = rows.repartition(parallelism(sets.sparkSession), "cell").sortWithinPartitions("cell")
    return links.unionByName(dealt.mapInArrow(search, pair))


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, block: int = BLOCK, long: int = LONG) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: set size and the smallest id reachable by links.

    Links are pairs with ``100 * |A & B| >= percent * |A | B|`` over distinct ``k``-word shingles;
    fewer words make one shingle. Rows without words, null texts among them, have no shingle and
    are their own component. Rows with equal sets link, repeated rows too, and give a row each. A
    null id stays a row of its own component, never another's.
    """
    signed = stage(signatures(docs, k, percent), "signatures")
    real = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stage(real.groupBy("digest").agg(F.min("doc_id").alias("class")), "classes")
    leaders = real.join(classes.withColumnRenamed("class", "doc_id"), ["digest", "doc_id"], "left_semi")
    passed = candidates(leaders, percent)
    # the hashes have done their work: what is needed of every row from here on is small
    light = stage(signed.select("doc_id", "digest", "n_shingles"), "set-sizes")
    unstage(signed)
    maybe = passed.select(F.col("id").alias("doc_id")).distinct()
    # a class may have several rows with its smallest id, and an id several texts: sets count once
    sets = full_sets(docs.join(maybe, "doc_id", "left_semi"), k).withColumnRenamed("id", "digest")
    sets = sets.filter(F.size("items") > 0).dropDuplicates(["digest"])
    # a stored number stands for the digest: every shingle of a set is shuffled with it
    numbered = stage(sets.select(F.monotonically_increasing_id().alias("id"), "digest", "items"), "sets")
    sets = numbered.select("id", "items")
    links = stage(search_families(sets, families(sets, percent), percent, block, long), "links")
    joined = components(links).join(numbered.select("id", "digest"), "id").select("digest", "component")
    rooted = classes.join(joined, "digest", "left")
    smallest = rooted.filter("component IS NOT NULL").groupBy("component").agg(F.min("class").alias("smallest"))
    roots = stage(rooted.join(smallest, "component", "left").select("digest", F.coalesce("smallest", "class").alias("component_id")), "roots")
    unstage(classes, passed, numbered, links)
    known = light.join(roots, "digest", "left")
    return known.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id"))
                        .otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents with the smallest id of their group, and those in no group, with their own columns.

    Rows that share an id stay or go together; of rows that share id and text one stays. A row with a
    null id takes part under a key made from its columns, after all ids below 2^62 (where ids are whole
    numbers; others with a null id all stay). Rows without words are in no group. Column names are
    free, and an empty table stays empty.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    own = F.col("doc_id")
    if docs.schema["doc_id"].dataType in (T.LongType(), T.IntegerType()):
        own = F.coalesce(own.cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64(*[f"`{c}`" for c in docs.columns]), F.lit(1 << 61)))
    keyed = docs.select(row.alias("row"), own.alias("doc_id"), "text")
    with scratch() as left:
        found = jaccard_components(keyed.select("doc_id", "text"), **options)
        kept = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("rows"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("first")).filter("first")
        kept = stage(kept.select("doc_id", "rows"), "kept")
        left.append(kept)
    out = keyed.join(kept.filter("rows = 1").select("doc_id"), "doc_id", "left_semi").select("row")
    repeated = kept.filter("rows > 1").select("doc_id")
    if not repeated.isEmpty():
        out = out.unionByName(keyed.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select("row"))
    out = out.unionByName(keyed.filter("doc_id IS NULL").select("row"))
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
