"""Substring dedup on a compacted De Bruijn graph of token k-mers.

Every run of ``least`` words is an edge of the graph, between its first and its last ``least - 1``
words. Edges found in several documents are what has to be cut, and they come in long paths.

1. Equal texts count once, under their smallest id. A later copy is cut as a whole.
2. Each window of ``least`` words selects an anchor, the run of ``GRAM`` words with the smallest
   hash in it, so equal windows select equal anchors. Only windows whose anchor occurs under
   two ids become edges; anchors are a sixteenth of the places.
3. Edges are combined before the shuffle: smallest and largest id, the place of the smallest, and
   whether all occurrences go on, and come, by one and the same edge.
4. Edges of several documents that follow each other without a branch, on both sides, compact into a
   path. All occurrences of a path's first edge run through the whole path, so its edges' first
   occurrences are consecutive places of one document: a path is found on source coordinates by one
   sort, not by rounds of pointer jumping.
5. Only the first edge of each path is joined back to its occurrences. Each is one long span with
   the source coordinates of its path; spans are compared by a digest of their words with the
   one at the source, and a clash of two hashes leaves groups of their own.
6. Spans whose words stand under a smaller id are cut.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasmill.llm import shingles
from atlasmill.llm.common import stage, unstage
from atlasmill.llm.suffix_dedup import stretches

GRAM = 19
PART = 1 << 32  # a place is the text's number under its id times this, plus the word
NO_EDGE = 0

_TEXT = "doc_id", "part", "text"


def _words(text: str) -> np.ndarray:
    return shingles.word_hashes(text.encode(), shingles.AS_THEY_ARE)


def _flat(schema: T.StructType, doc: pa.Array, rows: list[int], columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row per entry of ``columns``, with the id of the input row it comes from."""
    return pa.RecordBatch.from_arrays([doc.take(pa.array(rows, pa.int64())), *[pa.array(c) for c in columns]], names=schema.names)


def _anchors(texts: DataFrame, least: int) -> DataFrame:
    """``(doc_id, anchor, place, last)``: anchors with the first and the last window that select them."""
    schema = T.StructType([texts.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("anchor", "place", "last")]])
    span = least - GRAM + 1

    def run(batches):
        for batch in batches:
            rows, parts = [], []
            for k, (part, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                runs = shingles.grams(_words(text), GRAM)
                if len(runs) < span:
                    continue
                chosen = np.lib.stride_tricks.sliding_window_view(runs, span).argmin(1) + np.arange(len(runs) - span + 1)
                first = np.flatnonzero(np.diff(chosen, prepend=-1))
                last = np.append(first[1:], len(chosen)) - 1
                parts.append((runs[chosen[first]].view(np.int64), first + part * PART, last))
                rows.extend([k] * len(first))
            if parts:
                yield _flat(schema, batch.column(0), rows, [np.concatenate(c) for c in zip(*parts)])

    return texts.select(*_TEXT).mapInArrow(run, schema)


def _edges(marked: DataFrame, least: int) -> DataFrame:
    """``(doc_id, place, before, after, edges)``: stretches of consecutive windows, with the edges around them."""
    longs = [T.StructField(c, T.LongType()) for c in ("place", "before", "after")]
    schema = T.StructType([marked.schema["doc_id"], *longs, T.StructField("edges", T.ArrayType(T.LongType(), False))])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                part, text, windows = (batch.column(c)[k].as_py() for c in (1, 2, 3))
                words = _words(text)
                n = len(words) - least + 1
                inside = np.zeros(n + 1, np.int64)
                for w in windows:
                    inside[w["first"]] += 1
                    inside[w["last"] + 1] -= 1
                edge = np.diff((np.cumsum(inside)[:-1] > 0).astype(np.int8), prepend=0, append=0)
                every = np.concatenate([[NO_EDGE], stretches(words, np.arange(n), least).view(np.int64), [NO_EDGE]])
                starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                yield _flat(schema, batch.column(0), [k] * len(starts), [
                    starts + part * PART, every[starts], every[ends + 1], pa.array([every[a + 1:b + 1] for a, b in zip(starts, ends)], pa.list_(pa.int64()))])

    return marked.select(*_TEXT, "windows").mapInArrow(run, schema)


def _digests(marked: DataFrame) -> DataFrame:
    """``(doc_id, head, place, length, digest)``: digest of the words of each span."""
    longs = [T.StructField(c, T.LongType()) for c in ("head", "place", "length")]
    schema = T.StructType([marked.schema["doc_id"], *longs, T.StructField("digest", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                text, spans = batch.column(2)[k].as_py(), batch.column(3)[k].as_py()
                words = text.encode().split()
                made = [hashlib.blake2b(b" ".join(words[s["place"] % PART:s["place"] % PART + s["length"]]), digest_size=16).digest() for s in spans]
                longs = [np.array([s[c] for s in spans], np.int64) for c in ("head", "place", "length")]
                yield _flat(schema, batch.column(0), [k] * len(spans), [*longs, pa.array(made, pa.binary())])

    return marked.select(*_TEXT, "spans").mapInArrow(run, schema)


def _of_text() -> list:
    """Id and part of the text that a place belongs to."""
    return ["doc_id", F.shiftright("place", 32).alias("part")]


def repeated_spans(texts: DataFrame, least: int) -> DataFrame:
    """``(doc_id, part, spans)``: array of (first word, words) that also stand under a smaller id.

    ``texts`` has distinct ``(doc_id, part, text)`` with at least ``least`` words each. A text without such spans has no row.
    """
    anchors = stage(_anchors(texts, least), "anchors")
    shared = stage(anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor"), "shared-anchors")
    window = F.struct((F.col("place") % PART).alias("first"), "last")
    windows = stage(anchors.join(shared, "anchor").groupBy(*_of_text()).agg(F.collect_list(window).alias("windows")), "windows")  # bounded by the text
    unstage(anchors, shared)
    packed = stage(_edges(texts.join(windows, ["doc_id", "part"]), least), "edges")
    unstage(windows)
    each = packed.select("*", F.posexplode("edges").alias("i", "edge"))
    here = F.col("place") + F.col("i")
    around = each.select("edge", "doc_id", here.alias("place"),
                         F.when(F.col("i") == 0, F.col("before")).otherwise(F.get("edges", F.col("i") - 1)).alias("before"),
                         F.when(F.col("i") == F.size("edges") - 1, F.col("after")).otherwise(F.get("edges", F.col("i") + 1)).alias("after"))
    graph = around.groupBy("edge").agg(
        F.min("doc_id").alias("source"), F.max("doc_id").alias("most"), F.min_by("place", "doc_id").alias("place"),
        (F.min("before") == F.max("before")).alias("one_before"), (F.min("after") == F.max("after")).alias("one_after")).filter("source < most")
    line = Window.partitionBy("source", F.shiftright("place", 32)).orderBy("place")
    goes_on = F.col("one_before") & F.lag("one_after").over(line) & (F.lag("place").over(line) + 1 == F.col("place"))
    steps = graph.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("path", F.sum("new").over(line))
    paths = steps.groupBy("source", F.shiftright("place", 32).alias("part"), "path").agg(
        F.min_by("edge", "place").alias("head"), (F.count(F.lit(1)) + least - 1).alias("length"))
    paths = stage(paths.select("head", "length"), "paths")
    heads = each.select(F.col("edge").alias("head"), "doc_id", here.alias("place")).join(paths, "head")
    spans = stage(heads.groupBy(*_of_text()).agg(F.collect_list(F.struct("head", "place", "length")).alias("spans")), "spans")  # bounded by the text
    unstage(packed, paths)
    checked = stage(_digests(texts.join(spans, ["doc_id", "part"])), "checked")
    unstage(spans)
    first = stage(checked.groupBy("head", "digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("most")).filter("first < most"), "first")
    later = checked.join(first.drop("most"), ["head", "digest"]).filter(F.col("doc_id") > F.col("first"))
    cut = stage(later.groupBy(*_of_text()).agg(F.collect_list(F.struct((F.col("place") % PART).alias("first"), "length")).alias("spans")), "cut")
    unstage(checked, first)
    return cut


def cut_repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``: the text without words that a document with a smaller id has.

    A word goes if a run of ``least`` words over it starts in a document with a smaller ``doc_id`` too,
    as the documents came in. Words are what stands between ASCII white space, compared as they are; ``kept``
    joins those that stay by one space. A null text has no words and an empty ``kept``. Rows with a null id
    lose nothing and take nothing from others; rows that share an id take nothing from each other.
    Input columns of the three names are replaced. An empty table gives an empty result. Texts that share an id are
    told apart by 31 bits of a hash; spans that fit no text are not cut.
    """
    if least < GRAM + 1:
        raise ValueError(f"least must be at least {GRAM + 1}")
    given = docs.drop("n_words", "n_removed", "kept")
    part = F.shiftrightunsigned(F.xxhash64("text"), 33)
    n_words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    known = given.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    light = stage(known.filter(n_words >= least).select("doc_id", part.alias("part"), F.unhex(F.sha2("text", 256)).alias("digest")), "text-keys")
    first = stage(light.groupBy("digest").agg(F.min("doc_id").alias("first")), "first-texts")
    leaders = light.join(first, [light.digest == first.digest, light.doc_id == first["first"]], "left_semi").select("doc_id", "part").distinct()
    copies = light.join(first, "digest").filter(F.col("doc_id") > F.col("first")).select("doc_id", "part").distinct()
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.lit(PART).alias("length")))
    texts = stage(known.select("doc_id", part.alias("part"), "text").join(leaders, ["doc_id", "part"]).dropDuplicates(["doc_id", "part"]), "texts")
    spans = repeated_spans(texts, least)
    unstage(texts)
    spans = spans.unionByName(copies.withColumn("spans", whole))
    schema = T.StructType([*given.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    at_text, width = given.columns.index("text"), len(given.columns)

    def run(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, cut in zip(batch.column(at_text), batch.column(width)):
                words, cut = (text.as_py() or "").encode().split(), cut.as_py()
                n_words.append(len(words))
                if cut:
                    stays = np.ones(len(words), bool)
                    for span in cut:
                        stays[span["first"]:span["first"] + span["length"]] = False
                    words = [words[i] for i in np.flatnonzero(stays)]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                              pa.array(kept, pa.string())], names=schema.names)

    # the input row travels as one column, so that no column of its own can clash
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(given.columns)])
    keyed = given.select(row.alias("row"), F.col("doc_id").alias("own_id"), part.alias("own_part"))
    joined = keyed.join(spans, (F.col("own_id") == F.col("doc_id")) & (F.col("own_part") == F.col("part")), "left")
    return joined.select("row.*", "spans").mapInArrow(run, schema)
