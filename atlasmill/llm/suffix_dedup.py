"""Repeated passages by sparse suffix arrays.

A suffix array over all texts has a row for each word. Here only suffixes at content-selected
places are kept: a place whose run of ``GRAM`` words has the smallest hash among ``SPAN``
neighbouring runs. Any passage of ``SPAN + GRAM - 1`` words selects the same place wherever it
stands, so both ends of a match of ``least`` words keep a common suffix in their first ``SPAN``
words, and those suffixes agree in at least ``least - SPAN + 1`` words.

Sorting suffixes by fingerprints of their first words puts suffixes that agree next to each
other; neighbours that agree that far are candidates. They are extended to the left, over the places between
two kept suffixes, and to the right by the passage's next suffixes: every stretch of ``least``
words around a candidate is compared across documents, and stretches that follow each other join
into passages. Nothing shorter is reported and no repeated stretch is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasmill.llm import shingles
from atlasmill.llm.common import stage, unstage

GRAM, SPAN = 8, 20
_STEP = np.uint64(0x9E3779B97F4A7C13)  # odd, and 3 modulo 8
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def stretches(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``length`` words from each start, from one running sum."""
    n = len(words)
    up, down = np.full(n + 1, _STEP, np.uint64), np.full(n + 1, _BACK, np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * up[:-1], dtype=np.uint64)])
    return shingles.mix64((sums[starts + length] - sums[starts]) * down[starts] + np.uint64(length))


def kept_places(words: np.ndarray) -> np.ndarray:
    """Places with the smallest hash of a run of GRAM words among SPAN neighbours, the first of equals."""
    runs = shingles.grams(words, GRAM)
    if len(runs) < SPAN:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(runs, SPAN)
    return np.unique(view.argmin(1) + np.arange(len(view)))


def sparse_suffixes(docs: DataFrame, least: int) -> DataFrame:
    """``(doc_id, text_hash, prints, places)``: fingerprints of the kept suffixes' first words, one row per document."""
    agree = least - SPAN + 1
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text_hash", T.LongType()),
                           T.StructField("prints", T.ArrayType(T.LongType(), False)), T.StructField("places", T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        for batch in batches:
            prints, places = [], []
            for t in batch.column(2).to_pylist():
                words = shingles.word_hashes(t.encode()) if t else np.zeros(0, np.uint64)
                at = kept_places(words) if len(words) >= least else np.zeros(0, np.int64)
                at = at[at + agree <= len(words)]
                places.append(at.astype(np.int32))
                prints.append(stretches(words, at, agree).view(np.int64) if len(at) else np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prints))),
                                              pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(places)))], names=["doc_id", "text_hash", "prints", "places"])

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, schema)


def extend(marked: DataFrame, least: int) -> DataFrame:
    """``(doc_id, text_hash, start, print)`` of every stretch of ``least`` words around marked places."""
    schema = T.StructType([marked.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("print", T.LongType())])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                words = shingles.word_hashes(batch.column(2)[k].as_py().encode())
                at = np.array(batch.column(3)[k].as_py(), np.int64)
                starts = np.unique((at[:, None] - np.arange(SPAN)[None]).ravel())
                starts = starts[(starts >= 0) & (starts + least <= len(words))]
                one = pa.array([k])
                index = pa.array(np.zeros(len(starts), np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(one).take(index), batch.column(1).take(one).take(index), pa.array(starts.astype(np.int32)),
                                                  pa.array(stretches(words, starts, least).view(np.int64))], names=["doc_id", "text_hash", "start", "print"])

    return marked.select("doc_id", "text_hash", "text", "at").mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, least: int = 50) -> DataFrame:
    """``(doc_id, other_doc_id, start_word, end_word, n_words)``: passages of at least ``least`` words found in another document.

    Words are compared in lower case (A-Z); ends are exclusive. ``other_doc_id`` is the smallest
    id that has the passage, or the largest for that document itself. A stretch shared with other
    documents than the one before it starts a new passage, so passages of a document may overlap.
    Equal texts are looked at once; each copy is one passage over its whole text. Null and short
    texts, and rows with a null id, give no row; rows that repeat id and text count as one document.
    """
    if least < SPAN + GRAM:
        raise ValueError(f"least must be at least {SPAN + GRAM}")
    known = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.md5("text").alias("digest"))
    classes = stage(known.groupBy("digest", "text_hash").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")), "text-classes")
    leaders = known.join(classes.select("digest", "doc_id"), ["digest", "doc_id"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    suffixes = stage(sparse_suffixes(leaders, least), "suffixes")
    each = suffixes.select("doc_id", "text_hash", F.explode(F.arrays_zip("prints", "places")).alias("s")).select("doc_id", "text_hash", "s.prints", "s.places")
    shared = each.groupBy("prints").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("prints")
    # stored, so that the join below has nothing but exchanges under it and hot prints can be split
    shared = stage(shared, "shared-prints")
    places = each.join(shared, "prints").groupBy("doc_id", "text_hash").agg(F.collect_list("places").alias("at"))  # bounded by the text
    places = stage(places, "places")
    texts = known.select("doc_id", "text_hash", "text").join(places, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    found = stage(extend(texts, least), "stretches")
    unstage(suffixes, shared, places)
    pairs = stage(found.groupBy("print").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b"), "pairs")
    hits = found.join(pairs, "print").select("doc_id", "text_hash", "start", F.when(F.col("doc_id") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other"))
    line = Window.partitionBy("doc_id", "text_hash").orderBy("start")
    fresh = (F.col("start") - F.lag("start").over(line) == 1) & (F.col("other") == F.lag("other").over(line))
    runs = hits.withColumn("fresh", F.when(F.coalesce(fresh, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("fresh").over(line))
    passages = runs.groupBy("doc_id", "text_hash", "run").agg(F.min("other").alias("other_doc_id"), F.min("start").alias("start_word"),
                                                              (F.max("start") + least).alias("end_word"))
    passages = passages.select("doc_id", "other_doc_id", "start_word", "end_word")
    copied = classes.filter("doc_id < last").withColumnsRenamed({"doc_id": "first"}).select("digest", "first", "last")
    n = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("int")
    copies = known.join(copied, "digest").select("doc_id", F.when(F.col("doc_id") == F.col("first"), F.col("last")).otherwise(F.col("first")).alias("other_doc_id"),
                                                 F.lit(0).alias("start_word"), n.alias("end_word")).filter(F.col("end_word") >= least).distinct()
    return passages.unionByName(copies).select("*", (F.col("end_word") - F.col("start_word")).alias("n_words"))
