"""Benchmark decontamination with a distributed positional inverted index.

The index has a row ``(term, doc, place)`` for each token, stored by term. A phrase is found by
intersecting lists whose places are shifted by the term's offset in the phrase: equal shifted
places mean one occurrence. The lists of a phrase's rarest terms come first, because what they
leave is short; the other terms are then compared with the text of the few documents that remain.
Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasmill.llm.common import lower_ascii, scratch, stage, unstage


def one_of_no(*ranges: tuple[int, int]) -> str:
    """Pattern of the longest runs without the ASCII characters of ``ranges``.

    Each is named alone: Java looks single Latin-1 characters up in one table, but tries ranges one by one.
    """
    return "[^" + "".join(f"\\x{c:02X}" for low, high in ranges for c in range(low, high + 1)) + "]+"


#: A word of a lower-cased text: anything but the ASCII that is no digit and no lower-case letter.
WORD = one_of_no((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: The same in a text as it is.
ANY_CASE_WORD = one_of_no((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Lists that are intersected before the exact check.
RAREST = 3
#: A table of terms with at most this many rows, each with a word, is sent to all executors.
SENT_ROWS = 100_000


def words(text: Column) -> Column:
    """Words of a text, null or wordless texts giving an empty array."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None, name: str = "index") -> DataFrame:
    """Stored postings ``(term, doc_id, text_hash, place)`` of all documents.

    ``vocabulary(term, ...)``, if given, keeps the lists of its terms only and adds its columns; a
    search for other terms would not read the rest. A document is known by id and text, so an id
    may repeat over texts. Equal rows give equal postings once more, which changes no search.
    """
    tokens = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(words(F.col("text"))).alias("place", "term"))
    if vocabulary is not None:
        small = vocabulary.count() <= SENT_ROWS
        tokens = tokens.join(F.broadcast(vocabulary) if small else vocabulary, "term")
    return stage(tokens, name)


def shifted(index: DataFrame, probes: DataFrame) -> DataFrame:
    """``(probe, doc_id, text_hash, start)``: lists of ``probes(probe, term, offset)``, places shifted by the offset."""
    small = probes.count() <= SENT_ROWS
    return index.join(F.broadcast(probes) if small else probes, "term").select(
        "probe", "doc_id", "text_hash", (F.col("place") - F.col("offset")).alias("start"))


def intersect(lists: list[DataFrame]) -> DataFrame:
    """Starts in all lists, from the first on."""
    found = lists[0].distinct()
    for more in lists[1:]:
        same = (F.col("l.probe") == F.col("r.probe")) & (F.col("l.start") == F.col("r.start")) & (
            F.col("l.text_hash") == F.col("r.text_hash")) & F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))
        found = found.alias("l").join(more.alias("r"), same, "left_semi")
    return found


def rarest_terms(phrases: DataFrame, index: DataFrame, key: str, rarest: int = RAREST) -> DataFrame:
    """``(key, rank, term, offset)``: the rarest terms of ``phrases(key, terms)``, rank 1 being the rarest."""
    length = index.groupBy("term").agg(F.count(F.lit(1)).alias("length"))
    each = phrases.select(key, F.posexplode("terms").alias("offset", "term"))
    known = each.join(length, "term", "left").withColumn("length", F.coalesce("length", F.lit(0)))
    order = Window.partitionBy(key).orderBy("length", "term", "offset")
    return known.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rarest).select(key, "rank", "term", "offset")


def phrase_starts(phrases: DataFrame, index: DataFrame, key: str = "phrase", rarest: int = RAREST) -> DataFrame:
    """``(key, doc_id, text_hash, start)``: where the rarest terms of ``phrases(key, terms)`` stand as in the phrase.

    Phrases that have the same rarest terms at the same distances are looked up once, as a probe, known by a hash.
    Starts that equal hashes would mix are told apart by the exact check.
    """
    chosen = rarest_terms(phrases, index, key, rarest)
    shape = chosen.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "term", "offset"))).alias("t"))
    base = F.col("t")[0]["offset"]
    shape = shape.select(key, base.alias("base"), F.transform("t", lambda x: F.struct(
        x["term"].alias("term"), (x["offset"] - F.col("t")[0]["offset"]).alias("offset"))).alias("probe_terms"))
    shape = stage(shape.withColumn("probe", F.xxhash64("probe_terms")), "probes")
    probes = shape.select("probe", "probe_terms").dropDuplicates(["probe"]).select(
        "probe", F.size("probe_terms").alias("n"), F.posexplode("probe_terms").alias("rank", "x"))
    probes = stage(probes.select("probe", "n", (F.col("rank") + 1).alias("rank"), "x.term", "x.offset"), "probe-terms")
    # a phrase with fewer terms than ``rarest`` passes the lists it does not have
    found = None
    for rank in range(1, rarest + 1):
        own = shifted(index, probes.filter(F.col("rank") == rank).select("probe", "term", "offset"))
        if found is None:
            found = own.distinct()
            continue
        fewer = probes.filter((F.col("rank") == 1) & (F.col("n") < rank)).select("probe")
        kept = intersect([found, own])
        found = kept.unionByName(found.join(fewer, "probe", "left_semi"))
    return (found.join(shape.select(key, "base", "probe"), "probe")
            .select(key, "doc_id", "text_hash", (F.col("start") - F.col("base")).alias("start")).filter("start >= 0"))


def proximity_matches(phrases: DataFrame, index: DataFrame, slop: int, key: str = "phrase") -> DataFrame:
    """``(key, doc_id, text_hash, first, last)``: stretches with every term of a phrase, at most ``slop`` words longer than it.

    Terms may stand in any order. A stretch starts at a term, is the shortest from there, and is
    found through the phrase's rarest term: its postings name the neighbourhoods in which the
    other lists are read. Terms that repeat in a phrase must stand once.
    """
    terms = phrases.select(key, F.size("terms").alias("width"), F.explode(F.array_distinct("terms")).alias("term"))
    need = terms.groupBy(key).agg(F.count(F.lit(1)).alias("need"))
    rare = rarest_terms(phrases, index, key, 1).select(key, "term")
    reach = F.col("width") + slop
    anchors = index.join(rare, "term").join(phrases.select(key, F.size("terms").alias("width")), key).select(
        key, "doc_id", "text_hash", F.col("place").alias("anchor"), reach.alias("reach"), F.explode(F.array(
            F.floor(F.col("place") / reach) - 1, F.floor(F.col("place") / reach), F.floor(F.col("place") / reach) + 1)).alias("cell")).distinct()
    posts = index.join(terms, "term").select(key, "doc_id", "text_hash", "place", "term", F.floor(F.col("place") / reach).alias("cell"))
    near = anchors.alias("a").join(posts.alias("p"), (F.col(f"a.{key}") == F.col(f"p.{key}")) & (F.col("a.text_hash") == F.col("p.text_hash"))
                                   & F.col("a.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("a.cell") == F.col("p.cell")))
    near = near.filter("abs(p.place - a.anchor) < a.reach").select(*[F.col(f"a.{c}") for c in (key, "doc_id", "text_hash", "anchor", "reach")], "p.place", "p.term")
    hood = near.groupBy(key, "doc_id", "text_hash", "anchor", "reach").agg(F.sort_array(F.collect_set(F.struct("place", "term"))).alias("all"))
    # at most two reaches of places around an anchor: one bounded array
    starts = hood.join(need, key).select("*", F.explode("all").alias("s")).withColumn(
        "inside", F.filter("all", lambda x: (x["place"] >= F.col("s.place")) & (x["place"] < F.col("s.place") + F.col("reach"))))
    full = starts.filter(F.size(F.array_distinct(F.col("inside.term"))) == F.col("need"))
    firsts = F.transform(F.array_distinct(F.col("inside.term")), lambda t: F.array_min(F.transform(F.filter(
        F.col("inside"), lambda x: x["term"] == t), lambda x: x["place"])))
    found = full.select(key, "doc_id", "text_hash", F.col("s.place").alias("first"), F.array_max(firsts).alias("last"))
    return found.groupBy(key, "doc_id", "text_hash", "last").agg(F.max("first").alias("first")).select(key, "doc_id", "text_hash", "first", "last")


def windows(benchmark: DataFrame, width: int = 10) -> tuple[DataFrame, DataFrame]:
    """``(phrase, terms, text)`` of distinct windows and ``(phrase, item_id)``.

    A shorter item is one window; items without words have none. Windows of an item without an id are
    searched like any other, and name no item.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - width))
    cut = items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, width))).alias("terms"))
    cut = cut.withColumn("text", F.array_join("terms", " ")).withColumn("phrase", F.xxhash64("text")).distinct()
    cut = stage(cut, "windows")
    return cut.select("phrase", "terms", "text").dropDuplicates(["phrase"]), cut.filter("item_id IS NOT NULL").select("phrase", "item_id")


def window_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> tuple[DataFrame, DataFrame]:
    """Exact occurrences: ``(doc_id, text_hash, n_hit, phrases)`` and ``(phrase, item_id)``.

    Starts that the rarest terms leave are compared with the words of their document.
    """
    phrases, owners = windows(benchmark, width)
    vocabulary = stage(phrases.select(F.explode("terms").alias("term")).distinct(), "terms")
    index = build_index(docs, vocabulary)
    starts = stage(phrase_starts(phrases, index), "starts")
    texts = phrases.select("phrase", "text", F.size("terms").alias("n"))
    wanted = starts.join(F.broadcast(texts) if texts.count() <= SENT_ROWS else texts, "phrase")
    grouped = wanted.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(
        F.sort_array(F.collect_set(F.struct("start", "n", "text", "phrase"))).alias("maybe"))
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(
        grouped, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
    # words come before the aggregation, so that they are made once a text and not once a start
    own = own.select("doc_id", "text_hash", words(F.col("text")).alias("w"), "maybe").dropDuplicates(["doc_id", "text_hash"])
    hits = F.filter("maybe", lambda m: F.array_join(F.slice(F.col("w"), m["start"] + 1, m["n"]), " ") == m["text"])
    exact = own.select("doc_id", "text_hash", hits.alias("hits")).filter("size(hits) > 0")
    # hits are sorted by start: words past the furthest end so far are new
    covered = F.aggregate("hits", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda s, x: F.struct(
        F.greatest(s["end"], x["start"] + x["n"]).alias("end"),
        (s["n"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(s["end"], x["start"]))).cast("long").alias("n")))
    hits = stage(exact.select("doc_id", "text_hash", covered["n"].alias("n_hit"), F.array_distinct(F.col("hits.phrase")).alias("phrases")), "hits")
    unstage(index, starts, vocabulary)
    return hits, owners


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` of every row.

    ``items_sha256`` is that of the sorted item ids, joined by commas. Null and wordless texts have
    no words and are clean, as is everything against an empty benchmark. Repeated rows get the same
    result each.
    """
    hits, owners = window_hits(docs, benchmark, width)
    pairs = hits.select("doc_id", "text_hash", F.explode("phrases").alias("phrase")).join(owners, "phrase")
    items = pairs.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    found = hits.select("doc_id", "text_hash", "n_hit").join(items.withColumnsRenamed({"doc_id": "d", "text_hash": "h"}),
                                                             F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    found = stage(found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items")), "found")
    n_words = F.coalesce(F.regexp_count("text", F.lit(ANY_CASE_WORD)), F.lit(0))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), n_words.cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The clean rows with their own columns, whatever their names.

    Null and wordless texts are clean, as is everything against an empty benchmark; benchmark items
    with a null id count. Equal rows stay or go together, with a null id too.
    """
    with scratch() as kept:
        hits, _ = window_hits(docs, benchmark, width)
        kept.append(hits)
    marked = hits.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    own = docs.select(row.alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"))
    clean = own.join(marked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left_anti")
    return clean.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
