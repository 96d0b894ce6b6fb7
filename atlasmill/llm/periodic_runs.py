"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period ``q`` that holds ``power`` periods and ``least``
words and that no neighbouring word extends. Spark deals the documents; inside a task the words of
some 200,000 words of documents stand in one array, with words numbered anew in each document, so
that nothing matches across documents.

* Prefix doubling sorts the suffixes. After the round for ``B`` words each aligned block of ``B``
  words has its range in the suffix array; suffixes that are already alone drop out.
* A wavelet tree over the suffix array answers range successor queries: of a block at ``p``, the
  first, second and last occurrence that starts in ``p + B .. p + 2B - 1`` (at the smallest ``B``
  also the first in ``p + 1 .. p + B - 1``).
* A run with period ``B <= q < 2B`` holds an aligned block and its copy ``q`` words on. Up to two
  occurrences in the window give ``q`` at once. More of them are an arithmetic progression, whose
  difference is the block's own period; then ``q`` is the distance between the left or the right
  ends of the stretches with that period around the block and around the progression.
* Each candidate is extended word by word in both directions, once for each stretch and period.
  Of the periods found for one stretch the smallest counts.

There are at most three candidates a block and ``n / 4`` blocks, so work is ``O(n log n)`` and
memory linear in one document, however periodic it is.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasmill.llm.common import SPACE

AT_ONCE = 200_000


class Wavelet:
    """Wavelet tree of a permutation of ``0 .. m - 1``, stored as one bit row a level (a wavelet matrix)."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for bit in reversed(range(max(1, int(len(values) - 1).bit_length()))):
            ones = (values >> bit) & 1
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(1 - ones, out=before[1:])
            self.levels.append((bit, before, int(before[-1])))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def below(self, lo: np.ndarray, hi: np.ndarray, v: np.ndarray) -> np.ndarray:
        """How many values of each range are below ``v``."""
        lo, hi, count = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)
        over = v >= 1 << len(self.levels)
        for bit, before, zeros in self.levels:
            a, b = before[lo], before[hi]
            one = (v >> bit) & 1 == 1
            count += np.where(one, b - a, 0)
            lo, hi = np.where(one, zeros + lo - a, a), np.where(one, zeros + hi - b, b)
        return np.where(over, -1, count)

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank ``k`` in each range."""
        lo, hi, k, value = lo.copy(), hi.copy(), k.copy(), np.zeros(len(lo), np.int64)
        for bit, before, zeros in self.levels:
            a, b = before[lo], before[hi]
            one = k >= b - a
            value |= np.where(one, 1 << bit, 0)
            k = np.where(one, k - (b - a), k)
            lo, hi = np.where(one, zeros + lo - a, a), np.where(one, zeros + hi - b, b)
        return value


def sorted_suffixes(ids: np.ndarray, first: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """``(slot of every suffix in the suffix array, [(B, places, low, high)])`` for block lengths from ``first`` on.

    ``places`` are the multiples of ``B`` whose block occurs more than once, ``low .. high`` its
    range in the suffix array. All suffixes must differ, as unique ends of documents make them.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    slot, size, blocks = np.empty(n, np.int64), np.empty(n, np.int64), []
    keys, base, open_ = ids[order], np.arange(n), order
    length = 1
    while True:
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(heads, len(keys)))
        slot[open_] = np.repeat(base[heads], sizes)
        size[open_] = np.repeat(sizes, sizes)
        open_ = np.sort(open_[size[open_] > 1])
        if length >= first:
            places = open_[open_ % length == 0]
            blocks.append((length, places, slot[places], slot[places] + size[places]))
        if not len(open_):
            return slot, blocks
        after = slot[np.minimum(open_ + length, n - 1)]
        keys = slot[open_] * n + after  # an open suffix never reaches past the last word
        order = np.argsort(keys, kind="stable")
        open_, keys = open_[order], keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] // n != keys[:-1] // n]))
        base = slot[open_] + np.arange(len(open_)) - np.repeat(starts, np.diff(np.append(starts, len(open_))))
        length *= 2


def agreeing(ids: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from ``i`` and from ``j`` on agree, to the right or to the left of both."""
    done, width = 0, 64
    while True:
        if step > 0:
            a, b = ids[i + done:i + done + width], ids[j + done:j + done + width]
            a = a[:len(b)]
        else:
            a, b = ids[max(0, i - done - width):max(0, i - done)][::-1], ids[max(0, j - done - width):max(0, j - done)][::-1]
            b = b[:len(a)]
        unlike = np.flatnonzero(a != b)
        if len(unlike):
            return done + int(unlike[0])
        done += len(a)
        if len(a) < width:
            return done
        width = min(width * 2, 1 << 16)


class Stretches:
    """Maximal stretches in which words ``period`` apart agree, each extended once."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.known = ids, {}

    def around(self, place: int, period: int) -> tuple[int, int]:
        known = self.known.setdefault(period, [])
        k = bisect_right(known, (place, len(self.ids) + 1)) - 1
        if k >= 0 and known[k][1] > place + period:
            return known[k]
        low = place - agreeing(self.ids, place, place + period, -1)
        high = place + period + agreeing(self.ids, place, place + period, 1)
        insort(known, (low, high))
        return low, high


def find_runs(ids: np.ndarray, least: int, power: int) -> list[tuple[int, int, int]]:
    """``(start, end, period)`` of the runs of an array whose documents end with unique words."""
    first = 1 << ((least + 1) // 3).bit_length() - 1
    slot, blocks = sorted_suffixes(ids, first)
    if not blocks or not len(blocks[0][1]):
        return []
    # only suffixes that share their first block with another one can be asked for
    asked = np.zeros(len(ids), bool)
    low, high = blocks[0][2], blocks[0][3]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, np.unique(low), 1)
    np.add.at(edge, np.unique(high), -1)
    asked[np.cumsum(edge[:-1]) > 0] = True
    suffixes = np.empty(len(ids), np.int64)
    suffixes[slot] = np.arange(len(ids))
    slots = np.flatnonzero(asked)
    places = np.sort(suffixes[slots])
    tree = Wavelet(np.searchsorted(places, suffixes[slots]))
    stretches, found = Stretches(ids), {}

    def consider(place: int, period: int) -> None:
        if period > 0:
            start, end = stretches.around(place, period)
            if end - start >= max(least, power * period):
                found[start, end] = min(period, found.get((start, end), period))

    for length, at, low, high in blocks:
        low, high = np.searchsorted(slots, low), np.searchsorted(slots, high)
        windows = [(length, 2 * length)] if length > first else [(1, length), (length, 2 * length)]
        for near, far in windows:
            below = tree.below(low, high, np.searchsorted(places, at + near))
            below = np.where(below < 0, high - low, below)
            until = tree.below(low, high, np.searchsorted(places, at + far))
            until = np.where(until < 0, high - low, until)
            hit = np.flatnonzero(until > below)
            if not len(hit):
                continue
            lo, hi, k, end = low[hit], high[hit], below[hit], until[hit]
            one = places[tree.smallest(lo, hi, k)]
            two = places[tree.smallest(lo, hi, np.minimum(k + 1, end - 1))]
            last = places[tree.smallest(lo, hi, end - 1)]
            for p, f, s, e in zip(at[hit].tolist(), one.tolist(), two.tolist(), last.tolist()):
                if near < length or e == s:  # the block itself belongs to the nearest progression
                    consider(p, f - p)
                    if s != f:
                        consider(p, s - p)
                else:
                    here, there = stretches.around(p, s - f), stretches.around(f, s - f)
                    for a, b in zip(here, there):
                        if length <= b - a < 2 * length and agreeing(ids, p, p + b - a, 1):
                            consider(p, b - a)
    return [(start, end, period) for (start, end), period in sorted(found.items())]


def periodic_runs(docs: DataFrame, least: int = 24, power: int = 3) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (array of start, length, period by start, then period) and ``collapsed``.

    ``collapsed`` is the text with each run cut down to its first period, words joined by one space.
    Words are what stands between ASCII white space, compared as they are. A null text has no words,
    no runs and an empty ``collapsed``. Rows are independent, so repeated rows and null ids are kept
    as they are; input columns of the three names are replaced. An empty table gives an empty result.
    """
    if least < 2 or power < 3:
        raise ValueError("least must be at least 2 and power at least 3")
    given = docs.drop("n_words", "runs", "collapsed")
    run_type = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
    schema = T.StructType([*given.schema.fields, T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(run_type)), T.StructField("collapsed", T.StringType())])
    at_text = given.columns.index("text")
    arrow_runs = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

    def settle(texts: list[list[str]]) -> tuple[list[list[dict]], list[str]]:
        ids, starts, total, fresh = [], [], 0, 0
        for words in texts:
            seen: dict[str, int] = {}
            ids.extend([fresh + seen.setdefault(w, len(seen)) for w in words])
            fresh += len(seen)
            ids.append(fresh)  # a unique end
            starts.append(total)
            total += len(words) + 1
            fresh += 1
        runs: list[list[dict]] = [[] for _ in texts]
        cut: list[list[tuple[int, int]]] = [[] for _ in texts]
        for start, end, period in sorted(find_runs(np.array(ids, np.int64), least, power), key=lambda r: (r[0], r[2])):
            k = bisect_right(starts, start) - 1
            runs[k].append({"start": start - starts[k], "length": end - start, "period": period})
            cut[k].append((start - starts[k] + period, end - starts[k]))
        out = []
        for words, spans in zip(texts, cut):
            if spans:
                keep = np.ones(len(words), bool)
                for a, b in spans:
                    keep[a:b] = False
                words = [words[i] for i in np.flatnonzero(keep)]
            out.append(" ".join(words))
        return runs, out

    def run(batches):
        for batch in batches:
            texts = batch.column(at_text)
            k = 0
            while k < batch.num_rows:
                group, total, start = [], 0, k
                while k < batch.num_rows and (not group or total < AT_ONCE):
                    # split() without arguments would also split at other white space
                    words = [w.decode() for w in (texts[k].as_py() or "").encode().split()]
                    group.append(words)
                    total += len(words)
                    k += 1
                runs, collapsed = settle(group)
                part = batch.slice(start, len(group))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([len(words) for words in group], pa.int64()), pa.array(runs, arrow_runs),
                     pa.array(collapsed, pa.string())], names=schema.names)

    return given.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(given.columns)]).mapInArrow(run, schema)


def loop_tails(docs: DataFrame) -> DataFrame:
    """``docs`` in which every tenth document, by crc32 of its id, repeats a stretch of words to its end.

    With ``h`` the checksum and ``g = h div 10``, word ``i >= a = g mod n`` becomes word
    ``a + (i - a) mod p`` with ``p = 1 + (n - a) div (3 + g mod 8)``. Other texts, those without
    words and those of null ids stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "")

    def looped(ws):
        g, n = F.floor(h / 10), F.size(ws)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ws, place(i).cast("int"))), " ")

    # the array of one element binds the words, so that they are made once a text
    text = F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, looped(ws)).otherwise(F.lit("")))[0]
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").isNotNull(), text).otherwise(F.col("text")))


def run_digest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` after ``loop_tails``: its strongest run and digests of its runs and of what is kept.

    The strongest run has the greatest length over period, compared exactly; of equals the first,
    then the one with the smaller period. Without runs its four columns are null.
    """
    found = periodic_runs(loop_tails(docs.select("doc_id", "text")))
    better = F.array_sort("runs", lambda a, b: (
        F.when(a.length * b.period > b.length * a.period, -1).when(a.length * b.period < b.length * a.period, 1)
        .when(a.start != b.start, F.when(a.start < b.start, -1).otherwise(1))
        .when(a.period < b.period, -1).when(a.period > b.period, 1).otherwise(0)))
    best = F.get(better, F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"),
                                                               F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    digest = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                          F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return digest.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                         F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                         "runs_sha256", "collapsed_sha256")
