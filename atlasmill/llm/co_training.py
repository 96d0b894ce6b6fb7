"""Quality classifier by co-training.

Two views of a document have a classifier each: the content of the text, and the metadata of its
page (source, language, length, and the layout of its lines). Both start from labelled rows. In
each round a view labels every document it is sure of for the other view, as counts of features
that are summed in Spark; afterwards the views are calibrated on held-out labels, and their
calibrated log-odds are added to score every document.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasmill.llm import linear
from atlasmill.llm.common import fold, stage, unstage

_LETTERS = re.compile(r"[^\W\d_]+")


def _tenth(part: float, whole: float) -> int:
    return min(9, int(10 * part / whole)) if whole else 0


def content(text: str | None) -> set[str]:
    """Words, endings in signs, and how much of a text is repeated, in capitals or signs."""
    words = text.split() if text else []
    out = set(_LETTERS.findall(text.lower())) if text else set()
    ends = [w[-2:] for w in words if len(w) > 1 and not (w[-1].isalnum() or w[-2].isalnum())]
    out |= {"end:" + e for e in ends}
    n = len(words)
    out |= {f"same:{_tenth(sum(a == b for a, b in zip(words, words[1:])), n)}", f"capitals:{_tenth(sum(w.isupper() and len(w) > 1 for w in words), n)}",
            f"signs:{_tenth(sum(not any(map(str.isalnum, w)) for w in words) + len(ends), n)}", f"distinct:{_tenth(len(set(words)), n)}"}
    return out


def metadata(text: str | None, source: str | None, lang: str | None, n_chars: int | None) -> set[str]:
    """Record fields, and the layout of the page's lines; words are not looked at."""
    lines = text.split("\n") if text else []
    long = [len(x) for x in lines if x]
    log = lambda x: int(math.log2(x + 1))
    return {f"source:{source}", f"lang:{lang}", f"chars:{log(n_chars or 0)}", f"lines:{log(len(long))}", f"longest:{log(max(long, default=0))}",
            f"mean:{log(sum(long) / len(long)) if long else 0}", f"chars:{log(n_chars or 0)} lines:{log(len(long))}"}


def _packed(found: list[int]) -> bytes:
    """A feature list as bytes; sorted, so that equal texts have equal bytes."""
    return np.array(sorted(found), "<i4").tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<i4").astype(np.int64)


def _log_odds(w: np.ndarray, lists: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of every list, and the features of all lists with the number of their list."""
    flat = _unpacked(b"".join(lists))
    owner = np.repeat(np.arange(len(lists)), [len(x) // 4 for x in lists])
    return np.bincount(owner, w[flat], len(lists)) + w[-1], flat, owner


def _scored(rows: DataFrame, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Adds ``za`` and ``zb``, the log-odds of both views."""
    given = rows.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType([*rows.schema.fields, T.StructField("za", T.DoubleType()), T.StructField("zb", T.DoubleType())])
    names = rows.columns

    def run(batches):
        for batch in batches:
            z = [pa.array(_log_odds(w, batch.column(names.index(c)).to_pylist())[0], pa.float64()) for w, c in zip(given.value, "ab")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *z], names=[*names, "za", "zb"])

    return rows.mapInArrow(run, schema)


def hand_over(pool: DataFrame, weights: tuple[np.ndarray, np.ndarray], sure: float) -> dict[str, np.ndarray]:
    """What each view learns from the other: rows of ``pool(a, b)`` with each of its features, by label.

    A row counts for a view when the other view is sure of its label. ``[0]`` has the rows labelled 0, ``[1]``
    those labelled 1; the last column counts all. Tasks count before the shuffle, so only sums reach the driver.
    """
    given, edge = pool.sparkSession.sparkContext.broadcast(weights), math.log(sure / (1 - sure))
    widths = [len(w) for w in weights]

    def count(batches):
        sums = [np.zeros((2, n), np.int64) for n in widths]
        for batch in batches:
            views = [_log_odds(w, batch.column(k).to_pylist()) for k, w in enumerate(given.value)]
            for own, (z, _, _), (_, flat, owner) in zip(sums, reversed(views), views):
                for y, chosen in enumerate((z <= -edge, z >= edge)):
                    own[y] += np.append(np.bincount(flat[chosen[owner]], minlength=own.shape[1] - 1), chosen.sum())
        for view, own in zip("ab", sums):
            k = np.flatnonzero(own.any(0))
            yield pa.RecordBatch.from_arrays([pa.array([view] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(own[0][k]), pa.array(own[1][k])], names=["view", "k", "zeros", "ones"])

    out = {v: np.zeros((2, n), np.int64) for v, n in zip("ab", widths)}
    sums = pool.select("a", "b").mapInArrow(count, "view string, k int, zeros long, ones long").groupBy("view", "k")
    for r in sums.agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).collect():  # at most the features of both views
        out[r.view][:, r.k] = r.zeros, r.ones
    return out


def evidence(counts: np.ndarray) -> np.ndarray:
    """Log-odds of each feature by counts as of ``hand_over``; the constant is left to the fit."""
    share = np.log((counts[:, :-1] + 0.5) / (counts[:, -1:] + 1.0))
    return np.append(share[1] - share[0], 0.0)


def score_quality(docs: DataFrame, labels: DataFrame, rounds: int = 3, sure: float = 0.95,
                  bound: int = 20_000, vocabulary: int = 4096, folds: int = 5) -> DataFrame:
    """``(doc_id, held_out, content_score, metadata_score, score, predicted)`` of every row; score: chance of good quality.

    At most ``bound`` labelled rows, those with the smallest hashes of their ids, are used; those of
    fold 0 calibrate, the others train. A round hands over all documents without a used label that a view puts above the chance
    ``sure`` for one of the labels, however many; each round counts them anew by the weights of the last, so none counts twice, and
    documents with the same features in both views count as one. The labelled rows decide how much the counts are
    trusted. Nulls count as values of their own; null texts are empty.
    Without labels of both kinds every score is one half. Repeated rows get equal scores; of labels that repeat the smallest counts.
    """
    sc = docs.sparkSession.sparkContext
    marked = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("y"))
    chosen = linear.bounded_sample(marked, bound).withColumn("held_out", fold("doc_id", folds) == 0)
    rows = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    sample = rows.join(F.broadcast(chosen), "doc_id")
    train = sample.filter("NOT held_out")
    names_a = [f for f, *_ in linear.associated(train.select("y", "text"), content, vocabulary, strength=20.0)]
    names_b = [f for f, *_ in linear.associated(train.select("y", "text", "source", "lang", "n_chars"), metadata, vocabulary, least=1, strength=0.0)]
    known = sc.broadcast(({f: k for k, f in enumerate(names_a)}, {f: k for k, f in enumerate(names_b)}))

    def views(batches):
        a, b = known.value
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            one = [_packed([a[f] for f in content(t) if f in a]) for t in cols[1]]
            two = [_packed([b[f] for f in metadata(*x) if f in b]) for x in zip(*cols[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(one, pa.binary()), pa.array(two, pa.binary())], names=["doc_id", "a", "b"])

    seen = stage(rows.mapInArrow(views, T.StructType([docs.schema["doc_id"], T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])), "views")
    labelled = seen.join(F.broadcast(chosen), "doc_id").select("a", "b", "y", "held_out").collect()  # the bounded sample
    held = [r for r in labelled if r.held_out]
    taught = [r for r in labelled if not r.held_out]
    mine = {v: [_unpacked(getattr(r, v)) for r in taught] for v in "ab"}
    truth = np.array([float(r.y > 0) for r in taught])
    width = {"a": len(names_a), "b": len(names_b)}
    own = {v: np.array([np.append(np.bincount(np.concatenate([x for x, t in zip(mine[v], truth) if t == y] or [np.zeros(0, np.int64)]), minlength=width[v]), (truth == y).sum())
                        for y in (0.0, 1.0)]) for v in "ab"}

    def fitted(handed=None):
        lead = {v: evidence(own[v] + handed[v]) if handed and handed[v][:, -1].any() else None for v in "ab"}
        return tuple(linear.fit(mine[v], truth, width[v], ridge=0.5, lead=lead[v]) if taught else np.zeros(width[v] + 1) for v in "ab")

    weights = fitted()
    if names_a and names_b and rounds:
        pool = stage(seen.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti").select("a", "b").distinct(), "pool")
        for _ in range(rounds):
            weights = fitted(hand_over(pool, weights, sure))
        unstage(pool)
    y = np.array([float(r.y > 0) for r in held])
    base = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    prior = math.log(base / (1 - base))
    curves = []
    for v, w in zip("ab", weights):
        z = _log_odds(w, [bytes(getattr(r, v)) for r in held])[0]
        curves.append(linear.calibrate(z, y) if len(held) else (1.0, 0.0))
    (sa, ca), (sb, cb) = curves
    za, zb = F.col("za") * sa + ca, F.col("zb") * sb + cb
    chance = lambda z: F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))
    # two calibrated chances share the prior: it counts once
    score = chance(za + zb - prior)
    return _scored(seen, weights).select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), chance(za).alias("content_score"), chance(zb).alias("metadata_score"),
                                         score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
