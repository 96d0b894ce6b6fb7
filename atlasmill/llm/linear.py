"""Small linear classifiers over named binary features, fitted on a bounded sample of labelled rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, bound: int) -> DataFrame:
    """At most ``bound`` rows, those with the smallest hash of their id: the same ones in every run."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def associated(sample: DataFrame, features, bound: int, least: int = 3, strength: float = 12.0, ratio: float = 0.0) -> list[tuple[str, float, float]]:
    """``(name, ratio, share)`` of the features most tied to the label, by the log-likelihood ratio of a 2 x 2 table.

    ``features(text, ...)`` gives the set of feature names of a row; ``sample`` has the label as
    ``y`` first. Tasks count before the shuffle. At most ``bound`` names come to the driver.
    ``ratio`` of a feature: how many times as frequent it is where ``y`` is 1, half a row being added to
    the others; ``share``: how many of the rows with ``y`` = 1 have it. Smaller ratios are left out.
    """

    def count(batches):
        from collections import Counter
        ones, zeros = Counter(), Counter()
        for batch in batches:
            for y, *row in zip(*(c.to_pylist() for c in batch.columns)):
                (ones if y else zeros).update(features(*row))
        names = list(ones.keys() | zeros.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([ones[k] for k in names], pa.int64()),
                                          pa.array([zeros[k] for k in names], pa.int64())], names=["name", "a", "b"])

    total = sample.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("a"), F.count(F.lit(1)).alias("n")).first()
    n1, n0 = total.a, total.n - total.a
    if not n1 or not n0:
        return []
    sums = sample.mapInArrow(count, "name string, a long, b long").groupBy("name").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    both, all_ = a + b, float(n1 + n0)
    g = 2 * (term(a, both * n1 / all_) + term(b, both * n0 / all_)
             + term(n1 - a, (all_ - both) * n1 / all_) + term(n0 - b, (all_ - both) * n0 / all_))
    kept = sums.filter(both >= least).withColumn("g", g).filter(F.col("g") >= strength)
    kept = kept.withColumn("share", a / n1).withColumn("ratio", F.col("share") / ((b + 0.5) / n0)).filter(F.col("ratio") > ratio)
    return [(r.name, r.ratio, r.share) for r in kept.orderBy(F.desc("g"), "name").limit(bound).select("name", "ratio", "share").collect()]


def fit(rows: list[np.ndarray], y: np.ndarray, width: int, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 300,
        lead: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression with soft labels; the last weight is the constant. Nesterov steps on all rows.

    ``lead`` has weights found elsewhere: their score is one more input, whose own weight is fitted along and
    multiplied into the result.
    """
    lengths = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows).astype(np.int64) if len(rows) and lengths.sum() else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    weight = np.ones(len(rows)) if weight is None else weight
    led, middle, spread = np.zeros(len(rows)), 0.0, 1.0
    if lead is not None and len(rows):
        led = np.bincount(owner, lead[flat], len(rows)) + lead[-1]
        middle, spread = led.mean(), led.std() or 1.0
        led = (led - middle) / spread
    w, last = np.zeros(width + 2), np.zeros(width + 2)
    # a bound for the curvature: largest row norm times rows, eased by the features' own frequency
    scale = np.append(np.bincount(flat, weight[owner], width), [weight.sum(), (weight * np.abs(led)).sum()])
    scale = scale * (1 + (lengths.mean() + np.abs(led).mean() if len(rows) else 0)) / 4 + ridge
    for step in range(rounds):
        ahead = w + step / (step + 3) * (w - last)
        z = np.bincount(owner, ahead[flat], len(rows)) + ahead[-2] + ahead[-1] * led
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        slope = np.append(np.bincount(flat, error[owner], width) + ridge * ahead[:-2], [error.sum(), error @ led + ridge * ahead[-1]])
        last, w = w, ahead - slope / scale
    out, trust = w[:-1].copy(), w[-1] / spread
    if lead is not None:
        out += trust * lead
        out[-1] -= trust * middle
    return out


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and constant of a logistic curve through scores and labels (Platt), by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        r, s = p - y, p * (1 - p) + 1e-9
        g = np.array([(r * z).sum() + 1e-2 * (a - 1), r.sum()])
        h = np.array([[(s * z * z).sum() + 1e-2, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        a, b = a - np.clip(move[0], -2, 2), b - np.clip(move[1], -2, 2)
    return (a, b) if math.isfinite(a + b) and a > 0 else (1.0, 0.0)
