"""Toxicity by weak supervision.

Voters look at a text: lexicons of words and of word stems, and patterns of writing. A generative
label model estimates how often each voter fires on toxic and on other texts, and which voters
fire together beyond that, from the vote patterns of all texts open to learning. Its posterior
labels train a linear classifier, which scores every text. Label, language, source and id are no
inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasmill.llm import linear
from atlasmill.llm.common import fold

WORD = re.compile(r"[^\W\d_]+")
SHOUTED = re.compile("[A-Z]+")
STEMS = (4, 5, 6, 7)
#: Lexicons are mined from this many disjoint parts of the labelled sample, so they err independently.
PARTS = 2
#: Voters of each part: precise words, other words, precise stems, other stems. With the patterns at most 2 ** 12 vote patterns exist.
KINDS = 4
#: A precise entry is so many times as frequent in toxic rows, and stands in such a share of them.
PRECISE = (30.0, 0.005)

#: Entries stand in so many rows, with such a log-likelihood ratio, so many times as often in toxic rows.
LEAST, STRENGTH, RATIO = 4, 16.0, 8.0

#: Information in nats that makes a tie between two voters; weaker ones count as none.
TIE = 0.002


def features(text: str | None) -> set[str]:
    """Words, and stems of words as ``^stem``."""
    words = set(WORD.findall(text.lower())) if text else set()
    return words | {"^" + w[:k] for w in words for k in STEMS if len(w) > k}


def patterns(text: str | None, hits: int) -> list[bool]:
    """Ways of writing: shouting, strings of exclamation marks, and several or dense finds."""
    text = text or ""
    upper = len(text) - len(SHOUTED.sub("", text))
    return [upper * 2 > len(text), text.count("!!") * 100 > len(text) > 0, hits >= 3, hits * 400 >= len(text) > 0 and hits > 0]


def voter_of(part: int, name: str, ratio: float, share: float) -> int:
    """Voter of an entry of a part's lexicon, by what it is and how precise."""
    return part * KINDS + 2 * (name[0] == "^") + (ratio < PRECISE[0] or share < PRECISE[1])


def votes(text: str | None, lexicon: dict[str, tuple[int, int]]) -> tuple[int, list[int]]:
    """Bits of the voters that fire, and the numbers of the lexicon's entries in the text."""
    found = [lexicon[f] for f in features(text) if f in lexicon]
    bits = 0
    for _, voters in found:
        bits |= voters
    for k, fires in enumerate(patterns(text, len(found))):
        bits |= fires << (PARTS * KINDS + k)
    return bits, [k for k, _ in found]


VOTERS = PARTS * KINDS + len(patterns("", 0))


class LabelModel:
    """Latent class with a tree of dependences between the voters.

    ``fire[y, j, u]``: chance that voter j fires for class y when its parent in the tree does (u =
    1) or does not; accuracies are the case without parent. The tree joins the voters that carry
    most information about each other within a class.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 60, known: np.ndarray | bool = False):
        """``start``: first guess of the posterior of each pattern, -1 where there is none; it stays where it is ``known``."""
        v = ((patterns[:, None] >> np.arange(VOTERS)) & 1).astype(float)
        any_vote = np.where(patterns > 0, 0.5, 0.05)
        post = np.where(start >= 0, start, any_vote)
        self.parent = np.full(VOTERS, -1)
        for step in range(rounds):
            weight = np.stack([counts * (1 - post), counts * post])
            self.prior = (weight[1].sum() + 1) / (counts.sum() + 2)
            if step >= rounds // 2:  # classes settle first, else their ties look like ties of voters
                self.parent = self._tree(v, weight)
            up = np.where(self.parent >= 0, v[:, np.maximum(self.parent, 0)], 0.0)
            self.fire = np.zeros((2, VOTERS, 2))
            for y in range(2):
                for u in range(2):
                    w = weight[y][:, None] * (up == u)
                    self.fire[y, :, u] = ((w * v).sum(0) + 0.5) / (w.sum(0) + 1)
            post = np.where(known, start, self.posterior(patterns))

    def _tree(self, v: np.ndarray, weight: np.ndarray) -> np.ndarray:
        info = np.zeros((VOTERS, VOTERS))
        total = weight.sum()
        for w in weight:
            n = w.sum() + 1
            one = (w[:, None] * v).sum(0)
            both = np.einsum("p,pi,pj->ij", w, v, v)
            for a in range(2):
                for b in range(2):
                    joint = both if a and b else one[:, None] - both if a else one[None] - both if b else n - one[:, None] - one[None] + both
                    pa_, pb = (one if a else n - one)[:, None], (one if b else n - one)[None]
                    info += np.maximum(joint, 0) / total * np.log((np.maximum(joint, 0) + 0.5) * n / ((pa_ + 0.5) * (pb + 0.5)))
        parent, joined = np.full(VOTERS, -1), {0}
        while len(joined) < VOTERS:
            i, j = max(((i, j) for i in joined for j in range(VOTERS) if j not in joined), key=lambda x: (info[x], -x[1]))
            if info[i, j] > TIE:
                parent[j] = i
            joined.add(j)
        return parent

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        v = (patterns[:, None] >> np.arange(VOTERS)) & 1
        up = np.where(self.parent >= 0, v[:, np.maximum(self.parent, 0)], 0)
        score = np.zeros(len(patterns))
        for y, sign in ((1, 1), (0, -1)):
            p = self.fire[y, np.arange(VOTERS), up]
            score += sign * np.log(np.where(v == 1, p, 1 - p)).sum(1)
        return 1 / (1 + np.exp(-np.clip(score + math.log(self.prior / (1 - self.prior)), -40, 40)))


def learn(docs: DataFrame, labels: DataFrame, open_: Column, bound: int = 20_000, vocabulary: int = 4096) -> dict:
    """Lexicons, label model and classifier from the rows for which ``open_`` holds.

    Labels, of at most ``bound`` rows, pick the lexicons, give the label model its first guess and
    set the scale of the scores. Accuracies and ties of voters come from the vote patterns of all
    open rows. The classifier is fitted on the label model's posteriors of at most ``bound`` open
    rows, labelled or not. Both samples are the rows with the smallest hashes of their ids.
    ``vocabulary`` bounds the lexicons together.
    """
    sc = docs.sparkSession.sparkContext
    marked = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    chosen = linear.bounded_sample(marked.filter(open_), bound)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    voters: dict[str, int] = {}
    for part in range(PARTS):
        own = sample.filter(F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(PARTS)) == part).select("y", "text")
        for name, ratio, share in linear.associated(own, features, vocabulary // PARTS, least=LEAST, strength=STRENGTH, ratio=RATIO):
            voters[name] = voters.get(name, 0) | 1 << voter_of(part, name, ratio, share)
    lexicon = sc.broadcast({name: (k, voters[name]) for k, name in enumerate(sorted(voters))})

    def rows(batches):
        for batch in batches:
            seen = [votes(t, lexicon.value) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b for b, _ in seen], pa.int64()),
                                              pa.array([sorted(f) for _, f in seen], pa.list_(pa.int32()))], names=["y", "bits", "found"])

    def seen_in(frame: DataFrame) -> list:
        """``(y, bits, found, n)`` of a bounded sample; rows that look alike come once."""
        kind = frame.schema["y"].dataType
        return (frame.select("y", "text").mapInArrow(rows, T.StructType([T.StructField("y", kind), T.StructField("bits", T.LongType()), T.StructField("found", T.ArrayType(T.IntegerType()))]))
                .groupBy("y", "bits", "found").agg(F.count(F.lit(1)).alias("n")).orderBy("y", "bits", "found").collect())

    labelled = seen_in(sample)
    picked = linear.bounded_sample(docs.filter(open_).filter("doc_id IS NOT NULL").select("doc_id").distinct(), bound)
    unlabelled = seen_in(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumn("y", F.lit(0)))

    def counted(batches):
        seen = Counter()
        for batch in batches:
            seen.update(votes(t, lexicon.value)[0] for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["bits", "n"])

    # at most 2 ** VOTERS rows
    free = docs.filter(open_).select("text").mapInArrow(counted, "bits long, n long").groupBy("bits").agg(F.sum("n").alias("n")).orderBy("bits").collect()
    if not labelled or not unlabelled:
        return {"lexicon": {}, "weights": np.array([-4.0])}
    ones, all_ = Counter(), Counter()
    for r in labelled:
        ones[r.bits] += r.n * (r.y > 0)
        all_[r.bits] += r.n
    start = np.array([(ones[r.bits] + (0.5 if r.bits else 0.05)) / (all_[r.bits] + 1) for r in free])
    seen = free + labelled
    model = LabelModel(np.array([r.bits for r in seen], np.int64), np.array([float(r.n) for r in seen]),
                       np.append(start, [float(r.y > 0) for r in labelled]), known=np.arange(len(seen)) >= len(free))
    soft = model.posterior(np.array([r.bits for r in unlabelled], np.int64))
    weights = linear.fit([np.array(r.found, np.int64) for r in unlabelled], soft, len(voters), np.array([float(r.n) for r in unlabelled]), ridge=0.05, rounds=800)
    # labels set the scale of the scores, not their order
    z = np.array([weights[-1] + weights[np.array(r.found, np.int64)].sum() for r in labelled])
    slope, constant = linear.calibrate(np.repeat(z, [r.n for r in labelled]), np.repeat([float(r.y > 0) for r in labelled], [r.n for r in labelled]))
    weights = weights * slope
    weights[-1] += constant
    return {"lexicon": lexicon.value, "weights": weights, "model": model}


def scores_of(texts: list[str | None], lexicon: dict[str, tuple[int, int]], weights: np.ndarray) -> np.ndarray:
    z = np.array([weights[-1] + sum(weights[lexicon[f][0]] for f in features(t) if f in lexicon) for t in texts], float)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score(docs: DataFrame, learnt: dict, held_out: Column, threshold: float = 0.7) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row; null and empty texts get the score of no find."""
    given = docs.sparkSession.sparkContext.broadcast((learnt["lexicon"], learnt["weights"]))

    def run(batches):
        for batch in batches:
            s = scores_of(batch.column(2).to_pylist(), *given.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Learn from fold 0 and 2 of 3 and score every row.

    Without labels of both kinds nothing is learnt and every score is low. Repeated rows get equal
    scores; of labels that repeat the largest counts. Rows with a null id are scored and counted in
    the vote patterns, but are in no sample.
    """
    held_out = fold("doc_id", 3) == 1
    return score(docs, learn(docs, labels, ~held_out), held_out, threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows with a score below the threshold, with their own columns; null and empty texts are scored as having no find."""
    learnt = learn(docs, labels, fold("doc_id", 3) != 1)
    given = docs.sparkSession.sparkContext.broadcast((learnt["lexicon"], learnt["weights"]))
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores_of(batch.column(place).to_pylist(), *given.value) < threshold))

    return docs.mapInArrow(run, docs.schema)
