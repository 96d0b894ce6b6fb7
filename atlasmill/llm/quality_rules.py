"""Quality rules as a learned decision list.

Sequential covering: a rule is a conjunction of thresholds on text statistics, grown on one part
of the labelled rows by information gain, pruned on another, and kept while it is precise there;
the rows it covers are set aside before the next rule. The list is an ordered conditional
expression. Every step is one small aggregation of bin counts over all labelled rows, so the
driver only sees histograms; only DataFrame and SQL functions are used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasmill.llm.common import LOWER, SPACE, UPPER, stage

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
#: What the rules look at; each is a share or a mean, so that long and short texts compare.
FEATURES = {
    "symbol_share": "n_symbols / nullif(n_words, 0)",
    "repeat_share": "n_repeat_words / nullif(n_words, 0)",
    "dup_line_share": "n_dup_lines / nullif(n_lines, 0)",
    "mean_word": "word_chars / nullif(n_words, 0)",
    "distinct_share": "n_distinct / nullif(n_words, 0)",
    "upper_share": "n_upper / nullif(word_chars, 0)",
    "exclaim_share": "n_exclaim / nullif(n_words, 0)",
    "digit_share": "n_digits / nullif(word_chars, 0)",
    "line_words": "n_words / nullif(n_lines, 0)",
}


@dataclass(frozen=True)
class Condition:
    """``feature > threshold`` or ``feature <= threshold``."""
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = F.expr(FEATURES[self.feature])
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _removed(text: Column, pattern: str) -> Column:
    """Code points that a pattern matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def statistics(docs: DataFrame, *carry: str) -> DataFrame:
    """Counts over each whole text; null texts count as empty. One row per document, no shuffle.

    A 3-word window is one string of three words, so equality is exact. Windows are sorted with
    their places inside the row; equal neighbours are windows found twice or more.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", *carry, text.alias("t")).select(
        "doc_id", *carry, "t", F.regexp_extract_all("t", F.lit(f"[^{SPACE}]+"), F.lit(0)).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines"))
    count = split.select(
        "doc_id", *carry, F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        _removed(F.col("t"), f"[{SYMBOLS}]").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        _removed(F.col("t"), "[A-Z]").cast("long").alias("n_upper"), _removed(F.col("t"), "!").cast("long").alias("n_exclaim"),
        _removed(F.col("t"), "[0-9]").cast("long").alias("n_digits"),
        F.sort_array(F.zip_with(
            F.zip_with("w", F.slice("w", 2, F.greatest(F.lit(0), F.size("w") - 1)), lambda a, b: F.concat_ws(" ", a, b)),
            F.transform(F.slice("w", 3, F.greatest(F.lit(0), F.size("w") - 2)), lambda c, i: F.struct(c.alias("c"), i.alias("i"))),
            lambda ab, c: F.when(c.isNotNull(), F.struct(F.concat_ws(" ", ab, c["c"]).alias("g"), c["i"].alias("i"))))).alias("grams"))
    # windows that end past the text are null and stand first
    near = F.zip_with(F.slice("grams", 1, F.greatest(F.lit(0), F.size("grams") - 1)), F.slice("grams", 2, F.greatest(F.lit(0), F.size("grams") - 1)),
                      lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
    places = count.withColumn("at", F.array_sort(F.array_distinct(F.flatten(F.filter(near, lambda x: x.isNotNull())))))
    covered = F.aggregate("at", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda s, i: F.struct(
        (i + 3).alias("end"), (s["n"] + 3 - F.greatest(F.lit(0), s["end"] - i)).cast("long").alias("n")))
    return places.withColumn("n_repeat_words", covered["n"]).drop("grams", "at")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _bin(feature: str, cuts: list[float]) -> Column:
    """Number of cuts below the value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda cut: cut < F.col(feature)))


class _Labelled:
    """Labelled statistics in bins, stored once; answers counts for conjunctions."""

    def __init__(self, rows: DataFrame, bins: int):
        shares = rows.select("bad", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("part"), *[F.expr(e).alias(f) for f, e in FEATURES.items()])
        marks = [k / bins for k in range(1, bins)]
        cuts = shares.agg(*[F.percentile_approx(f, marks, 10_000).alias(f) for f in FEATURES]).first()
        self.cuts = {f: sorted(set(cuts[f] or [])) for f in FEATURES}
        bin_of = {f: _bin(f, c).alias(f) for f, c in self.cuts.items()}
        self.rows = stage(shares.groupBy("bad", "part", *bin_of.values()).agg(F.count(F.lit(1)).alias("n")), "labelled")

    def where(self, rule) -> Column:
        out = F.lit(True)
        for f, above, b in rule:
            out = out & (F.col(f) > b if above else F.col(f) <= b)
        return out

    def histogram(self, rule, before) -> dict:
        """``{(feature, bin): (bad, good)}`` of the growing part under a conjunction."""
        rows = self.rows.filter((F.col("part") < 2) & self.where(rule))
        for old in before:
            rows = rows.filter(~self.where(old))
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES])).alias("x")
        counts = rows.select("bad", "n", pairs).groupBy("x.f", "x.b").agg(
            F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"), F.sum("n").alias("n")).collect()
        return {(r.f, r.b): (r.bad, r.n - r.bad) for r in counts}  # features times bins entries at most

    def judged(self, rule, before) -> list[tuple[int, int]]:
        """``(bad, good)`` of the pruning part for every beginning of the rule."""
        rows = self.rows.filter("part = 2")
        for old in before:
            rows = rows.filter(~self.where(old))
        cols = []
        for k in range(1, len(rule) + 1):
            inside = self.where(rule[:k])
            cols += [F.sum(F.when(inside & F.col("bad"), F.col("n")).otherwise(0)), F.sum(F.when(inside & ~F.col("bad"), F.col("n")).otherwise(0))]
        r = rows.agg(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()
        return [(r[2 * k] or 0, r[2 * k + 1] or 0) for k in range(len(rule))]


def _best(histogram: dict, bins: dict[str, list]) -> tuple | None:
    total_bad = sum(b for (f, _), (b, _) in histogram.items() if f == next(iter(FEATURES)))
    total_good = sum(g for (f, _), (_, g) in histogram.items() if f == next(iter(FEATURES)))
    if not total_bad or not total_good:
        return None
    old, found = math.log2(total_bad / (total_bad + total_good)), None
    for f in FEATURES:
        bad = good = 0
        for b in range(len(bins[f])):
            x = histogram.get((f, b), (0, 0))
            bad, good = bad + x[0], good + x[1]
            for above, p, n in ((False, bad, good), (True, total_bad - bad, total_good - good)):
                if p and (p, n) != (total_bad, total_good):
                    gain = p * (math.log2(p / (p + n)) - old)
                    if found is None or gain > found[0] + 1e-9:
                        found = gain, (f, above, b)
    return found[1] if found and found[0] > 0 else None


def learn(rows: DataFrame, bins: int = 64, longest: int = 3, most: int = 12, precision: float = 0.9, support: int = 5) -> list[Rule]:
    """Decision list from ``rows`` of statistics with a boolean ``bad``; empty if nothing is learnt.

    ``precision`` and ``support`` hold on the pruning part, a third of the rows by hash of the id.
    """
    data, found = _Labelled(rows, bins), []
    while len(found) < most:
        rule: list[tuple] = []
        while len(rule) < longest:
            best = _best(data.histogram(rule, found), data.cuts)
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        judged = data.judged(rule, found)
        value, length = max(((p - n) / (p + n) if p + n else -1.0, -k) for k, (p, n) in enumerate(judged, 1))
        p, n = judged[-length - 1]
        if p < support or p < precision * (p + n):
            break
        found.append(tuple(rule[:-length]))
    return [tuple(Condition(f, above, data.cuts[f][b]) for f, above, b in rule) for rule in found]


def expression(rules: list[Rule]) -> Column:
    """True where no rule rejects: rules are tried in order."""
    out = None
    for rule in rules:
        hit = rule[0].column()
        for condition in rule[1:]:
            hit = hit & condition.column()
        out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Base statistics, ``base_failed``, ``kept`` and the number of the rejecting rule of every row.

    Rules are learnt from all rows with a quality label that the base does not reject. Without
    such labels nothing but the base rejects. Null and empty texts have no words and fail the base.
    Repeated rows get one result each; repeated labels count each time they join.
    """
    counts = stage(statistics(docs), "statistics")
    marked = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (F.col("quality") == 0).alias("bad"))
    rules = learn(counts.filter(~base_failed()).join(marked, "doc_id"), **options)
    number = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        number = F.when(~expression([rule]), F.lit(k)).otherwise(number)
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
                         (~base_failed() & expression(rules)).alias("kept"), F.when(base_failed(), F.lit(0)).otherwise(number).alias("rule"))
