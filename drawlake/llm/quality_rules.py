"""Quality rules as a learned decision list.

Per-text statistics are plain Spark expressions. From a bounded sample of labelled
statistics, sequential covering grows one conjunction of thresholds after another (by
information gain on two thirds of the sample), prunes it on the other third, keeps it if it
is precise enough there, removes what it covers and goes on. The list is emitted as one
ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm.common import BLANKS, fold, one_text_each, table, words_of

#: The symbols that the contract counts.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What the rules may test, as functions of the statistics.
FEATURES = {
    "n_words": lambda c: c("n_words"),
    "mean_word": lambda c: c("word_chars") / F.greatest(c("n_words"), F.lit(1)),
    "symbols_per_word": lambda c: c("n_symbols") / F.greatest(c("n_words"), F.lit(1)),
    "capitals_per_char": lambda c: c("n_capitals") / F.greatest(c("word_chars"), F.lit(1)),
    "calls_per_word": lambda c: c("n_calls") / F.greatest(c("n_words"), F.lit(1)),
    "dup_lines_share": lambda c: c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)),
    "repeat_share": lambda c: c("n_repeat_words") / F.greatest(c("n_words"), F.lit(1)),
}


def text_statistics(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals
    and n_calls (marks ! and ?) to the rows of `docs`, next to doc_id and text."""
    text = F.coalesce("text", F.lit(""))
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    one = docs.select(
        *docs.columns,
        # A word is hashed once; windows of words hash these hashes.
        F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("_words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]")).alias("_lines"),
        F.length(F.translate(text, BLANKS, "")).cast("bigint").alias("word_chars"),
        without(SYMBOLS).cast("bigint").alias("n_symbols"),
        without(CAPITALS).cast("bigint").alias("n_capitals"),
        without("!?").cast("bigint").alias("n_calls"),
    )
    words = F.col("_words")
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - WINDOW)
    two = one.select(
        *[c for c in one.columns if c not in ("_words", "_lines")],
        n.cast("bigint").alias("n_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])))
        .otherwise(F.array().cast("array<bigint>")).alias("_windows"),
    )
    windows = F.col("_windows")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    three = two.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct(windows)) < F.size(windows),
            F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(none),
    ).drop("_windows")
    ordered = F.col("_sorted")
    twice = F.filter(ordered, lambda x, j: (F.get(ordered, j - 1)["h"] == x["h"]) | F.coalesce(F.get(ordered, j + 1)["h"] == x["h"], F.lit(False)))
    at = F.array_sort(F.transform(twice, lambda x: x["i"]))
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate(
        at, zero, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")), lambda acc: acc["n"]
    )
    return three.withColumn("n_repeat_words", F.when(F.size(ordered) > 0, covered).otherwise(F.lit(0).cast("bigint"))).drop("_sorted")


def base_failed(c=F.col) -> Column:
    return (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def column(self) -> Column:
        value = FEATURES[self.feature](F.col)
        return value >= self.threshold if self.above else value < self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    hit = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _thresholds(values: np.ndarray, most: int = 48) -> np.ndarray:
    distinct = np.unique(values)
    middle = (distinct[1:] + distinct[:-1]) / 2
    if len(middle) > most:
        middle = np.unique(np.quantile(middle, np.linspace(0, 1, most)))
    return middle


def grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition of greatest information gain until no good row is covered."""
    rule: list[Condition] = []
    live = np.ones(len(bad), bool)
    while (live & ~bad).any() and len(rule) < 4:
        p, n = int((live & bad).sum()), int((live & ~bad).sum())
        best, gain = None, 1e-9
        for f, v in x.items():
            for t in _thresholds(v[live]):
                for above in (True, False):
                    hit = live & (v >= t if above else v < t)
                    p1, n1 = int((hit & bad).sum()), int((hit & ~bad).sum())
                    if p1 and (g := p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p / (p + n)))) > gain:
                        best, gain = Condition(f, above, float(t)), g
        if best is None:
            break
        rule.append(best)
        live &= best.holds(x)
    return tuple(rule)


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop final conditions while that does not lower (p - n) / (p + n) on the pruning rows."""

    def worth(r: Rule) -> float:
        hit = covers(r, x)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray, least_precision: float = 0.9, least_cover: int = 5, most_rules: int = 12) -> list[Rule]:
    """Sequential covering. part: True for rows that grow a rule, False for those that prune
    it. A rule joins the list if on the pruning rows, with those it covers, at least
    `least_precision` of what it covers is bad."""
    rules: list[Rule] = []
    live = np.ones(len(bad), bool)
    while len(rules) < most_rules and (live & part & bad).sum() >= least_cover:
        g, p = live & part, live & ~part
        rule = grow({k: v[g] for k, v in x.items()}, bad[g])
        if not rule:
            break
        rule = prune(rule, {k: v[p] for k, v in x.items()}, bad[p])
        hit = covers(rule, x) & live
        test = hit & ~part
        if hit[part].sum() < least_cover or not test.any() or bad[test].mean() < least_precision or bad[hit].mean() < least_precision:
            break
        rules.append(rule)
        live &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional: false under the first rule that holds, else true."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Texts with a quality label from the learning folds: at most `most` rows, those with
    the smallest hash of the id. The id list is bounded by `most` and so can be broadcast."""
    ids = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    return one_text_each(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "doc_id", "quality")


def fit_rules(docs: DataFrame, labels: DataFrame, most: int = 12_000) -> list[Rule]:
    """Learn from at most `most` labelled documents. Null labels and null ids are left out, null
    and empty texts fail the base rule and teach nothing; of labels that repeat an id the least
    counts, of texts the one of least hash. Without labels, as with empty tables, the list is
    empty."""
    stats = text_statistics(labelled_sample(docs, labels, most)).withColumn("base_failed", base_failed())
    rows = stats.select("doc_id", "quality", "base_failed", *[f(F.col).cast("double").alias(k) for k, f in FEATURES.items()]).collect()
    rows = [r for r in rows if not r["base_failed"]]
    if not rows:
        return []
    rows.sort(key=lambda r: r["doc_id"])
    x = {k: np.array([r[k] for r in rows], float) for k in FEATURES}
    bad = np.array([r["quality"] == 0 for r in rows])
    return learn_rules(x, bad, np.array([r["doc_id"] % 3 != 0 for r in rows]))


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of `docs` with statistics, base_failed and kept.

    Null and empty texts have no words and so fail the base rule. Repeated rows are judged
    alike. An empty table stays empty. Columns of `docs` other than doc_id and text are
    left out, so none can clash with the statistics.
    """
    judged = text_statistics(docs.select("doc_id", "text")).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns, whatever their names.
    The numbers of judged and kept rows are observed as `quality_rules`, for listeners of the
    session; filters are not pushed below what is observed, so the statistics are computed
    once and not again for each use in the filter."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select("doc_id", "text", F.struct(*columns).alias("_row"))
    judged = text_statistics(packed).withColumn("base_failed", base_failed())
    judged = judged.withColumn("_kept", ~F.col("base_failed") & verdict(rules))
    judged = judged.observe("quality_rules", F.count(F.lit(1)).alias("judged"), F.count_if(F.col("_kept")).alias("kept"))
    return judged.filter("_kept").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit_rules(docs, table(spark, sf_dir, "labels"))
    return apply_rules(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
