"""Quality rules as learned decision lists, in DataFrame operations only.

Sequential covering: grow a conjunction of thresholds that best separates low-quality
documents from the rest, prune it on rows it was not grown on, keep it if it is
precise, remove what it covers, and go on.  All counts come from Spark aggregates
over a bounded labelled sample; the result is an ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, bind, free, kept_columns, materialize, named, words_of

#: Labelled rows to learn from at most (those with the smallest hashes of doc_id).
MAX_TRAIN = 10_000
#: Thresholds a feature has (its quantiles), bounds of the list and of a rule, and what a rule takes: precision and
#: low-quality rows covered.
QUANTILES, MAX_RULES, MAX_CONDITIONS, MIN_PRECISION, MIN_COVERED = 16, 8, 3, 0.85, 8
SYMBOLS = "#*$%&|<>"
FEATURES = ("words", "mean_word", "symbols", "dup_lines", "repeats", "capitals", "digits", "marks", "distinct_words")


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more, the first occurrence included."""

    def count(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        several = F.transform(
            F.array(order),
            lambda s: F.sort_array(F.filter(
                F.transform(s, lambda e, k: F.when(
                    (F.get(s, k - 1)["x"] == e["x"]) | (F.get(s, k + 1)["x"] == e["x"]), e["i"])),
                lambda p: p.isNotNull())),
        )[0]
        # windows start at p: each covers three words, or as many as lie before the next
        covered = F.transform(
            F.array(several),
            lambda p: F.aggregate(
                F.transform(p, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - v, F.lit(3)))),
                F.lit(0), lambda a, x: a + x),
        )[0]
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered)

    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    return F.when(n < 3, 0).otherwise(F.transform(F.array(windows), count)[0])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_counts(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the contract's counts, ``base_failed`` and a struct of the learner's inputs, and that one's name.

    Words are runs without ASCII white space.  A null text has none; its ratios are 0.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    words, split, counts, into = free([*docs.columns, *COUNTS], "words", "lines", "counts", "inputs")

    def gone(chars: str) -> Column:  # how many characters of the text are in chars
        return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")

    step = bind(bind(docs, words, words_of(text)), split, lines)
    step = bind(step, counts, F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        gone(SYMBOLS).alias("n_symbols"),
        (F.size(split) - F.size(F.array_distinct(split))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col(words)).cast("long").alias("n_repeat_words"),
        F.size(split).alias("n_lines"),
        F.size(F.array_distinct(words)).alias("distinct"),
        gone("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("caps"),
        gone("0123456789").alias("digits"),
        gone("!?").alias("marks"),
    ))
    c = F.col(counts)

    def ratio(top: str, bottom: str) -> Column:
        return F.coalesce(F.try_divide(c[top], c[bottom]), F.lit(0.0)).cast("double")

    inputs = {
        "words": c["n_words"].cast("double"), "mean_word": ratio("word_chars", "n_words"), "symbols": ratio("n_symbols", "n_words"),
        "dup_lines": ratio("n_dup_lines", "n_lines"), "repeats": ratio("n_repeat_words", "n_words"), "capitals": ratio("caps", "word_chars"),
        "digits": ratio("digits", "word_chars"), "marks": ratio("marks", "n_words"), "distinct_words": ratio("distinct", "n_words"),
    }
    return step.select(
        *named(docs.columns), *[c[x].alias(x) for x in COUNTS[:-1]],
        ((c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])).alias("base_failed"),
        F.struct(*[inputs[f].alias(f) for f in FEATURES]).alias(into),
    ), into


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, inputs: Column) -> Column:
        c = inputs[self.feature]
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _all(rule: Rule, inputs: Column) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column(inputs)
    return out


def training_rows(docs: DataFrame, labels: DataFrame, bad: Column, max_rows: int = MAX_TRAIN) -> DataFrame:
    """``(doc_id, bad 0/1, inputs)`` of at most ``max_rows`` labelled documents that pass the base rules."""
    known = (
        labels.select("doc_id", bad.cast("int").alias("bad")).filter("doc_id is not null and bad is not null")
        .groupBy("doc_id").agg(F.max("bad").alias("bad"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    # at most max_rows rows of two numbers
    sample, inputs = base_counts(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))
    sample = sample.filter("not base_failed").select("doc_id", "bad", F.col(inputs).alias("inputs"))
    return materialize(sample.repartition(1), "quality")  # at most max_rows rows of numbers


def learn(rows: DataFrame, min_precision: float = MIN_PRECISION) -> list[Rule]:
    """Ordered conjunctions that cover low-quality rows of ``rows(doc_id, bad, inputs)``.

    Rules grow on two thirds of the rows, by the gain in information for each threshold
    on either side, and are cut back to the prefix that is best on the last third.  No or
    one-sided labels give no rules.
    """
    inputs = F.col("inputs")
    steps = [k / QUANTILES for k in range(1, QUANTILES)] + [0.97, 0.99]
    cuts = dict(zip(FEATURES, rows.select("inputs.*").approxQuantile(list(FEATURES), steps, 0.0), strict=True))
    cuts = {f: sorted(set(v)) for f, v in cuts.items() if v}
    grow = F.pmod(F.xxhash64(F.lit("grow"), "doc_id"), F.lit(3)) > 0
    rules: list[Rule] = []
    left = rows
    if not cuts:
        return rules

    def histogram(covered: DataFrame) -> dict:
        def bin_of(f: str, c: list[float]) -> Column:  # how many thresholds lie below the value
            below = F.filter(F.array(*map(F.lit, c)), lambda t: t < inputs[f])
            return F.struct(F.lit(f).alias("f"), F.size(below).alias("b"))

        bins = F.array(*[bin_of(f, c) for f, c in cuts.items()])
        counted = covered.select("bad", F.explode(bins).alias("x")).groupBy("x.f", "x.b").agg(
            F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
        return {(r["f"], r["b"]): (r["p"], r["n"]) for r in counted.collect()}  # features x bins

    while len(rules) < MAX_RULES:
        rule: Rule = ()
        at = left.filter(grow)
        while len(rule) < MAX_CONDITIONS:
            hist = histogram(at.filter(_all(rule, inputs)))
            first = next(iter(cuts))
            p0 = sum(v[0] for (f, _), v in hist.items() if f == first)
            n0 = sum(v[1] for (f, _), v in hist.items() if f == first)
            if not p0 or not n0:
                break
            best, gain = None, 1e-9
            for f, c in cuts.items():
                p_low = n_low = 0
                for b, t in enumerate(c):
                    p, n = hist.get((f, b), (0, 0))
                    p_low, n_low = p_low + p, n_low + n
                    for above, (p, n) in ((False, (p_low, n_low)), (True, (p0 - p_low, n0 - n_low))):
                        if p:
                            g = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                            if g > gain:
                                best, gain = Condition(f, above, t), g
            if best is None:
                break
            rule += (best,)
        if not rule:
            break
        prefixes = [rule[: k + 1] for k in range(len(rule))]
        sums = [F.sum(F.when(_all(r, inputs) & held, v)).alias(f"{tag}{k}{s}") for k, r in enumerate(prefixes)
                for tag, held in (("g", grow), ("h", ~grow)) for s, v in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]
        got = left.agg(*sums).first().asDict()

        def worth(k: int, tag: str) -> float:
            p, n = got[f"{tag}{k}p"] or 0, got[f"{tag}{k}n"] or 0
            return (p + 1) / (p + n + 2)

        keep = max(range(len(prefixes)), key=lambda k: (worth(k, "h"), -k))
        p, n = ((got[f"g{keep}{s}"] or 0) + (got[f"h{keep}{s}"] or 0) for s in "pn")
        if p < MIN_COVERED or p / (p + n) < min_precision:
            break
        rules.append(prefixes[keep])
        left = left.filter(~_all(prefixes[keep], inputs))
    return rules


def verdict(rules: list[Rule], inputs: Column) -> Column:
    """The decision list: the first rule that holds rejects; a document that meets none is kept."""
    out = F.when(F.lit(False), False)
    for r in rules:
        out = out.when(_all(r, inputs), False)
    return out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept``; learns from ``labels(doc_id, quality)``.

    Every row stays, repeated ones too.  Input columns named like an output are replaced;
    other columns pass through, whatever their names.
    """
    source = docs.select(*named(kept_columns(docs, [*COUNTS, "kept"])))
    rules = learn(training_rows(source, labels, F.col("quality") == 0))
    counted, inputs = base_counts(source)
    return counted.withColumn("kept", ~F.col("base_failed") & verdict(rules, F.col(inputs))).drop(inputs)


def held_out_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row over the fifth of the labelled rows that the rules of this call are not learned from: low-quality
    ones rejected and kept, others rejected and kept, all of them past the base rules."""
    rows = training_rows(docs, labels, F.col("quality") == 0)
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(5)) == 0
    kept = verdict(learn(rows.filter(~held)), F.col("inputs"))
    counts = {"found": (1, False), "missed": (1, True), "rejected": (0, False), "left": (0, True)}
    return rows.filter(held).agg(*[F.count_if((F.col("bad") == b) & (kept == k)).alias(n) for n, (b, k) in counts.items()])
