"""Quality rules whose cutoffs are certified on labelled documents.

A fixed base rule rejects what is short or mostly repeats itself. Three further rules
compare an exact count with a percentage: symbols of word characters, repeated lines of
lines, repeated words of words. Their cutoffs are chosen by stratum (language), along a
fixed path: from no cutoff at all, each step tightens one rule by one cutoff of its grid,
the rules in turn. What the rules together reject only grows along the path. At each step
the good documents of the labelled holdout that pass the base rule give a binomial count of
false rejections, and the exact binomial tail tests whether their rate is at most
``RISK``. The steps of a stratum are tested in their order, up to the first that
fails (fixed-sequence testing: no correction among them), and a Bonferroni correction over
the strata keeps the chance of any wrong certificate at ``DELTA``. Of the certified steps,
the one whose gain, bad less good documents rejected, is largest is used (the most lenient
of several); without a gain nothing is rejected in that stratum. So in every
stratum at most ``RISK`` of good documents are lost to the three rules together, and few
labels mean few rejections: without any loss a stratum needs 217 good labels if it is one of four.

Everything here is DataFrame expressions.

Defined results: null or blank texts have zero counts and fail the base rule; a null
language is a stratum of its own; repeated labels each count; null labels don't;
equal rows are kept; empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.store import written

RISK = 0.02
DELTA = 0.05
SPACE = r"[\x20\x09-\x0D]+"
#: rule -> (count, out of, grid of percentages)
RULES: dict[str, tuple[str, str, tuple[int, ...]]] = {
    "symbols": ("n_symbols", "word_chars", (2, 5, 10, 15, 20, 30)),
    "lines": ("n_dup_lines", "n_lines", (20, 30, 40, 50, 60, 75)),
    "repeats": ("n_repeat_words", "n_words", (10, 15, 20, 25, 30, 40)),
}
STEPS = sum(len(grid) for *_, grid in RULES.values())
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeat_words(words: Column) -> Column:
    """Words that are in a run of three words that the array has more than once."""
    runs = F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)))

    def several(runs: Column) -> Column:
        placed = F.sort_array(F.transform(runs, lambda r, i: F.struct(r.alias("r"), i.alias("i"))))

        def starts(placed: Column) -> Column:
            again = F.filter(
                placed,
                lambda x, j: F.coalesce(F.get(placed, j + 1)["r"] == x["r"], F.lit(False))
                | ((j > 0) & F.coalesce(F.get(placed, j - 1)["r"] == x["r"], F.lit(False))),
            )
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def covered(at: Column) -> Column:
            steps = F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return _let(_let(placed, starts), covered)

    return _let(runs, lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), F.lit(0)).otherwise(several(r)))


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``doc_id, stratum`` and ``COUNTS`` of each row's whole text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = rows.select(
        "doc_id",
        "stratum",
        F.array_remove(F.split("text", SPACE, -1), "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
    )
    counted = split.select(
        "doc_id",
        "stratum",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
    )
    return counted.select("doc_id", "stratum", *(F.col(c).cast("long").alias(c) for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """``P(X <= k)`` of ``n`` trials at ``rate``, by the ratio of successive terms; 1 where ``k`` is above the mean."""
    first = n * math.log1p(-rate)
    odds = math.log(rate) - math.log1p(-rate)

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    start = F.struct(first.alias("term"), F.exp(first).alias("total"))
    summed = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), start, step)["total"]
    return F.when(k > n * rate, F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(summed)


def first_step() -> Column:
    """The first step of the path whose rules reject the document; beyond ``STEPS`` if none does.

    A rule's cutoffs come from the most lenient to the strictest, at every third step.
    """
    firsts = []
    for turn, (part, whole, grid) in enumerate(RULES.values()):
        exceeded = sum(((100 * F.col(part) > c * F.col(whole)).cast("int") for c in grid), F.lit(0))
        firsts.append(F.when(exceeded > 0, len(RULES) * (len(grid) - exceeded) + turn + 1).otherwise(STEPS + 1))
    return F.least(*firsts)


def certified_steps(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``cut_stratum, step``: the step that each stratum uses, for those that have a certified one with a gain."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("good")).where("good is not null")
    held = measured.where(~base_failed()).join(marks, "doc_id")
    counts = (
        held.groupBy("stratum", first_step().alias("first"))
        .agg(F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("good") == 0, 1).otherwise(0)).alias("bad"))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(STEPS))))
    )
    reached = F.col("first") <= F.col("step")
    tests = counts.groupBy("stratum", "step").agg(
        F.sum("good").alias("n"), F.sum(F.when(reached, F.col("good")).otherwise(0)).alias("lost"), F.sum(F.when(reached, F.col("bad")).otherwise(0)).alias("caught")
    )
    strata = tests.agg((F.count(F.lit(1)) / STEPS).alias("strata"))
    # losses only grow along the path: a step that passes has no failed one before it
    passed = tests.crossJoin(F.broadcast(strata)).where(  # one row
        (F.col("caught") > F.col("lost")) & (binomial_tail(F.col("lost"), F.col("n"), RISK) <= DELTA / F.col("strata"))
    )
    best = passed.groupBy("stratum").agg(F.min_by("step", F.struct(F.col("lost") - F.col("caught"), "step")).alias("step"))
    return best.select(F.col("stratum").alias("cut_stratum"), "step")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``doc_id``, ``COUNTS``, the stratum's cutoffs (null: none), ``base_failed`` and ``kept``."""
    measured = written(measure(docs, id_col, text_col, stratum_col), "measured")
    steps = certified_steps(measured, labels, id_col)
    judged = measured.withColumn("first", first_step()).join(steps, F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left")
    cuts = []
    for turn, (rule, (_, _, grid)) in enumerate(RULES.items()):
        notch = F.floor((F.col("step") - turn - 1) / len(RULES)) + 1
        cuts.append(F.get(F.array(*(F.lit(c) for c in reversed(grid))), (notch - 1).cast("int")).alias(f"cut_{rule}"))
    verdict = F.coalesce(F.col("first") > F.col("step"), F.lit(True))
    return judged.select("doc_id", *COUNTS, *cuts, base_failed().alias("base_failed"), (~base_failed() & verdict).alias("kept"))
