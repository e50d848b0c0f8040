"""How early line boundaries could be known from hypotheses of growing lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import stats
from tideline.functions.text import ends_sentence, let, words
from tideline.session import written

SEEN, FIRM, OPENS = range(3)


def _ends(text: Column) -> Column:
    """``n`` words, and the ``places`` of those that end a sentence: the text is cut into words once."""

    def found(w: Column) -> Column:
        places = F.filter(F.transform(w, lambda x, i: F.when(ends_sentence(x), i)), lambda i: i.isNotNull())
        return F.struct(F.size(w).alias("n"), places.alias("places"))

    return let(words(text), found)


def _sighted(hypotheses: DataFrame, key: list[str], runs: int) -> DataFrame:
    """``key..., word_no, first, stable, islands, seen_no, last_no`` of each place that a hypothesis of two words or more has an end at.

    What is shuffled and sorted is one row a hypothesis, with its places and without its text; they become rows where they are counted.
    """
    none = F.array().cast("array<int>")
    ended = hypotheses.select(*key, "hyp_no", "at", _ends(F.col("text")).alias("e")).select(*key, "hyp_no", "at", "e.n", "e.places")
    spoken = F.col("n") >= 2
    told = ended.select(*key, "hyp_no", "at", "n", F.when(spoken, F.col("places")).otherwise(none).alias("places"))
    order = Window.partitionBy(*key).orderBy("hyp_no")

    def before(k: int) -> Column:
        return F.when(F.lag("hyp_no", k).over(order) == F.col("hyp_no") - k, F.lag("places", k).over(order)).otherwise(none)

    earlier = [f"before_{k}" for k in range(1, max(runs, 2))]
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.max(F.when(spoken, F.col("hyp_no"))).over(whole).alias("last_no")
    beside = told.select("*", last, *(before(k).alias(name) for k, name in enumerate(earlier, 1)))
    firm = F.col("places")
    for name in earlier[: runs - 1]:
        firm = F.array_intersect(firm, name)

    def marked(places: Column, kind: int) -> Column:
        return F.transform(places, lambda p: F.struct(p.alias("word_no"), F.lit(kind).alias("kind")))

    marks = F.concat(marked(F.col("places"), SEEN), marked(firm, FIRM), marked(F.array_except("places", "before_1"), OPENS))
    each = beside.select(*key, "last_no", "hyp_no", "at", "n", F.inline(marks))
    kind = F.col("kind")
    return each.groupBy(*key, "word_no").agg(
        F.min(F.when(kind == SEEN, F.col("at"))).alias("first"),
        F.min(F.when((kind == FIRM) & (F.col("word_no") + 1 < F.col("n")), F.col("at"))).alias("stable"),
        F.count_if(kind == OPENS).alias("islands"),
        F.max("hyp_no").alias("seen_no"),
        F.max("last_no").alias("last_no"),
    )


def boundary_timings(hypotheses: DataFrame, closed: DataFrame, runs: int = 2) -> DataFrame:
    """``session_id, line_id, word_no, saved, saved_raw, lag, flaps`` for each inner boundary of closed lines.

    ``hypotheses(session_id, line_id, hyp_no, at, text)``, numbered without gaps;
    ``closed(session_id, line_id, text, close_at, pace, start_s)``. A boundary is stable
    when ``runs`` hypotheses in a row have it and a word follows it; it flaps when it is
    gone again. Boundaries that no hypothesis had have nulls.
    """
    key = ["session_id", "line_id"]
    ends = closed.select(*key, "close_at", "start_s", "pace", _ends(F.col("text")).alias("e")).select(*key, "close_at", "start_s", "pace", F.col("e.n").alias("size"), F.explode("e.places").alias("word_no"))
    inner = ends.where(F.col("word_no") + 1 < F.col("size"))
    both = inner.join(_sighted(hypotheses, key, runs), [*key, "word_no"], "left")
    word_end = F.col("start_s") + F.col("pace") * (F.col("word_no") + 1)
    return both.select(
        *key,
        F.col("word_no").cast("bigint").alias("word_no"),
        F.when(F.col("stable").isNotNull(), F.greatest(F.col("close_at") - F.col("stable"), F.lit(0.0))).alias("saved"),
        F.when(F.col("first").isNotNull(), F.greatest(F.col("close_at") - F.col("first"), F.lit(0.0))).alias("saved_raw"),
        (F.col("stable") - word_end).alias("lag"),
        F.coalesce(F.col("islands") - 1 + (F.col("seen_no") < F.col("last_no")).cast("int"), F.lit(0)).cast("bigint").alias("flaps"),
    )


def earliness_table(timings: DataFrame, gate_s: float = 1.0) -> DataFrame:
    """One row: counts, percentiles of each column, and whether the median saving passes."""
    names = ("saved", "saved_raw", "lag", "flaps")
    # written once: counts and ranks would each work the timings out again
    timings = written(timings.select(*names), "timings")
    table = timings.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("saved_raw").isNull()).alias("never_seen"),
        F.count_if(F.col("saved_raw").isNotNull() & F.col("saved").isNull()).alias("never_stable"),
        *(F.count(name).alias(f"{name}_n") for name in names),
    )
    ranks = stats.at_ranks(
        timings.select(F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(name).cast("double").alias("value")) for name in names))).alias("x")).select("x.*"),
        ["name"], "value", {"p50": stats.near_rank(0.5), "p90": stats.near_rank(0.9)},
    )
    nan = F.lit(float("nan"))
    wide = ranks.agg(
        *(F.coalesce(F.max(F.when(F.col("name") == name, F.col(p))), nan).alias(f"{name}_{p}") for name in names for p in ("p50", "p90")),
        *(F.max(F.when(F.col("name") == name, F.col("longest"))).alias(f"{name}_max") for name in names),
    )
    both = table.crossJoin(F.broadcast(wide))  # one row
    order = ["n", "never_seen", "never_stable", *(f"{name}_{x}" for name in names for x in ("n", "p50", "p90", "max"))]
    return both.select(*order, ((F.col("saved_n") > 0) & (F.col("saved_p50") >= gate_s)).alias("passed"))
