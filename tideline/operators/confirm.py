"""Boundaries that hypotheses have to confirm, and prefixes that may be sent early.

A hypothesis is the text of an open line so far, ``session_id, line_id, hyp_no, at, text``,
numbered without gaps. What a row's last few hypotheses agree on is found by windows; which
of it counts depends on what has been cut or sent before, so that a line's hypotheses are
folded in order, by an expression. A line's hypotheses are one row there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.text import FILLERS, ends_clause, ends_sentence, let, normalize, words

LINE = ["session_id", "line_id"]
CUTS = "struct<done:int,last:double,since:int,found:array<struct<hyp_no:int,place:int>>>"
SENT = "struct<sent:int,found:array<struct<hyp_no:int,place:int>>>"


def growing(lines: DataFrame, step: int, pace: float) -> DataFrame:
    """``session_id, line_id, hyp_no, at, text``: each line as it grows by ``step`` words."""
    w = lines.select("session_id", "line_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    each = w.select("session_id", "line_id", "w", F.explode(F.sequence(F.lit(1), F.ceil(F.size("w") / step).cast("int"))).alias("hyp_no"))
    return each.select(
        "session_id", "line_id", "hyp_no", (F.col("hyp_no") * step * pace).alias("at"), F.array_join(F.slice("w", 1, F.col("hyp_no") * step), " ").alias("text")
    )


def agreed(hypotheses: DataFrame, runs: int) -> DataFrame:
    """Hypotheses with the places of words that end a sentence, or a sentence or clause, in each of the last ``runs`` of them.

    ``firm`` are the former and ``soft`` the latter; ``spoken`` has a 1 for each word with
    content.
    """
    w = hypotheses.select(*LINE, "hyp_no", "at", words(F.col("text")).alias("w"))

    def places(test) -> Column:  # noqa: ANN001
        return F.filter(F.transform("w", lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())

    silent = F.array(*(F.lit(f) for f in ("", *FILLERS)))
    marked = w.select(
        *LINE,
        "hyp_no",
        "at",
        F.size("w").alias("n"),
        F.transform("w", lambda x: (~F.array_contains(silent, normalize(x))).cast("byte")).alias("spoken"),
        places(ends_sentence).alias("firm"),
        places(lambda x: ends_sentence(x) | ends_clause(x)).alias("soft"),
    )
    order = Window.partitionBy(*LINE).orderBy("hyp_no")
    none = F.array().cast("array<int>")
    for name in ("firm", "soft"):
        held = F.col(name)
        for k in range(1, runs):
            held = F.array_intersect(held, F.coalesce(F.lag(name, k).over(order), none))
        marked = marked.withColumn(f"{name}_agreed", held)
    return marked.select(*LINE, "hyp_no", "at", "n", "spoken", F.col("firm_agreed").alias("firm"), F.col("soft_agreed").alias("soft"))


def _by_line(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*LINE).agg(F.sort_array(F.collect_list(F.struct("hyp_no", "at", "n", "spoken", "firm", "soft"))).alias("hyps"))


def _content(spoken: Column, start: Column, stop: Column) -> Column:
    """How many words with content there are from ``start`` up to and with ``stop``."""
    return F.aggregate(F.slice(spoken, start + 1, F.greatest(stop - start + 1, F.lit(0))), F.lit(0), lambda a, x: a + x)


def boundaries(hypotheses: DataFrame, runs: int = 2, words_after: int = 1, least_words: int = 4, gap_s: float = 1.0) -> DataFrame:
    """``session_id, line_id, hyp_no, word_no``: where a line is cut before its utterance ends, all cuts accepted.

    A cut is at the last word that ``runs`` hypotheses since the cut before agree to end a
    sentence, with ``words_after`` words behind it and ``least_words`` words of content in
    the line; cuts are ``gap_s`` apart at least.
    """

    def step(state: Column, hyp: Column) -> Column:
        able = F.filter(
            hyp["firm"],
            lambda p: (p >= state["done"]) & (p + words_after < hyp["n"]) & (_content(hyp["spoken"], state["done"], p) >= least_words),
        )
        due = (hyp["at"] >= state["last"] + gap_s) & (hyp["hyp_no"] - state["since"] >= runs)

        def moved(place: Column) -> Column:
            cut = F.array(F.struct(hyp["hyp_no"].alias("hyp_no"), place.alias("place")))
            after = F.struct((place + 1).alias("done"), hyp["at"].alias("last"), hyp["hyp_no"].alias("since"), F.concat(state["found"], cut).alias("found"))
            return F.when(place.isNull(), state).otherwise(after.cast(CUTS))

        return let(F.when(due, F.array_max(able)), moved)

    start = F.expr(f"cast(named_struct('done', 0, 'last', 0.0D, 'since', -{runs}, 'found', array()) as {CUTS})")
    folded = _by_line(agreed(hypotheses, runs)).select(*LINE, F.aggregate("hyps", start, step)["found"].alias("found"))
    return folded.select(*LINE, F.inline("found")).select(*LINE, "hyp_no", F.col("place").cast("bigint").alias("word_no"))


def early_prefixes(hypotheses: DataFrame, runs: int = 2, clause_words: int = 6) -> DataFrame:
    """``session_id, line_id, hyp_no, prefix``: what is sent before lines are finished; a line's prefix only grows.

    A prefix ends where ``runs`` hypotheses agree on the end of a sentence, or of a clause
    ``clause_words`` words or more beyond what has been sent, with a word behind it.
    """

    def step(state: Column, hyp: Column) -> Column:
        able = F.filter(
            hyp["soft"], lambda p: (p + 1 < hyp["n"]) & (F.array_contains(hyp["firm"], p) | (p + 1 >= state["sent"] + clause_words))
        )

        def moved(place: Column) -> Column:
            sends = place.isNotNull() & (place >= state["sent"]) & (_content(hyp["spoken"], F.lit(0), place) > 0)
            sent = F.array(F.struct(hyp["hyp_no"].alias("hyp_no"), place.alias("place")))
            after = F.struct((place + 1).alias("sent"), F.concat(state["found"], sent).alias("found"))
            return F.when(sends, after.cast(SENT)).otherwise(state)

        return let(F.array_max(able), moved)

    start = F.expr(f"cast(named_struct('sent', 0, 'found', array()) as {SENT})")
    folded = _by_line(agreed(hypotheses, runs)).select(*LINE, F.aggregate("hyps", start, step)["found"].alias("found"))
    sent = folded.select(*LINE, F.inline("found"))
    text = F.array_join(F.slice(words(F.col("text")), 1, F.col("place") + 1), " ")
    return sent.join(hypotheses, [*LINE, "hyp_no"]).select(*LINE, "hyp_no", text.alias("prefix"))
