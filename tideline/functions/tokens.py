"""Tokens of models put back in place: positions, times, text, names of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN, SHOWN = "<unk>", "□"


def with_times(tokens: Column, times: Column, origin: Column, fed_s: Column, limit: Column) -> Column:
    """``array<struct<token, start>>`` by position; the arrays have to be of one size.

    Times count from what had been fed when the engine was reset, and stay within the audio;
    control tokens, ``<|...|>``, have no place in it.
    """
    paired = F.transform(tokens, lambda t, i: F.struct(t.alias("token"), F.least(F.greatest(F.get(times, i) + origin - fed_s, F.lit(0.0)), limit).alias("start")))
    spoken = F.filter(paired, lambda x: ~x["token"].rlike(r"^<\|.*\|>$"))
    sizes = F.concat(F.lit("tokens and times differ in number: "), F.size(tokens).cast("string"), F.lit(" and "), F.size(times).cast("string"))
    return F.when(F.size(tokens) == F.size(times), spoken).otherwise(F.raise_error(sizes))


def token_text(tokens: Column) -> Column:
    """The text that tokens spell: marks open words, unknown tokens are shown, other control tokens are not."""
    spelled = F.transform(F.filter(tokens, lambda t: (t == UNKNOWN) | ~t.rlike("^<[^>]*>$|^[a-z]{3}_[A-Z][a-z]{3}$")), lambda t: F.when(t == UNKNOWN, F.concat(F.lit("▁"), F.lit(SHOWN))).otherwise(t))
    return F.trim(F.replace(F.array_join(spelled, ""), F.lit("▁"), F.lit(" ")))


def windows_in(seconds: Column, window_ms: int = 32) -> Column:
    """Whole windows in a duration, by whole milliseconds."""
    return F.floor(F.floor(F.round(seconds * 1000, 6)) / window_ms).cast("long")


def context_size(seconds: Column) -> Column:
    """Positions of an encoder for so much audio: fifty a second and one second more, 512 to 1500."""
    return F.least(F.greatest(F.ceil((seconds + 1) * 50), F.lit(512)), F.lit(1500)).cast("long")


def stem(path: Column) -> Column:
    """A path's file name without its last suffix; a name that only starts with a dot stays."""
    name = F.regexp_replace(path, "^.*/", "")
    return F.when(name.rlike(r"^[.][^.]*$"), name).otherwise(F.regexp_replace(name, r"[.][^.]*$", ""))


def expand_home(path: Column, home: str) -> Column:
    """``~`` and ``~/...`` under the home folder."""
    return F.when(path.rlike("^~(/|$)"), F.concat(F.lit(home), F.substring(path, 2, 1 << 30))).otherwise(path)


def reference_places(ops: Column) -> Column:
    """For each hypothesis word its place in the reference, by alignment steps; null for words that were added."""
    said = F.filter(ops, lambda x: x["op"] != "D")
    return F.transform(said, lambda x: F.when(x["op"] != "I", x["ref_no"]))


def scatter_gather(rows: DataFrame, keys: list[str], pieces: str, wanted, model) -> DataFrame:  # noqa: ANN001
    """``keys..., pieces`` with the model's answers in the places of the pieces that are ``wanted``.

    ``model`` takes and gives rows with the columns ``piece`` and ``answer``; other pieces never reach it.
    """
    each = rows.select(*keys, F.posexplode_outer(pieces).alias("place", "piece"))
    # a row without pieces has one made-up null, which the model never gets
    chosen = F.coalesce(wanted(F.col("piece")), F.lit(False)) & F.col("place").isNotNull()
    asked = model(each.where(chosen)).select(*keys, "place", F.col("answer").alias("piece"))
    whole = asked.unionByName(each.where(~chosen))
    ordered = F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "piece"))))
    return whole.groupBy(*keys).agg(F.transform(ordered, lambda x: x["piece"]).alias(pieces))
