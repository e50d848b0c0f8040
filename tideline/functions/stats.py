"""Percentiles and ratios by the definitions that reports use. Nulls don't count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sorted(values: Column) -> Column:
    return F.sort_array(F.collect_list(values))


def nearest_rank(values: Column, q: float) -> Column:
    """The element at ``round(q * (n - 1))``, halves upwards; NaN for none."""

    def pick(v: Column) -> Column:
        return F.coalesce(F.get(v, F.round(q * (F.size(v) - 1)).cast("int")), F.lit(float("nan")))

    return F.get(F.transform(F.array(_sorted(values)), pick), F.lit(0))


def floor_rank(values: Column, q: float) -> Column:
    """The element at ``floor(n * q)``, the last at most."""

    def pick(v: Column) -> Column:
        return F.get(v, F.least(F.floor(F.size(v) * q), F.size(v) - 1).cast("int"))

    return F.get(F.transform(F.array(_sorted(values)), pick), F.lit(0))


def upper_median(values: Column) -> Column:
    """The element at ``n div 2``; zero for none."""
    return F.get(F.transform(F.array(_sorted(values)), lambda v: F.coalesce(F.get(v, F.floor(F.size(v) / 2).cast("int")), F.lit(0.0))), F.lit(0))


def near_rank(q: float) -> Callable[[Column], Column]:
    """The place, from 0, that ``nearest_rank`` takes of n."""
    return lambda n: F.round(q * (n - 1)).cast("long")


def low_rank(q: float) -> Callable[[Column], Column]:
    """The place, from 0, that ``floor_rank`` takes of n."""
    return lambda n: F.least(F.floor(n * q), n - 1).cast("long")


CELLS = 4096


def _span(value: str) -> list[Column]:
    return [F.min(value).cast("double").alias("_low"), F.max(value).cast("double").alias("_high")]


def _in_cells(rows: DataFrame, keys: list[str], value: str, spans: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``cell``: which of ``CELLS`` equal parts of its group's range a value is in. It doesn't fall where the value grows."""
    spans = rows.groupBy(*keys).agg(*_span(value)) if spans is None else spans.select(*keys, "_low", "_high")
    share = (F.col(value).cast("double") - F.col("_low")) / (F.col("_high") - F.col("_low"))
    cell = F.when(F.col("_high") > F.col("_low"), F.least(F.floor(F.nanvl(share, F.lit(0.0)) * CELLS), F.lit(CELLS - 1))).otherwise(F.lit(0))
    return rows.join(spans, keys).withColumn("cell", cell.cast("int")).drop("_low", "_high")


def _cell_of(celled: DataFrame, keys: list[str], ranks: DataFrame, pick: list[str]) -> DataFrame:
    """``keys..., cell, pick..., rank``: the cell that has each of ``ranks(keys..., pick..., rank)``, and the rank within it.

    The window is over the counts of at most ``CELLS`` cells of a group.
    """
    sizes = celled.groupBy(*keys, "cell").agg(F.sum("times").alias("size"))
    so_far = F.sum("size").over(Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    upto = sizes.withColumn("upto", so_far).withColumn("before", F.col("upto") - F.col("size"))
    found = upto.join(ranks, keys).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
    return found.select(*keys, "cell", *pick, (F.col("rank") - F.col("before")).alias("rank"))


def at_ranks(rows: DataFrame, keys: list[str], value: str, picks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``keys..., n, longest`` and a column for each of ``picks``: the value at that place of a group's sorted values.

    Equal values are counted first. A group's range is cut into cells, of which counts tell the
    one that has a rank; that cell is cut again, and only what is in its part is put in order. No
    group is held in an array, sorted or dealt to one task as a whole, whatever its size.
    """
    by = keys or ["_all"]
    given = rows if keys else rows.withColumn("_all", F.lit(0))
    counted = given.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("times"))
    totals = counted.groupBy(*by).agg(F.sum("times").alias("n"), F.max(value).alias("longest"), *_span(value))
    wanted = F.array(*(F.struct(F.lit(name).alias("pick"), place(F.col("n")).alias("rank")) for name, place in picks.items()))
    ranks = totals.select(*by, F.inline(wanted))
    first = _in_cells(counted, by, value, totals)
    inside = first.join(_cell_of(first, by, ranks, ["pick"]), [*by, "cell"]).drop("cell")
    within = [*by, "pick"]
    asked = inside.groupBy(*within).agg(F.first("rank").alias("rank"), *_span(value))
    second = _in_cells(inside.drop("rank"), within, value, asked)
    narrow = second.join(_cell_of(second, within, asked.select(*within, "rank"), []), [*within, "cell"]).drop("cell")
    upto = F.sum("times").over(Window.partitionBy(*within).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = narrow.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("times") <= F.col("rank")))
    found = placed.groupBy(*by).agg(*(F.min(F.when(F.col("pick") == name, F.col(value))).alias(name) for name in picks))
    return totals.join(found, by).select(*keys, "n", "longest", *picks)


def ratio(part: Column, whole: Column) -> Column:
    """NaN where there is nothing to divide by."""
    return F.when(whole == 0, F.lit(float("nan"))).otherwise(part / whole)


def verdict(passed: Column) -> Column:
    """``pass``, ``fail``, or ``n/a`` where there is no reading."""
    return F.when(passed.isNull(), "n/a").when(passed, "pass").otherwise("fail")
