"""Append-only logs folded into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_log(log: DataFrame, keys: list[str], seq: str | Column) -> DataFrame:
    """One row for each key: the last value that is not null, by ``seq``, in every other column.

    Partial aggregates keep one value a task and column, so a hot key is no burden.
    """
    order = F.col(seq) if isinstance(seq, str) else seq
    values = [c for c in log.columns if c not in (*keys, seq if isinstance(seq, str) else "")]
    folded = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in values]
    return log.groupBy(*keys).agg(*folded)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The view after a batch of changes: rows are overwritten by key, never appended twice.

    Values there are older than any change; no change leaves them as they are.
    """
    kind = changes.schema[seq].dataType
    base = current.select("*", F.lit(None).cast(kind).alias(seq), F.lit(0).alias("changed"))
    both = base.unionByName(changes.withColumn("changed", F.lit(1)), allowMissingColumns=True)
    return fold_log(both, keys, F.struct("changed", seq)).drop("changed", seq)
