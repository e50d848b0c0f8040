"""Groups of rows dealt out in blocks, so that no task gets an unbounded group.

A group that is too large for one task is cut into blocks by hash, and each pair of
blocks is a group of its own; every pair of members meets in at least one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.store import give_back


def block_parts(group: str, member: str, n_blocks: Column) -> Column:
    """The numbers of the pairs of blocks that a member of a group takes part in, as an array."""
    n = n_blocks.cast("bigint")
    mine = F.pmod(F.xxhash64(member), n)
    return F.when(n == 1, F.array(F.xxhash64(group))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda x: F.xxhash64(group, F.least(x, mine), F.greatest(x, mine)))
    )


def deal(rows: DataFrame, group: str, member: str, n_blocks: Column) -> DataFrame:
    """``rows`` with ``part``, once for each pair of blocks that the member's block is in."""
    return rows.withColumn("part", F.explode(block_parts(group, member, n_blocks)))


def over_groups(rows: DataFrame, key: str, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``work`` over tables of whole groups of ``key``, a column of longs without nulls.

    Rows come sorted by key; a group that Arrow batches cut is joined again. The number of
    partitions is fixed: work on pairs is bound by time and not by bytes, which Spark would
    put partitions together by.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(place).to_numpy()
            changes = np.flatnonzero(keys[1:] != keys[:-1])
            if held and keys[0] != held[-1].column(place)[-1].as_py():
                yield from work(pa.Table.from_batches(held))
                held = []
            if len(changes):
                cut = int(changes[-1]) + 1
                yield from work(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield from work(pa.Table.from_batches(held))
        held.clear()
        give_back()

    return rows.repartition(parts, key).sortWithinPartitions(key).mapInArrow(run, schema)


def spanning(joined: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph whose adjacency matrix is ``joined``."""
    n = len(joined)
    fresh = np.ones(n, bool)
    found: list[tuple[int, int]] = []
    for root in range(n):
        if not fresh[root]:
            continue
        fresh[root] = False
        front = [root]
        while front:
            at = front.pop()
            new = np.flatnonzero(joined[at] & fresh)
            fresh[new] = False
            found.extend((at, int(x)) for x in new)
            front.extend(new.tolist())
    return found
