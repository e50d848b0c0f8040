"""Sharding by minimax contiguous partition of ordered atomic groups.

Rows with equal texts form one atomic group. Groups are put in order (by digest of
the text), and the ordered sizes are cut into at most ``n_shards`` runs so that the
largest run is as small as any contiguous cut allows. The capacity is found by binary
search; a greedy walk checks each candidate; the cuts are those of the smallest
feasible capacity.

The ordered sizes never come to the driver. It sees totals by digest prefix, a bounded
number of them, and zooms in only where a cut can fall for any capacity still in
question; elsewhere a prefix is inside one shard for all of them, and acts as one
block. Groups larger than an even share get a shard of their own first, so that one
text that holds a third of all rows doesn't leave the other shards empty.

Defined results: a null text has size 1 and forms one group of its own, apart from
empty texts; an empty table gives an empty result; equal ``(doc_id, text)`` rows are
kept, each with a slot; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.store import written

PREFIX_STEP = 3
DETAIL_LIMIT = 100_000
ROWS_A_CELL = 200_000


@dataclass(frozen=True)
class Block:
    """Groups whose digests start with ``key``: bytes together, of the largest, number."""

    key: str
    total: int
    largest: int
    count: int


def greedy_cuts(sizes: list[int], capacity: int, limit: int) -> list[int] | None:
    """Starts of the runs after the first, or None if ``limit`` runs don't suffice."""
    ends = list(accumulate(sizes))
    if not ends:
        return []
    starts, at, base = [], 0, 0
    while True:
        reach = bisect_right(ends, base + capacity, lo=at)
        if reach >= len(ends):
            return starts
        if reach == at or len(starts) + 1 >= limit:
            return None
        starts.append(reach)
        at, base = reach, ends[reach - 1]


def smallest_capacity(sizes: list[int], limit: int, low: int = 0, high: int | None = None) -> int:
    """The smallest capacity for which the greedy walk needs at most ``limit`` runs."""
    total = sum(sizes)
    low = max(low, -(-total // limit), max(sizes, default=0))
    high = max(low, total if high is None else high)
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(sizes, middle, limit) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _doubtful(blocks: list[Block], limit: int) -> list[int]:
    """Indexes of blocks that a cut may fall into for some capacity that may be the smallest."""
    totals = [b.total for b in blocks]
    ends = list(accumulate(totals))
    whole = ends[-1]
    least = max(-(-whole // limit), max(b.largest for b in blocks))
    most = smallest_capacity(totals, limit)
    found: set[int] = set()
    low = high = 0
    for _ in range(limit):
        if low >= whole:
            break
        high = min(whole, high + most)
        aim = low + least
        at = bisect_right(ends, aim)
        if at >= len(ends):
            low = whole
        else:
            low = max(ends[at - 1] if at else 0, min(aim, ends[at]) - blocks[at].largest + 1, low)
        first, last = bisect_right(ends, low), bisect_right(ends, min(high, whole - 1))
        found.update(i for i in range(first, min(last, len(blocks) - 1) + 1) if blocks[i].count > 1)
    return sorted(found)


def _blocks(groups: DataFrame, length: int, under: list[str] | None, exact: bool) -> list[Block]:
    if under is not None:
        width = len(under[0])
        groups = groups.where(F.substring("group_key", 1, width).isin(under))
    if exact:
        rows = groups.select("group_key", "group_bytes").collect()
        return [Block(r[0], r[1], r[1], 1) for r in rows]
    rows = (
        groups.groupBy(F.substring("group_key", 1, length).alias("prefix"))
        .agg(F.sum("group_bytes"), F.max("group_bytes"), F.count(F.lit(1)))
        .collect()
    )
    return [Block(*r) for r in rows]


def find_cuts(groups: DataFrame, limit: int, detail_limit: int = DETAIL_LIMIT) -> list[str]:
    """Digests at which a new shard starts, for ``groups(group_key, group_bytes)``.

    At most ``16 ** PREFIX_STEP`` totals for each doubtful prefix, or ``detail_limit``
    groups, are on the driver at a time.
    """
    if limit <= 1:
        return []
    length = PREFIX_STEP
    blocks = sorted(_blocks(groups, length, None, False), key=lambda b: b.key)
    if not blocks:
        return []
    while doubt := _doubtful(blocks, limit):
        width = min(len(blocks[i].key) for i in doubt)
        now = [i for i in doubt if len(blocks[i].key) == width]
        exact = sum(blocks[i].count for i in now) <= detail_limit
        finer = _blocks(groups, width + PREFIX_STEP, [blocks[i].key for i in now], exact)
        gone = set(now)
        blocks = sorted([b for i, b in enumerate(blocks) if i not in gone] + finer, key=lambda b: b.key)
    totals = [b.total for b in blocks]
    starts = greedy_cuts(totals, smallest_capacity(totals, limit), limit)
    return [blocks[i].key for i in starts or []]


def _oversized(groups: DataFrame, total: int, n_shards: int) -> list[tuple[str, int]]:
    """Groups above an even share of what is left, largest first; fewer than ``n_shards``."""
    top = groups.orderBy(F.desc("group_bytes"), "group_key").limit(n_shards).collect()
    own: list[tuple[str, int]] = []
    rest = total
    for key, size in top:
        left = n_shards - len(own)
        if left <= 1 or size * left <= rest:
            break
        own.append((key, size))
        rest -= size
    return own


def assign_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: each row of ``docs`` in a shard and slot."""
    text = F.col(text_col)
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.sha2(text, 256), F.lit("")).alias("group_key"),
        ),
        "shard-rows",
    )
    groups = written(rows.groupBy("group_key").agg(F.sum("size").alias("group_bytes")), "shard-groups")
    n_rows = rows.count()
    total = groups.agg(F.sum("group_bytes")).first()[0] or 0
    own = _oversized(groups, total, n_shards) if total else []
    rest = groups.where(~F.col("group_key").isin([k for k, _ in own])) if own else groups
    cuts = find_cuts(rest, n_shards - len(own))

    shard: Column = F.lit(len(own))
    for cut in cuts:
        shard = shard + (F.col("group_key") >= cut).cast("int")
    for place, (key, _) in reversed(list(enumerate(own))):
        shard = F.when(F.col("group_key") == key, F.lit(place)).otherwise(shard)

    cells = min(4096, max(64, -(-n_rows // (n_shards * ROWS_A_CELL))))
    placed = rows.select(
        "doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(cells)).alias("cell")
    )
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("place", F.row_number().over(within))
        # at most 4,096 cells in each shard: the size of this side is bounded
        .join(F.broadcast(offsets), ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"))
    )
