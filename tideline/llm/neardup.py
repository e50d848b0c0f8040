"""Near-duplicate documents by SetSketch registers.

A register holds the exponentially spaced, truncated minimum of one hash function over a
set: ``floor(1 - log_b(x))`` of the smallest exponential ``x``, kept in a byte. Registers
merge by maximum and agree with a probability that grows with the Jaccard similarity.
Bands of register values bring sets together; inside a band's bucket the likelihood of
the registers, jointly with the known set sizes, decides which pairs may be similar
enough; these only say which sets are looked at together. All links are then confirmed
on full sets, by exact intersections.

Sets are represented once however many documents have them. Buckets and candidate groups
that are too large for one task are dealt out in pairs of blocks, and each block hands on
a spanning forest of its links, so that connected sets stay connected and no task emits
all pairs. A pair at the similarity 0.8 misses all bands with probability
(1 - 0.8^6)^32 = 6e-5, at 0.85 with 3e-7, and falls below the likelihood's cut, four and a half
standard deviations down, with 3e-6. Six registers to a band keep unlike sets
apart: two agree in a band by chance with 2e-10.

Defined results: null or blank texts have an empty set, link with nothing and are kept;
equal rows are kept, with one component; a row with a null id links with nothing, has a
null component and is kept; empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import ship_package
from tideline.llm.blocks import block_parts, deal, over_groups, spanning
from tideline.llm.graph import components
from tideline.llm.shingles import splitmix, text_sets
from tideline.llm.store import drop, give_back, small_batches, written

REGISTERS = 192
BAND_ROWS = 6
SKETCH_BASE = 1.1
SKETCH_RATE = 20.0
TOP_REGISTER = 255
MARGIN = 0.13
BUCKET_BLOCK = 512
SET_BLOCK = 512
SET_BLOCK_SHINGLES = 400_000

_MULTIPLIERS = splitmix(97, REGISTERS) | np.uint64(1)


def sketch(elements: np.ndarray, multipliers: np.ndarray = _MULTIPLIERS) -> np.ndarray:
    """SetSketch registers of a non-empty set of 64-bit hashes."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(elements), 1024):
        part = elements[at : at + 1024, None] * multipliers[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    share = (least.astype(np.float64) + 1.0) * 2.0**-64
    value = np.floor(1.0 - np.log(-np.log1p(-np.minimum(share, 1 - 1e-16)) / SKETCH_RATE) / math.log(SKETCH_BASE))
    return np.clip(value, 0, TOP_REGISTER).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def slope(up: np.ndarray, down: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, at: float, registers: int = REGISTERS) -> np.ndarray:
    """Derivative of the joint log-likelihood of the registers at the similarity ``at``.

    The likelihood is concave in the similarity: where this is not negative, the most
    likely similarity is ``at`` or more. ``up`` and ``down`` count the registers in which
    the first set's value is larger, and smaller.
    """
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    x, y = u - v * at, v - u * at
    k = (SKETCH_BASE - 1) / SKETCH_BASE
    p, q = -np.log1p(-k * x) / math.log(SKETCH_BASE), -np.log1p(-k * y) / math.log(SKETCH_BASE)
    dp, dq = k / math.log(SKETCH_BASE) / (1 - k * x), k / math.log(SKETCH_BASE) / (1 - k * y)
    same = registers - up - down
    return same * (v * dp + u * dq) / (1 - p - q) - up * v * dp / p - down * u * dq / q


def most_likely(up: int, down: int, n_a: int, n_b: int, registers: int = REGISTERS) -> float:
    """The similarity of the greatest joint likelihood, by bisection."""
    low, high = 0.0, min(n_a / n_b, n_b / n_a)
    for _ in range(50):
        middle = (low + high) / 2
        if slope(np.float64(up), np.float64(down), np.float64(n_a), np.float64(n_b), middle, registers) >= 0:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def digest(elements: bytes) -> bytes:
    """The name of a set, given its sorted hashes."""
    return hashlib.blake2b(elements, digest_size=16).digest()


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_shingles, set_id, registers``: one row for each row of ``docs``."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, registers = [], [], []
            for elements in text_sets(batch.column(1)):
                sizes.append(len(elements))
                ids.append(digest(elements.tobytes()) if len(elements) else None)
                registers.append(sketch(elements).tobytes() if len(elements) else None)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(registers, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_id", "registers"])
        give_back()

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, set_id binary, registers binary")


def _links(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.binary()), pa.array([b for _, b in rows], pa.binary())], names=["a", "b"])


def _bounds(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def candidate_links(sets: DataFrame, least: float, threshold: float) -> DataFrame:
    """``a, b``, written: links that keep together all sets that share a band and may reach ``threshold``.

    ``sets(set_id, n_shingles, registers)`` has each set once.
    """
    bands = REGISTERS // BAND_ROWS
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * BAND_ROWS + 1, F.lit(BAND_ROWS)))
    )
    rows = sets.select("set_id", F.explode(spread).alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = written(rows.join(written(shared, "shared-bands"), "band"), "buckets", release=True)
    dealt = deal(met, "band", "set_id", F.ceil(F.col("members") / BUCKET_BLOCK)).drop("members", "band")
    dealt = dealt.join(sets, "set_id").select("part", "set_id", "n_shingles", "registers")

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = table.column(0).to_numpy()
        ids = table.column(1).to_pylist()
        sizes = table.column(2).to_numpy().astype(np.float64)
        registers = np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint8).reshape(-1, REGISTERS)
        bounds = _bounds(keys)
        found: list[tuple[bytes, bytes]] = []

        def close(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Which of the pairs may be similar enough."""
            fit = np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j])
            i, j = i[fit], j[fit]
            x, y = registers[i], registers[j]
            up, down = (x > y).sum(1), (x < y).sum(1)
            fit[fit] = slope(up, down, sizes[i], sizes[j], least) >= 0
            return fit

        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        widths = np.diff(bounds)[group]
        small = np.flatnonzero(widths <= 16)
        for d in range(1, 16):
            i = small[small + d < len(keys)]
            i = i[group[i] == group[i + d]]
            if not len(i):
                break
            for at in i[close(i, i + d)]:
                found.append((ids[at], ids[at + d]))
        for g in np.flatnonzero(np.diff(bounds) > 16):
            low, high = bounds[g], bounds[g + 1]
            n = high - low
            joined = np.zeros((n, n), bool)
            for i in range(n - 1):
                j = np.arange(low + i + 1, high)
                hits = j[close(np.full(len(j), low + i), j)] - low
                joined[i, hits] = joined[hits, i] = True
            found.extend((ids[low + a], ids[low + b]) for a, b in spanning(joined))
        yield _links(list(dict.fromkeys(found)))

    links = written(over_groups(dealt, "part", work, "a binary, b binary").distinct(), "candidates", release=True)
    drop(met)
    return links


def intersections(arrays: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets, by products of incidence columns."""
    owner = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
    joined = np.concatenate(arrays)
    order = np.argsort(joined, kind="stable")
    joined, owner = joined[order], owner[order]
    starts = np.concatenate([[True], joined[1:] != joined[:-1]])
    column = np.cumsum(starts) - 1
    counts = np.bincount(column)
    shared = counts > 1
    keep = shared[column]
    owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
    total = np.zeros((len(arrays), len(arrays)), np.float64)
    width = 4096
    for at in range(0, int(shared.sum()), width):
        low, high = np.searchsorted(column, [at, at + width])
        incidence = np.zeros((len(arrays), width), np.float32)
        incidence[owner[low:high], column[low:high] - at] = 1
        total += incidence @ incidence.T
    return np.rint(total).astype(np.int64)


def _same_set(texts: pa.Array, names: list[bytes]) -> list[bool]:
    return [digest(e.tobytes()) == name for e, name in zip(text_sets(texts), names, strict=True)]


def parts_of(members: DataFrame) -> DataFrame:
    """``members(group_id, set_id, n_shingles, ...)``, written, with ``parts``: the blocks' pairs that each takes part in.

    Groups are measured and cut before any text is attached; the join reads two written
    tables, so that Spark can split a hot group.
    """
    sums = written(members.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("volume")).where("members > 1"), "group-sizes")
    wide = F.greatest(F.ceil(F.col("members") / SET_BLOCK), F.ceil(F.col("volume") / SET_BLOCK_SHINGLES))
    joined = members.join(sums, "group_id").withColumn("parts", block_parts("group_id", "set_id", F.least(wide, F.col("members"))))
    return written(joined.drop("members", "volume"), "parts")


def confirmed_links(texts: DataFrame, num: int, den: int, fits: Callable[[pa.Array, list[bytes]], list[bool]] = _same_set) -> DataFrame:
    """``a, b``: a spanning forest, block by block, of the links with ``den * both >= num * either``.

    ``texts(set_id, parts, text)`` has each set once for each part; an id may
    come with several texts, of which those count that ``fits`` finds to be of the set.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [e.tobytes() for e in text_sets(batch.column(2))]
            right = fits(batch.column(2), batch.column(0).to_pylist())
            whole = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["set_id", "parts", "elements"])
            yield whole.filter(pa.array(right, pa.bool_()))
        give_back()

    packed = texts.select("set_id", "parts", "text").mapInArrow(pack, "set_id binary, parts array<bigint>, elements binary")
    dealt = packed.select(F.explode("parts").alias("part"), "set_id", "elements")

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bounds = _bounds(table.column(0).to_numpy())
        ids = table.column(1).to_pylist()
        packed = table.column(2)
        found: list[tuple[bytes, bytes]] = []
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            arrays = [np.frombuffer(x, np.uint64) for x in packed.slice(low, high - low).to_pylist()]
            if len(arrays) < 2:
                continue
            both = intersections(arrays)
            sizes = np.array([len(a) for a in arrays])
            joined = den * both >= num * (sizes[:, None] + sizes[None, :] - both)
            np.fill_diagonal(joined, False)
            found.extend((ids[low + a], ids[low + b]) for a, b in spanning(joined))
        yield _links(found)

    return over_groups(dealt, "part", work, "a binary, b binary")


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Documents are linked where ``den * intersection >= num * union`` of their shingle sets.
    """
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    described = written(describe(docs, id_col, text_col), "described")
    linkable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    full = described.where(linkable)
    sets = written(
        full.groupBy("set_id").agg(F.min("n_shingles").alias("n_shingles"), F.min("registers").alias("registers"), F.min("doc_id").alias("first_id")), "sets"
    )
    maybe = candidate_links(sets.select("set_id", "n_shingles", "registers"), num / den - MARGIN, num / den)
    groups = components(maybe)
    chosen = written(
        groups.select(F.col("node").alias("set_id"), F.col("root").alias("group_id")).join(sets.select("set_id", "n_shingles", "first_id"), "set_id"), "chosen"
    )
    chosen = parts_of(chosen)
    one = docs.select(F.col(id_col).alias("first_id"), F.col(text_col).alias("text")).where("first_id is not null")
    # the same join at every size: texts are dealt by id, the small side is hashed in each partition
    texts = one.join(chosen.hint("shuffle_hash"), "first_id").select("set_id", "parts", "text")
    links = confirmed_links(texts, num, den)
    roots = components(links).select(F.col("node").alias("set_id"), "root")
    labelled = written(full.drop("registers").join(roots, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "set_id").alias("label")), "labelled")
    # written, so that the join reads two exchanges and Spark can split a hot label
    least = written(labelled.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    linked = labelled.join(least, "label").select("doc_id", "n_shingles", "component_id")
    alone = described.where(~linkable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
