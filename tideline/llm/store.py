"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.session import shared_folder, small_batches  # noqa: F401  others take it from here


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; see ``tideline.session``."""
    return shared_folder(spark)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the application may have ended already
        pass


def written(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """``df`` as a parquet table of the shared folder, read back.

    Unlike a local checkpoint it survives the loss of executors; it is removed when
    the application's Python ends. ``release`` has Spark drop the shuffle files of frames
    that nothing refers to any more, which it otherwise does when the driver happens to
    collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tideline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    schema = df.schema
    del df
    if release:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(schema).parquet(path)
    table._written_at = path
    return table


def drop(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more: all that came of them is written itself."""
    for table in tables:
        _remove(table.sparkSession, table._written_at)


def give_back() -> None:
    """Return a Python worker's free memory to the system: idle workers keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def fresh_name(rows: DataFrame, name: str) -> str:
    """``name``, or one made of it that no column of ``rows`` has; names don't tell cases apart."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


BITS_AN_ID = 8
BLOCK_BITS = 1 << 16
MOST_BITS = 1 << 29


def only_ids(rows: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``rows`` whose id may be one of ``wanted``'s; a join has to follow.

    A bit map of hashed ids, ``BITS_AN_ID`` bits for each wanted row, keeps most other rows,
    and their texts, out of the join's shuffle. It is put together in blocks of 8 kB by
    tasks, and is broadcast; beyond 64 million wanted rows it would take more than 64 MB, and
    the join goes without it: then most texts have to move in any case.
    """
    asked = BITS_AN_ID * max(1, wanted.count())
    if asked > MOST_BITS:
        return rows
    size = max(BLOCK_BITS, 1 << (asked - 1).bit_length())
    bit = F.pmod(F.xxhash64(id_col), F.lit(size))
    bits = wanted.select((bit / BLOCK_BITS).cast("bigint").alias("block"), (bit % BLOCK_BITS).cast("int").alias("bit")).distinct()

    def pack(table: pa.Table) -> Iterator[pa.RecordBatch]:
        blocks, places = table.column(0).to_numpy(), table.column(1).to_numpy()
        for block in np.unique(blocks):
            held = np.zeros(BLOCK_BITS, bool)
            held[places[blocks == block]] = True
            yield pa.RecordBatch.from_arrays([pa.array([int(block)], pa.int64()), pa.array([np.packbits(held).tobytes()], pa.binary())], names=["block", "bits"])

    from tideline.llm.blocks import over_groups

    bitmap = np.zeros(size // 8, np.uint8)
    for block, held in over_groups(bits, "block", pack, "block bigint, bits binary").collect():
        bitmap[block * (BLOCK_BITS // 8) : (block + 1) * (BLOCK_BITS // 8)] = np.frombuffer(held, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)
    numbered = rows.withColumn(fresh_name(rows, "bit"), bit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(batch.num_columns - 1).to_numpy()
            hit = (shared.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(hit.astype(bool)))

    return numbered.mapInArrow(run, rows.schema)


def hashed_sample(rows: DataFrame, bound: int, key: str = "doc_id", extra: str | None = None) -> DataFrame:
    """At most ``bound`` of ``rows``, those with the smallest hashes of ``key``.

    The rows are counted first and most are left out by their hash, so that partitions
    hand on about ``bound`` rows together, and not each.
    """
    count = rows.count()
    turn = F.shiftrightunsigned(F.xxhash64(key), 1)  # 63 bits
    limit = int(min(1.0, 1.3 * bound / max(1, count)) * (2**53 - 1)) << 10
    return rows.where(turn <= limit).orderBy(turn, key, *([extra] if extra else [])).limit(bound)


def hashed_sample_by(rows: DataFrame, bound: int, group: str, key: str = "doc_id") -> DataFrame:
    """About ``bound`` of ``rows``, shared out equally to the values of ``group``; each has one row at least."""
    counts = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    quota = max(1, bound // max(1, len(counts)))
    turn = F.shiftrightunsigned(F.xxhash64(key), 1)  # 63 bits
    # of each group some more than wanted, so that chance leaves none without rows
    limits = [(g, int(min(1.0, (1.3 * quota + 40) / n) * (2**53 - 1)) << 10) for g, n in counts.items()]
    bounds = F.broadcast(rows.sparkSession.createDataFrame(limits, f"`{group}` {rows.schema[group].dataType.simpleString()}, __limit long"))
    near = rows.join(bounds, group).where(turn <= F.col("__limit"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(turn, key, *(c for c in rows.columns if c not in (key, group))))
    return near.withColumn("__place", place).where(F.col("__place") <= quota).select(*rows.columns)


def hashed_span(text: str, chars: int, key: str = "doc_id") -> Column:
    """A text, or ``chars`` characters of a longer one from a hashed place; from its first letter, if there is none in those."""
    whole, size = F.col(text), F.length(text)
    at = F.pmod(F.xxhash64(key, text), F.greatest(size - chars + 1, F.lit(1))) + 1
    span = F.substr(whole, at.cast("int"), F.lit(chars))
    first = F.substr(whole, F.greatest(F.regexp_instr(whole, F.lit(r"\p{L}")), F.lit(1)), F.lit(chars))
    return F.when(size <= chars, whole).when(span.rlike(r"\p{L}"), span).otherwise(first)
