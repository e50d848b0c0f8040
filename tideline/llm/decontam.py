"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle sets, in powers of two. For a
partition with sets of up to ``u`` shingles, documents are seen through windows of ``2u``
shingles that advance by ``u``: an item inside a document of any length is then inside
one window, whose set is at most four times the item's, so that containment of
``THRESHOLD`` is a Jaccard similarity of 0.19 at least and one of ``FUNCTIONS`` minima
agrees with a probability above 1 - 1.4e-6. A window's minimum can only agree with an
item's if it is one of the items' shingles; windows without any need no signature.
A document and an item whose minima agree are verified by exact containment of the
item's shingles in the document's.

The items are read in blocks of a fixed size (one, for usual benchmarks). Documents are read once and never
shuffled: of several blocks, a filter of bits for each tells which ones a text may have shingles of, and a
task loads those alone, ``MOST_LOADED`` at a time.

Defined results: null or blank texts match nothing; an item of fewer than five words is
one shingle and only matches a document that is the same sequence; equal rows each
match; a null item id is kept as a null; item ids may be text; empty tables give no matches;
other columns of documents pass through ``with_matches`` untouched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.session import ship_package
from tideline.llm.shingles import _short, pieces, shingle_hashes, splitmix, text_bytes, text_sets, word_hashes
from tideline.llm.store import fresh_name, small_batches

THRESHOLD_NUM, THRESHOLD_DEN = 4, 5
FUNCTIONS = 64
BLOCK_BYTES = 4 << 20
MOST_LOADED = 4
WIDTH = 5
MATCH = "array<struct<item_id:{},n_item:bigint,n_shared:bigint>>"
_MULTIPLIERS = splitmix(41, FUNCTIONS) | np.uint64(1)
_TABLE_BITS = 22


def minima(elements: np.ndarray) -> np.ndarray:
    return (elements[:, None] * _MULTIPLIERS[None, :]).min(axis=0)


class Items:
    """A block of test items, ready to be looked for."""

    def __init__(self, rows: list[tuple[int | str | None, str | None]]) -> None:
        self.ids = [r[0] for r in rows]
        self.sets = list(text_sets(pa.array([r[1] for r in rows], pa.string())))
        full = [s for s in self.sets if len(s)]
        self.known = np.unique(np.concatenate(full)) if full else np.zeros(0, np.uint64)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.known >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        self.classes: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
        for place, elements in enumerate(self.sets):
            if len(elements):
                top = 1 << int(len(elements) - 1).bit_length()
                for k, value in enumerate(minima(elements).tolist()):
                    self.classes[top][(k, value)].append(place)
        self.classes = {u: dict(v) for u, v in self.classes.items()}

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes are shingles of some item."""
        found = self.table[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]
        maybe = np.flatnonzero(found)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)
            found[maybe] = self.known[at] == hashes[maybe]
        return found

    def search(self, runs: np.ndarray, hits: np.ndarray) -> list[dict]:
        """Matches of one document: its shingle hashes in order, and where known ones are."""
        places: set[int] = set()
        for u, index in self.classes.items():
            windows = np.unique(np.concatenate([hits // u, np.maximum(hits // u - 1, 0)]))
            for w in windows.tolist():
                part = runs[w * u : w * u + 2 * u]
                if len(part):
                    for key in enumerate(minima(part).tolist()):
                        places.update(index.get(key, ()))
        present = np.unique(runs[hits])
        found = []
        for place in sorted(places):
            elements = self.sets[place]
            shared = len(np.intersect1d(elements, present, assume_unique=True))
            if THRESHOLD_DEN * shared >= THRESHOLD_NUM * len(elements):
                found.append({"item_id": self.ids[place], "n_item": len(elements), "n_shared": shared})
        return found

    def matches(self, column: pa.Array) -> list[list[dict]]:
        data, offsets = text_bytes(column)
        found: list[list[dict]] = []
        for at, to in pieces(offsets):
            words, _, _, before = word_hashes(data, offsets[at : to + 1])
            runs, whole = shingle_hashes(words, before, WIDTH)
            hits = np.flatnonzero(whole & self.holds(runs)) if len(self.known) else np.zeros(0, np.int64)
            edges = np.searchsorted(hits, before)
            for k, (a, b) in enumerate(zip(before[:-1], before[1:], strict=True)):
                if 0 < b - a < WIDTH:
                    one = _short(words[a:b])
                    found.append(self.search(one, np.zeros(1, np.int64)) if len(self.known) and self.holds(one)[0] else [])
                elif edges[k] < edges[k + 1]:
                    found.append(self.search(runs[a : b - WIDTH + 1], hits[edges[k] : edges[k + 1]] - a))
                else:
                    found.append([])
        return found


def _id_type(items: DataFrame, id_col: str) -> str:
    """The type of ids in matches: longs, or else text."""
    return "bigint" if items.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | str | None, str | None]]]:
    """The items in blocks of about ``block_bytes`` of text; an item is never cut."""
    rows = items.select(F.col(id_col).cast(_id_type(items, id_col)).alias("item_id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    for block in range(count):
        yield [(r[0], r[1]) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block).collect()]


def _one_pass(docs: DataFrame, rows: list, place: int, name: str, id_type: str) -> DataFrame:
    """``docs`` with the matches of one block of items in the column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(rows)  # at most one block
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string(MATCH.format(id_type)))])
    kind = pa.list_(pa.struct([("item_id", pa.int64() if id_type == "bigint" else pa.string()), ("n_item", pa.int64()), ("n_shared", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Items(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known.matches(batch.column(place)), kind)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def filter_of(rows: list[tuple[int | str | None, str | None]]) -> np.ndarray:
    """Packed bits of the shingles of a block of items."""
    bits = np.zeros(1 << _TABLE_BITS, bool)
    for elements in text_sets(pa.array([text for _, text in rows], pa.string())):
        bits[(elements >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
    return np.packbits(bits)


def _by_filters(docs: DataFrame, blocks: list[list], place: int, name: str, id_type: str) -> DataFrame:
    """``docs`` with the matches of all blocks of items in the column ``name``, in one pass."""
    context = docs.sparkSession.sparkContext
    shared, bits = [context.broadcast(rows) for rows in blocks], context.broadcast(np.stack([filter_of(rows) for rows in blocks]))  # a block each; half a megabyte a block
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string(MATCH.format(id_type)))])
    kind = pa.list_(pa.struct([("item_id", pa.int64() if id_type == "bigint" else pa.string()), ("n_item", pa.int64()), ("n_shared", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        any_block = np.bitwise_or.reduce(bits.value, axis=0)
        loaded: dict[int, Items] = {}

        def items_of(block: int) -> Items:
            known = loaded.pop(block, None) or Items(shared[block].value)
            while len(loaded) >= MOST_LOADED:
                loaded.pop(next(iter(loaded)))
            loaded[block] = known
            return known

        for batch in batches:
            column = batch.column(place)
            rows: list[list[int]] = [[] for _ in blocks]
            for row, elements in enumerate(text_sets(column)):
                at = (elements >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
                at = at[(any_block[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0]
                if len(at):
                    hit = ((bits.value[:, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).any(axis=1)
                    for block in np.flatnonzero(hit).tolist():
                        rows[block].append(row)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for block, chosen in enumerate(rows):
                if chosen:
                    for row, more in zip(chosen, items_of(block).matches(column.take(pa.array(chosen))), strict=True):
                        found[row] += more
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def with_matches(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", name: str = "matches") -> DataFrame:
    """``docs`` with the matches of each row's text, as an array of structs; a column of that name is replaced."""
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    out, id_type = docs.drop(name), _id_type(items, item_id)
    place = out.columns.index(text_col)
    blocks = list(item_blocks(items, item_id, item_text))
    if len(blocks) == 1:
        return _one_pass(out, blocks[0], place, name, id_type)
    return _by_filters(out, blocks, place, name, id_type)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, n_item, n_shared``: one row for each item that a row of ``docs`` contains."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_matches(chosen, items).select("doc_id", F.inline("matches"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    name = fresh_name(docs, "matches")
    return with_matches(docs, items, text_col, name=name).where(F.size(name) == 0).drop(name)
