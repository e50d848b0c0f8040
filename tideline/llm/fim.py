"""Fill-in-the-middle texts, cut by succinct rank and select.

A batch of UTF-8 texts has one packed bit for each byte: whether a code point starts there.
A directory holds the number of bits before each block of ``BLOCK`` bytes. The popcount of a
text's bits is its number of code points; a cut after ``k`` code points is the place of the
bit with the rank ``k``: the block by binary search in the directory, the byte in the block
by popcounts, the bit in the byte by a table. No text is decoded or walked through by character.

Draws come from a digest of the row key and a salt, so that a row's cuts and form don't depend on
partitions, retries or other rows.

Defined results: a null text is as an empty one; texts that are empty or have a marker in them
are left plain, and so are those that the draw leaves; a null id draws as an empty one;
equal rows get equal results; other columns pass through, but for those of the names
that are added, which are replaced; an empty table gives an empty result. Memory is bounded
by an Arrow batch, which is bounded in bytes, or by its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.session import ship_package
from tideline.llm.shingles import text_bytes
from tideline.llm.store import fresh_name, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK = 512  # bytes of text, and bits, of a directory entry
ADDED = "n long, form string, prefix_chars long, middle_chars long, output string"

#: place of the bit of each rank in a byte, first bit first; 8 where there is none
_SELECT = np.full((256, 8), 8, np.uint8)
for _byte in range(256):
    _places = [k for k in range(8) if _byte >> (7 - k) & 1]
    _SELECT[_byte, : len(_places)] = _places


class Boundaries:
    """Rank and select over the code point starts of a run of UTF-8 bytes."""

    def __init__(self, data: np.ndarray) -> None:
        starts = (data & 0xC0) != 0x80
        blocks = len(data) // BLOCK + 1
        self.bits = np.zeros((blocks, BLOCK // 8), np.uint8)
        packed = np.packbits(starts)
        self.bits.reshape(-1)[: len(packed)] = packed
        self.before = np.zeros(blocks + 1, np.int64)
        np.cumsum(np.bitwise_count(self.bits).sum(1, dtype=np.int64), out=self.before[1:])
        self.size = len(data)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many code points start before each byte ``at``."""
        block, inside = at // BLOCK, at % BLOCK
        counts = np.bitwise_count(self.bits[block]).cumsum(1, dtype=np.int64)
        byte, bit = inside // 8, inside % 8
        whole = np.where(byte > 0, np.take_along_axis(counts, np.maximum(byte - 1, 0)[:, None], 1)[:, 0], 0)
        head = self.bits[block, byte] & ~(0xFF >> bit.astype(np.uint8)).astype(np.uint8)
        return self.before[block] + whole + np.bitwise_count(head)

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The byte at which the code point of each rank starts; the end, for the rank after the last."""
        found = np.full(len(rank), self.size, np.int64)
        there = rank < self.before[-1]
        rank = rank[there]
        block = np.searchsorted(self.before, rank, side="right") - 1
        left = rank - self.before[block]
        counts = np.bitwise_count(self.bits[block]).cumsum(1, dtype=np.int64)
        byte = (counts <= left[:, None]).sum(1)
        left = left - np.where(byte > 0, np.take_along_axis(counts, np.maximum(byte - 1, 0)[:, None], 1)[:, 0], 0)
        found[there] = block * BLOCK + byte * 8 + _SELECT[self.bits[block, byte], left]
        return found


def arranged(data: np.ndarray, bounds: np.ndarray, first: np.ndarray, second: np.ndarray, form: np.ndarray) -> list[bytes]:
    """The output of each text of ``data``, cut at the bytes ``first`` and ``second``."""
    whole = data.tobytes()
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    found = []
    for low, high, a, b, kind in zip(bounds[:-1].tolist(), bounds[1:].tolist(), first.tolist(), second.tolist(), form.tolist(), strict=True):
        if kind == "psm":
            found.append(b"".join((p, whole[low:a], s, whole[b:high], m, whole[a:b])))
        elif kind == "spm":
            found.append(b"".join((s, whole[b:high], p, whole[low:a], m, whole[a:b])))
        else:
            found.append(whole[low:high])
    return found


def draws(id_col: str, salt: str) -> list[Column]:
    """Four numbers under 2^32 of the digest of ``salt``, a colon and the id."""
    digest = F.sha2(F.concat(F.lit(salt + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: str = "1", rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """``docs`` with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    ``rate`` percent of the texts are cut, and ``spm_rate`` percent of those have their suffix first.
    """
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    added = T.StructType.fromDDL(ADDED).fields
    docs = docs.drop(*(f.name for f in added if f.name not in (id_col, text_col)))
    names: list[str] = []
    told = docs
    for draw in draws(id_col, salt):
        names.append(fresh_name(told, "draw"))
        told = told.withColumn(names[-1], draw)
    has_marker = fresh_name(told, "marker")
    told = told.withColumn(has_marker, F.coalesce(F.col(text_col).contains(PREFIX) | F.col(text_col).contains(SUFFIX) | F.col(text_col).contains(MIDDLE), F.lit(False)))
    place, kept = docs.columns.index(text_col), len(docs.columns)
    schema = T.StructType([*docs.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, bounds = text_bytes(batch.column(place))
            data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
            marks = Boundaries(data)
            start = marks.rank(bounds)
            n = np.diff(start)
            h1, h2, h3, h4 = (batch.column(kept + k).to_numpy() for k in range(4))
            one, two = h1 % (n + 1), h2 % (n + 1)
            low, high = np.minimum(one, two), np.maximum(one, two)
            plain = (n == 0) | np.asarray(batch.column(kept + 4).to_numpy(zero_copy_only=False), bool) | (h3 % 100 >= rate)
            form = np.where(plain, "plain", np.where(h4 % 100 < spm_rate, "spm", "psm"))
            outputs = arranged(data, bounds, marks.select(start[:-1] + low), marks.select(start[:-1] + high), form)
            columns = [
                pa.array(n, pa.int64()),
                pa.array(form.tolist(), pa.string()),
                pa.array(low, pa.int64(), mask=plain),
                pa.array(high - low, pa.int64(), mask=plain),
                pa.array(outputs, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *columns], names=[*batch.schema.names[:kept], *(f.name for f in added)])

    return told.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text of an output: between its markers, which no cut text has itself."""

    def after(text: Column, marker: str) -> Column:
        return F.substring_index(text, marker, -1)

    def before(text: Column, marker: str) -> Column:
        return F.substring_index(text, marker, 1)

    head = F.substr(output, F.lit(len(PREFIX) + 1))
    psm = F.concat(before(head, SUFFIX), after(output, MIDDLE), before(after(output, SUFFIX), MIDDLE))
    spm = F.concat(before(after(output, PREFIX), MIDDLE), after(output, MIDDLE), before(head, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
