"""Sub-word pieces put together into timed words."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.text import bare
from tideline.session import ship_package, small_batches

PIECES = T.ArrayType(T.StructType([T.StructField("piece", T.StringType()), T.StructField("start", T.DoubleType())]))


def _differ(values: pa.Array) -> np.ndarray:
    """Where a value isn't the one before it; nulls are equal. The first differs."""
    a, b = values[:-1], values[1:]
    found = pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))
    return np.append(np.ones(min(len(values), 1), bool), found.to_numpy(zero_copy_only=False))


def _settle(parts: list[pa.Array], opens: np.ndarray, no: int, last: bool) -> tuple[list[pa.Array], list[pa.Array], int]:
    """Words of ``parts`` (session, text, start, end of all), words that wait for more pieces, and the number of the first that waits.

    The first word has number ``no``. Unless these are the ``last`` parts, the last word waits, for its
    text, and the one before it, for its end.
    """
    sessions, texts, starts, t_ends = parts
    at = np.flatnonzero(opens)
    word = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(at, len(texts)), pa.int32()), texts), "")
    until = np.maximum.reduceat(pc.fill_null(t_ends, -np.inf).to_numpy(zero_copy_only=False), at)
    kept = pc.not_equal(word, "").to_numpy(zero_copy_only=False).copy()
    kept[-1] |= not last
    at, word, until = at[kept], word.filter(pa.array(kept)), until[kept]
    session, start, t_end = sessions.take(pa.array(at)), starts.take(pa.array(at)), pa.array(until, pa.float64(), mask=np.isneginf(until))
    n, begins = len(at), _differ(session)
    places = np.arange(n)
    number = places - np.maximum.accumulate(np.where(begins, places, 0)) + np.where(np.cumsum(begins) == 1, no, 0)
    goes_on = np.append(~begins[1:], np.zeros(min(n, 1), bool))
    following = pc.if_else(pa.array(goes_on), start.take(pa.array(np.minimum(places + 1, n - 1))), pa.scalar(None, pa.float64()))
    end = pc.coalesce(following, pc.max_element_wise(t_end, start))
    cut = n if last else n - 1 - int(n > 1 and goes_on[n - 2])
    found = [x.slice(0, cut) for x in (session, pa.array(number, pa.int64()), word, start, end)]
    return found, [x.slice(cut) for x in (session, word, start, t_end)], int(number[cut]) if cut < n else 0


def merged_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of runs of pieces that come in order, session by session. Two words at most are held of what went by."""
    names = ["session_id", "word_no", "word", "start_s", "end_s"]
    held: list[pa.Array] = []
    no = 0
    for batch in batches:
        runs = batch.column("pieces")
        of, flat = pc.list_parent_indices(runs), pc.list_flatten(runs)
        if not len(of):
            continue
        piece = pc.fill_null(pc.struct_field(flat, "piece"), "")
        mark = pc.or_(pc.starts_with(piece, "▁"), pc.starts_with(piece, " "))
        text = pc.if_else(mark, pc.utf8_slice_codeunits(piece, 1), piece)
        parts = [batch.column("session_id").take(of), text, pc.struct_field(flat, "start_s"), batch.column("t_end").take(of)]
        opens = mark.to_numpy(zero_copy_only=False)
        if held:
            opens = np.append(np.ones(len(held[0]), bool), opens)
            parts = [pa.concat_arrays(both) for both in zip(held, parts, strict=True)]
        found, held, no = _settle(parts, opens | _differ(parts[0]), no, False)
        yield pa.RecordBatch.from_arrays(found, names)
    if held:
        found, held, no = _settle(held, np.ones(len(held[0]), bool), no, True)
        yield pa.RecordBatch.from_arrays(found, names)


def _in_order(rows: DataFrame, order: list[str | Column]) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "session_id").sortWithinPartitions("session_id", *order)


def _merged(runs: DataFrame) -> DataFrame:
    ship_package(runs.sparkSession)
    small_batches(runs.sparkSession)
    kind = runs.schema["session_id"].dataType.simpleString()
    rows = runs.select("session_id", "pieces", F.col("t_end").cast("double").alias("t_end"))
    return rows.mapInArrow(merged_words, f"session_id {kind}, word_no long, word string, start_s double, end_s double")


def merge_pieces(pieces: DataFrame) -> DataFrame:
    """``session_id, word_no, word, start_s, end_s`` of ``pieces(session_id, piece_no, piece, start_s, t_end)``.

    A piece that begins with a mark or a space opens a word, and so does a bare mark; a
    word that stays empty goes. A word ends where the next begins, the last at ``t_end``.
    """
    one = F.array(F.struct("piece", F.col("start_s").cast("double").alias("start_s")))
    return _merged(_in_order(pieces, ["piece_no"]).select("session_id", one.alias("pieces"), "t_end"))


def merge_runs(runs: DataFrame, order: list[str | Column]) -> DataFrame:
    """``merge_pieces`` of ``runs(session_id, pieces, t_end)`` with columns of ``order``: many pieces a row, as ``array<struct<piece, start_s: double>>``.

    A word may go on in the next run. Runs are put in order, pieces aren't; where ``runs`` come out of a
    window of that order, they aren't sorted or shuffled again, so that only what the window has is in memory.
    """
    return _merged(_in_order(runs, order))


def decode_tokens(tokens: list[tuple[bytes, float]]) -> list[tuple[str, float]]:
    """Text pieces of byte tokens: characters that tokens split are joined, at the first byte's time.

    Bytes that no character has become U+FFFD.
    """
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    found: list[tuple[str, float]] = []
    held: float | None = None
    for raw, start in tokens:
        begin = start if held is None else held
        text = decoder.decode(raw)
        pending = decoder.getstate()[0]
        if text:
            found.append((text, begin))
        held = None if not pending else (start if text else begin)
    if rest := decoder.decode(b"", True):
        found.append((rest, held if held is not None else 0.0))
    return found


@F.pandas_udf(PIECES)
def decoded(tokens: pd.Series) -> pd.Series:
    """``decode_tokens`` over ``array<struct<raw: binary, start: double>>``."""
    rows = [decode_tokens([(bytes(t["raw"]), t["start"]) for t in row]) for row in tokens]
    return pd.Series([[{"piece": p, "start": s} for p, s in row] for row in rows])


def restore_marks(words: Column, marked: Column) -> Column:
    """Words of ``marked`` in place of ``words``, if both are the same but for marks and case; else ``words``."""
    same = (F.size(words) == F.size(marked)) & F.forall(F.arrays_zip(words.alias("a"), marked.alias("b")), lambda x: bare(x["a"]) == bare(x["b"]))
    return F.when(same, marked).otherwise(words)
