"""Rows of transcript files: SubRip, WebVTT, plain text, bilingual text, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.text import escape_vtt, one_line, words
from tideline.functions.times import cue_end, positive, round_ms, stamp

VTT_HEADER = "WEBVTT\n\n"


def _clean(lines: DataFrame) -> DataFrame:
    return lines.withColumn("shown", one_line(F.col("source"))).where("shown <> ''")


def _span(separator: str):  # noqa: ANN202
    return F.concat(stamp(F.col("start_s"), separator), F.lit(" --> "), stamp(cue_end(F.col("start_s"), F.col("end_s")), separator))


def srt(lines: DataFrame) -> DataFrame:
    """``session_id, line_id, block``; blocks are numbered within their session, empty lines not."""
    order = Window.partitionBy("session_id").orderBy("line_id")
    numbered = _clean(lines).withColumn("number", F.row_number().over(order))
    block = F.concat(F.col("number").cast("string"), F.lit("\n"), _span(","), F.lit("\n"), F.col("shown"), F.lit("\n\n"))
    return numbered.select("session_id", "line_id", block.alias("block"))


def vtt(lines: DataFrame) -> DataFrame:
    """``session_id, line_id, block``; a file starts with ``VTT_HEADER``."""
    return _clean(lines).select("session_id", "line_id", F.concat(_span("."), F.lit("\n"), escape_vtt(F.col("shown")), F.lit("\n\n")).alias("block"))


def txt(lines: DataFrame) -> DataFrame:
    return _clean(lines).select("session_id", "line_id", F.concat("shown", F.lit("\n")).alias("block"))


def txt_translation(lines: DataFrame) -> DataFrame:
    """Translations alone; a blank or missing one gives no row."""
    shown = lines.withColumn("shown", one_line(F.col("translation"))).where("shown <> ''")
    return shown.select("session_id", "line_id", F.concat("shown", F.lit("\n")).alias("block"))


def bilingual(lines: DataFrame) -> DataFrame:
    """The source with its time, and below it the translation, if there is one."""
    below = F.coalesce(one_line(F.col("translation")), F.lit(""))
    head = F.substring(stamp(positive(F.col("start_s")), "."), 1, 8)
    block = F.concat(
        F.lit("["), head, F.lit("] "), F.col("shown"), F.lit("\n"), F.when(below == "", "").otherwise(F.concat(F.lit(" " * 11), below, F.lit("\n"))), F.lit("\n")
    )
    return _clean(lines).select("session_id", "line_id", block.alias("block"))


def jsonl(lines: DataFrame) -> DataFrame:
    """The source rows of a transcript's log; fields without a value are left out."""
    row = F.to_json(F.struct("line_id", round_ms(F.col("start_s")).alias("start"), round_ms(F.col("end_s")).alias("end"), "source"))
    return lines.select("session_id", "line_id", row.alias("row"))


def jsonl_patch(translations: DataFrame) -> DataFrame:
    """The patch rows that follow source rows."""
    return translations.select("session_id", "line_id", F.to_json(F.struct("line_id", "translation")).alias("row"))


def word_times(lines: DataFrame, pace: float) -> DataFrame:
    """Words at an even pace from their line's start; a word ends where the next one starts."""
    spoken = lines.select("session_id", "line_id", "start_s", "end_s", F.posexplode(words(F.col("source"))).alias("word_no", "word"))
    placed = spoken.select("session_id", "line_id", F.col("word_no").cast("bigint").alias("word_no"), "word", (F.col("start_s") + pace * F.col("word_no")).alias("start_s"), "end_s")
    following = F.lead("start_s").over(Window.partitionBy("session_id", "line_id").orderBy("word_no"))
    return placed.withColumn("end_s", F.coalesce(following, F.greatest("end_s", "start_s")))
