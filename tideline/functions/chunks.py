"""Texts cut into pieces that a translation model can carry. Built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.text import clauses, let, sentences, width_cut, word_count


def _glued(parts: Column, most: int) -> Column:
    """Clauses put together until a group has ``most`` words; the rest is a group."""
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, clause: Column) -> Column:
        group = F.when(acc["open"] == "", clause).otherwise(F.concat(acc["open"], F.lit(" "), clause))
        full = word_count(group) >= most
        return F.struct(
            F.when(full, "").otherwise(group).alias("open"), F.when(full, F.concat(acc["out"], F.array(group))).otherwise(acc["out"]).alias("out")
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["open"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["open"]))))


def split(text: Column, most: int, run: int, heard: bool = False) -> Column:
    """Pieces of about ``most`` words: sentences, else glued clauses, else cuts by width.

    A piece of more than ``run`` words without marks to cut at is cut into equal parts;
    ``run = 0``, or marks that were heard and not inferred, leave it whole. ``most = 0``
    turns splitting off. White space inside a piece that is put together is one space.
    """
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    if most == 0:
        return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.array(trimmed))

    def cut(piece: Column) -> Column:
        if run == 0:
            return F.array(piece)
        whole = word_count(piece) <= run
        if heard:
            whole = whole | F.rlike(text, F.lit("[.!?,;:]"))
        return F.when(whole, F.array(piece)).otherwise(width_cut(piece, run))

    def pieces(sentence: Column) -> Column:
        groups = let(_glued(clauses(sentence), most), lambda g: F.flatten(F.transform(g, cut)))
        return F.when(word_count(sentence) <= most, cut(sentence)).otherwise(groups)

    return F.flatten(F.transform(sentences(text), pieces))
