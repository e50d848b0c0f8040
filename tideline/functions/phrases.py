"""Phrase conversion: the longest phrase that matches, from the left, by a chain of dictionaries.

A dictionary is a table of ``source, target``; of several targets the least counts, blank
sources don't. Each is a trie of its characters; the next one of the chain works on what the one before made.
Dictionaries are sent to all tasks, behind a check of their size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.session import ship_package

MOST_CHARS = 32 << 20
_END = ""


class Trie:
    """Phrases by their characters."""

    def __init__(self, phrases: dict[str, str]) -> None:
        self.root: dict = {}
        for source, target in phrases.items():
            node = self.root
            for char in source:
                node = node.setdefault(char, {})
            node[_END] = target

    def convert(self, text: str) -> str:
        """``text`` with the longest phrase at each place replaced, from the left; what is replaced isn't looked at again."""
        out, at, plain = [], 0, 0
        while at < len(text):
            node, target, end = self.root, None, at
            for k in range(at, len(text)):
                node = node.get(text[k])
                if node is None:
                    break
                if _END in node:
                    target, end = node[_END], k + 1
            if target is None:
                at += 1
                continue
            out += [text[plain:at], target]
            at = plain = end
        return "".join([*out, text[plain:]])


def dictionary(table: DataFrame) -> dict[str, str]:
    """A table of phrases; one that is too large to be sent to tasks is an error."""
    chosen = table.where("source <> '' and target is not null").groupBy("source").agg(F.min("target").alias("target"))
    size = chosen.agg(F.coalesce(F.sum(F.length("source") + F.length("target")), F.lit(0))).first()[0]
    if size > MOST_CHARS:
        raise ValueError(f"a dictionary of {size} characters; {MOST_CHARS} are sent to tasks")
    return dict(map(tuple, chosen.collect()))


def converted(text: Column, *tables: DataFrame) -> Column:
    """A text column converted by each dictionary in turn; null for null."""
    spark = tables[0].sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast([dictionary(t) for t in tables])  # at most MOST_CHARS characters each
    tries: list[Trie] = []

    @F.pandas_udf("string")
    def convert(column: pd.Series) -> pd.Series:
        if not tries:
            tries.extend(Trie(x) for x in shared.value)

        def one(text: str | None) -> str | None:
            for trie in tries if text else ():
                text = trie.convert(text)
            return text

        return column.map(one)

    return convert(text)
