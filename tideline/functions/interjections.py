"""Pieces made of interjections only, answered without a model. Built-in expressions.

A word is reduced to its shape: lower case, marks dropped, repeated letters once. Shapes
are told apart by the letters that they are made of.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.text import let, words

# Whole-word shapes and their renderings.
WORDS = {
    "yeah": "對", "yea": "對", "yeh": "對", "yah": "對", "ya": "對", "yep": "對", "yup": "對", "yes": "對", "right": "對",
    "okay": "好", "okey": "好", "ok": "好", "huh": "蛤", "wow": "哇", "eh": "欸", "uh-huh": "嗯", "uh-uh": "不",
}
# What shapes of certain letters are rendered as.
SOUNDS = (
    ("^[hm]*m[hm]*$", "嗯"),
    ("^[hm]*m[hm]*(-[hm]*m[hm]*)+$", "嗯"),
    ("^o[oh]*h[oh]*$", "喔"),
    ("^a[ah]*h[ah]*$", "啊"),
    ("^u[hm]+$", "呃"),
    ("^e[rhm]+$", "呃"),
)


def shape(word: Column) -> Column:
    """The word's shape; null if it has anything but ASCII letters, hyphens, stops and apostrophes."""
    plain = F.regexp_replace(F.lower(word), "[.'’]", "")
    single = F.regexp_replace(F.regexp_replace(plain, "([a-z-])\\1+", "$1"), "^-+|-+$", "")
    return F.when(F.rlike(word, F.lit("^[A-Za-z.'’-]*$")) & (single != ""), single)


def interjection(word: Column) -> Column:
    """The word's rendering, or null if it is no interjection."""

    def classify(s: Column) -> Column:
        known = F.try_element_at(F.create_map(*(F.lit(x) for pair in WORDS.items() for x in pair)), s)
        sound = F.lit(None).cast("string")
        for pattern, text in reversed(SOUNDS):
            sound = F.when(F.rlike(s, F.lit(pattern)), text).otherwise(sound)
        return F.coalesce(known, sound)

    return let(shape(word), classify)


def render(piece: Column) -> Column:
    """Renderings with the marks that follow them; null unless every word is an interjection."""
    edges = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
    parts = F.transform(
        words(piece),
        lambda t: F.struct(F.regexp_replace(t, edges, "").alias("core"), F.regexp_extract(t, r"([^\p{L}\p{N}]*)$", 1).alias("tail")),
    )

    def answer(spoken: Column) -> Column:
        rendered = F.transform(spoken, lambda p: F.concat(interjection(p["core"]), p["tail"]))
        return F.when(
            (F.size(spoken) > 0) & F.forall(rendered, lambda x: x.isNotNull()), F.array_join(rendered, "")
        )

    return let(F.filter(parts, lambda p: p["core"] != ""), answer)
