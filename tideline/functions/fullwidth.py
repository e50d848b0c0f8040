"""Target-script text: full-width marks, joined parts, vocabulary. Built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks and their full-width forms.
FULL_WIDTH = {",": "，", ".": "。", ":": "：", ";": "；", "!": "！", "?": "？"}
HAN = "\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}\\x{f900}-\\x{faff}"
#: Terms that tests and examples need; a full phrase dictionary is to be injected.
SAMPLE_TERMS = {"项目经理": "專案經理", "項目經理": "專案經理", "软件": "軟體", "鼠标": "滑鼠", "内存": "記憶體"}


def punctuate(text: Column) -> Column:
    """Marks become full-width, unless inside a Latin token; spaces beside them and between Han go."""
    text = F.regexp_replace(text, r" *\.{2,} *", "……")
    for mark, wide in FULL_WIDTH.items():
        m = "\\" + mark
        text = F.regexp_replace(text, f" *(?:(?<![A-Za-z0-9]){m}|{m}(?![A-Za-z0-9])) *", wide)
    text = F.regexp_replace(text, f"(?U)(?<=[{HAN}])\\s+(?=[{HAN}])", "")
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), "[，、 ]+$", "")


def to_terms(text: Column, terms: dict[str, str]) -> Column:
    """Phrases replaced by a dictionary, longer ones first."""
    for old, new in sorted(terms.items(), key=lambda x: (-len(x[0]), x[0])):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def finish(parts: Column, terms: dict[str, str] = SAMPLE_TERMS) -> Column:
    """Parts joined, by a space unless the text so far ends on a mark; terms and marks put right."""
    shown = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    marks = F.lit("[,.:;!?，。：；！？]$")
    joined = F.aggregate(
        shown, F.lit(""), lambda acc, p: F.when((acc == "") | F.rlike(acc, marks), F.concat(acc, p)).otherwise(F.concat(acc, F.lit(" "), p))
    )
    return punctuate(to_terms(joined, terms))


def close_up(text: Column) -> Column:
    """No white space, but for one space between two ASCII letters or digits."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "(?<![A-Za-z0-9]) | (?![A-Za-z0-9])", "")


def join_pieces(pieces: Column) -> Column:
    """Sub-word pieces joined, their marks read as spaces."""
    return F.replace(F.array_join(pieces, ""), F.lit("▁"), F.lit(" "))


def cut_short(text: Column) -> Column:
    """Whether a translation stops at a comma."""
    return F.rlike(F.regexp_replace(text, r"(?U)\s+$", ""), F.lit("[,，、]$"))
