"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from tideline.functions.text import FILLERS

FILLER_LIST = "[" + ", ".join(f"'{f}'" for f in FILLERS) + "]"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')"


def normalize(word: str) -> str:
    return f"lower(regexp_replace({word}, '^[^\\p{{L}}\\p{{N}}'']+|[^\\p{{L}}\\p{{N}}'']+$', '', 'g'))"


def content_words(text: str) -> str:
    return f"list_filter(list_transform({words(text)}, lambda w: {normalize('w')}), lambda w: w <> '' AND NOT list_contains({FILLER_LIST}, w))"


def strip_upper(text: str) -> str:
    return (
        f"array_to_string(list_filter(list_transform({words(text)}, lambda w: replace(upper(regexp_replace(w, '[^\\p{{L}}\\p{{N}}'']', '', 'g')), 'ẞ', 'SS')),"
        " lambda w: w <> ''), ' ')"
    )


def repeated(words_sql: str, n: int) -> str:
    runs = f"list_transform(generate_series(1, len({words_sql}) - {n - 1}), lambda i: array_to_string(list_slice({words_sql}, i, i + {n - 1}), ' '))"
    return f"(len({words_sql}) >= {2 * n} AND len(list_distinct({runs})) < len({runs}))"


def stamp(seconds: str, separator: str) -> str:
    ms = f"round(greatest({seconds}, 0) * 1000)::BIGINT"
    return (
        f"lpad(({ms} // 3600000)::VARCHAR, 2, '0') || ':' || lpad((({ms} // 60000) % 60)::VARCHAR, 2, '0') || ':' ||"
        f" lpad((({ms} // 1000) % 60)::VARCHAR, 2, '0') || '{separator}' || lpad(({ms} % 1000)::VARCHAR, 3, '0')"
    )
