r"""Chat formatting by schema fingerprint.

Each record's nested field paths (names only, without types or values) are hashed.
The hash selects a declarative mapping, an SQL expression that yields canonical turns
``array<struct<pos, role, text>>``. A record whose hash isn't known, as it has more fields, takes
the first mapping all of whose paths it has; a text in ``system`` is a turn before the others.
A layout that no mapping knows, or whose values don't fit, gives no turns: it is reported
with a null layout, or null turns, and its conversation has a row without a text.

Template: ``<turn ROLE>TEXT</turn>\n`` for each turn. Inside roles and texts ``\`` is
written ``\\``, ``<`` is ``\l`` and ``>`` is ``\g``, so that no text can hold a mark, and
reading back gives the exact text. The loss mask covers the texts of assistant turns.

Everything here is DataFrame expressions; records are VARIANT values.

Defined results: null role or text counts as empty; a null conversation key is a key of
its own; equal rows are kept, each as a turn; ties of position are ordered by role, then
text; empty input gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<pos:bigint,role:string,text:string>"
END = "</turn>\n"

_PAIR = "array(named_struct('pos', 0L, 'role', 'user', 'text', {0}), named_struct('pos', 1L, 'role', 'assistant', 'text', {1}))"
_S = "try_variant_get(record, '$.{0}', 'string')".format

#: layout -> (shapes of its field paths, the paths that it needs, expression for its turns). ``record`` is the VARIANT.
MAPPINGS: dict[str, tuple[list[str], list[str], str]] = {
    "turn_row": (
        ["OBJECT<conv_id, role, text, turn>", "OBJECT<role, text, turn>"],
        ["turn", "role", "text"],
        f"array(named_struct('pos', try_variant_get(record, '$.turn', 'bigint'), 'role', {_S('role')}, 'text', {_S('text')}))",
    ),
    "messages": (
        ["OBJECT<messages: ARRAY<OBJECT<content, role>>>", "OBJECT<id, messages: ARRAY<OBJECT<content, role>>>"],
        ["messages[0].role", "messages[0].content"],
        "transform(try_variant_get(record, '$.messages', 'array<struct<role string, content string>>'),"
        " (m, i) -> named_struct('pos', cast(i as bigint), 'role', m.role, 'text', m.content))",
    ),
    "from_value": (
        ["OBJECT<conversations: ARRAY<OBJECT<from, value>>>", "OBJECT<conversations: ARRAY<OBJECT<from, value>>, id>"],
        ["conversations[0].from", "conversations[0].value"],
        "transform(try_variant_get(record, '$.conversations', 'array<struct<`from` string, value string>>'), (m, i) ->"
        " named_struct('pos', cast(i as bigint), 'role', case m.`from` when 'human' then 'user' when 'gpt' then 'assistant'"
        " else m.`from` end, 'text', m.value))",
    ),
    "prompt_response": (["OBJECT<prompt, response>"], ["prompt", "response"], _PAIR.format(_S("prompt"), _S("response"))),
    "prompt_completion": (["OBJECT<completion, prompt>"], ["prompt", "completion"], _PAIR.format(_S("prompt"), _S("completion"))),
    "instruction": (
        ["OBJECT<input, instruction, output>", "OBJECT<instruction, output>"],
        ["instruction", "output"],
        _PAIR.format(f"concat_ws('\\n\\n', {_S('instruction')}, nullif({_S('input')}, ''))", _S("output")),
    ),
    "question_answer": (["OBJECT<answer, question>"], ["question", "answer"], _PAIR.format(_S("question"), _S("answer"))),
}


def fingerprint(record: Column) -> Column:
    """SHA-256 of the tree of field paths of a VARIANT, without types."""
    shape = F.regexp_replace(F.schema_of_variant(record), r"(: )?\b(VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|STRING|DATE|BINARY|UUID|TIMESTAMP(_NTZ)?|DECIMAL\(\d+,\s*\d+\))(?=[,>]|$)", "")
    return F.sha2(shape, 256)


def to_turns(records: DataFrame, record: str = "record", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep..., fingerprint, layout, turns`` for each record."""
    base = records.select(*keep, F.col(record).alias("record")).withColumn("fingerprint", fingerprint(F.col("record")))
    exact, near = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (shapes, paths, _) in reversed(MAPPINGS.items()):
        exact = F.when(F.col("fingerprint").isin([hashlib.sha256(s.encode()).hexdigest() for s in shapes]), name).otherwise(exact)
        near = F.when(F.expr(" and ".join(f"try_variant_get(record, '$.{path}', 'variant') is not null" for path in paths)), name).otherwise(near)
    named = base.withColumn("layout", F.coalesce(exact, near))
    turns = F.lit(None).cast(f"array<{TURN}>")
    for name, (_, _, expression) in MAPPINGS.items():
        turns = F.when(F.col("layout") == name, F.expr(expression).cast(f"array<{TURN}>")).otherwise(turns)
    system = F.expr("try_variant_get(record, '$.system', 'string')")
    first = F.array(F.struct(F.lit(-1).cast("long").alias("pos"), F.lit("system").alias("role"), system.alias("text")))
    return named.select(*keep, "fingerprint", "layout", F.when(system.isNotNull(), F.concat(first, turns)).otherwise(turns).alias("turns"))


def escape(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for plain, coded in (("\\", "\\\\"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    """The inverse of ``escape``; a pair of backslashes is one, read from the left."""

    def piece(p: Column) -> Column:
        return F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), piece), "\\")


def render(turns: Column) -> Column:
    """Segments ``array<struct<text, loss>>`` whose texts together are the formatted string."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct(F.concat(F.lit("<turn "), escape(t["role"]), F.lit(">")).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(t["text"]).alias("text"), F.coalesce(t["role"] == "assistant", F.lit(False)).alias("loss")),
                F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )


def format_chats(turns: DataFrame, key: str) -> DataFrame:
    """``key, formatted, segments``: one row for each conversation of ``turns(key, turns)``.

    One without any turn has nulls there, so that nothing is lost unseen.
    """
    single = turns.select(F.col(key), F.explode_outer("turns").alias("turn"))
    whole = single.groupBy(key).agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    whole = whole.withColumn("turns", F.when(F.size("turns") > 0, F.col("turns")))
    return whole.select(key, render(F.col("turns")).alias("segments")).select(
        key, F.array_join(F.col("segments.text"), "").alias("formatted"), "segments"
    )


def read_back(formatted: Column) -> Column:
    """Canonical turns ``array<struct<role, text>>`` out of a formatted string."""
    pieces = F.split(formatted, END, -1)
    return F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(7)), ">", 1)).alias("role"),
            unescape(F.substr(p, F.locate(">", p) + 1)).alias("text"),
        ),
    )


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digests(chats: DataFrame, key: str) -> DataFrame:
    """What the formatted strings and masks hold, as counts and SHA-256 digests."""
    read = chats.select(key, "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
