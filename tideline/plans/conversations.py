"""Queries over conversations: one conversation is a session, one turn a line."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import text as tx
from tideline.functions import times as tm
from tideline.operators import fold, merge, render, waiting
from tideline.plans import sqltext as sq
from tideline.plans.registry import register
from tideline.session import table

PACE = 0.4


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    return rows.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("line_id"), "text")


def spoken_until(line: Column, count: Column) -> Column:
    """When a line of so many words ends: worked out in decimals, as doubles of tenths add up to one ulp more or less."""
    return (line * F.lit(10) + F.lit(Decimal(str(PACE))) * count).cast("double")


def two_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines of both lanes, disturbed by turn so that every branch is taken."""
    kind = F.col("line_id") % 5
    accurate = (
        F.when(kind == 1, F.array_join(F.slice(tx.words(F.col("text")), 1, 2), " "))
        .when(kind == 2, F.concat_ws(" ", "text", "text", "text"))
        .when(kind >= 3, None)
        .otherwise(F.col("text"))
    )
    return turns(spark, sf_dir).select(
        "session_id",
        "line_id",
        tx.strip_upper(F.col("text")).alias("quick"),
        accurate.alias("accurate"),
        (kind == 3).alias("timed_out"),
        (F.col("line_id") * 10.0).alias("start_s"),
        spoken_until(F.col("line_id"), tx.word_count(F.col("text"))).alias("end_s"),
    )


LANES_SQL = f"""
WITH lanes AS (
  SELECT conv_id AS session_id, turn AS line_id, {sq.strip_upper('text')} AS quick,
    CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN array_to_string(list_slice({sq.words('text')}, 1, 2), ' ') WHEN 2 THEN text || ' ' || text || ' ' || text END AS accurate,
    turn % 5 = 3 AS timed_out, turn * 10.0::DOUBLE AS start_s, (turn * 10.0 + {PACE} * len({sq.words('text')}))::DOUBLE AS end_s
  FROM conversations WHERE text IS NOT NULL
)
"""

_SETTLED_SQL = LANES_SQL + f""", counted AS (
  SELECT *, {sq.content_words('quick')} AS q, {sq.content_words('accurate')} AS a FROM lanes
), judged AS (
  SELECT *, CASE WHEN accurate IS NULL THEN CASE WHEN timed_out THEN 'accurate_timeout' END
    WHEN len(q) = 0 THEN NULL
    WHEN len(a) = 0 OR (len(q) - len(a) >= 5 AND len(a) < 0.6 * len(q)) THEN 'accurate_truncated'
    WHEN len(a) - len(q) >= 5 AND len(a) > 1.5 * len(q) AND {sq.repeated('a', 4)} THEN 'accurate_looped' END AS reason
  FROM counted
), settled AS (
  SELECT session_id, line_id, start_s, end_s, CASE WHEN reason IS NULL THEN accurate ELSE quick END AS source,
    CASE WHEN reason IS NULL THEN 'accurate' ELSE 'fast' END AS lane, reason
  FROM judged WHERE accurate IS NOT NULL OR timed_out
)
"""


@register("settled_lines", _SETTLED_SQL + "SELECT * FROM settled")
def settled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.settle(two_lanes(spark, sf_dir))


@register("settled_reason_counts", _SETTLED_SQL + "SELECT coalesce(reason, 'accurate') AS reason, count(*) AS n FROM settled GROUP BY ALL")
def settled_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled_lines(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("accurate")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@register("strip_upper_lines", f"SELECT conv_id AS session_id, turn AS line_id, {sq.strip_upper('text')} AS quick FROM conversations WHERE text IS NOT NULL")
def strip_upper_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("session_id", "line_id", tx.strip_upper(F.col("text")).alias("quick"))


@register("worth_translating", f"SELECT conv_id AS session_id, turn AS line_id FROM conversations WHERE len({sq.content_words('text')}) > 0")
def worth_translating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).where(F.size(tx.content_words(F.col("text"))) > 0).select("session_id", "line_id")


@register(
    "sentence_ends",
    f"""SELECT conv_id AS session_id, turn AS line_id,
    list_filter(generate_series(0, len(w) - 1), lambda i: regexp_matches(w[i + 1], '[.!?]["'')\\]”]*$')) AS sentence_at,
    len(list_filter(w, lambda x: regexp_matches(x, '[,;:]["'')\\]”]*$')))::BIGINT AS n_clause_ends
    FROM (SELECT *, {sq.words('text')} AS w FROM conversations WHERE text IS NOT NULL)""",
)
def sentence_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tx.words(F.col("text"))
    found = turns(spark, sf_dir).select("session_id", "line_id", w.alias("w"))
    at = F.transform(F.filter(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: tx.ends_sentence(s["x"])), lambda s: s["i"].cast("bigint"))
    return found.select("session_id", "line_id", at.alias("sentence_at"), F.size(F.filter("w", tx.ends_clause)).cast("bigint").alias("n_clause_ends"))


_TURN = "conv_id AS session_id, turn AS line_id"
_START, _END = "(turn * 10.0)::DOUBLE", f"(turn * 10.0 + {PACE} * len({sq.words('text')}))::DOUBLE"
_LINE = "trim(regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x9f ]+', ' ', 'g'))"
_NUMBER = "row_number() OVER (PARTITION BY conv_id ORDER BY turn)"


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = turns(spark, sf_dir)
    return lines.select(
        "session_id",
        "line_id",
        F.col("text").alias("source"),
        (F.col("line_id") * 10.0).alias("start_s"),
        spoken_until(F.col("line_id"), tx.word_count(F.col("text"))).alias("end_s"),
    )


@register(
    "srt_cues",
    f"""SELECT {_TURN}, {_NUMBER}::VARCHAR || chr(10) || {sq.stamp(_START, ',')} || ' --> ' || {sq.stamp(f'greatest({_END}, {_START} + 0.5)', ',')} || chr(10)
    || {_LINE} || chr(10) || chr(10) AS block FROM conversations WHERE {_LINE} <> ''""",
)
def srt_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.srt(timed(spark, sf_dir))


@register(
    "vtt_cues",
    f"""SELECT {_TURN}, {sq.stamp(_START, '.')} || ' --> ' || {sq.stamp(f'greatest({_END}, {_START} + 0.5)', '.')} || chr(10)
    || replace(replace(replace({_LINE}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || chr(10) || chr(10) AS block FROM conversations WHERE {_LINE} <> ''""",
)
def vtt_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.vtt(timed(spark, sf_dir))


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in translation for every second turn: its content words."""
    even = turns(spark, sf_dir).where("line_id % 2 = 0")
    return even.select("session_id", "line_id", F.array_join(tx.content_words(F.col("text")), " ").alias("translation"))


_TRANSLATED = f"CASE WHEN turn % 2 = 0 THEN array_to_string({sq.content_words('text')}, ' ') END"


@register(
    "bilingual_rows",
    f"""SELECT session_id, line_id, '[' || left({sq.stamp('start_s', '.')}, 8) || '] ' || line || chr(10)
    || CASE WHEN coalesce(t, '') = '' THEN '' ELSE repeat(' ', 11) || t || chr(10) END || chr(10) AS block
    FROM (SELECT {_TURN}, {_START} AS start_s, {_LINE} AS line, {_TRANSLATED} AS t FROM conversations WHERE text IS NOT NULL) WHERE line <> ''""",
)
def bilingual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = timed(spark, sf_dir).join(translations(spark, sf_dir), ["session_id", "line_id"], "left")
    return render.bilingual(both)


@register(
    "jsonl_rows",
    f"""SELECT {_TURN}, '{{"line_id":' || turn || ',"start":' || {_START}::VARCHAR || ',"end":' || round({_END}, 3)::VARCHAR || ',"source":' || to_json(text)::VARCHAR || '}}' AS row
    FROM conversations WHERE text IS NOT NULL""",
)
def jsonl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.jsonl(timed(spark, sf_dir))


@register(
    "fold_patches",
    f"""SELECT {_TURN}, {_START} AS start_s, round({_END}, 3) AS end_s, text AS source, {_TRANSLATED} AS translation FROM conversations WHERE text IS NOT NULL""",
)
def fold_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timed(spark, sf_dir).select("session_id", "line_id", F.lit(0).alias("seq"), "start_s", F.round("end_s", 3).alias("end_s"), "source")
    log = rows.withColumn("translation", F.lit(None).cast("string")).unionByName(
        translations(spark, sf_dir).withColumn("seq", F.lit(1)), allowMissingColumns=True
    )
    return fold.fold_log(log, ["session_id", "line_id"], "seq")


@register(
    "in_order_overtaken",
    f"""WITH t AS (SELECT {_TURN}, CASE WHEN turn % 3 = 1 THEN upper(substr(text, 1, 5)) END AS translation,
      max(CASE WHEN turn % 3 = 1 THEN turn END) OVER (PARTITION BY conv_id) AS newest FROM conversations WHERE text IS NOT NULL)
    SELECT session_id, line_id, translation, CASE WHEN translation IS NOT NULL THEN 'translated' WHEN line_id < newest THEN 'overtaken' ELSE 'flushed' END AS state FROM t""",
)
def in_order_overtaken(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = turns(spark, sf_dir)
    done = lines.where("line_id % 3 = 1").select("session_id", "line_id", tx.upper_each(F.substring("text", 1, 5)).alias("translation"))
    return waiting.in_order(lines.select("session_id", "line_id"), done)


@register(
    "draft_reuse",
    f"""SELECT {_TURN}, turn % 2 = 0 AS reused FROM conversations WHERE text IS NOT NULL""",
)
def draft_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = turns(spark, sf_dir).select("session_id", "line_id", F.col("text").alias("source"))
    drafts = jobs.select("session_id", "line_id", F.when(F.col("line_id") % 2 == 0, F.col("source")).otherwise(F.concat("source", F.lit("?"))).alias("source"))
    drafts = drafts.select("*", F.lit(1).alias("made"), F.lower("source").alias("answer"))
    return waiting.reuse_drafts(jobs, drafts).select("session_id", "line_id", F.col("answer").isNotNull().alias("reused"))


@register(
    "word_times",
    f"""SELECT session_id, line_id, i - 1 AS word_no, w[i] AS word, line_id * 10.0 + {PACE} * (i - 1) AS start_s,
    CASE WHEN i < len(w) THEN line_id * 10.0 + {PACE} * i ELSE line_id * 10.0 + {PACE} * len(w) END AS end_s
    FROM (SELECT {_TURN}, {sq.words('text')} AS w FROM conversations), unnest(generate_series(1, len(w))) AS t(i)""",
)
def word_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.word_times(timed(spark, sf_dir), PACE)


@register(
    "word_to_line",
    f"""WITH w AS (SELECT session_id, line_id * 10.0 + {PACE} * (i - 0.5) AS mid FROM (SELECT {_TURN}, {sq.words('text')} AS w FROM conversations), unnest(generate_series(1, len(w))) AS t(i)),
    l AS (SELECT {_TURN}, {_END} AS t_end, max({_END}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM conversations WHERE text IS NOT NULL)
    SELECT l.session_id, l.line_id, count(w.mid) AS n_words FROM l LEFT JOIN w ON w.session_id = l.session_id AND w.mid >= coalesce(l.prev, 0) AND w.mid < l.t_end
    GROUP BY l.session_id, l.line_id""",
)
def word_to_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = timed(spark, sf_dir)
    heard = render.word_times(lines, PACE).select("session_id", tm.midpoint(F.col("start_s"), F.col("end_s")).alias("mid"))
    return waiting.claim_words(heard, lines.select("session_id", "line_id", F.col("end_s").alias("t_end")))


@register(
    "width_cut",
    f"""WITH c AS (SELECT {_TURN}, {sq.words('text')} AS w FROM conversations WHERE text IS NOT NULL),
    p AS (SELECT *, ceil(len(w) / 12.0)::BIGINT AS parts FROM c WHERE len(w) > 0)
    SELECT session_id, line_id, k AS piece_no, array_to_string(list_slice(w, k * (len(w) // parts) + least(k, len(w) % parts) + 1,
      k * (len(w) // parts) + least(k, len(w) % parts) + len(w) // parts + CASE WHEN k < len(w) % parts THEN 1 ELSE 0 END), ' ') AS piece
    FROM p, unnest(generate_series(0, parts - 1)) AS t(k)""",
)
def width_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = turns(spark, sf_dir).select("session_id", "line_id", F.posexplode(tx.width_cut(F.col("text"), 12)).alias("piece_no", "piece"))
    return pieces.withColumn("piece_no", F.col("piece_no").cast("bigint"))


@register("last_line", "SELECT conv_id AS session_id, max(turn) AS line_id FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def last_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = Window.partitionBy("session_id").orderBy(F.desc("line_id"))
    return turns(spark, sf_dir).withColumn("place", F.row_number().over(newest)).where("place = 1").select("session_id", "line_id")
