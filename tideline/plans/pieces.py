"""Queries of sweeps, phrases and unigram pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import phrases, unigram
from tideline.functions import text as tx
from tideline.operators import sweep
from tideline.plans import sqltext as sq
from tideline.plans.conversations import turns
from tideline.plans.registry import oracle_of, register
from tideline.plans.series import capped_segments, series


@register(
    "windows_of_pieces",
    f"""WITH p AS ({oracle_of("capped_segments").rstrip()}),
    w AS (SELECT user_id AS session_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events)
    SELECT w.session_id, w.seq, w.place, p.piece_no FROM w JOIN p ON p.session_id = w.session_id AND w.place BETWEEN p.first AND p.last_end - 1""",
)
def windows_of_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pieces a window is of: at the padded ends, of two."""
    order = Window.partitionBy("session_id").orderBy("at", "seq")
    windows = series(spark, sf_dir).select("session_id", "seq", (F.row_number().over(order) - 1).cast("long").alias("place"))
    return sweep.in_pieces(windows, capped_segments(spark, sf_dir))


_FIRST = f"list_slice({sq.words('text')}, 1, 2)"
_PHRASES = """SELECT string_agg(regexp_replace(source, '([.^$|()\\[\\]{{}}*+?\\\\-])', '\\\\\\1', 'g'), '|' ORDER BY length(source) DESC, source) AS pattern FROM ({})"""


@register(
    "converted_phrases",
    f"""WITH one AS ({_PHRASES.format(f"SELECT DISTINCT array_to_string(list_slice({sq.words('text')}, 1, k), ' ') AS source FROM conversations, (VALUES (1), (2), (4)) AS n(k) WHERE turn = 0 AND len({sq.words('text')}) >= k")}),
    two AS ({_PHRASES.format(f"SELECT DISTINCT {sq.words('text')}[3] AS source FROM conversations WHERE turn = 1 AND len({sq.words('text')}) >= 3")})
    SELECT conv_id AS session_id, turn AS line_id, regexp_replace(regexp_replace(text, one.pattern, '<\\0>', 'g'), two.pattern, '[\\0]', 'g') AS text
    FROM conversations, one, two WHERE text IS NOT NULL""",
)
def converted_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by two dictionaries: how conversations begin, in one, two or four words, and the third words of answers."""
    lines = turns(spark, sf_dir)
    spoken = lines.select("line_id", tx.words(F.col("text")).alias("w"))
    openings = [spoken.where((F.col("line_id") == 0) & (F.size("w") >= k)).select(F.array_join(F.slice("w", 1, k), " ").alias("source")) for k in (1, 2, 4)]
    first = openings[0].unionByName(openings[1]).unionByName(openings[2]).distinct()
    second = spoken.where((F.col("line_id") == 1) & (F.size("w") >= 3)).select(F.get("w", F.lit(2)).alias("source")).distinct()
    tables = [d.select("source", F.concat(F.lit(a), F.col("source"), F.lit(b)).alias("target")) for d, a, b in ((first, "<", ">"), (second, "[", "]"))]
    return lines.select("session_id", "line_id", phrases.converted(F.col("text"), *tables).alias("text"))


_PIECES = 400


@register(
    "unigram_scores",
    f"""WITH RECURSIVE w AS (SELECT '▁' || unnest({sq.words('text')}) AS word FROM conversations WHERE text IS NOT NULL),
    counted AS (SELECT word, count(*) AS times FROM w GROUP BY word),
    parts AS (SELECT substring(word, i, k) AS piece, sum(times) AS times FROM counted, unnest(generate_series(1, length(word))) AS a(i), unnest(generate_series(1, 4)) AS b(k) WHERE i + k - 1 <= length(word) GROUP BY 1),
    taken AS (SELECT piece, times FROM parts WHERE length(piece) = 1 UNION ALL (SELECT piece, times FROM parts WHERE length(piece) > 1 ORDER BY times DESC, piece LIMIT {_PIECES})),
    model AS (SELECT map(list(piece), list((ln(times) - ln((SELECT sum(times) FROM taken)))::FLOAT::DOUBLE)) AS m FROM taken),
    v AS (SELECT word, 0 AS i, [0.0::DOUBLE] AS best FROM counted
      UNION ALL SELECT word, i + 1, list_append(best, list_max(list_transform(generate_series(1, least(4, i + 1)), lambda k: best[i + 2 - k] + coalesce(m[substring(word, i + 2 - k, k)], -1e9)))) FROM v, model WHERE i < length(word)),
    scored AS (SELECT word, best[i + 1] AS score FROM v WHERE i = length(word))
    SELECT conv_id AS session_id, turn AS line_id, round(sum(score), 3) AS score FROM (SELECT conv_id, turn, '▁' || unnest({sq.words('text')}) AS word FROM conversations WHERE text IS NOT NULL) JOIN scored USING (word) GROUP BY ALL""",
)
def unigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best segmentation's score of each turn, by a vocabulary of all characters and the most frequent longer pieces of the table."""
    lines = turns(spark, sf_dir)
    words = lines.select(F.explode(tx.words(F.col("text"))).alias("w")).groupBy(F.concat(F.lit(unigram.SPACE), "w").alias("word")).agg(F.count(F.lit(1)).alias("times"))
    places = F.flatten(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.length("word") - i + 1)), lambda k: F.substr(F.col("word"), i, k))))
    parts = words.select(F.explode(places).alias("piece"), "times").groupBy("piece").agg(F.sum("times").alias("times"))
    longer = parts.where("length(piece) > 1").orderBy(F.desc("times"), "piece").limit(_PIECES)  # the vocabulary's size
    taken = parts.where("length(piece) = 1").unionByName(longer)
    total = taken.agg(F.sum("times").alias("total"))
    scored = taken.crossJoin(F.broadcast(total)).select("piece", (F.log("times") - F.log("total")).cast("float").cast("double").alias("score"))  # one row of totals
    model = unigram.Unigram(dict(map(tuple, scored.collect())))
    pieces = F.explode(unigram.unigram_pieces(spark, F.array_join(tx.words(F.col("text")), " "), model)).alias("piece")
    known = spark.createDataFrame(sorted(model.scores.items()), "piece string, score double")
    cut = lines.select("session_id", "line_id", pieces).groupBy("session_id", "line_id", "piece").agg(F.count(F.lit(1)).alias("times"))
    return cut.join(F.broadcast(known), "piece").groupBy("session_id", "line_id").agg(F.round(F.sum(F.col("score") * F.col("times")), 3).alias("score"))
