"""Queries over documents and literal cases: words, cuts, marks, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import chunks, fullwidth, interjections
from tideline.functions import text as tx
from tideline.functions.text import FILLERS, SPELLINGS, TENS, UNITS
from tideline.operators import confirm, joins, scoring, words
from tideline.plans import sqltext as sq
from tideline.plans.conversations import turns
from tideline.plans.registry import register
from tideline.session import table


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")


@register(
    "content_word_counts",
    f"SELECT doc_id, len({sq.words('text')})::BIGINT AS n_words, len({sq.content_words('text')})::BIGINT AS n_content FROM documents WHERE text IS NOT NULL",
)
def content_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return docs(spark, sf_dir).select(
        "doc_id", tx.word_count(text).cast("bigint").alias("n_words"), F.size(tx.content_words(text)).cast("bigint").alias("n_content")
    )


@register(
    "normalized_words",
    f"SELECT {sq.normalize('w')} AS word, count(*) AS n FROM (SELECT unnest({sq.words('text')}) AS w FROM documents) WHERE {sq.normalize('w')} <> '' GROUP BY ALL",
)
def normalized_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    # raw words are counted first, and only the distinct ones are normalised
    raw = docs(spark, sf_dir).select(F.explode(tx.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    return raw.select(tx.normalize(F.col("w")).alias("word"), "c").where("word <> ''").groupBy("word").agg(F.sum("c").alias("n"))


@register("repeated_runs", f"SELECT doc_id, {sq.repeated('w', 4)} AS repeated FROM (SELECT doc_id, {sq.content_words('text')} AS w FROM documents WHERE text IS NOT NULL)")
def repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.content_words(F.col("text")).alias("w")).select("doc_id", tx.has_repeated_run(F.col("w"), 4).alias("repeated"))


def _spelled(n: str) -> str:
    units = "[" + ", ".join(f"'{u}'" for u in UNITS) + "]"
    tens = "[" + ", ".join(f"'{t}'" for t in TENS) + "]"

    def hundred(x: str, zero: str) -> str:
        return (
            f"CASE WHEN {x} = 0 THEN {zero} WHEN {x} < 20 THEN [{units}[{x} + 1]] WHEN {x} % 10 = 0 THEN [{tens}[{x} // 10 - 1]]"
            f" ELSE [{tens}[{x} // 10 - 1], {units}[{x} % 10 + 1]] END"
        )

    def thousand(x: str, zero: str) -> str:
        return f"CASE WHEN {x} >= 100 THEN list_concat([{units}[{x} // 100 + 1], 'hundred'], {hundred(f'({x} % 100)', '[]')}) ELSE {hundred(x, zero)} END"

    low = thousand(f"({n} % 1000)", "[]")
    return f"CASE WHEN {n} >= 1000 THEN list_concat(list_append({thousand(f'({n} // 1000)', '[]')}, 'thousand'), {low}) ELSE {thousand(n, chr(91) + chr(39) + 'zero' + chr(39) + chr(93))} END"


_VARIANTS = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPELLINGS.items()) + " ELSE w END"


@register(
    "metric_tokens",
    f"""WITH raw AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_''\\s]', ' ', 'g')), '\\s+'), lambda w: w <> '')) AS w FROM documents),
    num AS (SELECT doc_id, w, CASE WHEN regexp_full_match(w, '[0-9]{{1,6}}') THEN w::BIGINT END AS n FROM raw),
    tok AS (SELECT doc_id, unnest(CASE WHEN n IS NOT NULL THEN {_spelled('n')} ELSE [{_VARIANTS}] END) AS t FROM num)
    SELECT doc_id, t AS token, count(*) AS n FROM tok
    WHERE NOT list_contains({sq.FILLER_LIST}, t) AND t NOT LIKE '%\\_%' ESCAPE '\\' AND (length(t) > 1 OR t IN ('a', 'i')) GROUP BY ALL""",
)
def metric_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = docs(spark, sf_dir).select("doc_id", F.explode(tx.metric_tokens(F.col("text"), True)).alias("token"))
    return tokens.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


_CUT = "string_split(regexp_replace(text, '([.!?])(\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


@register(
    "sentence_pieces",
    f"""SELECT doc_id, count(*) AS n_pieces, sum(length(p))::BIGINT AS chars FROM (SELECT doc_id, regexp_replace(unnest({_CUT}), '^\\s+|\\s+$', '', 'g') AS p FROM documents)
    WHERE p <> '' GROUP BY doc_id""",
)
def sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = docs(spark, sf_dir).select("doc_id", tx.sentences(F.col("text")).alias("p")).where(F.size("p") > 0)
    return found.select("doc_id", F.size("p").cast("bigint").alias("n_pieces"), F.length(F.array_join("p", "")).cast("bigint").alias("chars"))


@register("clause_chunks")
def clause_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("session_id", "line_id", F.posexplode(chunks.split(F.col("text"), 6, 6)).alias("piece_no", "piece"))


@register(
    "ellipsis_and_stop",
    """SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\s*\\.(?:\\s*\\.)+', '...', 'g'), '\\s+$', ''), '([^.])\\.$', '\\1') AS shown
    FROM documents WHERE text IS NOT NULL""",
)
def ellipsis_and_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.trim_final_stop(tx.collapse_spaced_ellipsis(F.col("text"))).alias("shown"))


@register(
    "one_line_text",
    """SELECT doc_id, md5(replace(replace(replace(trim(regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x9f ]+', ' ', 'g')), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS digest
    FROM documents WHERE text IS NOT NULL""",
)
def one_line_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(tx.escape_vtt(tx.one_line(F.col("text"))).cast("binary")).alias("digest"))


@register(
    "prompt_tail",
    """SELECT doc_id, right(text, 200) AS tail, CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(right(text, 200), '^\\S*\\s*', '') END AS on_word
    FROM documents WHERE text IS NOT NULL""",
)
def prompt_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return docs(spark, sf_dir).select("doc_id", tx.prompt_tail(text, 200).alias("tail"), tx.prompt_tail_on_word(text, 200).alias("on_word"))


_INTERJECTIONS = ("Mm-hmm.", "Oh, yeah.", "Ummm", "uh-uh", "uh-huh!", "on", "ere", "Right?", "o.k.", "Hmmm...", "wow so", "Yeahhh, okayyy.", "ah", "42", "- oh")


_SOUND = " ".join(f"WHEN regexp_matches(single, '{p}') THEN '{t}'" for p, t in interjections.SOUNDS)
_KNOWN = " ".join(f"WHEN '{w}' THEN '{t}'" for w, t in interjections.WORDS.items())
_BARE = "'^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$'"


@register(
    "interjections",
    f"""WITH p AS (SELECT row_number() OVER () AS id, piece FROM (SELECT unnest([{", ".join("'" + x.replace("'", "''") + "'" for x in _INTERJECTIONS)}]) AS piece UNION ALL SELECT text FROM conversations WHERE text IS NOT NULL)),
    t AS (SELECT id, i, {sq.words("piece")}[i] AS t FROM p, unnest(generate_series(1, len({sq.words("piece")}))) AS g(i)),
    c AS (SELECT id, i, regexp_replace(t, {_BARE}, '', 'g') AS core, regexp_extract(t, '([^\\p{{L}}\\p{{N}}]*)$', 1) AS tail FROM t),
    l AS (SELECT *, string_split(regexp_replace(lower(core), '[.''’]', '', 'g'), '') AS chars FROM c WHERE core <> ''),
    s AS (SELECT *, regexp_replace(array_to_string(list_filter(chars, lambda x, k: k = 1 OR x <> chars[k - 1]), ''), '^-+|-+$', '', 'g') AS single FROM l),
    r AS (SELECT id, i, CASE WHEN regexp_full_match(core, '[A-Za-z.''’-]*') AND single <> '' THEN coalesce(CASE single {_KNOWN} END, CASE {_SOUND} END) END || tail AS rendered FROM s),
    w AS (SELECT id, CASE WHEN count(*) = count(rendered) THEN string_agg(rendered, '' ORDER BY i) END AS rendered FROM r GROUP BY id)
    SELECT piece, rendered FROM p LEFT JOIN w USING (id)""",
)
def interjection_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in _INTERJECTIONS))).alias("piece"))
    spoken = turns(spark, sf_dir).select(F.col("text").alias("piece"))
    return cases.unionByName(spoken).select("piece", interjections.render(F.col("piece")).alias("rendered"))


def _twice(text: str, pattern: str, by: str) -> str:
    """A replacement whose matches share their ends."""
    return f"regexp_replace(regexp_replace({text}, '{pattern}', '{by}', 'g'), '{pattern}', '{by}', 'g')"


def _wide(text: str) -> str:
    text = f"regexp_replace({text}, ' *\\.{{2,}} *', '……', 'g')"
    for mark, wide in fullwidth.FULL_WIDTH.items():
        held = _twice(text, f"([A-Za-z0-9])\\{mark}([A-Za-z0-9])", "\\1\ue000\\2")
        text = f"replace(regexp_replace({held}, ' *\\{mark} *', '{wide}', 'g'), '\ue000', '{mark}')"
    text = _twice(text, f"([{fullwidth.HAN}])\\s+([{fullwidth.HAN}])", "\\1\\2")
    return f"regexp_replace(regexp_replace({text}, '^\\s+|\\s+$', '', 'g'), '[，、 ]+$', '')"


_CLOSED = _twice("regexp_replace(t, '\\s+', ' ', 'g')", "([A-Za-z0-9]) ([A-Za-z0-9])", "\\1\ue000\\2")


@register(
    "full_width",
    f"""WITH c AS (SELECT conv_id AS session_id, turn AS line_id, translate(text, 'aeiou', '你好世界他') AS t FROM conversations WHERE text IS NOT NULL)
    SELECT session_id, line_id, {_wide("t")} AS wide, replace(replace({_CLOSED}, ' ', ''), '\ue000', ' ') AS closed FROM c""",
)
def full_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with Han characters for vowels, so that marks stand between both scripts."""
    text = F.translate("text", "aeiou", "你好世界他")
    return turns(spark, sf_dir).select("session_id", "line_id", fullwidth.punctuate(text).alias("wide"), fullwidth.close_up(text).alias("closed"))


def lanes_to_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns against themselves, disturbed by turn: whole, cut short, with a hole, upper case."""
    w = tx.words(F.col("text"))
    kind = F.col("line_id") % 4
    hole = F.concat(F.slice(w, 1, 4), F.slice(w, 12, F.greatest(F.size(w), F.lit(1))))
    hyp = (
        F.when(kind == 1, F.array_join(F.slice(w, 1, 4), " "))
        .when(kind == 2, F.array_join(hole, " "))
        .when(kind == 3, tx.strip_upper(F.col("text")))
        .otherwise(F.col("text"))
    )
    return turns(spark, sf_dir).select("session_id", "line_id", F.col("text").alias("ref"), hyp.alias("hyp"))


@register(
    "sentence_boundaries",
    f"""WITH w AS (SELECT conv_id AS session_id, turn AS line_id, i, {sq.words('text')}[i] AS raw FROM conversations, unnest(generate_series(1, len({sq.words('text')}))) AS g(i) WHERE text IS NOT NULL),
    t AS (SELECT *, unnest(list_filter(string_split_regex(lower(regexp_replace(raw, '[^\\p{{L}}\\p{{N}}_''\\s]', ' ', 'g')), '\\s+'), lambda w: w <> '')) AS w FROM w),
    n AS (SELECT *, CASE WHEN regexp_full_match(w, '[0-9]{{1,6}}') THEN w::BIGINT END AS n FROM t),
    k AS (SELECT session_id, line_id, i, any_value(raw) AS raw, sum(CASE WHEN n IS NOT NULL THEN len({_spelled('n')}) ELSE 1 END) AS size FROM n GROUP BY ALL),
    c AS (SELECT *, sum(size) OVER (PARTITION BY session_id, line_id ORDER BY i) AS upto FROM k)
    SELECT session_id, line_id, sum(size)::BIGINT AS n_tokens, coalesce(string_agg((upto - 1)::BIGINT::VARCHAR, ' ' ORDER BY i) FILTER (WHERE regexp_matches(raw, '[.!?]["'')\\]”]*$')), '') AS ends, (max(upto) - arg_max(size, i))::BIGINT AS last_word
    FROM c GROUP BY ALL""",
)
def sentence_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = turns(spark, sf_dir).select("session_id", "line_id", tx.boundaries(F.col("text")).alias("b")).where("size(b.tokens) > 0")
    return found.select("session_id", "line_id", F.size("b.tokens").cast("long").alias("n_tokens"), F.array_join("b.ends", " ").alias("ends"), F.col("b.last_word").cast("long").alias("last_word"))


_SIDE = "regexp_replace(t, '[^\\p{L}\\p{N}_''\\s]', ' ', 'g')"


@register(
    "word_error_rates",
    f"""WITH p AS (SELECT conv_id AS session_id, turn AS line_id, text AS ref, CASE turn % 4 WHEN 1 THEN array_to_string(list_slice({sq.words('text')}, 1, 4), ' ')
      WHEN 2 THEN array_to_string(list_concat(list_slice({sq.words('text')}, 1, 4), list_slice({sq.words('text')}, 12, len({sq.words('text')}))), ' ') WHEN 3 THEN regexp_replace(text, '[.,!?]', ' ', 'g') ELSE text END AS hyp
      FROM conversations WHERE text IS NOT NULL),
    t AS (SELECT session_id, line_id, true AS r, ref AS t FROM p UNION ALL SELECT session_id, line_id, false, hyp FROM p),
    raw AS (SELECT session_id, line_id, r, unnest(list_filter(string_split_regex(lower({_SIDE}), '\\s+'), lambda w: w <> '')) AS w FROM t),
    num AS (SELECT *, CASE WHEN regexp_full_match(w, '[0-9]{{1,6}}') THEN w::BIGINT END AS n FROM raw),
    tok AS (SELECT session_id, line_id, r, unnest(CASE WHEN n IS NOT NULL THEN {_spelled('n')} ELSE [{_VARIANTS}] END) AS t FROM num),
    known AS (SELECT *, NOT list_contains({sq.FILLER_LIST}, t) AND t NOT LIKE '%\\_%' ESCAPE '\\' AND (length(t) > 1 OR t IN ('a', 'i')) AS content FROM tok),
    c AS (SELECT session_id, line_id, count(*) FILTER (WHERE r) AS a, count(*) FILTER (WHERE NOT r) AS b, count(*) FILTER (WHERE r AND content) AS ac, count(*) FILTER (WHERE NOT r AND content) AS bc FROM known GROUP BY ALL)
    -- what is left of a line is in its order: of words that are only left out, each is one error
    SELECT p.session_id, p.line_id, coalesce(CASE WHEN a > 0 THEN round(100.0 * (a - b) / a, 6) END, 0)::DOUBLE AS wer, coalesce(CASE WHEN ac > 0 THEN round(100.0 * (ac - bc) / ac, 6) END, 0)::DOUBLE AS content_wer, coalesce(ac, 0)::BIGINT AS ref_words
    FROM p LEFT JOIN c USING (session_id, line_id)""",
)
def word_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word errors, by alignment, of lines that lost words or marks."""
    lines = lanes_to_score(spark, sf_dir)
    hyp = F.when(F.col("line_id") % 4 == 3, F.regexp_replace("ref", "[.,!?]", " ")).otherwise(F.col("hyp"))
    found = scoring.measure(lines.withColumn("hyp", hyp), ["session_id", "line_id"])
    return found.select("session_id", "line_id", F.round("wer", 6).alias("wer"), F.round("content_wer", 6).alias("content_wer"), "ref_words")


@register("word_errors")
def word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.measure(lanes_to_score(spark, sf_dir), ["session_id", "line_id"])


_W = sq.words("text")


@register(
    "chrf_scores",
    f"""WITH p AS (SELECT conv_id AS session_id, turn AS line_id, regexp_replace(text, '\\s+', '', 'g') AS ref, regexp_replace(CASE turn % 4 WHEN 1 THEN array_to_string(list_slice({_W}, 1, 4), ' ')
      WHEN 2 THEN array_to_string(list_concat(list_slice({_W}, 1, 4), list_slice({_W}, 12, len({_W}))), ' ') WHEN 3 THEN {sq.strip_upper('text')} ELSE text END, '\\s+', '', 'g') AS hyp
      FROM conversations WHERE text IS NOT NULL),
    g AS (SELECT session_id, line_id, n, substr(ref, i, n) AS gram, 1 AS r, 0 AS h FROM p, generate_series(1, 6) AS s(n), unnest(generate_series(1, length(ref) - n + 1)) AS t(i)
      UNION ALL SELECT session_id, line_id, n, substr(hyp, i, n), 0, 1 FROM p, generate_series(1, 6) AS s(n), unnest(generate_series(1, length(hyp) - n + 1)) AS t(i)),
    c AS (SELECT session_id, line_id, n, gram, sum(r) AS r, sum(h) AS h FROM g GROUP BY ALL),
    o AS (SELECT session_id, line_id, n, sum(least(r, h)) AS m, sum(r) AS r, sum(h) AS h FROM c GROUP BY session_id, line_id, n HAVING sum(r) > 0 AND sum(h) > 0),
    f AS (SELECT session_id, line_id, avg(m / h) AS p, avg(m / r) AS q FROM o GROUP BY ALL)
    SELECT p.session_id, p.line_id, round(coalesce(CASE WHEN f.p + f.q = 0 THEN 0 ELSE 500 * f.p * f.q / (4 * f.p + f.q) END, 0), 6)::DOUBLE AS chrf FROM p LEFT JOIN f USING (session_id, line_id)""",
)
def chrf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.chrf(lanes_to_score(spark, sf_dir), ["session_id", "line_id"])
    return found.withColumn("chrf", F.round("chrf", 6))


@register(
    "boundary_scores",
    f"""WITH RECURSIVE real AS (
      SELECT conv_id AS session_id, turn AS line_id, list_filter(generate_series(0, len(w) - 1), lambda i: regexp_matches(w[i + 1], '[.!?]["'')\\]”]*$')) AS real
      FROM (SELECT *, {sq.words('text')} AS w FROM conversations WHERE text IS NOT NULL)
    ), pairs AS (
      SELECT *, list_sort(list_transform(list_filter(real, lambda i: i % 3 <> 0), lambda i: i + (i % 2))) AS predicted FROM real
    ), walked AS (
      SELECT session_id, line_id, real, predicted, 1 AS i, 0 AS taken, 0 AS hits, 0 AS misses FROM pairs
      UNION ALL
      SELECT session_id, line_id, real, predicted, i + 1, CASE WHEN near THEN skipped + 1 ELSE skipped END, hits + near::INT, misses + (NOT near AND NOT known)::INT
      FROM (
        SELECT *, coalesce(real[skipped + 1] <= predicted[i] + 1, false) AS near, len(list_filter(real, lambda t: abs(t - predicted[i]) <= 1)) > 0 AS known
        FROM (SELECT *, greatest(taken, len(list_filter(real, lambda t: t < predicted[i] - 1))) AS skipped FROM walked WHERE i <= len(predicted))
      )
    ) SELECT session_id, line_id, hits::BIGINT AS hits, (hits + misses)::BIGINT AS predicted, len(real)::BIGINT AS truth,
      CASE WHEN hits + misses = 0 THEN 'nan'::DOUBLE ELSE hits / (hits + misses) END AS precision, CASE WHEN len(real) = 0 THEN 'nan'::DOUBLE ELSE hits / len(real) END AS recall
    FROM walked WHERE i = len(predicted) + 1""",
)
def boundary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = F.transform(
        F.filter(F.transform(tx.words(F.col("text")), lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: tx.ends_sentence(x["w"])), lambda x: x["i"]
    )
    found = turns(spark, sf_dir).select("session_id", "line_id", places.alias("real"))
    moved = F.transform(F.filter("real", lambda i: i % 3 != 0), lambda i: i + (i % 2))
    return scoring.boundary_scores(found.withColumn("predicted", moved), ["session_id", "line_id"])


_HYPS = f"""
told AS (
  SELECT session_id, line_id, w, list_filter(generate_series(0, len(w) - 1), lambda i: regexp_matches(w[i + 1], '[.!?]["'')\\]”]*$')) AS ends,
    list_filter(generate_series(0, len(w) - 1), lambda i: regexp_matches(w[i + 1], '[.!?,;:]["'')\\]”]*$')) AS stops,
    list_transform(list_transform(w, lambda x: {sq.normalize('x')}), lambda x: CASE WHEN x = '' OR list_contains({sq.FILLER_LIST}, x) THEN 0 ELSE 1 END) AS flags
  FROM (SELECT conv_id AS session_id, turn AS line_id, {sq.words('text')} AS w FROM conversations WHERE text IS NOT NULL)
), marks AS (
  SELECT session_id, line_id, h::INT AS hyp_no, h * 3 * 0.4 AS said_at, list_slice(w, 1, h * 3) AS w, list_filter(ends, lambda p: p < h * 3) AS firm,
    list_filter(stops, lambda p: p < h * 3) AS soft, list_slice(flags, 1, h * 3) AS spoken
  FROM told, unnest(generate_series(1, ceil(len(w) / 3)::INT)) AS t(h)
), agreed AS MATERIALIZED (
  SELECT session_id, line_id, hyp_no, said_at, len(w) AS n, w, spoken,
    list_filter(firm, lambda p: list_contains(lag(firm) OVER o, p)) AS firm, list_filter(soft, lambda p: list_contains(lag(soft) OVER o, p)) AS soft
  FROM marks WINDOW o AS (PARTITION BY session_id, line_id ORDER BY hyp_no)
)"""


@register(
    "confirmed_boundaries",
    f"""WITH RECURSIVE {_HYPS}, folded AS (
      SELECT DISTINCT session_id, line_id, 0 AS hyp_no, 0 AS done, 0.0::DOUBLE AS last, -2 AS since, NULL::BIGINT AS place FROM marks
      UNION ALL
      SELECT session_id, line_id, hyp_no, coalesce(p + 1, done) AS done, CASE WHEN p IS NULL THEN last ELSE said_at END AS last, CASE WHEN p IS NULL THEN since ELSE hyp_no END AS since, p
      FROM (
        SELECT a.session_id, a.line_id, a.hyp_no, a.said_at::DOUBLE AS said_at, f.done, f.last, f.since,
          CASE WHEN a.said_at >= f.last + 1.0 AND a.hyp_no - f.since >= 2 THEN list_max(list_filter(a.firm, lambda p: p >= f.done AND p + 1 < a.n
            AND list_sum(list_slice(a.spoken, f.done + 1, p + 1)) >= 4)) END AS p
        FROM folded f JOIN agreed a ON a.session_id = f.session_id AND a.line_id = f.line_id AND a.hyp_no = f.hyp_no + 1
      )
    ) SELECT session_id, line_id, hyp_no, place::BIGINT AS word_no FROM folded WHERE place IS NOT NULL""",
)
def confirmed_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confirm.boundaries(confirm.growing(turns(spark, sf_dir), step=3, pace=0.4))


@register(
    "early_prefixes",
    f"""WITH RECURSIVE {_HYPS}, folded AS (
      SELECT DISTINCT session_id, line_id, 0 AS hyp_no, 0 AS sent, NULL::VARCHAR AS prefix FROM marks
      UNION ALL
      SELECT session_id, line_id, hyp_no, CASE WHEN sends THEN p + 1 ELSE sent END, CASE WHEN sends THEN array_to_string(list_slice(w, 1, p + 1), ' ') END
      FROM (
        SELECT *, coalesce(p >= sent AND list_sum(list_slice(spoken, 1, p + 1)) > 0, false) AS sends FROM (
          SELECT a.session_id, a.line_id, a.hyp_no, a.w, a.spoken, f.sent,
            list_max(list_filter(a.soft, lambda p: p + 1 < a.n AND (list_contains(a.firm, p) OR p + 1 >= f.sent + 6))) AS p
          FROM folded f JOIN agreed a ON a.session_id = f.session_id AND a.line_id = f.line_id AND a.hyp_no = f.hyp_no + 1
        )
      )
    ) SELECT session_id, line_id, hyp_no, prefix FROM folded WHERE prefix IS NOT NULL""",
)
def early_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confirm.early_prefixes(confirm.growing(turns(spark, sf_dir), step=3, pace=0.4))


@register(
    "cut_short_rate",
    "SELECT lang, round(100.0 * avg(CASE WHEN regexp_matches(regexp_replace(text, '\\s+$', ''), '[,，、]$') THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS pct FROM documents WHERE text IS NOT NULL GROUP BY lang",
)
def cut_short_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.groupBy("lang").agg(F.round(100.0 * F.avg(fullwidth.cut_short(F.col("text")).cast("int")), 6).alias("pct"))


@register(
    "subword_words",
    f"""WITH said AS (
      SELECT conv_id AS session_id, turn, i, w[i] AS word, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS place
      FROM (SELECT *, {sq.words('text')} AS w FROM conversations WHERE text IS NOT NULL), unnest(generate_series(1, len(w))) AS t(i)
    ) SELECT session_id, place AS word_no, word, round(place * 0.2::DOUBLE, 6) AS start_s,
      round(coalesce(lead(place) OVER (PARTITION BY session_id ORDER BY place) * 0.2::DOUBLE, place * 0.2::DOUBLE), 6) AS end_s FROM said""",
)
def subword_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of each conversation, cut into two pieces and put together again."""
    turn = F.asc_nulls_last("line_id")
    by_turn = Window.partitionBy("session_id").orderBy(turn)
    twice = F.lag("line_id").over(by_turn).eqNullSafe(F.col("line_id")) | F.lead("line_id").over(by_turn).eqNullSafe(F.col("line_id"))
    # a turn is one run, in whose text words have their order; words of turns of one number take turns, so that each is a run
    singly = F.transform(tx.words(F.col("text")), lambda w, i: F.struct(i.alias("i"), w.alias("said")))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.col("text").alias("said")))
    lines = turns(spark, sf_dir).withColumn("twice", twice).select("session_id", "line_id", F.inline(F.when(F.col("twice"), singly).otherwise(whole)))
    before = Window.partitionBy("session_id").orderBy(turn, "i").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("place", F.coalesce(F.sum(tx.word_count(F.col("said"))).over(before), F.lit(0)))

    def pieces(word: Column, i: Column) -> Column:
        at = (F.col("place") + i) * 2
        rest = F.substring(word, 3, 1 << 30)
        first = F.when(rest.startswith("▁"), word).otherwise(F.substring(word, 1, 2))
        second = F.when(rest.startswith("▁"), "").otherwise(rest)
        return F.array(
            F.struct(F.concat(F.lit("▁"), first).alias("piece"), (at * 0.1).alias("start_s")), F.struct(second.alias("piece"), ((at + 1) * 0.1).alias("start_s"))
        )

    runs = placed.select("session_id", "line_id", "i", F.flatten(F.transform(tx.words(F.col("said")), pieces)).alias("pieces"), F.lit(0.0).alias("t_end"))
    merged = words.merge_runs(runs, [turn, "i"])
    return merged.select("session_id", "word_no", "word", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@register(
    "missing_models",
    """WITH w AS (SELECT source || '/' || doc_id AS path, n_chars AS size, doc_id FROM documents), p AS (SELECT path, size + (doc_id % 5 = 0)::INT AS size FROM w WHERE doc_id % 7 <> 0)
    SELECT w.path, w.size FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.path = w.path AND p.size = w.size)""",
)
def missing_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: those that aren't there, or not in the very size."""
    wanted = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), "doc_id")
    there = wanted.where("doc_id % 7 <> 0").select("path", (F.col("size") + (F.col("doc_id") % 5 == 0).cast("int")).alias("size"))
    return joins.missing(wanted.select("path", "size"), there)
