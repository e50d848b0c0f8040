"""The queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.session import table
from tideline.llm import chat, countjoin, decontam, fim, html, langid, neardup, paragraphs, quality, segmentation, sharding, toxicity, whitening

Query = Callable[[SparkSession, str], DataFrame]


_ODD_CHAT = r"""
SELECT * FROM VALUES (-7L, 0L, 'user', r'\### Assistant: </turn> ok'), (-7L, 1L, 'assistant', r'\### Assistant: </turn> ok')
AS t(conv_id, turn, role, text)
"""


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted, and read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(_ODD_CHAT))
    fields = F.struct(*(F.coalesce(F.col(c), F.lit("")).alias(c) if c in ("role", "text") else F.col(c) for c in ("conv_id", "turn", "role", "text")))
    turns = chat.to_turns(rows.select("conv_id", F.to_variant_object(fields).alias("record")), keep=("conv_id",))
    return chat.digests(chat.format_chats(turns, "conv_id"), "conv_id")


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(15 + length(role) + length(text)
    + 2 * length(role || text) - length(replace(replace(role || text, '<', ''), '>', '')) - length(replace(role || text, '\', '')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the base rule and by cutoffs certified on the labels."""
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP2_SQL = r"""
WITH docs AS (
  SELECT doc_id, lang, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS n_symbols
  FROM documents
), runs AS (
  SELECT doc_id, i, array_to_string(w[i:i+2], ' ') AS r FROM docs, unnest(generate_series(1, len(w) - 2)) AS t(i)
), again AS (
  SELECT doc_id, i FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, r) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id
), measured AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines
  FROM docs LEFT JOIN covered c USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
), path AS (
  SELECT *, least(
    list_sum(list_transform([2, 5, 10, 15, 20, 30], lambda c: CASE WHEN 100 * n_symbols > c * word_chars THEN 0 ELSE 3 END)) + 1 + CASE WHEN 100 * n_symbols > 2 * word_chars THEN 0 ELSE 99 END,
    list_sum(list_transform([20, 30, 40, 50, 60, 75], lambda c: CASE WHEN 100 * n_dup_lines > c * n_lines THEN 0 ELSE 3 END)) + 2 + CASE WHEN 100 * n_dup_lines > 20 * n_lines THEN 0 ELSE 99 END,
    list_sum(list_transform([10, 15, 20, 25, 30, 40], lambda c: CASE WHEN 100 * n_repeat_words > c * n_words THEN 0 ELSE 3 END)) + 3 + CASE WHEN 100 * n_repeat_words > 10 * n_words THEN 0 ELSE 99 END
  ) AS first FROM judged
), tests AS (
  SELECT lang, step, count(*) FILTER (WHERE quality = 1) AS n,
    count(*) FILTER (WHERE quality = 1 AND first <= step) AS lost, count(*) FILTER (WHERE quality = 0 AND first <= step) AS caught
  FROM path JOIN labels USING (doc_id), unnest(generate_series(1, 18)) AS t(step) WHERE NOT base_failed AND quality IS NOT NULL
  GROUP BY lang, step
), tails AS (
  SELECT *, count(*) OVER () / 18 AS strata, 0.02 AS rate FROM tests
), certified AS (
  SELECT *, lost <= n * rate AND list_sum(list_transform(generate_series(0, lost),
    lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(rate) + (n - i) * ln(1 - rate)))) <= 0.05 / strata AS passed FROM tails
), sequence AS (
  SELECT *, bool_and(passed) OVER (PARTITION BY lang ORDER BY step) AS holds FROM certified
), best AS (
  SELECT lang, step FROM sequence WHERE holds AND caught > lost QUALIFY row_number() OVER (PARTITION BY lang ORDER BY caught - lost DESC, step) = 1
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (step IS NULL OR first > step) AS kept
FROM path j LEFT JOIN best b ON j.lang IS NOT DISTINCT FROM b.lang
"""


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose five-word shingle sets are 85 % alike."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), num=85, den=100)


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM words, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, n
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of passages that several documents have; one of each cluster stays."""
    return paragraphs.repeated_passages(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes; equal texts stay together."""
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), n_shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.sample(docs, langid.learnable()))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out")
    found = langid.with_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out, "lang_pred", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain four fifths of a benchmark item's shingles, with the item."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH texts AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), words AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM texts
), shingles AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i+4], ' ') AS s FROM words, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0
), items AS (SELECT id, s, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE kind = 1)
SELECT d.id AS doc_id, i.id AS item_id, i.n AS n_item, count(*) AS n_shared
FROM items i JOIN shingles d ON d.s = i.s AND d.kind = 0 GROUP BY d.id, i.id, i.n HAVING 5 * count(*) >= 4 * i.n
"""


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document, decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return segmentation.sampled_rows(segmentation.sample_segmentations(docs))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability that a document is labelled toxic, learned from three quarters of the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.sample(docs, labels, toxicity.learnable()))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out")
    found = toxicity.with_toxicity(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as fill-in-the-middle texts, and their texts rebuilt from these."""
    made = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents
), draws AS (
  SELECT *, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM docs
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM draws
), made AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
    ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END AS output FROM cuts
), split AS (
  SELECT *, string_split(CASE form WHEN 'psm' THEN replace(substring(output, 4), '<S>', '<M>') ELSE replace(substring(output, 4), '<P>', '<M>') END, '<M>') AS x FROM made
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN x[1] || x[3] || x[2] ELSE x[2] || x[3] || x[1] END) AS restored_sha256
FROM split
"""


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents whose four-word shingle sets are 85 % alike."""
    return countjoin.jaccard_classes(table(spark, sf_dir, "documents"), num=85, den=100)


OP12_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS s FROM words, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, n
"""


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened coordinates of every usable vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_quality_rules": op2_quality_rules,
        "op3_minhash_near_dedup": op3_minhash_near_dedup,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_sharding": op5_sharding,
        "op6_language_id": op6_language_id,
        "op7_decontamination": op7_decontamination,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_html_extraction": op9_html_extraction,
        "op10_toxicity": op10_toxicity,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_ngram_jaccard_join": op12_ngram_jaccard_join,
        "op13_embedding_whitening": op13_embedding_whitening,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": OP1_SQL,
        "op2_quality_rules": OP2_SQL,
        "op3_minhash_near_dedup": OP3_SQL,
        "op7_decontamination": OP7_SQL,
        "op11_fill_in_middle": OP11_SQL,
        "op12_ngram_jaccard_join": OP12_SQL,
    }
