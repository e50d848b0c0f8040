"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, sampling of pieces.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last keep
the columns of ``documents``. ``run`` writes every stage's result as Parquet in the shared
folder and reads it as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontam, langid, neardup, paragraphs, segmentation
from tideline.llm.store import fresh_name, written
from tideline.session import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without any letter go, and where no language is labelled, those alone."""
    learned = langid.sample(docs, langid.learnable())
    if not learned:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    model = langid.fit(learned)
    language, share = fresh_name(docs, "language"), fresh_name(docs, "share")
    found = langid.with_language(docs, model, lang_name=language, score_name=share)
    return found.where(F.col(language) != langid.UNKNOWN).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (four fifths alike or more): the one with the smallest id."""
    found = neardup.near_duplicates(docs, num=80, den=100)
    kept = found.where("kept").select("doc_id").where("doc_id is not null").distinct()
    once = docs.join(kept.hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has."""
    return paragraphs.remove_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of the documents that are left."""
    return segmentation.sampled_rows(segmentation.sample_segmentations(docs.select("doc_id", "text")))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("sentencepiece", sentencepiece),
]

#: The language model, the sampling and the components are not expressible; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
