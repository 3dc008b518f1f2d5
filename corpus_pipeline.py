"""A training corpus from raw documents, in five stages.

Each stage reads all that the one before it kept, and its decisions take effect:
language ID drops documents in no learned language and noise, line dedup cuts frequent lines,
near-dedup keeps one document of each group, mixing repeats and cuts documents to the
sources' targets, and packing puts what is left into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.llm import language_id, line_dedup, mixing, near_dedup, packing
from foliant.llm.common import materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with text in a learned language: those without a letter and those that
    the network rejects go. A null ``lang`` gets the predicted one. Every learned language
    is wanted, so none is dropped."""
    names = ("_lang_pred", "_lang_score")
    found = language_id.predict(docs, language_id.fitted(docs, reject=True), tuple(docs.columns), names)
    kept = found.filter(F.col(names[0]) != language_id.UND)
    return kept.withColumn("lang", F.coalesce("lang", names[0])).drop(*names)


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least 10 documents share."""
    done = line_dedup.dedup_lines(docs, ("_kept", "_n_lines", "_n_dropped"))
    return done.withColumns({"text": F.col("_kept"), "n_chars": F.char_length("_kept").cast("long")}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated and cut to the sources' targets."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return packing.packed_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_frequent_lines),
    ("near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: No SQL trains a network; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
