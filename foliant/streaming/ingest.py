"""Extraction from a stream of files. Every stage is stateless per document, so the
batch plans run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.extract import extract_text
from ..sources.pdf import stream_pdfs


def extract_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """``extract_text`` of PDF files as they arrive below ``path``."""
    return extract_text(stream_pdfs(spark, path), **options)


def write_texts(texts: DataFrame, out: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Appends extracted texts to Parquet files, exactly once."""
    writer = texts.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
