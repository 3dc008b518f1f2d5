"""PDF files as a DataFrame of bytes, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def read_pdfs(spark: SparkSession, path: str | list[str], glob: str = "*.pdf") -> DataFrame:
    """path, modificationTime, length, content of the files below ``path``. Filters on
    the first three are applied before files are read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def stream_pdfs(spark: SparkSession, path: str, glob: str = "*.pdf", per_trigger: int = 1000) -> DataFrame:
    """The same as a stream of new files."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return reader.option("maxFilesPerTrigger", per_trigger).load(path)


def from_column(df: DataFrame, content: str, doc_id: str) -> DataFrame:
    """Any DataFrame with a binary column, in the shape the engine reads."""
    return df.select(F.col(doc_id).cast("string").alias("path"), F.col(content).alias("content"))


def write_files(spark: SparkSession, folder: str, files: dict[str, bytes]) -> None:
    """A few files by name, from the driver, in any file system that Spark reaches."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    system = paths(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for name, content in files.items():
        out = system.create(paths(folder, name))
        out.write(bytearray(content))
        out.close()
