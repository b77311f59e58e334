"""Documents from files: one row for each file, as bytes or as text, and rows of text written back as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content BINARY) of every file below a path; large files should be read by ranges instead."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return files.load(path).select("path", "length", "content")


def text_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content STRING); a file is one row."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def literals(spark: SparkSession, contents: list[str | bytes]) -> DataFrame:
    """(id, content) of documents given in the program."""
    kind = "BINARY" if contents and isinstance(contents[0], bytes) else "STRING"
    return spark.createDataFrame(list(enumerate(contents)), f"id INT, content {kind}")


def stream_of_files(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def write_texts(df: DataFrame, content: str, path: str) -> None:
    """One line of text for each row."""
    df.select(content).write.mode("errorifexists").text(path)
