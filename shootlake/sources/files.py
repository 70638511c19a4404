"""Photo files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan(spark: SparkSession, path: str, pattern: str = "*", content: bool = True) -> DataFrame:
    """path, length, modificationTime and, when asked for, the bytes of each file below `path`.

    Leaving the content out reads no file at all, only listings.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files if content else files.drop("content")
