"""Incremental runs: the same transforms over new files only, by Structured Streaming's own checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.sources.readers import MARKDOWN, relative


def markdown_stream(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """(source_file, rel_path, text) of Markdown files as they come."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", MARKDOWN).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(root)
    rows = files.select(relative(F.col("path"), root).alias("rel_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return rows.select(F.regexp_extract("rel_path", r"([^/]+)$", 1).alias("source_file"), "rel_path", "text")


def run_once(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Bring ``path`` (Parquet) up to date with what has come since the last run, then stop. A batch that is run
    again after a failure overwrites its own folder, so nothing is written twice."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
