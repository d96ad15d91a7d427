"""Continuous extraction: new packages in a folder, batch by batch.

The windows of the extraction stay within one document, so each micro-batch runs the batch plan unchanged in foreachBatch; a
batch that is run again overwrites its own folder, which makes the sink exactly-once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.extract import Extraction
from ..sources.packages import relative_id


def stream_packages(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """doc_id (the file's path below `path`) and content of packages as they arrive there."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path)
    return files.select(relative_id(path).alias("doc_id"), "content")


def ingest(packages: DataFrame, out: str, checkpoint: str, view: Callable[[Extraction], DataFrame] = lambda e: e.document, available_now: bool = True, **options) -> StreamingQuery:
    """Writes view(extraction) of every micro-batch as Parquet below out/batch=N."""

    def write(batch: DataFrame, number: int) -> None:
        with Extraction(batch, **options) as e:
            view(e).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = packages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
