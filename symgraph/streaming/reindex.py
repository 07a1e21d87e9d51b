"""Re-index a source tree whenever files arrive in it.

Arriving files are a binary-file stream. Each micro-batch only tells that
something changed; the batch job then compares digests and scans what is new,
so a restart or a repeated batch does no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.snapshot import build
from ..settings import Settings

ARRIVALS = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, root: str) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(ARRIVALS).option("recursiveFileLookup", True).load(root)
    return files.select("path", "modificationTime", "length")


def keep_indexed(spark: SparkSession, settings: Settings, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start the stream; with ``once`` it ends when all present files are indexed."""

    def refresh(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            build(batch.sparkSession, settings)

    writer = arrivals(spark, settings.root).writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
