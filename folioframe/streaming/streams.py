"""The same tables from streams: files as they arrive, and sessions of events with watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.reader import parse_column

_FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """Parsed pages of PDF files as they arrive; a file is always whole within one batch, so no state is kept."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return parse_column(files.withColumnRenamed("path", "doc_id"))


def each_batch(parsed: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Run window operators on a stream of pages, batch by batch: ``work`` gets a batch and its number."""
    return parsed.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)


def sessions(events: DataFrame, gap: str, late: str, key: str = "user_id", time: str = "ts") -> DataFrame:
    """Gap clustering of a stream: sessions by key, closed once the watermark passes; later events are dropped."""
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n_events"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts")).drop("w")
