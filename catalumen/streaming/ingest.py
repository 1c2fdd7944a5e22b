"""Incremental scans as a stream: each micro-batch of records is merged into the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from catalumen.operators.pipeline import ingest
from catalumen.sources.snapshots import Catalog


def stream_into(cat: Catalog, records: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts merging a stream of file records (columns of a scan) into the catalogue.

    A batch that is delivered again changes nothing but times of sight: contents, metadata and occurrences are all
    upserts by key. A batch's records are ordered by seq, as within a scan.
    """

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            ingest(cat, batch)

    writer = records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def arrivals(records: DataFrame, late: str = "7 days", window: str = "1 day") -> DataFrame:
    """Records and bytes per day of scan and type, of a stream with late rows: windows close `late` after their end."""
    timed = records.withColumn("at", F.col("scanned_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "type").agg(F.count(F.lit(1)).alias("records"), F.sum("size_bytes").alias("bytes")).select(F.col("window.start").alias("day"), "type", "records", "bytes")
