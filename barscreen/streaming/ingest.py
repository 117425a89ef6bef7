"""Incremental ingest of landed bar files with Structured Streaming.

New files are read as they land. Each micro-batch is parsed and stored in one job, however many files it holds; a batch
that is run again after a failure replaces its sessions by themselves. A file that can't be stored is noted and the stream
goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from barscreen.config import Universe
from barscreen.sources.files import landed
from barscreen.sources.store import Store


def landed_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the files that land in folder, as Spark's binaryFile source has them."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(folder)


def follow(store: Store, folder: str, layout: str | None, universe: Universe, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Store the bars of new files in folder; once: only those that are there now. Without a layout each file's header tells."""

    def write(batch: DataFrame, _: int) -> None:
        store.take_in(landed(batch).withColumn("layout", F.lit(layout).cast("string")), universe)

    writer = landed_files(store.spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
