"""Harvest as a stream: new feed files in a folder are parsed and merged. Delivery of a file again changes nothing, as ids
follow from content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerflow.operators.store import Store
from ledgerflow.sources import feeds

FILES = "path string, modificationTime timestamp, length long, content binary"


def start(spark: SparkSession, landing: str, store: Store, checkpoint: str, rejected: str, discovered_at: str, live: bool = False, limit: int | None = None) -> StreamingQuery:
    """A query that takes what is there and ends; rejected documents go to a table of their own, a folder for each batch."""
    files = spark.readStream.format("binaryFile").schema(FILES).load(landing)

    def merge(batch: DataFrame, number: int) -> None:
        raw = feeds.parsed(batch.select("path", "content"), live, limit)
        good, bad = feeds.snapshots(raw, discovered_at, live)
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        # the position within the whole batch: files in the order of their paths
        store.harvest(good.withColumn("position", F.concat("path", F.lit("#"), F.lpad(F.col("position").cast("string"), 8, "0"))))

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
