"""Catalog batches as a stream: each micro-batch of complete snapshots is merged into the store once.

A snapshot counts as one unit, so the stream carries whole snapshots (one file
each). The store records which it holds in the same step as their rows, so a
micro-batch that is replayed, after whatever crash, merges nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.plans.ingest import sync_store
from millrace.sources.snapshot import SNAPSHOT, applied


def stream_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """New snapshot files under ``path``, each row with its file."""
    return spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", 1).json(path).withColumn("file", F.col("_metadata.file_path")).withColumn("at", F.col("_metadata.file_modification_time"))


def merge_snapshots(snapshots: DataFrame, store: str, checkpoint: str, digest) -> StreamingQuery:
    """Merges each snapshot of the stream into the store at ``store``, in the order they come.

    ``digest`` gives records their source_payload_hash column. Snapshots whose
    file the state knows already are passed over.
    """

    def apply(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        files = batch.groupBy("file").agg(F.max("at").alias("at")).join(applied(spark, store).select(F.col("name").alias("file")), "file", "left_anti")
        for row in files.orderBy("at", "file").collect():  # one file a trigger
            sync_store(spark, store, digest(batch.where(F.col("file") == row["file"])).drop("file", "at"), row["at"].isoformat(), row["file"])

    return snapshots.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
