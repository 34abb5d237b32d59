"""Incremental ingest of key files into the key index."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..operators.catalog import listed
from ..sources.lake import staged_merge


def ingest_new_keys(spark: SparkSession, landing: str, index: str, checkpoint: str, staging: str) -> None:
    """Reads the key files that have landed since the last call and merges them into the partitions they touch.

    A batch that failed, before, in or after its overwrite, is run again by the next call and leaves the same rows: its
    staging table is the whole of the touched partitions, and a commit record under the name of the stream and the batch says when
    it is done.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = listed(batch.withColumnRenamed("value", "key"))
        if not rows.isEmpty():
            stream = json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]  # another checkpoint is another stream
            staged_merge(rows, index, "source_key", f"{staging}/{stream}-{number}", f"{stream}-{number}")

    query = spark.readStream.text(landing).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
