"""Keeping a cache and its duplicate groups up to date while entries arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.groups import duplicate_hashes, members


def refresh_cache(entries: DataFrame, cache_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends hashed entries of a stream to a Parquet log, one folder a batch; a batch that is run again replaces its own."""

    def add(batch: DataFrame, number: int) -> None:
        batch.withColumn("file_hash", F.sha2(F.col("content").cast("binary"), 256)).drop("content").write.mode("overwrite").parquet(
            f"{cache_path}/batch={number}")

    writer = entries.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(log: DataFrame) -> DataFrame:
    """The last version of every path: one aggregate, no window over a path's history."""
    rest = [c for c in log.columns if c not in ("path", "batch")]
    newest = log.groupBy("path").agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select("path", *[F.col("r")[c].alias(c) for c in rest])


def current_duplicates(log: DataFrame) -> DataFrame:
    """hash, n, size of the files that are duplicates now."""
    return duplicate_hashes(members(latest(log)))
