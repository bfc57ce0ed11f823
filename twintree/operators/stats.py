"""Counters of a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scan_stats(candidates: DataFrame) -> DataFrame:
    """found and relevant files and bytes; candidates as read_candidates gives them."""
    relevant = F.col("candidate")
    return candidates.agg(
        F.count_if("is_file").alias("found_files"),
        F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("found_bytes"),
        F.count_if(relevant).alias("relevant_files"),
        F.coalesce(F.sum(F.when(relevant, F.col("file_size"))), F.lit(0)).cast("long").alias("relevant_bytes"),
    )


def progress(candidates: DataFrame, files: DataFrame, deduped: DataFrame | None = None) -> DataFrame:
    """scan_stats with processed (hashed) and deduped files and bytes; deduped as sources.dedupe gives it."""
    hashed = files.where("file_hash is not null").agg(F.count("*").alias("processed_files"),
        F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("processed_bytes"))
    out = scan_stats(candidates).crossJoin(hashed)  # one row each
    if deduped is None:
        return out.withColumns({"deduped_files": F.lit(0).cast("long"), "deduped_bytes": F.lit(0).cast("long")})
    return out.crossJoin(deduped.agg(F.count_if(F.col("state") == "deduped").alias("deduped_files"),
        F.coalesce(F.sum("deduped"), F.lit(0)).cast("long").alias("deduped_bytes")))
