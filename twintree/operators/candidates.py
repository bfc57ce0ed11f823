"""Which files need their bytes read: sizes that occur once cannot be duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_archive_name
from ..options import Options


def size_groups(entries: DataFrame) -> DataFrame:
    """file_size, n, bytes. Counted before the shuffle, so a common size is no hot key."""
    return entries.where(F.col("is_file")).groupBy("file_size").agg(F.count("*").alias("n"), F.sum("file_size").cast("long").alias("bytes"))


def shared_sizes(entries: DataFrame) -> DataFrame:
    return size_groups(entries).where("n > 1").select("file_size")


def read_candidates(entries: DataFrame, options: Options = Options(), members: DataFrame | None = None) -> DataFrame:
    """entries with `candidate`. members: archive members, whose sizes count too (they are hashed already).

    Size bounds keep files from being read, not from making a size shared. Archives are read whatever their size.
    """
    sized = entries.select("is_file", "file_size")
    if members is not None:
        sized = sized.unionByName(members.select(F.lit(True).alias("is_file"), "file_size"))
    shared = shared_sizes(sized).withColumn("shared", F.lit(True))
    joined = entries.join(shared, "file_size", "left")
    bounded = F.col("file_size") >= options.min_size
    if options.max_size is not None:
        bounded &= F.col("file_size") <= options.max_size
    wanted = F.col("is_file") & F.coalesce("shared", F.lit(False)) & bounded
    if "file_hash" in entries.columns:
        wanted &= F.col("file_hash").isNull()
    if options.read_archives:
        archive = is_archive_name(F.col("path")) & F.col("is_file")
        unread = archive & F.col("file_hash").isNull() if "file_hash" in entries.columns else archive
        wanted = wanted | unread | (archive & ~F.col("is_dir"))
    return joined.withColumn("candidate", F.coalesce(wanted, F.lit(False))).drop("shared").select(*entries.columns, "candidate")


def content_hashes(candidates: DataFrame) -> DataFrame:
    """file_hash: SHA-256 of the content in lower hex for candidates, else what is known already, else null."""
    known = F.col("file_hash") if "file_hash" in candidates.columns else F.lit(None).cast("string")
    return candidates.withColumn("file_hash", F.coalesce(known, F.when(F.col("candidate"), F.sha2(F.col("content").cast("binary"), 256)))).drop(
        "content", "candidate")
