"""The cache of a scan: a Parquet snapshot of entries with their hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import is_below
from ..functions.scalars import decode_hash

COLUMNS = ("path", "ctime", "file_size", "file_hash", "phys", "n_extents", "is_file", "is_dir", "in_archive", "archive_path", "failure")


def store(entries: DataFrame, path: str) -> None:
    kept = [c for c in COLUMNS if c in entries.columns]
    entries.select(*kept).write.mode("overwrite").option("compression", "zstd").parquet(path)


def load_legacy(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an old cache: a JSON array of records whose hashes are base64.

    These hashes are of another function than this engine's, so such a cache serves reports without a scan only; hashes of
    a still older kind (over 44 characters) are null.
    """
    schema = "path string, ctime long, file_size long, file_hash string, was_file boolean, was_dir boolean, phys long, n_extends int, upgrade boolean, dedup_state boolean"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.where("path is not null").select(
        "path", "ctime", "file_size", decode_hash(F.col("file_hash")).alias("file_hash"), "phys", F.col("n_extends").alias("n_extents"),
        F.coalesce("was_file", F.lit(True)).alias("is_file"), F.coalesce("was_dir", F.lit(False)).alias("is_dir"),
    )


def load(spark: SparkSession, path: str, roots: Sequence[str] = ()) -> DataFrame:
    """Cached entries, below roots if any are given: the whole input of an analysis without a scan."""
    rows = spark.read.parquet(path)
    if not roots:
        return rows
    wanted = F.lit(False)
    for root in roots:
        wanted = wanted | is_below(F.col("path"), root)
    return rows.where(wanted)


def validate(scanned: DataFrame, cached: DataFrame) -> DataFrame:
    """scanned with file_hash and `valid`: a cached hash holds while change time and size are what they were.

    Archives that failed are read again. One left join on the path; nothing is gathered.
    """
    old = cached.select("path", F.col("ctime").alias("c_ctime"), F.col("file_size").alias("c_size"), F.col("file_hash").alias("c_hash"),
        (F.coalesce("failure", F.lit(0)) if "failure" in cached.columns else F.lit(0)).alias("c_failure"))
    joined = scanned.drop("file_hash").join(old, "path", "left")
    valid = F.coalesce((F.col("ctime") == F.col("c_ctime")) & (F.col("file_size") == F.col("c_size")) & (F.col("c_failure") == 0), F.lit(False))
    return joined.withColumn("valid", valid).withColumn("file_hash", F.when(F.col("valid"), F.col("c_hash"))).drop("c_ctime", "c_size", "c_hash", "c_failure")


def revalidated_members(validated: DataFrame, cached: DataFrame) -> DataFrame:
    """Cached members of the archives that are unchanged; they need no new reading."""
    unchanged = validated.where("valid").select(F.col("path").alias("archive_path"))
    return cached.where("in_archive").join(unchanged, "archive_path", "left_semi").select(*cached.columns)
