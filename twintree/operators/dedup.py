"""Planning which files give up their blocks to which keeper."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import components

BATCH_FILES = 127
BUDGET_FLOOR = 24 << 20


def dedup_candidates(files: DataFrame) -> DataFrame:
    """hash, path, file_size, phys, n_extents, ctime, occurrences, n, avg_phys.

    Files with a size, a known place and known extents whose hash has two such files. avg_phys is the floor of the mean
    place over all of a group; occurrences counts files of the group at one place. Both are sums joined back, so that a
    large group is not one window.
    """
    fit = files.where("file_hash is not null and file_size > 0 and phys is not null and phys <> 0 and n_extents is not null").select(
        F.col("file_hash").alias("hash"), "path", "file_size", "phys", "n_extents", "ctime")
    groups = fit.groupBy("hash").agg(F.count("*").alias("n"), F.sum(F.col("phys").cast("decimal(38,0)")).alias("s")).where("n > 1")
    groups = groups.select("hash", "n", F.expr("cast(s div n as bigint)").alias("avg_phys"))
    places = fit.groupBy("hash", "phys").agg(F.count("*").alias("occurrences"))
    return fit.join(groups, "hash").join(places, ["hash", "phys"])


def keepers(candidates: DataFrame) -> DataFrame:
    """One file of each group: fewest extents, most files at its place, oldest, nearest the mean place, then by place and path."""
    choice = F.struct("n_extents", (-F.col("occurrences")).alias("o"), "ctime", F.abs(F.col("avg_phys") - F.col("phys")).alias("d"), "phys",
        components(F.col("path")).alias("c"), "path", "file_size")
    return candidates.groupBy("hash").agg(F.min(choice).alias("k"), F.first("avg_phys").alias("avg_phys"), F.first("n").alias("n")).select("hash",
        F.col("k.path").alias("keeper"), F.col("k.phys").alias("keeper_phys"), F.col("k.file_size").alias("file_size"), "avg_phys", "n",
        F.col("k.ctime").alias("keeper_ctime"))


def dedup_groups(candidates: DataFrame, aggressive: bool = False) -> DataFrame:
    """hash, path, phys, file_size, ctime, keeper, keeper_phys, keeper_ctime, avg_phys: one row per file to dedupe.

    Files at the keeper's place are left out unless aggressive.
    """
    kept = keepers(candidates).select("hash", "keeper", "keeper_phys", "keeper_ctime", "avg_phys")
    rows = candidates.select("hash", "path", "phys", "file_size", "ctime").join(kept, "hash").where(F.col("path") != F.col("keeper"))
    return rows if aggressive else rows.where("phys <> keeper_phys")


def group_plan(rows: DataFrame) -> DataFrame:
    """hash, keeper, file_size, avg_phys, n_dups, usage: groups with their sums; usage counts the keeper."""
    out = rows.groupBy("hash", "keeper", "avg_phys").agg(F.first("file_size").alias("file_size"), F.count("*").alias("n_dups"))
    return out.select("hash", "keeper", "file_size", "avg_phys", "n_dups", (F.col("file_size") * (F.col("n_dups") + 1)).alias("usage"))


def simulate(rows: DataFrame) -> DataFrame:
    """groups, dup_files, dup_bytes: what a run would process."""
    return rows.agg(F.count_distinct("hash").alias("groups"), F.count("*").alias("dup_files"),
        F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("dup_bytes"))


@dataclass(frozen=True)
class Share:
    """A part of a group's dups: places first to last of its list."""

    hash: str
    size: int
    first: int
    last: int

    @property
    def files(self) -> int:
        return self.last - self.first + 2

    @property
    def usage(self) -> int:
        return self.files * self.size


def pack(groups: Iterator[tuple[str, int, int]], budget: int) -> Iterator[list[Share]]:
    """Greedy batches in the given order: at most BATCH_FILES files and budget bytes, the keeper counted in each share.

    groups: (hash, file_size, dups). A group that does not fit a batch of its own is split, every share with the keeper; a
    pair over the budget is a batch nevertheless.
    """
    batch: list[Share] = []
    files = used = 0
    for name, size, dups in groups:
        at = 0
        while at < dups:
            left = Share(name, size, at, dups - 1)
            if files + left.files <= BATCH_FILES and used + left.usage <= budget:
                batch.append(left)
                files, used, at = files + left.files, used + left.usage, dups
                continue
            if batch:
                yield batch
                batch, files, used = [], 0, 0
                continue
            room = max(2, min(BATCH_FILES, budget // max(size, 1)))
            share = Share(name, size, at, min(dups, at + room - 1) - 1)
            yield [share]
            at = share.last + 1
    if batch:
        yield batch


def batches(plan: DataFrame, budget: int = 512 << 20, shards: int = 1) -> DataFrame:
    """batch, hash, first, last, usage over group_plan's rows in the order of avg_phys.

    The fold is sequential. One shard packs as a single sequence; more shards cut the order into ranges of avg_phys that
    are packed apart, each with its own last batch. The groups stream by: a task holds no more than a batch.
    """
    spread = plan.repartitionByRange(shards, "avg_phys", "hash") if shards > 1 else plan.repartition(1)
    ordered = spread.sortWithinPartitions("avg_phys", "hash").select("hash", "file_size", "n_dups", F.spark_partition_id().alias("shard"))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = None

        def rows() -> Iterator[tuple[str, int, int]]:
            nonlocal shard
            for frame in frames:
                for r in frame.itertuples(index=False):
                    shard = r.shard
                    yield r.hash, int(r.file_size), int(r.n_dups)

        for number, batch in enumerate(pack(rows(), budget)):
            yield pd.DataFrame([(shard, number, s.hash, s.first, s.last, s.usage) for s in batch], columns=["shard", "batch", "hash", "first", "last", "usage"])

    return ordered.mapInPandas(fold, "shard int, batch long, hash string, first long, last long, usage long")


def read_order(rows: DataFrame) -> DataFrame:
    """rows (batch, phys, path) with read_order: by place within a batch of bounded size."""
    return rows.withColumn("read_order", F.row_number().over(Window.partitionBy("batch").orderBy("phys", "path")))


def split_ranges(size: int, budget: int, files: int) -> list[tuple[int, int]]:
    """Byte ranges of a file, of whole 12 MiB where possible, so that `files` of them keep the budget."""
    unit = 12 << 20
    step = max(unit, budget // max(files, 1) // unit * unit)
    return [(low, min(size, low + step)) for low in range(0, size, step)]
