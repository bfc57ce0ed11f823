"""Groups of equal files and directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import components
from ..plans.lineage import cut

HIDE = {0: "false", 1: "ns = 0", 2: "ns <> 1", 3: "true"}


def members(files: DataFrame, dirs: DataFrame | None = None) -> DataFrame:
    """hash, typ (D or F), typ_order, path, size, is_dir: one row per hashed file and per hashed directory. Paths are keys of both tables."""
    is_dir = F.col("is_dir") if "is_dir" in files.columns else F.lit(False)
    out = files.where("file_hash is not null").select(F.col("file_hash").alias("hash"), F.lit("F").alias("typ"), F.lit(2).alias("typ_order"), "path",
        F.col("file_size").alias("size"), is_dir.alias("is_dir"))
    if dirs is not None:
        out = out.unionByName(dirs.where("dir_hash is not null").select(F.col("dir_hash").alias("hash"), F.lit("D").alias("typ"),
            F.lit(1).alias("typ_order"), "path", F.col("dir_size").alias("size"), F.lit(True).alias("is_dir")))
    return out


def hash_counts(all_members: DataFrame) -> DataFrame:
    """hash, n, size. All members of a hash have one size."""
    return all_members.groupBy("hash").agg(F.count("*").alias("n"), F.min("size").alias("size"))


def duplicate_hashes(all_members: DataFrame) -> DataFrame:
    return hash_counts(all_members).where("n > 1")


def duplicates(all_members: DataFrame) -> DataFrame:
    """The members of groups of two or more, with n."""
    return all_members.join(duplicate_hashes(all_members).select("hash", "n"), "hash")


def visible(flagged: DataFrame, rule: int) -> DataFrame:
    """What a report shows. flagged: members with `shadowed`; adds n (members), ns (not shadowed ones)."""
    counts = flagged.groupBy("hash").agg(F.count("*").alias("n"), F.count_if(~F.col("shadowed")).alias("ns")).where("n > 1")
    counts = counts.withColumn("hide", F.expr(HIDE[rule])).where("not hide or ns > 1")
    return flagged.join(counts, "hash").where("not hide or not shadowed").drop("hide")


def export_order(shown: DataFrame) -> DataFrame:
    """shown with group_rank and member_rank: directories first, then by path; groups by size, then by first member.

    Both ranks come from one global sort of all members, in ranges, so neither a window over one partition nor a group of
    many members is one task's work.
    """
    order = components(F.col("path"))
    heads = shown.groupBy("hash").agg(F.max("size").alias("gsize"), F.count("*").alias("__size"),
        F.min(F.struct("typ_order", order.alias("order"))).alias("head"))
    ranked = _ranked(heads, [F.desc("gsize"), F.col("head.typ_order"), F.col("head.order")])
    ranked = cut(ranked.select("hash", F.col("rank").alias("group_rank"), "__size"))
    members_ = _ranked(shown.join(ranked.drop("__size"), "hash"), [F.col("group_rank"), F.col("typ_order"), order])
    # the rows before a group are the sizes of the groups before it
    before = _prefix_sums(ranked.select("group_rank", "__size"))
    return members_.join(before, "group_rank").withColumn("member_rank", (F.col("rank") - F.col("__before")).cast("int")).drop("rank", "__before")


def _offsets(sorted_rows: DataFrame, value: Column) -> DataFrame:
    """__part, __before: sums of value over the parts before; one short row for each part."""
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return sorted_rows.groupBy("__part").agg(F.sum(value).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))


def _sorted(rows: DataFrame, keys: list) -> DataFrame:
    """rows sorted by range and kept, with their range __part and their __row in the order of all."""
    return cut(rows.orderBy(*keys).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))


def _ranked(rows: DataFrame, keys: list) -> DataFrame:
    """rows with `rank` from 1: sorted by range, then numbered within ranges whose offsets come from their counts."""
    kept = _sorted(rows, keys)
    offsets = _offsets(kept, F.lit(1))
    first = F.shiftleft(F.col("__part").cast("long"), 33)  # what monotonically_increasing_id starts a partition with
    return kept.join(F.broadcast(offsets), "__part").withColumn("rank", F.col("__offset") + F.col("__row") - first + 1).drop("__part", "__row", "__offset")


def _prefix_sums(sizes: DataFrame) -> DataFrame:
    """group_rank, __before: the sum of __size over smaller ranks, by parts of 2**16 ranks."""
    parted = sizes.withColumn("__part", F.shiftright("group_rank", 16))
    within = Window.partitionBy("__part").orderBy("group_rank").rowsBetween(Window.unboundedPreceding, -1)
    inner = parted.withColumn("__inner", F.coalesce(F.sum("__size").over(within), F.lit(0)))
    return inner.join(F.broadcast(_offsets(parted, F.col("__size"))), "__part").select("group_rank", (F.col("__offset") + F.col("__inner")).alias("__before"))
