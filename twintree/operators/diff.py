"""Side-by-side comparison of trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, is_below, relative_to
from ..functions.scalars import icon
from ..plans.lineage import cut

UNIQ, SUPR, DUPS = 0, 1, 2


def nodes_of(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """path, is_file, is_dir, file_hash, dir_hash, size of every node; an archive is one node with both hashes."""
    f = files.select("path", F.lit(True).alias("is_file"), "file_hash", F.col("file_size").alias("fsize"))
    d = dirs.select("path", F.lit(True).alias("is_dir"), "dir_hash", F.col("dir_size").alias("dsize"))
    both = f.join(d, "path", "full")
    return both.select("path", F.coalesce("is_file", F.lit(False)).alias("is_file"), F.coalesce("is_dir", F.lit(False)).alias("is_dir"), "file_hash",
        "dir_hash", F.when(F.col("is_file"), F.col("fsize")).otherwise(F.col("dsize")).alias("size"))


def _above(rel: Column) -> Column:
    """The relative paths above a relative path, the root ("") first."""
    return F.transform(ancestors(F.concat(F.lit("/"), rel)), lambda a: F.substr(a, F.lit(2)))


def tree_diff(nodes: DataFrame, roots: Sequence[str]) -> DataFrame:
    """root, rel, path, is_file, is_dir, size, stat.

    stat is DUPS where another root has an equal node at the same relative path (files by file hash if both have one, else
    by directory hash), SUPR for directories below which all files are equal to some root's, else UNIQ. Coverage may come
    from several roots. Nodes of one relative path come together once: one for each root at most.
    """
    listed = F.array(*[F.struct(F.lit(r).alias("root"), is_below(F.col("path"), r).alias("inside"), relative_to(F.col("path"), r).alias("rel")) for r in roots])
    own = nodes.withColumn("at", F.explode(F.filter(listed, lambda x: x["inside"]))).select("at.root", "at.rel", "path", "is_file", "is_dir",
        "file_hash", "dir_hash", "size")
    together = own.groupBy("rel").agg(F.collect_list(F.struct("root", "path", "is_file", "is_dir", "file_hash", "dir_hash", "size")).alias("all"))

    def same(x: Column, y: Column) -> Column:
        both = x["file_hash"].isNotNull() & y["file_hash"].isNotNull()
        return F.when(both, x["file_hash"] == y["file_hash"]).otherwise(F.coalesce(x["dir_hash"] == y["dir_hash"], F.lit(False)))

    told = F.transform("all", lambda x: F.struct(x.alias("node"), F.exists("all", lambda y: (x["root"] != y["root"]) & same(x, y)).alias("eq")))
    marked = cut(together.select("rel", F.explode(told).alias("t")).select("t.node.root", "rel", "t.node.path", "t.node.is_file", "t.node.is_dir",
        "t.node.size", "t.eq"))
    # directories without files below them cover nothing and lack nothing
    leaves = marked.where("not is_dir and rel <> ''").select("root", F.explode(_above(F.col("rel"))).alias("rel"), "eq")
    covered = leaves.groupBy("root", "rel").agg(F.every("eq").alias("covered"))
    stat = F.when(F.col("eq"), DUPS).when(F.col("is_dir") & F.coalesce("covered", F.lit(True)), SUPR).otherwise(UNIQ)
    return cut(marked.join(covered, ["root", "rel"], "left").select("root", "rel", "path", "is_file", "is_dir", "size", stat.alias("stat")))


def displayed(diff: DataFrame) -> DataFrame:
    """Nodes that a report lists: not below a DUPS node; with label and size (0 if unknown)."""
    tops = diff.where((F.col("stat") == DUPS) & F.col("is_dir")).select("root", F.col("rel").alias("above"))
    hidden = diff.where("rel <> ''").select("root", "rel", F.explode(_above(F.col("rel"))).alias("above")).join(tops, ["root", "above"],
        "left_semi").select("root", "rel").distinct()
    label = F.when(F.col("stat") == DUPS, "DUPS").when(F.col("stat") == SUPR, "SUPR").otherwise("UNIQ")
    return diff.join(hidden, ["root", "rel"], "left_anti").select("root", "rel", "stat", label.alias("label"),
        icon(F.col("is_file"), F.col("is_dir")).alias("icon"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))
