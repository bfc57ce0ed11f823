"""Sizes and hashes of directories.

A directory's hash is made from an order-free sum over its children (or leaves): each contributes SHA-256 of its name and
hash, cut into eight numbers of 28 bits, and the hash is SHA-256 of the number of children and the eight sums. So a
directory of any width is aggregated before the shuffle, and none is ever gathered in one place. Equal directories have
equal hashes; different ones would need equal sums of 224 bits.

Two plans give the same partition of directories: `roll_up` goes level by level from the deepest, `flat_signatures` does one
shuffle over exploded ancestors, for deep forests. A directory with any child that has no hash has neither hash nor size.
An archive stands in its parent with its file's hash and size and publishes the directory hash of its members besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, depth_of, name_of, parent_path
from ..plans.lineage import cut

PIECES, DIGITS = 8, 7


def _sums(digest: str) -> list[Column]:
    """Aggregates: the sums of the pieces of each row's SHA-256."""
    return [F.sum(F.conv(F.substring(digest, 1 + DIGITS * k, DIGITS), 16, 10).cast("long")).alias(f"s{k}") for k in range(PIECES)]


def _digest(count: str) -> Column:
    return F.sha2(F.concat_ws("|", F.col(count), *[F.col(f"s{k}") for k in range(PIECES)]), 256)


def _level(children: DataFrame) -> DataFrame:
    """path, dir_size, dir_hash of the parents of children (parent_path, name, h, size)."""
    told = children.select("parent_path", "size", F.sha2(F.concat("name", "h").cast("binary"), 256).alias("digest"))
    sums = told.groupBy("parent_path").agg(F.count("*").alias("n"), F.count("digest").alias("hashed"), F.sum("size").cast("long").alias("dir_size"),
        *_sums("digest"))
    whole = F.col("n") == F.col("hashed")
    return sums.select(F.col("parent_path").alias("path"), F.when(whole, F.col("dir_size")).alias("dir_size"), F.when(whole, _digest("n")).alias("dir_hash"))


def roll_up(files: DataFrame, max_depth: int | None = None, archives: bool = False) -> DataFrame:
    """path, parent_path, name, depth, dir_size, dir_hash of all directories above files.

    files: path, file_size, file_hash. max_depth: of the files, if it is known. archives: some paths are files and have
    members below them. Every level is kept in the shared folder, since the next one and the result read it.
    """
    leaves = files.select("path", parent_path(F.col("path")).alias("parent_path"), name_of(F.col("path")).alias("name"),
        depth_of(F.col("path")).alias("depth"), F.col("file_hash").alias("h"), F.col("file_size").alias("size"))
    if max_depth is None:
        max_depth = leaves.agg(F.max("depth")).first()[0] or 0
    done, below = [], None
    for depth in range(max_depth, 0, -1):
        here = leaves.where(F.col("depth") == depth).select("path", "parent_path", "name", "h", "size")
        if below is not None:
            # an archive's directory row gives way to its file row
            here = here.unionByName(below.join(here.select("path"), "path", "left_anti") if archives else below)
        dirs = cut(_level(here))
        path = F.col("path")
        done.append(dirs.select("path", parent_path(path).alias("parent_path"), name_of(path).alias("name"), F.lit(depth - 1).alias("depth"),
            "dir_size", "dir_hash"))
        below = dirs.select("path", parent_path(path).alias("parent_path"), name_of(path).alias("name"), F.col("dir_hash").alias("h"),
            F.col("dir_size").alias("size"))
    if not done:
        return leaves.select("path", "parent_path", "name", "depth", F.col("size").alias("dir_size"), F.col("h").alias("dir_hash")).limit(0)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def flat_signatures(files: DataFrame) -> DataFrame:
    """path, dir_size, signature: equal signatures for directories with equal relative paths and contents.

    Leaves inside an archive count up to the archive only.
    """
    path = F.col("path")
    inner = F.col("archive_path") if "archive_path" in files.columns else F.lit(None).cast("string")
    up = F.when(inner.isNull(), ancestors(path)).otherwise(F.filter(ancestors(path), lambda a: (a == inner) | a.startswith(F.concat(inner, F.lit("/")))))
    rows = files.select("path", "file_hash", "file_size", F.explode(up).alias("dir"))
    told = rows.select("dir", "file_size", F.sha2(F.concat(F.substr(path, F.length("dir") + 2), F.lit("\0"), "file_hash").cast("binary"), 256).alias("digest"))
    sums = told.groupBy("dir").agg(F.count("*").alias("n"), F.count("digest").alias("hashed"), F.sum("file_size").cast("long").alias("dir_size"),
        *_sums("digest"))
    return sums.where("n = hashed").select(F.col("dir").alias("path"), "dir_size", _digest("n").alias("signature"))


def directory_sizes(files: DataFrame) -> DataFrame:
    """path, dir_size, n_files over all files, hashed or not."""
    return files.select("file_size", F.explode(ancestors(F.col("path"))).alias("path")).groupBy("path").agg(
        F.sum("file_size").cast("long").alias("dir_size"), F.count("*").alias("n_files"))
