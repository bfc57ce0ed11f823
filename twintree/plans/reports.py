"""Listings and their text and JSON forms."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import ancestors, components, display_path, name_of, parent_path
from ..functions.scalars import human_size, icon, icon_rank, member_icon
from ..operators.diff import displayed
from ..operators.groups import hash_counts


def group_lines(report: DataFrame, roots: Sequence[str] = (), absolute: bool = False) -> DataFrame:
    """group_rank, member_rank, line: a head for each group (member_rank 0) and a line for each member."""
    heads = report.groupBy("group_rank").agg(F.max("size").alias("size")).select("group_rank", F.lit(0).alias("member_rank"),
        F.concat(F.lit("Group "), human_size(F.col("size"))).alias("line"))
    mark = F.when(F.col("shadowed"), "S").otherwise(" ")
    lines = report.select("group_rank", "member_rank", F.concat(F.lit("   "), member_icon(F.col("typ"), F.col("is_dir")), mark, F.lit(" "),
        display_path(F.col("path"), roots, absolute)).alias("line"))
    return heads.unionByName(lines).orderBy("group_rank", "member_rank")


def write_group_text(report: DataFrame, path: str, roots: Sequence[str] = (), absolute: bool = False) -> None:
    """Text files whose parts, in order of their names, are the report."""
    group_lines(report, roots, absolute).select("line").write.mode("overwrite").text(path)


def tree_listing(nodes: DataFrame, all_members: DataFrame) -> DataFrame:
    """path, parent_path, label, icon, name, size, child_rank of every node that is not below a duplicate.

    nodes: as diff.nodes_of gives them. Children stand by icon, duplicates first, larger first, then by name.
    """
    counts = hash_counts(all_members).select("hash", F.col("n").alias("copies"))
    own = F.when(F.col("is_file"), F.col("file_hash")).otherwise(F.col("dir_hash"))
    labelled = nodes.withColumn("hash", own).join(counts, "hash", "left").withColumn("dup", F.coalesce(F.col("copies") > 1, F.lit(False)))
    tops = labelled.where("dup").select(F.col("path").alias("above"))
    hidden = labelled.select("path", F.explode(ancestors(F.col("path"))).alias("above")).join(tops, "above", "left_semi").select("path").distinct()
    seen = labelled.join(hidden, "path", "left_anti").where("path <> ''")
    code = icon(F.col("is_file"), F.col("is_dir"))
    rows = seen.select("path", parent_path(F.col("path")).alias("parent_path"), F.when(F.col("dup"), "DUPS").otherwise("UNIQ").alias("label"),
        code.alias("icon"), name_of(F.col("path")).alias("name"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    rank = F.row_number().over(Window.partitionBy("parent_path").orderBy(icon_rank(F.col("icon")), F.col("label"), F.desc("size"), "name"))
    return rows.withColumn("child_rank", rank)


def first_members(listing: DataFrame, nodes: DataFrame, all_members: DataFrame, most: int = 4) -> DataFrame:
    """path, member_rank, member: the first members of the group of every listed duplicate."""
    own = F.when(F.col("is_file"), F.col("file_hash")).otherwise(F.col("dir_hash"))
    tops = listing.where("label = 'DUPS'").select("path").join(nodes.select("path", own.alias("hash")), "path")
    rank = F.row_number().over(Window.partitionBy("hash").orderBy("typ_order", components(F.col("member"))))
    firsts = all_members.select("hash", "typ_order", F.col("path").alias("member")).withColumn("member_rank", rank).where(F.col("member_rank") <= most)
    return tops.join(firsts.join(tops.select("hash").distinct(), "hash", "left_semi"), "hash").select("path", "member_rank", "member")


def tree_json(listing: DataFrame, members: DataFrame, root: str = "") -> str:
    """The nested listing of one tree; meant for reports that a person reads, so it is put together on the driver."""
    rows = listing.orderBy("parent_path", "child_rank").collect()
    firsts: dict[str, list[str]] = {}
    for r in members.orderBy("path", "member_rank").collect():
        firsts.setdefault(r["path"], []).append(r["member"])
    children: dict[str, list] = {}
    for r in rows:
        children.setdefault(r["parent_path"], []).append(r)

    def build(path: str) -> dict:
        return {f"{r['label']} {r['icon']} {r['name']} {r['size']}": dict.fromkeys(firsts.get(r["path"], []), " ") if r["label"] == "DUPS"
            else build(r["path"]) for r in children.get(path, [])}

    return json.dumps(build(root), indent=2, ensure_ascii=False)


def diff_listing(diff: DataFrame) -> DataFrame:
    """displayed(diff) with parent and child_rank: by icon, stat and size (larger first), then name."""
    shown = displayed(diff).where("rel <> ''")
    rel = F.concat(F.lit("/"), F.col("rel"))
    shown = shown.withColumn("parent", F.substr(parent_path(rel), F.lit(2))).withColumn("name", name_of(rel))
    rank = F.row_number().over(Window.partitionBy("root", "parent").orderBy(icon_rank(F.col("icon")), F.desc("stat"), F.desc("size"), "name"))
    return shown.withColumn("child_rank", rank)


def diff_json(diff: DataFrame) -> str:
    children: dict[tuple[str, str], list] = {}
    roots = []
    for r in diff_listing(diff).orderBy("root", "parent", "child_rank").collect():
        if r["root"] not in roots:
            roots.append(r["root"])
        children.setdefault((r["root"], r["parent"]), []).append(r)

    def build(root: str, rel: str) -> dict:
        return {f"{r['label']} {r['icon']} {r['name']} {r['size']}": None if r["label"] == "DUPS" else build(root, r["rel"])
            for r in children.get((root, rel), [])}

    return json.dumps({root: build(root, "") for root in roots}, indent=2, ensure_ascii=False)
