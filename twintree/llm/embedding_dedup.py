"""Operator 6: near-duplicate vectors by a forest of random-projection trees.

Trees are fitted on a bounded sample: every node halves its sample along a random direction, down to leaves of about
leaf_rows rows of the whole table. Every vector then walks down every tree; near a split (within the level's spill, which
goes by the spread of the rows around the split) it takes both branches. Vectors of one label in one leaf are compared, every pair in the first leaf that both share, so
that its link is counted once; links join the components.

Rows with the same label and the same vector are one node with a weight before they meet the trees. A leaf with more
than block_rows rows of one label is cut into chunks, and every pair of chunks is a task's work of bounded size.

Cases: a null label, and a null, empty or zero vector or one with null or non-finite components, link with nothing: no
links, its own component, kept; vectors of different lengths do not link; a null id has a null component and is kept;
rows that repeat an id count one by one; an empty table gives an empty result; only id, vector and label are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean
from .graph import components, local_roots
from .topk_search import valid_vector


@dataclass
class Tree:
    """A complete binary tree: direction and spill by depth, threshold by node; leaves are numbered from first."""

    directions: np.ndarray
    thresholds: np.ndarray
    spills: np.ndarray
    first: int


#: A node with fewer sampled rows splits where all sampled rows of its depth do.
_LEAST_ROWS = 8


def grow(sample: np.ndarray, depth: int, seed: int, first: int, overlap: float) -> Tree:
    """overlap: the share of rows so near to a split that they take both branches."""
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((depth, sample.shape[1]))
    directions /= np.maximum(np.linalg.norm(directions, axis=1, keepdims=True), 1e-300)
    thresholds, spills = np.zeros(2**depth), np.zeros(depth)
    node = np.ones(len(sample), dtype=np.int64)
    for d in range(depth):
        along = sample @ directions[d]
        order = np.lexsort((along, node))
        low, high = np.searchsorted(node[order], np.arange(2**d, 2 ** (d + 1))), np.searchsorted(node[order], np.arange(2**d, 2 ** (d + 1)), side="right")
        ranked = along[order]
        middle = np.minimum((low + high) // 2, len(sample) - 1)
        thresholds[2**d : 2 ** (d + 1)] = np.where(high - low >= _LEAST_ROWS, ranked[middle], np.median(along))
        spills[d] = np.quantile(np.abs(along - thresholds[node]), overlap)
        node = 2 * node + (along > thresholds[node])
    return Tree(directions, thresholds, spills, first)


def leaves_of(tree: Tree, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that a row comes to."""
    row, node = np.arange(len(units)), np.ones(len(units), dtype=np.int64)
    depth = len(tree.directions)
    for d in range(depth):
        off = (units @ tree.directions[d])[row] - tree.thresholds[node]
        right, left = off > -tree.spills[d], off <= tree.spills[d]
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
    return row, node - 2**depth + tree.first


def plan_forest(depth: int, overlap: float, max_copies: float) -> float:
    """The overlap at each level at which a row comes to max_copies leaves of a tree at most, on average."""
    return min(overlap, max_copies ** (1 / depth) - 1) if depth else 0.0


def _units(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare_block(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links counted here for the first time, and each row's smallest linked row, of one leaf's block."""
    units, node, weight = _units(group["vector"]), group["node"].to_numpy(), group["weight"].to_numpy()
    side, leaf = group["chunk"].to_numpy(), int(group["leaf"].iloc[0])
    i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
    linked = units @ units.T >= threshold
    linked &= (side[:, None] == i) & (side[None, :] == j) | (side[:, None] == j) & (side[None, :] == i)
    np.fill_diagonal(linked, False)
    if not linked.any():
        return pd.DataFrame({"node": node[:0], "links": weight[:0], "root": node[:0]})
    order = np.argsort(node, kind="stable")
    a, b = np.nonzero(linked[np.ix_(order, order)])
    root = np.empty(len(node), dtype=np.int64)
    root[order] = node[order][local_roots(len(node), a, b)]
    seen = sorted({x for mine in group["leaves"] for x in mine if x < leaf})
    if seen:
        place = {x: k for k, x in enumerate(seen)}
        been = np.zeros((len(node), len(seen)), dtype=np.float32)
        for r, mine in enumerate(group["leaves"]):
            been[r, [place[x] for x in mine if x < leaf]] = 1
        linked &= been @ been.T < 0.5
    return pd.DataFrame({"node": node, "links": linked @ weight, "root": root})[lambda x: (x["links"] > 0) | (x["root"] != x["node"])]


def forest_links(vectors: DataFrame, threshold: float = 0.93, trees: int = 4, leaf_rows: int = 2048, overlap: float = 0.25, max_copies: float = 8.0,
    sample_rows: int = 20_000, block_rows: int = 2048, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row. sample_rows bounds what the trees are fitted on.

    A row comes to trees x max_copies leaves on average at most, whatever the table's size: overlap is the share of rows that
    take both branches of a split, less where the trees are so deep that this would give more copies.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "forest")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    usable = valid_vector(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("same", F.when(usable, F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("vector").cast("array<string>")), 256)))
    nodes = rows.where("same is not null").groupBy("same").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"),
        F.first("vector").alias("vector"), F.first("label").alias("label"))
    nodes = scratch.save(nodes.withColumn("dim", F.size("vector")), "nodes")
    count = nodes.count()
    depth = max(0, math.ceil(math.log2(max(1, count) / leaf_rows)))
    forests: dict[int, list[Tree]] = {}
    sample: dict[int, list] = {}
    for r in nodes.orderBy(F.xxhash64("node"), "node").limit(sample_rows).select("dim", "vector").collect():
        sample.setdefault(r["dim"], []).append(r["vector"])
    for dim, found in sample.items():
        forests[dim] = [grow(_units(pd.Series(found)), depth, seed + t, t * 2**depth, plan_forest(depth, overlap, max_copies)) for t in range(trees)]
    shared = spark.sparkContext.broadcast(forests)

    def placed(batches):
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                units = _units(part["vector"])
                # a dimension that no sampled vector has gets one leaf for each tree
                forest = shared.value.get(dim) or [Tree(np.zeros((0, int(dim))), np.zeros(1), np.zeros(0), 0)]
                found = [leaves_of(tree, units) for tree in forest]
                row, leaf = np.concatenate([r for r, _ in found]), np.concatenate([x for _, x in found])
                order = np.lexsort((leaf, row))
                row, leaf = row[order], leaf[order]
                cuts = np.searchsorted(row, np.arange(len(part) + 1))
                yield part[["node", "weight", "label", "dim", "vector"]].assign(leaves=[leaf[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)])

    label_type = nodes.schema["label"].dataType.simpleString()
    kind = nodes.schema["vector"].dataType.simpleString()
    leaves = nodes.select("node", "weight", "label", "dim", "vector").mapInPandas(lean(placed),
        f"node long, weight long, label {label_type}, dim int, vector {kind}, leaves array<int>")
    leaves = scratch.save(leaves, "leaves")
    cells = leaves.select("label", "dim", F.explode("leaves").alias("leaf")).groupBy("label", "dim", "leaf").agg(
        F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("chunks"))
    cells = scratch.save(cells.where("chunks > 1"), "cells")
    in_leaf = leaves.select("*", F.explode("leaves").alias("leaf"))
    if cells.limit(1).count():
        in_leaf = in_leaf.join(cells, ["label", "dim", "leaf"], "left")
    else:
        in_leaf = in_leaf.withColumn("chunks", F.lit(1))
    chunks = F.coalesce("chunks", F.lit(1))
    in_leaf = in_leaf.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    blocks = in_leaf.select("node", "weight", "label", "dim", "vector", "leaves", "leaf", "chunk", F.least("chunk", "other").alias("i"),
        F.greatest("chunk", "other").alias("j"))
    found = blocks.groupBy("label", "dim", "leaf", "i", "j").applyInPandas(lambda group: compare_block(group, threshold), "node long, links long, root long")
    found = scratch.save(found, "found")
    joined = components(found.where("root <> node").select(F.col("node").alias("u"), F.col("root").alias("v")), scratch)
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    summary = nodes.select("same", "node", "weight").join(counted, "node", "left").join(joined, "node", "left")
    summary = summary.select("same", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"))
    out = rows.select("vec_id", "same").join(scratch.save(summary, "summary"), "same", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
