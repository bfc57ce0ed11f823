"""Connected components over links that stay distributed: alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _smaller(rows: DataFrame) -> DataFrame:
    """Every (u, v) joined with the smallest of u's neighbours, itself included."""
    least = rows.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return rows.join(least, "u")


def _round(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _smaller(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    small = _smaller(large)
    return small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u > v").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links (u, v) of longs -> (node, component): the smallest node that links reach, for every node that is not itself the smallest.

    A smallest node has no row. Null ends and loops are passed over; the result is a scratch table.
    """
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u > v").distinct()

    def state(rows: DataFrame) -> tuple:
        return rows.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()

    held = scratch.save(links, "links")
    before = state(held)
    while before[0]:
        after = scratch.save(_round(held), "stars")
        now = state(after)
        scratch.drop(held)
        held = after
        if now == before:
            break
        before = now
    return held.select(F.col("u").alias("node"), F.col("v").alias("component"))


def local_roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that links (a[i], b[i]) reach, for each of size indexes; for the links of one bounded block."""
    root = np.arange(size)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        root = new[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root
