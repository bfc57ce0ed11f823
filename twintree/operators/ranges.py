"""Joins by address range and by parent."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut


def to_physical(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """address, physical: asked (address) mapped through chunks (start, length, physical); null where no chunk holds it.

    Chunks do not overlap. They are put in classes by length (powers of two), and a chunk lies in at most two grains of its
    class; an address asks for its grain in each class that occurs (64 at most). So this is an equi-join at every size, and
    a grain holds few chunks, whatever their lengths are.
    """
    kind = F.ceil(F.log2(F.greatest(F.col("length"), F.lit(1)))).cast("int")
    grain = lambda x: F.call_function("shiftright", x, F.col("class"))
    classed = chunks.where("length > 0").select("start", "length", F.col("physical").alias("base"), kind.alias("class"))
    cells = classed.select("*", F.explode(F.array_distinct(F.array(grain(F.col("start")), grain(F.col("start") + F.col("length") - 1)))).alias("grain"))
    classes = [r["class"] for r in classed.select("class").distinct().collect()]
    places = asked.select("address").distinct()
    probes = places.select("address", F.explode(F.array(*map(F.lit, classes)) if classes else F.array().cast("array<int>")).alias("class"))
    probes = probes.select("address", "class", grain(F.col("address")).alias("grain"))
    inside = (F.col("address") >= F.col("start")) & (F.col("address") < F.col("start") + F.col("length"))
    found = probes.join(cells, ["class", "grain"]).where(inside).select("address", (F.col("base") + F.col("address") - F.col("start")).alias("physical"))
    return asked.select("address").join(found, "address", "left")


def build_paths(nodes: DataFrame) -> DataFrame:
    """id, path of nodes (id, parent, name): names from the top down, by doubling.

    Each round joins every unfinished node with its ancestor's, so depth d takes log2(d) rounds; nodes whose parent is null,
    unknown or themselves are tops. Nodes of a cycle, or below one, have no path: they are told first, by pointers alone,
    since no chain without a cycle is longer than there are nodes.
    """
    known = nodes.select(F.col("id").alias("known"))
    top = F.col("parent").isNull() | F.col("known").isNull() | (F.col("parent") == F.col("id"))
    first = cut(nodes.join(known, F.col("parent") == F.col("known"), "left").select("id", F.when(~top, F.col("parent")).alias("up"),
        F.concat(F.lit("/"), "name").alias("path")))
    rounds = math.ceil(math.log2(max(2, first.count()))) + 1

    def doubled(state: DataFrame, more: list) -> DataFrame:
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), *([F.col("path").alias("head")] if more else []))
        return cut(state.join(above, "up", "left").select("id", F.col("next").alias("up"), *more))

    chain = first.select("id", "up")
    for _ in range(rounds):
        if not chain.where("up is not null").limit(1).count():
            break
        chain = doubled(chain, [])
    state = first.join(chain.where("up is null").select("id"), "id", "left_semi")
    while state.where("up is not null").limit(1).count():
        state = doubled(state, [F.concat(F.coalesce("head", F.lit("")), "path").alias("path")])
    return state.select("id", "path")
