"""Operator 10: minimax contiguous partition of atomic groups into shards.

Documents with equal texts form one atomic group. Groups stand in the order of their text's SHA-256, so their order does
not depend on the input's and every prefix of the digest holds about as many groups as any other. The smallest feasible
shard capacity is found by binary search with a greedy check, and the shards are cut where the greedy walk cuts.

The walk never sees single groups unless it must: it starts from the sums of 4,096 digest prefixes and splits only those
prefixes in which a cut may fall, until the lower bound (cuts allowed anywhere inside a prefix) meets the upper bound
(cuts allowed between prefixes only). The driver so holds some ten thousand sums, whatever the input's size.

Cases: a null text has size 0 plus the overhead, a null CRC, and all null texts form one group apart from empty texts;
null, repeated and clashing ids are kept as they are; an empty table gives an empty result; fewer groups than shards
leave the last shards empty. Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

FIRST_DIGITS, MORE_DIGITS = 3, 2


@dataclass(frozen=True)
class Block:
    """Groups that follow one another: those whose digest starts with prefix."""

    prefix: str
    size: int
    groups: int
    largest: int


def _walk(blocks: list[Block], capacity: int, whole: bool) -> list[int]:
    """Greedy cuts: indexes of the blocks at which (whole) or within which a new shard starts."""
    cuts, held = [], 0
    for i, b in enumerate(blocks):
        rest = b.size
        if whole or b.groups == 1:
            if held + rest > capacity:
                cuts.append(i)
                held = 0
        else:
            while held + rest > capacity:
                rest -= capacity - held
                cuts.append(i)
                held = 0
        held += rest
    return cuts


def _smallest(blocks: list[Block], shards: int, whole: bool) -> int:
    low = max(max(b.size if whole else b.largest for b in blocks), -(-sum(b.size for b in blocks) // shards))
    high = max(low, sum(b.size for b in blocks))
    while low < high:
        mid = (low + high) // 2
        if len(_walk(blocks, mid, whole)) < shards:
            high = mid
        else:
            low = mid + 1
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest capacity, and for each shard after the first the digest prefix it starts with.

    groups: digest, bytes; one row per group.
    """

    def sums(rows: DataFrame, digits: int) -> list[Block]:
        found = rows.groupBy(F.substring("digest", 1, digits).alias("prefix")).agg(
            F.sum("bytes").alias("size"), F.count("*").alias("groups"), F.max("bytes").alias("largest")
        )
        return [Block(*r) for r in found.collect()]

    blocks = sorted(sums(groups, FIRST_DIGITS), key=lambda b: b.prefix)
    while blocks:
        low, high = _smallest(blocks, shards, False), _smallest(blocks, shards, True)
        if low == high:
            return high, [blocks[i].prefix for i in _walk(blocks, high, True)]
        split: set[str] = set()
        for at_low, at_high in zip(_walk(blocks, low, False), [*_walk(blocks, high, False), *[len(blocks) - 1] * shards], strict=False):
            split |= {b.prefix for b in blocks[min(at_low, at_high) : max(at_low, at_high) + 1] if b.groups > 1}
        finer = [b for b in blocks if b.prefix not in split]
        for digits in {len(p) for p in split}:
            chosen = [p for p in split if len(p) == digits]
            finer += sums(groups.where(F.substring("digest", 1, digits).isin(chosen)), digits + MORE_DIGITS)
        blocks = sorted(finer, key=lambda b: b.prefix)
    return 0, []


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, slot_buckets: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per input row.

    slot_buckets: rows of a shard are numbered in so many independent parts, by a digest of the id, whose offsets come from
    a table of shards x slot_buckets counts (that bound is what makes its broadcast safe).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.col(text_col)
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("null")).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    sized = scratch.save(sized, "sized")
    groups = scratch.save(sized.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    _, starts = minimax_cuts(groups, shards)
    scratch.drop(groups)
    shard = F.lit(0)
    for start in starts:
        shard = shard + (F.col("digest") >= F.lit(start)).cast("int")
    placed = sized.withColumn("shard", shard.cast("int")).withColumn("part",
        F.pmod(F.conv(F.substring(F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"), 256), 1, 7), 16, 10).cast("long"),
        F.lit(slot_buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "row"))
    return placed.join(F.broadcast(offsets), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + within - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard")
    )
