"""Operator 1: URL allow and block rules answered by a Bloom filter cascade.

A rule is a host and a path prefix; it fits the host, all its subdomains, and every path that starts with its path. A
URL's candidate keys are its host's suffixes joined to its path's prefixes (of the lengths that rules have). The keys of
all URLs are the complete key universe. Level 0 of the cascade is a Bloom filter of the listed keys, level 1 one of
level 0's false positives over that universe, level 2 one of the listed keys that level 1 mistakes, and so on until a
level makes no mistake. Over that universe the first level that rejects a key then tells exactly whether it is listed,
so that URLs are judged without a join. A second cascade tells block rules from allow rules over the rules themselves.

Cases: a null URL or one without "://" has an empty host and path and fits no rule; a rule that is both allowed and
blocked counts as blocked; of fitting rules of equal length that with the longer host wins; the default verdict holds
where no rule fits; repeated rows are judged one by one; other columns of the input are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, mix64

#: A cascade larger than this is refused: it is broadcast to every executor.
MAX_BITS = 1 << 31


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray

    def places(self, a: np.ndarray, b: np.ndarray, number: int) -> np.ndarray:
        return bloom_places(a, b, number, self.bits, self.hashes)

    def holds(self, a: np.ndarray, b: np.ndarray, number: int) -> np.ndarray:
        at = self.places(a, b, number)
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def bloom_places(a: np.ndarray, b: np.ndarray, number: int, bits: int, hashes: int) -> np.ndarray:
    """Bit numbers, one row per key; a and b are two 64-bit hashes of the key, number is the level's."""
    salt = np.uint64((number + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    first, step = mix64(a.astype(np.uint64) ^ salt), mix64(b.astype(np.uint64) ^ salt) | np.uint64(1)
    return ((first[:, None] + step[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def cascade_holds(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact for keys of the universe over which the cascade was built."""
    listed = np.zeros(len(a), dtype=bool)
    left = np.arange(len(a))
    for number, level in enumerate(levels):
        left = left[level.holds(a[left], b[left], number)]
        listed[left] = number % 2 == 0
    return listed


def _two_hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b")]


def _build_level(keys: DataFrame, count: int, rate: float, number: int) -> Level:
    """A Bloom filter of keys (a, b): bits are set in partitions and merged by a bitwise-or aggregate."""
    hashes = max(1, math.ceil(math.log2(1 / rate)))
    bits = max(64, math.ceil(count * hashes / math.log(2)))
    if bits > MAX_BITS:
        raise ValueError(f"a level of {bits} bits is over the bound of {MAX_BITS}")

    def words(batches):
        for batch in batches:
            at = bloom_places(batch["a"].to_numpy(), batch["b"].to_numpy(), number, bits, hashes).ravel()
            yield pd.DataFrame({"word": at >> 6, "mask": np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64)}).drop_duplicates()

    filled = np.zeros(-(-bits // 64), dtype=np.uint64)
    for word, mask in keys.mapInPandas(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask")).collect():
        filled[word] = np.int64(mask).view(np.uint64)
    return Level(bits, hashes, filled)


def _test(keys: DataFrame, level: Level, number: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def passing(batches):
        for batch in batches:
            yield batch[shared.value.holds(batch["a"].to_numpy(), batch["b"].to_numpy(), number)]

    return keys.mapInPandas(passing, "a long, b long")


def build_cascade(universe: DataFrame, listed: DataFrame, scratch: Scratch) -> list[Level]:
    """universe, listed: keys as (a, b). Levels alternate between listed keys and the universe's false positives."""
    inside = scratch.save(listed.select("a", "b").distinct(), "listed")
    n = inside.count()
    if not n:
        return []
    universe = universe.select("a", "b")
    around = universe.agg(F.approx_count_distinct(F.struct("a", "b"))).first()[0]
    levels, number = [], 0
    include, other = inside, None
    rate = min(0.5, max(2**-30, math.sqrt(0.5) * n / max(around, 1)))
    while n:
        levels.append(_build_level(include, n, rate, number))
        if number == 0:
            wrong = _test(universe, levels[0], 0).distinct().join(inside, ["a", "b"], "left_anti")
        else:
            wrong = _test(other, levels[number], number)
        wrong = scratch.save(wrong, f"level{number}")
        include, other, n, rate, number = wrong, include, wrong.count(), 0.5, number + 1
    return levels


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased in ASCII, and path; both empty for a null URL or one without "://"."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2))
    return ascii_lower(host), path


def _candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """The URL's keys as structs (key, host length), longest first, of equal ones the longer host first."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: F.length(path) >= n), lambda n: F.substr(path, F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct((-F.length(s) - F.length(p)).alias("short"),
        (-F.length(s)).alias("host"), F.concat(s, p).alias("key")))))
    return F.transform(F.array_sort(keys), lambda x: x["key"])


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict: one row per input row."""
    spark: SparkSession = pages.sparkSession
    scratch = Scratch(spark, "urls")
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not rules:
        return parts.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = parts.withColumn("keys", _candidates(F.col("host"), F.col("path"), sorted({len(r.path) for r in rules})))
    stated = spark.createDataFrame([(r.key, r.action == "block") for r in rules], "key string, block boolean").groupBy("key").agg(F.max("block").alias("block"))
    stated = stated.select(*_two_hashes(F.col("key")), "block")
    listed = build_cascade(keyed.select(F.explode("keys").alias("key")).select(*_two_hashes(F.col("key"))), stated, scratch)
    blocked = build_cascade(stated, stated.where("block"), scratch)
    shared = spark.sparkContext.broadcast((listed, blocked))

    @F.pandas_udf("int")
    def first_listed(a: pd.Series, b: pd.Series) -> pd.Series:
        """Twice the place of the longest listed key, one more if it is blocked; -1 if none is listed."""
        rules_, blocks_ = shared.value
        sizes = a.str.len().fillna(0).to_numpy(dtype=np.int64)
        out = np.full(len(sizes), -1, dtype=np.int32)
        if not sizes.sum():
            return pd.Series(out)
        flat_a, flat_b = (np.concatenate([np.asarray(x, dtype=np.int64) for x in s]) for s in (a, b))
        rows = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.cumsum(sizes) - sizes
        hit = np.flatnonzero(cascade_holds(rules_, flat_a, flat_b))
        row, first = np.unique(rows[hit], return_index=True)
        hit = hit[first]
        out[row] = 2 * (hit - starts[row]) + cascade_holds(blocks_, flat_a[hit], flat_b[hit])
        return pd.Series(out)

    hashed = keyed.withColumn("found", first_listed(F.transform("keys", lambda k: F.xxhash64(k)),
        F.transform("keys", lambda k: F.xxhash64(F.lit("second"), k))))
    place = F.floor(F.col("found") / 2).cast("int")
    return hashed.select(
        "page_id", "host", "path",
        F.when(F.col("found") >= 0, F.get("keys", place)).alias("rule"),
        F.when(F.col("found") < 0, F.lit(default)).when(F.col("found") % 2 == 1, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
    )
