"""Sizes, icons, hashes and binary fields."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

# Block group types and profiles by bit, as the file system writes them.
GROUP_TYPES = {1: "data", 2: "system", 4: "metadata"}
GROUP_PROFILES = {8: "raid0", 16: "raid1", 32: "dup", 64: "raid10", 128: "raid5", 256: "raid6"}
# Compression codes of extents.
COMPRESSION = {0: "none", 1: "zlib", 2: "lzo"}

ICON_RANK = {"D": 0, "A": 1, "F": 2, "X": 3}


def human_size(size: Column, units: int = 6) -> Column:
    """Binary units with one decimal, cut off rather than rounded; below 1024 a whole number.

    size: a long or a decimal without fraction; units: how many of Ki to Ei there are, the last one for all that is larger.
    """
    exact = size.cast("decimal(38,0)")
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(["Ki", "Mi", "Gi", "Ti", "Pi", "Ei"][:units], 1):
        one = F.lit(1024**power).cast("decimal(19,0)")
        # in whole numbers: neither ten times a size nor its double need be exact
        whole = F.call_function("div", exact, one)
        tenth = F.call_function("div", (exact % one) * 10, one)
        text = F.concat(whole.cast("string"), F.lit("."), tenth.cast("string"), F.lit(f" {unit}B"))
        out = F.when(exact >= one, text).otherwise(out)
    return out


def icon(is_file: Column, is_dir: Column) -> Column:
    """A for an archive (file and directory), else F or D, X for what is neither."""
    return F.when(is_file & is_dir, "A").when(is_file, "F").when(is_dir, "D").otherwise("X")


def icon_rank(code: Column) -> Column:
    out = F.lit(ICON_RANK["X"])
    for k, v in ICON_RANK.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def member_icon(typ: Column, is_dir: Column) -> Column:
    """A group member's icon: a file that is also a directory is an archive."""
    return F.when((typ == "F") & is_dir, "A").otherwise(typ)


def page_rounded(mib: Column) -> Column:
    """Mebibytes as bytes, rounded to whole 4 KiB."""
    return F.floor((F.floor(mib * (1 << 20)).cast("long") + 1024) / 4096).cast("long") * 4096


def clamped_budget(total: Column, used: Column, low: int, high: int) -> Column:
    """Half of what is free, in steps of 64 KiB, within bounds."""
    half = F.floor((total - used) / 2 / 65536).cast("long") * 65536
    return F.least(F.greatest(half, F.lit(low)), F.lit(high))


def decode_hash(text: Column) -> Column:
    """Base64 to lower hex; texts over 44 characters (hashes of an old kind) and those not of 32 bytes are null."""
    padded = F.rpad(F.regexp_replace(text, "=+$", ""), 44, "=")
    raw = F.when(F.length(text) <= 44, F.unbase64(padded))
    return F.when(F.length(raw) == 32, F.lower(F.hex(raw)))


def group_type(flags: Column) -> Column:
    """Names of the set type bits, joined by commas."""
    return F.array_join(F.filter(F.array(*[F.when(flags.bitwiseAND(F.lit(bit).cast("long")) != 0, name) for bit, name in GROUP_TYPES.items()]),
        lambda x: x.isNotNull()), ",")


def group_profile(flags: Column) -> Column:
    out = F.lit("single")
    for bit, name in reversed(GROUP_PROFILES.items()):
        out = F.when(flags.bitwiseAND(F.lit(bit).cast("long")) != 0, name).otherwise(out)
    return out


def profile_code(name: Column) -> Column:
    """The bit of a profile's name, 0 for single, null for others."""
    out = F.when(name == "single", 0)
    for bit, known in GROUP_PROFILES.items():
        out = out.when(name == known, bit)
    return out


def key_text(object_id: Column, item_type: Column, offset: Column) -> Column:
    """object/type @ 0xoffset"""
    return F.concat_ws("", object_id.cast("string"), F.lit("/"), item_type.cast("string"), F.lit(" @ 0x"), F.lower(F.hex(offset)))


def uuid_text(raw: Column) -> Column:
    h = F.lower(F.hex(raw))
    return F.concat_ws("-", *[F.substring(h, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def time_text(seconds: Column, nanos: Column) -> Column:
    """ISO date and time in UTC with nine decimals."""
    day = F.date_add(F.to_date(F.lit("1970-01-01")), F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))
    return F.concat(day.cast("string"), F.lit("T"), F.format_string("%02d:%02d:%02d.%09d", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60, nanos))


def _crc32c_tables() -> np.ndarray:
    """Eight tables of 256: table k is the checksum's step over a byte that k bytes follow."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = value >> 1 ^ np.where(value & 1, np.uint32(0x82F63B78), np.uint32(0))
    tables = [value]
    for _ in range(7):
        tables.append(tables[-1] >> np.uint32(8) ^ value[tables[-1] & np.uint32(255)])
    return np.stack(tables)


_CRC32C = _crc32c_tables()
_ROWS = [t.tolist() for t in _CRC32C]


def crc32c_of(data: bytes, state: int = 0xFFFFFFFF, final: int = 0xFFFFFFFF) -> int:
    """Castagnoli's checksum, eight bytes a step; directory names are hashed with state 2**32 - 2 and no final inversion."""
    t0, t1, t2, t3, t4, t5, t6, t7 = _ROWS
    whole = len(data) // 8 * 8
    for word in struct.unpack(f"<{whole // 8}Q", data[:whole]):
        word ^= state
        state = t7[word & 255] ^ t6[word >> 8 & 255] ^ t5[word >> 16 & 255] ^ t4[word >> 24 & 255] ^ t3[word >> 32 & 255] ^ t2[word >> 40 & 255] ^ t1[
            word >> 48 & 255] ^ t0[word >> 56]
    for byte in data[whole:]:
        state = state >> 8 ^ t0[(state ^ byte) & 255]
    return state ^ final


def crc32c_many(values: list[bytes], state: int = 0xFFFFFFFF, final: int = 0xFFFFFFFF) -> np.ndarray:
    """Checksums of many values at once: one step for the k-th byte of all that are that long."""
    sizes = np.array([len(v) for v in values], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1][order]
    raw, found = np.frombuffer(b"".join(values), dtype=np.uint8), np.full(len(values), state, dtype=np.uint32)
    left = len(values)
    for k in range(int(sizes.max(initial=0))):
        while left and sizes[order[left - 1]] <= k:
            left -= 1
        now = found[:left]
        found[:left] = now >> np.uint32(8) ^ _CRC32C[0][(now ^ raw[starts[:left] + k]) & np.uint32(255)]
    out = np.empty(len(values), dtype=np.int64)
    out[order] = found ^ np.uint32(final)
    return out


def _checksums(data: pd.Series, state: int, final: int) -> pd.Series:
    known = data.notna()
    out = pd.Series([None] * len(data), index=data.index, dtype="Int64")
    out[known] = crc32c_many([bytes(x) for x in data[known]], state, final)
    return out


@F.pandas_udf(LongType())
def crc32c(data: pd.Series) -> pd.Series:
    return _checksums(data, 0xFFFFFFFF, 0xFFFFFFFF)


@F.pandas_udf(LongType())
def name_hash(data: pd.Series) -> pd.Series:
    """What directories find entries by."""
    return _checksums(data, 0xFFFFFFFE, 0)


@F.pandas_udf(StructType().add("data", BinaryType()).add("error", StringType()))
def decompressed(code: pd.Series, data: pd.Series, size: pd.Series) -> pd.DataFrame:
    """Extent bytes by compression code: zlib streams carry 8 leading bytes of lengths; LZO has no decoder here."""

    def one(kind, raw, n):
        if raw is None:
            return None, None
        try:
            if kind == 0:
                return bytes(raw), None
            if kind == 1:
                return zlib.decompressobj(-15).decompress(bytes(raw)[8:], int(n)), None
        except zlib.error as broken:
            return None, str(broken)
        return None, f"no decoder for {COMPRESSION.get(kind, kind)}"

    return pd.DataFrame([one(*x) for x in zip(code, data, size, strict=True)], columns=["data", "error"])
