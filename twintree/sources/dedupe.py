"""The dedupe action: files give up their blocks to their keeper, through the kernel's call that compares them first."""

from __future__ import annotations

import fcntl
import os
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import BUDGET_FLOOR, split_ranges

# Fixed values of the kernel's call: request, header, one destination, status of equal ranges and of different ones.
REQUEST = 0xC0189436
HEAD, DESTINATION = "=QQHHI", "=qQQiI"
SAME, DIFFERS = 0, 1
SCHEMA = "hash string, keeper string, path string, file_size long, deduped long, state string"


def dedupe_range(source: int, offset: int, length: int, target: int) -> tuple[int, int]:
    """(bytes deduped, status) of one range at the same place of two open files."""
    asked = bytearray(struct.pack(HEAD, offset, length, 1, 0, 0) + struct.pack(DESTINATION, target, offset, 0, 0, 0))
    fcntl.ioctl(source, REQUEST, asked)
    _, _, done, status, _ = struct.unpack_from(DESTINATION, asked, struct.calcsize(HEAD))
    return done, status


def dedupe_file(keeper: str, path: str, size: int, ctime: int | None, keeper_ctime: int | None, budget: int) -> tuple[int, str]:
    """(bytes deduped, state). A file whose size or change time is not what the scan saw is left alone."""
    try:
        with open(keeper, "rb") as source, open(path, "r+b") as target:
            for f, seen in ((source, keeper_ctime), (target, ctime)):
                now = os.fstat(f.fileno())
                if now.st_size != size or (seen is not None and int(now.st_ctime) != seen):
                    return 0, "keeper changed" if f is source else "changed"
            done = 0
            for low, high in split_ranges(size, budget, 2):
                while low < high:
                    step, status = dedupe_range(source.fileno(), low, high - low, target.fileno())
                    if status != SAME or not step:
                        return done, "differs" if status == DIFFERS else f"status {status}"
                    low, done = low + step, done + step
            return done, "deduped"
    except OSError as why:
        return 0, why.strerror or str(why)


def dedupe(plan: DataFrame, budget: int, simulate: bool = True) -> DataFrame:
    """hash, keeper, path, file_size, deduped, state for each row of dedup_groups (state "planned" and 0 bytes if simulated).

    Files of a keeper are worked off by one task after the other, nearest places first, since they lock its blocks.
    """
    if simulate:
        return plan.select("hash", "keeper", "path", "file_size", F.lit(0).cast("long").alias("deduped"), F.lit("planned").alias("state"))
    limit = max(budget, BUDGET_FLOOR)
    times = [c if c in plan.columns else F.lit(None).cast("long").alias(c) for c in ("ctime", "keeper_ctime")]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for r in frame.itertuples(index=False):
                seen = [None if pd.isna(x) else int(x) for x in (r.ctime, r.keeper_ctime)]
                made.append((r.hash, r.keeper, r.path, r.file_size, *dedupe_file(r.keeper, r.path, int(r.file_size), *seen, limit)))
            yield pd.DataFrame(made, columns=["hash", "keeper", "path", "file_size", "deduped", "state"])

    rows = plan.select("hash", "keeper", "path", "file_size", "phys", *times)
    return rows.repartition("hash").sortWithinPartitions("hash", "phys").mapInPandas(work, SCHEMA)
