"""What the operators of this subpackage share: reading tables, shared scratch tables, small numeric helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 2_000
#: Removes the shuffle files of a plan that has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, else one made for local runs.

    On a cluster a folder of this machine alone would lose rows, so a session without the setting is refused there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.match(r"local(\[[^-]*\])?$", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="twintree-"))
    return context.getCheckpointDir().rstrip("/")


class Scratch:
    """Intermediate tables in the shared folder: they cut the lineage and outlive lost executors."""

    _all: list["Scratch"] = []

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
        self._made = 0
        self._held: set[str] = set()
        Scratch._all.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """df, computed once. Rows go to Python workers in batches of at most BATCH_ROWS meanwhile, since texts are long.

        Shuffle files go when the table is written; else they stay until the driver happens to collect its garbage.
        """
        self._made += 1
        path = f"{self.root}/{self._made}-{name}"
        conf, key = self.spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        before, cleaned = conf.get(key), conf.get(CLEANUP)
        conf.set(key, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
        conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(key, before)
            conf.set(CLEANUP, cleaned)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        self._held.add(path)
        return kept

    def drop(self, *saved: DataFrame) -> None:
        """Removes saved tables that no later plan reads."""
        for one in saved:
            self._delete(one._scratch_path)
            self._held.discard(one._scratch_path)

    def keep_only(self, *saved: DataFrame) -> None:
        """Removes all saved tables but these."""
        for path in self._held - {one._scratch_path for one in saved}:
            self._delete(path)
        self._held = {one._scratch_path for one in saved}

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def _forget_all() -> None:
    for scratch in Scratch._all:
        try:
            if scratch.spark.sparkContext._jsc is not None:
                scratch._delete(scratch.root)
        except Exception:  # the JVM is already gone; the cluster's own retention cleans the folder
            return


atexit.register(_forget_all)


def give_back() -> None:
    """Hands free memory back to the system: Python workers live on after a task, beside those of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow or mapInPandas that gives its memory back when its task ends."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_CODEC = pa.Codec("zstd", 6)


def pack_bytes(raw: bytes) -> bytes:
    return len(raw).to_bytes(4, "little") + _CODEC.compress(raw, asbytes=True)


def unpack_bytes(packed: bytes) -> bytes:
    return _CODEC.decompress(packed[4:], int.from_bytes(packed[:4], "little"), asbytes=True)


def pack_ints(values: np.ndarray) -> bytes:
    """Non-negative integers below 2**32 as compressed bytes; lowest bytes first, so that small numbers pack well."""
    return pack_bytes(np.ascontiguousarray(values, dtype="<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_ints(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(unpack_bytes(packed), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
