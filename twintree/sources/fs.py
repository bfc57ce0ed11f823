"""File systems as a data source, and file contents by hash."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import stat
import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import depth_of, name_of, parent_path

SCHEMA = "path string, file_size long, ctime long, phys long, n_extents int"
EXTENT_SCHEMA = "path string, logical long, physical long, length long, flags int"

# Fixed values of the kernel's extent map call: request, header, one extent, and flags.
FIEMAP = 0xC020660B
FIEMAP_HEAD, FIEMAP_EXTENT = "=QQIIII", "=QQQQQIIII"
FIEMAP_SYNC, EXTENT_LAST, EXTENT_UNKNOWN = 0x1, 0x1, 0x2
#: Extents asked for at a time.
EXTENTS_AT_ONCE = 128


def extents_of(path: str) -> list[tuple[int, int, int, int]] | None:
    """(logical, physical, length, flags) of a file's extents; None where the file system does not tell them."""
    found: list[tuple[int, int, int, int]] = []
    head, one = struct.calcsize(FIEMAP_HEAD), struct.calcsize(FIEMAP_EXTENT)
    try:
        with open(path, "rb") as f:
            start = 0
            while True:
                asked = bytearray(struct.pack(FIEMAP_HEAD, start, 2**64 - 1 - start, FIEMAP_SYNC, 0, EXTENTS_AT_ONCE, 0) + bytes(one * EXTENTS_AT_ONCE))
                fcntl.ioctl(f.fileno(), FIEMAP, asked)
                mapped = struct.unpack_from(FIEMAP_HEAD, asked)[3]
                for k in range(mapped):
                    logical, physical, length, _, _, flags, *_ = struct.unpack_from(FIEMAP_EXTENT, asked, head + one * k)
                    found.append((logical, physical, length, flags))
                if not mapped or found[-1][3] & EXTENT_LAST:
                    return found
                start = found[-1][0] + found[-1][2]
    except OSError:
        return None


class Subtree(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class FileTree(DataSource):
    """spark.read.format("twintree").option("paths", '["/a", "/b"]'): regular files with sizes and change times in seconds.

    paths is a JSON list. One partition for each directory below a root. Symbolic links and names that are no UTF-8 are
    passed over, so directories without files do not show. With the option extents (true) every file's first physical
    place and number of extents are asked for; else, and where the file system does not tell, they are 0: unknown.
    """

    @classmethod
    def name(cls) -> str:
        return "twintree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "FileTreeReader":
        return FileTreeReader(json.loads(self.options.get("paths", "[]")), self.options.get("extents", "false").lower() == "true")


class FileTreeReader(DataSourceReader):
    def __init__(self, paths: Sequence[str], extents: bool = False):
        self.paths, self.extents = paths, extents

    def partitions(self) -> list[Subtree]:
        found: list[Subtree] = []
        for root in self.paths:
            found.append(Subtree(root, deep=False))
            if os.path.isdir(root):
                found += [Subtree(e.path, deep=True) for e in os.scandir(root) if e.is_dir(follow_symlinks=False)]
        return found or [Subtree("", deep=False)]

    def read(self, part: Subtree) -> Iterator[tuple]:
        if not part.path:
            return
        if os.path.isfile(part.path):
            yield from self._row(part.path)
            return
        for top, dirs, names in os.walk(part.path, followlinks=False):
            for name in sorted(names):
                yield from self._row(os.path.join(top, name))
            if not part.deep:
                dirs.clear()

    def _row(self, path: str) -> Iterator[tuple]:
        try:
            path.encode("utf-8")
            seen = os.lstat(path)
        except (OSError, UnicodeEncodeError):
            return
        if stat.S_ISREG(seen.st_mode):
            known = [e for e in (extents_of(path) if self.extents else None) or [] if not e[3] & EXTENT_UNKNOWN]
            yield path, seen.st_size, int(seen.st_ctime), known[0][1] if known else 0, len(known)


def extents(entries: DataFrame) -> DataFrame:
    """path, logical, physical, length, flags: all extents of the entries' files, as the file system tells them."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(p, *e) for p in frame["path"] for e in extents_of(p) or ()], columns=["path", "logical", "physical", "length", "flags"])

    return entries.where("is_file").select("path").mapInPandas(rows, EXTENT_SCHEMA)


def with_extents(entries: DataFrame, found: DataFrame) -> DataFrame:
    """entries with phys and n_extents from a table of extents (path, logical, physical), wherever that comes from."""
    first = found.groupBy("path").agg(F.min_by("physical", "logical").alias("__phys"), F.count("*").cast("int").alias("__n"))
    joined = entries.join(first, "path", "left")
    return joined.withColumns({"phys": F.coalesce("__phys", F.lit(0).cast("long")), "n_extents": F.coalesce("__n", F.lit(0))}).select(*entries.columns)


def scan(spark: SparkSession, paths: Sequence[str], extents: bool = False) -> DataFrame:
    """Entries of real paths; the folders must be visible to all executors."""
    spark.dataSource.register(FileTree)
    real = list(dict.fromkeys(os.path.realpath(p) for p in paths))
    rows = spark.read.format("twintree").option("paths", json.dumps(real)).option("extents", str(extents)).load().dropDuplicates(["path"])
    path = F.col("path")
    return rows.select("path", parent_path(path).alias("parent_path"), name_of(path).alias("name"), depth_of(path).alias("depth"),
        F.lit(True).alias("is_file"), F.lit(False).alias("is_dir"), "file_size", "ctime", "phys", "n_extents")


def hash_files(candidates: DataFrame, buffer: int = 1 << 20) -> DataFrame:
    """candidates with file_hash: candidates without one are read in pieces; a file that changed since the scan stays unhashed."""
    known = candidates if "file_hash" in candidates.columns else candidates.withColumn("file_hash", F.lit(None).cast("string"))

    def digest(path: str, size: int, ctime: int) -> str | None:
        try:
            with open(path, "rb", buffering=0) as f:
                seen = os.fstat(f.fileno())
                if seen.st_size != size or int(seen.st_ctime) != ctime:
                    return None
                found = hashlib.sha256()
                while piece := f.read(buffer):
                    found.update(piece)
                return found.hexdigest()
        except OSError:
            return None

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["file_hash"] = [h if h is not None or not wanted else digest(p, s, c) for h, wanted, p, s,
                c in zip(frame["file_hash"], frame["candidate"], frame["path"], frame["file_size"], frame["ctime"], strict=True)]
            yield frame

    return known.mapInPandas(hashed, known.schema).drop("candidate")
