"""Members of archives as entries that are hashed while they are read.

Formats are told by their first bytes: zip, tar (plain or gzip, bzip2, xz), cpio (new ASCII and old octal headers), ar, and
a single compressed file as an archive of one member "data". Others (7z, cab, iso9660, ...) have no decoder here and give a
failure row.
"""

from __future__ import annotations

import bz2
import calendar
import gzip
import hashlib
import io
import lzma
import stat
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import depth_of, is_archive_name, name_of, parent_path

MOST_ERRORS = 16
FIELDS = "archive_path string, member string, file_size long, file_hash string, mode int, mtime long, atime long, ctime long, nlink int, uname string, link string, failure int"

# First bytes of formats.
COMPRESSED = {b"\x1f\x8b": gzip.open, b"BZh": bz2.open, b"\xfd7zXZ\0": lzma.open}
CPIO = {b"070701": 16, b"070702": 16, b"070707": 8}
AR = b"!<arch>\n"


@dataclass
class Member:
    """A member with what its format tells; open gives its bytes and may be called until the next member is asked for."""

    name: str
    open: Callable[[], io.BufferedIOBase]
    mode: int | None = None
    mtime: int | None = None
    atime: int | None = None
    ctime: int | None = None
    nlink: int | None = None
    uname: str | None = None
    link: str | None = None
    regular: bool = True


class _Part(io.RawIOBase):
    """The next `size` bytes of a stream."""

    def __init__(self, stream: io.BufferedIOBase, size: int):
        self.stream, self.left = stream, size

    def readable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        wanted = self.left if size < 0 else min(size, self.left)
        piece = self.stream.read(wanted) if wanted else b""
        if wanted and not piece:
            raise EOFError("the archive ends within a member")
        self.left -= len(piece)
        return piece

    def skip(self, padding: int = 0) -> None:
        while self.left:
            self.read(1 << 20)
        self.stream.read(padding)


def _exactly(stream: io.BufferedIOBase, size: int) -> bytes:
    found = stream.read(size)
    if len(found) != size:
        raise EOFError("the archive ends within a header")
    return found


def _zip(source: str | io.BytesIO) -> Iterator[Member]:
    with zipfile.ZipFile(source) as archive:
        for info in archive.infolist():
            kind = info.external_attr >> 28
            regular = not info.is_dir() and kind not in (0xA, 0x4)
            yield Member(info.filename, lambda info=info: archive.open(info), mode=info.external_attr >> 16,
                mtime=calendar.timegm((*info.date_time, 0, 0, 0)), regular=regular)


def _tar(source: str | io.BytesIO) -> Iterator[Member]:
    with tarfile.open(fileobj=source) if isinstance(source, io.BytesIO) else tarfile.open(source, "r:*") as archive:
        for info in archive:
            extra = {k: int(float(info.pax_headers[k])) for k in ("atime", "ctime") if k in info.pax_headers}
            yield Member(info.name, lambda info=info: archive.extractfile(info), mode=info.mode, mtime=int(info.mtime), uname=info.uname or None,
                link=info.linkname or None, regular=info.isreg(), **extra)


def _cpio(stream: io.BufferedIOBase) -> Iterator[Member]:
    while True:
        magic = _exactly(stream, 6)
        if magic not in CPIO:
            raise ValueError("no cpio header")
        if CPIO[magic] == 16:
            head = _exactly(stream, 104)
            _, mode, _, _, nlink, mtime, size, *_, name_size, _ = (int(head[k : k + 8], 16) for k in range(0, 104, 8))
            name = _exactly(stream, name_size)[:-1].decode("utf-8", "replace")
            _exactly(stream, -(110 + name_size) % 4)
            padding = -size % 4
        else:
            head, padding = _exactly(stream, 70), 0
            mode, nlink = int(head[12:18], 8), int(head[30:36], 8)
            mtime, name_size, size = int(head[42:53], 8), int(head[53:59], 8), int(head[59:70], 8)
            name = _exactly(stream, name_size)[:-1].decode("utf-8", "replace")
        if name == "TRAILER!!!":
            return
        part = _Part(stream, size)
        yield Member(name, lambda part=part: part, mode=mode, mtime=mtime, nlink=nlink, regular=stat.S_ISREG(mode))
        part.skip(padding)


def _ar(stream: io.BufferedIOBase) -> Iterator[Member]:
    _exactly(stream, len(AR))
    names = b""
    while head := stream.read(60):
        if len(head) != 60 or head[58:] != b"`\n":
            raise ValueError("no ar header")
        name, mtime, mode, size = head[:16].rstrip(), head[16:28].strip(), head[40:48].strip(), int(head[48:58])
        padding = size % 2
        if name == b"//":
            names = _exactly(stream, size)
            stream.read(padding)
            continue
        part = _Part(stream, size)
        if name.startswith(b"#1/"):
            name = part.read(int(name[3:])).rstrip(b"\0")
        elif name[:1] == b"/" and name[1:].isdigit():
            name = names[int(name[1:]) :].split(b"/\n")[0]
        elif name not in (b"/", b"/SYM64/"):
            name = name.rstrip(b"/")
        symbols = name in (b"/", b"/SYM64/", b"__.SYMDEF")
        yield Member(name.decode("utf-8", "replace"), lambda part=part: part, mode=int(mode or b"0", 8), mtime=int(mtime or b"0"), regular=not symbols)
        part.skip(padding)


def _streamed(stream: io.BufferedReader) -> Iterator[Member] | None:
    """Members of a plain or decompressed stream: cpio or ar; None for others."""
    first = stream.peek(8)
    if first[:6] in CPIO:
        return _cpio(stream)
    return _ar(stream) if first.startswith(AR) else None


def _is_tar(source: str | io.BytesIO) -> bool:
    try:
        return tarfile.is_tarfile(source)
    except (OSError, EOFError, lzma.LZMAError):
        return False
    finally:
        if isinstance(source, io.BytesIO):
            source.seek(0)


def open_members(source: str | bytes) -> Iterator[Member]:
    """All members of an archive of any format known here: a path, or the archive's bytes."""
    if isinstance(source, bytes):
        first, place = source[:8], io.BytesIO(source)
    else:
        place = source
        with open(source, "rb") as f:
            first = f.read(8)
    if first.startswith(b"PK"):
        yield from _zip(place)
        return
    if _is_tar(place):
        yield from _tar(place)
        return
    opened = next((o for magic, o in COMPRESSED.items() if first.startswith(magic)), None)
    if opened:
        stream = io.BufferedReader(opened(place, "rb"))
    else:
        stream = io.BufferedReader(place) if isinstance(place, io.BytesIO) else open(place, "rb")
    with stream:
        found = _streamed(stream)
        if found is not None:
            yield from found
        elif opened:
            yield Member("data", lambda: stream)
        else:
            raise ValueError("no decoder for this format")


def members_of(source: str | bytes, buffer: int = 1 << 20) -> Iterator[tuple]:
    """(member, size read, hash, mode, mtime, atime, ctime, nlink, uname, link, failure) of every regular member.

    A row without a member tells that the archive could not be read or that 16 errors came in a row.
    """
    errors, failed = 0, (None,) * 10 + (1,)
    try:
        for m in open_members(source):
            if not m.regular:
                continue
            try:
                size, found, f = 0, hashlib.sha256(), m.open()
                while piece := f.read(buffer):
                    size += len(piece)
                    found.update(piece)
            except Exception:  # a broken member: the next ones may be whole
                errors += 1
                if errors >= MOST_ERRORS:
                    yield failed
                    return
                continue
            errors = 0
            yield m.name, size, found.hexdigest(), m.mode, m.mtime, m.atime, m.ctime, m.nlink, m.uname, m.link, 0
    except Exception:  # no decoder, or no archive at all
        yield failed


def _members(rows: Iterator[tuple[str, str | bytes]]) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in FIELDS.split(", ")]
    for path, source in rows:
        held = []
        for found in members_of(source):
            held.append((path, *found))
            if len(held) == 1024:
                yield pd.DataFrame(held, columns=names, dtype=object)
                held = []
        if held:
            yield pd.DataFrame(held, columns=names, dtype=object)


def read_archives(entries: DataFrame) -> DataFrame:
    """All members of the archives among entries, with their metadata and failures; one archive is one task's stream."""
    paths = entries.where(is_archive_name(F.col("path"))).select("path")
    return paths.mapInPandas(lambda frames: _members((p, p) for frame in frames for p in frame["path"]), FIELDS)


def read_archive_bytes(archives: DataFrame) -> DataFrame:
    """The same of archives (path, content) that come as bytes, as Spark's binaryFile source gives them."""
    return archives.select("path", "content").mapInPandas(lambda frames: _members((p, bytes(c)) for frame in frames for p,
        c in zip(frame["path"], frame["content"], strict=True)), FIELDS)


def member_entries(found: DataFrame) -> DataFrame:
    """Members as entries: the path is the archive's joined to the member's; they have no place on disk."""
    path = F.col("path")
    joined = found.where("member is not null").withColumn("path", F.concat_ws("/", "archive_path",
        F.regexp_replace("member", r"^(\./|/)+", ""))).dropDuplicates(["path"])
    return joined.select("path", parent_path(path).alias("parent_path"), name_of(path).alias("name"), depth_of(path).alias("depth"),
        F.lit(True).alias("is_file"), F.lit(False).alias("is_dir"), "file_size", F.lit(None).cast("long").alias("ctime"),
        F.lit(None).cast("long").alias("phys"), F.lit(None).cast("int").alias("n_extents"), "file_hash", F.lit(True).alias("in_archive"),
        "archive_path")


def failures(found: DataFrame) -> DataFrame:
    """archive_path, failure of the archives that could not be read to the end."""
    return found.groupBy("archive_path").agg(F.max("failure").alias("failure")).where("failure > 0")
