"""Disk images of copy-on-write B-tree file systems as tables.

`read_items` reads the trees of an image and gives one row for each leaf item, with its raw bytes; node errors are rows
too (tolerant reading) or end the read (strict). The typed tables unpack items by their layouts; an item that does not fit
its layout keeps its row with `corrupt` set.
"""

from __future__ import annotations

import bisect
import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import crc32c_of, name_hash, uuid_text

# Fixed values of the on-disk format: superblock places, magic, item types, tree ids, extent kinds, file kinds.
SUPERBLOCKS = (0x10000, 0x4000000, 0x4000000000, 0x4000000000000)
MAGIC = b"_BHRfS_M"
ITEM_TYPES = {1: "inode", 12: "inode_ref", 84: "dir_item", 96: "dir_index", 108: "extent_data", 132: "root", 144: "root_backref", 156: "root_ref",
    168: "extent", 228: "chunk"}
TREES = {1: "root", 2: "extent", 3: "chunk", 4: "device", 5: "filesystem", 6: "directory", 7: "checksum"}
EXTENT_KINDS = {0: "inline", 1: "regular", 2: "prealloc"}
FILE_KINDS = {0: "unknown", 1: "file", 2: "directory", 3: "char_device", 4: "block_device", 5: "fifo", 6: "socket", 7: "symlink", 8: "xattr"}

SUPERBLOCK = "<32s16sQQ8sQQQQQQQQQIIIIIQQQQHBBB98s256sQQ"
SUPERBLOCK_FIELDS = (
    "csum fsid bytenr flags magic generation root chunk_root log_root log_root_transid total_bytes bytes_used root_dir num_devices sectorsize nodesize leafsize stripesize "
    "system_chunk_bytes chunk_root_generation compat compat_ro incompat csum_type root_level chunk_root_level log_root_level dev_item label cache_generation uuid_tree_generation"
).split()
SYSTEM_CHUNKS, BACKUPS, BACKUP_BYTES, SUPERBLOCK_BYTES = 0x32B, 0xB2B, 0xA8, 0x1000
HEADER = "<32s16sQQ16sQQIB"
KEY = "<QBQ"

# Layouts by item type: struct format and names.
LAYOUTS = {
    "inode": ("<QQQQQIIIIQQQ32sqIqIqIqI",
        "generation transid st_size st_blocks block_group st_nlink st_uid st_gid st_mode st_rdev flags sequence reserved atime atime_ns ctime ctime_ns mtime mtime_ns otime otime_ns".split()),
    "extent": ("<QQQ", "reference_count generation flags".split()),
    "extent_data": ("<QQBBHB", "generation logical_bytes compression encryption other_encoding kind".split()),
    "root": ("<160sQQQQQQQI17sBB",
        "inode expected_generation root_dirid block_number byte_limit bytes_used last_snapshot flags reference_count drop_progress drop_level tree_level".split()),
    "root_ref": ("<QQH", "directory_id sequence name_bytes".split()),
    "chunk": ("<QQQQIIIHH", "length owner stripe_length type io_align io_width sector_bytes stripes sub_stripes".split()),
}
# References in extent items, by kind: name, format, fields.
REFERENCES = {
    176: ("tree_block", ("<Q", ("root",))),
    178: ("extent_data", ("<QQQI", ("root", "object_id", "offset", "count"))),
    182: ("shared_block", ("<Q", ("offset",))),
    184: ("shared_data", ("<QI", ("offset", "count"))),
}
RECORD_BYTES = {"extent": 0x18, "inode": 0xA0, "root": 0x1B7, "extent_data": 0x35, "root_ref": 0x12, "root_backup": BACKUP_BYTES,
    "superblock": SUPERBLOCK_BYTES}
ITEM_SCHEMA = "image string, tree_id long, object_id long, item_type int, offset long, payload binary, corrupt string"


@dataclass
class Device:
    """One image file; reads are by place, nothing is mapped whole. An image that is in memory already is its data."""

    path: str
    data: bytes | None = None

    def at(self, place: int, size: int) -> bytes:
        if self.data is not None:
            return self.data[place : place + size]
        if place >= os.path.getsize(self.path):
            return b""
        with open(self.path, "rb") as f:
            f.seek(place)
            return f.read(size)

    def superblock(self) -> dict:
        """The candidate with the highest generation whose magic and checksum fit."""
        found = []
        for place in SUPERBLOCKS:
            raw = self.at(place, SUPERBLOCK_BYTES)
            if len(raw) == SUPERBLOCK_BYTES and raw[64:72] == MAGIC and struct.unpack_from("<I", raw)[0] == crc32c_of(raw[32:]):
                found.append(dict(zip(SUPERBLOCK_FIELDS, struct.unpack_from(SUPERBLOCK, raw), strict=True)) | {"raw": raw})
        if not found:
            raise ValueError(f"no superblock in {self.path}")
        return max(found, key=lambda s: s["generation"])


def stripes_of(payload: bytes) -> Iterator[tuple[int, int]]:
    """(device id, place) of a chunk's stripes."""
    count = struct.unpack_from(LAYOUTS["chunk"][0], payload)[7]
    head = struct.calcsize(LAYOUTS["chunk"][0])
    for k in range(count):
        yield struct.unpack_from("<QQ", payload, head + 32 * k)


class Image:
    """Devices of one file system and the map from logical to physical places (the first stripe of a chunk)."""

    def __init__(self, paths: list[str | Device]):
        self.devices: dict[int, Device] = {}
        blocks = []
        for path in paths:
            device = path if isinstance(path, Device) else Device(path)
            block = device.superblock()
            number = struct.unpack_from("<Q", block["dev_item"])[0]
            if number in self.devices:
                raise ValueError(f"device {number} occurs twice")
            self.devices[number] = device
            blocks.append(block)
        self.superblock = max(blocks, key=lambda s: s["generation"])
        self.chunks: list[tuple[int, int, int, int]] = []
        raw, at = self.superblock["raw"][SYSTEM_CHUNKS:], 0
        while at < self.superblock["system_chunk_bytes"]:
            _, _, logical = struct.unpack_from(KEY, raw, at)
            at = self._add(logical, raw, at + 17)
        for _, item_type, offset, payload, bad in self.items(self.superblock["chunk_root"], True):
            if not bad and item_type == 228:
                self._add(offset, payload, 0)

    def _add(self, logical: int, raw: bytes, at: int) -> int:
        payload = raw[at:]
        count = struct.unpack_from(LAYOUTS["chunk"][0], payload)[7]
        device, place = next(stripes_of(payload))
        entry = (logical, struct.unpack_from("<Q", payload)[0], device, place)
        where = bisect.bisect_left(self.chunks, entry)
        if self.chunks[where : where + 1] != [entry]:
            self.chunks.insert(where, entry)
        return at + struct.calcsize(LAYOUTS["chunk"][0]) + 32 * count

    def physical(self, logical: int) -> tuple[int, int] | None:
        """The chunks are sorted and do not overlap, so the last one that starts at or before a place is the only one to hold it."""
        at = bisect.bisect_right(self.chunks, (logical, 1 << 64, 1 << 64, 1 << 64)) - 1
        if at >= 0:
            start, size, device, place = self.chunks[at]
            if logical < start + size:
                return device, place + logical - start
        return None

    def node(self, place: int, physical: int | None = None) -> bytes:
        """A node's bytes by logical place, or by the physical place on the device of this number."""
        size = self.superblock["nodesize"]
        if physical is None:
            return self.slice(place, size)
        if physical not in self.devices:
            raise ValueError(f"no device {physical}")
        return self.devices[physical].at(place, size)

    def slice(self, logical: int, size: int) -> bytes:
        found = self.physical(logical)
        if found is None:
            raise ValueError(f"no chunk holds {logical}")
        return self.devices[found[0]].at(found[1], size)

    def items(self, root: int, tolerant: bool, physical: int | None = None) -> Iterator[tuple]:
        """(object_id, item_type, offset, payload, error) of a tree's leaves from left to right, without recursion.

        physical: the root's place is one on the device of this number; the nodes below are found by their logical places.
        """
        stack = [(root, physical)]
        while stack:
            place, device = stack.pop()
            try:
                raw = self.node(place, device)
                if struct.unpack_from("<I", raw)[0] != crc32c_of(raw[32:]):
                    raise ValueError(f"checksum of the node at {place}")
                count, level = struct.unpack_from(HEADER, raw)[7:9]
                if level:
                    pointers = [struct.unpack_from("<Q", raw, 101 + 33 * k + 17)[0] for k in range(count)]
                    stack += [(p, None) for p in reversed(pointers)]
                    continue
                for k in range(count):
                    *key, start, size = struct.unpack_from("<QBQII", raw, 101 + 25 * k)
                    payload = raw[101 + start : 101 + start + size]
                    yield (*key, payload, None if len(payload) == size else f"item of {size} bytes ends outside of its node")
            except (ValueError, struct.error) as bad:
                if not tolerant:
                    raise
                yield None, None, None, None, str(bad)

    def tree_places(self, tolerant: bool, backup: int | None = None) -> Iterator[tuple[int, int]]:
        """(tree id, place) of the root tree and all trees it names; backup 0-3 starts from an older root."""
        root = self.superblock["root"]
        if backup is not None:
            root = struct.unpack_from("<Q", self.superblock["raw"], BACKUPS + BACKUP_BYTES * backup)[0]
        yield 1, root
        for object_id, item_type, _, payload, bad in self.items(root, tolerant):
            if item_type == 132 and not bad and len(payload) >= 184:
                at = struct.unpack_from("<Q", payload, 176)[0]
                if at:
                    yield object_id, at

    def trees(self, tolerant: bool, backup: int | None = None) -> Iterator[tuple]:
        """(tree id, item) of all trees."""
        for tree, place in self.tree_places(tolerant, backup):
            for item in self.items(place, tolerant):
                yield tree, item


def read_items(spark: SparkSession, images: list[list[str]], tolerant: bool = True, backups: bool = False) -> DataFrame:
    """Items of all trees of each image (a list of its device paths, visible to all executors).

    The root tree of an image is read by one task, every tree it names by a task of its own. backups: if the trees of the
    current root cannot be read whole, the four older roots are tried in order.
    """
    listed = spark.createDataFrame([("\n".join(paths),) for paths in images], "paths string").repartition(max(1, len(images)))

    def trees(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for paths in frame["paths"]:
                image = Image(paths.split("\n"))
                for backup in (None, *(range(4) if backups else ())):
                    try:
                        if backups:  # a root counts as readable only if all its trees are
                            for _ in image.trees(False, backup):
                                pass
                        made = [(paths, tree, place) for tree, place in image.tree_places(tolerant and not backups, backup)]
                        yield pd.DataFrame(made, columns=["paths", "tree", "place"]).astype({"tree": "string", "place": "string"})
                        break
                    except ValueError:
                        if not backups or backup == 3:
                            raise

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ITEM_SCHEMA.split(", ")]
        image, opened = None, None
        for frame in frames:
            for paths, tree, place in frame.itertuples(index=False):
                if paths != opened:
                    image, opened = Image(paths.split("\n")), paths
                held = []
                for item in image.items(int(place), tolerant and not backups):
                    held.append((paths.split("\n")[0], int(tree), *item))
                    if len(held) == 4096:
                        yield _signed(pd.DataFrame(held, columns=names))
                        held = []
                yield _signed(pd.DataFrame(held, columns=names))

    # unsigned places go as text
    found = listed.mapInPandas(trees, "paths string, tree string, place string")
    return found.repartition(max(8, 4 * len(images)), "paths", "tree").mapInPandas(rows, ITEM_SCHEMA)


def read_image_bytes(images: DataFrame, tolerant: bool = True) -> DataFrame:
    """Items of images (image, content) of one device each that come as bytes, as Spark's binaryFile source gives them."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ITEM_SCHEMA.split(", ")]
        for frame in frames:
            for name, content in zip(frame["image"], frame["content"], strict=True):
                held = [(name, tree, *item) for tree, item in Image([Device(name, bytes(content))]).trees(tolerant)]
                for low in range(0, len(held), 4096):
                    yield _signed(pd.DataFrame(held[low : low + 4096], columns=names))

    return images.select("image", "content").mapInPandas(rows, ITEM_SCHEMA)


def superblocks(spark: SparkSession, images: list[list[str]]) -> DataFrame:
    """One row for each device: path and all fields of its superblock, the label as text, the device's own number."""
    kinds = {f: "binary" if f in ("csum", "fsid", "magic", "dev_item") else "string" if f == "label" else "long" for f in SUPERBLOCK_FIELDS}

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for path in frame["path"]:
                block = Device(path).superblock()
                values = [block[f].split(b"\0")[0].decode("utf-8", "replace") if f == "label" else block[f] if isinstance(block[f], bytes)
                    else _long(block[f]) for f in SUPERBLOCK_FIELDS]
                number, total, used = struct.unpack_from("<QQQ", block["dev_item"])
                made.append((path, *values, _long(number), _long(total), _long(used)))
            yield pd.DataFrame(made, columns=["path", *kinds, "device", "device_bytes", "device_used"])

    schema = "path string, " + ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", device long, device_bytes long, device_used long"
    listed = spark.createDataFrame([(p,) for paths in images for p in paths], "path string")
    return listed.mapInPandas(rows, schema).withColumn("fsid", uuid_text(F.col("fsid")))


def _long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _signed(frame: pd.DataFrame) -> pd.DataFrame:
    """Unsigned keys as longs of the same bits."""
    for c in ("tree_id", "object_id", "offset"):
        frame[c] = frame[c].map(lambda x: None if pd.isna(x) else int(x) - (1 << 64) if int(x) >= 1 << 63 else int(x)).astype("Int64")
    frame["item_type"] = frame["item_type"].astype("Int32")
    return frame


def by_key(items: DataFrame, object_id: int, item_type: int, offset: int) -> DataFrame:
    return items.where((F.col("object_id") == object_id) & (F.col("item_type") == item_type) & (F.col("offset") == offset))


def by_object(items: DataFrame, object_id: int) -> DataFrame:
    return items.where(F.col("object_id") == object_id)


def by_type(items: DataFrame, name: str, object_id: int | None = None) -> DataFrame:
    """Items of one kind, of one object if it is given."""
    code = next(k for k, v in ITEM_TYPES.items() if v == name)
    found = items.where(F.col("item_type") == code)
    return found if object_id is None else found.where(F.col("object_id") == object_id)


def _unpack(items: DataFrame, name: str, more: dict[str, str] | None = None, extra=None, layout: str | None = None) -> DataFrame:
    """Items of one kind by a layout (their own unless another is named), with columns that `extra` tells from (payload, size)."""
    layout, fields = LAYOUTS[layout or name]
    kinds = {f: "binary" if f in ("reserved", "inode", "drop_progress") else "long" for f in fields} | (more or {})
    size = struct.calcsize(layout)

    def one(payload: bytes) -> list:
        values = [v if isinstance(v, bytes) else v - (1 << 64) if v >= 1 << 63 else v for v in struct.unpack_from(layout, payload)]
        return [*values, *(extra(payload, size) if extra else ())]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made, bad = [], []
            for payload in frame["payload"]:
                try:
                    made.append(one(bytes(payload)))
                    bad.append(None)
                except (struct.error, IndexError) as why:
                    made.append([None] * len(kinds))
                    bad.append(str(why))
            out = pd.DataFrame(made, columns=list(kinds), dtype=object)
            yield pd.concat([frame[["image", "tree_id", "object_id", "offset"]].reset_index(drop=True), out,
                pd.Series(bad, name="corrupt", dtype=object)], axis=1)

    schema = "image string, tree_id long, object_id long, offset long, " + ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", corrupt string"
    return by_type(items, name).mapInPandas(rows, schema)


def inodes(items: DataFrame) -> DataFrame:
    return _unpack(items, "inode").drop("reserved")


def roots(items: DataFrame) -> DataFrame:
    """Root items with the fields of the inode they embed."""
    layout, fields = LAYOUTS["inode"]
    more = {f"inode_{f}": "long" for f in fields if f != "reserved"}

    def inode(payload: bytes, _: int) -> list:
        return [_long(v) for f, v in zip(fields, struct.unpack_from(layout, payload), strict=True) if f != "reserved"]

    return _unpack(items, "root", more, inode).drop("inode")


def extents(items: DataFrame) -> DataFrame:
    """Extent data with its place (null if inline) or its inline bytes; inline bytes of encoded extents are null."""

    def place(payload: bytes, size: int) -> list:
        kind, plain = payload[20], not (payload[17] or payload[18] or payload[19])
        if kind == 0:
            return [None, None, None, None, payload[size:] if plain else None]
        return [*struct.unpack_from("<QQQQ", payload, size), None]

    out = _unpack(items, "extent_data", {"address": "long", "extent_bytes": "long", "data_offset": "long", "data_bytes": "long", "inline": "binary"}, place)
    named: Column = F.lit("unknown")
    for code, name in EXTENT_KINDS.items():
        named = F.when(F.col("kind") == code, name).otherwise(named)
    return out.withColumn("kind", named)


def extent_items(items: DataFrame) -> DataFrame:
    """Extent items with their flags, the key and level of a tree block, and the references that stand in the item itself.

    references: (kind, root, object_id, offset, count); a shared reference has its parent's place in `offset`.
    """
    more = {"block_object_id": "long", "block_item_type": "long", "block_offset": "long", "block_level": "long",
        "references": "array<struct<kind:string,root:long,object_id:long,offset:long,count:long>>"}

    def extra(payload: bytes, at: int) -> list:
        flags, block = struct.unpack_from("<Q", payload, 16)[0], [None] * 4
        if flags & 2:
            *key, level = struct.unpack_from("<QBQB", payload, at)
            block, at = [_long(key[0]), key[1], _long(key[2]), level], at + 18
        found = []
        while at < len(payload):
            kind, at = payload[at], at + 1
            if kind not in REFERENCES:
                raise struct.error(f"reference of kind {kind}")
            name, layout = REFERENCES[kind]
            values = dict(zip(layout[1], map(_long, struct.unpack_from(layout[0], payload, at)), strict=True))
            found.append({"kind": name} | {k: values.get(k) for k in ("root", "object_id", "offset", "count")})
            at += struct.calcsize(layout[0])
        return [*block, found]

    flags = F.col("flags")
    return _unpack(items, "extent", more, extra).withColumns({"is_data": flags.bitwiseAND(F.lit(1).cast("long")) != 0,
        "is_tree_block": flags.bitwiseAND(F.lit(2).cast("long")) != 0, "is_full_backref": flags.bitwiseAND(F.lit(256).cast("long")) != 0})


def chunks(items: DataFrame) -> DataFrame:
    return _unpack(items, "chunk", {"places": "array<struct<device:long,place:long>>"}, lambda payload,
        _: [[{"device": d, "place": p} for d, p in stripes_of(payload)]])


def _name_after(payload: bytes, size: int, length: int) -> str:
    if len(payload) != size + length:
        raise struct.error(f"a name of {length} bytes in {len(payload) - size}")
    return payload[size:].decode("utf-8", "replace")


def root_refs(items: DataFrame, kind: str = "root_ref") -> DataFrame:
    """References of subvolumes to their directories, by name (root_ref), or back to them (root_backref)."""
    return _unpack(items, kind, {"name": "string"}, lambda payload, size: [_name_after(payload, size, struct.unpack_from("<H", payload, 16)[0])],
        layout="root_ref")


def _entries(items: DataFrame, name: str, head: str, length: Callable[[tuple], int], columns: str, made: Callable[[tuple, bytes], tuple]) -> DataFrame:
    """Rows of items that hold one entry after another; what does not fit its layout is a row with `corrupt` set."""
    size, names = struct.calcsize(head), [c.split()[0] for c in columns.split(", ")]
    fixed = ["image", "tree_id", "object_id", "offset"]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                payload, at, key = bytes(r.payload), 0, (r.image, r.tree_id, r.object_id, r.offset)
                while at < len(payload):
                    whole = at + size <= len(payload)
                    values = struct.unpack_from(head, payload, at) if whole else ()
                    end = at + size + length(values) if whole else len(payload) + 1
                    if end > len(payload):
                        out.append((*key, *[None] * len(names), f"entry at {at} ends outside of the item's {len(payload)} bytes"))
                        break
                    out.append((*key, *made(values, payload[at + size : end]), None))
                    at = end
            yield pd.DataFrame(out, columns=[*fixed, *names, "corrupt"], dtype=object)

    return by_type(items, name).mapInPandas(rows, f"image string, tree_id long, object_id long, offset long, {columns}, corrupt string")


def dir_entries(items: DataFrame, kind: str = "dir_index") -> DataFrame:
    """Entries of directories: items of one kind hold one or more each."""

    def made(v: tuple, rest: bytes) -> tuple:
        return _long(v[0]), v[1], _long(v[3]), rest[: v[5]].decode("utf-8", "replace"), FILE_KINDS.get(v[6], "unknown"), v[4]

    return _entries(items, kind, "<QBQQHHB", lambda v: v[4] + v[5],
        "child long, child_type int, transid long, name string, file_kind string, data_bytes long", made)


def entry_by_name(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entries of directories (tree_id, object_id, name of wanted): found by the hash of the name, which is the key's offset.

    Names that share a hash stand in one item, so the name is compared, too.
    """
    asked = wanted.select("tree_id", "object_id", name_hash(F.col("name").cast("binary")).alias("offset"), F.col("name").alias("asked"))
    found = dir_entries(items.join(asked.select("tree_id", "object_id", "offset").distinct(), ["tree_id", "object_id", "offset"], "left_semi"), "dir_item")
    return asked.join(found, ["tree_id", "object_id", "offset"]).where("name = asked").drop("asked")


def inode_refs(items: DataFrame) -> DataFrame:
    """Names of inodes in their parents; the parent is the key's offset."""
    found = _entries(items, "inode_ref", "<QH", lambda v: v[1], "index long, name string", lambda v, rest: (_long(v[0]), rest.decode("utf-8", "replace")))
    return found.withColumnRenamed("offset", "parent")


def subvolumes(items: DataFrame) -> DataFrame:
    """Root items of subvolumes: the first file tree and ids from 128 up or -128 down."""
    return roots(items).where("tree_id = 1 and (object_id >= 128 or object_id <= -128 or object_id = 5)")


def default_subvolume(items: DataFrame) -> DataFrame:
    """image, object_id of the subvolume that is mounted by default: the entry "default" of the root tree's directory, else 5."""
    named = dir_entries(items, "dir_item").where("tree_id = 1 and name = 'default'").groupBy("image").agg(F.max("child").alias("child"))
    return items.select("image").distinct().join(named, "image", "left").select("image", F.coalesce("child", F.lit(5).cast("long")).alias("object_id"))
