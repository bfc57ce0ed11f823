"""Small disk images in memory, from items of trees: what tables are turned into to be read back as an image."""

from __future__ import annotations

import struct
from collections.abc import Sequence

from ..functions.scalars import crc32c_of
from . import imagefs as I

Item = tuple[int, int, int, bytes]

#: Nodes stand at the same logical and physical places, after the first superblock.
START = 0x100000
KIND_CODES = {name: code for code, name in I.FILE_KINDS.items()}
TYPE_CODES = {name: code for code, name in I.ITEM_TYPES.items()}


def inode(size: int, mtime: int, mode: int = 0o100644) -> bytes:
    times = [mtime, 0] * 4
    return struct.pack(I.LAYOUTS["inode"][0], 1, 1, size, size, 0, 1, 0, 0, mode, 0, 0, 0, b"", *times)


def entry(child: int, name: str, kind: str = "file") -> bytes:
    raw = name.encode()
    return struct.pack("<QBQQHHB", child, TYPE_CODES["inode"], 0, 1, 0, len(raw), KIND_CODES[kind]) + raw


def name_offset(name: str) -> int:
    """The key's offset of a directory's entry by name."""
    return crc32c_of(name.encode(), 0xFFFFFFFE, 0)


def inline_extent(data: bytes) -> bytes:
    return struct.pack("<QQBBHB", 1, len(data), 0, 0, 0, 0) + data


def regular_extent(address: int, size: int) -> bytes:
    return struct.pack("<QQBBHB", 1, size, 0, 0, 0, 1) + struct.pack("<QQQQ", address, size, 0, size)


def chunk(length: int, place: int, device: int = 1) -> bytes:
    return struct.pack(I.LAYOUTS["chunk"][0], length, 2, 65536, 1, 4096, 4096, 4096, 1, 0) + struct.pack("<QQ16s", device, place, b"")


def root_item(place: int) -> bytes:
    made = struct.pack(I.LAYOUTS["root"][0], inode(0, 0, 0o40755), 1, 256, place, 0, 0, 0, 0, 1, b"", 0, 0)
    return made.ljust(I.RECORD_BYTES["root"], b"\0")


def _sealed(raw: bytes) -> bytes:
    return struct.pack("<I", crc32c_of(raw[32:])) + raw[4:]


class _Nodes:
    """Nodes that are laid down one after the other."""

    def __init__(self, size: int):
        self.size, self.made = size, []

    def place(self) -> int:
        return START + len(self.made) * self.size

    def _add(self, owner: int, level: int, count: int, body: bytes) -> int:
        place = self.place()
        head = struct.pack(I.HEADER, b"", b"", place, 0, b"", 1, owner, count, level)
        self.made.append(_sealed((head + body).ljust(self.size, b"\0")))
        return place

    def leaf(self, items: Sequence[Item], owner: int) -> int:
        heads, bodies, at = b"", [], self.size - 101
        for object_id, item_type, offset, payload in items:
            at -= len(payload)
            heads += struct.pack("<QBQII", object_id, item_type, offset, at, len(payload))
            bodies.append(payload)
        gap = self.size - 101 - len(heads) - sum(map(len, bodies))
        return self._add(owner, 0, len(items), heads + b"\0" * gap + b"".join(reversed(bodies)))

    def tree(self, items: Sequence[Item], owner: int) -> int:
        """The place of the root over sorted items."""
        level, row, held, used = 0, [], [], 0
        for item in sorted(items, key=lambda x: x[:3]):
            need = 25 + len(item[3])
            if held and used + need > self.size - 101:
                row.append((held[0][:3], self.leaf(held, owner)))
                held, used = [], 0
            held.append(item)
            used += need
        row.append((held[0][:3] if held else (0, 0, 0), self.leaf(held, owner)))
        width = (self.size - 101) // 33
        while len(row) > 1:
            level += 1
            parts = [row[k : k + width] for k in range(0, len(row), width)]
            row = [(part[0][0], self._add(owner, level, len(part), b"".join(struct.pack("<QBQQQ", *key, place, 1) for key, place in part))) for part in parts]
        return row[0][1]


def image_of(trees: dict[int, Sequence[Item]], label: str = "", nodesize: int = 16384) -> bytes:
    """An image whose root tree names the given trees (id to items); one chunk holds all nodes."""
    nodes = _Nodes(nodesize)
    roots = [(tree, TYPE_CODES["root"], 0, root_item(nodes.tree(items, tree))) for tree, items in trees.items()]
    root = nodes.tree(roots, 1)
    length = (len(nodes.made) + 1) * nodesize
    whole = chunk(length, START)
    chunk_root = nodes.tree([(256, TYPE_CODES["chunk"], START, whole)], 3)
    system = struct.pack(I.KEY, 256, TYPE_CODES["chunk"], START) + whole
    device = struct.pack("<QQQ", 1, START + length, length).ljust(98, b"\0")
    block = struct.pack(I.SUPERBLOCK, b"", b"", I.SUPERBLOCKS[0], 0, I.MAGIC, 1, root, chunk_root, 0, 0, START + length, length, 6, 1, 4096, nodesize,
        nodesize, 4096, len(system), 1, 0, 0, 0, 0, 0, 0, 0, device, label.encode(), 0, 0)
    block = _sealed(block.ljust(I.SYSTEM_CHUNKS, b"\0")[: I.SYSTEM_CHUNKS] + system.ljust(I.SUPERBLOCK_BYTES - I.SYSTEM_CHUNKS, b"\0"))
    return (b"\0" * I.SUPERBLOCKS[0] + block).ljust(START, b"\0") + b"".join(nodes.made)
