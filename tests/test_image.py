"""A synthetic image: layouts by size, tree reading, mapping and decoding."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from twintree.functions.scalars import crc32c_many, crc32c_of
from twintree.sources import imagefs as I
from twintree.streaming.incremental import current_duplicates, latest, refresh_cache

NODE, LOGICAL, PHYSICAL = 4096, 0x100000, 0x30000
I_HASH = crc32c_of(b"one", 0xFFFFFFFE, 0)


def sealed(raw: bytes) -> bytes:
    return struct.pack("<I", crc32c_of(raw[32:])) + raw[4:]


def leaf(items: list[tuple[int, int, int, bytes]], place: int, owner: int) -> bytes:
    body, heads, at = b"", b"", NODE - 101
    for object_id, item_type, offset, payload in items:
        at -= len(payload)
        heads += struct.pack("<QBQII", object_id, item_type, offset, at, len(payload))
        body = payload + body
    head = struct.pack(I.HEADER, b"", b"", place, 0, b"", 1, owner, len(items), 0)
    return sealed(head + heads + b"\0" * (NODE - 101 - len(heads) - len(body)) + body)


def inner(places: list[int], place: int, owner: int) -> bytes:
    head = struct.pack(I.HEADER, b"", b"", place, 0, b"", 1, owner, len(places), 1)
    body = b"".join(struct.pack("<QBQQQ", k, 1, 0, p, 1) for k, p in enumerate(places))
    return sealed((head + body).ljust(NODE, b"\0"))


def chunk(length: int, place: int) -> bytes:
    return struct.pack(I.LAYOUTS["chunk"][0], length, 2, 65536, 2, 4096, 4096, 4096, 1, 0) + struct.pack("<QQ16s", 1, place, b"")


@pytest.fixture
def image(tmp_path):
    dir_entry = struct.pack("<QBQQHHB", 257, 1, 0, 9, 0, 3, 1) + b"one"
    second = struct.pack("<QBQQHHB", 258, 1, 0, 9, 0, 4, 2) + "zwö".encode()
    inode = struct.pack(I.LAYOUTS["inode"][0], 9, 9, 5, 4096, 0, 1, 0, 0, 0o100644, 0, 0, 0, b"", *([7, 8] * 4))
    inline = struct.pack("<QQBBHB", 9, 5, 0, 0, 0, 0) + b"hello"
    regular = struct.pack("<QQBBHB", 9, 4096, 0, 0, 0, 1) + struct.pack("<QQQQ", 777, 4096, 0, 4096)
    root_item = struct.pack(I.LAYOUTS["root"][0], inode[:160], 9, 256, LOGICAL + 2 * NODE, 0, 0, 0, 0, 1, b"", 0, 1).ljust(I.RECORD_BYTES["root"], b"\0")
    at = {0: leaf([(256, 228, LOGICAL, chunk(16 * NODE, PHYSICAL))], LOGICAL, 3)}
    back = struct.pack("<QQH", 256, 3, 3) + b"sub"
    default = struct.pack("<QBQQHHB", 257, 132, 0, 9, 0, 7, 2) + b"default"
    block = struct.pack("<QQQ", 1, 9, 2) + struct.pack("<QBQB", 5, 1, 0, 0) + struct.pack("<BQ", 176, 5)
    data = struct.pack("<QQQ", 3, 9, 1) + struct.pack("<BQQQI", 178, 5, 257, 0, 2) + struct.pack("<BQI", 184, 12345, 1)
    extents = [(777, 168, 4096, data), (888, 168, NODE, block), (999, 168, NODE, data[:-3])]
    at[1] = leaf([(5, 132, 0, root_item), (6, 84, 1, default), (256, 144, 5, back), (256, 156, 257, back), (257, 156, 258, back + b"x"), *extents],
        LOGICAL + NODE, 1)
    at[2] = inner([LOGICAL + 3 * NODE, LOGICAL + 4 * NODE, LOGICAL + 5 * NODE], LOGICAL + 2 * NODE, 5)
    at[3] = leaf([(256, 84, 5, dir_entry + second), (257, 1, 0, inode), (257, 12, 256, struct.pack("<QH", 2, 3) + b"one")], LOGICAL + 3 * NODE, 5)
    at[4] = leaf([(257, 108, 0, inline), (257, 108, 4096, regular), (257, 1, 7, b"short"), (258, 84, I_HASH, dir_entry),
        (259, 96, 2, dir_entry + second[:-2]), (260, 12, 5, struct.pack("<QH", 2, 9) + b"one")], LOGICAL + 4 * NODE, 5)
    at[5] = b"\1" * NODE
    system = struct.pack(I.KEY, 256, 228, LOGICAL) + chunk(16 * NODE, PHYSICAL)
    device = struct.pack("<Q", 1).ljust(98, b"\0")
    block = struct.pack(I.SUPERBLOCK, b"", b"f" * 16, 0x10000, 0, I.MAGIC, 9, LOGICAL + NODE, LOGICAL, 0, 0, 1 << 30, 0, 6, 1, 4096, NODE, NODE, 4096,
        len(system), 1, 0, 0, 0, 0, 0, 0, 0, device, b"label", 0, 0)
    block = sealed(block.ljust(I.SYSTEM_CHUNKS, b"\0")[: I.SYSTEM_CHUNKS] + system.ljust(I.SUPERBLOCK_BYTES - I.SYSTEM_CHUNKS, b"\0"))
    raw = bytearray(PHYSICAL + 16 * NODE)
    raw[0x10000 : 0x10000 + len(block)] = block
    for k, node in at.items():
        raw[PHYSICAL + k * NODE : PHYSICAL + (k + 1) * NODE] = node
    path = tmp_path / "image"
    path.write_bytes(bytes(raw))
    return str(path)


def test_record_sizes():
    assert struct.calcsize(I.LAYOUTS["inode"][0]) == I.RECORD_BYTES["inode"]
    assert struct.calcsize(I.LAYOUTS["extent"][0]) == I.RECORD_BYTES["extent"]
    assert struct.calcsize(I.LAYOUTS["extent_data"][0]) + 32 == I.RECORD_BYTES["extent_data"]
    assert struct.calcsize(I.LAYOUTS["root_ref"][0]) == I.RECORD_BYTES["root_ref"]


def test_image(spark, image):
    items = I.read_items(spark, [[image]]).cache()
    assert items.where("corrupt is not null").count() == 1
    assert {r["name"] for r in I.dir_entries(items, "dir_item").collect()} == {"one", "zwö", "default"}
    rows = {r["offset"]: r for r in I.inodes(items).collect()}
    assert rows[0]["st_size"] == 5 and rows[0]["mtime"] == 7 and rows[7]["corrupt"]
    found = {r["offset"]: r for r in I.extents(items).collect()}
    assert bytes(found[0]["inline"]) == b"hello" and found[0]["kind"] == "inline" and found[4096]["address"] == 777
    refs = I.root_refs(items).collect()
    assert sorted((r["name"] or "", r["corrupt"] is None) for r in refs) == [("", False), ("sub", True)]
    assert [(r["name"], r["directory_id"]) for r in I.root_refs(items, "root_backref").collect()] == [("sub", 256)]
    assert sorted((r["parent"], r["name"] or "", r["corrupt"] is None) for r in I.inode_refs(items).collect()) == [(5, "", False), (256, "one", True)]
    assert [(r["name"], r["corrupt"] is None) for r in I.dir_entries(items).collect()] == [("one", True), (None, False)]
    assert [r["object_id"] for r in I.default_subvolume(items).collect()] == [257]
    wanted = spark.createDataFrame([(5, 258, "one"), (5, 258, "two"), (5, 257, "one")], "tree_id long, object_id long, name string")
    assert [(r["object_id"], r["name"], r["child"]) for r in I.entry_by_name(items, wanted).collect()] == [(258, "one", 257)]
    told = {r["object_id"]: r for r in I.extent_items(items).collect()}
    assert [(x["kind"], x["root"], x["object_id"], x["offset"], x["count"]) for x in told[777]["references"]] == [("extent_data", 5, 257, 0, 2),
        ("shared_data", None, None, 12345, 1)]
    assert told[777]["is_data"] and told[888]["is_tree_block"] and told[888]["block_object_id"] == 5 and told[888]["references"][0][
        "kind"] == "tree_block" and told[999]["corrupt"]
    assert [r["inode_st_size"] for r in I.roots(items).collect()] == [5]
    block = I.superblocks(spark, [[image]]).first()
    assert block["label"] == "label" and block["device"] == 1 and block["nodesize"] == NODE and block["fsid"] == "-".join(
        ["66" * 4, "66" * 2, "66" * 2, "66" * 2, "66" * 6])
    assert [i[:2] for i in I.Image([image]).items(PHYSICAL + 3 * NODE, False, physical=1)] == [i[:2] for i in I.Image([image]).items(LOGICAL + 3 * NODE, False)]
    assert I.by_type(items, "inode", 257).count() == 2
    assert I.subvolumes(items).count() == 1 and I.by_key(items, 257, 108, 0).count() == 1 and I.by_object(items, 257).count() == 6
    opened = I.Image([image])
    assert opened.physical(LOGICAL + 5) == (1, PHYSICAL + 5) and opened.physical(1) is None
    with pytest.raises(ValueError):
        list(opened.items(LOGICAL + 2 * NODE, tolerant=False))
    with pytest.raises(ValueError):
        I.Image([image, image])


def test_checksums():
    rng = np.random.default_rng(3)
    values = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 7, 8, 9, 100, 4096, 3)]

    def plain(data: bytes, state: int, final: int) -> int:
        for byte in data:
            state ^= byte
            for _ in range(8):
                state = state >> 1 ^ (0x82F63B78 if state & 1 else 0)
        return state ^ final

    for state, final in ((0xFFFFFFFF, 0xFFFFFFFF), (0xFFFFFFFE, 0)):
        expected = [plain(v, state, final) for v in values]
        assert [crc32c_of(v, state, final) for v in values] == expected == crc32c_many(values, state, final).tolist()


def test_incremental(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = lambda *x: spark.createDataFrame(list(x), "path string, content string, file_size long").coalesce(1)
    rows(("/a", "x", 1), ("/b", "x", 1)).write.parquet(source)
    for expected in (2, 0):
        stream = spark.readStream.schema("path string, content string, file_size long").parquet(source)
        refresh_cache(stream, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
        log = spark.read.parquet(str(tmp_path / "log"))
        assert sum(r["n"] for r in current_duplicates(log).collect()) == expected
        rows(("/b", "y", 1)).write.mode("append").parquet(source)
    assert {r["path"] for r in latest(log).collect()} == {"/a", "/b"}
