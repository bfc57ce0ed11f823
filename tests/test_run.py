"""Real folders: scans with extents, whole runs from options, the guarded dedupe action, archive formats, old caches."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import json
import lzma
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from twintree.options import Options
from twintree.run import run
from twintree.sources import archive, cache, dedupe, fs


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "a:b"
    for name, text in {"d1/f": "same text", "d2/f": "same text", "p": "same text", "q": "only here", "x.txt": "longer than all"}.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    with zipfile.ZipFile(top / "d1/z.zip", "w") as z:
        z.writestr("m", "same text")
    return str(top)


def table_of_extents(spark, root, names):
    return spark.createDataFrame([(f"{root}/{n}", 0, 1000 * (k + 1), 4096) for k, n in enumerate(names)],
        "path string, logical long, physical long, length long")


def test_scan_with_extents(spark, root):
    rows = {os.path.relpath(r["path"], root): r for r in fs.scan(spark, [root], extents=True).collect()}
    assert set(rows) == {"d1/f", "d2/f", "p", "q", "x.txt", "d1/z.zip"}
    told = fs.extents_of(f"{root}/p")  # None where the file system does not tell extents
    assert told is None or all(len(e) == 4 for e in told)
    assert all((r["n_extents"] > 0) == (r["phys"] > 0) for r in rows.values())
    known = fs.with_extents(fs.scan(spark, [root]), table_of_extents(spark, root, ["p", "q"]))
    assert {os.path.relpath(r["path"], root): (r["phys"], r["n_extents"]) for r in known.collect() if r["phys"]} == {"p": (1000, 1), "q": (2000, 1)}
    assert fs.extents(fs.scan(spark, [root])).columns == ["path", "logical", "physical", "length", "flags"]


def test_every_option_has_an_effect(spark, root, tmp_path):
    place = str(tmp_path / "cache")
    names = ["d1/f", "d2/f", "p"]
    extents = table_of_extents(spark, root, names)
    found = run(spark, Options(paths=(root,), cache_path=place), extents)
    shown = {r["shown"] for r in found.report.collect()}
    assert shown == {"d1/f", "d2/f", "p"}  # relative to the only root
    whole = run(spark, Options(paths=(root,), absolute=True, no_scan=True, cache_path=place))
    assert {r["shown"] for r in whole.report.collect()} == {f"{root}/{n}" for n in names}
    assert run(spark, Options(paths=(root,), min_size=100)).report.count() == 0
    assert run(spark, Options(paths=(root,), max_size=5)).report.count() == 0
    members = {r["shown"] for r in run(spark, Options(paths=(root,), read_archives=True)).report.collect()}
    assert members == {"d1/f", "d1/z.zip/m", "d2/f", "p"} or members == {"d1/f", "d1/z.zip/m", "d2/f", "p", "d1/z.zip", "d2"}
    assert run(spark, Options(paths=(root,), output="-")).report is None
    tree = run(spark, Options(paths=(root,), output="t"))
    assert {r["label"] for r in tree.report.collect()} >= {"DUPS", "UNIQ"}
    both = run(spark, Options(paths=(f"{root}/d1", f"{root}/d2"), output="d"))
    assert {(os.path.basename(r["root"]), r["rel"], r["label"]) for r in both.report.collect()} == {("d1", "f", "DUPS"), ("d1", "z.zip", "UNIQ"),
        ("d2", "f", "DUPS")}
    for kind, result in (("g", found), ("t", tree), ("d", both)):
        result.write(str(tmp_path / f"out-{kind}"))
    assert "DUPS" in json.dumps(json.loads((tmp_path / "out-t").read_text())) and json.loads((tmp_path / "out-d").read_text())
    # a stale cache entry is read again, a fresh one is believed
    os.utime(f"{root}/q")
    cached = cache.load(spark, place)
    lie = cached.withColumn("file_hash", F.when(F.col("path") == f"{root}/p", F.lit("0" * 64)).otherwise(F.col("file_hash")))
    rows = [tuple(r) for r in lie.collect()]
    cache.store(spark.createDataFrame(rows, lie.schema), place)
    believed = {r["path"]: r["file_hash"] for r in run(spark, Options(paths=(root,), cache_path=place)).analysis.files.collect()}
    assert believed[f"{root}/p"] == "0" * 64
    anew = {r["path"]: r["file_hash"] for r in run(spark, Options(paths=(root,), cache_path=place, no_cache=True)).analysis.files.collect()}
    assert anew[f"{root}/p"] == hashlib.sha256(b"same text").hexdigest()
    with pytest.raises(ValueError):
        run(spark, Options(paths=(root,), no_scan=True))


def test_dedupe_is_planned_and_guarded(spark, root):
    names = ["d1/f", "d2/f", "p"]
    found = run(spark, Options(paths=(root,)), table_of_extents(spark, root, names))
    plan = found.plan().collect()
    assert {os.path.relpath(r["path"], root) for r in plan} | {os.path.relpath(plan[0]["keeper"], root)} == set(names) and len(plan) == 2
    planned = found.dedupe()
    assert [r["state"] for r in planned.collect()] == ["planned"] * 2
    counters = found.counters(planned).first()
    assert (counters["found_files"], counters["processed_files"], counters["deduped_files"]) == (6, 4, 0)
    real = run(spark, Options(paths=(root,), dedup_simulate=False, aggressive_dedup=True), table_of_extents(spark, root, names))
    changed = [r["path"] for r in plan][0]
    real.plan().count()
    with open(changed, "a") as f:
        f.write("more")
    done = {r["path"]: r["state"] for r in real.dedupe().collect()}
    assert done[changed] == "changed" or "keeper changed" in done.values()
    assert open(f"{root}/q").read() == "only here"
    assert dedupe.dedupe_file(f"{root}/q", f"{root}/none", 9, None, None, 1 << 30) == (0, "No such file or directory")


def cpio(entries: dict[str, bytes]) -> bytes:
    out = b""
    for name, data in [*entries.items(), ("TRAILER!!!", b"")]:
        raw = name.encode() + b"\0"
        out += b"070701" + b"".join(b"%08X" % x for x in (1, 0o100644, 0, 0, 1, 77, len(data), 0, 0, 0, 0, len(raw), 0)) + raw
        out += b"\0" * (-len(out) % 4) + data
        out += b"\0" * (-len(out) % 4)
    return out


def ar(entries: dict[str, bytes]) -> bytes:
    out = b"!<arch>\n"
    for name, data in entries.items():
        out += f"{name + '/':<16}{77:<12}{0:<6}{0:<6}{'100644':<8}{len(data):<10}`\n".encode() + data + b"\n" * (len(data) % 2)
    return out


def test_archive_formats(tmp_path):
    entries = {"one": b"hello", "two": b"w\xc3\xb6rld!"}
    (tmp_path / "plain.cpio").write_bytes(cpio(entries))
    (tmp_path / "packed.cpio.gz").write_bytes(gzip.compress(cpio(entries)))
    (tmp_path / "lib.a").write_bytes(ar(entries))
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for name, data in entries.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 2, 3, 4, 6)), data)
    for kind in ("", "gz", "bz2", "xz"):
        with tarfile.open(tmp_path / f"t.tar.{kind}", f"w:{kind}") as t:
            for name, data in entries.items():
                (tmp_path / name).write_bytes(data)
                t.add(tmp_path / name, name)
    expected = {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in entries.items()}
    for path in sorted(p for p in tmp_path.iterdir() if p.suffix):
        rows = list(archive.members_of(str(path)))
        assert {r[0]: r[1:3] for r in rows} == expected, path
        assert all(r[4] for r in rows) and all(r[-1] == 0 for r in rows)
    for name, packed in (("s.gz", gzip.compress(b"hello")), ("s.bz2", bz2.compress(b"hello")), ("s.xz", lzma.compress(b"hello"))):
        (tmp_path / name).write_bytes(packed)
        assert [r[:3] for r in archive.members_of(str(tmp_path / name))] == [("data", 5, hashlib.sha256(b"hello").hexdigest())]
    (tmp_path / "cut.cpio").write_bytes(cpio(entries)[:-130])
    (tmp_path / "odd.7z").write_bytes(b"7z\xbc\xaf\x27\x1c" + b"\0" * 40)
    assert [r[-1] for r in archive.members_of(str(tmp_path / "cut.cpio"))][-1] == 1
    assert [r[-1] for r in archive.members_of(str(tmp_path / "odd.7z"))] == [1]


def test_archive_error_budget(tmp_path):
    """Sixteen broken members in a row end an archive; one good one in between begins the count anew."""
    path = tmp_path / "z.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(40):
            z.writestr(f"m{i:02}", f"text {i:02}")
    raw = path.read_bytes()
    for broken, good, failed in ((15, 25, 0), (16, 0, 1)):
        bad = raw
        for i in range(broken):
            bad = bad.replace(f"text {i:02}".encode(), b"broken!"[:7], 1)
        path.write_bytes(bad)
        rows = list(archive.members_of(str(path)))
        assert (sum(r[0] is not None for r in rows), rows[-1][-1]) == (good, failed)


def test_old_cache(spark, tmp_path):
    import base64

    raw = bytes(range(32))
    records = [{"path": "/a", "ctime": 5, "file_size": 3, "file_hash": base64.b64encode(raw).decode().rstrip("="), "was_file": True, "phys": 9},
        {"path": "/b", "file_hash": "x" * 88}, {"ctime": 1}]
    (tmp_path / "old.json").write_text(json.dumps(records))
    got = {r["path"]: r for r in cache.load_legacy(spark, str(tmp_path / "old.json")).collect()}
    assert got["/a"]["file_hash"] == raw.hex() and got["/a"]["phys"] == 9 and got["/b"]["file_hash"] is None and got["/b"]["is_file"]
