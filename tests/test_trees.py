"""Hand-made trees with what is known of them, and random forests against a recursive model."""

from __future__ import annotations

import hashlib
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from twintree import queries
from twintree.functions import paths as P
from twintree.functions import scalars as S
from twintree.operators import dedup, diff, directories, groups
from twintree.operators.ranges import build_paths, to_physical
from twintree.options import Options
from twintree.plans import reports
from twintree.plans.analysis import Analysis
from twintree.sources import archive, cache, corpora, fs


def analysis(spark, tree: dict[str, str]) -> Analysis:
    rows = spark.createDataFrame(list(tree.items()), "path string, content string")
    return Analysis(corpora.as_entries(rows))


def shown(a: Analysis, rule: int) -> list[set[str]]:
    found: dict[str, set[str]] = {}
    for r in a.shown(rule).collect():
        found.setdefault(r["hash"], set()).add(r["path"])
    return sorted(found.values(), key=sorted)


def test_two_equal_files(spark):
    a = analysis(spark, {"/r/a": "xx", "/r/b": "xx", "/r/c": "yyy"})
    assert shown(a, 2) == [{"/r/a", "/r/b"}]
    assert {r["path"]: r["file_hash"] for r in a.files.collect()}["/r/c"] is None
    assert {r["path"]: r["dir_hash"] for r in a.dirs.collect()}["/r"] is None


T2 = {"/r/d1/f": "xx", "/r/d2/f": "xx"}


def test_equal_directories_and_rules(spark):
    a = analysis(spark, T2)
    both = [{"/r/d1", "/r/d2"}, {"/r/d1/f", "/r/d2/f"}]
    assert shown(a, 0) == both
    assert shown(a, 1) == shown(a, 2) == shown(a, 3) == both[:1]


def test_outside_copies(spark):
    one = analysis(spark, T2 | {"/r/f3": "xx"})
    files = {"/r/d1/f", "/r/d2/f", "/r/f3"}
    for rule in (0, 1, 2):
        assert files in shown(one, rule)
    assert shown(one, 3) == [{"/r/d1", "/r/d2"}]
    two = analysis(spark, T2 | {"/r/f3": "xx", "/r/f4": "xx"})
    assert files | {"/r/f4"} in shown(two, 0) and files | {"/r/f4"} in shown(two, 1)
    assert {"/r/f3", "/r/f4"} in shown(two, 2) and {"/r/f3", "/r/f4"} in shown(two, 3)


def test_names_count_and_unhashed_children(spark):
    assert shown(analysis(spark, {"/r/d1/f": "xx", "/r/d2/g": "xx"}), 2) == [{"/r/d1/f", "/r/d2/g"}]
    dirs = {r["path"]: r["dir_hash"] for r in analysis(spark, {"/r/d1/f": "xx", "/r/d1/u": "zzzzz", "/r/d2/f": "xx"}).dirs.collect()}
    assert dirs["/r/d1"] is None and dirs["/r/d2"] is not None


def test_component_order_and_empty_files(spark):
    report = analysis(spark, {"/r/a/b": "xx", "/r/a.b": "xx", "/r/e1": "", "/r/e2": ""}).report(0)
    rows = [(r["group_rank"], r["path"]) for r in report.orderBy("group_rank", "member_rank").collect()]
    assert rows == [(1, "/r/a/b"), (1, "/r/a.b"), (2, "/r/e1"), (2, "/r/e2")]
    lines = [r["line"] for r in reports.group_lines(report, ["/r"]).collect()]
    assert lines[0] == "Group 2 B" and lines[1] == "   F  a/b"


def test_empty_table(spark):
    a = analysis(spark, {"/r/a": "x"})
    nothing = Analysis(a.entries.limit(0))
    assert nothing.report(2).count() == 0 and nothing.dirs.count() == 0


def test_diff_of_two_and_three_roots(spark):
    a = analysis(spark, {"/A/p": "1", "/A/q/s": "22", "/B/p": "1", "/B/q/s": "22", "/B/q/t": "22"})
    nodes = diff.nodes_of(a.files, a.dirs)
    stat = {(r["root"], r["rel"]): r["stat"] for r in diff.tree_diff(nodes, ["/A", "/B"]).collect()}
    assert stat[("/A", "p")] == 2 and stat[("/A", "q")] == 1 and stat[("/A", "")] == 1
    assert stat[("/B", "q")] == 0 and stat[("/B", "q/s")] == 2
    assert '"DUPS F p 1": null' in reports.diff_json(diff.tree_diff(nodes, ["/A", "/B"]))
    b = analysis(spark, {"/A/d/p": "1", "/A/d/q": "22", "/B/d/p": "1", "/C/d/q": "22"})
    stat = {(r["root"], r["rel"]): r["stat"] for r in diff.tree_diff(diff.nodes_of(b.files, b.dirs), ["/A", "/B", "/C"]).collect()}
    assert stat[("/A", "d")] == stat[("/B", "d")] == stat[("/C", "d")] == 1


def test_keeper_and_dups(spark):
    rows = [("h", "/a", 5, 10, 2, 5), ("h", "/b", 5, 20, 1, 9), ("h", "/c", 5, 20, 1, 7), ("h", "/d", 5, 30, 1, 7)]
    files = spark.createDataFrame(rows, "file_hash string, path string, file_size long, phys long, n_extents int, ctime long")
    found = dedup.dedup_candidates(files)
    keeper = dedup.keepers(found).first()
    assert keeper["keeper"] == "/c" and keeper["avg_phys"] == 20
    assert {r["path"] for r in dedup.dedup_groups(found).collect()} == {"/a", "/d"}
    assert {r["path"] for r in dedup.dedup_groups(found, aggressive=True).collect()} == {"/a", "/b", "/d"}


def test_packing():
    batches = list(dedup.pack(iter([("a", 10, 1), ("b", 10, 2), ("c", 100, 9), ("d", 1000, 1)]), budget=300))
    assert [[(s.hash, s.first, s.last) for s in b] for b in batches[:1]] == [[("a", 0, 0), ("b", 0, 1)]]
    covered: dict[str, int] = {}
    for batch in batches:
        assert sum(s.files for s in batch) <= dedup.BATCH_FILES
        assert sum(s.usage for s in batch) <= 300 or (len(batch) == 1 and batch[0].files == 2)
        for s in batch:
            covered[s.hash] = covered.get(s.hash, 0) + s.last - s.first + 1
    assert covered == {"a": 1, "b": 2, "c": 9, "d": 1}


def digest(children: list[str]) -> str:
    """A directory's hash by its definition."""
    found = [hashlib.sha256(c.encode()).hexdigest() for c in children]
    sums = [sum(int(h[7 * k : 7 * k + 7], 16) for h in found) for k in range(8)]
    return hashlib.sha256("|".join(map(str, [len(children), *sums])).encode()).hexdigest()


def model(tree: dict[str, str]) -> dict[str, str | None]:
    """Directory hashes by recursion."""
    sizes = [len(c) for c in tree.values()]
    children: dict[str, dict[str, str | None]] = {}
    known = {p: hashlib.sha256(c.encode()).hexdigest() if sizes.count(len(c)) > 1 else None for p, c in tree.items()}
    dirs = {p.rsplit("/", i)[0] for p in tree for i in range(1, p.count("/") + 1)}
    for path in sorted(dirs, key=lambda d: -d.count("/") if d else 1):
        kids = {p.rpartition("/")[2]: h for p, h in known.items() if p and p.rpartition("/")[0] == path}
        children[path] = kids
        known[path] = None if None in kids.values() else digest([n + h for n, h in kids.items()])
    return {d: known[d] for d in dirs}


@pytest.mark.parametrize("seed", range(3))
def test_random_forests(spark, seed):
    rng = random.Random(seed)
    tree = {"/" + "/".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) + f"/f{rng.randint(0, 2)}": rng.choice(
        ["x", "yy", "yz", "zzz", "w" * rng.randint(4, 9)]) for _ in range(40)}
    a = analysis(spark, tree)
    expected = model(tree)
    assert {r["path"]: r["dir_hash"] for r in a.dirs.collect()} == expected
    flat = {r["path"]: r["signature"] for r in directories.flat_signatures(a.files).collect()}
    assert set(flat) == {p for p, h in expected.items() if h}
    for p in flat:
        for q in flat:
            assert (flat[p] == flat[q]) == (expected[p] == expected[q])


def test_wide_directories(spark):
    """Directories of any width are hashed by one definition."""
    n = F.col("id")
    rows = [spark.range(100_001).select(F.concat(F.lit(f"/r/{d}/f"), n).alias("path"), F.concat(F.lit("x"), n % 3).alias("content")) for d in "ab"]
    rows.append(spark.range(99_999).select(F.concat(F.lit("/r/c/f"), n).alias("path"), F.concat(F.lit("x"), n % 3).alias("content")))
    rows += [spark.range(5).select(F.concat(F.lit(f"/r/{d}/f"), n).alias("path"), F.concat(F.lit("x"), n % 3).alias("content")) for d in "de"]
    whole = rows[0]
    for more in rows[1:]:
        whole = whole.unionByName(more)
    a = Analysis(corpora.as_entries(whole))
    hashes = {r["path"]: r["dir_hash"] for r in a.dirs.collect()}
    assert hashes["/r/a"] == hashes["/r/b"] != hashes["/r/c"] and hashes["/r/d"] == hashes["/r/e"]
    for d, size in (("a", 100_001), ("c", 99_999), ("d", 5)):
        assert hashes[f"/r/{d}"] == digest([f"f{i}" + hashlib.sha256(f"x{i % 3}".encode()).hexdigest() for i in range(size)])


def test_file_system_archives_and_cache(spark, tmp_path):
    root = tmp_path / "r"
    (root / "x").mkdir(parents=True)
    (root / "p").write_text("hello")
    (root / "x/m").write_text("hello")
    with zipfile.ZipFile(root / "a.zip", "w") as z:
        z.writestr("m", "hello")
    (root / "broken.tar").write_text("no archive")
    with tarfile.open(root / "t.tar.gz", "w:gz") as t:
        t.add(root / "p", "inner/p")
    (root / "link").symlink_to(root / "p")
    scanned = fs.scan(spark, [str(root)])
    assert {r["name"] for r in scanned.collect()} == {"p", "m", "a.zip", "broken.tar", "t.tar.gz"}
    raw = archive.read_archives(scanned)
    assert [r["archive_path"].rpartition("/")[2] for r in archive.failures(raw).collect()] == ["broken.tar"]
    members = archive.member_entries(raw)
    assert {r["path"].removeprefix(str(root)) for r in members.collect()} == {"/a.zip/m", "/t.tar.gz/inner/p"}
    from twintree.operators.candidates import read_candidates

    files = fs.hash_files(read_candidates(scanned, Options(read_archives=True), members)).unionByName(members, allowMissingColumns=True)
    hashes = {r["path"].removeprefix(str(root)): r["file_hash"] for r in files.collect()}
    assert hashes["/p"] == hashes["/x/m"] == hashes["/a.zip/m"] == hashlib.sha256(b"hello").hexdigest()
    dirs = {r["path"].removeprefix(str(root)): r["dir_hash"] for r in directories.roll_up(files, archives=True).collect()}
    assert dirs["/a.zip"] == dirs["/x"] is not None
    cache.store(files, str(tmp_path / "cache"))
    kept = cache.load(spark, str(tmp_path / "cache"), [str(root)])
    assert kept.count() == files.count()
    (root / "p").write_text("other")
    again = {r["name"]: r["valid"] for r in cache.validate(fs.scan(spark, [str(root)]), kept).collect()}
    assert again["m"]


def test_human_size_of_large_sizes(spark, tmp_path):
    longs = spark.createDataFrame([(2**60 - 1,), (2**63 - 1,), (-5,), (None,)], "size long")
    assert [r["h"] for r in longs.select(S.human_size(F.col("size")).alias("h")).collect()] == ["1023.9 PiB", "7.9 EiB", "-5 B", None]
    # SQL knows no unit above TiB; the last two sizes are beyond a long, ten times the third is too
    rows = [(1, "é"), (11_000, "abcdefghij" * 100), (1_000_000, "ab"), (2_000_000, "abc"), (3_000_000, "abcdefghij" * 10), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["size"], r["shown"]) for r in queries.human_size_docs(spark, str(tmp_path)).collect()}
    sizes = {i: len(text.encode()) * (1 + i**3) for i, text in rows if text}
    tib = {i: f"{n // 1024**4}.{n % 1024**4 * 10 // 1024**4} TiB" for i, n in sizes.items()}
    assert got == {1: (4, "4 B"), 5: (None, None), 2_000_000: (None, tib[2_000_000]), 3_000_000: (None, tib[3_000_000])} | {
        i: (sizes[i], tib[i]) for i in (11_000, 1_000_000)}


def test_functions(spark):
    row = spark.range(1).select(
        S.human_size(F.lit(1536).cast("long")).alias("h"), S.key_text(F.lit(5), F.lit(1), F.lit(255)).alias("k"),
            S.time_text(F.lit(86461).cast("long"), F.lit(7)).alias("t"),
        S.crc32c(F.lit("123456789").cast("binary")).alias("c"), P.ancestors(F.lit("/a/b")).alias("a"),
            S.clamped_budget(F.lit(10 << 20), F.lit(0), 1 << 16, 1 << 22).alias("b"),
    ).first()
    assert row["h"] == "1.5 KiB" and row["k"] == "5/1 @ 0xff" and row["t"] == "1970-01-02T00:01:01.000000007"
    assert row["c"] == 0xE3069283 and row["a"] == ["", "/a"] and row["b"] == 1 << 22
    for wrong in ({"shadow_rule": 4}, {"output": "x"}, {"paths": ("not/absolute",)}):
        with pytest.raises(ValueError):
            Options(**wrong)
    more = spark.range(1).select(
        S.page_rounded(F.lit(1.0)).alias("p"), S.profile_code(F.lit("raid10")).alias("c"), S.profile_code(F.lit("none such")).alias("n"),
        S.uuid_text(F.unhex(F.lit("00112233445566778899aabbccddeeff"))).alias("u"), S.decode_hash(F.base64(F.unhex(F.lit("ab" * 32)))).alias("h"),
    ).first()
    assert (more["p"], more["c"], more["n"]) == (1 << 20, 64, None) and more["u"] == "00112233-4455-6677-8899-aabbccddeeff" and more["h"] == "ab" * 32


def test_ranges_and_paths(spark):
    chunks = spark.createDataFrame([(0, 10, 100), (20, 5, 500)], "start long, length long, physical long")
    found = {r["address"]: r["physical"] for r in to_physical(spark.createDataFrame([(3,), (15,), (24,)], "address long"), chunks).collect()}
    assert found == {3: 103, 15: None, 24: 504}
    nodes = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 5, "x"), (5, 4, "y")], "id long, parent long, name string")
    assert {r["id"]: r["path"] for r in build_paths(nodes).collect()} == {1: "/a", 2: "/a/b", 3: "/a/b/c"}


def test_ranges_of_all_lengths(spark):
    rng = random.Random(8)
    at, chunks = 0, []
    for _ in range(200):
        at += rng.choice([0, 1, 5, 1000])
        size = rng.choice([1, 2, 3, 64, 1000, 1 << 20])
        chunks.append((at, size, rng.randrange(1 << 40)))
        at += size
    asked = [rng.randrange(at + 5) for _ in range(500)] + [c[0] for c in chunks] + [c[0] + c[1] - 1 for c in chunks] + [7, 7]
    got = to_physical(spark.createDataFrame([(a,) for a in asked], "address long"),
        spark.createDataFrame(chunks, "start long, length long, physical long")).collect()
    assert len(got) == len(asked)
    for r in got:
        expected = [p + r["address"] - s for s, n, p in chunks if s <= r["address"] < s + n]
        assert r["physical"] == (expected[0] if expected else None)


def test_paths_below_cycles(spark):
    """Chains of any depth are built; nodes of a cycle and those below one have no path, and names do not grow."""
    rows = [(i, i - 1 if i else None, f"n{i}") for i in range(40)]
    rows += [(100 + i, 100 + (i + 1) % 30, "c") for i in range(30)] + [(200, 100, "below"), (201, 200, "below"), (300, 300, "own"), (301, 999, "lost")]
    got = {r["id"]: r["path"] for r in build_paths(spark.createDataFrame(rows, "id long, parent long, name string")).collect()}
    assert got == {i: "".join(f"/n{k}" for k in range(i + 1)) for i in range(40)} | {300: "/own", 301: "/lost"}


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_export_order_with_coalescing(spark, coalesce):
    """Ranks are right however the engine puts shuffled parts together."""
    rng = random.Random(9)
    tree = {f"/r/{rng.choice('abcdef')}{i}": rng.choice(["x", "yy", "zz", "vvv", "www"]) for i in range(300)}
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": coalesce, "spark.sql.shuffle.partitions": "17"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = analysis(spark, tree).report(0).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    by_hash: dict[str, list] = {}
    for r in got:
        by_hash.setdefault(r["hash"], []).append(r)
    order = sorted(by_hash.values(), key=lambda g: (-max(r["size"] for r in g), min((r["typ_order"], r["path"].split("/")) for r in g)))
    for rank, group in enumerate(order, 1):
        members = sorted(group, key=lambda r: (r["typ_order"], r["path"].split("/")))
        assert [(r["group_rank"], r["member_rank"]) for r in members] == [(rank, k) for k in range(1, len(group) + 1)]


def test_hash_counts_of_members(spark):
    a = analysis(spark, T2)
    assert {r["n"] for r in groups.hash_counts(a.members).collect()} == {2, 1}
