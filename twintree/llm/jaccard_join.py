"""Operator 4: exact n-gram Jaccard self-join with prefix trees.

Shingle sets are ordered by one global order: ordinary shingles by hash, then those that crowd the prefixes of a first pass
over all texts, last shingles that a bounded sample shows to be frequent. Two sets that link share a shingle among the first n - ceil(t n) + 1 of each (n: the set's size), so sets
meet only through these prefixes: sets that share enough of them come to the group of the smallest. A group's sets
are stored in a trie whose levels hold 16, 32, 64, ... shingles. A probing set walks it level by level; the overlap with
a path is computed once for all sets below it, and a subtree is pruned when its overlap and the remaining lengths can no
longer reach what its smallest set needs, or when all its sets are in the probe's component already. Groups put out
the links of a spanning forest, never all pairs. At first a set only meets the smallest one that it may link with; of the
other pairs those are looked at that are of two components then.

A group of more than `chunk` sets is joined in two steps. First each chunk is joined within itself and with the group's
smallest set, after which a group of copies is one component. Then the sets outside of the group's largest component, few
as a rule, are joined with all others, a chunk of the one and a chunk of the other at a time; pairs of one component are
passed over. So texts of a group of near copies are copied a bounded number of times, however large the group is.

Pairs are held against parity bits of their sets before any text moves: a bit that differs is a shingle that only one set
has, and linked sets have few of those. So texts move for pairs that are nearly linked, not for chance meetings.

Documents with equal sets are one node (the smallest doc_id) before the join.

Postings meet by merge joins at every size. Texts meet their blocks by a broadcast of checked size, else by a merge join.

Cases: null and empty texts and texts without words have no shingles and link with nothing; a text of fewer words than
the shingle is one shingle; rows with a null id take no part and have a null component; rows that repeat an id are one
node and so one component; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean
from .graph import components
from .shingles import set_digest, shingle_set

HOT = 1 << 62
#: So many ids (longs), and so many rows of an id with its few blocks, are broadcast; more of them are shuffled.
BROADCAST_IDS, BROADCAST_BLOCKS = 2_000_000, 250_000


def least_overlap(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The smallest overlap of linked sets of sizes a and b: 100 o >= percent (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def parity_bits(hashes: np.ndarray) -> np.ndarray:
    """Longs whose bit i tells whether an odd number of hashes end in i; between half a bit and one bit a hash, 64 at least."""
    bits = max(64, 1 << max(len(hashes).bit_length() - 1, 0))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _folded(parity: Column, size: Column) -> Column:
    """What the same set's parity bits are in `size` longs, a power of two up to their number."""
    place = lambda k: F.aggregate(F.sequence(k, F.size(parity), size), F.lit(0).cast("long"),
        lambda x, at: x.bitwiseXOR(F.element_at(parity, at)))
    return F.when(F.size(parity) == size, parity).otherwise(F.transform(F.sequence(F.lit(1), size), place))


def least_apart(a: Column, b: Column) -> Column:
    """At least so many shingles are in one of two sets only, by their parity bits."""
    size = F.least(F.size(a), F.size(b))
    differ = F.zip_with(_folded(a, size), _folded(b, size), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(differ, F.lit(0), lambda n, x: n + x)


def _short(digest: bytes) -> int:
    """What stands for a digest beside its node."""
    return int.from_bytes(digest[:8], "little", signed=True)


class Order:
    """Shingle hashes as positive longs in the global order."""

    def __init__(self, frequent: np.ndarray, crowded: np.ndarray | None = None):
        """frequent: hashes from the rarest to the commonest; crowded: keys in an order without crowded, likewise."""
        self.by_hash = np.argsort(frequent)
        self.sorted = frequent[self.by_hash]
        crowded = np.zeros(0, dtype=np.int64) if crowded is None else crowded
        self.by_key = np.argsort(crowded)
        self.crowded = crowded[self.by_key]

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        out = (hashes >> np.uint64(2)).astype(np.int64)
        if len(self.crowded) and len(hashes):
            at = np.minimum(np.searchsorted(self.crowded, out), len(self.crowded) - 1)
            late = self.crowded[at] == out
            out[late] = HOT + self.by_key[at[late]]
        if len(self.sorted) and len(hashes):
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            hot = self.sorted[at] == hashes
            out[hot] = HOT + len(self.crowded) + self.by_hash[at[hot]]
        out.sort()
        return out


class Trie:
    """Ordered sets in a tree; at level l a node is a distinct path of the first bounds[l + 1] shingles."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.bounds = [0]
        while self.bounds[-1] < self.sizes.max():
            self.bounds.append(self.bounds[-1] + (16 << (len(self.bounds) - 1)))
        self.node: list[np.ndarray] = []  # of each set, by level
        self.paths: list[list[np.ndarray]] = []  # of each node, its own shingles
        path = [b""] * len(sets)
        for low, high in zip(self.bounds[:-1], self.bounds[1:], strict=True):
            seen: dict[bytes, int] = {}
            own: list[np.ndarray] = []
            nodes = np.empty(len(sets), dtype=np.int64)
            for i, s in enumerate(sets):
                part = s[low:high]
                path[i] = set_digest(np.concatenate([np.frombuffer(path[i], dtype=np.int64), part]))
                if path[i] not in seen:
                    seen[path[i]] = len(own)
                    own.append(part)
                nodes[i] = seen[path[i]]
            self.node.append(nodes)
            self.paths.append(own)

    def linked(self, probe: np.ndarray, alive: np.ndarray, percent: int) -> np.ndarray:
        """Those of the sets alive (indexes) that link with the probe."""
        n = len(probe)
        sizes = self.sizes[alive]
        alive = alive[100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)]
        overlap = np.zeros(len(alive), dtype=np.int64)
        for level, high in enumerate(self.bounds[1:]):
            if not len(alive):
                break
            nodes, where = np.unique(self.node[level][alive], return_inverse=True)
            own = [self.paths[level][k] for k in nodes]
            lengths = np.array([len(p) for p in own])
            flat = np.concatenate(own)
            if not len(flat):
                break  # all that are left end above this level
            at = np.searchsorted(probe, flat)
            hits = np.concatenate([[0], np.cumsum(probe[np.minimum(at, n - 1)] == flat)])
            ends = np.cumsum(lengths)
            gained = hits[ends] - hits[ends - lengths]
            passed = np.where(lengths > 0, at[np.maximum(ends - 1, 0)], n)
            overlap = overlap + gained[where]
            # bounds of whole subtrees: the longest rest and the smallest need of the sets below a node
            rest, need = np.zeros(len(nodes), dtype=np.int64), np.full(len(nodes), 1 << 40)
            np.maximum.at(rest, where, np.maximum(self.sizes[alive] - high, 0))
            np.minimum.at(need, where, least_overlap(self.sizes[alive], n, percent))
            kept = overlap + np.minimum(rest, n - passed)[where] >= need[where]
            alive, overlap = alive[kept], overlap[kept]
        return alive[overlap >= least_overlap(self.sizes[alive], n, percent)]


def join_block(sets: list[np.ndarray], side: np.ndarray, percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the block's link graph.

    side: 0 or 1; pairs within one side are passed over if both occur. known: labels of components that are known already,
    whose pairs are passed over.
    """
    trie, links = Trie(sets), []
    root = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1]
    two = len(np.unique(side)) > 1
    everything = np.arange(len(sets))
    for i, probe in enumerate(sets):
        alive = everything[(root != root[i]) & ((side > side[i]) if two else (everything > i))]
        for j in trie.linked(probe, alive, percent):
            if root[i] != root[j]:
                links.append((i, int(j)))
                root[root == max(root[i], root[j])] = min(root[i], root[j])
    return links


def frequent_shingles(docs: DataFrame, words: int, text_col: str, sample_rows: int, least: int, most: int) -> np.ndarray:
    """Hashes from the rarest to the commonest of those in at least `least` of about sample_rows texts, at most `most`.

    The order only steers which shingles sets meet by; results do not depend on it.
    """
    keep = max(1, docs.count() // sample_rows)
    sample = docs.where(F.pmod(F.xxhash64(text_col), F.lit(keep)) == 0).select(text_col).dropDuplicates()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0):
                held.update(shingle_set(text.as_py(), words).view(np.int64).tolist())
                if len(held) > 500_000:
                    yield pa.RecordBatch.from_pydict({"h": pa.array(list(held), pa.int64()), "n": pa.array(list(held.values()), pa.int64())})
                    held = Counter()
        yield pa.RecordBatch.from_pydict({"h": pa.array(list(held), pa.int64()), "n": pa.array(list(held.values()), pa.int64())})

    found = sample.mapInArrow(lean(counted), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    best = found.orderBy(F.desc("n"), "h").limit(most).collect()
    return np.array([r["h"] for r in reversed(best)], dtype=np.int64).view(np.uint64)


def crowded_shingles(docs: DataFrame, words: int, percent: int, order: Broadcast, least: int, most: int, scratch: Scratch) -> np.ndarray:
    """Keys in the given order, from the rarest to the commonest, of shingles in the prefixes of more than `least` of all docs.

    At most `most`, the commonest; those that the order puts last already are left out. Like the sample's, they only steer
    which shingles sets meet by.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = [np.zeros(0, dtype=np.int64)]
            for text in batch.column("text"):
                hashes = shingle_set(text.as_py(), words)
                if len(hashes):
                    prefixes.append(order.value.keys(hashes)[: prefix_size(len(hashes), percent)])
            tokens, n = np.unique(np.concatenate(prefixes), return_counts=True)
            usual = tokens < HOT
            yield pa.RecordBatch.from_pydict({"token": pa.array(tokens[usual], pa.int64()), "n": pa.array(n[usual], pa.int64())})

    found = docs.select("text").mapInArrow(lean(counted), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = scratch.save(found.where(F.col("n") > least), "crowded")
    # from so many texts on there are at most `most`
    least, held = least + 1, 0
    for n, tokens in sorted(((r["n"], r["tokens"]) for r in found.groupBy("n").agg(F.count("*").alias("tokens")).collect()), reverse=True):
        held += tokens
        if held > most:
            least = n + 1
            break
    best = found.where(F.col("n") >= least).toArrow()
    scratch.drop(found)
    tokens, n = (best.column(c).to_numpy() for c in ("token", "n"))
    return tokens[np.lexsort((tokens, n))]


def _candidates(nodes: DataFrame, percent: int, pair_sets: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(pairs: a, b, structs of node and h; groups: leader, node, h) in which every two sets that may link meet.

    A prefix shingle of at most pair_sets sets gives their pairs (of sizes that can link). A linked pair shares, of its
    prefixes, as many shingles as its overlap needs beyond what can follow the prefixes; pairs with fewer are passed over,
    shingles of larger groups counting for every set that has them. So are pairs whose parity bits differ in more places
    than linked sets differ in shingles. The sets of a larger group all meet.
    """
    postings = nodes.select("node", "h", "size", F.explode("prefix").alias("token"))
    tokens = scratch.save(postings.groupBy("token").agg(F.count("*").alias("sets"), F.min("node").alias("leader")).where("sets > 1"), "tokens")
    # only shingles of several sets come out of this join, a small part of all
    hits = scratch.save(postings.join(tokens.hint("merge"), "token"), "hits")
    met = hits.where(F.col("sets") <= pair_sets).groupBy("token").agg(F.collect_list(F.struct("node", "h", "size")).alias("all"))
    size = lambda x: x["size"]
    fits = lambda x, y: (x["node"] < y["node"]) & (100 * F.least(size(x), size(y)) >= percent * F.greatest(size(x), size(y)))
    pairs = met.select("all", F.explode("all").alias("a")).select("a", F.explode(F.filter("all", lambda y: fits(F.col("a"), y))).alias("b"))
    pairs = scratch.save(pairs.groupBy("a", "b").agg(F.count("*").alias("shared")), "pairs")
    common = hits.where(F.col("sets") > pair_sets)
    extra = scratch.save(common.groupBy("h").agg(F.count("*").alias("extra")), "extra")
    known = extra.hint("merge")
    counted = pairs.withColumn("da", F.col("a.h")).withColumn("db", F.col("b.h"))
    counted = counted.join(known.select(F.col("h").alias("da"), F.col("extra").alias("ea")), "da", "left")
    counted = counted.join(known.select(F.col("h").alias("db"), F.col("extra").alias("eb")), "db", "left")
    reach = F.col("shared") + F.least(F.coalesce("ea", F.lit(0)), F.coalesce("eb", F.lit(0)))
    total, larger = F.col("a.size") + F.col("b.size"), F.greatest("a.size", "b.size")
    overlap = F.ceil(percent * total / F.lit(100 + percent) - F.lit(1e-9))
    after = F.ceil(percent * larger / F.lit(100) + F.lit(1e-9)) - 1
    ends = [F.struct(F.col(f"{x}.node").alias("node"), F.col(f"{x}.h").alias("h")).alias(x) for x in "ab"]
    likely = counted.where(reach >= overlap - after)
    for x in "ab":
        bits = nodes.select(F.col("node").alias(f"n{x}"), F.col("h").alias(f"d{x}"), F.col("parity").alias(f"p{x}"))
        likely = likely.withColumn(f"n{x}", F.col(f"{x}.node")).join(bits.hint("merge"), [f"n{x}", f"d{x}"])
    likely = scratch.save(likely.where(least_apart(F.col("pa"), F.col("pb")) <= total - 2 * overlap).select(*ends), "likely")
    return likely, scratch.save(common.select("leader", "node", "h").distinct(), "groups")


def _ends(pairs: DataFrame) -> DataFrame:
    """leader, node, h of pairs: the smaller node's group."""
    both = pairs.select(F.col("a.node").alias("leader"), F.explode(F.array("a", "b")).alias("x"))
    return both.select("leader", "x.node", "x.h").distinct()


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 10_000,
    hot_least: int = 4, hot_most: int = 50_000, chunk: int = 256, pair_sets: int = 64, scratch: Scratch | None = None,
    crowded_most: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per input row.

    sample_rows, hot_least and hot_most bound the list of frequent shingles, which is broadcast; chunk bounds a block;
    pair_sets is the largest group of a shingle that is taken apart into pairs; of the shingles that have larger groups at
    first, the commonest crowded_most, broadcast too, go behind the others.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    frequent = frequent_shingles(docs, words, "text", sample_rows, hot_least, hot_most)
    usual = spark.sparkContext.broadcast(Order(frequent))
    shared = spark.sparkContext.broadcast(Order(frequent, crowded_shingles(docs, words, percent, usual, pair_sets, crowded_most, scratch)))
    usual.destroy()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, short, prefixes, bits = [], [], [], [], []
            for text in batch.column("text"):
                hashes = shingle_set(text.as_py(), words)
                sizes.append(len(hashes))
                digests.append(set_digest(hashes) if len(hashes) else None)
                short.append(_short(digests[-1]) if len(hashes) else None)
                prefixes.append(shared.value.keys(hashes)[: prefix_size(len(hashes), percent)] if len(hashes) else np.zeros(0, dtype=np.int64))
                bits.append(parity_bits(hashes))
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate(prefixes) if prefixes else np.zeros(0, dtype=np.int64))
            parity = pa.ListArray.from_arrays(np.cumsum([0, *map(len, bits)]).astype(np.int32), np.concatenate(bits) if bits else np.zeros(0, dtype=np.int64))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(short, pa.int64()), lists, parity]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "h", "prefix", "parity"])

    sketches = scratch.save(docs.mapInArrow(lean(sketch), "doc_id long, n_shingles long, digest binary, h long, prefix array<long>, parity array<long>"), "sketches")
    usable = sketches.where("digest is not null and doc_id is not null")
    firsts = [F.min("doc_id").alias("node"), F.first("n_shingles").alias("size"), F.first("h").alias("h"), F.first("prefix").alias("prefix"),
        F.first("parity").alias("parity")]
    nodes = scratch.save(usable.groupBy("digest").agg(*firsts), "nodes")
    likely, groups = _candidates(nodes, percent, pair_sets, scratch)
    scratch.keep_only(sketches, nodes, likely, groups)
    # the texts that meet others at all, a part of the corpus
    met = scratch.save(likely.select(F.explode(F.array("a.node", "b.node")).alias("doc_id")).unionByName(groups.select(F.col("node").alias("doc_id"))).distinct(), "met")
    few = met.count() <= BROADCAST_IDS
    texts = scratch.save(docs.join(F.broadcast(met) if few else met.hint("merge"), "doc_id", "left_semi"), "texts")
    none, zero = F.lit(None).cast("long"), F.lit(0)
    own = lambda chunks: F.pmod(F.xxhash64("h"), chunks).cast("int")

    def placed(members: DataFrame, of: Column) -> DataFrame:
        """Chunks of the groups (leader, node, h), with the leader in each of them."""
        counts = members.groupBy("leader").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("chunks"))
        chunks = F.coalesce("chunks", F.lit(1))
        where = F.explode(F.when(F.col("node") == F.col("leader"), F.sequence(zero, chunks - 1)).otherwise(F.array(own(chunks))))
        rows = members.join(counts.where("chunks > 1"), "leader", "left").select("node", "h", "leader", where.alias("i"), of.alias("of"))
        return rows.select("node", "h", "leader", "i", F.col("i").alias("j"), zero.alias("side"), "of")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, sides, known, seen = None, [], [], [], [], set()
        u, v = [], []

        def flush() -> None:
            if len(ids) > 1:
                for a, b in join_block(sets, np.array(sides), percent, np.array(known) if known[0] is not None else None):
                    u.append(ids[a])
                    v.append(ids[b])

        for batch in batches:
            columns = [batch.column(c) for c in ("leader", "i", "j", "doc_id", "h", "text", "side", "of")]
            for row in range(batch.num_rows):
                leader, i, j, doc, h, text, side, of = (c[row].as_py() for c in columns)
                if (leader, i, j) != key:
                    flush()
                    key, ids, sets, sides, known, seen = (leader, i, j), [], [], [], [], set()
                hashes = shingle_set(text, words)
                if (doc, h, side) in seen or _short(set_digest(hashes)) != h:
                    continue  # another text under a repeated id, or a repeated row
                seen.add((doc, h, side))
                ids.append(doc)
                sets.append(shared.value.keys(hashes))
                sides.append(side)
                known.append(of)
        flush()
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    def links_of(placed: DataFrame, name: str) -> DataFrame:
        """placed: node, h, leader, i, j, side, of; rows of one (leader, i, j) are a block."""
        blocks = placed.groupBy("node", "h").agg(F.collect_list(F.struct("leader", "i", "j", "side", "of")).alias("blocks"))
        blocks = scratch.save(blocks.withColumnRenamed("node", "doc_id"), f"{name}-blocks")
        few = blocks.count() <= BROADCAST_BLOCKS
        payload = texts.join(F.broadcast(blocks) if few else blocks.hint("merge"), "doc_id").select("doc_id", "h", "text", F.explode("blocks").alias("b"))
        payload = payload.select("doc_id", "h", "text", "b.*").repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")
        found = scratch.save(payload.mapInArrow(lean(joined), "u long, v long"), name)
        scratch.drop(blocks)
        return found

    def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """rows with the component `of` their node."""
        return rows.join(labels, "node", "left").withColumn("of", F.coalesce("component", "node")).drop("component")

    # every set meets the smallest one that it may link with, and its groups
    first = _ends(likely.groupBy("b").agg(F.min("a").alias("a"))).unionByName(groups).distinct()
    links = links_of(placed(first, none), "links")
    labels = components(links, scratch)
    # a leader's pairs all met, since it is in each of its chunks; its groups may not have
    large = first.groupBy("leader").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("chunks")).where("chunks > 1")
    inside = scratch.save(labelled(groups.join(large, "leader"), labels), "inside")
    if inside.limit(1).count():
        main = inside.groupBy("leader", "of").agg(F.count("*").alias("n")).groupBy("leader")
        main = main.agg(F.max_by("of", F.struct("n", "of")).alias("main"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
        main = scratch.save(main.select("leader", "main", F.ceil(F.col("others") / F.lit(chunk)).cast("int").alias("rest")), "main")
        parted = inside.join(main, "leader")
        apart = F.col("of") != F.col("main")
        # blocks of chunk i of the main component and chunk j of the others, and of chunks of the others alone (i below 0)
        others = parted.where(apart).withColumn("mine", own(F.col("rest")))
        mine = parted.where(~apart).select("node", "h", "leader", own(F.col("chunks")).alias("i"),
            F.explode(F.sequence(zero, F.col("rest") - 1)).alias("j"), zero.alias("side"), "of")
        theirs = others.select("node", "h", "leader", F.explode(F.sequence(zero, F.col("chunks") - 1)).alias("i"), F.col("mine").alias("j"),
            F.lit(1).alias("side"), "of")
        alone = others.withColumn("other", F.explode(F.sequence(zero, F.col("rest") - 1))).select("node", "h", "leader",
            (-1 - F.least("mine", "other")).alias("i"), F.greatest("mine", "other").alias("j"),
            (F.col("mine") > F.col("other")).cast("int").alias("side"), "of")
        more = links_of(mine.unionByName(theirs).unionByName(alone), "more")
        labels = components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more), scratch)
    # what is left of the pairs: those of two components
    a, b = (labelled(likely.select("a", "b", F.col(f"{x}.node").alias("node")), labels).select("a", "b", F.col("of").alias(f"of_{x}")) for x in "ab")
    apart = scratch.save(a.join(b, ["a", "b"]).where("of_a <> of_b").select("a", "b"), "apart")
    links = labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
    if apart.limit(1).count():
        rest = labelled(_ends(apart), labels)
        links = links.unionByName(links_of(placed(rest, F.col("of")), "rest"))
    again = usable.groupBy("doc_id").agg(F.min("digest").alias("one"), F.max("digest").alias("two")).where("one <> two")
    repeated = again.join(usable.select("doc_id", "digest").distinct(), "doc_id").join(nodes.select("digest", "node"), "digest").select(
        F.col("doc_id").alias("u"), F.col("node").alias("v"))
    parts = components(links.unionByName(repeated), scratch)
    named = nodes.select("digest", "node").join(parts, "node", "left").select("digest", F.coalesce("component", "node").alias("of"))
    named = scratch.save(named, "named")
    scratch.keep_only(sketches, named)
    out = sketches.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("of", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that link to a smaller id: one row of each component stays, and all rows with a null id.

    Of rows that repeat an id, the one whose text has the smallest SHA-256 stays (null last).
    """
    scratch = Scratch(docs.sparkSession, "keepone")
    found = scratch.save(jaccard_components(docs, words, percent, id_col, text_col, scratch=scratch).select("doc_id", "component_id"), "components")
    scratch.keep_only(found)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    own = F.col(id_col).cast("long")
    kept = docs.join(gone, own == F.col("__gone"), "left_anti")
    again = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__rows")).where("__rows > 1").select(F.col("doc_id").alias("__again"))
    again = scratch.save(again, "again")
    if not again.limit(1).count():
        return kept
    once = kept.join(again, own == F.col("__again"), "left_anti")
    row = F.struct(F.sha2(F.col(text_col).cast("binary"), 256).isNull().alias("none"), F.sha2(F.col(text_col).cast("binary"), 256).alias("digest"),
        F.struct(*docs.columns).alias("row"))
    first = kept.join(again, own == F.col("__again"), "left_semi").groupBy(F.col(id_col).alias("__id")).agg(F.min(row).alias("__first"))
    return once.unionByName(first.select("__first.row.*"))
