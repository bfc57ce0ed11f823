"""Operator 3: removal of repeated byte strings through column-wise suffix sorting of many sequences.

Every window of `length` bytes that also starts anywhere else is found, and the bytes such windows cover are removed.

1. Each window is keyed by the smallest hash of its 24-byte grams, so equal windows have equal keys. A segment is a run of
   windows with one key. Segments with equal bytes are collapsed to one sequence with a weight; keys with one sequence
   and no inner repeat need no sorting.
2. Windows of the other keys are parted further by the place of the gram in the window (in steps of `step`) and by the
   bytes that all windows of such a part share, their core. A sequence is then a left margin, the core as one symbol, and
   a right margin: at most 2 step - 1 symbols, whatever `length` is.
3. Sequences are sorted by the column-wise construction: round after round, one symbol of every sequence is put before
   its suffix, the Burrows-Wheeler order of the whole collection is extended by the new suffixes, and the common prefixes
   with their neighbours are updated by range minima. A window repeats if its suffix shares `length` bytes with a
   neighbour. Sequences come and go through tables in the shared folder; a batch of groups is held at a time.

The method alone, over whole documents, needs a round for each byte of the longest document and reads the whole
transform in each; keys and cores keep it to 2 step rounds without losing a window. A core with more than hot_sequences
different sequences is too much for one task: its windows are parted again by longer cores, with an eighth of the step,
and so on down to a step of 1, where a core is a whole window and has one sequence. What is sorted so is bounded at every
size of the input, and no group of windows takes another way than this one. Tables meet by joins that Spark plans; nothing
is collected, and nothing is broadcast but what Spark itself finds small.

Cases: a null text counts as empty; texts shorter than the window keep all bytes; repeated rows are each other's copies,
so both lose their bytes; null ids are handed through; an empty table gives an empty result; only the id and text columns
are read. The kept text of a null text is null; a character stays in it if all its bytes stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, mix64
from .shingles import _powers

GRAM = 24
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BIG = 1 << 31


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place."""
    power, inverse = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[raw] * power[: len(raw)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * inverse[: len(raw) - GRAM + 1] * _SPREAD
    return h ^ (h >> np.uint64(29))


def window_keys(grams: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbouring hashes, from running minima of blocks in both directions."""
    blocks = -(-len(grams) // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[: len(grams)] = grams
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(grams) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(text: bytes, length: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(key, first window, windows, places of the key's gram) of a text's runs of equally keyed windows, cut at `length` windows."""
    if len(text) < length:
        return
    grams = gram_hashes(np.frombuffer(text, dtype=np.uint8))
    width = length - GRAM + 1
    keys = window_keys(grams, width)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
        key = keys[a]
        for low in range(a, b, length):
            high = min(b, low + length)
            yield int(key), low, high - low, low + np.flatnonzero(grams[low : high - 1 + width] == key)


def parts(text: bytes, key: int, first: int, windows: int, places: np.ndarray, length: int, step: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(core key, first window, windows, left margin, right margin) of a segment."""
    at = np.arange(first, first + windows)
    place = places[np.searchsorted(places, at)]
    bucket = (place - at) // step
    cuts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (bucket[1:] != bucket[:-1])]))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), windows], strict=True):
        core = int(place[a]) - step * int(bucket[a])
        end = core + length - step + 1
        low, high = first + a, first + b
        digest = xxhash.xxh3_64_intdigest(text[core:end], seed=(key ^ int(bucket[a]) * 0x9E3779B97F4A7C15) & (2**64 - 1))
        yield digest, low, b - a, text[low:core], text[end : high - 1 + length]


def column_sort(sequences: list[np.ndarray], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, symbols, common) of all suffixes in order; common[r]: weight of the prefix that r shares with r - 1.

    weight: of each symbol. Ends of sequences sort before all symbols and in the order of the sequences.
    """
    m = len(sequences)
    rest = np.array([len(s) for s in sequences])
    flat, base = np.concatenate([*sequences, np.zeros(0, dtype=np.int64)]).astype(np.int64), np.cumsum(rest) - rest
    first, tail = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    owner, symbols, common = np.arange(m), np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
    row = np.arange(m)
    done = 0
    while True:
        active = np.flatnonzero(rest > done)
        if not len(active):
            return owner, symbols, common
        symbol = flat[base[active] + rest[active] - 1 - done]
        order = np.argsort(symbol * _BIG + row[active])
        active, symbol = active[order], symbol[order]
        old = len(first)
        ahead = np.searchsorted(first * _BIG + tail, symbol * _BIG + row[active])
        new = ahead + np.arange(len(active))
        kept = np.arange(old) + np.cumsum(np.bincount(ahead, minlength=old + 1))[:old]
        merged_first, merged_tail = np.empty(old + len(active), dtype=np.int64), np.empty(old + len(active), dtype=np.int64)
        merged_first[kept], merged_first[new] = first, symbol
        merged_tail[kept], merged_tail[new] = tail, row[active]
        merged_common = np.zeros(m + len(merged_first), dtype=np.int64)
        merged_common[m + kept] = common[m:]
        changed = np.unique(np.concatenate([new, new + 1]))
        changed = changed[changed < len(merged_first)]
        merged_common[m + changed] = 0
        same = changed[changed > 0]
        same = same[merged_first[same] == merged_first[same - 1]]
        if len(same):
            ranges = np.stack([merged_tail[same - 1] + 1, merged_tail[same] + 1], axis=1).ravel()
            shared = np.minimum.reduceat(np.append(common, 0), ranges)[::2]
            merged_common[m + same] = weight[merged_first[same]] + shared
        moved = np.concatenate([np.arange(m), m + kept])
        first, tail, common = merged_first, moved[merged_tail], merged_common
        for_owner, for_symbols = np.empty(m + len(first), dtype=np.int64), np.empty(m + len(first), dtype=np.int64)
        for_owner[moved], for_owner[m + new] = owner, active
        for_symbols[moved], for_symbols[m + new] = symbols, done + 1
        owner, symbols = for_owner, for_symbols
        row = row.copy()
        row[active] = m + new
        done += 1


def repeated_windows(group: list[tuple[int, bytes, bytes, int, int]], length: int, step: int) -> list[np.ndarray]:
    """For each sequence (core number, left, right, windows, weight) which of its windows repeat within the batch or by weight."""
    core = length - step + 1
    sequences = [np.concatenate([np.frombuffer(left, np.uint8), [256 + number], np.frombuffer(right, np.uint8)]).astype(np.int64) for number, left,
        right, _, _ in group]
    weight = np.ones(257 + max(g[0] for g in group), dtype=np.int64)
    weight[256:] = core
    owner, symbols, common = column_sort(sequences, weight)
    shares = common >= length
    shares[:-1] |= shares[1:]
    out = [np.full(windows, w > 1) for _, _, _, windows, w in group]
    # a window starts in the left margin or at the core
    start = np.array([len(s) for s in sequences])[owner] - symbols
    at = np.flatnonzero(shares & (start < np.array([g[3] for g in group])[owner]))
    for r in at.tolist():
        out[owner[r]][start[r]] = True
    return out


def finer(first: int, core: int, windows: int, left: bytes, right: bytes, step: int, new: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(core key, first window, windows, left margin, right margin) of a sequence's windows, parted by cores of step `new`.

    A window has l bytes of the left margin; windows of one l // new share l // new * new of them, and as many bytes of the
    right margin as all of them reach: these go into the core.
    """
    at = np.arange(windows)
    part = (len(left) - at) // new
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(cuts.tolist(), np.append(cuts, windows)[1:].tolist(), strict=True):
        c = int(part[a])
        inner = len(left) - c * new
        reach = step - new - c * new
        digest = xxhash.xxh3_64_intdigest(core.to_bytes(8, "little") + left[inner:] + b"|" + right[:reach], seed=c + 1)
        yield digest, first + a, b - a, left[a:inner], right[reach : step - 1 - (len(left) - (b - 1))]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


class Columns:
    """Rows gathered by column, put out as batches."""

    def __init__(self, **kinds: pa.DataType):
        self.kinds = kinds
        self.clear()

    def clear(self) -> None:
        self.held: dict[str, list] = {name: [] for name in self.kinds}

    def add(self, *values) -> None:
        for column, value in zip(self.held.values(), values, strict=True):
            column.append(value)

    def batch(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(self.held[n], kind) for n, kind in self.kinds.items()], list(self.kinds))
        self.clear()
        return made

    def full(self) -> bool:
        return len(next(iter(self.held.values()))) >= 10_000


def _parts_batch() -> Columns:
    return Columns(doc=pa.binary(), first=pa.int64(), core=pa.int64(), windows=pa.int64(), left=pa.binary(), right=pa.binary())


_PARTS = "doc binary, first long, core long, windows long, left binary, right binary"


def find_segments(docs: DataFrame, length: int) -> DataFrame:
    """doc (MD5 of the text), first, windows, key, digest, inner: segments of all texts. docs: text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Columns(doc=pa.binary(), first=pa.int64(), windows=pa.int64(), key=pa.int64(), digest=pa.binary(), inner=pa.bool_())
        for batch in batches:
            for text in batch.column("text"):
                raw = (text.as_py() or "").encode()
                mine = hashlib.md5(raw).digest() if len(raw) >= length else b""
                for k, low, n, places in segments(raw, length):
                    out.add(mine, low, n, _signed(k), xxhash.xxh3_128_digest(raw[low : low + n - 1 + length]), len(places) > 1)
                if out.full():
                    yield out.batch()
        yield out.batch()

    return docs.mapInArrow(lean(cut), "doc binary, first long, windows long, key long, digest binary, inner boolean")


def part_segments(docs: DataFrame, chosen: DataFrame, length: int, step: int) -> DataFrame:
    """Parts of the chosen segments (doc, first, windows, key). The texts that have any meet their segments by digest."""
    listed = chosen.groupBy("doc").agg(F.collect_set(F.struct("first", "windows", "key")).alias("segments"))
    keyed = docs.select("text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("doc"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _parts_batch()
        for batch in batches:
            for doc, text, found in zip(batch.column("doc"), batch.column("text"), batch.column("segments"), strict=True):
                raw, doc = text.as_py().encode(), doc.as_py()
                for segment in found.as_py():
                    low, n, key = segment["first"], segment["windows"], segment["key"] % 2**64
                    places = low + np.flatnonzero(gram_hashes(np.frombuffer(raw, np.uint8, n - 1 + length, low)) == np.uint64(key))
                    for c, a, w, x, y in parts(raw, key, low, n, places, length, step):
                        out.add(doc, a, _signed(c), w, x, y)
                    if out.full():
                        yield out.batch()
        yield out.batch()

    return keyed.join(listed, "doc").select("doc", "text", "segments").mapInArrow(lean(part), _PARTS)


def sort_parts(rows: DataFrame, scratch: Scratch, length: int, step: int, hot_sequences: int, batch_symbols: int) -> tuple[DataFrame, DataFrame | None]:
    """(doc, first, windows of runs that start elsewhere too; the rows of cores with too many sequences, None if there are none)."""
    sequences = rows.groupBy("core", "windows", "left", "right").agg(F.count("*").alias("n"))
    sequences = scratch.save(sequences, "sequences")
    cores = sequences.groupBy("core").agg(F.count("*").alias("ways"), F.sum("n").alias("all")).where("all > 1")
    cores = scratch.save(cores, "cores")
    few = cores.where(F.col("ways") <= hot_sequences).select("core")
    met = sequences.join(few, "core").select("core", "windows", "left", "right", "n")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes, int, int]] = []
        names: list[int] = []
        number, symbols, last = -1, 0, None
        out = Columns(core=pa.int64(), windows=pa.int64(), left=pa.binary(), right=pa.binary(), at=pa.int64(), run=pa.int64())

        def flush() -> None:
            nonlocal held, names, number, symbols
            for (_, left, right, windows, _), name, flags in zip(held, names, repeated_windows(held, length, step) if held else [], strict=True):
                for at, run in runs(flags):
                    out.add(name, windows, left, right, at, run)
            held, names, number, symbols = [], [], -1, 0

        for batch in batches:
            for core, windows, left, right, n in zip(*(batch.column(c).to_pylist() for c in ("core", "windows", "left", "right", "n")), strict=True):
                if core != last:
                    if symbols > batch_symbols:
                        flush()
                        if out.full():
                            yield out.batch()
                    last, number = core, number + 1
                held.append((number, left, right, windows, n))
                names.append(core)
                symbols += len(left) + len(right) + 1
        flush()
        yield out.batch()

    kind = "core long, windows long, left binary, right binary, at long, run long"
    found = scratch.save(met.repartition("core").sortWithinPartitions("core").mapInArrow(lean(sort), kind), "found")
    # both sides meet by two hashes of the sequence, at every size alike: margins stay out of the shuffle
    named = ("core", "windows", "left", "right")
    hashes = [F.xxhash64(*named).alias("h1"), F.xxhash64(F.lit("second"), *named).alias("h2")]
    sites = rows.select("doc", "first", *hashes).join(found.select("at", "run", *hashes), ["h1", "h2"])
    repeats = scratch.save(sites.select("doc", (F.col("first") + F.col("at")).alias("first"), F.col("run").alias("windows")), "repeats")
    scratch.drop(sequences, found)
    hot = cores.where(F.col("ways") > hot_sequences).select("core")
    return repeats, rows.join(hot, "core", "left_semi") if hot.limit(1).count() else None


def part_again(rows: DataFrame, step: int, new: int) -> DataFrame:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _parts_batch()
        for batch in batches:
            for doc, first, core, windows, left, right in zip(*(batch.column(c).to_pylist()
                for c in ("doc", "first", "core", "windows", "left", "right")), strict=True):
                for c, a, w, x, y in finer(first, core % 2**64, windows, left, right, step, new):
                    out.add(doc, a, _signed(c), w, x, y)
                if out.full():
                    yield out.batch()
        yield out.batch()

    return rows.select("doc", "first", "core", "windows", "left", "right").mapInArrow(lean(part), _PARTS)


def find_repeats(docs: DataFrame, scratch: Scratch, length: int, step: int, hot_sequences: int, batch_symbols: int) -> DataFrame:
    """doc (MD5 of the text), first, windows: runs of windows that start elsewhere too. docs: text."""
    cuts = scratch.save(find_segments(docs, length), "segments")
    same = cuts.groupBy("key", "digest").agg(F.count("*").alias("n"), F.max("inner").alias("inner"))
    same = scratch.save(same, "same")
    # a sequence of weight over 1 repeats as a whole
    twice = same.where("n > 1").select("key", "digest")
    repeats = scratch.save(cuts.join(twice, ["key", "digest"], "left_semi").select("doc", "first", "windows"), "whole")
    keys = same.groupBy("key").agg(F.count("*").alias("n"), F.max("inner").alias("inner")).where("n > 1 or inner").select("key")
    keys = scratch.save(keys, "keys")
    chosen = cuts.join(keys, "key", "left_semi").select("doc", "first", "windows", "key")
    rows: DataFrame | None = scratch.save(part_segments(docs, chosen, length, step), "parts")
    scratch.keep_only(repeats, rows)
    while True:
        found, rows = sort_parts(rows, scratch, length, step, hot_sequences if step > 1 else 1 << 62, batch_symbols)
        repeats = repeats.unionByName(found)
        if rows is None:
            return repeats
        new = max(1, step // 8)
        while step % new:
            new -= 1
        rows, step = scratch.save(part_again(rows, step, new), "parts"), new


def remove_repeats(docs: DataFrame, length: int = 400, step: int = 64, id_col: str = "doc_id", text_col: str = "text", hot_sequences: int = 20_000,
    batch_symbols: int = 60_000, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per input row; with keep_text also kept (the bytes that stay)
    and text (the characters that do)."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    repeats = find_repeats(docs.select("text"), scratch, length, step, hot_sequences, batch_symbols)
    spans = repeats.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("first", "windows"))).alias("spans"))
    spans = scratch.save(spans, "spans")
    scratch.keep_only(spans)
    keyed = docs.withColumn("doc", F.unhex(F.md5(F.col("text").cast("binary"))))
    with_spans = keyed.join(spans, "doc", "left").select("doc_id", "text", F.transform("spans", lambda s: s["first"]).alias("first"),
        F.transform("spans", lambda s: s["windows"]).alias("windows"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans_, digests, stay, texts = [], [], [], [], [], []
            for text, first, windows in zip(batch.column("text"), batch.column("first"), batch.column("windows"), strict=True):
                raw = (text.as_py() or "").encode()
                pieces, at, gone, n = [], 0, 0, 0
                for low, w in zip(first.as_py() or (), windows.as_py() or (), strict=True):
                    high = low + w - 1 + length
                    if low > at or (low == at and not n):
                        n += 1
                        pieces.append(raw[at:low])
                        gone += high - low
                        at = high
                    elif high > at:
                        gone += high - at
                        at = high
                pieces.append(raw[at:])
                left = b"".join(pieces)
                sizes.append(len(raw))
                removed.append(gone)
                spans_.append(n)
                digests.append(hashlib.sha256(left).hexdigest())
                stay.append(left)
                texts.append(None if not text.is_valid else "".join([x.decode("utf-8", "ignore") for x in pieces]))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans_, pa.int64()),
                pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(stay, pa.binary()), pa.array(texts, pa.string())] if keep_text else []),
                names + (["kept", "text"] if keep_text else []))

    return with_spans.mapInArrow(lean(kept), f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (
        ", kept binary, text string" if keep_text else ""))
