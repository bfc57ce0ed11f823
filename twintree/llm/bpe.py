"""Operator 9: BPE encoding and decoding through a distinct-word table.

A word is a run without white space: the tokenizer drops white space and never merges across it, so a word's ids do not
depend on its neighbours.

1. Texts are split in Spark. A chunk is a run of documents of one task with about chunk_words distinct words at most; it
   is kept as its own words, each once, and every document as codes of its words.
2. The words of all chunks meet by bucket (a checksum of the word). There every distinct word of the corpus is encoded
   once, and its ids go back to each chunk that has it.
3. A chunk's ids join its documents by place, the ids join the id-to-piece table (bounded by the vocabulary), and the
   documents' ids and texts are put together.

A chunk holds a word once, so the commonest word of all has one row for each chunk: there is no hot key. A task holds one
chunk's words, or the distinct words of one bucket; `buckets` grows with the number of documents. Two shuffles carry all:
the first the words, by bucket, the second the ids, by chunk, and both the documents' codes. A chunk is named by a digest
of its words. If a lost task runs again and its input comes out in another order, names no longer meet and the run fails,
never with wrong ids; tables read from files come out alike.

Cases: a null text counts as empty and has no ids, as has a text of white space only; special tokens written in a text
become their ids, as the tokenizers library has it; repeated rows are encoded alike; null ids are handed through; an empty
table gives an empty result; only the id, the text and the columns to keep are read.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import give_back, lean, pack_bytes, pack_ints, unpack_bytes, unpack_ints

#: str.split() also splits at these, which the tokenizer takes for symbols.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")
_SLICE_BYTES = 1 << 20
#: Words that are handed to the library at a time: an encoding takes a hundred times the memory of its ids.
_AT_ONCE = 2_000
_DOCS_AT_ONCE = 256
OUTPUTS = {"ids": "array<int>", "decoded": "string"}


def split_words(text: str | None) -> list[str]:
    if not text:
        return []
    return [w for w in _SPACE.split(text) if w] if _NOT_SPACE.search(text) else text.split()


def load_tokenizer(model: str) -> Tokenizer:
    """model: the JSON text of a tokenizer; truncation and padding stay unused."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    made = Tokenizer.from_str(model)
    made.no_truncation()
    made.no_padding()
    return made


def encode_words(tokenizer: Tokenizer, words: list[str]) -> list[list[int]]:
    found: list[list[int]] = []
    for low in range(0, len(words), _AT_ONCE):
        found += [e.ids for e in tokenizer.encode_batch_fast(words[low : low + _AT_ONCE], add_special_tokens=False)]
    return found


def text_slices(batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of slices of about _SLICE_BYTES, so that no more than a slice is split at a time."""
    column = batch.column(text_col)
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(column):
        held = sizes[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, held + _SLICE_BYTES, side="right")))
        yield low, column.slice(low, high - low).to_pylist()
        low = high


def _joined(strings: pa.Array, counts: np.ndarray) -> pa.Array:
    """Each word's strings (counts tells how many) joined by a space."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), strings), " ")


class Chunk:
    """Documents as codes of their words: 0 is the chunk's next new word, n + 1 the n-th commonest of the repeated ones."""

    def __init__(self):
        self.index: defaultdict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.words: list[np.ndarray] = []
        self.rows: list[pa.RecordBatch] = []

    def add(self, rows: pa.RecordBatch, texts: list[str | None]) -> None:
        self.rows.append(rows)
        for text in texts:
            words = split_words(text)
            self.words.append(np.fromiter(map(self.index.__getitem__, words), dtype=np.int32, count=len(words)))

    def batches(self, number: int, buckets: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The chunk's own row, rows of the documents, and rows of the words by bucket, in the order of first use."""
        words = list(self.index)
        name = int.from_bytes(hashlib.blake2b(" ".join([str(number), *words]).encode(), digest_size=8).digest(), "little", signed=True)
        found = np.concatenate([*self.words, np.zeros(0, np.int32)])
        counts = np.bincount(found, minlength=len(words))
        repeated = np.argsort(-counts, kind="stable")[: int((counts > 1).sum())]
        code = np.zeros(len(words), dtype=np.int32)
        code[repeated] = np.arange(1, len(repeated) + 1)
        # words are numbered by first use, so a new one is larger than all before it
        new = found > np.concatenate([np.array([-1], np.int32), np.maximum.accumulate(found)])[: len(found)]
        codes = np.where(new, np.int32(0), code[found])
        del found
        ends = np.cumsum([0, *map(len, self.words)])
        firsts = np.concatenate([[0], np.cumsum(new, dtype=np.int32)])[ends]
        bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), dtype=np.int32, count=len(words))
        key = -1 - abs(name)
        yield _padded({"__key": pa.array([key]), "__chunk": pa.array([name]), "__first": pa.array([CHUNK], pa.int32()),
            "__codes": pa.array([pack_ints(repeated)], pa.binary()), "__words": pa.array([pack_ints(bucket)], pa.binary())}, 1, schema)
        at = 0
        for rows in self.rows:
            n = rows.num_rows
            packed = [pack_ints(codes[ends[k] : ends[k + 1]]) for k in range(at, at + n)]
            made = {"__key": pa.array([key] * n), "__chunk": pa.array([name] * n), "__first": pa.array(firsts[at : at + n], pa.int32()),
                "__codes": pa.array(packed, pa.binary())}
            at += n
            yield _padded(made | {c: rows.column(c) for c in rows.schema.names}, n, schema)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        texts = [pack_bytes(" ".join([words[i] for i in order[low:high]]).encode()) for low,
            high in zip(cuts.tolist(), np.append(cuts, len(words))[1:].tolist(), strict=True)]
        made = {"__key": pa.array(bucket[order[cuts]], pa.int64()), "__chunk": pa.array([name] * len(cuts), pa.int64()),
            "__first": pa.array([WORDS] * len(cuts), pa.int32()), "__words": pa.array(texts, pa.binary())}
        yield _padded(made, len(cuts), schema)


def _padded(columns: dict[str, pa.Array], rows: int, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of the schema; columns that are not given are null."""
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


#: __first of a chunk's own row and of rows of words; of documents it is the number of new words before them in the chunk.
CHUNK, WORDS = -2, -1
#: Chunks' own rows have the places of the repeated words by code, and every word's bucket in __words; rows of words have
#: the words, later their numbers of ids in __codes and their ids in __words. __key is the bucket, or below 0 by chunk.
_OWN = {"__key": pa.int64(), "__chunk": pa.int64(), "__first": pa.int32(), "__codes": pa.binary(), "__words": pa.binary()}
_KINDS = "__key long, __chunk long, __first int, __codes binary, __words binary"


def chunk_words_of(docs: DataFrame, text_col: str, chunk_words: int, chunk_bytes: int, buckets: int) -> DataFrame:
    """Rows of documents (with the columns of docs but the text) and rows of the words of each chunk and bucket."""
    kept = [f for f in docs.schema if f.name != text_col]
    names = [f.name for f in kept]

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, chunk, size, schema = TaskContext.get().partitionId() << 24, 0, Chunk(), 0, None
        for batch in batches:
            schema = schema or pa.schema([*(pa.field(n, t) for n, t in _OWN.items()), *(batch.schema.field(n) for n in names)])
            rows = batch.select(names)
            for low, texts in text_slices(batch, text_col):
                chunk.add(rows.slice(low, len(texts)), texts)
                size += sum(map(len, filter(None, texts)))
                if len(chunk.index) > chunk_words or size > chunk_bytes:
                    yield from chunk.batches(first + made, buckets, schema)
                    made, chunk, size = made + 1, Chunk(), 0
                    give_back()
        if chunk.rows:
            yield from chunk.batches(first + made, buckets, schema)

    return docs.select(*names, text_col).mapInArrow(lean(chunked), ", ".join([_KINDS, *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)]))


def encode_buckets(rows: DataFrame, model: str) -> DataFrame:
    """The rows with ids in place of words; every distinct word is encoded once, in its bucket. Other rows pass through."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known, bucket = load_tokenizer(shared.value), {}, None
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                counts, ids = part.column("__codes").to_pylist(), part.column("__words").to_pylist()
                for row, (key, first) in enumerate(zip(part.column("__key").to_pylist(), part.column("__first").to_pylist(), strict=True)):
                    if first != WORDS:
                        continue
                    if key != bucket:
                        known, bucket = {}, key
                    mine = unpack_bytes(ids[row]).decode().split(" ")
                    new = [w for w in mine if w not in known]
                    known.update(zip(new, (np.array(x, dtype=np.int32) for x in encode_words(tokenizer, new)), strict=True))
                    found = [known[w] for w in mine]
                    counts[row] = pack_ints(np.fromiter(map(len, found), dtype=np.int32, count=len(found)))
                    ids[row] = pack_ints(np.concatenate(found))
                made = {"__codes": pa.array(counts, pa.binary()), "__words": pa.array(ids, pa.binary())}
                yield pa.RecordBatch.from_arrays([made.get(c, part.column(c)) for c in part.schema.names], part.schema.names)

    return rows.repartition("__key").sortWithinPartitions("__key").mapInArrow(lean(encoded), rows.schema)


class Table:
    """A chunk's words: the number of ids, the ids and the pieces (joined by a space) by the place of first use."""

    def __init__(self, repeated: bytes, bucket: bytes, held: list[tuple[int, bytes, bytes]], pieces: pa.Array):
        """held: rows of words (bucket, counts, ids); pieces: the id-to-piece table, which ids join by position."""
        self.by_code = np.concatenate([[0], unpack_ints(repeated)])
        held = sorted(dict((b, (c, i)) for b, c, i in held).items())
        count, ids = (np.concatenate([unpack_ints(row[k]) for _, row in held] or [np.zeros(0, np.int64)]) for k in range(2))
        place = np.argsort(unpack_ints(bucket), kind="stable")
        if len(place) != len(count):
            raise RuntimeError("a chunk's words are not whole: the input came out differently when a lost task ran again; save it first")
        self.counts = np.zeros(len(place), dtype=np.int64)
        self.counts[place] = count
        self.ids, self.pieces = np.empty(len(place), dtype=object), np.empty(len(place), dtype=object)
        self.ids[place] = _joined(pa.array(ids).cast(pa.string()), count).to_numpy(zero_copy_only=False)
        self.pieces[place] = _joined(pieces.take(pa.array(ids)), count).to_numpy(zero_copy_only=False)

    def words(self, first: int, codes: np.ndarray) -> np.ndarray:
        """Places of a document's words that have ids."""
        new = codes == 0
        at = np.where(new, first + np.cumsum(new) - 1, self.by_code[codes])
        return at[self.counts[at] > 0]


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", chunk_words: int = 1 << 19,
    chunk_bytes: int = 1 << 26, buckets: int | None = None, keep_output: tuple[str, ...] = (), keep_columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; keep_output names further outputs: ids (array), decoded (text).

    keep_columns: columns of the input that are handed through. chunk_words and chunk_bytes bound a chunk (but for its last
    slice of texts); buckets: one for about 1,000 documents unless given, 64 to 2**14.
    """
    spark = docs.sparkSession
    if buckets is None:
        buckets = 1 << min(14, max(6, round(math.log2(max(1, docs.count()) / 1000 + 1))))
    kept = list(dict.fromkeys((id_col, *keep_columns)))
    # the text may also be asked for as a column to keep
    rows = docs.select(*kept, F.col(text_col).alias("__text"))
    chunks = chunk_words_of(rows, "__text", chunk_words, chunk_bytes, buckets)
    met = encode_buckets(chunks, model).repartition("__chunk").sortWithinPartitions("__chunk", "__first")
    shared = spark.sparkContext.broadcast(model)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_tokenizer(shared.value).get_vocab(with_added_tokens=True)
        names = [""] * (max(vocabulary.values(), default=-1) + 1)
        for piece, i in vocabulary.items():
            names[i] = piece
        pieces, chunk, held, table = pa.array(names, pa.string()), None, [], None
        own = None
        for batch in batches:
            for low in range(0, batch.num_rows, _DOCS_AT_ONCE):
                part = batch.slice(low, _DOCS_AT_ONCE)
                columns = [part.column(c).to_pylist() for c in ("__chunk", "__first", "__codes", "__words", "__key")]
                ids, decoded, n_tokens, where = [], [], [], []
                for row, (mine, first, codes, words, key) in enumerate(zip(*columns, strict=True)):
                    if mine != chunk:
                        chunk, own, held, table = mine, None, [], None
                    if first == CHUNK:
                        own = (codes, words)
                        continue
                    if first == WORDS:
                        held.append((key, codes, words))
                        continue
                    if table is None:
                        table, held = Table(*own, held, pieces), []
                    at = table.words(first, unpack_ints(codes))
                    n_tokens.append(int(table.counts[at].sum()))
                    ids.append(" ".join(table.ids[at].tolist()))
                    decoded.append(" ".join(table.pieces[at].tolist()))
                    where.append(row)
                mine = part.take(pa.array(where, pa.int64()))
                out = {c: mine.column(c) for c in kept} | {
                    "n_tokens": pa.array(n_tokens, pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                }
                if "ids" in keep_output:
                    out["ids"] = pa.array([np.fromstring(x, dtype=np.int32, sep=" ") for x in ids], pa.list_(pa.int32()))
                if "decoded" in keep_output:
                    out["decoded"] = pa.array(decoded, pa.string())
                yield pa.RecordBatch.from_pydict(out)

    fields = [f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in kept] + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string",
        *(f"{c} {OUTPUTS[c]}" for c in OUTPUTS if c in keep_output)]
    return met.mapInArrow(lean(put_together), ", ".join(fields)).withColumnRenamed(id_col, "doc_id")
