"""Operator 8: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from labels: words and word beginnings that are far commoner in toxic than in clean texts; a
short fixed list of insults stands beside it. Features are the densities of both, hits near the second person, capitals,
punctuation, and obfuscation (digits and signs inside words, stretched letters, lexicon words that show only after such
signs are undone). A training text's own counts are left out when its features are made, so that the lexicon does not
flatter the trees; calibration uses margins of trees that have not seen the row.

Labels are taken only from rows whose crc32 of the id, as text, is not divisible by 5. The lexicon, the trees and the
calibration are fitted on at most sample_rows of them, chosen by a hash of the id, and the lexicon has at most lexicon_parts
words and beginnings; scores are computed for all rows and whole texts.

Cases: a null text is scored as an empty one; a null id cannot be labelled or held out; null labels are passed over, and
an id labelled more than once is toxic if any label says so; without labels of both kinds the score is their mean, or 0;
a repeated id in the documents gives each of its rows a score; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, Isotonic, fit_isotonic, fit_trees
from .bpe import text_slices
from .common import Scratch, lean

# Insults, second-person words, and signs that stand for letters.
INSULTS = frozenset("idiot moron loser scum trash stupid pathetic worthless disgusting clown dumb imbecile filth bastard".split())
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch usted ustedes ti tus vosotros".split())
UNDO = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

BEGINNINGS = (3, 4, 5, 6, 7)
_WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"\S+")
_INSIDE = re.compile(r"[^\W\d_][\d@$!*.\-_]+[^\W\d_]")
_STRETCHED = re.compile(r"([^\W\d_])\1{3,}")
_SIGNS = re.compile(r"[^\w\s]")
_RUNS = re.compile(r"[^\w\s]{2,}")
_NEAR = 5
_CACHE_WORDS = 200_000


def parts_of(word: str) -> list[str]:
    """The word, and its beginnings marked by a star."""
    return [word, *[word[:n] + "*" for n in BEGINNINGS if n < len(word)]]


@dataclass
class Lexicon:
    """Counts of training texts with a part: toxic, clean."""

    toxic: int
    clean: int
    counts: dict[str, tuple[int, int]] = field(default_factory=dict)

    def weight(self, part: str, label: int | None, shown: bool) -> float:
        """The part's log-odds if it is in the lexicon, else 0; label: of the text that is left out, None if none is."""
        t, c = self.counts.get(part, (0, 0))
        n, m = self.toxic, self.clean
        if label is not None and shown:
            t, c, n, m = t - label, c - (1 - label), n - label, m - (1 - label)
        if t < 3:
            return 0.0
        odds = math.log((t + 0.5) / (n + 1)) - math.log((c + 0.5) / (m + 1))
        return odds if odds > 2.0 else 0.0

    def word_weight(self, word: str, label: int | None, shown: bool = True) -> float:
        return max(self.weight(p, label, shown) for p in parts_of(word))


FEATURES = ("size", "hits", "rate", "weight", "heaviest", "insults", "second", "near", "capitals", "shouting", "signs", "runs", "exclaiming",
    "inside", "stretched", "undone", "length")


def features_of(text: str | None, weigh) -> list[float]:
    """weigh: word -> lexicon weight."""
    text = text or ""
    words = _WORD.findall(text.lower())
    n, chars = max(1, len(words)), max(1, len(text))
    weights = [weigh(w) for w in words]
    hits = [i for i, w in enumerate(weights) if w]
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if hits and you:
        at = np.searchsorted(you, hits)
        gaps = np.minimum(np.abs(np.array(hits) - np.array(you)[np.minimum(at, len(you) - 1)]), np.abs(np.array(hits) - np.array(you)[np.maximum(at - 1, 0)]))
        near = int((gaps <= _NEAR).sum())
    inside = _INSIDE.findall(text)
    undone = 0
    if inside:
        odd = [t for t in _TOKEN.findall(text.lower()) if _INSIDE.search(t)]
        undone = sum(1 for t in odd if any(weigh(w) or w in INSULTS for w in (re.sub(r"[^\w]|_", "", t.translate(UNDO)), re.sub(r"[^\w]|_|\d", "", t))))
    stretched = len(_STRETCHED.findall(text))
    return [
        math.log1p(len(words)), math.log1p(len(hits)), len(hits) / n, sum(weights) / n, max(weights, default=0.0), sum(1 for w in words if w in INSULTS) / n,
        len(you) / n, near / n, sum(map(str.isupper, text)) / chars,
        len(re.findall(r"\b[A-Z]{3,}\b", text)) / n, len(_SIGNS.findall(text)) / chars, len(_RUNS.findall(text)) / n, text.count("!") / n,
        len(inside) / n, stretched / n, math.log1p(undone), sum(map(len, words)) / n,
    ]


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: BoostedTrees | None
    calibration: Isotonic | None
    constant: float = 0.0

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(features), self.constant)
        return self.calibration(self.trees.margin(features))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_rows: int = 12_000, folds: int = 4, lexicon_parts: int = 50_000) -> ToxicityModel:
    """sample_rows bounds the labelled rows that are learned from, lexicon_parts the lexicon (parts of most toxic texts first)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    marked = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max((F.col(label_col) > 0).cast("int")).alias("toxic"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(marked), "doc_id").select("text", "toxic")
    sample = scratch.save(sample, "sample")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        rows = [0, 0]
        for batch in batches:
            for low, texts in text_slices(batch, "text"):
                for text, toxic in zip(texts, batch.column("toxic").slice(low, len(texts)).to_pylist(), strict=True):
                    held[toxic].update({p for w in set(_WORD.findall((text or "").lower())) for p in parts_of(w)})
                    rows[toxic] += 1
                if sum(map(len, held)) > 600_000:
                    yield packed(held, rows)
                    held, rows = (Counter(), Counter()), [0, 0]
        yield packed(held, rows)

    def packed(held, rows) -> pa.RecordBatch:
        parts = list(held[0].keys() | held[1].keys())
        return pa.RecordBatch.from_pydict({"part": pa.array([*parts, ""], pa.string()),
            "t": pa.array([*[held[1][p] for p in parts], rows[1]], pa.int64()), "c": pa.array([*[held[0][p] for p in parts], rows[0]], pa.int64())})

    counts = sample.mapInArrow(lean(counted), "part string, t long, c long").groupBy("part").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    # only parts of enough toxic texts, and at least twice as common there as elsewhere, can come into the lexicon
    total = counts.where("part = ''").first()
    toxic, clean = (int(total["t"]), int(total["c"])) if total else (0, 0)
    if not toxic or not clean:
        return ToxicityModel(Lexicon(0, 0), None, None, float(toxic > 0))
    found = counts.where(F.col("part") != "").where((F.col("t") >= 3) & (F.col("t") * F.lit(clean) > 2 * F.col("c") * F.lit(toxic)))
    lexicon = Lexicon(toxic, clean, {r["part"]: (r["t"], r["c"]) for r in found.orderBy(F.desc("t"), "part").limit(lexicon_parts).collect()})
    shared = spark.sparkContext.broadcast(lexicon)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, marks = [], []
            for low, texts in text_slices(batch, "text"):
                for text, label in zip(texts, batch.column("toxic").slice(low, len(texts)).to_pylist(), strict=True):
                    own = {p for w in set(_WORD.findall((text or "").lower())) for p in parts_of(w)}
                    known: dict[str, float] = {}

                    def weigh(word: str, known=known, own=own, label=label) -> float:
                        if word not in known:
                            known[word] = max(shared.value.weight(p, label, p in own) for p in parts_of(word))
                        return known[word]

                    made.append(features_of(text, weigh))
                    marks.append(label)
            yield pa.RecordBatch.from_pydict({"x": pa.array(made, pa.list_(pa.float64())), "y": pa.array(marks, pa.int32())})

    rows = sample.mapInArrow(lean(left_out), "x array<double>, y int").collect()
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["x"], rows[i]["y"]))
    x, y = np.array([rows[i]["x"] for i in order]), np.array([rows[i]["y"] for i in order], dtype=np.float64)
    fold = np.random.default_rng(11).integers(0, folds, len(y))
    margin = np.zeros(len(y))
    for k in range(folds):
        if (fold == k).any() and (fold != k).any():
            margin[fold == k] = fit_trees(x[fold != k], y[fold != k]).margin(x[fold == k])
    return ToxicityModel(lexicon, fit_trees(x, y), fit_isotonic(margin, y))


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the columns score and predicted after theirs (which replace columns of these names)."""
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}

        def weigh(word: str) -> float:
            found = known.get(word)
            if found is None:
                if len(known) > _CACHE_WORDS:
                    known.clear()
                found = known[word] = shared.value.lexicon.word_weight(word, None)
            return found

        for batch in batches:
            for low, texts in text_slices(batch, text_col):
                score = shared.value.score(np.array([features_of(t, weigh) for t in texts]))
                columns = [batch.column(c).slice(low, len(texts)) for c in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    [*batch.schema.names, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double, predicted int"
    return docs.mapInArrow(lean(scored), schema)
