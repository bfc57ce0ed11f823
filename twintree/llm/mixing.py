"""Operator 7: mixing sources to target weights by iterative proportional fitting, then calibrated sampling.

Documents fall into cells of source, language and topic. Margin after margin, each value gets the factor at which the
expected tokens of its cells are its target; a cell's inclusion probability is the product of its three factors, at most 1.
The bound is part of the fitting, so what full cells cannot give is raised from the other cells of the same value in the
next rounds, and the margins are met with the bound in force. A document stays if a uniform number made from its id and
the seed is below its cell's probability.

Targets default to the present shares to the power `temper`, which brings large sources down and small ones up; given
shares are scaled to what is present. A value cannot get more than all its tokens: a target above that is cut to it, and
the rest of the margin takes over the difference in proportion; margins that cannot be met together are all moved towards
an even sample, as little as needed (see fit). `shares` tells present, target and reached shares. The
topic is told from the text's surface unless a column is named.

Cells are combinations of three short labels. They are raked on the driver, in arrays of six numbers a cell, and given to
the tasks as a table that Spark broadcasts if it is small and shuffles otherwise.

Cases: null sources, languages and topics are values of their own; a null or empty text has no tokens and stays with its
cell's probability (that of 1 if the cell has no tokens); null ids are drawn as the text "null"; repeated rows are drawn
alike; an empty table gives an empty result; other columns are handed through, and columns named topic, n_words and
inclusion are replaced where they are not the topic asked for.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Cells of so few rows are broadcast; Spark joins more of them as it sees fit.
BROADCAST_CELLS = 100_000
MARGINS = ("source", "lang", "topic")
_NULL = "\x00null"


def surface_topic(text: Column) -> Column:
    signs = F.length(F.regexp_replace(text, r"[^%$&*#!|]", "")) / F.length(text)
    return (
        F.when(text.isNull() | (F.length(text) == 0), "empty")
        .when(text.rlike(r"(?i)\blicen[sc]e"), "legal")
        .when(text.rlike(r"(?m)^[^|\n]*\|[^|\n]*\|"), "table")
        .when(signs > 0.05, "noise")
        .when(F.length(text) < 600, "note")
        .when(F.length(text) < 4000, "article")
        .otherwise("long")
    )


def count_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))), F.lit(0)).cast("long")


def feasible(share: np.ndarray, present: np.ndarray, budget: float) -> np.ndarray:
    """Tokens for each value: its share of the budget, at most what is present; the rest is spread over the others."""
    wanted = np.zeros(len(share))
    full = np.zeros(len(share), dtype=bool)
    while True:
        free = share[~full].sum()
        left = budget - present[full].sum()
        wanted = np.where(full, present, share * (left / free if free > 0 else 0.0))
        over = ~full & (wanted > present)
        if not over.any():
            return wanted
        full |= over


def _factors(code: np.ndarray, tokens: np.ndarray, chance: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each value the factor at which the tokens of its cells, min(1, factor chance) of each, are its target.

    A value's expected tokens are piecewise linear in the factor, with a bend where a cell is full: 1 / chance. So cells
    are put in order of their bends, and the piece that holds the target gives the factor.
    """
    use = (tokens > 0) & (chance > 0)
    cell = np.flatnonzero(use)
    cell = cell[np.lexsort((-chance[cell], code[cell]))]
    value, weight, rate = code[cell], tokens[cell], (tokens * chance)[cell]
    first = np.searchsorted(value, np.arange(len(target)))
    last = np.searchsorted(value, np.arange(len(target)), side="right")
    full = np.concatenate([[0.0], np.cumsum(weight)])
    rates = np.concatenate([[0.0], np.cumsum(rate)])
    # with the first k cells of the value full, the factor is (target - full tokens) / (rate of the others)
    before_full, before_rate = full[:-1] - full[first[value]], rates[:-1] - rates[first[value]]
    rest = rates[last[value]] - rates[first[value]] - before_rate
    found = np.divide(target[value] - before_full, rest, out=np.zeros(len(cell)), where=rest > 0)
    fits = found * chance[cell] <= 1 + 1e-12
    factor = np.full(len(target), np.inf)
    # the first cell in order that need not be full settles its value's factor
    order = np.flatnonzero(fits)[::-1]
    factor[value[order]] = found[order]
    return factor


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = 500, close: float = 1e-9) -> tuple[np.ndarray, float]:
    """(inclusion probabilities, largest miss of a target by share of the whole). codes: for each margin, each cell's value.

    targets: tokens of each value, at most what is present. Ends when no target is missed by more than `close`, or after so
    many rounds, which happens where the margins contradict each other within what is present.
    """
    total = max(1.0, float(tokens.sum()))
    chance, miss = np.ones(len(tokens)), 0.0
    for _ in range(rounds):
        for code, target in zip(codes, targets, strict=True):
            factor = np.minimum(_factors(code, tokens, chance, target), 1e12)
            chance = np.clip(chance * factor[code], 1e-15, 1e15)
        kept = np.minimum(1.0, chance) * tokens
        miss = max(float(np.abs(np.bincount(code, kept, len(target)) - target).max(initial=0.0)) for code, target in zip(codes, targets, strict=True)) / total
        if miss < close:
            break
    return np.where(tokens > 0, np.minimum(1.0, chance), 1.0), miss


def fit(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], keep_share: float, steps: int = 64, close: float = 1e-6) -> tuple[
    np.ndarray, list[np.ndarray], int]:
    """(inclusion probabilities, targets that they meet, steps given up).

    Margins that contradict each other are all moved towards what an even sample has, which can always be met, by the least
    number of `steps` parts at which they can be met together.
    """
    even = [keep_share * np.bincount(code, tokens, len(target)) for code, target in zip(codes, targets, strict=True)]

    def at(given: int) -> tuple[np.ndarray, float, list[np.ndarray]]:
        moved = [target + (e - target) * (given / steps) for target, e in zip(targets, even, strict=True)]
        return *rake(tokens, codes, moved), moved

    chance, miss, moved = at(0)
    low, high = 0, steps
    if miss < close:
        return chance, moved, 0
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if at(middle)[1] < close else (middle, high)
    chance, _, moved = at(high)
    return chance, moved, high


class Plan:
    """Cells with their inclusion probabilities, and the margins that they reach."""

    def __init__(self, found: list, keep_share: float, temper: float, targets: dict[str, dict[str, float]] | None):
        """found: rows of three labels and their tokens."""
        self.labels = [tuple(r[f"__{m}"] for m in MARGINS) for r in found]
        tokens = np.array([r["tokens"] for r in found], dtype=np.float64)
        budget = keep_share * tokens.sum()
        codes, wanted, self.margins = [], [], []
        for k, m in enumerate(MARGINS):
            values, code = np.unique(np.array([x[k] for x in self.labels], dtype=object).astype(str), return_inverse=True)
            present = np.bincount(code, tokens, len(values))
            asked = (targets or {}).get(m)
            share = np.array([asked.get(v, 0.0) for v in values]) if asked else np.power(present, temper)
            share = np.where(present > 0, share, 0.0)
            share = share / share.sum() if share.sum() else share
            codes.append(code)
            wanted.append(feasible(share, present, budget))
            self.margins.append((m, values, present))
        self.chance, wanted, self.given_up = fit(tokens, codes, wanted, keep_share) if found else (np.zeros(0), wanted, 0)
        kept = self.chance * tokens
        whole, held = max(1.0, tokens.sum()), max(1e-300, kept.sum())
        self.rows = []
        for (m, values, present), code, target in zip(self.margins, codes, wanted, strict=True):
            reached = np.bincount(code, kept, len(values))
            for i, v in enumerate(values):
                name = None if v == _NULL else str(v)
                self.rows.append((m, name, float(present[i] / whole), float(target[i] / max(1.0, budget)), float(reached[i] / held)))


def _keyed(docs: DataFrame, topic_col: str | None, text_col: str) -> DataFrame:
    text = F.col(text_col)
    topic = F.col(topic_col) if topic_col else surface_topic(text)
    labels = {f"__{m}": F.coalesce((topic if m == "topic" else F.col(m)).cast("string"), F.lit(_NULL)) for m in MARGINS}
    return docs.withColumns(labels).withColumn("__words", count_words(text))


def _plan(keyed: DataFrame, scratch: Scratch, keep_share: float, temper: float, targets: dict[str, dict[str, float]] | None) -> Plan:
    names = [f"__{m}" for m in MARGINS]
    cells = scratch.save(keyed.groupBy(*names).agg(F.sum("__words").alias("tokens")), "cells")
    return Plan(cells.orderBy(*names).collect(), keep_share, temper, targets)


def shares(docs: DataFrame, keep_share: float = 0.7, temper: float = 0.7, targets: dict[str, dict[str, float]] | None = None,
    topic_col: str | None = None, text_col: str = "text") -> DataFrame:
    """margin, value, present, target, reached: shares of the tokens, before and after, for each value of each margin."""
    spark = docs.sparkSession
    plan = _plan(_keyed(docs, topic_col, text_col), Scratch(spark, "mixing"), keep_share, temper, targets)
    return spark.createDataFrame(plan.rows, "margin string, value string, present double, target double, reached double")


def mix(docs: DataFrame, keep_share: float = 0.7, temper: float = 0.7, targets: dict[str, dict[str, float]] | None = None, seed: int = 17,
    topic_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", diagnose: bool = False) -> DataFrame:
    """The sampled rows of docs; with diagnose all rows without their texts, with topic, n_words, inclusion and kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    own = docs.columns
    keyed = _keyed(docs, topic_col, text_col)
    if diagnose:  # without texts the rows are short: they are kept, and texts are read once
        keyed = scratch.save(keyed.drop(text_col), "keyed")
    plan = _plan(keyed, scratch, keep_share, temper, targets)
    made = spark.createDataFrame([(*label, float(p)) for label, p in zip(plan.labels, plan.chance, strict=True)],
        ", ".join(f"__{m} string" for m in MARGINS) + ", __inclusion double")
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16,
        10).cast("double") / float(16**13)
    out = keyed.join(F.broadcast(made) if len(plan.labels) <= BROADCAST_CELLS else made, [f"__{m}" for m in MARGINS]).withColumn("__kept",
        drawn < F.col("__inclusion"))
    if not diagnose:
        return out.where("__kept").select(*own)
    rest = [c for c in own if c not in ("topic", "n_words", "inclusion", "kept", text_col)]
    return out.select(*rest, F.nullif(F.col("__topic"), F.lit(_NULL)).alias("topic"), F.col("__words").alias("n_words"),
        F.col("__inclusion").alias("inclusion"), F.col("__kept").alias("kept"))
