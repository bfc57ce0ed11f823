"""Operator 2: exact top-k search by inner product with norm-bucketed retrieval.

Vectors are turned into integers, laid out by length into buckets of bucket_rows, and every block of queries meets every
bucket. A query first gets a lower bound of its k-th score from the longest vectors. In a bucket that bound becomes a
local cosine threshold. If it is over 1, the bucket is passed over. If it is high, coordinate pruning keeps the rows
whose coordinates, in the query's heaviest dimensions, lie in the feasible intervals; otherwise length pruning keeps the
rows that are long enough. What is left is verified by exact integer products. Pruning only passes over rows whose score
is below the bound, so the result is exact.

A block of queries is sent only to buckets whose longest vector can reach the bound of one of its queries.

Cases: scores are exact integers; one beyond a long is put at the long's end; a vector that is null, empty or holds a null, NaN or infinite component takes no part, nor does a row with a null
id; vectors of another dimension are not compared; rows with the query's id are its own and are left out; repeated other
rows count one by one; a query repeated with the same vector is answered once; ties go to the smaller id; fewer
candidates than k give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, lean

EXACT = float(2**53)
#: From this local cosine threshold on, coordinate pruning is taken.
COORDINATE_FROM = 0.5
FOCUS = 6
#: The table of buckets is broadcast if it has no more rows.
BROADCAST_BUCKETS = 100_000


def valid_vector(vector: Column) -> Column:
    x = vector.cast("array<double>")
    return vector.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def scores_of(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer products; floating point is used where it can hold every partial sum."""
    if rows.size == 0:
        return np.zeros(len(rows), dtype=np.int64)
    if np.abs(rows).max() * np.abs(query).max() * rows.shape[1] < EXACT:
        return (rows @ query).astype(np.int64)
    wide = [sum(int(x) * int(y) for x, y in zip(row, query, strict=True)) for row in rows]
    return np.array([max(-(2**63), min(2**63 - 1, s)) for s in wide], dtype=np.int64)


class Bucket:
    """Rows of similar length, longest first."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        lengths = np.sqrt((rows * rows).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        self.ids, self.rows, self.lengths = ids[order], rows[order], lengths[order]
        self.units = self.rows / np.maximum(self.lengths, 1e-300)[:, None]

    def candidates(self, query: np.ndarray, bound: float) -> np.ndarray:
        """Indexes of the rows that may score bound or more."""
        length = float(np.sqrt((query * query).sum()))
        everything = np.arange(len(self.ids))
        if not np.isfinite(bound) or bound <= 0 or length == 0:
            return everything
        local = bound / (length * max(float(self.lengths[0]), 1e-300)) * (1 - 1e-9)
        if local > 1:
            return everything[:0]
        if local < COORDINATE_FROM:
            return everything[: np.searchsorted(-self.lengths, -(bound / length) * (1 - 1e-9), side="right")]
        unit = query / length
        kept = np.ones(len(self.ids), dtype=bool)
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            reach = np.sqrt((1 - local**2) * max(0.0, 1 - unit[f] ** 2)) + 1e-9
            if unit[f] >= 0:
                high = 1.0 if unit[f] >= local else unit[f] * local + reach
                kept &= (self.units[:, f] >= unit[f] * local - reach) & (self.units[:, f] <= high + 1e-9)
            else:
                low = -1.0 if unit[f] <= -local else unit[f] * local - reach
                kept &= (self.units[:, f] <= unit[f] * local + reach) & (self.units[:, f] >= low - 1e-9)
        return np.flatnonzero(kept)

    def best(self, own: int, query: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.candidates(query, bound)
        at = at[self.ids[at] != own]
        scores = scores_of(self.rows[at], query)
        enough = scores >= bound
        at, scores = at[enough], scores[enough]
        order = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at][order], scores[order]


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64).reshape(-1, dim)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
    bucket_rows: int = 8192, seed_rows: int = 2048, block_queries: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score. Queries and vectors are tables with id_col and vector_col.

    bucket_rows bounds what a task holds of the vectors, block_queries of the queries, seed_rows (the longest vectors,
    which give the first bounds) what is broadcast.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")

    def whole(df: DataFrame) -> DataFrame:
        # a double from 2**53 on is whole already, and floor() would end at the longest long
        down = lambda y: F.when(F.abs(y) < F.lit(EXACT), F.floor(y).cast("double")).otherwise(y)
        ints = F.transform(F.col(vector_col).cast("array<double>"), lambda x: down(x * F.lit(float(scale))))
        found = df.where(valid_vector(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), ints.alias("ints"))
        return found.withColumn("dim", F.size("ints")).withColumn("norm", F.sqrt(F.aggregate("ints", F.lit(0.0), lambda s, x: s + x * x)))

    rows = scratch.save(whole(vectors), "rows")
    count = rows.count()
    buckets = max(1, -(-count // bucket_rows))
    laid = rows.repartitionByRange(buckets, F.col("dim"), F.desc("norm"), F.col("id")) if buckets > 1 else rows.coalesce(1)
    laid = scratch.save(laid.withColumn("bucket", F.spark_partition_id()), "laid")
    seeds: dict[int, list] = {}
    for r in rows.orderBy(F.desc("norm"), "id").limit(seed_rows).collect():
        seeds.setdefault(r["dim"], []).append((r["id"], r["ints"]))
    shared = spark.sparkContext.broadcast({d: Bucket(np.array([i for i, _ in x]), np.array([v for _, v in x])) for d, x in seeds.items()})

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries with the k-th best score among the longest vectors, packed."""
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                for at in range(0, len(part), block_queries):
                    own, query = part["id"].to_numpy()[at : at + block_queries], _matrix(part["ints"][at : at + block_queries], int(dim))
                    bounds = []
                    for i, q in zip(own, query, strict=True):
                        scores = shared.value[dim].best(i, q, -np.inf, k)[1] if dim in shared.value else ()
                        bounds.append(float(scores[-1]) if len(scores) == k else -np.inf)
                    lengths = np.sqrt((query * query).sum(axis=1))
                    # what the longest vector of a bucket must have; a bound of 0 or less can be met by any
                    needs = np.where(np.array(bounds) > 0, np.array(bounds) / np.maximum(lengths, 1e-300), 0.0) * (1 - 1e-9)
                    yield pd.DataFrame({"dim": [dim], "need": [float(needs.min())], "own": [own.astype(np.int64).tobytes()],
                        "vectors": [query.tobytes()], "bounds": [np.array(bounds).tobytes()]})

    asked = whole(queries).dropDuplicates(["id", "ints"])
    packed = scratch.save(asked.select("id", "ints", "dim").mapInPandas(lean(blocks),
        "dim int, need double, own binary, vectors binary, bounds binary"), "queries")
    none = {c: F.lit(None).cast(kind) for c, kind in (("id", "long"), ("ints", "array<double>"), ("own", "binary"), ("vectors", "binary"),
        ("bounds", "binary"))}
    left = laid.select("bucket", "dim", F.lit(0).alias("kind"), "id", "ints", none["own"].alias("own"), none["vectors"].alias("vectors"),
        none["bounds"].alias("bounds"))
    longest = laid.groupBy("bucket", "dim").agg(F.max("norm").alias("longest"))  # one row for bucket_rows vectors
    reached = packed.join(F.broadcast(longest) if buckets <= BROADCAST_BUCKETS else longest, "dim").where(F.col("longest") >= F.col("need"))
    right = reached.select("bucket", "dim", F.lit(1).alias("kind"), none["id"].alias("id"), none["ints"].alias("ints"), "own", "vectors", "bounds")

    def retrieve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A bucket's rows come first, then block after block of queries."""
        key, parts, bucket = None, [], None
        for batch in batches:
            for (b, dim), part in batch.groupby(["bucket", "dim"], sort=False):
                if (b, dim) != key:
                    key, parts, bucket = (b, dim), [], None
                own_rows = part[part["kind"] == 0]
                if len(own_rows):
                    parts.append((own_rows["id"].to_numpy(dtype=np.int64), _matrix(own_rows["ints"], int(dim))))
                asked_here = part[part["kind"] == 1]
                if not len(asked_here) or not parts:
                    continue
                bucket = bucket or Bucket(np.concatenate([i for i, _ in parts]), np.concatenate([m for _, m in parts]))
                for own, vecs, bounds in zip(asked_here["own"], asked_here["vectors"], asked_here["bounds"], strict=True):
                    out = []
                    for i, q, bound in zip(np.frombuffer(own, np.int64), np.frombuffer(vecs).reshape(-1, int(dim)), np.frombuffer(bounds), strict=True):
                        ids, scores = bucket.best(i, q, bound, k)
                        out.append(pd.DataFrame({"query_id": i, "query": int(np.frombuffer(q.tobytes(), np.int64).sum()), "vec_id": ids, "score": scores}))
                    yield pd.concat(out)

    met = left.unionByName(right).repartition(buckets, "bucket").sortWithinPartitions("bucket", "dim", "kind")
    found = met.mapInPandas(lean(retrieve), "query_id long, query long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
